"""SimHash near-deduplication of documents: one of each group stays.

Two documents are near-duplicates if their sets of 5-word shingles have a Jaccard
similarity of 0.8 or more. Documents of equal sets are one node. Nodes meet in
buckets: the groups that simhash.py finds among their fingerprints (operator 1, by its
pivot distance tables), and BANDS keys of ROWS minimum hashes each (at a similarity of 0.8
a pair shares one with a probability over 0.9999), since fingerprints of such a pair may
differ in many bits.

A pair from a bucket passes a fingerprint test that loses none. A bit is the sign of
a sum of +-1 over the set, and two sets of n shingles or so at 0.8 differ in at most n / 4
shingles: a bit whose sum is beyond that is firm, the other set has it too. So two
fingerprints may differ only in bits that are loose in both: pivot coordinates by
at most so many, then the bits themselves. For small sets that discards most pairs,
for large ones few. What passes is verified by exact similarity of the sets of
64-bit shingle hashes.

A bucket doesn't form all its pairs. First every node meets the smallest node of each
of its buckets, and components are formed. What is then still apart is described by
its differences from the majority set of its cluster of buckets: sets that are close to that
are similar for certain and are linked to the closest one (_sure), and members of different
components of a bucket meet less the pairs that exact bounds rule out (_across). A pair
inside one component adds nothing to the groups, so none is lost by that.

Defined results: null and blank documents are one group; of texts that have no word
(punctuation only) those equal but for white space are near-duplicates. The smallest
doc_id of a group stays, nulls last, ties by a hash of the text; of rows that agree
in id and text one stays. An empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch, by_bytes, connected_components, flat_utf8, maybe_in, small_batches
from ._words import bit_rows, mix, shingle_hashes, word_hashes
from .simhash import PIVOTS, pivot_table
from .simhash import links as print_links

SHINGLE = 5
#: Numerator and denominator: compared in whole numbers.
THRESHOLD = 4, 5
BANDS, ROWS = 26, 5
#: Nodes of a cluster that meet its centre under one salt.
SALTED = 64
#: Bytes of text that are hashed at a time: that takes some 40 times their memory.
BYTES = 1 << 20
#: Hash classes in which shared differences are counted.
CLASSES = 64
_A = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_C = mix(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64))


def shingles(flat: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Shingle hashes of each text, repeats included; a text of fewer words is one shingle, and so is one that has no
    word but isn't blank (its runs of white space count as one)."""
    words, first = word_hashes(flat, offsets)
    s = shingle_hashes(words, SHINGLE)
    out = []
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        n = b - a
        if n:
            out.append(s[a : b - SHINGLE + 1] if n >= SHINGLE else shingle_hashes(words[a:b], n))
        else:
            signs = b" ".join(flat[offsets[i] : offsets[i + 1]].tobytes().split())
            out.append(np.array([xxhash.xxh64_intdigest(signs, 5)] if signs else [], np.uint64))
    return out


def band_keys(distinct: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(distinct), 2048):
        np.minimum(low, (distinct[i : i + 2048, None] * _A + _C).min(axis=0), out=low)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def print_of(distinct: np.ndarray) -> tuple[int, int]:
    """(fingerprint, firm bits) of a set: firm is what no set at THRESHOLD to it can have otherwise."""
    n = len(distinct)
    total = 2 * bit_rows(distinct).sum(axis=0, dtype=np.int64) - n
    most = differences(n)
    pack = lambda bits: int(np.packbits(bits.astype(np.uint8), bitorder="little").view("<u8")[0])
    # a sum of 0 is no bit, as one below 0
    return pack(total > 0), pack((total - most > 0) | (total + most <= 0))


def differences(n: int) -> int:
    """Shingles in which a set at THRESHOLD to one of n differs at most: the larger is at most 5/4 of the smaller, and of n + m
    a ninth may differ."""
    a, b = THRESHOLD
    return (b - a) * (n + n * b // a) // (a + b)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with id__ (doc_id, nulls last) and th__ (hash of the text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"id__": F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)), "th__": F.xxhash64(text)})


def sketches(docs: DataFrame) -> DataFrame:
    """(id__, th__, node, fp, firm, n, bands): node is a hash of the set of shingles; fp, firm, n (its size) and bands are the set's, repeats don't count."""
    names = ["id__", "th__", "node", "fp", "firm", "n", "bands"]

    def run(batches):
        for b in by_bytes(batches, 2, BYTES):
            node, prints, n, bands = [], [], [], []
            for s in shingles(*flat_utf8(b.column(2))):
                u = np.unique(s)
                node.append(xxhash.xxh64_intdigest(u.tobytes(), 7))
                prints.append(print_of(u))
                n.append(len(u))
                bands.append(band_keys(u).view(np.int64))
            sign = lambda x: pa.array(np.array(x, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sign(node), *(sign([x[k] for x in prints]) for k in range(2)), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=names)

    return docs.select("id__", "th__", F.col("text").cast("string").alias("text")).mapInArrow(run, "id__ bigint, th__ bigint, node bigint, fp bigint, firm bigint, n bigint, bands array<bigint>")


def _place() -> Column:
    return F.xxhash64("id__", "th__")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles binary) of the documents that stand for nodes (id__, th__, node). Other texts aren't shuffled, as far as a Bloom filter can tell them."""

    def run(batches):
        for b in by_bytes(batches, 1, BYTES):
            sets = [np.unique(s.astype("<u8").view("<i8")).tobytes() for s in shingles(*flat_utf8(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    wanted = nodes.select("id__", "th__", "node")
    maybe = maybe_in(wanted.select(_place().alias("h")), wanted.count())
    own = docs.select("id__", "th__", F.col("text").cast("string").alias("text")).where(maybe(_place()))
    return own.join(wanted.hint("shuffle_hash"), ["id__", "th__"]).select("node", "text").mapInArrow(run, "node bigint, shingles binary").dropDuplicates(["node"])


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) of sufficient similarity."""

    def run(batches):
        for b in by_bytes(batches, 2):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = _numbers(x), _numbers(y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(sum(THRESHOLD) * both >= THRESHOLD[0] * (len(p) + len(q)))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], names=["u", "v"])

    u = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    v = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    return pairs.join(u, "u").join(v, "v").select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


def _may_be(p: str, q: str) -> Column:
    """Whether two nodes (n, fp, firm, pivots) may be at THRESHOLD: sizes, pivot coordinates, then the bits that are firm in either."""
    loose = F.expr(f"64 - greatest(bit_count({p}.firm), bit_count({q}.firm))")
    out = F.expr(f"5 * least({p}.n, {q}.n) >= 4 * greatest({p}.n, {q}.n)")
    for i in range(PIVOTS):
        out = out & (F.expr(f"abs({p}.pivots[{i}] - {q}.pivots[{i}])") <= loose)
    return out & F.expr(f"(({p}.fp ^ {q}.fp) & ({p}.firm | {q}.firm)) = 0")


def _passing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) that pass the fingerprint test."""
    side = lambda node, c: nodes.select(F.col("node").alias(node), F.struct("fp", "firm", "n", pivot_table(F.col("fp")).alias("pivots")).alias(c))
    return pairs.join(side("u", "p"), "u").join(side("v", "q"), "v").where(_may_be("p", "q")).select("u", "v")


def groups(docs: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame]:
    """keyed() docs -> sketches (id__, th__, node), and the names (node, root) of nodes that share a bucket; others are alone."""
    sketched = s.keep(sketches(docs))
    bands = sketched.select("node", F.posexplode("bands").alias("t", "k")).select("node", F.xxhash64("t", "k").alias("k"))
    # operator 1's groups of fingerprints; equal ones that have no neighbour are a group too
    linked = connected_components(print_links(s.keep(sketched.select("fp").distinct()), s), s).withColumnRenamed("node", "fp")
    prints = sketched.select("node", "fp").join(linked, "fp", "left").select("node", F.xxhash64(F.lit(BANDS), F.coalesce("root", "fp")).alias("k"))
    buckets = bands.unionByName(prints)
    shared = buckets.groupBy("k").agg(F.min("node").alias("v"), F.max("node").alias("hi")).where("v < hi").select("k", "v")
    met = s.keep(buckets.join(shared, "k").select("k", "node", "v").distinct())
    few = sketched.join(met.select("node").distinct(), "node", "left_semi")
    nodes = s.keep(few.groupBy("node").agg(F.min(F.struct("id__", "th__")).alias("first"), F.first("fp").alias("fp"), F.first("firm").alias("firm"), F.first("n").alias("n")).select("node", "first.*", "fp", "firm", "n"))
    sets = s.keep(_sets(docs, nodes))
    # each node meets the smallest of each of its buckets: at most BANDS + 1 pairs a node
    pairs = s.keep(_passing(met.where("node <> v").select(F.col("node").alias("u"), "v").distinct(), nodes))
    names = _merge(nodes.select("node", F.col("node").alias("root")), s.keep(_verify(pairs, sets)), s)
    # buckets that still hold more than one component
    open_ = s.keep(_split(met.select("k", "node").join(names, "node"), "k").select("k", "node"))
    s.drop(met, pairs)
    deltas = _deltas(sets, _clusters(open_, s), s)
    names = _merge(names, s.keep(_sure(deltas)), s)
    links = s.keep(_verify(s.keep(_across(open_, deltas.join(names, "node"), nodes, s)), sets))
    return sketched.select("id__", "th__", "node"), _merge(names, links, s)


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def _each(*columns: str):
    """For mapInArrow: one row (h, the columns) of each number in the binary column that comes first."""

    def run(batches):
        for batch in batches:
            for raw, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = _numbers(raw)
                for i in range(0, len(h), 1 << 16):
                    part = h[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(np.full(len(part), x, np.int64)) for x in rest)], names=["h", *columns])

    return run


def _clusters(open_: DataFrame, s: Scratch) -> DataFrame:
    """(node, c, size, salt): nodes that buckets (k, node) connect have one c; a salt is of about SALTED nodes."""
    low = open_.groupBy("k").agg(F.min("node").alias("v"))
    named = connected_components(open_.join(low, "k").select(F.col("node").alias("u"), "v"), s).select("node", F.col("root").alias("c"))
    sizes = named.groupBy("c").agg(F.count("*").alias("size"))
    return s.keep(named.join(sizes, "c").select("node", "c", "size", F.expr(f"pmod(xxhash64(node), 1 + size div {SALTED})").alias("salt")))


def _deltas(sets: DataFrame, clusters: DataFrame, s: Scratch) -> DataFrame:
    """(node, c, n, d, delta binary): the n shingles of a set, and the d in which it differs from its cluster's centre.

    The centre holds what over half the cluster's sets hold, so it has at most twice their mean length."""

    def differ(batches):
        for b in by_bytes(batches, 2):
            n, d, out = [], [], []
            for raw, centre in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                own = _numbers(raw)
                delta = np.setxor1d(own, centre.values.to_numpy(), assume_unique=True) if centre.is_valid else own
                n.append(len(own))
                d.append(len(delta))
                out.append(delta.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(out, pa.binary())], names=["node", "c", "n", "d", "delta"])

    own = sets.select("node", "shingles").join(clusters, "node")
    rows = own.select("shingles", "c", "size").mapInArrow(_each("c", "size"), "h bigint, c bigint, size bigint")
    most = rows.groupBy("c", "size", "h").agg(F.count("*").alias("count")).where("2 * count > size")
    centre = most.groupBy("c", "size").agg(F.collect_list("h").alias("centre")).select("c", F.explode(F.expr(f"sequence(0L, size div {SALTED})")).alias("salt"), "centre")
    return s.keep(own.join(centre, ["c", "salt"], "left").select("node", "c", "shingles", "centre").mapInArrow(differ, "node bigint, c bigint, n bigint, d bigint, delta binary"))


def _sure(deltas: DataFrame) -> DataFrame:
    """(u, v): each node with the one closest to its cluster's centre, if their differences to it alone prove 0.8."""
    slack = deltas.select("node", "c", F.expr("n - 9 * d").alias("s"))
    best = slack.groupBy("c").agg(F.max(F.struct("s", "node")).alias("best"))
    return slack.join(best, "c").where("s + best.s >= 0 and node <> best.node").select(F.col("node").alias("u"), F.col("best.node").alias("v"))


def _shared(deltas: DataFrame) -> DataFrame:
    """(node, n, d, root, y, classes) of deltas with roots: y of its d differences are in another component of the
    cluster too, dealt to CLASSES hash classes."""
    rows = deltas.select("delta", "c", "node", "root").mapInArrow(_each("c", "node", "root"), "h bigint, c bigint, node bigint, root bigint")
    common = rows.groupBy("c", "h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("c", "h")
    counts = F.array(*[F.count_if(F.expr(f"pmod(h, {CLASSES}) = {i}")).cast("int") for i in range(CLASSES)])
    y = rows.select("c", "h", "node").join(common, ["c", "h"], "left_semi").groupBy("node").agg(F.count("*").alias("y"), counts.alias("classes"))
    none = F.array_repeat(F.lit(0), CLASSES)
    return deltas.select("node", "n", "d", "root").join(y, "node", "left").select("node", "n", "d", "root", F.coalesce("y", F.lit(0)).alias("y"), F.coalesce("classes", none).alias("classes"))


def _split(members: DataFrame, key: str) -> DataFrame:
    """Those members whose key holds more than one root."""
    mixed = members.groupBy(key).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(key)
    return members.join(mixed, key)


def _across(open_: DataFrame, deltas: DataFrame, nodes: DataFrame, s: Scratch) -> DataFrame:
    """(u, v) of buckets (k, node): members of different components that may be similar enough.

    Two sets differ where their deltas differ, and are at 0.8 if that is in at most a ninth of
    n + n'. Of its d differences a node shares at most y with a node of another component, so a pair at
    0.8 has 18 min(y, y') + s + s' >= 0, where s = n - 9 d. A node that meets this with no member of a
    bucket leaves it before pairs are formed, by the bucket's largest s and s + 18 y. For a pair, the
    minimum is taken class by class and summed. A pair is formed in its first common bucket only. The
    bounds are exact; sets that share many differences and lie just under the threshold pass them,
    and how many pairs these form depends on the data."""
    slack = F.expr("n - 9 * d").alias("s"), F.expr("n - 9 * d + 18 * y").alias("a")
    bounds = s.keep(_shared(_split(deltas, "c")).select("node", "root", "n", *slack, "classes").join(nodes.select("node", "fp", "firm"), "node"))
    left = s.keep(_split(open_.join(bounds.select("node", "root", "s", "a"), "node"), "k"))
    for _ in range(2):
        best = left.groupBy("k").agg(F.max("s").alias("s_max"), F.max("a").alias("a_max"))
        able = left.join(best, "k").where("a + s_max >= 0 and s + a_max >= 0").drop("s_max", "a_max")
        old, left = left, s.keep(_split(able, "k"))
        s.drop(old)
    keys = left.groupBy("node").agg(F.collect_list("k").alias("ks"))  # at most BANDS + 1 of a node
    left = s.keep(left.select("k", "node").join(keys, "node").join(bounds, "node"))
    side = lambda c: left.select("k", F.struct("node", "fp", "firm", "root", "n", "s", "a", "ks", "classes", pivot_table(F.col("fp")).alias("pivots")).alias(c))
    both = F.expr("p.root < q.root and p.a + q.s >= 0 and q.a + p.s >= 0")
    overlap = F.expr("18 * aggregate(zip_with(p.classes, q.classes, (i, j) -> least(i, j)), 0, (i, j) -> i + j) + p.s + q.s >= 0")
    x, y = side("p").alias("x"), side("q").alias("y")
    met = x.join(y, (F.col("x.k") == F.col("y.k")) & both & _may_be("p", "q") & overlap & (F.array_min(F.array_intersect("p.ks", "q.ks")) == F.col("x.k")))
    return met.select(F.col("p.node").alias("u"), F.col("q.node").alias("v"))


def _merge(names: DataFrame, links: DataFrame, s: Scratch) -> DataFrame:
    """(node, root) after the links: components are formed of the roots, not of all nodes again."""
    a, b = names.select(F.col("node").alias("u"), F.col("root").alias("a")), names.select(F.col("node").alias("v"), F.col("root").alias("b"))
    rooted = links.join(a, "u").join(b, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    over = connected_components(rooted, s).select(F.col("node").alias("root"), F.col("root").alias("new__"))
    return s.keep(names.join(over, "root", "left").select("node", F.coalesce("new__", "root").alias("root")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows and columns of docs, one row of each group. Only texts of documents that may go are shuffled."""
    small_batches(docs.sparkSession)
    # the row as one column, so that no name of its own is in the way
    own, place = keyed(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row__"))), F.struct("id__", "th__")
    with Scratch(docs.sparkSession) as s:
        sketched, names = groups(own, s)
        rooted = s.keep(sketched.join(names, "node", "left").select("id__", "th__", F.coalesce("root", "node").alias("root")))
        stay = rooted.groupBy("root").agg(F.min(place).alias("stay"), F.count("*").alias("rows")).where("rows > 1")
        # all rows of groups but the one that stays, and of that the repeats
        twice = rooted.join(stay, "root").groupBy("id__", "th__").agg(F.max(place != F.col("stay")).alias("goes"), F.count("*").alias("rows"))
        change = s.result(twice.where("goes or rows > 1").select("id__", "th__", "goes"))
        maybe = maybe_in(change.select(_place().alias("h")), change.count())
    own = own.withColumn("maybe__", maybe(_place()))
    resolved = own.where("maybe__").join(change.where("goes").hint("shuffle_hash"), ["id__", "th__"], "left_anti").dropDuplicates(["id__", "th__"])
    return own.where("not maybe__").unionByName(resolved).select("row__.*")
