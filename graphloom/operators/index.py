"""Inverted index with bounds: exact top-k that leaves frequent words' documents alone.

Postings of a token lie in blocks of about one impact: a class of term frequency and one of
document length. A block knows its largest frequency and shortest document, so the
most that any of its postings can add to a score is known whatever the corpus's mean length
will be.

A query's words are put in the order of that most. A document whose highest word in that
order is w scores at most its own impact for w and the sum of the most of the words
below. So once k documents are known to reach a score, only those blocks have to be read
whose bound, with that sum, reaches it too: of a stop word none or few. The
score to reach comes from the blocks of the largest bounds, whose documents are scored in full.

Postings are written where their document is read, without a shuffle or a sort, in parts of some
PART_DOCS documents. Blocks are formed of the words asked for alone, and scores are added up
a part at a time: what the scoring shuffles at once doesn't grow with the corpus. Blocks and pairs
of queries and documents still do; they are small beside the postings.

An index can be kept as segments: each is written once, in such parts, with the number and length of
its documents. Statistics are sums over segments; deleted documents are marks that hold for
the segments before them; a merge writes what is alive as one segment.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.tables import listed, read_text, remove, tidy, write_text

#: BM25's constants (fixed values)
K1, B = 0.9, 0.4
#: Documents, for each one asked for, whose full scores give the score to reach.
PROBES = 16
#: Scores are rounded to six places; bounds are compared with as much to spare.
SLACK = 1e-5
#: Rows of queries' words, and document ids, that are sent to all tasks at a time at most.
SENT_WORDS, SENT_DOCS = 200_000, 200_000
#: Documents of a part of the postings, about.
PART_DOCS = 200_000
#: How stored postings are written.
SMALL = {"compression": "zstd", "parquet.writer.version": "v2"}
#: Scores that a task adds up.
SUMS = 250_000


def terms(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != "")


def _counts(c: Column) -> Column:
    """array<struct<token, tf, dl>> of a text, by its sorted words: linear beside the sort, and no shuffle."""

    def runs(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: (x["i"] == 0) | (F.get(s, x["i"] - 1) != x["w"]))
        until = lambda f, k: F.coalesce(F.get(f, k + 1)["i"], F.size(s))
        return let(first, lambda f: F.transform(f, lambda x, k: F.struct(x["w"].alias("token"), (until(f, k) - x["i"]).cast("long").alias("tf"), F.size(s).cast("long").alias("dl"))))

    return let(F.sort_array(terms(c)), runs)


def postings(corpus: DataFrame) -> DataFrame:
    """(doc_id, contents) -> (token, block, doc_id, tf, dl). A block is a class of frequencies (powers of two) and of lengths
    (half powers of two). Words are counted in their row; only those of repeated doc_ids meet in a shuffle."""
    counted = corpus.select("doc_id", F.inline(_counts(F.col("contents"))))
    again = corpus.groupBy(F.col("doc_id").alias("d")).count().where("count > 1").select("d")
    if not again.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("d"))
        merged = counted.join(again, same, "left_semi").groupBy("doc_id", "token", "dl").agg(F.sum("tf").alias("tf"))
        counted = counted.join(again, same, "left_anti").unionByName(merged)
    block = F.floor(F.log2("tf")) * 128 + F.floor(2 * F.log2("dl"))
    return counted.select("token", block.cast("int").alias("block"), "doc_id", "tf", "dl")


def blocks(own: DataFrame) -> DataFrame:
    """(token, block, n, max_tf, min_dl)"""
    return own.groupBy("token", "block").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))


def dealt(k: int, n: int) -> Column:
    """Whether a doc_id is of part k of n, whatever its type."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(n)) == k


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _pieces(rows: DataFrame, *key: str) -> list[DataFrame]:
    """A table in slices of some SENT_WORDS rows, by a key: what is sent to all tasks at a time, so that postings stay where they are."""
    n = max(1, math.ceil(rows.count() / SENT_WORDS))
    return [F.broadcast(rows.where(F.pmod(F.xxhash64(*key), F.lit(n)) == k) if n > 1 else rows) for k in range(n)]


@dataclass
class Index:
    """Postings in parts (table, k, n), each of which holds all postings of its documents, which are dealt(k, n); how many documents
    there are, and their mean number of words."""

    parts: list[tuple[DataFrame, int, int]]
    n_docs: int
    avgdl: float

    @property
    def postings(self) -> DataFrame:
        return _union([own for own, _, _ in self.parts])

    @property
    def blocks(self) -> DataFrame:
        return blocks(self.postings)

    @staticmethod
    def build(corpus: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> Index:
        """The corpus is read once a part, and tokenised once."""
        docs = corpus.count()
        n = max(1, math.ceil(docs / PART_DOCS))
        return Index.of([(keep(postings(corpus.where(dealt(k, n)) if n > 1 else corpus)), k, n) for k in range(n)], docs)

    @staticmethod
    def of(parts: list[tuple[DataFrame, int, int]], docs: int) -> Index:
        total = _union([own for own, _, _ in parts]).agg(F.sum("tf")).first()[0] or 0
        return Index(parts, docs, total / docs if docs else 0.0)

    def _part(self, idf: Column, tf: Column, dl: Column, k1: float, b: float) -> Column:
        return idf * tf / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / F.lit(self.avgdl or 1.0)))

    def _asked(self, queries: DataFrame, k1: float, b: float, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """(qid, token, qtf, idf, block, n, bound): the blocks of the queries' words, and the most that a posting of each can add."""
        words = queries.select("qid", F.explode(terms(F.col("query"))).alias("token")).groupBy("qid", "token").agg(F.count("*").alias("qtf"))
        # postings of other words are left out before they are blocks
        own = keep(_union([blocks(self.postings.join(w, "token", "left_semi")) for w in _pieces(keep(words.select("token").distinct()), "token")]))
        df = own.groupBy("token").agg(F.sum("n").alias("df"))
        idf = F.log(1 + (F.lit(self.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        bound = F.col("qtf") * self._part(F.col("idf"), F.col("max_tf"), F.col("min_dl"), k1, b)
        return words.join(own.join(df, "token").withColumn("idf", idf), "token").select("qid", "token", "qtf", "idf", "block", "n", bound.alias("bound"))

    def _documents(self, wanted: DataFrame) -> DataFrame:
        """(qid, doc_id) of the blocks (qid, token, block): equi-joined by word and block, each of which is a part of a word's postings."""
        own = self.postings.select("token", "block", "doc_id")
        return _union([own.join(w, ["token", "block"]).select("qid", "doc_id") for w in _pieces(wanted.select("qid", "token", "block"), "token", "block")]).distinct()

    def _scores(self, pairs: DataFrame, words: DataFrame, keep: Callable[[DataFrame], DataFrame], k1: float, b: float, reach: DataFrame | None = None) -> DataFrame:
        """(qid, doc_id, score) of pairs (qid, doc_id); words: (qid, token, qtf, idf); both tables. Postings of the queries' words go once to
        where their document's pairs are; they meet the words there, so no pair is multiplied by its query's words in a shuffle. A part
        of the postings is a job, whose shuffle files are gone before the next one's. reach: (qid, reach), below which no score is kept."""
        part = F.col("qtf") * self._part(F.col("idf"), F.col("tf"), F.col("dl"), k1, b)
        n_queries = words.select("qid").distinct().count()
        slices = max(1, math.ceil(words.count() / SENT_WORDS))
        done = []
        for table, i, parts in self.parts:
            of_part = pairs.where(dealt(i, parts)) if parts > 1 else pairs
            docs = of_part.select("doc_id").distinct()
            n_docs = docs.count()
            n = max(1, math.ceil(n_docs * n_queries / slices / SUMS))
            for k in range(slices) if n_docs else ():
                here = F.pmod(F.xxhash64("qid"), F.lit(slices)) == k
                sent, asked = words.where(here), of_part.where(here)
                own = table.select("doc_id", "token", "tf", "dl").join(F.broadcast(sent.select("token").distinct()), "token", "left_semi")
                if n_docs <= SENT_DOCS:
                    own = own.join(F.broadcast(docs), "doc_id", "left_semi")
                both = own.select("doc_id", "token", "tf", "dl").unionByName(asked.select("doc_id", F.col("qid").alias("asked")), allowMissingColumns=True).repartition(n, "doc_id")
                met = both.join(F.broadcast(sent.select("token", "qid", "qtf", "idf")), "token", "left").select("doc_id", F.coalesce("asked", "qid").alias("qid"), part.alias("part"), F.col("asked").isNotNull().alias("pair"))
                summed = met.groupBy("doc_id", "qid").agg(F.round(F.sum("part"), 6).alias("score"), F.max("pair").alias("pair"))
                scored = summed.where("pair and score is not null").select("qid", "doc_id", "score")
                if reach is not None:
                    scored = scored.join(reach, "qid", "left").where(F.col("reach").isNull() | (F.col("score") >= F.col("reach") - SLACK)).drop("reach")
                done.append(keep(scored))
        return _union(done) if done else pairs.select("qid", "doc_id", F.lit(0.0).alias("score")).where("false")

    def candidates(self, queries: DataFrame, top_k: int, keep: Callable[[DataFrame], DataFrame], k1: float = K1, b: float = B) -> DataFrame:
        """(qid, doc_id, score) of all documents that can be among the first top_k, and some others."""
        asked = keep(self._asked(queries, k1, b, keep))
        words = keep(asked.groupBy("qid", "token").agg(F.first("qtf").alias("qtf"), F.first("idf").alias("idf"), F.max("bound").alias("most")))
        order = Window.partitionBy("qid").orderBy(F.desc("bound"), "token", "block")
        before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        probed = asked.withColumn("before", before).where(F.col("before") < PROBES * top_k)
        known = self._scores(keep(self._documents(keep(probed))), words, keep, k1, b)
        # the score of the k-th of them, at least: without k nothing is ruled out
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))
        reach = keep(known.withColumn("k", place).where(F.col("k") == top_k).select("qid", F.col("score").alias("reach")))
        below = F.coalesce(F.sum("most").over(Window.partitionBy("qid").orderBy("most", "token").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        floor = words.withColumn("below", below).select("qid", "token", "below")
        wanted = keep(asked.join(floor, ["qid", "token"]).join(reach, "qid", "left").where(F.col("reach").isNull() | (F.col("bound") + F.col("below") >= F.col("reach") - SLACK)))
        more = keep(self._documents(wanted).join(known.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti"))
        return known.unionByName(self._scores(more, words, keep, k1, b, reach))

    def top_k(self, queries: DataFrame, top_k: int, keep: Callable[[DataFrame], DataFrame], k1: float = K1, b: float = B) -> DataFrame:
        """(qid, rank from 0, doc_id, score) for queries (qid, query)."""
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")) - 1
        return self.candidates(queries, top_k, keep, k1, b).withColumn("rank", rank).where(F.col("rank") < top_k).select("qid", "rank", "doc_id", "score")


class Segments:
    """An index under a folder, in segments. A manifest names those that count and the marks of deleted documents;
    it is one small file a version, written last, so a reader sees all of a change or nothing."""

    def __init__(self, spark: SparkSession, root: str, doc_id: str = "bigint"):
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = f"token string, block int, doc_id {doc_id}, tf bigint, dl bigint"
        self.doc = f"doc_id {doc_id}"

    def _manifest(self) -> dict:
        versions = [int(n.split("-")[1]) for n in listed(self.spark, f"{self.root}/manifest") if n.startswith("version-")]
        return json.loads(read_text(self.spark, f"{self.root}/manifest/version-{max(versions):06d}")) if versions else {"version": 0, "next": 0, "segments": [], "deleted": []}

    def _commit(self, manifest: dict) -> None:
        version = manifest["version"] + 1
        write_text(self.spark, f"{self.root}/manifest/version-{version:06d}", json.dumps(manifest | {"version": version}))

    def _write(self, number: int, own: Callable[[int, int], DataFrame], docs: DataFrame) -> dict:
        """A segment: postings in parts, each written where its documents are read, and its documents. own: postings of the documents of
        part k of n, a power of two: a part of one segment has documents of few parts of another."""
        path = f"{self.root}/segment-{number:06d}"
        with tidy(self.spark):
            docs.select("doc_id").write.parquet(f"{path}/docs")
            n = self.spark.read.schema(self.doc).parquet(f"{path}/docs").count()
            parts = 1 << max(0, math.ceil(n / PART_DOCS) - 1).bit_length()
            for k in range(parts):
                own(k, parts).write.options(**SMALL).parquet(f"{path}/postings/{k:04d}")
        written = self.spark.read.schema(self.schema).parquet(*[f"{path}/postings/{k:04d}" for k in range(parts)])
        return {"number": number, "docs": n, "parts": parts, "words": written.agg(F.sum("tf")).first()[0] or 0}

    def add(self, corpus: DataFrame) -> None:
        """Documents (doc_id, contents) as a new segment. Those that are there already have to be deleted before."""
        m = self._manifest()
        segment = self._write(m["next"], lambda k, n: postings(corpus.where(dealt(k, n))), corpus)
        self._commit(m | {"next": m["next"] + 1, "segments": [*m["segments"], segment]})

    def delete(self, ids: DataFrame) -> None:
        """Marks documents (doc_id) of the segments so far."""
        m = self._manifest()
        ids.select("doc_id").distinct().write.parquet(f"{self.root}/deleted-{m['next']:06d}")
        self._commit(m | {"next": m["next"] + 1, "deleted": [*m["deleted"], m["next"]]})

    def _left(self, m: dict, number: int, own: DataFrame, k: int = 0, n: int = 1) -> DataFrame:
        """Rows of part k of n of a segment but those of documents that a later mark names. Marks are sent to the rows, but for more than
        a part should have."""
        for d in (d for d in m["deleted"] if d > number):
            marks = self.spark.read.schema(self.doc).parquet(f"{self.root}/deleted-{d:06d}")
            few = marks.count() <= n * SENT_DOCS
            own = own.join(F.broadcast(marks.where(dealt(k, n))) if few else marks, "doc_id", "left_anti")
        return own

    def _parts(self, m: dict) -> list[tuple[DataFrame, int, int]]:
        """Postings of what is alive, by segment and part."""
        out = []
        for s in m["segments"]:
            path, n = f"{self.root}/segment-{s['number']:06d}/postings", s.get("parts")
            for k in range(n or 1):  # a segment of before there were parts is one
                own = self.spark.read.schema(self.schema).parquet(f"{path}/{k:04d}" if n else path)
                out.append((self._left(m, s["number"], own, k, n or 1).select("token", "block", "doc_id", "tf", "dl"), k, n or 1))
        return out or [(self.spark.createDataFrame([], self.schema), 0, 1)]

    def _docs(self, m: dict) -> DataFrame:
        own = [self._left(m, s["number"], self.spark.read.schema(self.doc).parquet(f"{self.root}/segment-{s['number']:06d}/docs")) for s in m["segments"]]
        return _union(own) if own else self.spark.createDataFrame([], self.doc)

    def index(self, keep: Callable[[DataFrame], DataFrame]) -> Index:
        """Without marks the segments' own tables and sums; with some, tables and sums of what is alive."""
        m = self._manifest()
        if m["deleted"]:
            return Index.of([(keep(own), k, n) for own, k, n in self._parts(m)], self._docs(m).count())
        n, words = sum(s["docs"] for s in m["segments"]), sum(s["words"] for s in m["segments"])
        return Index(self._parts(m), n, words / n if n else 0.0)

    def merge(self) -> None:
        """One segment of what is alive; the folders of the old ones may be swept once nobody reads them."""
        m = self._manifest()
        old = self._parts(m)
        segment = self._write(m["next"], lambda k, n: _union([own for own, j, i in old if (j - k) % math.gcd(i, n) == 0]).where(dealt(k, n)), self._docs(m))
        self._commit({"version": m["version"], "next": m["next"] + 1, "segments": [segment], "deleted": []})

    def sweep(self) -> None:
        """Delete the folders that the manifest no longer names. Nothing may read or write the index meanwhile."""
        m = self._manifest()
        named = {f"segment-{s['number']:06d}" for s in m["segments"]} | {f"deleted-{d:06d}" for d in m["deleted"]} | {"manifest"}
        for name in listed(self.spark, self.root):
            if name not in named:
                remove(self.spark, f"{self.root}/{name}")
