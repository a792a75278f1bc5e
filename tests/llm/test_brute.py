"""Corpus operators against plain Python: scans, segments, expectation maximisation, the pipeline's stages; odd tables everywhere."""

import collections
import hashlib
import math
import random
import re

import pytest

from graphloom.llm import decontaminate, near_dedup, quality, secrets, sentencepiece_codec, simhash, suffix_dedup, token_count, toxicity, url_filter, warc

from graphloom.llm._spark import Scratch

from .test_operators import ODD


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, "u", 0, 0, "x", "y", True) for r in ODD], "doc_id long, text string, url string, n_words long, votes long, host string, fp string, kept boolean")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def _secrets(text):
    """The base spans as the contract words them."""
    out = []
    for kind, pattern, ok in (
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        out += [(m.start(), ("assign", "access", "hex").index(kind), m.end()) for m in re.finditer(pattern, text) if ok(m)]
    return sorted(out)


def test_secrets_brute():
    rng = random.Random(1)
    parts = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", "AKIA", "akia", "=", ":", " ", '"', "'", "abc123", "0f" * 12, "A" * 16, "é", "日本", "\n", "x", ".", "-", "/", "pass", "deadbeef" * 3, "ghp_"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert [s for s in secrets.find(text.encode()) if s[1] < 3] == _secrets(text), text


def _segments(weights):
    """All maximal scoring segments by their definition: the best one, then left and right of it."""

    def split(lo, hi):
        best = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += weights[j]
                if best is None or total > best[0] + 1e-12 or (abs(total - best[0]) <= 1e-12 and j + 1 - i < best[2] - best[1]):
                    best = total, i, j + 1
        return [] if best is None or best[0] <= 0 else [*split(lo, best[1]), best, *split(best[2], hi)]

    return split(0, len(weights))


def test_segments_brute():
    rng, of = random.Random(2), {"a": 1.0, "b": 2.5, "c": 0.7}
    model = toxicity.Model(of, -0.61, 1.0, 0.1)
    for _ in range(1500):
        words = [rng.choice("abcxxx") for _ in range(rng.randrange(18))]
        got = [(round(s, 9), i, j) for s, i, j in model.segments(" ".join(words))]
        assert got == [(round(s, 9), i, j) for s, i, j in _segments([of.get(w, -0.61) for w in words])]


def test_segments_in_linear_time():
    """Steps down the stack are as many as segments, not their square: spaced words, rising and falling."""

    class Counted(list):
        reads = 0

        def __getitem__(self, i):
            Counted.reads += isinstance(i, int)
            return list.__getitem__(self, i)

    import graphloom.llm.toxicity as t

    source = open(t.__file__).read().replace("] = []  # left sum", "] = Counted()  # left sum")
    scope = {"__name__": "graphloom.llm.counted", "Counted": Counted}
    exec(compile(source.replace("from ._spark", "from graphloom.llm._spark"), t.__file__, "exec"), scope)  # noqa: S102
    for gap, n in ((60, 4000), (1, 4000)):
        Counted.reads = 0
        text = " ".join("bad " + "ok " * gap for _ in range(n))
        scope["Model"]({"bad": 1.5}, -0.03, 1.0, 0.01).segments(text)
        assert Counted.reads < 12 * n


def test_toxicity_calibration(spark):
    """K is the one that makes clean best segments' E-values 1 on average; a class that the sample cuts keeps its share."""
    rng = random.Random(3)
    plain = [f"w{k}" for k in range(40)]
    text = lambda bad: " ".join([*(rng.choice(plain) for _ in range(80)), *(["vile", "foul"] * 3 if bad else ["foul"] * rng.randrange(2))])
    rows = [(i, text(i % 8 == 0)) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    train, _ = toxicity.training_rows(docs, labels)
    tails = [x for x in (model.tail(r.text) for r in train.where("y = 0").collect()) if x is not None]
    assert tails and model.k == pytest.approx((len(tails) + 1) / (sum(tails) + 1))
    _, whole = toxicity.training_rows(docs, labels)
    _, cut = toxicity.training_rows(docs, labels, sample=100)
    n = collections.Counter(int(i % 8 == 0) for i, _ in rows if __import__("zlib").crc32(str(i).encode()) % 5)
    assert whole == {0: 1.0, 1: 1.0} and cut == {k: n[k] / min(n[k], 100) for k in n}
    small = toxicity.fit(docs, labels, sample=100)
    expected = sum(small.score(t) for _, t in rows) / len(rows)
    assert expected == pytest.approx(1 / 8, abs=0.03)  # scores add up to the class's true share


def test_quality_posterior(spark):
    """The expression's expectation maximisation against loops."""
    rng = random.Random(4)
    words = lambda n, bad: " ".join(rng.choice(["#$%", "A!"]) if bad and rng.random() < 0.4 else f"word{rng.randrange(500)}" for _ in range(n))
    docs = spark.createDataFrame([(i, words(rng.choice([20, 60, 90, 200]), i % 4 == 0)) for i in range(200)], "doc_id long, text string")
    got = quality.judge(quality.measures(docs)).select("doc_id", "votes", "p_good", "base_failed", "kept").collect()
    counts = collections.Counter(tuple(r.votes) for r in got)
    ways = [w for w, _ in quality.RULES.values()]
    odds, balance = (1 - quality.START) / quality.START, quality.GOOD / (1 - quality.GOOD)
    first = [(0.2 * odds / balance, 0.2) if w < 0 else (0.5, 0.5 * odds * balance) for w in ways]
    good, rates = quality.GOOD, first

    def p(v):
        z = math.log(good / (1 - good)) + sum(math.log(g / b) for x, (g, b) in zip(v, rates, strict=True) if x)
        return 1 / (1 + math.exp(-z))

    for _ in range(quality.ITERATIONS):
        share = {v: n * p(v) for v, n in counts.items()}
        total, held = sum(counts.values()), quality.SMOOTH * sum(counts.values())
        new = []
        for k in range(len(ways)):
            g = (sum(x for v, x in share.items() if v[k]) + held * first[k][0]) / (sum(share.values()) + held)
            b = (sum(counts[v] - x for v, x in share.items() if v[k]) + held * first[k][1]) / (total - sum(share.values()) + held)
            new.append((g, b))
        good, rates = (sum(share.values()) + held * quality.GOOD) / (total + held), new
    assert len(counts) > 3
    for r in got:
        assert r.p_good == pytest.approx(p(tuple(r.votes))) and r.kept == (not r.base_failed and r.p_good >= 0.5)


def _print(distinct):
    fp, firm = near_dedup.print_of(distinct)
    return fp, firm, [(fp ^ (p % (1 << 64))).bit_count() for p in simhash.pivots()]


def test_near_dedup_recall():
    """Sets at 0.8 share a band, and pass the fingerprint test: whatever their size, and if one holds the other."""
    import numpy as np

    rng = np.random.default_rng(5)
    missed = discarded = unlike = 0
    for k in range(12_000):
        n = (4, 5, 8, 9, 12, 20, 45, 100, 180, 200)[k % 10]
        union = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        alone = n // 5  # so that the similarity is 0.8, or as little over as may be
        cut = (0, alone, int(rng.integers(0, alone + 1)))[k % 3]
        a, b = np.unique(union[: n - alone + cut]), np.unique(np.concatenate([union[: n - alone], union[n - alone + cut :]]))
        assert 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
        missed += not set(near_dedup.band_keys(a).tolist()) & set(near_dedup.band_keys(b).tolist())
        (x, firm_x, far_x), (y, firm_y, far_y) = _print(a), _print(b)
        assert not (x ^ y) & (firm_x | firm_y)
        assert max(abs(p - q) for p, q in zip(far_x, far_y, strict=True)) <= 64 - max(firm_x.bit_count(), firm_y.bit_count())
        other, firm, _ = _print(rng.integers(0, 1 << 63, len(a), dtype=np.uint64))
        unlike += n <= 20
        discarded += n <= 20 and bool((x ^ other) & (firm_x | firm))
    assert missed <= 4 and discarded > 0.99 * unlike


def test_near_dedup_far_fingerprints(spark):
    """A pair at 0.8 of which one is a text less its last word, beside texts of its first words: 27 bits apart."""
    words = "w154889 w548691 w897658 w442610 w18602 w583948 w877102 w363002 w993090".split()
    rng = random.Random(3)
    rows = [(0, " ".join(words)), (1, " ".join(words[:-1]))]
    rows += [(2 + k, " ".join([*words[:7], f"x{rng.randrange(10**6)}", f"y{rng.randrange(10**6)}"])) for k in range(20)]
    left = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in left.collect()} == {0, *range(2, 22)}


OPERATORS = {
    "op1": lambda d, where: _grouped(d),
    "op2": lambda d, where: quality.judge(quality.measures(d)),
    "op3": lambda d, where: sentencepiece_codec.digest_table(d, sentencepiece_codec.default_model()),
    "op4": lambda d, where: suffix_dedup.dedup(d),
    "op6": lambda d, where: token_count.count_tokens(d, token_count.default_tokenizer()),
    "op7": lambda d, where: secrets.scan(d),
    "op7_redact": lambda d, where: secrets.redact(d),
    "op8": lambda d, where: toxicity.score_table(d, toxicity.Model({"a": 1.0}, -0.5, 1.0, 0.1)),
    "op9": lambda d, where: url_filter.judge(d.withColumnRenamed("doc_id", "page_id"), d.sparkSession.createDataFrame([("x",)], "key string")),
    "op10": lambda d, where: _archived(d.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html"), where),
}


def _grouped(docs):
    with Scratch(docs.sparkSession) as s:
        return simhash.components(s.result(simhash.fingerprints(docs)), s)


@pytest.mark.parametrize("benchmark", [[], [(None, "a"), (1, None), (2, " \n"), (3, "a"), (3, "a"), (4, "b C d e f g"), (5, "é b c d e f g")]])
def test_decontaminate_odd_tables(odd, empty, benchmark):
    """Items of odd rows: null ids and texts without words count for nothing, repeated items are found once each."""
    items = odd.sparkSession.createDataFrame([(*r, "x", 0) for r in benchmark], "item_id long, text string, doc_id string, similarity int")
    found = collections.Counter((r.doc_id, r.item_id) for r in decontaminate.find_leaks(odd, items).collect())
    assert decontaminate.find_leaks(empty, items).count() == 0 == decontaminate.drop_leaks(empty, items).count()
    left = decontaminate.drop_leaks(odd, items)
    assert left.columns == odd.columns
    if benchmark:
        assert found[3, 3] == 4 and found[7, 5] == 1 and found[6, 5] == 0 and found[6, 4] == 1 == found[7, 4] and (1, 3) not in found
        assert left.count() == sum(d not in {x for x, _ in found} for d, _ in ODD)
    else:
        assert not found and left.count() == len(ODD)


def _archived(pages, where):
    warc.write_archives(pages, where)
    return warc.read_archives(pages.sparkSession, where)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_tables(odd, empty, tmp_path, name):
    """One row a row, of odd rows, of none; extra columns of any name don't matter, or are replaced where the operator says so."""
    assert OPERATORS[name](odd, str(tmp_path / "odd")).count() == len(ODD)
    assert OPERATORS[name](empty, str(tmp_path / "none")).count() == 0


def test_odd_urls(spark):
    rows = [(1, "http://" + "a" * 100_000 + ".org/x"), (2, "http://"), (3, "://"), (None, "http://b.com"), (4, "HTTP://B.COM/de/?://c.org/"), (5, "a://b://c/d")]
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([], "key string")).collect()}
    assert got[1] == ("a" * 100_000 + ".org", "/x", "org/") and got[2] == ("", "", None) == got[3] and got[None] == ("b.com", "", None) and got[4] == ("b.com", "/de/", "com/de/") and got[5][:2] == ("b:", "//c/d")


def test_odd_pages(spark, tmp_path):
    """Null ids, a long payload, equal ids with different payloads: a record each, of its own id."""
    long = "<p>é" * 200_000
    rows = [(None, "u", "x" * 200), (None, "u", "x" * 200), (7, "u", "one"), (7, "u", "two"), (8, "v", long), (9, "v", long)]
    where = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), where)
    got = sorted(((r.page_id or 0, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, where).collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert collections.Counter(got) == collections.Counter([(0, sha("x" * 200), "response", None)] * 2 + [(7, sha("one"), "response", None), (7, sha("two"), "response", None), (8, sha(long), "response", None), (9, sha(long), "revisit", 8)])
    import gzip

    ids = [h["warc-record-id"] for f in (tmp_path / "w").glob("part-*") for h, _ in warc.parse_warc(gzip.decompress(f.read_bytes()))]
    assert len(set(ids)) == 5  # the two records that are alike in everything share theirs


def test_arc_files(spark, tmp_path):
    """ARC files of both versions on disk, one of them compressed, to WARC records."""
    import gzip

    for version, name in ((1, "a.arc"), (2, "b.arc.gz")):
        raw = warc.arc_version_block(version) + warc.arc_record(version, "http://a/ b", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody\n") + warc.arc_record(version, "http://c", b"plain", kind="text/plain")
        (tmp_path / name).write_bytes(gzip.compress(raw) if name.endswith("gz") else raw)
    got = warc.read_arc(spark, str(tmp_path)).collect()
    assert len(got) == 4
    for r in got:
        (headers, block), = warc.parse_warc(bytes(r.warc))
        assert headers["warc-target-uri"] == r.url and headers["warc-type"] == ("response" if r.url.endswith("b") else "resource") and headers["warc-date"] == "2020-01-02T03:04:05Z"
        assert block == (b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody\n" if r.url.endswith("b") else b"plain") and headers["warc-payload-digest"].removeprefix("sha256:") == hashlib.sha256(b"body\n" if r.url.endswith("b") else b"plain").hexdigest()
    assert len({r.warc for r in got}) == 4


def _sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def test_pipeline_stages(spark, tmp_path):
    """All stages on planted documents, each against what its input says by brute force; nulls, empty and repeated rows among them."""
    import corpus_pipeline
    import sentencepiece

    rng = random.Random(7)
    words = lambda n: [f"{rng.choice('bcdfgh')}{rng.randrange(3000)}" for _ in range(n)]
    docs = [(i, " ".join(words(60) + (["vile", "foul", "rot"] * 4 if i % 7 == 0 else []))) for i in range(140)]
    by_id = dict(docs)
    for i, of in ((200, 1), (201, 2), (202, 3)):  # near copies
        w = by_id[of].split()
        w[30] = "edited"
        docs.append((i, " ".join(w)))
    docs += [(203, by_id[4]), (4, by_id[4]), (5, by_id[5]), (204, None), (205, ""), (None, by_id[8] + " null id")]
    items = [(k, " ".join(words(24))) for k in range(3)]
    docs += [(210 + k, " ".join([*words(20), *t.split(), *words(20)])) for k, t in items]
    docs.append((220, " ".join(words(30)) + " api_key = abcdef123456 " + " ".join(words(30))))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(140)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append([tuple(r)[:2] for r in now.select("doc_id", "text" if "text" in now.columns else "n_tokens").collect()])
        if k < 4:
            assert now.columns == corpus_pipeline.COLUMNS
    toxic, near, clean, redacted, encoded = kept
    assert sorted(map(str, toxic)) == sorted(str(r) for r in docs if "vile" not in (r[1] or ""))
    sets, left = _sets([(k, t) for k, (_, t) in enumerate(toxic)]), dict(enumerate(toxic))
    order = sorted(left, key=lambda k: (left[k][0] is None, left[k][0] or 0))
    root = {k: k for k in left}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x, a in enumerate(order):
        for b in order[:x]:
            u, v = sets[a], sets[b]
            if 5 * len(u & v) >= 4 * len(u | v):
                root[find(a)] = find(b) if order.index(find(b)) < order.index(find(a)) else root[find(a)]
    assert sorted(map(str, near)) == sorted(str(left[k]) for k in left if find(k) == k)
    assert {str(i) for i, _ in near} & {"200", "201", "202", "203", "205"} == set() and len(near) < len(toxic)
    assert sorted(map(str, clean)) == sorted(str(r) for r in near if r[0] not in (210, 211, 212))
    assert {i: t for i, t in redacted if "[SECRET]" in (t or "")}.keys() == {220} and len(redacted) == len(clean)
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    assert sorted(map(str, encoded)) == sorted(str((i, len(lib.encode(t or "")))) for i, t in redacted)


def test_decontaminate_odd_items(spark):
    """Items of null id are left out; slices give the same rows as one pass."""
    rng = random.Random(8)
    items = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))) for k in range(30)]
    docs = spark.createDataFrame([(k, f"x {t} y") for k, t in items], "doc_id long, text string")
    bench = spark.createDataFrame([*items, (None, items[0][1]), (99, None), (98, "")], "item_id long, text string")
    one = {tuple(r)[:2] for r in decontaminate.find_leaks(docs, bench).collect()}
    before, decontaminate.SLICE = decontaminate.SLICE, 7
    try:
        assert {tuple(r)[:2] for r in decontaminate.find_leaks(docs, bench).collect()} == one == {(k, k) for k, _ in items}
        assert decontaminate.drop_leaks(docs, bench).count() == 0
    finally:
        decontaminate.SLICE = before


def test_near_dedup_clashing_names(spark):
    """Columns of the names that near-dedup itself uses pass through it."""
    rows = [(k, "a b c d e f g " + "x" * (k % 2), k, str(k), k % 2 == 0, "n") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id__ int, th__ string, maybe__ boolean, row__ string")
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(tuple(r) for r in left.collect()) == rows[:2]


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 0), (3, 0, 1), (None, None, None)]])
def test_pipeline_odd_tables(spark, tmp_path, labels):
    """Odd rows, clashing columns, hardly any labels, no benchmark; no documents."""
    import corpus_pipeline

    for name, rows in (("odd", ODD), ("none", [])):
        where = tmp_path / name
        docs = spark.createDataFrame([(*r, "en", "s", 1, 7, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id__ int, ids string")
        docs.write.parquet(str(where / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(where / "labels.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(where / "benchmark.parquet"))
        got = collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, str(where)).collect())
        if not rows:
            assert not got
        elif len(labels) < 3:  # null and blank texts are one group; a row repeated is one; the two long ones differ by a letter
            assert got == collections.Counter([1, 3, None, 4, 6, 7])
        else:
            assert set(got) <= {d for d, _ in ODD}
