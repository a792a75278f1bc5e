"""Corpus operators against brute force, on small tables with the odd cases: nulls, empty
and long texts, repeated rows, empty tables, extra columns."""

import collections
import hashlib
import random
import re

import pytest

from graphloom.llm import _words, decontaminate, near_dedup, quality, secrets, sentencepiece_codec, simhash, suffix_dedup, token_count, toxicity, url_filter, warc
from graphloom.llm._spark import Scratch
from graphloom.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000
ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, LONG), (5, " \n\t "), (6, "É b C d e f g"), (7, "é b c d e f g")]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, and a column that clashes with the names that operators use."""
    return spark.createDataFrame([(*r, 0, 0) for r in ODD], "doc_id long, text string, node long, th long")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(compare, name):
    compare(QUERIES[name], ORACLE_SQL[name])


def _components(prints):
    with Scratch(prints.sparkSession) as s:
        return simhash.components(prints, s)


@pytest.mark.parametrize("edges", [3, 10**6])
def test_connected_components(spark, monkeypatch, edges):
    """Paths, stars, loops and repeats, by rounds of stars (a task unites few edges) and at once."""
    from graphloom.llm import _spark

    monkeypatch.setattr(_spark, "EDGES", edges)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    with Scratch(spark) as s:
        got = {r.node: r.root for r in _spark.connected_components(spark.createDataFrame(pairs, "u long, v long"), s).collect()}
        assert not _spark.connected_components(spark.createDataFrame([], "u long, v long"), s).collect()
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 130), 100) | {200: 200, 201: 200}


def test_scratch_leaves_nothing(spark, tmp_path):
    """Settings of the session come back, tables go but the one that the result reads."""
    import os

    from graphloom.llm._spark import shared_dir

    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", set(os.listdir(shared_dir(spark)))
    was = spark.conf.get(key)
    with Scratch(spark) as s:
        s.keep(spark.range(3))
        left = s.result(spark.range(4))
    assert spark.conf.get(key) == was and left.count() == 4 and len([x for x in set(os.listdir(shared_dir(spark))) - before if x.startswith("table-")]) == 1


def test_simhash(spark, odd, empty):
    rng, points = random.Random(1), {0}
    for k in range(600):
        x = (0x123456789ABCDEF0, 0xFEDCBA9876543210, 0)[k % 3]
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        points.add(x)
    fp = dict(enumerate(sorted(points)))
    parent = {i: i for i in fp}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in fp:
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2 and (a := root(i)) != (b := root(j)):
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in fp.items()], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in _components(df).collect()}
    assert got == {i: root(i) for i in fp}
    rows = _components(simhash.fingerprints(odd)).collect()
    assert len(rows) == len(ODD) and {r.fp for r in rows if r.doc_id in (1, 2, 5)} == {0}
    assert _components(simhash.fingerprints(empty)).count() == 0


def test_quality(spark, odd, empty):
    rows = {r.doc_id: r for r in quality.judge(quality.measures(odd)).collect()}
    assert rows[1].n_words == 0 and rows[1].base_failed and not rows[1].kept
    assert (rows[4].n_words, rows[4].n_repeat_words) == (30_000, 30_000)
    assert quality.judge(quality.measures(empty)).count() == 0
    texts = ["a b c a b c d", "x\ny\nx\n\n\n", "#a $b | é", "a a a a", "a b", "w v w v w"]
    got = [tuple(r)[-8:-3] for r in quality.measures(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)).orderBy("doc_id").collect()]
    for t, g in zip(texts, got, strict=True):
        w = t.split()
        runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {i + k for i, x in enumerate(runs) if runs.count(x) > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.strip()]
        assert g == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice))


def test_sentencepiece(spark, odd):
    import sentencepiece

    path = sentencepiece_codec.default_model()
    model, lib = sentencepiece_codec.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "é", "▁", "日本", "x", "0", "\x00", "😀", "    ", "ing", "Import ", ".", "…"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(20)))
        ids = lib.encode(t)
        joined, decoded = model.encode_decode(t)
        assert joined == ",".join(map(str, ids)) and decoded == lib.decode(ids) and model.encode(t) == ids
    for _ in range(500):
        ids = [rng.randrange(400) for _ in range(rng.randrange(8))]
        assert model.decode(ids) == lib.decode(ids)
    rows = sentencepiece_codec.digest_table(odd, path).collect()
    assert len(rows) == len(ODD) and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}


def test_suffix_dedup(spark, odd, empty):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefg ") for _ in range(400)) for _ in range(4)]
    rows = [(i, "".join(rng.choice(base)[(a := rng.randrange(250)) : a + rng.randrange(60, 300)] + rng.choice(["", "é", "zz"]) for _ in range(rng.randrange(4)))) for i in range(80)]
    seen, want = set(), {}
    for i, t in rows:
        raw, gone = t.encode(), set()
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone |= set(range(p, p + 100))
            seen.add(raw[p : p + 100])
        want[i] = (len(raw), len(gone), sum(p - 1 not in gone for p in gone), hashlib.sha256(bytes(c for p, c in enumerate(raw) if p not in gone)).hexdigest())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r[0]: tuple(r[1:]) for r in suffix_dedup.dedup(df).collect()} == want
    before, suffix_dedup.CROWD = suffix_dedup.CROWD, 5
    try:
        assert {r[0]: tuple(r[1:]) for r in suffix_dedup.dedup(df).collect()} == want
    finally:
        suffix_dedup.CROWD = before
    got = collections.Counter(r.n_bytes for r in suffix_dedup.dedup(odd).collect())
    assert sum(got.values()) == len(ODD) and suffix_dedup.dedup(empty).count() == 0
    for _ in range(20):
        t = bytes(rng.choice(b"ab") for _ in range(25))
        assert suffix_dedup.longest_previous_factor(t) == [max([k for k in range(26 - i) for j in range(i) if t[j : j + k] == t[i : i + k]], default=0) for i in range(25)]


def _removed(rows):
    """(n_bytes, n_removed) of documents in their order, by brute force."""
    seen, out = set(), []
    for t in rows:
        raw, gone = t.encode(), set()
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone |= set(range(p, p + 100))
            seen.add(raw[p : p + 100])
        out.append((len(raw), len(gone)))
    return out


@pytest.mark.parametrize("crowd", [5, 20_000])
def test_suffix_dedup_ids(spark, monkeypatch, crowd):
    """Thousands of null ids and of one repeated id, and rows that come twice: each text is told from the others."""
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    common = [word(150) for _ in range(3)]
    for null in (None, 7):
        texts = [word(rng.randrange(90, 260)) for _ in range(2000)]
        held = {k: rng.choice(common) for k in range(0, 2000, 100)}
        texts = [t + held.get(k, "") + t[:20] for k, t in enumerate(texts)]
        rows = [(null, t) for t in texts] + [(null, texts[5]), (null, texts[5])]
        got = collections.Counter((r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
        assert sum(got.values()) == len(rows)
        # which of a passage's copies is the first is settled by a hash of the text: all but one of each go
        assert sum(c for (_, gone), c in got.items() if gone) == len(held) - len(set(held.values()))
    twice = [(1, common[0] * 2), (1, common[0] * 2), (2, common[0])]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(spark.createDataFrame(twice, "doc_id long, text string")).collect())
    (_, first), (_, second) = _removed([common[0] * 2, common[0]])
    assert got == [(1, 300, first), (1, 300, first), (2, 150, second)]


def test_suffix_dedup_batches(spark, monkeypatch):
    """Groups cut over many small batches and flushes give the same rows."""
    monkeypatch.setattr(suffix_dedup, "BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "ROWS", 7)
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    rng = random.Random(12)
    base = "".join(rng.choice("abc") for _ in range(900))
    texts = [base[(a := rng.randrange(700)) : a + rng.randrange(80, 400)] + str(k) for k in range(60)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)).collect())
    assert got == [(k, *x) for k, x in enumerate(_removed(texts))]


def test_decontaminate(spark, odd, empty):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 20, 60])))) for i in range(20)]
    docs, want = [], set()
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(200)]
        if i % 3 == 0:
            item, text = items[i % 20]
            words[50:50] = text.upper().split()
            want.add((i, item))
        docs.append((i, ", ".join(words)))
    bench = spark.createDataFrame([*items, (98, None), (99, "...")], "item_id long, text string")
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    assert decontaminate.find_leaks(odd, bench).count() == 0 == decontaminate.drop_leaks(empty, bench).count()
    assert decontaminate.find_leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.drop_leaks(odd, bench).columns == odd.columns


def _windows(text, item):
    """Best similarity of an item and the windows of a text, by brute force."""
    words, own = text.lower().split(), item.lower().split()
    k = min(5, len(own))
    s, t = ([tuple(w[j : j + k]) for j in range(len(w) - k + 1)] for w in (words, own))
    m, c = min(len(t), len(s)), collections.Counter(t)
    shared = [sum((collections.Counter(s[a : a + m]) & c).values()) for a in range(len(s) - m + 1)] if s else [0]
    return max(x / (m + len(t) - x) for x in shared)


def _matches(texts, items):
    return {(d, i): x for d, i, x in decontaminate.matches(decontaminate.index_items(items), *_flat(*texts))}


def test_decontaminate_windows():
    """Edited passages on both sides of the threshold, items and passages that repeat themselves."""
    rng = random.Random(9)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    items, texts = [], []
    for i in range(120):
        n = rng.choice([4, 13, 30, 49, 94])
        own = new(n)
        if i % 3 == 0:  # a third of the item is one word again and again
            own[n // 3 : n // 3] = [own[0]] * (n // 2)
        items.append((i, " ".join(own)))
        for _ in range(3):
            w = list(own)
            for _ in range(rng.randrange(1 + len(w) // 20)):
                w[rng.randrange(len(w))] = new(1)[0]
            if rng.random() < 0.5:
                cut = rng.randrange(1 + len(w) // 8)
                w[len(w) - cut :] = [rng.choice("xyz")] * cut
            texts.append(" ".join([*new(rng.randrange(40)), *w, *new(rng.randrange(40))]))
    far = []
    for i in range(120, 160):  # item and passage end in a different word again and again
        own, repeats = new(120), [[f"r{i}{x}"] * 12 for x in "abcd"]
        items.append((i, " ".join(own + repeats[0])))
        texts += [" ".join(own + r) for r in repeats[1:]]
        a, *others = (_words.simhash(near_dedup.shingles(*_flat(x))[0]) for x in (items[-1][1], *texts[-3:]))
        far += [(a ^ b).bit_count() for b in others]
    assert max(far) > 21  # fingerprints of windows at 0.8 can be any distance apart
    best = {(d, i): _windows(t, x) for d, t in enumerate(texts) for i, x in items if d // 3 == i}
    want = {k: x for k, x in best.items() if x >= 0.8}
    assert 100 < len(want) < len(best) - 30 and sum(x < 0.84 for x in want.values()) > 10
    assert _matches(texts, items) == want
    # without the block index those are lost whose best window is within its radius
    index = decontaminate.index_items(items)
    for group in index:
        group.blocks = {}
    left = {(d, i): x for d, i, x in decontaminate.matches(index, *_flat(*texts))}
    assert len(want) / 10 < len(left) < 0.9 * len(want) and left.items() <= want.items()


def test_window_prints():
    """Fingerprints of all windows, over the ends of what is counted at a time; the blocks propose all within the radius."""
    import numpy as np

    rng = np.random.default_rng(12)
    s = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    s[300:380] = s[300]
    sizes, got, whole = [1, 2, 7, 64, 255, 256, 300, 701], {}, decontaminate.WINDOWS
    decontaminate.WINDOWS = 128
    try:
        for m, at, prints in decontaminate.window_prints(s, sizes):
            for k, x in enumerate(prints.tolist()):
                assert got.setdefault((m, at + k), x) == x
        items = [(k, _words.simhash(s[a : a + m]) ^ flips) for k, (a, m, flips) in enumerate([(5, 64, 0), (40, 64, 0b1011), (90, 7, 1 << 63), (333, 256, 0b1111), (2, 7, 1 << 20 | 1 << 50 | 1)])]
        index = decontaminate.Items([k for k, _ in items], [s[a : a + m] for a, m in ((5, 64), (40, 64), (90, 7), (333, 256), (2, 7))], 5)
        index.prints = np.array([x for _, x in items], np.uint64)
        for m, (own, _) in list(index.blocks.items()):
            index.blocks[m] = own, decontaminate._block_index(index.prints[own])
        found = {(int(a), m, i) for starts, m, i in index.proposed(s) for a in starts}
    finally:
        decontaminate.WINDOWS = whole
    assert got == {(m, a): _words.simhash(s[a : a + m]) for m in sizes for a in range(700 - m + 1)}
    want = {(a, m, i) for (m, a), x in got.items() for i, y in enumerate(index.prints.tolist()) if index.sizes[i] == m and (x ^ y).bit_count() <= decontaminate.RADIUS}
    assert found == want and {(5, 64, 0), (40, 64, 1), (90, 7, 2), (2, 7, 4)} <= want and (333, 256, 3) not in want


def test_decontamination_rows(spark):
    """drop_leaks keeps the rows that brute force keeps, edited passages included."""
    rng = random.Random(10)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    items, rows = [(i, " ".join(new(49))) for i in range(30)], []
    for i, x in items:
        for edits in range(4):
            w = x.split()
            for k in rng.sample(range(49), edits):
                w[k] = "edited"
            rows.append((4 * i + edits, " ".join([*new(20), *w, *new(20)])))
    want = {d for d, t in rows if _windows(t, items[d // 4][1]) < 0.8}
    got = decontaminate.drop_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert 0 < len(want) < len(rows) and {r.doc_id for r in got.collect()} == want


def test_decontaminate_at_the_threshold():
    """Windows of exactly 0.8 (8 n of 9 n shingles shared), and of one shingle less."""
    for n in range(1, 45):
        words = [f"w{k}" for k in range(9 * n + 4)]
        texts = [" ".join([*words[: 8 * n + 4 - less], *(f"x{k}" for k in range(n + less))]) for less in (0, 1)]
        assert _matches(texts, [(7, " ".join(words))]) == {(0, 7): 0.8}, n


def test_token_counts(spark, odd, empty, tmp_path):
    import numpy as np

    path = token_count.default_tokenizer()
    enc = token_count.encoding(path)
    got = collections.Counter((r.doc_id, r.n_tokens) for r in token_count.count_tokens(odd.repartition(3), path).collect())
    assert got == collections.Counter((i, len(enc.encode_ordinary(t or ""))) for i, t in ODD)
    assert token_count.count_tokens(empty, path).count() == 0
    lengths = [0, 5, 70, 0, 3]
    flat = np.concatenate([np.append(np.arange(n) % 100, token_count.EOD) for n in lengths] + [np.arange(4)]).astype("<u2")
    (tmp_path / "tokens.bin").write_bytes(flat.tobytes())
    rows = token_count.stitch(token_count.scan_blocks(token_count.read_flat(spark, str(tmp_path), 16))).orderBy("place").collect()
    assert [r.n_tokens for r in rows] == [*lengths, 4] and [r.finished for r in rows] == [True] * 5 + [False]


def test_secrets(spark, odd):
    good = b"A" * 30
    token = "ghp_" + good.decode() + secrets.checksum(good).decode()
    text = f"é API_KEY='abcdef12' token: short passwd=x AKIA{'Z' * 16} {'0af' * 8} {token} ghp_{'A' * 36}"
    spans = secrets.find(text.encode())
    assert [(secrets.KINDS[k], text[s:e]) for s, k, e in spans] == [("assign", "API_KEY='abcdef12"), ("access", "AKIA" + "Z" * 16), ("hex", "0af" * 8), ("checked", token)]
    rows = secrets.scan(odd).collect()
    assert len(rows) == len(ODD) and not any(r.spans for r in rows)
    out = secrets.redact(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert token not in out[0].text and out[0].text.count("[SECRET]") == 4 and out[1].text is None


def test_toxicity(spark, odd, empty):
    rng = random.Random(5)
    text = lambda bad: " ".join(rng.choice(["tree", "river", "stone", "light"]) for _ in range(60)) + (" vile foul vile" if bad else "")
    rows = [(i, text(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score_table(docs, model).collect()}
    assert all((scores[i] >= 0.5) == (i % 4 == 0) for i, _ in rows)
    assert {i for _, i, _ in model.segments("tree vile foul stone")} == {1}
    assert toxicity.score_table(odd, model).count() == len(ODD) and toxicity.drop_toxic(empty, model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert all(r.score < 0.5 for r in toxicity.score_table(odd, none).collect())


def test_url_filter(spark):
    keys = spark.range(3000).selectExpr("concat('h', id, '.org') key")
    listed = keys.where("hash(key) % 3 = 0")
    levels = url_filter.cascade(keys, listed)
    from pyspark.sql import functions as F

    assert len(levels) > 1 and keys.where(url_filter.member(F.col("key"), levels) != F.expr("hash(key) % 3 = 0")).count() == 0
    assert url_filter.cascade(keys, listed.limit(0)) == []
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://A.Example.ORG/es/x?y"), (4, "x://com/de/"), (5, "http://spam-farm.net"), (5, "http://spam-farm.net")], "page_id long, url string")
    hosts = pages.select(url_filter.host(F.col("url")).alias("key")).distinct()
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.listed_hosts(hosts)).collect())
    assert got == [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.org", "/es/x", "example.org/es/", "block"), (4, "com", "/de/", "com/de/", "block"), (5, "spam-farm.net", "", None, "block"), (5, "spam-farm.net", "", None, "block")]


def test_warc(spark, tmp_path):
    for version in (1, 2):
        raw = warc.arc_version_block(version) + warc.arc_record(version, "http://a/ b", b"HTTP/1.1 200 OK\r\n\r\nx\n\ny") + warc.arc_record(version, "http://c", b"")
        first, second = warc.parse_arc(raw)
        assert (first["url"], first["content"][-4:], second["content"]) == ("http://a/ b", b"x\n\ny", b"")
    with pytest.raises(ValueError):
        warc.parse_arc(warc.arc_version_block(1) + b"http://a 0.0.0.0 2020 text/html 99\nx")
    big = "é" * 60
    rows = [(3, "u", big), (1, "u v", big), (2, None, None), (4, "w", "short"), (5, "w", "short"), (6, "\n", "a\r\n\r\nWARC/1.1\r\n\r\n" * 9)]
    where = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), where)
    got = {r.page_id: r for r in warc.read_archives(spark, where).collect()}
    assert {i: r.record_type for i, r in got.items()} == {1: "response", 2: "response", 3: "revisit", 4: "response", 5: "response", 6: "response"}
    assert got[3].refers_to == 1 and all(got[i].payload_digest == hashlib.sha256((h or "").encode()).hexdigest() and got[i].payload_bytes == len((h or "").encode()) for i, _, h in rows)


def test_near_dedup(spark, odd, empty):
    rng = random.Random(6)
    base = [[f"w{rng.randrange(900)}" for _ in range(120)] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in rows}
    parent = dict.fromkeys(sets)
    parent = {i: i for i in parent}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and (a := root(i)) != (b := root(j)):
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id for r in near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {root(i) for i in sets}
    left = near_dedup.drop_near_duplicates(odd)
    assert left.columns == odd.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "3", "4", "6", "7", "None"]
    assert near_dedup.drop_near_duplicates(empty).count() == 0


def test_near_dedup_graded_group(spark):
    """One large group around a base text whose members lie on both sides of the threshold from each other."""
    rng = random.Random(7)
    base, rows = [f"w{k}" for k in range(150)], []
    for i in range(240):
        w = list(base)
        for _ in range(rng.randrange(11)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        for _ in range(rng.randrange(3)):
            del w[rng.randrange(len(w))]
        rows.append((i, " ".join(w)))
    sets = {i: {tuple((w := t.split())[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and (a := root(i)) != (b := root(j)):
                parent[max(a, b)] = min(a, b)
    want = {root(i) for i in sets}
    docs, counted = spark.createDataFrame(rows, "doc_id long, text string"), []
    across = near_dedup._across
    def counting(*a):
        out = across(*a)
        counted.append(out.count())
        return out

    near_dedup._across = counting
    try:
        assert {r.doc_id for r in near_dedup.drop_near_duplicates(docs).collect()} == want
    finally:
        near_dedup._across = across
    assert 1 < len(want) < 200 and counted[0] <= len(rows)


def test_near_dedup_repeats(spark):
    """Pages of one template, half of each its own: near copies among them that repeat a passage often."""
    rng = random.Random(8)
    template, rows, twins = [f"t{k}" for k in range(104)], [], {}
    for i in range(60):
        own = [f"p{i}x{k}" for k in range(104)]
        rows.append((i, " ".join(template + own)))
        if i % 6 == 0:
            edited = list(own)
            edited[rng.randrange(60, 100)] = "edited"
            twins[100 + i] = i
            rows.append((100 + i, " ".join(template + edited[:20] * 60 + edited[20:])))
    texts = dict(rows)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    alike = {(j, i) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert alike == set(twins.items())
    far = 0
    for j, i in twins.items():
        a, b = (_words.simhash(near_dedup.shingles(*_flat(texts[x]))[0]) for x in (i, j))
        far += (a ^ b).bit_count() > 26
    assert far  # with repeats counted the fingerprints are too far apart
    got = {r.doc_id for r in near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(range(60))


def test_near_dedup_without_words(spark):
    """Different texts of punctuation are different nodes; null and blank ones are one."""
    rows = [(1, "-----"), (2, "=====\n*"), (3, "(o_o)".replace("o", "^")), (4, " -----\n"), (5, None), (6, ""), (7, " \n\t "), (8, "a"), (9, "-" * 10_000)]
    out = near_dedup.sketches(near_dedup.keyed(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    nodes = {r.id__: r.node for r in out}
    assert nodes[1] == nodes[4] and nodes[5] == nodes[6] == nodes[7]
    assert len(set(nodes.values())) == 6 and len({tuple(r.bands) for r in out}) == 6


def _flat(*texts):
    import numpy as np

    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_pipeline(spark):
    import corpus_pipeline

    from ..conftest import SF

    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and out.count() > 0


def test_sentencepiece_digests_remember_more(monkeypatch):
    """op3's worker remembers the words of a varied corpus; the pipeline's, which keeps texts too, fewer."""
    path, seen = sentencepiece_codec.default_model(), []
    for n, again in ((sentencepiece_codec.DIGEST_CHUNKS, False), (sentencepiece_codec.MEMO_CHUNKS, True)):
        model = sentencepiece_codec.PieceModel(open(path, "rb").read(), n)
        monkeypatch.setattr(model, "chunk_ids", lambda c: seen.append(c) or [300])
        text = " ".join(f"w{k}" for k in range(200_000))
        model.encode_decode(text)
        seen.clear()
        model.encode_decode(text)
        assert bool(seen) == again
