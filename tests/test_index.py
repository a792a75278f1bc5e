"""The bounded index against plain BM25, and an index in segments against one that is built at once."""

import collections
import math
import random
import re

import pytest

from graphloom.operators import index, retrieval
from graphloom.plans import flows
from graphloom.plans import queries as plans
from graphloom.plans.queries import _keep

K1, B = 0.9, 0.4


def words(text):
    return [w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w]


def brute(docs, queries, k):
    held = {d: collections.Counter(words(t)) for d, t in docs}
    mean = sum(sum(c.values()) for c in held.values()) / len(held)
    df = collections.Counter(w for c in held.values() for w in c)
    out = []
    for q, text in queries:
        scores = []
        for d, c in held.items():
            own = [(w, n) for w, n in collections.Counter(words(text)).items() if w in c]
            if own:
                s = sum(n * math.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] / (c[w] + K1 * (1 - B + B * sum(c.values()) / mean)) for w, n in own)
                scores.append((-round(s, 6), d))
        out += [(q, rank, d, -s) for rank, (s, d) in enumerate(sorted(scores)[:k])]
    return out


def rows(df):
    return sorted((r.qid, r["rank"], r.doc_id, r.score) for r in df.collect())


def alike(got, want):
    """Equal up to the last place of a rounded score."""
    assert [x[:2] for x in got] == [x[:2] for x in want]
    for x, y in zip(got, want, strict=True):
        assert x[3] == pytest.approx(y[3], abs=2e-6) and (x[2] == y[2] or x[3] == pytest.approx(y[3], abs=2e-6))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    common, rare = ["the", "of", "and", "in"], [f"r{k}" for k in range(3000)]
    docs = [(k, " ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(rng.choice([3, 20, 60, 200])))) for k in range(800)]
    docs += [(9000, None), (9001, ""), (9002, "the " * 500), (9003, "The of")] + [(9100 + k, docs[5][1]) for k in range(4)]
    queries = [(k, " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(12))) for k in range(30)]
    queries += [(100 + k, docs[rng.randrange(800)][1]) for k in range(10)] + [(200, "the of"), (201, "nowhere"), (202, ""), (203, None), (204, docs[5][1])]
    return docs, queries


def test_top_k(spark, corpus):
    docs, queries = corpus
    d, q = spark.createDataFrame(docs, "doc_id long, contents string"), spark.createDataFrame(queries, "qid long, query string")
    own = index.Index.build(d, keep := _keep(spark))
    for k in (1, 5):
        alike(rows(own.top_k(q, k, keep)), sorted(brute(docs, queries, k)))
    # documents met: those of rare words, and few of the hundreds that hold a stop word
    met = collections.Counter(r.qid for r in own.candidates(q.where("qid < 200"), 5, keep).collect())
    holders = [sum(bool(set(words(t)) & set(words(x))) for _, x in docs) for k, t in queries if k < 200]
    assert sum(met.values()) < 0.35 * sum(holders) and min(holders) > 500


def test_hot_words_are_no_join_key(spark, corpus):
    """Blocks that are read hold few of a stop word's postings."""
    docs, queries = corpus
    d, q = spark.createDataFrame(docs, "doc_id long, contents string"), spark.createDataFrame([x for x in queries if x[0] < 30], "qid long, query string")
    own, seen = index.Index.build(d, keep := _keep(spark)), []
    real = own._documents
    own._documents = lambda wanted: seen.append(wanted) or real(wanted)
    own.candidates(q, 5, keep).collect()
    read = seen[1].join(own.blocks.select("token", "block"), ["token", "block"]).groupBy("token").sum("n").collect()
    stop = sum(r[1] for r in read if r.token in ("the", "of", "and", "in"))
    every = own._asked(q, K1, B).where("token in ('the', 'of', 'and', 'in')").agg({"n": "sum"}).first()[0]
    assert stop < 0.2 * every


def test_segments_equal_one_build(spark, corpus, tmp_path):
    docs, queries = corpus
    d, q = spark.createDataFrame(docs, "doc_id long, contents string"), spark.createDataFrame(queries, "qid long, query string")
    keep, store = _keep(spark), index.Segments(spark, str(tmp_path / "i"))
    assert rows(store.index(keep).top_k(q, 3, keep)) == []
    for k in range(3):
        store.add(d.where(f"doc_id % 3 = {k}"))
    once = index.Index.build(d, keep)
    both = store.index(keep)
    assert (both.n_docs, both.avgdl) == (once.n_docs, once.avgdl)
    assert sorted(map(tuple, both.blocks.collect())) == sorted(map(tuple, once.blocks.collect()))
    assert rows(both.top_k(q, 5, keep)) == rows(once.top_k(q, 5, keep))
    # deletion, another text under a deleted id, a merge
    gone = d.where("doc_id % 5 = 0 or doc_id = 9100").select("doc_id")
    store.delete(gone)
    store.add(spark.createDataFrame([(10, "r1 r2 the r3"), (12345, "r7 of")], "doc_id long, contents string"))
    left = [x for x in docs if x[0] % 5 and x[0] != 9100] + [(10, "r1 r2 the r3"), (12345, "r7 of")]
    want = rows(index.Index.build(spark.createDataFrame(left, "doc_id long, contents string"), keep).top_k(q, 5, keep))
    assert rows(store.index(keep).top_k(q, 5, keep)) == want
    store.merge()
    assert rows(index.Segments(spark, str(tmp_path / "i")).index(keep).top_k(q, 5, keep)) == want
    alike(want, sorted(brute(left, queries, 5)))


def test_postings_stay_in_their_rows(spark):
    """Words are counted without a shuffle; rows of a repeated doc_id and of one length count as one document, as in the SQL."""
    docs = [(1, "a b a"), (2, None), (3, "c c"), (None, "a x")]
    own = index.postings(spark.createDataFrame(docs, "doc_id long, contents string"))
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    plain = lambda df: sorted((str(r.doc_id), r.token, r.tf, r.dl) for r in df.collect())
    want = [("1", "a", 2, 3), ("1", "b", 1, 3), ("3", "c", 2, 2), ("None", "a", 1, 2), ("None", "x", 1, 2)]
    assert plain(own) == want
    again = index.postings(spark.createDataFrame([*docs, (1, "a d d"), (1, "a"), (None, "x y")], "doc_id long, contents string"))
    assert plain(again) == sorted([("1", "a", 1, 1), ("1", "a", 3, 3), ("1", "b", 1, 3), ("1", "d", 2, 3), ("3", "c", 2, 2), ("None", "a", 1, 2), ("None", "x", 2, 2), ("None", "y", 1, 2)])


def test_little_lies_beside_the_postings(spark, corpus, monkeypatch, tmp_path):
    """Postings are in parts of a bounded number of documents, each of which is scored by a job of its own; blocks are those of the
    words asked for, and scores below the one to reach aren't kept."""
    monkeypatch.setattr(index, "PART_DOCS", 300)
    docs, queries = corpus
    docs = [*docs, (7, "the r1"), (7, "of r2"), (None, "r5 r6")]
    d, q = spark.createDataFrame(docs, "doc_id long, contents string"), spark.createDataFrame([x for x in queries if x[0] > 90], "qid long, query string")
    kept, real = [], _keep(spark)

    def keep(df):
        kept.append(real(df))
        return kept[-1]

    own = index.Index.build(d, keep)
    assert len(own.parts) == 3 and len(kept) == 3
    ids = [{r.doc_id for r in t.select("doc_id").distinct().collect()} for t in kept]
    assert all(ids) and not (ids[0] & ids[1] | ids[0] & ids[2] | ids[1] & ids[2])
    got = own.top_k(q, 5, keep)
    asked = {w for _, t in queries for w in words(t)}
    formed = [t for t in kept[3:] if {"token", "block"} <= set(t.columns)]
    assert formed and all({r.token for r in t.select("token").distinct().collect()} <= asked for t in formed)
    scored = [t for t in kept if t.columns == ["qid", "doc_id", "score"]]
    assert len(scored) > 3
    reach = {r.qid: r.reach for t in kept if t.columns == ["qid", "reach"] for r in t.collect()}
    assert all(r.score >= reach[r.qid] - index.SLACK for t in scored[3:] for r in t.collect() if r.qid in reach)
    monkeypatch.setattr(index, "PART_DOCS", 10**6)
    assert rows(got) == rows(index.Index.build(d, real).top_k(q, 5, real))
    # segments in parts too, and nothing of the old ones once they are swept
    monkeypatch.setattr(index, "PART_DOCS", 200)
    d = d.where("doc_id <> 7")
    store = index.Segments(spark, str(tmp_path / "i"))
    for k in range(2):
        store.add(d.where(f"doc_id % 2 = {k}"))
    store.delete(d.where("doc_id % 5 = 0").select("doc_id"))
    store.merge()
    before = rows(store.index(real).top_k(q, 5, real))
    store.sweep()
    assert sorted(p.name for p in (tmp_path / "i").iterdir()) == ["manifest", "segment-000003"]
    assert len(store.index(real).parts) == 4
    assert rows(store.index(real).top_k(q, 5, real)) == before == rows(index.Index.build(d.where("doc_id % 5 <> 0"), real).top_k(q, 5, real))


def test_found_passages_alone_are_made(spark):
    """no copy of a corpus's passages is kept."""
    real, kept = _keep(spark), []
    docs = spark.createDataFrame([(k, f"title {k}\nword{k} common text") for k in range(50)], "doc_id long, contents string")
    c = flows.Corpus(docs, lambda df: kept.append(df) or real(df))
    hits = c.hits(spark.createDataFrame([(1, "word3"), (2, "word7 word8")], "qid long, query string"), 2).collect()
    assert sorted((r.qid, r.doc_id, r.evidence) for r in hits) == [(1, 3, "(Title: title 3) word3 common text"), (2, 7, "(Title: title 7) word7 common text"), (2, 8, "(Title: title 8) word8 common text")]
    assert not any("evidence" in t.columns for t in kept)


def test_texts_stay_where_they_are(spark):
    """Texts in which a passage is looked up aren't shuffled while the pairs to verify are few."""
    keep, before = _keep(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    docs = keep(spark.createDataFrame([(k, f"a{k} b{k} c{k} d{k} " + " ".join(f"w{k * j}" for j in range(400))) for k in range(300)], "doc_id long, contents string"))
    q = spark.createDataFrame([(1, "a7 b7 c7 d7"), (2, "b8 c8 d9"), (3, "b9 c9 d9")], "qid long, query string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        found = retrieval.containing(docs, q, keep=keep)
        assert "Exchange hashpartitioning(doc_id" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == [(1, 7), (3, 9)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stored_postings_stay_where_they_are(spark, corpus, monkeypatch, tmp_path):
    """F8: neither deletion marks nor the words and blocks asked for make a shuffle of the postings, also where they don't fit a broadcast
    of Spark's own choice; a part of a merge reads the parts that have its documents."""
    monkeypatch.setattr(index, "PART_DOCS", 300)
    monkeypatch.setattr(index, "SENT_WORDS", 25)
    docs, queries = corpus
    d, q = spark.createDataFrame(docs, "doc_id long, contents string"), spark.createDataFrame([(200, "the of r1"), (201, "r2 in r3 and r4 r5")], "qid long, query string")
    store, key = index.Segments(spark, str(tmp_path / "i")), "spark.sql.autoBroadcastJoinThreshold"
    store.add(d.where("doc_id % 3 = 0"))
    store.add(d.where("doc_id % 3 > 0"))
    store.delete(d.where("doc_id % 5 = 0").select("doc_id"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    before, keep, met, real = spark.conf.get(key), _keep(spark), [], index.Index._documents
    spark.conf.set(key, "-1")
    try:
        parts = store._parts(store._manifest())
        assert [n for _, _, n in parts] == [1, 2, 2] and not any("Exchange hashpartitioning" in plan(t) for t, _, _ in parts)
        monkeypatch.setattr(index.Index, "_documents", lambda self, wanted: met.append(real(self, wanted)) or met[-1])
        store.merge()
        store.sweep()
        got = rows(store.index(keep).top_k(q, 5, keep))
        assert len(met) == 2 and not any("SortMergeJoin" in plan(t) for t in met)
    finally:
        spark.conf.set(key, before)
    monkeypatch.setattr(index, "PART_DOCS", 10**6)
    assert got == rows(index.Index.build(d.where("doc_id % 5 <> 0"), keep).top_k(q, 5, keep))


def test_nothing_of_an_index_is_left(spark, tmp_path, monkeypatch):
    """F8: the query's index goes once its hits are a table."""
    monkeypatch.setattr(plans, "scratch", lambda spark, what: str(tmp_path / what))
    assert plans.q_index_segments(spark, "/root/testdata/sf0.001").count() > 0
    assert [p.name for p in tmp_path.iterdir()] == ["run"] and len(list((tmp_path / "run").iterdir())) == 1
