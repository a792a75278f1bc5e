"""Unit vectors of the operators."""

import json
import random
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer
from itertools import permutations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import generated, graph, retrieval, scoring, selection, triples, verification
from graphloom.plans import flows
from graphloom.plans.queries import _keep
from graphloom.sources import models, tables


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


def test_triple_parse(spark):
    t = "Lake Orla [SEP] froze over in [SEP] (ENT2) [PREP] near (ENT1)"
    assert one(spark, T.elements(F.lit(t))) == ["Lake Orla", "froze over in", "(ENT2)", "near (ENT1)"]
    assert one(spark, T.entities(F.lit(t))) == ["(ENT2)", "(ENT1)"]
    assert one(spark, T.elements(F.lit("no mark"))) is None
    assert one(spark, T.elements(F.lit("[SEP]"))) is None
    assert one(spark, T.definition(F.lit("(ENT1) [SEP] is [SEP] a sailor"))) == "a sailor"


@pytest.mark.parametrize(
    ("gold", "pred", "f1"),
    [("red blue", "red green", 0.5), ("the", "", 1.0), ("the", "x", 0.0), ("a1 a1 b", "a1 a1 c", 2 / 3), ("The  Beatles!", "beatles", 1.0)],
)
def test_f1(spark, gold, pred, f1):
    assert one(spark, T.token_f1(F.lit(pred), F.lit(gold))) == pytest.approx(f1)


def test_scalars(spark):
    assert one(spark, T.normalize_answer(F.lit("The  Otters!"))) == "otters"
    assert one(spark, T.exact_match(F.lit("an oak"), F.lit("Oak."))) == 1
    assert one(spark, T.last_tag(F.lit("<search>x</search> <search>y</search>"), "search")) == "y"
    assert one(spark, T.last_tag(F.lit("none"), "search")) is None
    assert one(spark, T.definite(F.lit("Panama canal"))) == "Panamthe canal"
    assert one(spark, T.infill_text(F.lit("Blank is Oslo\nx"), F.lit("d"))) == "Oslo"
    assert one(spark, T.infill_text(F.lit(" "), F.lit("d"))) == "d"
    assert one(spark, T.title_of(F.lit("(Title: A (b) c) text"))) == "A (b"
    assert one(spark, T.question_mark(F.lit("who"))) == "who?"
    assert one(spark, T.passage_title(F.lit("\"'Oslo'\"\nA city"))) == "Oslo"
    assert one(spark, T.cut_at(F.lit("a </search> b </search>"), ("</search>", "</x>"))) == "a </search>"
    assert one(spark, T.cut_at(F.lit("a b"), ("</x>",))) == "a b"


@pytest.mark.parametrize(
    ("said", "verdict"),
    [("True.", True), ("yes, it does", True), ("no way", False), ("not sure", False), ("It is impossible to say.", False), ("it's not possible to tell\ntrue", False), (" FALSE ", False), ("nothing but yes", False)],
)
def test_boolean_answers(spark, said, verdict):
    assert one(spark, T.boolean_answer(F.lit(said))) is verdict


def test_unmapped_boolean_answer_is_drawn_by_its_key(spark):
    rows = spark.createDataFrame([(f"p{k}", "correct") for k in range(40)], "p string, t string").select(T.boolean_answer(F.col("t"), F.col("p")).alias("v"))
    first, second = ([r.v for r in rows.collect()] for _ in range(2))
    assert first == second and set(first) == {True, False}


@pytest.mark.parametrize(
    ("triple", "query"),
    [
        ("(ENT1) [SEP] is [SEP] a harbour", "1 is a harbour"),
        ("Port Ellis [SEP] lies north of [SEP] (ENT1)", "Port Ellis lies north of"),
        ("Port Ellis [SEP] burned down [SEP] twice [PREP] in 1806", "Port Ellis burned down twice"),
        ("(old) mill [SEP] stands in [SEP] Port Ellis", "stands in Port Ellis"),
        ("Port Ellis [SEP] (ENT2)", "Port Ellis   2"),
        ("no marks (ENT1)", "no marks (ENT1)"),
    ],
)
def test_triple_query(spark, triple, query):
    assert one(spark, T.triple_query(F.lit(triple))) == query


@pytest.mark.parametrize(("x", "text"), [(0.0625, "0.062"), (0.2345, "0.234"), (0.0005, "0.001"), (1.0, "1.000"), (2 / 3, "0.667"), (None, None)])
def test_three_places(spark, x, text):
    assert spark.createDataFrame([(x,)], "x double").select(T.three_places()(F.col("x")).alias("x")).first()["x"] == text


_LONG = "a chain that is long enough to count"


@pytest.mark.parametrize(
    ("answer", "text"),
    [
        (f"# Reasoning: old # Reasoning: {_LONG}\n# Latent Entities:\nx\n# Triples:\ny", _LONG),
        (f"Reasoning: {_LONG}\n# Triples:\ny", _LONG),
        ("# Reasoning: short\n# Triples:\ny", ""),
        (f"{_LONG}\n# Question: z", _LONG),
        (f"Given a question do this\n# Output Format:\n{_LONG}\n# Question: z", _LONG),
        (f"# Question: {_LONG}\n# Latent Entities:\nx", _LONG),
        (f"# Question: z\nReasoning: {_LONG}\n# Latent Entities:\nx", _LONG),
        (f"# Question: {_LONG}\n# Triples:\nx", _LONG),
        (f"# Title\nQuestion: {_LONG}\nshort\n {_LONG} \n", _LONG),
        ("nothing here", ""),
    ],
)
def test_cot_text(spark, answer, text):
    assert one(spark, generated.cot_text("t"), t=answer) == text


def test_sections(spark):
    text = "# Latent Entities:\n(ENT1) [SEP] is [SEP] a ship\n(ENT3) [SEP] is [SEP] a port\nNone\n(ENT3) [SEP] is [SEP] a crew\n# Triples:\n(ENT4) [SEP] is [SEP] odd\nx [SEP] y\n# Question: next\nz [SEP] z"
    got = [(r.kind, r.triple) for r in generated.sections(spark.createDataFrame([(1, text)], "index long, text string")).orderBy("pos").collect()]
    assert got == [("definition", "(ENT1) [SEP] is [SEP] a ship"), ("relation", "(ENT3) [SEP] is [SEP] a port"), ("definition", "(ENT3) [SEP] is [SEP] a crew"), ("relation", "(ENT4) [SEP] is [SEP] odd"), ("relation", "x [SEP] y")]


def test_listed_definitions_only(spark):
    """A triple that looks like a definition stays unless it is listed."""
    rows = spark.createDataFrame([(1, "(ENT1) [SEP] is [SEP] a ship\n(ENT1) [SEP] is [SEP] comedy\nx [SEP] y\nx [SEP] y")], "index long, text string")
    listed = spark.createDataFrame([(1, "(ENT1) [SEP] is [SEP] a ship")], "index long, triple string")
    assert [r.triple for r in generated.triple_lines(rows, listed).orderBy("pos").collect()] == ["(ENT1) [SEP] is [SEP] comedy", "x [SEP] y"]


words = st.lists(st.sampled_from(["red", "blue", "the", "x1", "A", ""]), max_size=6).map(" ".join)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(words, words), min_size=1, max_size=8))
def test_f1_property(spark, pairs):
    def plain(a, b):
        p, g = ([w for w in x.lower().split() if w not in ("a", "an", "the")] for x in (a, b))
        if not p or not g:
            return float(p == g)
        n = sum((Counter(p) & Counter(g)).values())
        return 2 * n / (len(p) + len(g))

    rows = spark.createDataFrame(pairs, "p string, g string").select("p", "g", T.token_f1(F.col("p"), F.col("g")).alias("f"), T.token_f1(F.col("g"), F.col("p")).alias("r")).collect()
    for x in rows:
        assert x.f == pytest.approx(plain(x.p, x.g)) == pytest.approx(x.r)


FACTS = [(1, "relation", 0, "(ENT1) [SEP] was launched at [SEP] Kerr Yard"), (1, "relation", 1, "(ENT1) [SEP] carried [SEP] (ENT2)")]
DEFS = [(1, "definition", 0, "(ENT1) [SEP] is [SEP] a ship"), (1, "definition", 1, "(ENT2) [SEP] is [SEP] a cargo")]
COLS = "index long, kind string, pos int, triple string"


def _graph(spark, facts=FACTS, defs=DEFS):
    return spark.createDataFrame(facts, COLS), triples.definitions(spark.createDataFrame(defs, COLS))


def test_graph(spark):
    facts, d = _graph(spark)
    assert [tuple(r) for r in graph.adjacency(facts, d).collect()] == [(1, 0, 1)]
    paths = sorted((r.path_index, r.path) for r in graph.valid_paths(facts, d).collect())
    assert paths == [(0, ["(ENT1)", "(ENT2)"]), (1, ["(ENT2)", "(ENT1)"])]
    q = {r.ent: r.query for r in graph.retrieval_query(facts, d).collect()}
    assert q == {"(ENT1)": "a ship was launched at Kerr Yard.", "(ENT2)": "a cargo is a cargo."}
    i = {r.ent: r.query for r in graph.infill_query(facts, d).collect()}
    assert i == {"(ENT1)": "<extra_id_0> was launched at Kerr Yard. <extra_id_0> is a ship.", "(ENT2)": "<extra_id_0> is a cargo."}
    a = {r.ent: r.query for r in graph.agent_query(facts, d).collect()}
    assert a == {"(ENT1)": "a ship was launched at Kerr Yard. What is the ship?", "(ENT2)": "What is the cargo?"}


def test_definitions_that_name_entities(spark):
    """They are resolved in rounds; an entity without definition ends them, a cycle can't spin."""
    nested = [(1, "definition", 0, "(ENT1) [SEP] is [SEP] the owner of (ENT2)"), (1, "definition", 1, "(ENT2) [SEP] is [SEP] a mill")]
    facts, d = _graph(spark, [(1, "relation", 0, "(ENT1) [SEP] slept")], nested)
    assert {r.ent: r.query for r in graph.retrieval_query(facts, d).collect()} == {"(ENT1)": "the owner of a mill slept.", "(ENT2)": "a mill is a mill."}
    assert {r.ent: r.query for r in graph.infill_query(facts, d).collect()}["(ENT1)"] == "<extra_id_0> slept."
    unknown, d = _graph(spark, [(1, "relation", 0, "(ENT1) [SEP] slept"), (1, "relation", 1, "(ENT9) [SEP] woke [SEP] (ENT1)")], [(1, "definition", 0, "(ENT1) [SEP] is [SEP] kin of (ENT1)")])
    assert [r.query for r in graph.retrieval_query(unknown, d).collect()] == ["kin of (ENT1) slept."]
    cycle, d = _graph(spark, [(1, "relation", 0, "(ENT1) [SEP] slept")], [(1, "definition", 0, "(ENT1) [SEP] is [SEP] kin of (ENT2)"), (1, "definition", 1, "(ENT2) [SEP] is [SEP] kin of (ENT1)")])
    assert graph.retrieval_query(cycle, d).count() == 2


def test_agent_query_mentions(spark):
    """The first mention keeps its article, later ones are definite."""
    facts, d = _graph(spark, [(1, "relation", 0, "(ENT1) [SEP] left"), (1, "relation", 1, "(ENT1) [SEP] came back")], [(1, "definition", 0, "(ENT1) [SEP] is [SEP] an envoy")])
    assert [r.query for r in graph.agent_query(facts, d).collect()] == ["an envoy left. the envoy came back. What is the envoy?"]


def _brute_paths(n, pairs, limit):
    found = {}
    for o in permutations(range(n)):
        bits = tuple(int(o.index(a) > o.index(b)) for a, b in pairs)
        found.setdefault(bits, o)
    return [list(found[b]) for b in sorted(found)][:limit]


def test_paths_equal_permutations(spark):
    """Random graphs of up to seven entities against all permutations."""
    rng, rows, defs, want = random.Random(3), [], [], {}
    for g in range(30):
        n = rng.randrange(1, 8)
        pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randrange(9))}) if n > 1 else []
        defs += [(g, f"(ENT{k})", k, "x", "x") for k in range(n)]
        rows += [(g, "relation", i, f"(ENT{a}) [SEP] meets [SEP] (ENT{b})") for i, (a, b) in enumerate(pairs)]
        want[g] = [[f"(ENT{k})" for k in o] for o in _brute_paths(n, pairs, 6)]
    got = {}
    for r in graph.valid_paths(spark.createDataFrame(rows, COLS), spark.createDataFrame(defs, "index long, ent string, ord int, definition string, sentence string"), 6).orderBy("index", "path_index").collect():
        got.setdefault(r["index"], []).append(r.path)
    assert got == want


def test_paths_of_many_entities(spark):
    """Twelve entities in a ring: 479001600 permutations, five paths."""
    rows = [(1, "relation", k, f"(ENT{k}) [SEP] meets [SEP] (ENT{(k + 1) % 12})") for k in range(12)]
    defs = spark.createDataFrame([(1, f"(ENT{k})", k, "x", "x") for k in range(12)], "index long, ent string, ord int, definition string, sentence string")
    began = time.time()
    paths = graph.valid_paths(spark.createDataFrame(rows, COLS), defs, 5).collect()
    assert len(paths) == 5 and all(sorted(r.path) == sorted(f"(ENT{k})" for k in range(12)) for r in paths) and time.time() - began < 60
    seeded = [r.path for s in (1, 2) for r in graph.valid_paths(spark.createDataFrame(rows, COLS), defs, 5, seed=s).orderBy("path_index").collect()]
    assert seeded[:5] != seeded[5:]


def test_paths_of_a_dense_graph(spark):
    """30 entities with 100 pairs: every path obeys one orientation, all differ, in seconds."""
    rng = random.Random(2)
    pairs = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(130)})[:100]
    rows = [(1, "relation", k, f"(ENT{a}) [SEP] meets [SEP] (ENT{b})") for k, (a, b) in enumerate(pairs)]
    defs = spark.createDataFrame([(1, f"(ENT{k})", k, "x", "x") for k in range(30)], "index long, ent string, ord int, definition string, sentence string")
    began = time.time()
    paths = [r.path for r in graph.valid_paths(spark.createDataFrame(rows, COLS), defs, 5).orderBy("path_index").collect()]
    assert time.time() - began < 60 and len(paths) == 5 == len(set(map(tuple, paths))) and paths[0] == [f"(ENT{k})" for k in range(30)]
    bits = [[int(p.index(f"(ENT{a})") > p.index(f"(ENT{b})")) for a, b in pairs] for p in paths]
    assert bits == sorted(bits) and all(sorted(p) == sorted(paths[0]) for p in paths)


def test_open_definitions(spark):
    rows = spark.createDataFrame([(1, "definition", 0, "Oslo [SEP] is [SEP] near (ENT2)"), (1, "definition", 1, "(ENT2) hall [SEP] is [SEP] x"), (1, "relation", 0, "x [SEP] y")], COLS)
    assert [r.triple for r in triples.open_definitions(rows).collect()] == ["(ENT2) hall [SEP] is [SEP] x", "x [SEP] y"]


def test_isolated_entities_have_one_path(spark):
    d = spark.createDataFrame([(1, f"(ENT{k})", k, "x", "x") for k in range(3)], "index long, ent string, ord int, definition string, sentence string")
    none = spark.createDataFrame([], COLS)
    assert [r.path for r in graph.valid_paths(none, d).collect()] == [["(ENT0)", "(ENT1)", "(ENT2)"]]


def test_compare_and_repair(spark):
    rows = [(1, "cot", "A [SEP] x"), (1, "cot", "B [SEP] x"), (1, "doc", "b [SEP]  X"), (1, "doc", "C [SEP] x"), (1, "doc", "D [SEP] x")]
    r = triples.compare(spark.createDataFrame(rows, "index long, source string, triple string"), "cot", "doc").first()
    assert (r.overlap, r.precision, r.recall) == (1, 0.5, pytest.approx(1 / 3)) and r.f1 == pytest.approx(0.4)
    s = spark.createDataFrame([(1, ["(ENT1) [SEP] runs [SEP] x"], ["(ENT1) [SEP] is [SEP] a film"])], "index long, cot_def_triples array<string>, cot_triples array<string>")
    r = triples.repair(s).first()
    assert r.changed and r.cot_def_triples == ["(ENT1) [SEP] is [SEP] a film"] and r.cot_triples == ["(ENT1) [SEP] runs [SEP] x"]


def test_last_definition_counts(spark):
    rows = [(1, "definition", 0, "(ENT1) [SEP] is [SEP] a film"), (1, "definition", 1, "(ENT1) [SEP] is [SEP] a silent film")]
    r = triples.definitions(spark.createDataFrame(rows, COLS)).first()
    assert (r.ent, r.ord, r.definition) == ("(ENT1)", 0, "a silent film")


def test_evidence_cap_counts_gold(spark):
    gold = spark.createDataFrame([(1, i, 100 + i, f"g{i}") for i in range(2)], "qid long, ord long, doc_id long, evidence string")
    hits = spark.createDataFrame([(1, i, i, f"h{i}") for i in range(5)], "qid long, ord long, doc_id long, evidence string")
    out = retrieval.assemble(gold, hits, "open-book+gold", 5).orderBy("pos").collect()
    assert [r.evidence for r in out] == ["g0", "g1", "h0", "h1", "h2"] and [r.is_gold for r in out] == [1, 1, 0, 0, 0]
    assert retrieval.assemble(gold, hits, "open-book+gold", 5, total=True).count() == 7


def test_rollup_counts_null_scores_as_zero(spark):
    rows = spark.createDataFrame([(2, 1, 1.0), (2, None, None), (3, 1, 0.5)], "num_hops int, em_score int, f1_score double")
    assert {r.hops: (r.n, r.em, r.f1) for r in scoring.by_hop(rows).collect()} == {"total": (3, 2 / 3, 0.5), "2": (2, 0.5, 0.5), "3": (1, 1.0, 0.5)}
    lines = [r.value for r in scoring.metric_lines(scoring.by_hop(rows)).collect()]
    assert lines[0] == "Hops: 2, EM: 0.500, F1: 0.500"
    assert {r.hops: r.n for r in scoring.fixed_hops(rows).collect()} == {"total": 3, "2": 2, "3": 1, "4": 0}


def test_selection(spark):
    rows = spark.range(100).withColumn("h", F.col("id") % 3)
    s = selection.stratified_sample(rows, {0: 5, 1: 7}, "h", F.col("id"))
    assert s.groupBy("h").count().orderBy("h").collect() == [(0, 5), (1, 7)]
    left = selection.reindex(selection.complement(rows, s, "id"), "id")
    assert [r["index"] for r in left.orderBy("id").collect()] == list(range(88))
    assert selection.complete(rows, rows, "id") and not selection.complete(rows, s, "id")


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"index": 1, "question": "q", "num_hops": 2, "answer": "a"}, {"index": 2}]')
    rows = tables.read_samples(spark, str(tmp_path / "s.json"))
    assert [r.question for r in rows.orderBy("index").collect()] == ["q", None]
    tables.write_results(rows.drop("source_file"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    memo = tables.MemoTable(spark, str(tmp_path / "memo"))
    assert memo.read().count() == 0
    for _ in range(2):
        memo.append(spark.createDataFrame([("p", "v")], tables.MEMO))
    assert memo.read().collect() == [("p", "v")]
    config = tables.EngineConfig(top_k=3)
    assert "top_k=3" in config.output_path("r", "answering")
    for wrong in ({"setting": "closed"}, {"strategy": "guess"}, {"document_level": "page"}):
        with pytest.raises(ValueError):
            tables.EngineConfig(**wrong)


def test_sorted_results(spark, tmp_path):
    """Files in the order of the index."""
    tables.write_results(spark.range(50).selectExpr("99 - id as index"), str(tmp_path / "o"), "json", order="index")
    read = [json.loads(x)["index"] for f in sorted((tmp_path / "o").glob("part-*")) for x in f.read_text().split()]
    assert read == sorted(read) and len(read) == 50


def test_stages_resume(spark, tmp_path):
    """A run that starts again reads what is complete."""
    from pyspark.sql.functions import udf

    seen = spark.sparkContext.accumulator(0)

    @udf("long")
    def counted(x):
        seen.add(1)
        return x

    for _ in range(2):
        keep = tables.Stages(str(tmp_path))
        assert keep(spark.range(4).select(counted("id").alias("x"))).count() == 4
    assert seen.value == 4


def test_construct_graphs_resumes(spark, tmp_path):
    keep, store = _keep(spark), tables.GraphTable(spark, str(tmp_path / "g"))
    rows = spark.createDataFrame([(k, f"ships sail far{k}") for k in range(4)], "index long, question string")
    model = models.LineBackend(as_triples=True)
    first = flows.construct_graphs(rows.where("index < 2"), store, model, keep)
    assert {r["index"] for r in first.collect()} == {0, 1} and store.read().count() == first.count()
    everything = flows.construct_graphs(rows, store, model, keep)
    n = everything.count()
    assert everything.groupBy("index").count().select("count").distinct().count() == 1 and everything.select("index").distinct().count() == 4
    assert flows.construct_graphs(rows, store, model, keep, force=True).count() == n


def test_stream(spark, tmp_path):
    from graphloom.streaming.ingest import run_batches, sample_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"index": 1, "question": "q"}\n{"index": 1, "question": "q"}\n{"index": 2, "question": "r"}\n')
    run_batches(sample_stream(spark, str(tmp_path / "in")), lambda b: b.select("index", "question"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r["index"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_models_answer_every_distinct_prompt_once(spark):
    rows = spark.createDataFrame([(1, "Oslo is old.", "Oslo is old"), (2, "Oslo is old.", "Oslo is old"), (3, "x", "Berlin grew fast")], "i int, evidence string, claim string")
    out = {r.i: r.supported for r in models.verify(rows, models.StubBackend()).collect()}
    assert out == {1: True, 2: True, 3: False}
    with pytest.raises(ValueError):
        models.backend("nobody")


def test_small_run(spark):
    docs = spark.createDataFrame([(1, "Kerr Yard\nKerr Yard built the Marigold for Ann Lee."), (2, "Oslo\nOslo is a city.")], "doc_id long, contents string")
    keep = _keep(spark)
    c = flows.Corpus(docs, keep)
    s = spark.createDataFrame([(1, "Who owned the Marigold?", "Ann Lee", 2), (2, "Where is Oslo?", "Norway", 2)], "index long, question string, answer string, num_hops int")
    gold = spark.createDataFrame([], "index long, ord long, doc_id long, evidence string")
    facts = spark.createDataFrame(FACTS + DEFS, COLS)
    out = {r["index"]: r for r in flows.graph_check(s, facts, c, gold, models.StubBackend(), tables.EngineConfig(), keep).collect()}
    assert set(out) == {1, 2} and out[2].best_path_confidence == 0.0 and out[1].prediction in ("SUPPORTED", "NOT_SUPPORTED")


class Server(BaseHTTPRequestHandler):
    """A search service, two chat formats and a batch API on one port."""

    files: dict = {}
    lines: list = []

    def log_message(self, *a):
        pass

    def _send(self, x, raw=False):
        body = x if raw else json.dumps(x).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def do_POST(self):  # noqa: N802
        body = self.rfile.read(int(self.headers["Content-Length"]))
        if self.path == "/retrieve":
            x = json.loads(body)
            return self._send({"result": [[{"document": {"contents": f"T{k}\n{q}"}, "score": 9 - k} for k in range(x["topk"])] for q in x["queries"]]})
        if self.path == "/chat":
            x = json.loads(body)
            return self._send({"choices": [{"message": {"content": x["messages"][-1]["content"].upper()}}]})
        if self.path == "/messages":
            x = json.loads(body)
            assert "system" in x and self.headers["x-api-key"] == "k"
            return self._send({"content": [{"text": x["messages"][0]["content"][::-1]}]})
        if self.path == "/v1/files":
            Server.lines = [json.loads(x) for x in body.decode().splitlines() if x.startswith('{"custom_id"')]
            return self._send({"id": "file"})
        return self._send({"id": "b", "status": "in_progress"})

    def do_GET(self):  # noqa: N802
        if self.path.startswith("/v1/batches"):
            return self._send({"id": "b", "status": "completed", "output_file_id": "out", "error_file_id": "err"})
        good = [x for x in Server.lines if "bad" not in x["body"]["messages"][-1]["content"]]
        if self.path == "/v1/files/out/content":  # in another order, one line missing
            out = [{"custom_id": x["custom_id"], "response": {"status_code": 200, "body": {"choices": [{"message": {"content": x["body"]["messages"][-1]["content"] + "!"}}]}}} for x in reversed(good) if "lost" not in str(x)]
        else:
            out = [{"custom_id": x["custom_id"], "error": "refused"} for x in Server.lines if x not in good]
        return self._send("\n".join(map(json.dumps, out)).encode(), raw=True)


@pytest.fixture(scope="module")
def server():
    s = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_http_models(server):
    assert models.backend("gpt-x", url=f"{server}/chat").generate(["ab"]) == [("AB", None, "ok")]
    assert models.backend("claude-x", url=f"{server}/messages", key="k").generate(["ab"]) == [("ba", None, "ok")]
    assert models.HttpBackend(url=f"{server}/nowhere-json", timeout_s=1).generate(["x"])[0][2].startswith("error")
    assert models.backend("gpt", timeout_s=7.0).timeout_s == 7.0 and not hasattr(models.backend("stub", timeout_s=7.0), "timeout_s")


def test_batch_model(server):
    """Answers are joined by id; a refused and a lost request get a status."""
    got = models.BatchBackend(url=server, poll_s=0.01).generate(["a", "bad", "lost", "b"])
    assert [g[0] for g in got] == ["a!", None, None, "b!"] and [g[2][:5] for g in got] == ["ok", "error", "error", "ok"]


def test_http_retriever(spark, server):
    queries = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "qid long, query string")
    got = sorted(tuple(r) for r in models.retrieve(queries, models.HttpRetriever(f"{server}/retrieve"), top_k=2).collect())
    assert got == [(q, k, f"T{k}\n{t}", 9.0 - k, "ok") for q, t in ((1, "x"), (2, "x"), (3, "y")) for k in range(2)]
    failed = models.retrieve(queries, models.HttpRetriever("http://127.0.0.1:9", 1.0)).collect()
    assert len(failed) == 3 and all(r.contents is None and r.status.startswith("error") for r in failed)


class _Tensor(list):
    def to(self, _):
        return self

    def tolist(self):
        return list(self)


class _Given(dict):
    def to(self, _):
        return self


def test_local_models(monkeypatch):
    """A fake library: what is asked of it, the confidence of picked tokens, and the cut at a stop sequence."""

    class Tok:
        def __call__(self, text, return_tensors):
            return _Given(input_ids=type("I", (), {"shape": (1, 0)})())

        def apply_chat_template(self, messages, tokenize, add_generation_prompt):
            return messages[-1]["content"]

        def batch_decode(self, out, skip_special_tokens):
            return ["go </search> on"]

        def decode(self, ids, skip_special_tokens):
            return " ".join(map(str, ids))

    class Out:
        sequences = [_Tensor([0, 1, 2])]
        scores = [[_Tensor([0.0, 0.0])], [_Tensor([0.0, 0.0, 0.0, 0.0])]]

    class Model:
        device = "cpu"

        def generate(self, **how):
            if how.get("output_scores"):
                return Out()
            assert how["do_sample"] is False
            return type("O", (), {"__getitem__": lambda self, i: self})()

    monkeypatch.setattr(models, "_local", lambda kind, path: (None, Tok(), Model()))
    assert models.CausalBackend(stop=("</search>",)).generate(["x"]) == [("go </search>", None, "ok")]
    text, confidence, status = models.Seq2SeqBackend().generate(["x"])[0]
    assert (text, status) == ("0 1 2", "ok") and confidence == pytest.approx((1 / 2 + 1 / 4) / 2)
    monkeypatch.undo()
    assert models.CausalBackend(path="/nowhere").generate(["x"])[0][2].startswith("error")


def test_strategies(spark):
    row = spark.createDataFrame([(1, "Who?", "since x", ["(ENT1) [SEP] is [SEP] a ship"], ["a [SEP] b [SEP] c"], None, None)], "index long, question string, cot_reasoning string, cot_def_triples array<string>, cot_triples array<string>, question_def_triples array<string>, question_triples array<string>")
    ask = lambda name, **k: [(r.hop, r.query, r.thinking) for r in retrieval.strategy_queries(row, name, **k).orderBy("hop").collect()]
    assert ask("question") == [(0, "Who?", None)] == ask("question_triplets")
    assert ask("triplets") == [(0, "Who?\n\nTriplets:\n(ENT1) [SEP] is [SEP] a ship\na [SEP] b [SEP] c", None)]
    assert ask("cot_reasoning") == [(0, "Who?", None)] and ask("cot_reasoning", agent=True, nudge=True) == [(0, "Who?", "since x")]
    assert ask("multihop_triplets") == [(0, "Who?\n\nSearching for: 1 is a ship", None), (1, "Who?\n\nSearching for: a b c", None)]
    with pytest.raises(ValueError):
        ask("guess")


def test_containing(spark):
    """Literal containment by rare inner words: against all pairs."""
    rng = random.Random(4)
    word = lambda: rng.choice(["ship", "port", "mill", "oak", "é", "a-b", "x1"])
    docs = [(k, " ".join(word() for _ in range(30))) for k in range(60)] + [(60, None), (61, "")]
    queries = [(k, (d := docs[rng.randrange(60)][1])[(a := rng.randrange(len(d) - 5)) : a + rng.randrange(1, 40)]) for k in range(60)] + [(60, "nowhere to be found here"), (61, "")]
    got = {tuple(r) for r in retrieval.containing(spark.createDataFrame(docs, "doc_id long, contents string"), spark.createDataFrame(queries, "qid long, query string")).collect()}
    assert got == {(q, i) for q, t in queries for i, d in docs if t and d and t in d}


def test_tiers(spark):
    """All evidence first, then document by document; confidences are those of the calls made."""
    whole = spark.createDataFrame([(1, True, 0.9), (2, False, 0.5), (3, False, 0.5), (4, False, None)], "claim_id long, supported boolean, confidence double")
    each = spark.createDataFrame([(1, 0, "a", True, 0.1), (2, 0, "a", False, 0.2), (2, 1, "b", True, 0.8), (2, 2, "c", True, 0.3), (3, 0, "a", False, 0.1)], "claim_id long, pos int, doc_id string, supported boolean, confidence double")
    got = {r.claim_id: (r.supported, r.tier, r.supported_doc_id, r.confidence) for r in verification.tiers(whole, each).collect()}
    assert got == {1: (True, "concat", "[concatenated_documents]", 0.9), 2: (True, "each", "b", 0.5), 3: (False, "none", None, 0.3), 4: (False, "none", None, None)}


DOCS = [(1, "Kerr Yard\nKerr Yard built the Marigold for Ann Lee."), (2, "Oslo\nOslo is a city."), (3, "Marigold\nThe Marigold carried salt.")]


def _world(spark):
    keep = _keep(spark)
    c = flows.Corpus(spark.createDataFrame(DOCS, "doc_id long, contents string"), keep)
    s = spark.createDataFrame([(1, "Who owned the Marigold?", "Ann Lee", 2), (2, "Where is Oslo?", "Norway", 2)], "index long, question string, answer string, num_hops int")
    return keep, c, s, spark.createDataFrame([], "index long, ord long, doc_id long, evidence string")


@pytest.mark.parametrize("level", ["concat", "each", "concat+each"])
def test_verify_claims(spark, level):
    keep, c, _, gold = _world(spark)
    claims = spark.createDataFrame([(1, 1, "The Marigold carried salt"), (2, 1, "Oslo sank at dawn")], "qid long, index long, claim string")
    got = {r.qid: r for r in flows.verify_claims(claims, c, gold, models.StubBackend(threshold=0.9), tables.EngineConfig(document_level=level), keep).collect()}
    assert got[1].supported and not got[2].supported and got[2].supported_doc_id is None
    assert got[1].supported_doc_id == ("3" if level == "each" else "[concatenated_documents]")


class Searcher(models.Backend):
    """Searches the question, then answers; other prompts get their last line."""

    def generate(self, prompts):
        return [(self._one(p), 0.5, "ok") for p in prompts]

    def _one(self, p):
        if "<search> query </search>" not in p:
            return p.split("\n")[-1]
        return "done <answer>x</answer>" if "<information>" in p else f"<search>{p.rsplit('# Question: ', 1)[1].split('<')[0]}</search> more"


@pytest.mark.parametrize(("nudge", "total"), [(False, False), (True, False), (True, True)])
def test_agent_run(spark, nudge, total):
    """v2 and v3: the agent searches for infilling, with thoughts for start entities if nudged."""
    keep, c, s, gold = _world(spark)
    facts = spark.createDataFrame(FACTS + DEFS, COLS)
    config = tables.EngineConfig(use_agent=True, nudge=nudge, total_results=total, max_turns=3)
    out = {r["index"]: r for r in flows.graph_check(s, facts, c, gold, Searcher(), config, keep).collect()}
    assert set(out) == {1, 2} and out[1].best_path_index is not None
    hits = flows.agent_hits(spark.createDataFrame([(5, "salt Marigold"), (6, "salt Marigold")], "qid long, query string"), c, Searcher(), config, keep)
    rows = hits.orderBy("qid", "ord").collect()
    assert {r.qid for r in rows} == {5, 6} and rows[0].doc_id == 3 and rows[0].evidence.startswith("(Title: Marigold)")


@pytest.mark.parametrize("strategy", ["question", "multihop_triplets", "question_triplets"])
def test_compare_run(spark, strategy):
    """E3 with a model that makes triples of a prompt's lines."""
    keep, c, s, _ = _world(spark)
    s = s.select("index", "question").unionByName(spark.createDataFrame([(3, None)], "index long, question string"))
    gold = spark.createDataFrame([(1, 0, 1, "(Title: Kerr Yard) Kerr Yard built the Marigold for Ann Lee.")], "index long, ord long, doc_id long, evidence string")

    class Reasoner(models.Backend):
        def generate(self, prompts):
            made = models.LineBackend(as_triples=True).generate(prompts)
            return [(f"# Reasoning: it was Kerr Yard that built her\n# Triples:\n{m[0]}", 0.5, "ok") if "step by step" in p else m for p, m in zip(prompts, made, strict=True)]

    state, compared = flows.compare_run(s, c, gold, Reasoner(), tables.EngineConfig(strategy=strategy, compare_question=True), keep)
    assert {r["index"]: r.state for r in state.collect()} == {1: "ok", 2: "ok", 3: "no question"}
    rows = {(r["index"], r.pairing): r for r in compared.collect()}
    same = rows[1, "gold_doc"]
    assert same.n_self == 1 and same.overlap == 1  # the gold passage is found, so its triple is among the documents'


def test_retry_empty(spark):
    """Rows that stay empty are asked again, as often as allowed."""
    keep, asked = _keep(spark), []

    def make(rows, attempt):
        asked.append(rows.count())
        return rows.select("index", F.when(F.col("index") <= attempt, "text").alias("text"))

    out = {r["index"]: r.text for r in flows.retry_empty(spark.range(4).withColumnRenamed("id", "index"), make, 2, keep).collect()}
    assert out == {0: "text", 1: "text", 2: "text", 3: None} and asked == [4, 3, 2]
