"""Early stop and shared beginnings of paths: what is asked of the model, and that the rows are those of asking everything."""

import itertools
import uuid
from dataclasses import dataclass
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import verification
from graphloom.plans import flows
from graphloom.plans.queries import _keep
from graphloom.sources import models, tables

DOCS = [(1, "Kerr Yard\nKerr Yard built the Marigold for Ann Lee."), (2, "Oslo\nOslo is a city in Norway."), (3, "Marigold\nThe Marigold carried salt."), (4, "Salt\nSalt was sold by Ann Lee in Oslo.")]
COLS = "index long, kind string, pos int, triple string"


@dataclass(frozen=True)
class Logged(models.StubBackend):
    """Writes every prompt down."""

    log: str = ""

    def generate(self, prompts):
        for p in prompts:
            Path(self.log, uuid.uuid4().hex).write_text(p)
        return super().generate(prompts)


def prompts(log):
    return [p.read_text() for p in Path(log).iterdir()]


def world(spark, tmp_path, threshold):
    keep, log = _keep(spark), tmp_path / f"log-{uuid.uuid4().hex}"
    log.mkdir()
    c = flows.Corpus(spark.createDataFrame(DOCS, "doc_id long, contents string"), keep)
    gold = spark.createDataFrame([], "index long, ord long, doc_id long, evidence string")
    return keep, c, gold, Logged(threshold=threshold, log=str(log)), log


def facts():
    out = []
    for index, last in enumerate(["carried salt", "sank at dawn yesterday", "is a city"]):
        defs = ["the yard that built it", "the ship of (ENT1)", "a port"]
        out += [(index, "definition", k, f"(ENT{k + 1}) [SEP] is [SEP] {x}") for k, x in enumerate(defs)]
        out += [(index, "relation", 0, "(ENT1) [SEP] built [SEP] (ENT2)"), (index, "relation", 1, f"(ENT2) [SEP] {last.split()[0]} [SEP] {' '.join(last.split()[1:])}"), (index, "relation", 2, "(ENT3) [SEP] took [SEP] (ENT2)")]
    return [*out, (3, "relation", 0, "Oslo [SEP] is [SEP] a city")]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.99])
def test_waves_equal_asking_everything(spark, tmp_path, threshold):
    keep, c, gold, model, log = world(spark, tmp_path, threshold)
    config = tables.EngineConfig(path_limit=4)
    rows = spark.createDataFrame(facts(), COLS)
    samples = spark.createDataFrame([(k, "Who owned the Marigold?", "Ann Lee", 2) for k in range(5)], "index long, question string, answer string, num_hops int")
    got = {r["index"]: r for r in flows.graph_check(samples, rows, c, gold, model, config, keep).collect()}
    asked = prompts(log)
    # everything: all paths filled in, all claims verified, then the paths up to the first that is supported
    defs = flows.triples.definitions(rows.where("kind = 'definition'"))
    paths = keep(flows.G.valid_paths(rows, defs, 4, config.seed).select("index", "path_index", "path"))
    lone = spark.createDataFrame([(3, 0, []), (4, 0, [])], "index long, path_index int, path array<string>")
    paths = paths.unionByName(lone)
    quiet = models.StubBackend(threshold=threshold)
    filled, steps = flows.infill_paths(paths, rows, c, gold, quiet, config, keep)
    claims = keep(filled.select("index", "path_index", T.sentence(F.col("triple")).alias("claim")))
    each = keep(claims.select("index", "claim").distinct().withColumn("qid", F.xxhash64("index", "claim")))
    held = keep(each.join(flows.verify_claims(each, c, gold, quiet, config, keep), "qid").select("index", "claim", "supported"))
    verdicts = verification.path_verdicts(claims.join(held, ["index", "claim"]), paths)
    infill = steps.groupBy("index", "path_index").agg(F.max_by("confidence", "infilling_index").alias("infill"))
    seen = keep(verification.visited(verdicts.join(infill, ["index", "path_index"], "left").withColumn("infill", F.coalesce("infill", F.lit(0.0)))))
    want = {r["index"]: r for r in verification.best_path(seen, "infill").collect()}
    assert set(got) == set(range(5)) == set(want)
    for i, r in got.items():
        for name in want[i].__fields__:
            assert r[name] == want[i][name], (i, name)
    # what was asked: prefixes and claims of visited paths, each once, and one answer a sample
    visited = {(r["index"], r.path_index) for r in seen.collect()}
    all_paths = {(r["index"], r.path_index): r.path for r in paths.collect()}
    prefixes = {(i, tuple(all_paths[i, k][:n])) for i, k in visited for n in range(1, len(all_paths[i, k]) + 1)}
    told = {(r["index"], r.claim) for r in claims.collect() if (r["index"], r.path_index) in visited}
    count = lambda mark: sum(mark in p for p in asked)
    distinct_claims = count("true or false")
    assert len(asked) == len(set(asked)) or threshold < 1  # equal prompts of two waves may come twice
    assert count("Replace the blank") <= len(prefixes) and distinct_claims <= len(told)
    searched = {(r["index"], r.ent, r.search, r["query"]) for r in steps.collect() if (r["index"], r.path_index) in visited}
    assert count("Replace the blank") <= len(searched)
    if threshold == 0.3:  # first paths are supported: nothing of a second one is asked
        assert {k for i, k in visited if i < 3} == {0} or len(visited) < len(all_paths)


@pytest.mark.parametrize("level", ["each", "concat+each"])
def test_documents_up_to_the_first_that_supports(spark, tmp_path, level):
    keep, c, gold, model, log = world(spark, tmp_path, 0.9)
    config = tables.EngineConfig(document_level=level, top_k=4)
    claims = spark.createDataFrame([(1, 1, "The Marigold carried salt"), (2, 1, "Oslo sank at dawn"), (3, 2, "Salt sold in Oslo by Kerr Yard")], "qid long, index long, claim string")
    got = {r.qid: r for r in flows.verify_claims(claims, c, gold, model, config, keep).collect()}
    asked = [p for p in prompts(log) if "true or false" in p]
    rows = c.assembled(claims.select("qid", "index", F.col("claim").alias("query")), gold, config).collect()
    plain, calls = models.StubBackend(threshold=0.9), 0
    for q, _, claim in [tuple(r) for r in claims.collect()]:
        texts = [r.evidence for r in sorted((r for r in rows if r.qid == q), key=lambda r: r.pos)]
        ask = lambda e, claim=claim: plain.generate([models.TEMPLATES["verify"].replace("<<evidence>>", e).replace("<<claim>>", claim)])[0][0] == "true"
        done = False
        if level == "concat+each":
            calls += 1
            done = ask("\n".join(texts))
        for e in itertools.chain(texts if not done else ()):
            calls += 1
            done = ask(e)
            if done:
                break
        assert got[q].supported == done
    assert len(asked) == calls


def test_thoughts_last(spark, tmp_path):
    """A second run asks nothing that the memo knows; it reads the wanted buckets alone."""
    keep, _, _, model, log = world(spark, tmp_path, 0.5)
    memo = tables.MemoTable(spark, str(tmp_path / "memo"), buckets=8)
    rows = spark.createDataFrame([(f"p{k}",) for k in range(40)], "prompt string")
    first = {r.prompt: r.value for r in flows.remembered(rows, memo, model, keep).collect()}
    assert len(first) == 40 == len(prompts(log))
    again = flows.remembered(rows.union(rows), memo, model, keep)
    assert {r.prompt: r.value for r in again.collect()} == first and len(prompts(log)) == 40
    memo.append(spark.createDataFrame([("p1", "newer"), ("p2", "a")], tables.MEMO))
    memo.compact()
    memo.append(spark.createDataFrame([("p2", "0 later")], tables.MEMO))
    assert {r.prompt: r.value for r in memo.read().collect()} == first | {"p1": "newer", "p2": "0 later"}
    known = memo.lookup(rows.where("prompt in ('p1', 'p2')"))
    assert {tuple(r) for r in known.collect()} == {("p1", "newer"), ("p2", "0 later")}
    files = {Path(f).parent.name for f in known.inputFiles()}
    plan = known._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and len(files) <= 8
