"""Splittable JSON arrays, answers kept by part, fingerprints of runs."""

import json
import random
import uuid
from dataclasses import dataclass
from pathlib import Path

import pytest

from graphloom.sources import json_ranges, models, tables


def odd_rows():
    rng = random.Random(8)
    bits = ['"', "\\", ",", "[", "]", "{", "}", "é", "日", "\n", " ", "a", "\\\\", '\\"', "],[", "}, {"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
    return [{"index": k, "question": text(), "gold_id_list": [text() for _ in range(rng.randrange(4))], "answer": None if k % 5 == 0 else text()} for k in range(60)]


@pytest.mark.parametrize("size", [7, 16, 61, 1000, 1 << 27])
def test_arrays_by_ranges(spark, tmp_path, size):
    rows = odd_rows()
    (tmp_path / "a.json").write_text(json.dumps(rows[:30], ensure_ascii=False))
    (tmp_path / "b.json").write_text("\n " + json.dumps(rows[30:50], indent=2) + " \n")
    (tmp_path / "c.json").write_text(json.dumps(rows[50:51]))
    (tmp_path / "d.json").write_text(" [ ] ")
    (tmp_path / "e.json").write_text(json.dumps(rows[51], ensure_ascii=False))
    (tmp_path / "f.json").write_text("")
    (tmp_path / "g.json").write_text("﻿" + json.dumps(rows[52:], separators=(",", ":")))
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0", "spark.sql.execution.arrow.maxRecordsPerBatch": "5" if size < 100 else "10000"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        df = tables.read_samples(spark, str(tmp_path))
        got = {r["index"]: r for r in df.collect()}
        order = [(r.file[-6], r.number) for r in json_ranges.records(spark, str(tmp_path)).orderBy("file", "number").collect()]
        if size <= 16:
            assert spark.read.option("lineSep", ",").text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got) == list(range(60)) and df.count() == 60
    for want in rows:
        assert {k: got[want["index"]][k] for k in want} == want
    assert order == [("a", k) for k in range(30)] + [("b", k) for k in range(20)] + [("c", 0), ("e", 0)] + [("g", k) for k in range(8)]


@dataclass(frozen=True)
class Dying(models.StubBackend):
    """Writes prompts down; dies at a prompt while a file is there."""

    log: str = ""

    def generate(self, prompts):
        for p in prompts:
            if p == "p33" and Path(self.log, "die").exists():
                raise RuntimeError("lost")
            Path(self.log, uuid.uuid4().hex).write_text(p)
        return [("said " + p, 0.5, "error: x" if p == "p7" else "ok") for p in prompts]


def test_answers_by_part_survive(spark, tmp_path):
    (log := tmp_path / "log").mkdir()
    (log / "die").write_text("")
    asked = lambda: sorted(p.read_text() for p in log.iterdir() if p.name != "die")
    model = models.Stored(inner=Dying(log=str(log)), path=str(tmp_path / "answers"), parts=8)
    rows = spark.createDataFrame([(k, f"p{k % 50}") for k in range(100)] + [(100, None)], "id long, prompt string")
    with pytest.raises(Exception, match="lost"):
        models.generate(rows, model).collect()
    first = asked()
    whole = {r.prompt for r in model._known(spark).collect()}
    assert whole and whole < {f"p{k}" for k in range(50)} and whole <= set(first)
    (log / "die").unlink()
    out = {r.id: (r.text, r.status) for r in models.generate(rows, model).collect()}
    again = asked()
    for p in first:
        again.remove(p)
    # what a part had written is not asked again; all the rest is, once
    assert sorted(again) == sorted({f"p{k}" for k in range(50)} - whole | ({"p7"} & whole))
    assert out[100] == (None, None) and all(out[k] == (f"said p{k % 50}", "error: x" if k % 50 == 7 else "ok") for k in range(100))
    # all is known now, but what failed; another model's answers are its own
    models.generate(rows, model).collect()
    assert len(asked()) == len(first) + len(again) + 1
    assert models.replace(model, max_new_tokens=8).folder() != model.folder() == models.replace(model, parts=3).folder()


def test_fingerprints(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"q{k}") for k in range(20)], "index long, question string")
    one = tables.fingerprint(tables.EngineConfig(), rows)
    assert one == tables.fingerprint(tables.EngineConfig(), rows.orderBy(rows["index"].desc()).select("question", "index").repartition(3))
    other = [tables.fingerprint(tables.EngineConfig(top_k=6), rows), tables.fingerprint(tables.EngineConfig(), rows.where("index > 0")), tables.fingerprint(tables.EngineConfig(), rows.union(rows.limit(1)))]
    assert len({one, *other}) == 4
    root, runs = str(tmp_path / "run"), []
    for _ in range(2):
        keep = tables.Stages(root, one, spark)
        runs.append(keep(rows.withColumn("x", rows["index"] * 0 + len(runs))).select("x").distinct().collect())
    assert runs[0] == runs[1]  # the second run reads what the first has written
    with pytest.raises(ValueError, match="another configuration"):
        tables.Stages(root, other[0], spark)
