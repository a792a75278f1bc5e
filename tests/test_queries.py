"""Every query of the engine against its SQL; those without SQL give rows."""

import pytest

from graphloom.plans import more_queries, queries

QUERIES = queries.QUERIES | more_queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | more_queries.ORACLE_SQL

from .conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(compare, name):
    compare(QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_q_pipeline_long_lines(spark, monkeypatch):
    """A line's triple holds all its words, however many."""
    seen, words = [], [f"w{k}" for k in range(300)]
    done = spark.createDataFrame([], "index long, prediction string, best_path_index long, best_path_confidence double, predicted_answer string, em_score double, f1_score double")
    samples = spark.createDataFrame([(1, " ".join(words))], "index long, question string")
    monkeypatch.setattr(queries, "_run", lambda *a: (None, None, None, samples))
    monkeypatch.setattr(queries.flows, "graph_check", lambda s, facts, *a: seen.append(facts) or done)
    queries.q_pipeline(spark, None)
    assert [r.triple for r in seen[0].where("kind = 'relation'").collect()] == ["(ENT1) [SEP] w1 [SEP] " + " ".join(words[2:])]


def test_q_cut_at_stops_in_texts(spark, compare, tmp_path):
    """Texts that hold stop sequences themselves, as four of sf0.1 do."""
    import shutil

    shutil.copytree(SF, d := tmp_path / "sf")
    texts = ["the last one", "a </search> b </answer> c", "", None, "läst 𝄞 last", "plain"]
    rows = spark.createDataFrame([(k // 2, k % 2, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    rows.toPandas().to_parquet(d / "conversations.parquet")
    compare(more_queries.q_cut_at, ORACLE_SQL["q_cut_at"], str(d))
