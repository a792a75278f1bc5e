"""Row selection: resume, completeness, sampling, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_index(rows: DataFrame, wanted: DataFrame, key: str = "index") -> DataFrame:
    """Rows whose key is wanted."""
    return rows.join(wanted.select(key), key, "left_semi")


def with_hops(rows: DataFrame, hops: int) -> DataFrame:
    """P2"""
    return rows.where(F.col("num_hops") == hops)


def progress(samples: DataFrame, done: DataFrame, key: str = "index") -> DataFrame:
    """One row: samples in all, those that are done, those that remain."""
    have = done.select(F.col(key).alias(key), F.lit(1).alias("d__")).distinct()
    return samples.select(key).join(have, key, "left").agg(F.count("*").alias("total"), F.count("d__").alias("existing"), (F.count("*") - F.count("d__")).alias("remaining"))


def cached_by_start(paths: DataFrame, found: DataFrame) -> DataFrame:
    """Paths (index, path_index, path) with what was retrieved for their start entity; found: (index, ent, ...). Q9:
    a start that nothing was retrieved for gives nulls."""
    return paths.withColumn("ent", F.get("path", F.lit(0))).join(found, ["index", "ent"], "left").withColumnRenamed("ent", "start")


def remaining(samples: DataFrame, done: DataFrame, key: str = "index") -> DataFrame:
    """Samples that aren't done."""
    return samples.join(done.select(key).distinct(), key, "left_anti")


def complete(want: DataFrame, have: DataFrame, key: str = "index") -> bool:
    """S6"""
    return remaining(want, have, key).isEmpty()


def with_memo(prompts: DataFrame, memo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their value, distinct missing prompts); memo: (prompt, value), of repeated prompts the last by value."""
    known = memo.groupBy("prompt").agg(F.max("value").alias("value"))
    return prompts.join(known, "prompt"), prompts.select("prompt").distinct().join(known, "prompt", "left_anti")


def uniform_sample(rows: DataFrame, n: int, by: Column) -> DataFrame:
    """K1: exactly n rows, the first in the order of `by`."""
    return rows.orderBy(by).limit(n)


def stratified_sample(rows: DataFrame, sizes: dict[int, int], stratum: str, by: Column) -> DataFrame:
    """K2: exactly sizes[s] rows of each stratum. Rows of each stratum are cut to that many by a window top-k,
    which Spark limits within each task before the shuffle."""
    n = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    wanted = rows.where(F.col(stratum).isin(*sizes))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(by))
    return wanted.withColumn("r__", rank).where(F.col("r__") <= max(sizes.values())).where(F.col("r__") <= F.element_at(n, F.col(stratum))).drop("r__")


def complement(rows: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """J10, K3"""
    return rows.join(sample.select(key), key, "left_anti")


def reindex(rows: DataFrame, order: str, name: str = "index") -> DataFrame:
    """Places from 0 in the order of a unique column: rows are dealt to ranges of the column, counted by range,
    and numbered inside; no single task sorts all rows. The ranges are bounds on the driver, so both uses agree."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(rows.approxQuantile(order, [i / n for i in range(1, n)], 0.001)))  # at most n numbers
    ranged = rows.withColumn("p__", sum((F.when(F.col(order) > F.lit(x), 1).otherwise(0) for x in bounds), F.lit(0)))
    counts = ranged.groupBy("p__").agg(F.count("*").alias("n__"))
    before = counts.withColumn("o__", F.coalesce(F.sum("n__").over(Window.orderBy("p__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("p__", "o__")
    k = F.row_number().over(Window.partitionBy("p__").orderBy(order))
    return ranged.withColumn("k__", k).join(F.broadcast(before), "p__").withColumn(name, F.col("o__") + F.col("k__") - 1).drop("p__", "k__", "o__")


def first_rows(rows: DataFrame, n: int | None, order: str = "index") -> DataFrame:
    """P3; None: all."""
    return rows if n is None else rows.orderBy(order).limit(n)


#: The projection of a checked sample
CHECKED = ("index", "uid", "num_hops", "question", "answer", "gold_id_list", "gold_evidence_list", "definition_triples", "triples")
EMPTY = {"prediction": "string", "best_path_index": "int", "best_path_confidence": "double", "best_path_infilling_confidence": "double", "best_infilling_conf_path_index": "int", "best_infilling_conf_path_confidence": "double"}


def checked_projection(samples: DataFrame) -> DataFrame:
    return samples.select(*CHECKED, *[F.lit(None).cast(kind).alias(c) for c, kind in EMPTY.items()])


def fallback(rows: DataFrame, status: str = "status") -> DataFrame:
    """K6: rows whose status isn't ok: empty answer, zero scores, null verdict."""
    bad = F.col(status) != "ok"
    blank = {"predicted_answer": F.lit(""), "em_score": F.lit(0), "f1_score": F.lit(0.0), "prediction": F.lit(None).cast("string")}
    return rows.withColumns({c: F.when(bad, v).otherwise(F.col(c)) for c, v in blank.items() if c in rows.columns})


def with_question(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a question, and the others, which are passed on as they are."""
    asked = F.coalesce(F.col("question"), F.lit("")) != ""
    return samples.where(asked), samples.where(~asked)


def stringified(c: str) -> Column:
    """A struct as map<string, string>."""
    return F.from_json(F.to_json(F.col(c)), "map<string,string>")
