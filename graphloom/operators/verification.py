"""Verdicts of claims, paths and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def path_verdicts(claims: DataFrame, paths: DataFrame) -> DataFrame:
    """Claims (index, path_index, supported) -> verdict (all hold; true if none) and supported share (0 if none)."""
    got = claims.groupBy("index", "path_index").agg(F.bool_and("supported").alias("v"), F.avg(F.col("supported").cast("double")).alias("c"))
    return paths.select("index", "path_index").join(got, ["index", "path_index"], "left").select("index", "path_index", F.coalesce("v", F.lit(True)).alias("supported"), F.coalesce("c", F.lit(0.0)).alias("confidence"))


def visited(verdicts: DataFrame) -> DataFrame:
    """Paths up to the first supported one."""
    stop = F.min(F.when(F.col("supported"), F.col("path_index"))).over(Window.partitionBy("index"))
    return verdicts.withColumn("stop__", stop).where("stop__ is null or path_index <= stop__").drop("stop__")


def best_path(seen: DataFrame, infill: str | None = None) -> DataFrame:
    """(index, supported, best_path_index, best_path_confidence); of equal confidences the first path.
    infill: a second confidence to take the best of as well."""
    best = lambda c: F.max_by("path_index", F.struct(F.col(c), -F.col("path_index")))
    more = [best(infill).alias("best_infilling_conf_path_index"), F.max(infill).alias("best_infilling_conf_path_confidence")] if infill else []
    return seen.groupBy("index").agg(F.bool_or("supported").alias("supported"), best("confidence").alias("best_path_index"), F.max("confidence").alias("best_path_confidence"), *more)


def first_supporting(verdicts: DataFrame) -> DataFrame:
    """(claim_id, pos, doc_id, supported, confidence) -> the first document that supports the claim; mean confidence
    of the calls up to it (A11); null if there were none."""
    stop = F.min(F.when(F.col("supported"), F.col("pos"))).over(Window.partitionBy("claim_id"))
    seen = verdicts.withColumn("stop__", stop).where("stop__ is null or pos <= stop__")
    return seen.groupBy("claim_id").agg(F.bool_or("supported").alias("supported"), F.max_by(F.when(F.col("supported"), F.col("doc_id")), "pos").alias("supported_doc_id"), F.avg("confidence").alias("confidence"), F.count("*").alias("calls"))


#: the document id of a verdict on all evidence together (fixed value)
ALL_DOCUMENTS = "[concatenated_documents]"


def tiers(whole: DataFrame, each: DataFrame) -> DataFrame:
    """M5, A11, concat+each: the verdict on all evidence (claim_id, supported, confidence); where that fails, document by
    document (claim_id, pos, doc_id, supported, confidence). confidence is the mean over the calls that were made."""
    failed = each.join(whole.where("not supported").select("claim_id"), "claim_id", "left_semi")
    second = first_supporting(failed).select("claim_id", F.col("supported").alias("s2"), "supported_doc_id", F.col("confidence").alias("c2"), "calls")
    both = whole.join(second, "claim_id", "left")
    own = F.when(F.col("confidence").isNotNull(), 1).otherwise(0)
    mean = (F.coalesce("confidence", F.lit(0.0)) + F.coalesce(F.col("c2") * F.col("calls"), F.lit(0.0))) / F.nullif(own + F.coalesce("calls", F.lit(0)), F.lit(0))
    doc = F.when(F.col("supported"), ALL_DOCUMENTS).otherwise(F.col("supported_doc_id").cast("string"))
    tier = F.when(F.col("supported"), "concat").when(F.col("s2"), "each").otherwise("none")
    return both.select("claim_id", (F.col("supported") | F.coalesce("s2", F.lit(False))).alias("supported"), tier.alias("tier"), doc.alias("supported_doc_id"), mean.alias("confidence"))
