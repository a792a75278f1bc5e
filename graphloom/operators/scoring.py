"""Answer scoring and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def score(preds: DataFrame, pred: str = "predicted_answer", answer: str = "answer", aliases: str | None = None) -> DataFrame:
    """em_score and f1_score, the best over the answer and its aliases. Every text is normalised once: tokens are columns."""
    golds = F.array(F.col(answer))
    if aliases:
        golds = F.concat(golds, F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    read = preds.withColumns({"p__": T.tokens(F.col(pred)), "g__": F.transform(golds, T.tokens)})
    read = read.withColumns({"p__": F.struct(F.array_join("p__", " ").alias("text"), T.numbered(F.col("p__")).alias("w")), "g__": F.transform("g__", lambda g: F.struct(F.array_join(g, " ").alias("text"), T.numbered(g).alias("w")))})
    em = T.let(F.col("p__"), lambda p: F.array_max(F.transform("g__", lambda g: (g["text"] == p["text"]).cast("int"))))
    f1 = T.let(F.col("p__"), lambda p: F.array_max(F.transform("g__", lambda g: T.tokens_f1(p["w"], g["w"]))))
    return read.withColumns({"em_score": em, "f1_score": f1}).drop("p__", "g__")


def by_hop(scored: DataFrame) -> DataFrame:
    """(hops string, n, em, f1): means by num_hops and in total; null scores count as 0. One partial aggregate."""
    filled = scored.select("num_hops", F.coalesce(F.col("em_score").cast("double"), F.lit(0.0)).alias("e"), F.coalesce("f1_score", F.lit(0.0)).alias("f"))
    sums = filled.groupingSets([["num_hops"], []], "num_hops").agg(F.grouping("num_hops").alias("g"), F.count("*").alias("n"), F.avg("e").alias("em"), F.avg("f").alias("f1"))
    return sums.where("g = 0 or n > 0").select(F.when(F.col("g") == 1, "total").otherwise(F.col("num_hops").cast("string")).alias("hops"), "n", "em", "f1")


def fixed_hops(scored: DataFrame, hops: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """A2: total and the named hop counts; 0 where there is no row."""
    spark = scored.sparkSession
    frame = spark.createDataFrame([("total",), *((str(h),) for h in hops)], "hops string")
    return frame.join(F.broadcast(by_hop(scored)), "hops", "left").select("hops", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("em", F.lit(0.0)).alias("em"), F.coalesce("f1", F.lit(0.0)).alias("f1"))


def metric_lines(rolled: DataFrame) -> DataFrame:
    """Report lines in the order of the hop string."""
    three = T.three_places()
    return rolled.orderBy("hops").select(F.concat(F.lit("Hops: "), "hops", F.lit(", EM: "), three(F.col("em")), F.lit(", F1: "), three(F.col("f1"))).alias("value"))


def metric_json(rolled: DataFrame) -> DataFrame:
    """One JSON object per row of the roll-up, three decimals as in S7."""
    three = T.three_places()
    return rolled.select(F.to_json(F.struct("hops", three(F.col("em")).cast("double").alias("em"), three(F.col("f1")).cast("double").alias("f1"))).alias("value"))


def average_comparison(compared: DataFrame) -> DataFrame:
    """Mean precision, recall and F1 by pairing over the rows that could be compared."""
    return compared.where("precision is not null").groupBy("pairing").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
