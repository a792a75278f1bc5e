"""Triple tables: parsing, repair, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def parse(triples: DataFrame) -> DataFrame:
    """(index, pos, triple, ...) -> and elements, sentence, ents; unparsable rows go (P5)."""
    return triples.withColumn("elements", T.elements(F.col("triple"))).where("elements is not null").withColumns({"sentence": F.array_join("elements", " "), "ents": T.entities(F.col("triple"))})


def definitions(triples: DataFrame) -> DataFrame:
    """Definition triples -> (index, ent, ord, definition, sentence): the last definition of an entity, at its first place."""
    parsed = parse(triples).select("index", "pos", F.get("elements", F.lit(0)).alias("ent"), T.definition(F.col("triple")).alias("definition"), "sentence")
    return parsed.groupBy("index", "ent").agg(F.min("pos").alias("ord"), F.max_by("definition", "pos").alias("definition"), F.max_by("sentence", "pos").alias("sentence"))


def open_definitions(triples: DataFrame) -> DataFrame:
    """Of definition rows those whose first word still holds an entity; others are filled in."""
    return triples.where((F.col("kind") != "definition") | T.has_entity(F.get(F.split(T.squeeze(F.col("triple")), " "), F.lit(0))))


def split_kinds(triples: DataFrame) -> DataFrame:
    """kind = definition or relation, by shape."""
    return triples.withColumn("kind", F.when(T.is_definition(F.col("triple")), "definition").otherwise("relation"))


def repair(samples: DataFrame, defs: str = "cot_def_triples", rels: str = "cot_triples") -> DataFrame:
    """K4 on array columns: both lists together, split anew by shape. changed: K5."""
    both = F.concat(F.coalesce(defs, F.array().cast("array<string>")), F.coalesce(rels, F.array().cast("array<string>")))
    out = samples.withColumns({"d__": F.filter(both, T.is_definition), "r__": F.filter(both, lambda t: ~T.is_definition(t))})
    return out.withColumn("changed", ~(F.col("d__").eqNullSafe(F.col(defs)) & F.col("r__").eqNullSafe(F.col(rels)))).withColumns({defs: F.col("d__"), rels: F.col("r__")}).drop("d__", "r__")


def compare(graphs: DataFrame, left: str, right: str, keys: tuple[str, ...] = ("index",)) -> DataFrame:
    """U1 on a long table (index, source, triple): sets of normalised triples of two sources.

    One aggregate over (index, triple) and one over index; no arrays are gathered.
    """
    norm = graphs.where(F.col("source").isin(left, right)).select(*keys, "source", T.normal_triple(F.col("triple")).alias("t"), T.entities(F.col("triple")).alias("ents"))
    side = norm.groupBy(*keys, "t").agg(F.max((F.col("source") == left).cast("int")).alias("l"), F.max((F.col("source") == right).cast("int")).alias("r"))
    n = side.groupBy(*keys).agg(F.sum(F.col("l") * F.col("r")).alias("overlap"), F.sum("l").alias("n_self"), F.sum("r").alias("n_other"))
    p, r = T.safe_ratio(F.col("overlap"), F.col("n_self")), T.safe_ratio(F.col("overlap"), F.col("n_other"))
    out = n.withColumns({"self_only": F.col("n_self") - F.col("overlap"), "other_only": F.col("n_other") - F.col("overlap"), "precision": p, "recall": r})
    return out.withColumn("f1", T.harmonic(F.col("precision"), F.col("recall")))


def compare_arrays(left, right) -> dict:
    """U1 per row, for two array columns: overlap, only-left, only-right and shared entity names (Q27: names, not meanings) as columns."""
    a, b = (F.array_distinct(F.transform(x, T.normal_triple)) for x in (left, right))
    names = lambda x: F.array_distinct(F.flatten(F.transform(x, T.entities)))
    return {"overlap": F.array_intersect(a, b), "self_only": F.array_except(a, b), "other_only": F.array_except(b, a), "entity_overlap": F.array_intersect(names(left), names(right))}


def united(parts: DataFrame) -> DataFrame:
    """Triples of several documents as one graph, ordered by document, then place; repeats stay."""
    return parts.groupBy("index").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_pos", "pos", "triple"))), lambda x: x["triple"]).alias("triples"))
