"""Latent-entity graphs: mentions, adjacency, resolution orders.

Tables: defs (index, ent, ord, definition), triples (index, pos, kind, triple).
A graph's entities are few; graphs are many. Joins are on index, so all steps of a
graph stay in one partition's key range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def mentions(triples: DataFrame, defs: DataFrame) -> DataFrame:
    """(index, kind, pos, ent, defined)"""
    ents = triples.select("index", "kind", "pos", F.explode(T.entities(F.col("triple"))).alias("ent"))
    return ents.join(defs.select("index", "ent", F.lit(True).alias("d__")), ["index", "ent"], "left").select("index", "kind", "pos", "ent", F.coalesce("d__", F.lit(False)).alias("defined"))


def undefined_flag(triples: DataFrame, defs: DataFrame) -> DataFrame:
    return mentions(triples, defs).groupBy("index").agg(F.bool_or(~F.col("defined")).alias("has_undefined"))


def by_mention_count(triples: DataFrame) -> DataFrame:
    """A13"""
    return triples.groupBy("index", F.size(T.entities(F.col("triple"))).alias("n_ents")).agg(F.count("*").alias("n"))


def adjacency(triples: DataFrame, defs: DataFrame) -> DataFrame:
    """(index, a, b): ordinals of defined entities that some triple holds together, a < b.

    Pairs are formed inside each triple's own array, not by a self-join."""
    names = defs.groupBy("index").agg(F.map_from_entries(F.collect_list(F.struct("ent", "ord"))).alias("m"))
    own = triples.select("index", T.entities(F.col("triple")).alias("e")).where("size(e) > 1").join(names, "index")
    places = own.select("index", F.array_sort(F.filter(F.transform("e", lambda x: F.try_element_at("m", x)), lambda x: x.isNotNull())).alias("o"))
    pairs = places.select("index", F.explode(F.flatten(F.transform("o", lambda a: F.transform(F.filter("o", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("x"))
    return pairs.select("index", "x.a", "x.b").distinct()


def _ranked(defs: DataFrame) -> DataFrame:
    return defs.select("index", "ent", (F.row_number().over(Window.partitionBy("index").orderBy("ord", "ent")) - 1).alias("r"), "ord")


#: Entities that a bit set holds.
MOST_ENTITIES = 63


def _bit(k):
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), k.cast("int"))


def _has(bits, k):
    return bits.bitwiseAND(_bit(k)) != 0


def _order(edges, n):
    """Entities 0..n-1 in the smallest order that obeys the edges (f before t), which have no cycle: the set of those that come
    before each, as bits, against the set of those that are placed."""
    every = F.sequence(F.lit(0), n - 1)
    before = F.transform(every, lambda e: F.aggregate(F.filter(edges, lambda x: x["t"] == e), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(_bit(x["f"]))))

    def step(s, _):
        free = F.filter(every, lambda e: ~_has(s["placed"], e) & (s["before"][e].bitwiseAND(F.bitwise_not(s["placed"])) == 0))
        one = F.get(free, F.lit(0))
        return F.struct(F.concat(s["order"], F.array(one)).alias("order"), s["placed"].bitwiseOR(_bit(one)).alias("placed"), s["before"].alias("before"))

    start = F.struct(F.array().cast("array<int>").alias("order"), F.lit(0).cast("bigint").alias("placed"), before.alias("before"))
    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["order"])


def valid_paths(triples: DataFrame, defs: DataFrame, limit: int = 5, seed: int | None = None) -> DataFrame:
    """(index, path_index, path): for each acyclic orientation of the adjacent pairs the
    first order that obeys it, orientations in the order of their bits, at most `limit`.

    All inside a graph's row. Pairs are oriented one after the other and only the first `limit` acyclic beginnings are
    kept: each of them can be completed, so later ones aren't needed. A beginning carries what each entity reaches as a set of
    bits: an edge closes a cycle if its end reaches its start (one AND), and is taken up by an OR into those that reach its
    start. The smallest topological order of an orientation is its first permutation. seed: G7, where there are more
    orientations than `limit` they come in another order: a hash of (seed, index, pair) turns each pair's two directions
    round or not. A graph of over 63 entities is an error.
    """
    ents = _ranked(defs).groupBy("index").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "ent", "ord"))), lambda x: x["ent"]).alias("ents"), F.map_from_entries(F.collect_list(F.struct("ord", "r"))).alias("rank"))
    pairs = adjacency(triples, defs).groupBy("index").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("pairs"))
    edge = "struct<f: int, t: int>"
    ranks = F.coalesce(F.transform("pairs", lambda x: F.struct(F.element_at("rank", x["a"]).alias("f"), F.element_at("rank", x["b"]).alias("t"))), F.array().cast(f"array<{edge}>"))
    few = F.when(F.size("ents") <= MOST_ENTITIES, F.size("ents")).otherwise(F.raise_error(F.lit(f"a graph has over {MOST_ENTITIES} entities")).cast("int"))
    rows = ents.join(pairs, "index", "left").select("index", "ents", few.alias("n"), ranks.alias("pairs"))
    back = lambda p: F.struct(p["t"].alias("f"), p["f"].alias("t"))
    if seed is not None:
        turned = lambda p, k: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("index").cast("string"), k.cast("string"))), 1, 1), 16, 10).cast("int") % 2 == 1) & (F.pow(F.lit(2.0), F.size("pairs")) > limit)
        rows = rows.withColumn("pairs", F.transform("pairs", lambda p, k: F.when(turned(p, k), back(p)).otherwise(p)))

    def extended(o, p):
        more = o["reach"][p["t"]].bitwiseOR(_bit(p["t"]))
        reach = F.transform(o["reach"], lambda r, i: F.when((i == p["f"]) | _has(r, p["f"]), r.bitwiseOR(more)).otherwise(r))
        return F.struct(F.concat(o["edges"], F.array(p)).alias("edges"), reach.alias("reach"))

    def grown(some, p):
        both = F.transform(some, lambda o: F.filter(F.array(p, back(p)), lambda e: ~_has(o["reach"][e["t"]], e["f"])))
        return F.slice(F.flatten(F.zip_with(some, both, lambda o, es: F.transform(es, lambda e: extended(o, e)))), 1, limit)

    none = F.struct(F.array().cast(f"array<{edge}>").alias("edges"), F.transform(F.sequence(F.lit(1), F.col("n")), lambda _: F.lit(0).cast("bigint")).alias("reach"))
    found = rows.withColumn("oriented", F.aggregate("pairs", F.array(none), grown))
    orders = F.transform("oriented", lambda o: F.transform(_order(o["edges"], F.col("n")), lambda i: F.get("ents", i)))
    return found.select("index", F.posexplode(orders).alias("path_index", "path"))


def varied_paths(triples: DataFrame, defs: DataFrame, limit: int = 5, seed: int | None = None) -> DataFrame:
    """Paths by turns from each start entity, in the order in which starts are first seen."""
    many = valid_paths(triples, defs, min(10 * limit, 1000), seed).withColumn("start", F.get("path", F.lit(0)))
    own = Window.partitionBy("index", "start")
    ranked = many.withColumns({"turn": F.row_number().over(own.orderBy("path_index")), "seen": F.min("path_index").over(own)})
    k = F.row_number().over(Window.partitionBy("index").orderBy("turn", "seen")) - 1
    return ranked.withColumn("path_index", k).where(F.col("path_index") < limit).select("index", "path_index", "path", "start")


def retrieval_query(triples: DataFrame, defs: DataFrame) -> DataFrame:
    """(index, ent, query): the sentences about an entity alone, or else its definition's sentence, with
    definitions put in for entities."""
    rows = _about(triples, defs).withColumn("query", F.when(F.size("lines") > 0, F.array_join("lines", " ")).otherwise(F.concat("sentence", F.lit("."))))
    return rows.select("index", "ent", _resolved("query").alias("query"))


def infill_query(triples: DataFrame, defs: DataFrame, blank: str = "<extra_id_0>") -> DataFrame:
    """The same sentences and that of the definition, if it names no other entity, with the blank for the entity."""
    own = F.concat("sentence", F.lit("."))
    lines = F.when(T.entities(F.col("sentence")) == F.array("ent"), F.concat("lines", F.array(own))).otherwise(F.col("lines"))
    rows = _about(triples, defs).withColumn("lines", lines).withColumn("query", F.replace(F.when(F.size("lines") > 0, F.array_join("lines", " ")).otherwise(own), F.col("ent"), F.lit(blank)))
    return rows.select("index", "ent", _resolved("query").alias("query"))


def agent_query(triples: DataFrame, defs: DataFrame, plain: bool = False) -> DataFrame:
    """The query for the search agent: an entity's first mention as it is defined, later ones with the definite
    article, and the question for it at the end; a sentence that says that something is itself goes (plain: it stays)."""
    rows = _about(triples, defs).withColumn("query", F.when(F.size("lines") > 0, F.array_join("lines", " ")).otherwise(F.concat("sentence", F.lit("."))))

    def mention(first):
        def put(q, x):
            once = x["definition"] if first else T.definite(x["definition"])
            return F.replace(T.replace_first(q, x["ent"], once), x["ent"], T.definite(once))

        return put

    # one round over all definitions; then rounds for entities that definitions named
    rows = rows.withColumn("query", F.when(T.has_entity(F.col("query")), F.aggregate("d", F.col("query"), mention(True))).otherwise(F.col("query")))
    again = F.aggregate(F.sequence(F.lit(1), F.size("d")), F.col("query"), lambda q, _: F.when(T.has_entity(q), F.aggregate("d", q, mention(False))).otherwise(q))
    rows = rows.withColumn("query", F.when(F.col("undefined"), F.col("query")).otherwise(again))
    asked = F.concat("query", F.lit(" What is "), T.definite(F.col("definition")), F.lit("?"))
    return rows.select("index", "ent", (asked if plain else T.strip(F.regexp_replace(asked, r"\b(.+?)\s+is\s+\1\b.", ""))).alias("query"))


def _about(triples: DataFrame, defs: DataFrame) -> DataFrame:
    """P10: defs and lines (sentences that name no entity but this one), d (all definitions), undefined (Q6: some triple
    names an entity without definition)."""
    said = triples.where("kind = 'relation'").select("index", "pos", T.entities(F.col("triple")).alias("e"), T.sentence(F.col("triple")).alias("s")).where("size(e) > 0 and s is not null")
    names = defs.groupBy("index").agg(F.array_sort(F.collect_list(F.struct("ord", "ent", "definition"))).alias("d"))
    alone = said.where("size(e) = 1").groupBy("index", F.get("e", F.lit(0)).alias("ent")).agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("l"))
    flag = undefined_flag(triples.where("kind = 'relation'"), defs).withColumnRenamed("has_undefined", "undefined")
    rows = defs.join(alone, ["index", "ent"], "left").join(names, "index").join(flag, "index", "left")
    lines = F.transform("l", lambda x: F.concat(x["s"], F.lit(".")))
    return rows.select("index", "ent", "definition", "sentence", "d", F.coalesce(lines, F.array().cast("array<string>")).alias("lines"), F.coalesce("undefined", F.lit(False)).alias("undefined"))


def _resolved(query: str):
    """Definitions put in for entities, in their order, again for those that definitions name: as many rounds as there
    are definitions, and one if some entity has none (Q6: it would never end)."""
    put = lambda q: F.aggregate("d", q, lambda a, x: F.replace(a, x["ent"], x["definition"]))
    rounds = F.sequence(F.lit(1), F.when(F.col("undefined"), F.lit(1)).otherwise(F.size("d")))
    return F.aggregate(rounds, F.col(query), lambda q, _: F.when(T.has_entity(q), put(q)).otherwise(q))
