"""Operator 9: URL filter by a cascade of Bloom filters. DataFrame functions only.

Level 1 encodes the listed keys, level 2 the unlisted keys of the corpus that
level 1 lets through by mistake, level 3 the listed keys that level 2 lets
through, and so on until a level makes no mistake on the corpus's complete key
universe. A key's first level that rejects it decides: exact membership for every
key of the corpus, by bit tests on literals, without a join of the pages.

The bits of a level are a binary literal of at most MAX_BYTES; the level's key
count is checked before its filter is made, and beyond the bound the filter
raises, for the list must then be split by key hash (see cascade()).

Defined results: a null url, or one without ://, has empty host and path, fits no
rule and is allowed. Repeated rows give repeated rows; null keys are never listed.
Columns named host, path, rule and verdict are replaced, others are passed on.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Scratch, table

#: (host suffix, path prefix, verdict): fixed values of the query
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: A host is listed if one of its labels is one of these (fixed values of the query)
LISTED_LABELS = ("cheap-pills", "spam-farm", "casino-win", "free-download")
BITS_PER_KEY = 10
HASHES = 5
MAX_BYTES = 64 << 20
#: Each byte of a filter holds six bits, so that it is an ASCII character.
CELL = 6


def host(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.char_length(rest) + F.lit(4))
    ok = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    return F.when(ok, F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.char_length(rest) + F.lit(4))
    ok = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    return F.when(ok, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule (host and path together) that fits; null if none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0], r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _place(key: Column, level: int, i: int, bits: int) -> Column:
    """Double hashing: place i of the key at this level."""
    one, two = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    return F.pmod(F.pmod(one, F.lit(bits)) + F.lit(i) * F.pmod(two, F.lit(bits)), F.lit(bits))


def _filter(keys: DataFrame, level: int, n: int) -> tuple[bytes, int]:
    """The level's bits, aggregated by cell on the executors."""
    cells = max(8, math.ceil(n * BITS_PER_KEY / CELL))
    if cells > MAX_BYTES:
        raise ValueError(f"a level of {n} keys needs {cells} bytes; the bound is {MAX_BYTES}: split the list by key hash")
    bits = cells * CELL
    places = keys.select(F.explode(F.array(*[_place(F.col("key"), level, i, bits) for i in range(HASHES)])).alias("p"))
    got = places.groupBy(F.floor(F.col("p") / CELL).alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.pmod("p", F.lit(CELL)).cast("int"))).alias("v"))
    out = bytearray(b"0" * cells)  # "0" stands for no bit set
    for r in got.toLocalIterator():  # at most `cells` rows
        out[r["cell"]] = 48 + r["v"]
    return bytes(out), bits


def passes(key: Column, level: int, cells: bytes, bits: int) -> Column:
    """Does the level's filter hold the key? Bit tests on a binary literal."""
    whole, out = F.lit(bytearray(cells)), F.lit(True)
    for i in range(HASHES):
        p = _place(key, level, i, bits)
        cell = F.ascii(F.substring(whole, F.floor(p / CELL).cast("int") + 1, F.lit(1)).cast("string")) - 48
        out = out & (F.bit_get(cell, F.pmod(p, F.lit(CELL)).cast("int")) == 1)
    return out


def cascade(universe: DataFrame, listed: DataFrame, max_levels: int = 40) -> list[tuple[bytes, int]]:
    with Scratch(universe.sparkSession, tidy=False) as s:  # a filter's cells come by toLocalIterator
        return _cascade(universe, listed, max_levels, s)


def _cascade(universe: DataFrame, listed: DataFrame, max_levels: int, s: Scratch) -> list[tuple[bytes, int]]:
    """Filters by level for the listed keys over a universe; both are DataFrames of one column, key.

    Every level after the first holds only the mistakes of the level before, a few
    hundredths of its keys, so the sizes fall geometrically.
    """
    all_keys = universe.where("key is not null").distinct()
    marked = s.keep(all_keys.join(listed.where("key is not null").distinct().withColumn("listed", F.lit(True)), "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")))
    levels: list[tuple[bytes, int]] = []
    left = marked
    while len(levels) < max_levels:
        side = len(levels) % 2 == 0  # odd levels (the first, third, ...) encode listed keys
        keys = left.where(F.col("listed") == side)
        if not (n := keys.count()):
            return levels
        levels.append(_filter(keys, len(levels), n))
        # those of the other side that pass by mistake go on, with this level's own keys
        left = s.keep(left.where((F.col("listed") == side) | passes(F.col("key"), len(levels) - 1, *levels[-1])))
    raise ValueError("the cascade did not end: two keys of equal hash")


def member(key: Column, levels: list[tuple[bytes, int]]) -> Column:
    """Exact membership for keys of the universe."""
    out = F.lit(len(levels) % 2 == 1)  # passed every level: the last level's side
    for level in reversed(range(len(levels))):
        out = F.when(~passes(key, level, *levels[level]), F.lit(level % 2 == 1)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages and the columns host, path, rule, verdict; listed: DataFrame of host keys."""
    parts = pages.withColumns({"host": host(F.col("url").cast("string")), "path": path(F.col("url").cast("string"))})
    levels = cascade(parts.select(F.col("host").alias("key")), listed)
    hit = rule(F.col("host"), F.col("path"), rules)
    other = F.when(member(F.col("host"), levels), "block").otherwise("allow")
    return parts.withColumn("hit__", hit).withColumns({"rule": F.col("hit__.rule"), "verdict": F.coalesce(F.col("hit__.verdict"), other)}).drop("hit__")


def listed_hosts(hosts: DataFrame) -> DataFrame:
    """The query's list: hosts of which a label is in LISTED_LABELS."""
    return hosts.where(F.arrays_overlap(F.split("key", r"\."), F.array(*map(F.lit, LISTED_LABELS)))).distinct()


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    hosts = pages.select(host(F.col("url")).alias("key")).distinct()
    return judge(pages, listed_hosts(hosts)).select("page_id", "host", "path", "rule", "verdict")


_LABELS = "|".join(LISTED_LABELS)
OP9_SQL = f"""
with a as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
b as (select page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from a),
c as (select *, case
 when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
 when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
 when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
 when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
 when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule from b)
select page_id, host, path, rule, case when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block' when rule is not null then 'allow'
 when regexp_matches(host, '(^|\\.)({_LABELS})(\\.|$)') then 'block' else 'allow' end as verdict from c
"""
