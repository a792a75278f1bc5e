"""Operator 2: quality rules as weak supervision. DataFrame functions only.

Each rule votes one way (drop or keep) or abstains. The votes of all rows are
counted by pattern (at most 2 to the number of rules, whatever the input), and
expectation maximisation over these counts estimates the share of good rows and
how often each rule votes on good and on bad rows (its accuracy), without labels.
A row's posterior probability of being good, given the votes cast on it, then
replaces the demand that it pass every rule; abstaining is no evidence. The
iterations are one SQL expression over the pattern array, evaluated on one row.

Defined results: a null or empty text has no words, every measure 0, and fails the
base rules. Repeated rows give repeated rows, an empty table gives none. Columns of
the names that measures() and judge() add (n_words, votes, kept, ...) are replaced;
other columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Scratch, table

#: Python's re.split characters of a word boundary: space and 0x09 to 0x0D
SPACE = r"[\x20\x09-\x0D]+"
ITERATIONS = 25
#: Starting share of good rows and accuracy of every rule.
GOOD, START = 0.8, 0.85
#: Weight of the starting point in each estimate, as a share of all rows.
SMOOTH = 0.02


def _let(value: Column, f) -> Column:
    """f of a value that is computed once: a lambda variable, not an expression that each use repeats."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def n_repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. Windows are compared
    by a 64-bit hash of their three words; equal hashes are brought together by a
    sort within the row."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.struct(F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        same = lambda x, k: (x["h"] == F.coalesce(F.get(s, k - 1)["h"], F.bitwise_not(x["h"]))) | (x["h"] == F.coalesce(F.get(s, k + 1)["h"], F.bitwise_not(x["h"])))
        places = F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))
        # each place covers three words, less what the next place covers
        return _let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    # most texts repeat no window: then the places aren't looked for
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(windows, lambda w: F.when(F.size(F.array_distinct(F.transform(w, lambda x: x["h"]))) == F.size(w), F.lit(0)).otherwise(_let(F.sort_array(w), covered))))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint), and the flags' inputs."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = _let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), n_repeat_words(w).cast("bigint").alias("n_repeat_words")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    n_chars = F.char_length(text)
    return docs.withColumns({"w__": of_words, "l__": of_lines}).withColumns(
        {
            "n_words": F.col("w__.n_words"),
            "word_chars": F.char_length(F.regexp_replace(text, SPACE, "")).cast("bigint"),
            "n_symbols": (n_chars - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("bigint"),
            "n_dup_lines": F.col("l__.n_dup_lines"),
            "n_repeat_words": F.col("w__.n_repeat_words"),
            "n_lines": F.col("l__.n_lines"),
            "n_upper": (n_chars - F.char_length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("bigint"),
            "n_marks": (n_chars - F.char_length(F.regexp_replace(text, r"[!?]+", ""))).cast("bigint"),
        }
    ).drop("w__", "l__")


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


#: name -> (vote, condition): a rule votes keep (1) or drop (-1) if its condition holds, else it abstains
RULES = {
    "short": (-1, "n_words < 50"),
    "repeats": (-1, "100 * n_repeat_words > 50 * n_words"),
    "lines": (-1, "10 * n_dup_lines > 3 * n_lines"),
    "symbols": (-1, "100 * n_symbols > 20 * n_words"),
    "word_size": (-1, "word_chars < 3 * n_words or word_chars > 10 * n_words"),
    "capitals": (-1, "5 * n_upper > 2 * word_chars"),
    "marks": (-1, "10 * n_marks > n_words"),
    "clean": (1, "n_words >= 50 and 100 * n_symbols <= 5 * n_words and 10 * n_upper <= word_chars and 50 * n_marks <= n_words and 10 * n_dup_lines <= n_lines"),
    "prose": (1, "n_words >= 80 and 100 * n_symbols <= 2 * n_words and 5 * n_repeat_words <= n_words and 10 * n_upper <= word_chars and 3 * n_lines <= n_words"),
}


def votes(rules: dict[str, tuple[int, str]]) -> Column:
    """array<boolean>: did each rule vote?"""
    return F.array(*[F.coalesce(F.expr(cond), F.lit(False)) for _, cond in rules.values()])


def fit(voted: DataFrame, rules: dict[str, tuple[int, str]], iterations: int = ITERATIONS) -> DataFrame:
    """One row, m: struct<good, a array<struct<g, b>>>: the share of good rows; the
    share of good and of bad rows that each rule votes on."""
    patterns = voted.groupBy("votes").count()  # at most 2^rules rows
    one = patterns.agg(F.collect_list(F.struct("votes", F.col("count").cast("double").alias("n"))).alias("p"))
    odds, balance = (1 - START) / START, GOOD / (1 - GOOD)
    rate = lambda g, b: F.struct(F.lit(g).alias("g"), F.lit(b).alias("b"))
    first = [rate(0.2 * odds / balance, 0.2) if way < 0 else rate(0.5, 0.5 * odds * balance) for way, _ in rules.values()]
    start = F.struct(F.lit(GOOD).alias("good"), F.array(*first).alias("a"))
    ks = F.sequence(F.lit(0), F.lit(len(rules) - 1))

    def step(model: Column, _: Column) -> Column:
        weighed = F.transform("p", lambda x: F.struct(x["votes"].alias("votes"), (x["n"] * posterior(x["votes"], model)).alias("g"), x["n"].alias("n")))

        def again(w: Column) -> Column:
            total = lambda f: F.aggregate(w, F.lit(0.0), lambda a, x: a + f(x))
            all_rows = total(lambda x: x["n"])
            held = all_rows * SMOOTH
            good = (total(lambda x: x["g"]) + held * GOOD) / (all_rows + held)

            def rates(k: Column) -> Column:
                begin = F.get(F.array(*first), k)
                share = lambda f, was: (total(lambda x: F.when(F.get(x["votes"], k), f(x)).otherwise(0.0)) + held * was) / (total(f) + held)
                return F.struct(share(lambda x: x["g"], begin["g"]).alias("g"), share(lambda x: x["n"] - x["g"], begin["b"]).alias("b"))

            return F.struct(good.alias("good"), F.transform(ks, rates).alias("a"))

        return _let(weighed, again)

    return one.select(F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step).alias("m"))


def posterior(v: Column, model: Column) -> Column:
    """Probability that a row with these votes is good."""
    one = F.transform(v, lambda x, k: F.when(x, F.log(F.get(model["a"], k)["g"] / F.get(model["a"], k)["b"])).otherwise(0.0))
    z = F.aggregate(one, F.log(model["good"] / (1 - model["good"])), lambda a, x: a + x)
    return 1 / (1 + F.exp(-z))


def judge(measured: DataFrame, rules: dict[str, tuple[int, str]] = RULES) -> DataFrame:
    """Rows with measures -> base_failed, p_good, kept. The model is one row, cross-joined to all."""
    voted = measured.withColumn("votes", votes(rules))
    model = fit(voted, rules).select(F.col("m").alias("m__"))
    bad = F.coalesce(base_failed(), F.lit(True))
    return voted.crossJoin(F.broadcast(model)).withColumn("p_good", posterior(F.col("votes"), F.col("m__"))).withColumns({"base_failed": bad, "kept": ~bad & (F.col("p_good") >= 0.5)}).drop("m__")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as bigint) doc_id", "text")
    with Scratch(spark) as s:
        measured = s.result(measures(docs).drop("text"))  # numbers only: the texts are read once
    return judge(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
