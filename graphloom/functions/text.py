"""Column expressions on answers, triples and generated text. No Python UDF but nfc()."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: token of a latent entity (fixed format)
ENT = r"\(ENT\d+\)"
#: white space as Unicode has it
WS = r"(?U)[\s\x1c-\x1f]+"
#: ASCII punctuation
PUNCT = r"[!-/:-@\[-`{-~]"
SEP, PREP = "[SEP]", "[PREP]"


def squeeze(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, WS, " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def tokens(c: Column) -> Column:
    """tokens of a normalised answer: lower case, no punctuation, no article. Null: none."""
    words = F.split(squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), PUNCT, "")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin("a", "an", "the"))


def normalize_answer(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def exact_match(pred: Column, gold: Column) -> Column:
    """F3"""
    return (normalize_answer(pred) == normalize_answer(gold)).cast("int")


def let(value: Column, f) -> Column:
    """f of a value that is computed once: a lambda variable, not an expression that each use repeats."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def numbered(words: Column) -> Column:
    """Words with the number of their occurrence, sorted: sets of them are multisets of words."""
    return let(F.sort_array(words), lambda s: F.transform(s, lambda w, i: F.concat(w, F.lit(" "), (i - F.array_position(s, w)).cast("string"))))


def tokens_f1(p: Column, g: Column) -> Column:
    """F4, A12 on numbered token arrays: the multisets' intersection is that of the sets."""

    def of(x: Column) -> Column:
        precision, recall = x["n"] / x["p"], x["n"] / x["g"]
        return F.when((x["p"] == 0) | (x["g"] == 0), (x["p"] == x["g"]).cast("double")).when(x["n"] == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))

    return let(F.struct(F.size(F.array_intersect(p, g)).cast("double").alias("n"), F.size(p).alias("p"), F.size(g).alias("g")), of)


def token_f1(pred: Column, gold: Column) -> Column:
    """F4"""
    return tokens_f1(numbered(tokens(pred)), numbered(tokens(gold)))


def best_over(metric, pred: Column, golds: Column) -> Column:
    """A4: the largest value of a metric over an array of answers."""
    return F.array_max(F.transform(golds, lambda g: metric(pred, g)))


def safe_ratio(num: Column, den: Column) -> Column:
    """F19"""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def elements(triple: Column) -> Column:
    """G1: parts of a triple string; null if it has no separator, or nothing but separators."""
    parts = F.filter(F.transform(F.split(triple, r"\[SEP\]|\[PREP\]"), strip), lambda x: x != "")
    return F.when(F.contains(triple, F.lit(SEP)) & (F.size(parts) > 0), parts)


def sentence(triple: Column) -> Column:
    return F.array_join(elements(triple), " ")


def is_definition(triple: Column) -> Column:
    """Definition-shaped triples."""
    return F.startswith(triple, F.lit("(ENT")) & F.contains(triple, F.lit(" [SEP] is [SEP] "))


def defined_entity(triple: Column) -> Column:
    """G2"""
    return F.get(elements(triple), F.lit(0))


def definition(triple: Column) -> Column:
    e = elements(triple)
    return F.when(F.size(e) > 2, F.array_join(F.slice(e, 3, F.greatest(F.size(e), F.lit(1))), " ")).otherwise("")


def entities(c: Column) -> Column:
    """distinct entity tokens in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"({ENT})"), F.lit(1)))


def has_entity(c: Column) -> Column:
    """F6"""
    return F.rlike(c, F.lit(ENT))


def normal_triple(c: Column) -> Column:
    """F9"""
    return squeeze(F.lower(c))


def replace_first(c: Column, old: Column, new: Column) -> Column:
    """F7"""
    at = F.instr(c, old) if isinstance(old, str) else F.call_function("instr", c, old)
    return F.when(at > 0, F.concat(F.substr(c, F.lit(1), at - 1), new, F.substr(c, at + F.length(old)))).otherwise(c)


def definite(c: Column) -> Column:
    """F8: the first 'a ' and the first 'an ' become 'the ', wherever they stand."""
    for article in ("a ", "an "):
        c = replace_first(c, F.lit(article), F.lit("the "))
    return c


def substitute(c: Column, names: Column, values: Column) -> Column:
    """Every name replaced by its value, literally, in order; both arrays of one length."""
    return F.aggregate(F.arrays_zip(names.alias("k"), values.alias("v")), c, lambda a, x: F.replace(a, x["k"], x["v"]))


def last_tag(c: Column, tag: str) -> Column:
    """F10"""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), F.lit(-1))


def all_tags(c: Column, tag: str, glue: str = "\n") -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), glue)


def title_of(passage: Column) -> Column:
    """between '(Title: ' and the first ')'."""
    return F.regexp_extract(passage, r"(?s)\(Title: (.*?)\)", 1)


#: what an answer to a verification may begin with (fixed values)
TRUE_WORDS = ("true", "yes")
FALSE_WORDS = (
    "false",
    "no",
    "it is impossible to say",
    "it's impossible to say",
    "it is impossible to tell",
    "it's impossible to tell",
    "it is not possible to say",
    "it's not possible to say",
    "it is not possible to tell",
    "it's not possible to tell",
)


def boolean_answer(c: Column, key: Column | None = None) -> Column:
    """the first line, lower-cased, without dots and spaces at the ends, by what it begins with (no word of one
    list begins with one of the other); what fits neither is drawn from a hash of `key` (or of the text)."""
    line = F.regexp_replace(F.lower(F.get(F.split(c, "\n"), F.lit(0))), r"^[ .]+|[ .]+$", "")
    begins = lambda words: F.rlike(line, F.lit("^(?:" + "|".join(words) + ")"))
    drawn = F.pmod(F.xxhash64(c if key is None else key), F.lit(2)) == 1
    return F.when(begins(TRUE_WORDS), True).when(begins(FALSE_WORDS), False).otherwise(drawn)


def infill_text(c: Column, fallback: Column) -> Column:
    """the first line without 'blank is '; the fallback if nothing is left."""
    line = strip(F.get(F.split(F.regexp_replace(c, r"(?i)^blank is ", ""), "\n"), F.lit(0)))
    return F.when(F.coalesce(line, F.lit("")) == "", fallback).otherwise(line)


def question_mark(c: Column) -> Column:
    """F15; the empty string stays."""
    t = strip(c)
    return F.when((t == "") | F.endswith(t, F.lit("?")), t).otherwise(F.concat(t, F.lit("?")))


def prompt(template: str, **values: Column) -> Column:
    """F16: <<name>> placeholders replaced literally."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"<<{name}>>"), value)
    return out


def triple_query(triple: Column) -> Column:
    """a triple as words to search for: subject, relation, and the object up to [PREP]. A placeholder object goes,
    and so does a subject that still begins with a bracket; of a placeholder subject the number stays (Q10).
    Strings of fewer than three parts only lose the marks."""
    parts = F.split(triple, r" \[SEP\] ")
    plain = lambda x: F.replace(F.replace(x, F.lit("(ENT"), F.lit("")), F.lit(")"), F.lit(""))
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    subject, relation, obj = strip(plain(at(0))), strip(at(1)), strip(F.substring_index(at(2), PREP, 1))
    marked = lambda x: F.startswith(x, F.lit("ENT")) | F.startswith(x, F.lit("("))
    three = F.when(marked(subject), F.concat_ws(" ", relation, obj)).when(marked(obj), F.concat_ws(" ", subject, relation)).otherwise(F.concat_ws(" ", subject, relation, obj))
    few = plain(F.replace(triple, F.lit(SEP), F.lit(" ")))
    return F.when(~F.contains(triple, F.lit(SEP)), triple).when(F.size(parts) >= 3, three).otherwise(few)


def cap_words(c: Column, n: int = 500) -> Column:
    """texts of more words than n are cut to n, joined by single spaces."""
    words = F.split(squeeze(c), " ")
    return F.when(F.size(words) > n, F.array_join(F.slice(words, 1, n), " ")).otherwise(c)


def passage_title(contents: Column) -> Column:
    """The first line without quotation marks at its ends."""
    return F.regexp_replace(F.substring_index(contents, "\n", 1), "^[\"']+|[\"']+$", "")


def passage_text(contents: Column) -> Column:
    at = F.instr(contents, "\n")
    return F.when(at > 0, F.substr(contents, at + F.lit(1))).otherwise("")


def evidence(title: Column, text: Column) -> Column:
    """R6"""
    return F.concat(F.lit("(Title: "), title, F.lit(") "), text)


def three_places():
    """three decimals, by the number's exact binary value (0.0625 is halfway and goes to 0.062, 0.0005 is above it
    and goes to 0.001). Spark rounds the shortest decimal text, so this is an Arrow UDF, for the few rows of a report."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f"{x:.3f}" for x in column.to_pylist()], pa.string())

    return run


def cut_at(c: Column, stops: tuple[str, ...], start: Column | None = None) -> Column:
    """Text up to and with the stop sequence that ends first; all of it if none is there. Stop sequences that begin before
    `start` (from 1) don't count."""
    at = lambda x: F.call_function("locate", F.lit(x), c, F.lit(1) if start is None else start)
    end = F.array_min(F.array(*[F.when(at(x) > 0, at(x) + F.lit(len(x) - 1)).otherwise(F.length(c)) for x in stops]))
    return F.substr(c, F.lit(1), end)


def readable(triple: Column) -> Column:
    """A triple as a line of evidence."""
    return F.replace(F.replace(triple, F.lit("[SEP] "), F.lit("")), F.lit("[PREP] "), F.lit(""))


def nfc():
    """Unicode NFC, as an Arrow UDF; Spark has no such function. ASCII batches pass untouched."""
    import unicodedata

    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in column.to_pylist()], pa.string())

    return run
