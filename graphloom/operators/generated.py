"""Generated text to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def lines(rows: DataFrame, column: str = "text") -> DataFrame:
    return rows.select("index", F.posexplode(F.split(column, "\n")).alias("pos", "line")).withColumn("line", T.strip(F.col("line")))


def before_next_question(rows: DataFrame) -> DataFrame:
    """Lines before the first that starts a new question."""
    stop = F.min(F.when(F.startswith(F.col("line"), F.lit("# Question")), F.col("pos"))).over(Window.partitionBy("index"))
    return rows.withColumn("stop__", stop).where("stop__ is null or pos < stop__").drop("stop__")


#: what an answer without latent entities says (fixed values)
NONE_LINES = ("no latent entities identified", "(no latent entities needed)")


def latent_lines(rows: DataFrame, column: str = "text") -> DataFrame:
    """L2: definition triples: (index, pos, triple)."""
    low = F.lower(F.col("line"))
    own = before_next_question(lines(rows, column)).where(T.is_definition(F.col("line")))
    return own.where(~F.contains(low, F.lit(NONE_LINES[0])) & ~F.contains(low, F.lit(NONE_LINES[1]))).select("index", "pos", F.col("line").alias("triple"))


def triple_lines(rows: DataFrame, defs: DataFrame | None = None, column: str = "text") -> DataFrame:
    """Triples, each once at its first place, but for those listed in defs (index, triple) (Q31: others may look like definitions)."""
    own = before_next_question(lines(rows, column)).where(F.contains(F.col("line"), F.lit(T.SEP)) & ~F.startswith(F.col("line"), F.lit("# Triples")))
    own = own.groupBy("index", F.col("line").alias("triple")).agg(F.min("pos").alias("pos")).select("index", "pos", "triple")
    return own if defs is None else own.join(defs.select("index", "triple"), ["index", "triple"], "left_anti").select("index", "pos", "triple")


def sections(rows: DataFrame, column: str = "text") -> DataFrame:
    """L1: single-shot answers: (index, kind, pos, triple). The first section ends at the head of the triples or at a
    triple that doesn't begin with an entity; in it the k-th triple is a definition if it defines (ENTk)."""
    low, line = F.lower(F.col("line")), F.col("line")
    kept = before_next_question(lines(rows, column)).where(~F.contains(low, F.lit(NONE_LINES[0])) & ~F.contains(low, F.lit(NONE_LINES[1])) & ~F.startswith(line, F.lit("# Latent Entities")))
    triple = F.contains(line, F.lit(T.SEP)) & ~F.startswith(line, F.lit("# Triples"))
    ends = F.startswith(line, F.lit("# Triples")) | (triple & ~F.startswith(line, F.lit("(ENT")))
    own = Window.partitionBy("index").orderBy("pos")
    marked = kept.withColumn("second", F.max(ends).over(own.rowsBetween(Window.unboundedPreceding, 0))).where(triple)
    k = F.row_number().over(own)  # the first section comes first, so this is the place in it
    defines = F.startswith(line, F.concat(F.lit("(ENT"), F.col("k").cast("string"), F.lit(") [SEP] is [SEP]")))
    return marked.withColumn("k", k).select("index", F.when(~F.col("second") & defines, "definition").otherwise("relation").alias("kind"), "pos", line.alias("triple"))


def reasoning(column: str = "text"):
    """Text after the last mark of reasoning."""
    return T.strip(F.substring_index(F.col(column), "# Reasoning:", -1))


#: Marks in a generated chain of thought, and the lengths below which text isn't one (fixed values)
REASONING, QUESTION, LATENT, TRIPLES, FORMAT = "Reasoning:", "# Question:", "# Latent Entities:", "# Triples:", "# Output Format:"
MIN_COT, MIN_PART, MIN_LINE = 20, 20, 30


def cot_text(column: str = "text"):
    """The chain of thought of an answer: after its own mark, else before the next question, else between the
    question and the entities or the triples, else the first long line that is no heading. '' if that is short."""
    text = F.col(column)
    has = lambda c, mark: F.contains(c, F.lit(mark))
    before = lambda c, mark: F.substring_index(c, mark, 1)
    after = lambda c, mark: F.substring_index(c, mark, -1)
    long = lambda c: F.when(F.length(c) > MIN_PART, c)
    some = lambda c: F.when(c != "", c)
    told = F.when(has(text, "# " + REASONING), after(text, "# " + REASONING)).when(has(text, REASONING), after(text, REASONING))
    marked = T.strip(F.when(has(told, LATENT), before(told, LATENT)).otherwise(before(told, TRIPLES)))
    head = T.strip(before(text, QUESTION))
    head = F.when(has(head, "Given a question") & has(head, FORMAT), T.strip(after(head, FORMAT))).otherwise(head)

    def between(mark: str):
        part = after(T.strip(before(text, mark)), QUESTION)
        inner = F.when(has(part, REASONING), some(T.strip(after(part, REASONING))))
        if mark == TRIPLES:
            inner = inner.when(has(part, LATENT), some(T.strip(before(part, LATENT))))
        return F.when(has(text, mark) & has(before(text, mark), QUESTION), inner.otherwise(long(T.strip(part))))

    every = F.transform(F.split(text, "\n"), T.strip)
    line = F.get(F.filter(every, lambda x: (F.length(x) > MIN_LINE) & ~F.startswith(x, F.lit("#")) & ~has(x, "Question:") & ~has(x, "Output Format:")), F.lit(0))
    found = F.coalesce(some(marked), F.when(has(text, QUESTION), long(head)), between(LATENT), between(TRIPLES), line, F.lit(""))
    return F.when(F.length(found) < MIN_COT, "").otherwise(found)
