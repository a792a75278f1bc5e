"""Sources and sinks."""

from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .json_ranges import records

SAMPLES = "index int, uid string, num_hops int, question string, answer string, answer_aliases array<string>, gold_id_list array<string>, gold_evidence_list array<string>, cot_reasoning string, cot_def_triples array<string>, cot_triples array<string>, retrieved_documents array<string>"
GRAPHS = "index int, uid string, num_hops int, question string, answer string, answer_aliases array<string>, gold_id_list array<string>, gold_evidence_list array<string>, definition_triples array<string>, triples array<string>"
MEMO = "prompt string, value string"


@dataclass(frozen=True)
class EngineConfig:
    """What the runs of all entry points can be told."""

    dataset: str = "musique"
    model: str = "stub"
    graph_model: str = "stub"
    setting: str = "open-book"
    top_k: int = 5
    agent_top_k: int = 3
    path_limit: int = 5
    document_level: str = "concat"
    strategy: str = "question"
    max_turns: int = 3
    max_words: int = 500
    evidence_chars: int = 40_000
    cot_retry: int = 2
    max_samples: int | None = None
    use_agent: bool = False
    total_results: bool = False
    nudge: bool = False
    seed: int = 42
    batch_size: int = 32
    timeout_s: float = 300.0
    compare_question: bool = False

    def __post_init__(self):
        for name, known in (("dataset", ("musique", "hotpotqa", "2wikimultihopqa")), ("setting", ("gold", "open-book", "open-book+gold")), ("document_level", ("concat", "each", "concat+each")), ("strategy", ("question", "cot_reasoning", "triplets", "combined", "multihop_triplets", "question_triplets"))):
            if getattr(self, name) not in known:
                raise ValueError(f"{name}: {getattr(self, name)}")

    def with_(self, **changes) -> EngineConfig:
        return replace(self, **changes)

    def backend(self, graph: bool = False, **options):
        """The model that answers, or the one that constructs graphs; timeout_s goes to those that know one."""
        from .models import backend

        return backend(self.graph_model if graph else self.model, timeout_s=self.timeout_s, **options)

    def output_path(self, root: str, task: str) -> str:
        """S17"""
        return f"{root}/dataset={self.dataset}/task={task}/graph_model={self.graph_model}/model={self.model}/setting={self.setting}/top_k={self.top_k}"


def read_samples(spark: SparkSession, path: str, schema: str = SAMPLES, lines: bool = False) -> DataFrame:
    """JSON arrays of samples, a file by as many tasks as it has ranges, or with `lines` a sample a line (as write_results
    gives), with a fixed schema; the file's name tells the dataset."""
    if lines:
        return spark.read.schema(schema).json(path).withColumn("source_file", F.input_file_name())
    own = records(spark, path).select(F.from_json("text", schema).alias("x"), F.col("file").alias("source_file"))
    return own.select("x.*", "source_file")


def read_graphs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Samples with their constructed graphs; long_triples() turns them to a GraphTable's rows."""
    return read_samples(spark, path, GRAPHS, lines).drop("source_file")


def long_triples(graphs: DataFrame) -> DataFrame:
    """Array columns to (index, kind, pos, triple)."""
    one = lambda c, kind: graphs.select("index", F.lit(kind).alias("kind"), F.posexplode(c).alias("pos", "triple"))
    return one("definition_triples", "definition").unionByName(one("triples", "relation"))


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, under another name until it is whole; an existing one is an error."""
    fs, p = _fs(spark, path)
    _, part = _fs(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p) or not fs.rename(part, p):
        raise FileExistsError(path)


def remove(spark: SparkSession, path: str) -> None:
    """A file, or a folder with all that is in it."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())


def write_results(df: DataFrame, path: str, fmt: str = "json", order: str | None = None) -> None:
    """S4; order, W6: rows sorted by it, over the files of the result and in each."""
    (df.orderBy(order) if order else df).write.mode("overwrite").format(fmt).save(path)


def write_arrays(df: DataFrame, path: str) -> None:
    """Rows as JSON arrays, a file a task."""

    def run(batches):
        before, n = None, 0
        for b in batches:
            own = b.column(0).to_pylist()
            rows = ([before] if before is not None else []) + own[:-1] if own else []
            if own:
                before = own[-1]
            yield pa.RecordBatch.from_arrays([pa.array([("," if n + k else "[") + x for k, x in enumerate(rows)], pa.string())], names=["value"])
            n += len(rows)
        if before is not None:
            yield pa.RecordBatch.from_arrays([pa.array([("," if n else "[") + before + "]"], pa.string())], names=["value"])

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(run, "value string").write.mode("errorifexists").text(path)


@contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of a job that runs inside go when it ends: what it wrote is all that later steps read."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stage_table(df: DataFrame, path: str) -> DataFrame:
    """A stage's result as a table that the next stage and a rerun read: what is complete isn't computed again."""
    if not exists(df.sparkSession, f"{path}/_SUCCESS"):
        with tidy(df.sparkSession):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Stages:
    """`keep` of a run, as tables under a folder of the run's own, numbered in the order of its steps: a run that is
    started again with the same inputs and configuration goes on where the last one ended. fingerprint() of those is kept
    beside them, and a run with another one is refused."""

    def __init__(self, root: str, fingerprint: str | None = None, spark: SparkSession | None = None):
        self.root, self.n = root.rstrip("/"), 0
        if fingerprint:
            claim(spark, f"{self.root}/FINGERPRINT", fingerprint)

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return stage_table(df, f"{self.root}/{self.n:04d}")

    def end(self, df: DataFrame) -> DataFrame:
        """The run's result as a table, beside which nothing of the run is left. Only for a run that isn't to be resumed."""
        done = self(df)
        for n in listed(df.sparkSession, self.root):
            if n != f"{self.n:04d}":
                remove(df.sparkSession, f"{self.root}/{n}")
        return done


def fingerprint(config: object, *inputs: DataFrame) -> str:
    """Of a configuration and of the rows of inputs, whatever their order."""
    told = [repr(config)]
    for df in inputs:
        columns = sorted(df.columns)
        row = F.xxhash64(*[F.to_json(F.struct(c)) for c in columns])
        told.append(repr((columns, tuple(df.select(row.alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()))))
    return hashlib.sha256("\n".join(told).encode()).hexdigest()


def claim(spark: SparkSession, path: str, fingerprint: str) -> None:
    """Leave the fingerprint at path, or hold it against the one that is there."""
    if not exists(spark, path):
        write_text(spark, path, fingerprint)
    elif (there := read_text(spark, path)) != fingerprint:
        raise ValueError(f"{path} is of other inputs or another configuration: {there[:12]}, not {fingerprint[:12]}")


class GraphTable:
    """Constructed graphs (index, kind, pos, triple); later rows of a sample are added once it isn't there yet."""

    def __init__(self, spark: SparkSession, path: str, index: str = "bigint"):
        self.spark, self.path, self.schema = spark, path, f"index {index}, kind string, pos int, triple string"

    def read(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def write(self, rows: DataFrame, replace: bool = False) -> None:
        """Sorted by index in every file."""
        own = rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in self.schema.split(", ")])
        own.sortWithinPartitions("index", "kind", "pos").write.mode("overwrite" if replace else "append").parquet(self.path)


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file, overwritten (Q20)."""
    lines.coalesce(1).write.mode("overwrite").text(path)


def new_version(df: DataFrame, root: str, version: int) -> str:
    """Repaired data beside the old, never over it (Q23)."""
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").json(path)
    return path


class MemoTable:
    """Prompt -> value between runs, in hash buckets of the prompt: appended to as sorted deltas, of which a prompt's last one
    counts; a look-up reads the wanted buckets alone. Empty before the first append."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("prompt"), F.lit(self.buckets)).cast("int")

    def _rows(self) -> DataFrame:
        """(prompt, value, version, bucket) of all deltas. A compaction replaces the deltas before it."""
        kind = f"{MEMO}, version long, bucket int"
        versions = sorted(self._versions())
        if not versions:
            return self.spark.createDataFrame([], kind)
        base = max((v for v in versions if exists(self.spark, f"{self.path}/version={v}/_COMPACT")), default=0)
        paths = [f"{self.path}/version={v}" for v in versions if v >= base]
        return self.spark.read.schema(kind).option("basePath", self.path).parquet(*paths)

    def _versions(self) -> list[int]:
        """Those that were written whole."""
        names = listed(self.spark, self.path)
        return [int(n.split("=")[1]) for n in names if n.startswith("version=") and exists(self.spark, f"{self.path}/{n}/_SUCCESS")]

    def _last(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("prompt").agg(F.max_by("value", F.struct("version", "value")).alias("value"))

    def read(self) -> DataFrame:
        return self._last(self._rows())

    def lookup(self, prompts: DataFrame) -> DataFrame:
        """(prompt, value) of those prompts that are known."""
        wanted = prompts.select("prompt").distinct()
        buckets = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]  # at most self.buckets
        return self._last(self._rows().where(F.col("bucket").isin(buckets)).join(wanted, "prompt", "left_semi"))

    def append(self, rows: DataFrame) -> None:
        self._write(rows.select("prompt", "value").where("prompt is not null"), max(self._versions(), default=0) + 1)

    def compact(self) -> None:
        """All deltas as one; those before it aren't read any more, and may be deleted once nobody does."""
        version = max(self._versions(), default=0) + 1
        self._write(self.read(), version)
        write_text(self.spark, f"{self.path}/version={version}/_COMPACT", "")

    def _write(self, rows: DataFrame, version: int) -> None:
        own = rows.withColumn("bucket", self._bucket())
        own.repartition("bucket").sortWithinPartitions("bucket", "prompt").write.partitionBy("bucket").mode("errorifexists").parquet(f"{self.path}/version={version}")
