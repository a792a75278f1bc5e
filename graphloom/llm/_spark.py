"""Shared plumbing of the corpus operators: intermediate tables, batches of bounded
bytes, Bloom filters, Arrow text access and connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker function takes at a time. A longer text is taken alone.
BATCH_BYTES = 4 << 20
#: Rows and bytes of the Arrow batches of jobs that an operator runs itself.
JOB_ROWS, JOB_BYTES = 1000, 4 << 20
#: Edges that one task unites at a time.
EDGES = 1_000_000
#: A Bloom filter's hashes, bits per key, and bits at most (as a power of two): 8 MB.
HASHES, BITS, MOST_BITS = 6, 10, 26


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where it is unset, a folder in the
    warehouse: on a local master (tests), or if the warehouse isn't in a machine's own file system; else that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not spark.sparkContext.master.startswith("local") and (warehouse.startswith("file:") or "://" not in warehouse):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"{warehouse}/graphloom"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """For operators whose result Spark computes later, in the user's own job: the session's Arrow batches hold JOB_BYTES
    at most. A bound on bytes, which Spark has anyway (64 MB a task and direction); only ever lowered, so plans of
    other code run as they did, in smaller batches."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > JOB_BYTES:
        spark.conf.set(key, str(JOB_BYTES))


class Scratch:
    """Intermediate tables of one operator call, as Parquet in the shared folder, so they survive lost executors.

    As a context: settings hold for the jobs that run inside and are put back after them (small Arrow batches; a job's
    shuffle files go when it ends, unless `tidy` is false: for rows that are fetched bit by bit). At its end all tables go but those of result(), which the returned frame still reads."""

    def __init__(self, spark: SparkSession, tidy: bool = True):
        self.spark, self.paths, self.stay = spark, {}, set()
        self.conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(JOB_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(JOB_BYTES), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": str(tidy).lower()}

    def __enter__(self) -> Scratch:
        self.before = {k: self.spark.conf.get(k, None) for k in self.conf}
        for k, v in self.conf.items():
            self.spark.conf.set(k, v)
        return self

    def __exit__(self, *_) -> None:
        for k, v in self.before.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        self.drop(*(df for _, df in list(self.paths.values()) if id(df) not in self.stay))

    def keep(self, df: DataFrame) -> DataFrame:
        """Compute df once and cut its lineage."""
        path = f"{shared_dir(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path, out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in tables:
            path, _ = self.paths.pop(id(df))
            delete(self.spark, path)

    def result(self, df: DataFrame) -> DataFrame:
        """A table that outlives the context."""
        out = self.keep(df)
        self.stay.add(id(out))
        return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `most` bytes in a string or binary column, or of one row. After the last one the
    worker, which Spark keeps for later tasks, gives back the memory that it doesn't use any more."""
    try:
        for b in batches:
            n = len(b)
            if not n:
                continue
            size = np.cumsum(_lengths(b.column(column)))
            at = 0
            while at < n:
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
                yield b.slice(at, end - at)
                at = end
    finally:
        _release()


def _release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def flat_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): one buffer of all texts, document i at offsets[i]:offsets[i+1]. Null: empty."""
    return flat_binary(column.fill_null("") if column.null_count else column)


def flat_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def maybe_in(keys: DataFrame, n: int) -> Callable[[Column], Column]:
    """keys (h: 64-bit hashes, about n of them) -> a condition on a hash column that holds for every key and for few others.

    A Bloom filter, made on the executors. Its bits are bounded (MOST_BITS); where that is under BITS a key more of the
    others pass, and in the end all do. So it saves work and decides nothing: an exact join has to follow."""
    from pyspark.sql.functions import arrow_udf

    size = 1 << min(MOST_BITS, max(10, (BITS * n).bit_length()))
    place = [F.expr(f"((h & 4294967295L) + {i} * (shiftrightunsigned(h, 32) | 1L)) & {size - 1}L") for i in range(HASHES)]
    places = keys.select(F.explode(F.array(*place)).alias("p"))
    got = places.groupBy(F.expr("shiftright(p, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("v")).toArrow()  # at most size / 64 rows
    words = np.zeros(size // 64, np.uint64)
    words[got["w"].to_numpy()] = got["v"].to_numpy().view(np.uint64)
    sent = keys.sparkSession.sparkContext.broadcast(words)

    @arrow_udf("boolean")
    def test(column: pa.Array) -> pa.Array:
        h, u = column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.uint64
        a, b, ok = h & u(0xFFFFFFFF), (h >> u(32)) | u(1), np.ones(len(h), bool)
        for i in range(HASHES):
            p = (a + u(i) * b) & u(size - 1)
            ok &= ((sent.value[(p >> u(6)).astype(np.int64)] >> (p & u(63))) & u(1)).astype(bool)
        return pa.array(ok)

    return test


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (u, v) -> (node, root) of all their nodes, root: the smallest node reachable by them."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return ids, ids[root]
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (root[root] != root).any():
            root = root[root]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges, EDGES at a time, as (node, root)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def flush():
        node, root = forest(*(np.concatenate([x[i] for x in held]) for i in range(2)))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])

    for b in batches:
        if count + len(b) > EDGES and held:
            yield flush()
            held, count = [], 0
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        count += len(b)
    if held:
        yield flush()


def connected_components(edges: DataFrame, s: Scratch) -> DataFrame:
    """(u, v) pairs of bigint ids -> (node, root): root is the smallest id reachable.

    Every round, tasks unite the edges that they hold (EDGES at a time, so memory is bounded), then large-star and
    small-star contraction joins each neighbourhood to its minimum; rounds are logarithmic in the longest path. A hub's
    edges are spread by AQE's skew join; its minimum comes from a partial aggregate. As soon as the edges left fit
    one task's turn, it ends. Ids of nodes without edges don't appear. Nulls and loops are ignored."""
    norm = lambda d: d.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    star = lambda d: d.mapInArrow(_forests, "node bigint, root bigint")
    e = s.keep(norm(edges))

    def mark(d: DataFrame):
        return tuple(d.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(hash(u, v) as decimal(20,0)))")).first())

    before = mark(e)
    while before[0] > EDGES:
        united = star(e).select(F.col("node").alias("u"), F.col("root").alias("v")).where("u <> v").distinct()
        both = united.unionByName(united.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u")
        old, e = e, s.keep(norm(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_min.select("u", F.col("m").alias("v")))))
        s.drop(old)
        after = mark(e)
        if after == before:  # stars: what tasks would unite are the stars themselves
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = after
    out = s.keep(star(e.coalesce(1)))
    s.drop(e)
    return out
