"""What the operators share: shared tables, batches of whole groups, joins of checked size."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast; beyond it a shuffled join takes over.
BROADCAST_ROWS = 20_000
#: Bytes of an Arrow batch that goes to a Python worker, one longer text excepted: work arrays take some ten times that.
TEXT_BYTES = 2 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_own_dir: list[str] = []
_scratch: list[list[DataFrame]] = []


def text_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, so that long texts can't fill a worker; a bound that the user has
    set stays. Every operator asks for the same, so lazy frames don't get in each other's way."""
    if int(spark.conf.get(_BATCH_BYTES).rstrip("bB")) >= 1 << 30:
        spark.conf.set(_BATCH_BYTES, TEXT_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset it is one of our own under a local master, as in tests; on a
    cluster that would be another folder on each machine, so it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="ionloom-"))
    return _own_dir[0]


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: its lineage ends here, and
    losing an executor costs no recomputation. The table goes when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._ionloom_path = path
    if _scratch:
        _scratch[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The tables that materialize() writes within."""
    _scratch.append([])
    try:
        yield _scratch[-1]
    finally:
        _scratch.pop()


def discard(df: DataFrame | None) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    path = getattr(df, "_ionloom_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "left", salts: int = 16, rows: int | None = None) -> DataFrame:
    """Join a table of one row per key, for instance of statistics per source.

    It is counted first, unless `rows` says how many it has: up to BROADCAST_ROWS rows it is broadcast. A larger one is joined by a
    shuffle in which every key is dealt over `salts` partitions, so that a hot key is no hot task.
    """
    if (small.limit(BROADCAST_ROWS + 1).count() if rows is None else rows) <= BROADCAST_ROWS:
        return df.join(F.broadcast(small), on, how)
    dealt = df.withColumn("_salt", F.pmod(F.hash(*[df[c] for c in df.columns if c not in on][:2]), F.lit(salts)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 100_000) -> Iterator[pa.Table]:
    """Tables of at least `rows` rows (but for the last) out of batches sorted by keys, cut between groups."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = [table.column(k)[-1].as_py() for k in keys]
        lo, hi = 0, table.num_rows - 1  # the first row of the last group
        columns = [table.column(k) for k in keys]
        while lo < hi:
            mid = (lo + hi) // 2
            if [c[mid].as_py() for c in columns] == last:
                hi = mid
            else:
                lo = mid + 1
        if lo:
            yield table.slice(0, lo)
        rest = table.slice(lo)
        held, n = rest.to_batches(), rest.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def nonnull(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def mixed(c: Column) -> Column:
    """A join key that no aggregate is already partitioned by, so that both sides of the join get an
    exchange of its own and skewed partitions can be split."""
    return c.bitwiseXOR(F.lit(0x5DEECE66D))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v: long): rows (u, component), component the smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Every step is a map-side
    combined minimum and a join whose skewed partitions can be split, so one component may hold any
    share of the nodes. A written table ends the lineage of each round. Self-loops are ignored.
    """
    edges = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), keep_larger=True)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = _star(large, low, keep_larger=False)
        new = materialize(stars)
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = new
        if mark == before:
            break
        before = mark
    roots = edges.select(F.col("v").alias("u")).distinct().withColumn("component", F.col("u"))
    return edges.select("u", F.col("v").alias("component")).unionByName(roots)


def _star(edges: DataFrame, low: DataFrame, keep_larger: bool) -> DataFrame:
    """Edges (u > v) in which each node u's larger (else smaller) neighbours hang on u's minimum m."""
    low = low.select(mixed(F.col("u")).alias("k"), "m")
    met = edges.withColumn("k", mixed(F.col("u"))).join(low, "k")
    if keep_larger:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select("u", "v", "m").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.filter("u <> v").distinct()


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that nothing holds any more, before the next step writes its own. The JVM hears
    of what Python has dropped from another thread, a moment later, so one round would keep the files of the last table."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.5)
        spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give what a Python worker has freed back to the system: workers stay from stage to stage, and their executor's memory counts them."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if give_back:
        give_back(0)
