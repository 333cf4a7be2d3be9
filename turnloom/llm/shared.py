"""The shared scratch folder, materialised tables and distributed connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh one where it is unset (local runs)."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='turnloom-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_recording: list[str] | None = None


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Lists the scratch tables that are made meanwhile, for a caller that knows when nothing reads them any more."""
    global _recording
    before, _recording = _recording, []
    try:
        yield _recording
    finally:
        _recording = before


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished queries now: Spark deletes them only once the driver has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shrink_executors(spark: SparkSession) -> None:
    """Let executors give back the heap that finished queries filled: their JVMs keep it until a full collection, beside native buffers and
    Python workers. As many tasks as there are cores run at once, so each executor has some."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def trim() -> None:
    """Give back what earlier tasks of this Python worker freed and its allocators kept."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if give_back:
        give_back(0)


BATCH_ROWS = 1000  # rows of text that Arrow carries to a Python worker at once


def small_batches(spark: SparkSession) -> None:
    """Texts are long: fewer rows at once keep buffers on both sides of a Python worker small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def stored(df: DataFrame, name: str, partition: str | None = None) -> tuple[DataFrame, str]:
    """Cut lineage: write df to the shared folder and read it again. Returns the table and its path, for drop()."""
    spark = df.sparkSession
    small_batches(spark)
    path = scratch(spark, name)
    if _recording is not None:
        _recording.append(path)
    (df.write.partitionBy(partition) if partition else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def is_scan(df: DataFrame) -> bool:
    """Whether df is read straight from files, without a shuffle, so that _metadata names where each row is."""
    if "_metadata" in df.columns:
        return False
    try:
        df.select("_metadata.file_path", "_metadata.file_block_start")
    except AnalysisException:
        return False
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Exchange" not in plan.replace("BroadcastExchange", "")


def files_of(path: str) -> Iterator[pa.Table]:
    """The Parquet files of a stored table's folder, read in a task; none if there is no such folder."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    where, root = fs.FileSystem.from_uri(path)
    for info in where.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.is_file and info.base_name.startswith("part-"):
            with where.open_input_file(info.path) as f:
                yield pq.read_table(f)


def components(edges: DataFrame, name: str = "components") -> tuple[DataFrame, str]:
    """Connected components of undirected edges (a, b): one row (node, comp) per node, comp being its smallest node.

    Each round maps every node to the smallest of its closed neighbourhood and contracts the graph along that map, so at least half of the
    nodes that are no minimum of their component vanish: rounds grow with the logarithm of the longest path. Every step is a partially
    aggregated groupBy or a join against a table with one row a key, so a node with very many edges is split by skew handling. The edges
    and the map never leave the executors. The second value is the path of the table that the result reads."""
    spark = edges.sparkSession
    edge, at = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    found, found_at = None, None
    while True:
        both = edge.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edge.select("b", "a"))
        step, step_at = stored(both.groupBy("node").agg(F.min("other").alias("to")).select("node", F.least("node", "to").alias("to")), name)
        if found is None:
            found, found_at = step.select("node", F.col("to").alias("comp")), step_at
        else:
            moved = found.join(step.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
            new, new_at = stored(moved, name)
            drop(spark, found_at)
            found, found_at = new, new_at
        shrunk = (
            edge.join(step.select(F.col("node").alias("a"), F.col("to").alias("ca")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("to").alias("cb")), "b")
            .where("ca <> cb")
            .select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
            .distinct()
        )
        left, left_at = stored(shrunk, name)
        drop(spark, at)
        if step_at != found_at:
            drop(spark, step_at)
        edge, at = left, left_at
        if edge.isEmpty():
            drop(spark, at)
            return found, found_at
