"""Exact deduplication by a stateful stream.

Rows (digest, doc_id, code points, content locator) of all documents are streamed, in several micro-batches, through an aggregation keyed by
the digest. Its state lives in RocksDB, on disk, with changelog checkpoints in the shared folder; it has no watermark and so never expires.
It holds the digest, the stable identifier of the row that stays and its content locator: the file (a hash of its path) and the row in it
where the text is found again. A stream that is started again on the same checkpoint goes on where it ended.

Digests that were hit more than once are then checked on full bytes: all texts of the digest must equal the text at the locator. Texts of a
digest that do not are told apart by their bytes. Everything is DataFrame or SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .shared import drop, is_scan, scratch, stored

BLANK = " \t\n\x0b\x0c\r"
BATCHES = 2  # micro-batches at least
BATCH_FILES = 4096  # files of digests in a micro-batch, at most
BROADCAST_HITS = 300_000  # digests that were hit: about 100 bytes each

ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size FROM d GROUP BY norm),
k AS (SELECT norm, doc_id AS keep_id FROM (SELECT norm, doc_id, row_number() OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS r FROM d) WHERE r = 1)
SELECT d.doc_id, k.keep_id, g.group_size, d.doc_id = k.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm) JOIN k USING (norm)
"""


def normal(text) -> F.Column:
    """The text without ASCII blanks; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANK, "")


def dedup_stream(path: str, schema, out: str, checkpoint: str, spark: SparkSession, batches: int = BATCHES) -> None:
    """Run the stateful stream over the files at path that it has not read yet; each micro-batch writes the digests it changed to out.

    The files are read in at least `batches` micro-batches of at most BATCH_FILES files each. Columns: digest, doc_id, code_points, file,
    at."""
    files = len(spark.read.schema(schema).parquet(path).inputFiles())
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, min(BATCH_FILES, -(-files // batches)))).parquet(path)
    keeper = F.max(F.struct("code_points", (-F.col("doc_id")).alias("back"), "file", "at")).alias("keeper")
    state = rows.groupBy("digest").agg(keeper, F.count(F.lit(1)).alias("group_size"))

    def write(batch: DataFrame, number: int) -> None:
        new = batch.select("digest", (-F.col("keeper.back")).alias("keep_id"), "keeper.file", "keeper.at", "group_size", F.lit(number).cast("long").alias("batch"))
        new.write.mode("overwrite").parquet(f"{out}/part={number}")

    conf, old = spark.conf, {}
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each state partition sets aside tens of MB
        "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    }
    for k, v in wanted.items():
        old[k] = conf.get(k, None)
        conf.set(k, v)
    try:
        stream = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        stream.awaitTermination()
    finally:
        for k, v in old.items():
            conf.unset(k) if v is None else conf.set(k, v)


STATE = "digest string, keep_id long, file long, at long, group_size long, batch long"


def last_state(spark: SparkSession, out: str) -> DataFrame:
    """The last row of each digest in what dedup_stream wrote: a later micro-batch's row stands for all before."""
    spark.createDataFrame([], STATE).write.mode("overwrite").parquet(f"{out}/part=-1")
    state = spark.read.schema(STATE).parquet(out).groupBy("digest").agg(F.max_by(F.struct("keep_id", "file", "at", "group_size"), "batch").alias("s"))
    return state.select("digest", "s.*")


def sha256(norm) -> F.Column:
    return F.sha2(norm, 256)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest=sha256, batches: int = BATCHES, locator: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Texts are equal when identical without ASCII blanks; null counts as empty, so all null, empty and blank texts are one group. Of equal
    texts the one with the most code points stays, then the smallest doc_id; a row without doc_id stays only if its group has no other
    id, and then kept is true for each such row. Rows that repeat a doc_id in a group count each and are kept alike. Texts are taken
    whole, however long. locator names two columns that tell where a row's text is (file, place), if not the file and row it is read from. digest makes a string of a normalised text; another than SHA-256 changes no group, only the work. An empty table
    gives an empty result; other columns are not read."""
    spark = docs.sparkSession
    where = list(locator)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *where)
    if not where:
        if not is_scan(docs):
            docs, _ = stored(docs, "dedup-rows")
        where = [F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")]
    else:
        where = [F.col(c) for c in where]
    rows = docs.select("doc_id", "text", normal(F.col("text")).alias("norm"), where[0].alias("file"), where[1].alias("at"))
    points = F.length(F.coalesce("text", F.lit(""))).cast("long").alias("code_points")
    digests, at = stored(rows.select("doc_id", digest(F.col("norm")).alias("digest"), points, "file", "at"), "dedup-digests")
    out, checkpoint = scratch(spark, "dedup-state"), scratch(spark, "dedup-checkpoint")
    dedup_stream(at, digests.schema, out, checkpoint, spark, batches)
    state, state_at = stored(last_state(spark, out), "dedup-final")
    drop(spark, out)
    drop(spark, checkpoint)

    hits = state.where("group_size > 1").select(F.col("digest").alias("key"), F.col("file").alias("own_file"), F.col("at").alias("own_at"))
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits
    same = F.col("file").eqNullSafe(F.col("own_file")) & F.col("at").eqNullSafe(F.col("own_at"))
    texts = rows.select(digest(F.col("norm")).alias("digest"), "norm", "file", "at").join(hits, F.expr("digest = key"))
    # Aggregated before they are shuffled, so a group of any size sends three texts a task.
    seen = texts.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"), F.max(F.when(same, F.col("norm"))).alias("own"))
    clash, clash_at = stored(seen.where("not (low <=> own and high <=> own)").select("digest"), "dedup-clash")
    state = state.select(F.col("digest").alias("key"), "keep_id", "group_size")
    if clash.isEmpty():
        drop(spark, clash_at)
        found = digests.join(state, F.expr("digest = key"))
        return found.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), F.col("digest").alias("text_sha256"))
    clean = digests.join(clash, "digest", "left_anti").join(state, F.expr("digest = key")).select("doc_id", "keep_id", "group_size", F.col("digest").alias("text_sha256"))
    apart = rows.select("doc_id", "norm", points, digest(F.col("norm")).alias("digest")).join(clash, "digest", "left_semi")
    keeper = F.max(F.struct("code_points", (-F.col("doc_id")).alias("back"))).alias("keeper")
    groups = apart.groupBy("norm").agg(keeper, F.count(F.lit(1)).alias("group_size")).withColumnRenamed("norm", "other")
    apart = apart.join(groups, F.expr("norm = other")).select("doc_id", (-F.col("keeper.back")).alias("keep_id"), "group_size", sha256(F.col("norm")).alias("text_sha256"))
    return clean.union(apart).select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))
