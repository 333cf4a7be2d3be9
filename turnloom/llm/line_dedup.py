"""Line deduplication by a suffix array over line-ID sequences, built by distributed prefix doubling.

A line's ID is a 128-bit hash of the line (two of 64 bits with different seeds). A suffix begins at a (row, position) and ends with its document. At level j, suffixes are in one
class when their first 2^j lines are equal, and a class's rank is its place in the order of these prefixes; the next level's ranks come from
the pair (own rank, rank 2^j lines further on). A suffix alone in its class has its final place and leaves, so what is sorted shrinks to the
text that is repeated. The classes of a level are the intervals of the array whose longest common prefix is at least 2^j lines: their
earliest member is the copy that stays. Only DataFrame functions are used, and no row order is gathered in one task: a rank is a place
within a range partition plus the sizes of the partitions before it. Suffixes that follow one another in a text and in an earlier one make a
maximal repeated run; runs are what is deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import table
from .shared import drop, stored

MIN_LINES = 2  # a power of two: runs of so many lines or more are deleted where they occur again
LAST = (1 << 63) - 1

ORACLE = r"""
WITH l AS (SELECT doc_id, u.i, u.line, regexp_matches(u.line, '[^\x20\x09-\x0D]') AS real
  FROM documents, unnest(string_split(coalesce(text, ''), chr(10))) WITH ORDINALITY AS u(line, i)),
s AS (SELECT doc_id, i, line, lead(line) OVER w AS follows FROM l WHERE real WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, follows IS NOT NULL AND row_number() OVER (PARTITION BY line, follows ORDER BY doc_id, i) > 1 AS again FROM s),
r AS (SELECT doc_id, i, again OR coalesce(lag(again) OVER (PARTITION BY doc_id ORDER BY i), false) AS gone FROM k)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE coalesce(r.gone, false)) AS removed_lines,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE NOT coalesce(r.gone, false)), '')) AS kept_sha256
FROM l LEFT JOIN r ON l.doc_id = r.doc_id AND l.i = r.i GROUP BY l.doc_id
"""


def ranked(pairs: DataFrame, *order: str) -> DataFrame:
    """pairs with their place (rank) in the order, from 0, without a global window: range partitions, then offsets."""
    spread = pairs.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    spread, at = stored(spread.sortWithinPartitions(*order), "lines-order")
    sizes = spread.groupBy("part").agg(F.count(F.lit(1)).alias("size"))  # one row a partition
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return spread.join(F.broadcast(before.select(F.col("part").alias("p"), "before")), F.expr("part = p")).withColumn("rank", own - 1 + F.col("before")).drop("part", "p", "before")


def lines_of(docs: DataFrame) -> DataFrame:
    """row, key, seq, a, b of every line that isn't blank; seq counts them in a document, (a, b) is the line's ID. docs: row, doc_id, text."""
    lines = docs.select("row", F.coalesce("doc_id", F.lit(LAST)).alias("key"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    lines = lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    seq = F.row_number().over(Window.partitionBy("row").orderBy("line_no")) - 1
    return lines.select("row", "key", "line_no", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")).withColumn("seq", seq).drop("line_no")


def levels(lines: DataFrame):
    """Yields (number of lines, suffixes: row, key, seq, rank, first_key, first_row, first_seq) of each level until no class has two members."""
    spark = lines.sparkSession
    n, names = 1, lines.select("row", "key", "seq", "a", "b")
    while True:
        classes = names.groupBy("a", "b").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("key", "row", "seq")).alias("first")).where("members > 1")
        classes, at = stored(classes, "lines-classes")
        if classes.isEmpty():
            return
        place = ranked(classes.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "first"), "ca", "cb")
        place, _ = stored(place, "lines-ranks")
        own = names.join(place, F.expr("a = ca and b = cb"))
        own, own_at = stored(own.select("row", "key", "seq", "rank", F.col("first.key").alias("first_key"), F.col("first.row").alias("first_row"), F.col("first.seq").alias("first_seq")), "lines-suffixes")
        drop(spark, at)
        yield n, own
        further = own.select(F.col("row").alias("r"), (F.col("seq") - n).alias("s"), F.col("rank").alias("b"))
        names = own.join(further, F.expr("row = r and seq = s")).select("row", "key", "seq", F.col("rank").alias("a"), "b")
        n *= 2


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Maximal repeated runs of at least min_lines lines: row, start, lines, source_row, source_start. docs: row, doc_id, text.

    A suffix whose first 2^j lines occur earlier, at the deepest such level j, points to the earliest place of them; neighbouring suffixes
    that point along one diagonal are one run."""
    lines, lines_at = stored(lines_of(docs), "lines")
    spark = docs.sparkSession
    late = spark.createDataFrame([], "row long, seq int, n int, first_row long, first_seq int")
    for n, own in levels(lines):
        if n >= min_lines:
            late = late.union(own.where("row <> first_row or seq <> first_seq").select("row", "seq", F.lit(n).alias("n"), "first_row", "first_seq"))
    best = late.groupBy("row", "seq").agg(F.max_by(F.struct("first_row", "first_seq"), "n").alias("f"))
    best = best.select("row", "seq", F.col("f.first_row").alias("source_row"), (F.col("seq") - F.col("f.first_seq")).alias("shift"))
    # Grouped by text first, so that a run that many texts repeat is split by the texts.
    island = F.col("seq") - F.row_number().over(Window.partitionBy("row", "source_row", "shift").orderBy("seq"))
    runs = best.withColumn("island", island).groupBy("row", "source_row", "shift", "island").agg(F.min("seq").alias("start"), (F.count(F.lit(1)) + min_lines - 1).alias("lines"))
    runs, _ = stored(runs.select("row", "start", "lines", "source_row", (F.col("start") - F.col("shift")).alias("source_start")), "lines-runs")
    drop(spark, lines_at)
    return runs


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """row, doc_id, text (what stays), n_lines, removed_lines of every row of docs.

    Lines end at \\n; a blank line has no ID, is part of no run and always stays. Of equal runs of at least min_lines lines the first in
    order of (doc_id, row, position) stays, a null doc_id being last; runs that overlap themselves are treated alike. Null or empty texts
    have one empty line. Rows that repeat a doc_id are documents of their own. Long texts are taken whole. Other columns are not read. An
    empty table gives an empty result."""
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs, _ = stored(docs, "lines-rows")  # the same numbers in every later plan, also after a lost executor
    gone = repeated_runs(docs, min_lines).select(F.col("row").alias("r"), F.explode(F.sequence("start", (F.col("start") + F.col("lines") - 1).cast("int"))).alias("seq"))
    gone, _ = stored(gone.groupBy("r").agg(F.collect_set("seq").alias("gone")), "lines-gone")  # a document's own positions: bounded by its length
    few = gone.select(F.sum(F.size("gone"))).first()[0] or 0
    both = docs.join(F.broadcast(gone) if few <= 1_000_000 else gone, F.expr("row = r"), "left")
    both = both.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    real = F.filter(every, lambda i: F.col("lines")[i].rlike(r"[^\x20\x09-\x0D]"))  # where the line of each seq is
    both = both.withColumn("real", F.when(F.col("gone").isNotNull(), real))
    stay = F.array_except(every, F.transform("gone", lambda s: F.col("real")[s]))
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.col("lines")[i]), "\n"))
    return both.select("row", "doc_id", kept.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed_lines"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.when(F.col("removed_lines") > 0, F.col("removed_lines")).otherwise(0).alias("removed_lines"), F.sha2("text", 256).alias("kept_sha256"))
