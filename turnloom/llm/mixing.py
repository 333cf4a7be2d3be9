"""Mixing sources to target weights by entropy balancing.

A document of w words gets a rate r(w) in (0, 2). Of all rates whose expected words meet each source's target, the wanted ones are closest
in (bounded) entropy to one copy each; by convex duality they are exponentially tilted, r = 2 / (1 + exp(-t w / scale)), with one dual
variable t a source. Newton iterations on the dual run over the histogram of (source, size), a partial aggregate of the documents that
has all that the gradient and the curvature need; each iteration is one join and one aggregation on the executors. The rates are then
rounded into whole copies: per source, cumulative rounding over the sizes keeps the words within one document's size of the target, and
a greedy correction over the histogram takes away what is left. Which of equally long documents get the extra copy is decided by a hash
of their doc_id, so reruns agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import table
from .shared import drop, stored

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
ROUNDS = 40
CELL = 256  # documents ranked together for the extra copies


def word_count(text) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per source its size and target. sizes: source, source_size, one row a source.

    Filling by weight up to `most` times a source's size: with sources in the order of size / weight, the first k are full for the largest
    k at which the rest's common level still exceeds the k-th's limit."""
    by_point = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_point) - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("limit", F.col("source_size") * float(most)).withColumn("wanted", F.sum("source_size").over(Window.partitionBy()) * share)
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    w = w.withColumn("full_before", F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("weight_from", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    w = w.withColumn("level", (F.col("wanted") - F.col("full_before")) / F.col("weight_from"))
    free = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    level = F.first(free, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    w = w.withColumn("common", level)
    return w.select("source", "source_size", F.when(F.col("common").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("common") * F.col("weight"))).alias("target"))


def dual(hist: DataFrame, aims: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, str]:
    """Per source its dual variable, and the path of that table: Newton steps, or bisection where one leaves the bracket. hist: source, size, n; aims: source,
    source_size, target, scale. A source whose target is all it may give has no finite optimum and takes the bracket's end."""
    spark = hist.sparkSession
    full = F.col("target") >= F.col("source_size") * float(MOST) * (1 - 1e-12)
    at = aims.select("source", "target", "scale", F.when(full, 800.0).otherwise(0.0).alias("t"), F.lit(-800.0).alias("low"), F.lit(800.0).alias("high"), full.alias("done"))
    at, path = stored(at, "mix-dual")
    for _ in range(rounds):
        rate = F.lit(float(MOST)) / (1 + F.exp(-F.col("t") * F.col("size") / F.col("scale")))
        both = hist.alias("h").join(at.withColumnRenamed("source", "s"), F.expr("h.source <=> s"))
        step = both.groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("got"),
            F.sum(F.col("n") * F.col("size") * F.col("size") / F.col("scale") * rate * (1 - rate / MOST)).alias("slope"),
        )
        new = at.alias("a").join(step.withColumnRenamed("source", "s"), F.expr("a.source <=> s"), "left").drop("s")
        gap = F.col("got") - F.col("target")
        low, high = F.when(gap < 0, F.col("t")).otherwise(F.col("low")), F.when(gap > 0, F.col("t")).otherwise(F.col("high"))
        newton = F.col("t") - gap / F.col("slope")
        inside = (newton > low) & (newton < high)
        done = F.coalesce(F.abs(gap) <= 1e-6 * F.col("target") + 1e-6, F.lit(True))
        new = new.select(
            "source", "target", "scale",
            F.when(F.col("done") | done, F.col("t")).otherwise(F.when(inside, newton).otherwise((low + high) / 2)).alias("t"),
            low.alias("low"), high.alias("high"), (F.col("done") | done | (high - low < 1e-12)).alias("done"),
        )
        new, new_path = stored(new, "mix-dual")
        drop(spark, path)
        at, path = new, new_path
        if at.where(~F.col("done")).isEmpty():
            break
    return at, path


def _round(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for each size of one source: cumulative rounding, then greedy correction with the largest sizes first."""
    pdf = pdf.sort_values("size", kind="stable").reset_index(drop=True)
    size, n = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    target, t, scale = float(pdf["target"].iloc[0]), float(pdf["t"].iloc[0]), float(pdf["scale"].iloc[0])
    full = target >= MOST * float((n * size).sum()) * (1 - 1e-12)
    rate = np.full(len(size), float(MOST)) if full else MOST / (1 + np.exp(np.clip(-t * size / scale, -700, 700)))
    m = np.diff(np.floor(np.concatenate(([0.0], np.cumsum(n * rate))) + 0.5)).astype(np.int64)
    m = np.clip(m, 0, MOST * n)
    left = int(round(target)) - int((m * size).sum())
    for i in range(len(size) - 1, -1, -1):
        if size[i] <= 0 or not left:
            continue
        room = MOST * n[i] - m[i] if left > 0 else m[i]
        k = min(int(room), abs(left) // int(size[i]))
        m[i] += k if left > 0 else -k
        left -= int(k * size[i]) * (1 if left > 0 else -1)
    pdf["copies"] = m
    return pdf[["source", "size", "n", "copies"]]


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(per document doc_id, size, source_size, target, taken, copies and pick; per source its target).

    Null, empty and blank texts have size 0 and are never taken (copies 0); a null source is a source of its own, the last. A null doc_id and repeated rows are
    documents like any other. Copies are whole, so a source's words may miss its target by half of its shortest document. An empty table, or one without words, gives targets of 0. Columns row, file and at are passed on. Other columns are not read."""
    spark = docs.sparkSession
    row = [c for c in ("row", "file", "at") if c in docs.columns]
    d = docs.select(*row, F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    d, _ = stored(d, "mix-sizes")
    hist, hist_at = stored(d.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    per = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    aims, _ = stored(targets(per.select("source", "source_size")), "mix-targets")
    scales = per.select("source", (F.greatest("source_size", F.lit(1)) / F.col("docs")).alias("scale"))
    scaled = aims.alias("a").join(scales.withColumnRenamed("source", "s"), F.expr("a.source <=> s")).select("source", "source_size", "target", "scale")
    solved, solved_at = dual(hist, scaled)
    cells = hist.alias("h").join(solved.select(F.col("source").alias("s"), "target", "scale", "t"), F.expr("h.source <=> s")).drop("s")
    # One group a source, with one row for each different size: bounded by the sizes that texts have, not by the documents.
    copies = cells.groupBy("source").applyInPandas(_round, "source string, size long, n long, copies long")
    copies = copies.alias("c").join(aims.withColumnRenamed("source", "s"), F.expr("c.source <=> s")).drop("s")
    copies, _ = stored(copies, "mix-copies")
    drop(spark, hist_at)
    drop(spark, solved_at)
    # Documents of a cell are ranked in parts of about CELL; a part's share of the extra copies follows from the parts before it.
    tag = F.xxhash64("doc_id")
    right = copies.select(F.col("source").alias("s"), F.col("size").alias("z"), "n", "copies", "source_size", "target")
    one = d.join(right, F.expr("source <=> s and size = z")).drop("s", "z")
    one = one.withColumn("part", F.when(F.col("n") > CELL, F.pmod(tag, F.ceil(F.col("n") / CELL))).otherwise(F.lit(0).cast("long")))
    split = one.where(f"n > {CELL}").groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    split = split.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0).cast("long")))
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy(tag, "doc_id"))
    parts = split.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"), "before")
    ranked = one.withColumn("rank", rank).join(parts, F.expr("source <=> s and size = z and part = p"), "left")
    extra = F.col("copies") - F.floor(F.col("copies") / F.col("n")) * F.col("n")
    picked = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("rank") + F.coalesce("before", F.lit(0)) <= extra, 1).otherwise(0)
    picked = F.when(F.col("size") > 0, picked).otherwise(0)
    out = ranked.select(*row, "doc_id", "source", "size", "source_size", "target", picked.cast("long").alias("copies"))
    return out.select(*row, "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source"), aims


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))[0]
