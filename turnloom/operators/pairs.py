"""Queries over pairs, planned otherwise than their entries' texts say: those stay as they are, for the oracle and for Spark's small cases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import catalog
from ..session import shards

BLOCK, ROWS = 1024, 64  # vectors of a block, and those of them that meet another block at a time
MET = [("label", pa.int32()), ("l_id", pa.int64()), ("r_id", pa.int64()), ("cosine", pa.float64())]


def _dots(a: list[tuple], b: list[tuple]) -> Iterator[tuple]:
    """(ids, ids, products) of pairs whose first id is the lesser one. Sums run over the dimensions in order, as a plain loop's do, so they
    are the same to the last bit; vectors of different length have none."""
    sizes = [np.array([len(u) for _, u in x]) for x in (a, b)]
    width = max(s.max() for s in sizes)
    ids = [np.array([i for i, _ in x], np.int64) for x in (a, b)]
    v = [np.zeros((width, len(x))) for x in (a, b)]
    for m, x in zip(v, (a, b), strict=True):
        for k, (_, u) in enumerate(x):
            m[: len(u), k] = u
    for at in range(0, len(a), ROWS):
        part = v[0][:, at : at + ROWS]
        total = np.zeros((part.shape[1], len(b)))
        for d in range(width):
            total += part[d][:, None] * v[1][d]
        left = ids[0][at : at + ROWS]
        i, j = np.nonzero(left[:, None] < ids[1])
        yield left[i], ids[1][j], pa.array(total[i, j], pa.float64(), mask=sizes[0][at + i] != sizes[1][j])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, i, j, side, id, u) in order of blocks; two blocks are in memory at a time."""
    key, sides = None, ([], [])

    def close() -> Iterator[pa.RecordBatch]:
        if key is None:
            return
        a, b = sides if key[1] != key[2] else (sides[0], sides[0])
        for left, right, cosine in _dots(a, b) if a and b else ():
            cols = [pa.array(np.full(len(left), key[0], np.int32)), pa.array(left), pa.array(right), cosine]
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(MET))

    for b in batches:
        us = b.column(5)
        for k, (label, i, j, side, id_) in enumerate(zip(*(b.column(c).to_pylist() for c in range(5)), strict=True)):
            if (label, i, j) != key:
                yield from close()
                key, sides = (label, i, j), ([], [])
            sides[side].append((id_, us[k].values.to_numpy(zero_copy_only=False)))
    yield from close()


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of vectors of a label, block by block. The work and the result are quadratic; memory is bounded by two blocks, and pairs of
    blocks are dealt over all tasks."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1
    u = catalog.view(spark, sf_dir, "units").where("label is not null and id is not null").select("label", "id", "u", F.floor(place / BLOCK).cast("int").alias("b"))
    u = u.withColumn("last", F.max("b").over(Window.partitionBy("label"))).withColumn("o", F.explode(F.sequence(F.lit(0), "last")))
    u = u.select("label", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") > F.col("o")).cast("int").alias("side"), "id", "u")
    met = u.repartition(shards(spark), "label", "i", "j").sortWithinPartitions("label", "i", "j", "side").mapInArrow(_met, "label int, l_id long, r_id long, cosine double")
    return met.select("label", "l_id", "r_id", F.round("cosine", 6).alias("cosine"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that can meet others, and whether another turn has their id (then they are not told apart by it)."""
    t = catalog.view(spark, sf_dir, "turns").where("rec is not null and id is not null and start is not null and `end` is not null and speaker is not null")
    return t.select("rec", "id", "start", "end", "speaker", (F.count(F.lit(1)).over(Window.partitionBy("id")) > 1).alias("twin"))


def _meeting(left: DataFrame, right: DataFrame, and_also: str) -> DataFrame:
    """Turns of different speakers that share time, once, in the bin of 60 s where the later of the two begins."""
    bins = F.explode(F.sequence(F.floor(F.col("start") / 60), F.floor(F.col("end") / 60))).alias("b")
    l, r = left.select("*", bins).alias("l"), right.select("*", bins).alias("r")  # noqa: E741
    where = "l.rec = r.rec and l.b = r.b and l.id <> r.id and l.speaker <> r.speaker and l.start < r.`end` and r.start < l.`end` and l.b = floor(greatest(l.start, r.start) / 60)"
    return l.join(r, F.expr(f"{where} and {and_also}"))


def cannot_link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of turns of different speakers that share time. A pair of ids is made once, so pairs are not shuffled to tell them apart; only
    those of ids that several turns have are."""
    t = _turns(spark, sf_dir)
    sole, twins = t.where("not twin"), t.where("twin")
    once = _meeting(sole, sole, "l.id < r.id").select("l.rec", F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    again = _meeting(twins, t, "true").select("l.rec", F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()
    return once.union(again)


def overlap_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers that talk while a turn does, counted without pairs: of a speaker's turns that begin before a turn's end, the one that ends
    last tells whether any shares time with it. Turns whose id another turn has go by pairs, as there turns with one id do not count."""
    t = _turns(spark, sf_dir)
    speakers = t.select("rec", F.col("speaker").alias("other")).distinct()
    asked = t.where("not twin").join(speakers, "rec").where("speaker <> other")
    rows = asked.select("rec", "other", F.col("end").alias("at"), F.lit(0).alias("kind"), "id", "start", F.lit(None).cast("double").alias("until"))
    rows = rows.union(t.select("rec", "speaker", "start", F.lit(1), F.lit(None).cast("long"), F.lit(None).cast("double"), "end"))
    before = Window.partitionBy("rec", "other").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # asked first: a start at the end shares none
    shared = rows.withColumn("until", F.max("until").over(before)).where("kind = 0 and until > start").select("id", "other")
    twins = _meeting(t.where("twin"), t, "true").select("l.id", F.col("r.speaker").alias("other"))
    return shared.union(twins).groupBy("id").agg(F.countDistinct("other").alias("excluded"), F.min("other").alias("first_excluded"))


QUERIES = {f.__name__: f for f in (cosine_pairs, cannot_link_edges, overlap_exclusions)}
