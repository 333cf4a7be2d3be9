"""Pivot-permutation index over embeddings.

Every vector is described by its NEAR nearest reference points (pivots) in order. Inverted lists hold, per label, dimension and pivot, the
vectors that have the pivot in their description. Two vectors meet in a list; they are verified by cosine in double precision if they
share at least SHARED pivots, in the list of the first pivot they share, so that each pair is counted once and no pair leaves the list's
task. A list of more than BLOCK vectors is dealt out as pairs of blocks. Equal vectors are one class from the start."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import table
from .shared import components, stored

LEAST = 0.98
PIVOTS = 4096  # reference points at most: the bounded sample that the index is fitted on
NEAR = 10
SHARED = 2
BLOCK = 512


def fit(vectors: DataFrame, most: int = PIVOTS) -> np.ndarray | list:
    """Pivots by dimension: a sample of the distinct vectors, those with the smallest hashes, 2 sqrt(n) of them and at least 64."""
    n = vectors.count()
    k = int(min(most, max(64, 2 * n**0.5)))
    rows = vectors.select("v", F.xxhash64("v").alias("h")).distinct().orderBy("h").limit(k).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r.v), []).append(r.v)
    return {d: unit(np.array(x, np.float64)) for d, x in by.items()}


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _describe(pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = b.column(2)
            lengths = np.diff(np.asarray(vecs.offsets))
            flat = np.asarray(vecs.flatten(), np.float64)
            starts = np.concatenate(([0], np.cumsum(lengths)))
            near: list = [None] * len(vecs)
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                if (p := pivots.get(int(d))) is None:
                    for i in at:
                        near[i] = list(range(SHARED))  # all vectors of this length share them
                    continue
                x = unit(flat[(starts[at][:, None] + np.arange(d))])
                m = min(NEAR, len(p))
                cos = x @ p.T
                top = np.argpartition(-cos, m - 1, axis=1)[:, :m]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(cos, top, 1), axis=1, kind="stable"), 1)
                for i, row in zip(at, top.tolist(), strict=True):
                    near[i] = row
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(near, pa.list_(pa.int32()))], names=["id", "copies", "v", "label", "near"])

    return run


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index connected to each of n by the edges (i, j)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per list (or pair of blocks): how many vectors each of its vectors links to, and an edge to the smallest it is connected with."""
    for b in batches:
        ids_out, links_out, to_out = [], [], []
        for pivot, one, other, rows in zip(*(b.column(i) for i in range(4)), strict=True):
            pivot, one, other, values = pivot.as_py(), one.as_py(), other.as_py(), rows.values
            ids, copies, block = (np.asarray(values.field(k)) for k in range(3))
            order = np.argsort(ids, kind="stable")
            ids, copies, block = ids[order], copies[order], block[order]
            vec, near = values.field(3), values.field(4)
            x = unit(np.asarray(vec.flatten(), np.float64).reshape(len(ids), -1))[order]
            p = np.asarray(near.flatten()).reshape(len(ids), -1)[order]
            names, at = np.unique(p, return_inverse=True)
            hot = np.zeros((len(ids), len(names)), np.float32)
            hot[np.arange(len(ids))[:, None], at.reshape(p.shape)] = 1
            early = hot[:, names < pivot]
            ok = (hot @ hot.T >= min(SHARED, p.shape[1])) & (early @ early.T == 0) & (x @ x.T >= LEAST)
            np.fill_diagonal(ok, False)
            if one != other:
                ok &= block[:, None] != block[None, :]
            if not ok.any():
                continue
            links = ok @ copies
            i, j = np.nonzero(ok)
            root = _roots(len(ids), i, j)
            some = links > 0
            ids_out.append(ids[some])
            links_out.append(links[some])
            to_out.append(ids[root][some])
        if ids_out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (ids_out, links_out, to_out)], names=["id", "links", "to"])


def embedding_links(rows: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label).

    A vector that is null, empty, zero or holds a null or non-finite value, or whose label is null, links with nothing; so does a row
    without vec_id, whose component_id and kept are null. Vectors of different lengths never link. Equal vectors of one label link with
    each other. Rows that repeat a vec_id count each. An empty table gives an empty result; other columns are not read."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    fit_for = F.coalesce(F.expr("vec_id is not null and label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) <> double('inf')) and exists(v, x -> x <> 0)"), F.lit(False))
    rows = rows.withColumn("fit", fit_for).withColumn("key", F.when(F.col("fit"), F.sha2(F.expr("concat_ws(',', label, cast(v as string))"), 256)))
    good = rows.where("fit")
    classes, _ = stored(good.groupBy("key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"), F.first("label").alias("label")), "pivot-classes")
    pivots = fit(classes)
    described = classes.select("id", "copies", "v", "label").mapInArrow(_describe(pivots), "id long, copies long, v array<double>, label string, near array<int>")
    flat = described.select("id", "copies", "v", "label", "near", F.size("v").alias("dim"), F.explode("near").alias("pivot"))
    flat, _ = stored(flat, "pivot-lists")
    key = ["label", "dim", "pivot"]
    sizes = flat.groupBy(*key).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    sizes, _ = stored(sizes.withColumn("blocks", F.ceil(F.col("members") / BLOCK)), "pivot-sizes")
    dealt = flat.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select(*key, F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"), F.struct("id", "copies", "block", "v", "near").alias("row"))
    lists = dealt.groupBy(*key, "one", "other").agg(F.collect_list("row").alias("rows")).where("size(rows) > 1")
    found, _ = stored(lists.select("pivot", "one", "other", "rows").mapInArrow(_verify, "id long, links long, to long"), "pivot-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp, _ = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")), "pivot-components")
    per = classes.select("id", "copies", "key").join(links, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
    per, _ = stored(per.select(F.col("key").alias("k"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("comp", "id").alias("c")), "pivot-result")
    out = rows.select("vec_id", "key").join(per, F.expr("key = k"), "left")
    c = F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), c.alias("component_id"), (F.col("vec_id") == c).alias("kept"))


def op8_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))
