"""Keys of a text column looked up by shard, without shuffling the texts.

A split of the input (a chunk) is read twice by the same rule. The first time its different keys go to shards; the shards join what all
chunks sent, and their answers are written into a folder a chunk; the second time the chunk reads its folder. Tasks hold the keys of a part
of a chunk, or of a shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import is_scan, stored


def by_split(rows: DataFrame, name: str) -> DataFrame:
    """rows with the column chunk, naming the split of the input that a row is read from; what is not a plain scan is stored first."""
    if not is_scan(rows):
        rows, _ = stored(rows, name)
    return rows.withColumn("chunk", F.sha1(F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))))


def column(rows: pa.RecordBatch, name: str) -> pa.Array:
    return rows.column(rows.schema.get_field_index(name))


def flat(rows: pa.RecordBatch, name: str) -> np.ndarray:
    """The values of a column of lists, one list after the other."""
    return np.asarray(column(rows, name).flatten())


def lists(values: np.ndarray, cuts: np.ndarray) -> pa.ListArray:
    """values cut into lists."""
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values))


def runs_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of consecutive rows of a batch that are equal in names, with these values."""
    for b in batches:
        at = list(zip(*(column(b, n).to_pylist() for n in names), strict=True))
        start = 0
        for i in range(1, len(at) + 1):
            if i == len(at) or at[i] != at[start]:
                yield at[start], b.slice(start, i - start)
                start = i


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys with the sums of their n."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


def dealt(key: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, cuts, shards): keys in the order of their shards, which stay sorted within one, and where each shard's begin."""
    by = np.argsort(shard, kind="stable")
    shard = shard[by]
    first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else np.zeros(0, np.int64)
    return by, np.append(first, len(key)), shard[first]


def at(keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is among sorted keys, and whether it is."""
    if not len(keys):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return i, keys[i] == key
