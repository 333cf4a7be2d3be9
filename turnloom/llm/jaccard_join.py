"""Size-aware heavy-light set join on word shingles, reduced to connected components.

Two sets link when |A n B| / |A u B| >= 0.75, in integers 100 * inter >= 75 * union. Sets of at most `boundary` shingles (light) meet by
enumerating fixed-size subsets: a pair of sizes s, t must share at least ceil(3 (s + t) / 7) elements, so both list their subsets of that
size. Larger sets (heavy), and light ones that a heavy one may match, meet by scanning inverted lists over the part of each set that any
partner must touch. The boundary is the cheapest by the corpus's own histogram of sizes.

Frequent shingles go last in the order of every set, so the lists that are scanned are of rare ones; the order is a heuristic and changes
no result. Identical sets (by a 128-bit digest) are one class from the start. In the lists every member is first compared with the leaders of about its
size that it shares most lists with; the components this gives make all but a few comparisons superfluous, and a second scan compares whatever lies in different
components yet shares a list, at the first list that two sets share and not again where one of the lists just before is shared too. Hence no
group of copies is expanded into its pairs, and yet no link between components is lost."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import table
from . import words
from .shared import components, drop, release, stored
from .splits import summed

K = 5
BROADCAST_IDS = 2_000_000  # ids (8 bytes each) that may be broadcast; more are joined by a shuffle
HOT_SHINGLES = 1 << 18  # shingles that are ordered by their counts; the others by their hash
LIGHT_MOST = 12
BITS = 4096
MARK = 256  # bits of the bitmap by which sets that are components of their own are told apart before they are paired
BEFORE = 8  # list keys of a set before one of its keys, by which two sets that met at an earlier key are known
LEADERS = 3  # of its lists' leaders that a set is compared with before components are formed
COUNTED = 1_000_000  # shingles of a task that are counted together in search of frequent ones; as many frequent ones are held


def need(s: int, t: int) -> int:
    """Least number of shared elements of linked sets of these sizes."""
    return -(-3 * (s + t) // 7)


def prefix(n: int) -> int:
    return n - math.ceil(3 * n / 4) + 1


def subset_sizes(s: int, boundary: int) -> list[int]:
    low, high = math.ceil(0.75 * s), min(boundary, int(s / 0.75 + 1e-9))
    return sorted({need(s, t) for t in range(low, high + 1)})


def choose_boundary(histogram: dict[int, int]) -> int:
    """The boundary of least cost: an enumerated subset costs 1, a posting in an inverted list 2 (it's written and scanned)."""

    def cost(x: int) -> int:
        light = sum(histogram.get(s, 0) * sum(math.comb(s, k) for k in subset_sizes(s, x)) for s in range(1, x + 1))
        heavy = sum(2 * c * prefix(s) for s, c in histogram.items() if s > 0.75 * x)
        return light + heavy

    return min(range(LIGHT_MOST + 1), key=lambda x: (cost(x), x))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its set's size and class (128 bits); per task the shingles that are frequent in it, by lossy counting: of every COUNTED
    shingles those that are repeated go on."""
    waiting, held = [], 0
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    names = ["doc_id", "n", "cls", "more", "hot", "mark"]

    def merged() -> tuple[np.ndarray, np.ndarray]:
        u, c = np.unique(np.concatenate(waiting), return_counts=True)
        return summed(np.concatenate((keys, u[c > 1])), np.concatenate((counts, c[c > 1])))

    def frequent() -> pa.RecordBatch:
        u, c = keys[counts > 2], counts[counts > 2]
        none = pa.nulls(len(u), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(c), none, none, pa.array(u.view(np.int64)), pa.nulls(len(u), pa.list_(pa.int64()))], names=names)

    for batch in batches:
        ids = batch.column(0)
        for start, norm in words.blocks(batch.column(1)):
            w = words.Words(norm)
            doc, _, h = w.shingles(K)
            flat, off = words.per_doc_unique(doc, h, len(norm))
            cls = np.zeros((len(norm), 2), np.int64)
            raw = flat.tobytes()
            for i in np.flatnonzero(np.diff(off)).tolist():
                cls[i] = np.frombuffer(hashlib.blake2b(raw[8 * off[i] : 8 * off[i + 1]], digest_size=16).digest(), np.int64)
            waiting.append(flat)
            held += len(flat)
            yield pa.RecordBatch.from_arrays([ids.slice(start, len(norm)), pa.array(np.diff(off)), pa.array(cls[:, 0]), pa.array(cls[:, 1]), pa.nulls(len(norm), pa.int64()), parity(flat, off, MARK)], names=names)
            if held >= COUNTED:
                keys, counts = merged()
                waiting, held = [], 0
                if len(keys) > COUNTED:
                    yield frequent()
                    keys, counts = keys[:0], counts[:0]
    if held:
        keys, counts = merged()
    if len(keys):
        yield frequent()


def _postings(hot: np.ndarray, rank: np.ndarray, boundary: int):
    """Per document its list keys (token) and, for each, how many elements may still be shared after it (room)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for start, norm in words.blocks(batch.column(1)):
                w = words.Words(norm)
                doc, _, h = w.shingles(K)
                flat, off = words.per_doc_unique(doc, h, len(norm))
                n = np.diff(off)
                owner = np.repeat(np.arange(len(norm)), n)
                freq = np.zeros(len(flat), np.int64)
                if len(hot) and len(flat):
                    at = np.minimum(np.searchsorted(hot, flat), len(hot) - 1)
                    freq = np.where(hot[at] == flat, rank[at], 0)
                order = np.lexsort((flat, freq, owner))
                flat = flat[order]
                pos = np.arange(len(flat)) - off[:-1][owner]
                size = n[owner]
                take = (size > 0.75 * boundary) & (pos < size - -(-3 * size // 4) + 1)
                tok, room, own = flat[take], (size - pos)[take], owner[take]
                toks, rooms, owns = [tok], [room], [own]
                for d in np.flatnonzero((n > 0) & (n <= boundary)):
                    x = np.sort(flat[off[d] : off[d + 1]]).tolist()
                    for k in subset_sizes(len(x), boundary):
                        keys = np.array([hash((k, *c)) for c in itertools.combinations(x, k)], np.int64).view(np.uint64)
                        toks.append(words.mix(keys ^ np.uint64(0xA5A5A5A5)))
                        rooms.append(np.full(len(keys), len(x)))
                        owns.append(np.full(len(keys), d))
                tok, room, own = np.concatenate(toks), np.concatenate(rooms), np.concatenate(owns)
                order = np.argsort(own, kind="stable")
                counts = np.bincount(own, minlength=len(norm))
                offs = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, len(norm)),
                        pa.array(n.astype(np.int32)),
                        pa.ListArray.from_arrays(offs, pa.array(tok[order].view(np.int64))),
                        pa.ListArray.from_arrays(offs, pa.array(room[order].astype(np.int32))),
                    ],
                    names=["id", "n", "tokens", "rooms"],
                )

    return run


def parity(flat: np.ndarray, off: np.ndarray, bits: int) -> pa.ListArray:
    """Per set a bitmap: bit j says whether an odd number of its elements has the low bits j."""
    n = len(off) - 1
    at = np.repeat(np.arange(n), np.diff(off)) * bits + (flat & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * bits) & 1).astype(bool)
    return pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * (bits // 64)).astype(np.int32)), pa.array(np.packbits(odd).view(np.int64)))


def apart(x: str, y: str) -> str:
    """SQL: how many bits of two bitmaps differ."""
    return f"aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p ^ q)), 0, (s, c) -> s + c)"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its set, and its parity bitmap: bit j says whether an odd number of elements has the low bits j."""
    for batch in batches:
        ids = batch.column(0)
        for start, norm in words.blocks(batch.column(1)):
            doc, _, h = words.Words(norm).shingles(K)
            flat, off = words.per_doc_unique(doc, h, len(norm))
            for i in range(0, len(norm), 256):
                j = min(i + 256, len(norm))
                part, cuts = flat[off[i] : off[j]], off[i : j + 1] - off[i]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start + i, j - i),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(part.view(np.int64))),
                        parity(part, cuts, BITS),
                    ],
                    names=["id", "items", "bits"],
                )


def among(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs whose key is in ids: a broadcast while ids are few, a shuffle beyond."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, key, "left_semi")


def _linked(docs: DataFrame, pairs: DataFrame) -> tuple[DataFrame, str]:
    """Of the candidate pairs (a, b), those that link.

    The bitmaps of two sets differ in at most |A| + |B| - 2 |A n B| bits, so linked sets have |A| + |B| >= 7 times the bits that differ.
    Only pairs that pass this exact bound are joined with the sets themselves."""
    spark = docs.sparkSession
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets, sets_at = stored(among(docs, ids).mapInArrow(_sets, "id long, items array<long>, bits array<long>"), "jaccard-sets")
    small = sets.select("id", F.size("items").alias("n"), "bits")
    near = pairs.join(small.select(F.col("id").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("x")), "a").join(small.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("y")), "b")
    near, near_at = stored(near.where(f"n1 + n2 >= 7 * {apart('x', 'y')}").select("a", "b"), "jaccard-near")
    some = among(sets.select(F.col("id").alias("doc_id"), "items"), near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct())
    both = near.join(some.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a").join(some.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
    inter = both.select("a", "b", (F.size("x") + F.size("y")).cast("long").alias("total"), F.size(F.array_intersect("x", "y")).cast("long").alias("inter"))
    links, at = stored(inter.where("100 * inter >= 75 * (total - inter)").select("a", "b"), "jaccard-links")
    drop(spark, sets_at)
    drop(spark, near_at)
    release(spark)
    return links, at


_FITS = "n1 * 4 >= n2 * 3 and n2 * 4 >= n1 * 3 and 7 * least(room1, room2) >= 3 * (n1 + n2)"
_NEW = "not arrays_overlap(before1, before2)"


def _after(lists: DataFrame, boundary: int) -> DataFrame:
    """lists with the up to BEFORE keys before each in the order of its set.

    Two sets that share one of them met there, where at least as many elements might be shared, so they need not meet again: at the first
    key that they share they have none in common, and no pair is lost. Only keys of scanned parts are in an order that all sets follow."""
    w = Window.partitionBy("id", "n").orderBy(F.desc("room"), "token").rowsBetween(-BEFORE, -1)
    return lists.withColumn("before", F.when(F.col("n") > boundary, F.collect_list("token").over(w)).otherwise(F.array().cast("array<long>")))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    A null, empty or blank text has the empty set and links with nothing; a text of one to four words is one shingle. Equal texts link.
    A row without doc_id gets its n_shingles, links with nothing and has a null component_id. Rows that repeat a doc_id count as one
    node that holds the sets of all of them. Other columns are not read. An empty table gives an empty result."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    seen, _ = stored(docs.mapInArrow(_profile, "doc_id long, n long, cls long, more long, hot long, mark array<long>"), "jaccard-profile")
    mine = seen.where("hot is null")
    reps, reps_at = stored(mine.where("n > 0 and doc_id is not null").groupBy("cls", "more", "n").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
    hot = seen.where("hot is not null").groupBy("hot").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "hot").limit(HOT_SHINGLES).toPandas()
    keys, rank = hot["hot"].to_numpy(np.int64).view(np.uint64), hot["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    sizes = {r["n"]: r["count"] for r in reps.where(f"n <= {4 * LIGHT_MOST}").groupBy("n").count().collect()}
    boundary = choose_boundary(sizes)

    chosen = among(docs.where("doc_id is not null"), reps.select(F.col("rep").alias("doc_id")))
    flat = chosen.mapInArrow(_postings(keys[order], rank[order], boundary), "id long, n int, tokens array<long>, rooms array<int>")
    flat = flat.select("id", "n", F.explode(F.arrays_zip("tokens", "rooms")).alias("p")).select("id", "n", F.col("p.tokens").alias("token"), F.col("p.rooms").alias("room"))
    flat = flat.withColumn("class", F.floor(F.log("n") / math.log(1.15)).cast("int"))
    by_list = Window.partitionBy("token")
    led = flat.withColumn("members", F.count(F.lit(1)).over(by_list)).where("members > 1")
    led = led.withColumn("leader", F.first(F.struct("id", "n", "room")).over(Window.partitionBy("token", "class").orderBy("id")))
    lists, lists_at = stored(led.select("token", "id", "n", "room", "leader"), "jaccard-lists")

    first = lists.select(F.col("leader.id").alias("a"), F.col("leader.n").alias("n1"), F.col("leader.room").alias("room1"), F.col("id").alias("b"), F.col("n").alias("n2"), F.col("room").alias("room2"))
    # Of the leaders that a set meets, it is compared with the LEADERS that it shares most lists with; the rest waits for the second scan.
    first = first.where(f"a <> b and {_FITS}").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    best = Window.partitionBy("b").orderBy(F.desc("shared"), "a")
    first = first.withColumn("place", F.row_number().over(best)).where(F.col("place") <= LEADERS).select("a", "b")
    first, first_at = stored(first, "jaccard-pairs")
    release(spark)
    links, links_at = _linked(docs, first)
    comp, comp_at = components(links, "jaccard-components")

    at = lists.join(comp.withColumnRenamed("node", "id"), "id", "left").select("token", "id", "n", "room", F.coalesce("comp", "id").alias("comp"))
    at, at_at = stored(at, "jaccard-lists")
    drop(spark, lists_at)
    several = at.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("token")
    at, mixed_at = stored(_after(at.join(several, "token", "left_semi"), boundary), "jaccard-mixed")
    drop(spark, at_at)
    release(spark)
    heads = at.groupBy("token", "comp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("room").alias("room"), F.count(F.lit(1)).alias("size"), F.first("before").alias("before"))
    # A component of one set carries the set's bitmap: linked sets differ in at most (|A| + |B|) / 7 elements, and their bitmaps in no more bits.
    marks = mine.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.first("mark").alias("mark"), F.count(F.lit(1)).alias("m")).where("m = 1").select(F.col("doc_id").alias("comp"), "mark")
    alone = comp.select(F.col("comp").alias("c")).distinct()
    marks = marks.join(alone, F.expr("comp = c"), "left_anti")
    heads = heads.join(marks, "comp", "left").withColumn("before", F.when(F.col("mark").isNotNull(), F.col("before")))
    heads, heads_at = stored(heads, "jaccard-heads")
    release(spark)
    x, y = (heads.select("token", *[F.col(c).alias(f"{c}{i}") for c in ("comp", "low", "high", "room", "size", "mark", "before")]) for i in (1, 2))
    fits = "comp1 < comp2 and high1 * 4 >= low2 * 3 and high2 * 4 >= low1 * 3 and 7 * least(room1, room2) >= 3 * (low1 + low2)"
    new = f"high1 + high2 >= 7 * {apart('mark1', 'mark2')} and {_NEW}"
    met = x.join(y, (x.token == y.token) & F.expr(f"{fits} and (mark1 is null or mark2 is null or {new})"))
    # The component with fewer members in the list is expanded first, and only so far as the other's bounds allow.
    turn = F.col("size1") <= F.col("size2")
    pick = lambda c: (F.when(turn, F.col(f"{c}1")).otherwise(F.col(f"{c}2")), F.when(turn, F.col(f"{c}2")).otherwise(F.col(f"{c}1")))
    met = met.select(x.token, pick("comp")[0].alias("comp1"), pick("comp")[1].alias("comp2"), pick("low")[1].alias("low2"), pick("high")[1].alias("high2"), pick("room")[1].alias("most2"))
    one, two = (at.select(F.col("token").alias(f"t{i}"), F.col("comp").alias(f"c{i}"), F.col("id").alias(f"id{i}"), F.col("n").alias(f"n{i}"), F.col("room").alias(f"room{i}"), F.col("before").alias(f"before{i}")) for i in (1, 2))
    cross = met.join(one, F.expr("token = t1 and comp1 = c1 and n1 * 4 >= low2 * 3 and high2 * 4 >= n1 * 3 and 7 * least(room1, most2) >= 3 * (n1 + low2)")).join(two, F.expr(f"token = t2 and comp2 = c2 and {_FITS} and {_NEW}"))
    cross = cross.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct()
    cross = cross.join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    cross, cross_at = stored(cross, "jaccard-pairs")
    more, more_at = _linked(docs, cross)
    for p in (mixed_at, heads_at, cross_at, first_at):
        drop(spark, p)
    if not more.isEmpty():
        comp, _ = components(links.union(more), "jaccard-components")
        drop(spark, comp_at)
    drop(spark, links_at)
    drop(spark, more_at)
    node = mine.join(reps.toDF("k", "k2", "m", "rep"), F.expr("cls = k and more = k2 and n = m"), "left")
    node = node.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("rep")).alias("rep"))
    out = node.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "rep", "doc_id")).alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
