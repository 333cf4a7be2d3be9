"""Interpolated modified Kneser-Ney model of trusted text, and the perplexity of every document under it.

The model is over the bytes of a text whose words are joined by one space. An n-gram of ORDER bytes runs across the ends of words, so a
byte depends on the end of the word before. An n-gram is packed into one integer, so no two share a key. A language has a model of its own.
Every text is scored by text that it was not counted in: a trusted text is scored by the model of the other half of trusted texts, so that
the threshold, which comes from trusted texts, is one for texts that the model has not seen.

Texts are read twice and never shuffled. First, each chunk (a split of the input) yields its different n-grams once, with their counts in
trusted text. They are dealt to shards by language and the last two bytes of the context, which all orders above two have in common. A shard
joins the trusted counts of all chunks and yields the counts of counts, from which the discounts come (three an order), and its share of the
orders below, of which there are at most 65,536 n-grams a language. Then a shard joins its model with the n-grams that the chunks ask for,
and answers with their log probabilities. Second, each chunk reads its answers from the shared folder and sums them by document. What a
task holds is a chunk's different n-grams, or a shard's; both shares shrink with more splits or more shuffle partitions.

Words as units were tried: on check_s 27.1 million words make 12.5 million different pairs, so joins of documents with counts of pairs
write several times the input."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import words
from .shared import drop, files_of, release, shrink_executors, stored, trim
from .splits import at, by_split, column, dealt, flat, lists, runs_of, summed

ORDER = 5
QUANTILE = 0.995  # of trusted texts' perplexity, by language
MARGIN = 1.15  # times the quantile's perplexity, from which a text is rejected
BLOCK = 1 << 18  # bytes of text handled at once
PENDING = 400_000  # n-grams of a language and half that wait for being counted together
BROADCAST_IDS = 2_000_000
#: A text is in half 0 or 1 of trusted text, or not trusted.
NOT_TRUSTED = 2


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram ending at each byte, index of its text) of texts of words joined and closed by a space, each after order - 1 zero bytes."""
    pad = b"\0" * (order - 1)
    buf = np.frombuffer(pad + pad.join(texts), np.uint8)
    doc = np.repeat(np.arange(len(texts)), [len(t) + (order - 1 if i + 1 < len(texts) else 0) for i, t in enumerate(texts)])
    key = np.zeros(len(doc), np.int64)
    for k in range(order):
        key = key << 8 | buf[k : len(doc) + k]
    real = buf[order - 1 :] != 0
    return key[real], doc[real]


def plain(text: str | None) -> bytes:
    """The text's words, joined and closed by a space. A zero byte, which would look like padding, becomes a one."""
    ws = (text or "").encode("utf-8", "replace").replace(b"\0", b"\1").split()
    return b" ".join([*ws, b""]) if ws else b""


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, str, int, np.ndarray, list[bytes]]]:
    """Runs of rows of one chunk, language and half: (chunk, lang, half, row indexes, texts). Columns chunk, lang, half, text come first."""
    chunk, lang, half = (batch.column(i).to_pylist() for i in range(3))
    held: dict = {}
    last = None
    for i, text in enumerate(words.each(batch.column(3))):
        if chunk[i] != last:
            for k, (rows, run, _) in held.items():
                yield *k, np.array(rows), run
            held, last = {}, chunk[i]
        t = plain(text)
        if not t:
            continue
        rows, run, size = held.setdefault((chunk[i], lang[i], half[i]), ([], [], [0]))
        rows.append(i)
        run.append(t)
        size[0] += len(t)
        if size[0] > BLOCK:
            yield chunk[i], lang[i], half[i], np.array(rows), run
            del held[(chunk[i], lang[i], half[i])]
    for k, (rows, run, _) in held.items():
        yield *k, np.array(rows), run


class Tally:
    """Different n-grams with their counts, summed as they come."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, key: np.ndarray) -> None:
        self.parts.append(np.unique(key, return_counts=True))
        self.waiting += len(self.parts[-1][0])
        if self.waiting > PENDING and len(self.parts) > 1:
            self.parts = [self.sums()]
            self.waiting = 0

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        key, n = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        return summed(key, n)


def shard_of(key: np.ndarray, lang: str, shards: int) -> np.ndarray:
    """By language and the last two bytes of the context."""
    salt = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
    return (words.mix((key >> 8 & 0xFFFF).astype(np.uint64) ^ salt) % np.uint64(shards)).astype(np.int32)


KEYS = "shard int, chunk string, lang string, half int, keys array<long>, n array<long>"


def _keys(shards: int, order: int):
    """Of each chunk, by language and half, the different n-grams with their counts, dealt to shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        held: dict[tuple[str, int], Tally] = {}
        last = None

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, half), tally in held.items():
                key, n = tally.sums()
                shard = shard_of(key, lang, shards)
                by, cuts, shard = dealt(key, shard)
                key, n, m = key[by], n[by], len(shard)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), pa.array([last] * m, pa.string()), pa.array([lang] * m, pa.string()), pa.array(np.full(m, half, np.int32)), lists(key, cuts), lists(n, cuts)],
                    names=["shard", "chunk", "lang", "half", "keys", "n"],
                )

        for b in batches:
            for chunk, lang, half, _, run_ in _runs(b):
                if chunk != last:
                    yield from out()
                    held, last = {}, chunk
                tally = held.setdefault((lang, half), Tally())
                tally.add(grams(run_, order)[0])
        yield from out()

    return run


def suffixes(key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Different last k bytes of sorted different n-grams, and of how many each is the end."""
    return np.unique(key & ((1 << 8 * k) - 1), return_counts=True)


MODEL = "shard int, lang string, keys array<long>, n0 array<long>, n1 array<long>, variant array<int>, low array<int>, times array<long>, counts array<long>"


def _merge(order: int):
    """Per shard and language the trusted counts of both halves; per variant (half 0, half 1, both) its number of n-grams of the two
    orders below and the counts of counts of the others."""

    def row(shard: int, lang: str, parts: list) -> pa.RecordBatch:
        halves = [summed(*(np.concatenate([p[i] for p in parts if p[0] == h] or [np.zeros(0, np.int64)]) for i in (1, 2))) for h in (0, 1)]
        key = np.union1d(halves[0][0], halves[1][0])
        n = np.zeros((2, len(key)), np.int64)
        for h, (k, c) in enumerate(halves):
            n[h, np.searchsorted(key, k)] = c
        variant, low, times, counts = [], [], [], []
        for v, c in enumerate((n[0], n[1], n[0] + n[1])):
            k, c = key[c > 0], c[c > 0]
            for level in range(order, 2, -1):
                counts += [v, level, *(int((c == i).sum()) for i in (1, 2, 3, 4))]
                k, c = suffixes(k, level - 1)
            variant.append(np.full(len(k), v, np.int32))
            low.append(k.astype(np.int32))
            times.append(c)
        cols = [pa.array([shard], pa.int32()), pa.array([lang])]
        cols += [lists(x, np.array([0, len(x)])) for x in (key, n[0], n[1], np.concatenate(variant), np.concatenate(low), np.concatenate(times), np.array(counts, np.int64))]
        return pa.RecordBatch.from_arrays(cols, names=["shard", "lang", "keys", "n0", "n1", "variant", "low", "times", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        last, parts = None, []
        for where, rows in runs_of(batches, "shard", "lang", "half"):
            if where[:2] != last:
                if parts:
                    yield row(*last, parts)
                last, parts = where[:2], []
            parts.append((where[2], flat(rows, "keys"), flat(rows, "n")))
        if parts:
            yield row(*last, parts)

    return run


def discounts(r: np.ndarray) -> np.ndarray:
    """What is taken from n-grams seen once, twice and more often, from the counts of counts r[1..4] (r[0] is unused), in safe bounds."""
    y = r[1] / max(r[1] + 2 * r[2], 1)
    raw = [i - (i + 1) * y * r[i + 1] / max(r[i], 1) for i in (1, 2, 3)]
    return np.array([min(max(x, 0.1 * i), 0.95 * i) for i, x in zip((1, 2, 3), raw, strict=True)])


class Level:
    """The n-grams of one order with their probabilities, and the back-off weights of their contexts; keys are sorted."""

    def __init__(self, key: np.ndarray, n: np.ndarray, d: np.ndarray, lower: np.ndarray):
        """lower: the probability of each n-gram's end under the order below."""
        off = d[np.minimum(n, 3) - 1]
        self.key = key
        self.context, back = np.unique(key >> 8, return_inverse=True)
        total, taken = np.bincount(back, n), np.bincount(back, off)
        self.gamma = taken / total
        self.p = (n - off) / total[back] + self.gamma[back] * lower


def probability(levels: list[Level], key: np.ndarray) -> np.ndarray:
    """The interpolated probability of each n-gram. levels: from order 1 up; none: uniform over bytes."""
    weight, p, open_ = np.ones(len(key)), np.zeros(len(key)), np.ones(len(key), bool)
    for k in range(len(levels), 0, -1):
        i = np.flatnonzero(open_)
        part = key[i] & ((1 << 8 * k) - 1)
        j, hit = at(levels[k - 1].key, part)
        p[i[hit]] = weight[i[hit]] * levels[k - 1].p[j[hit]]
        open_[i[hit]] = False
        i, part = i[~hit], part[~hit]
        j, hit = at(levels[k - 1].context, part >> 8)
        weight[i[hit]] *= levels[k - 1].gamma[j[hit]]
    p[open_] = weight[open_] / 256
    return p


def low_levels(key2: np.ndarray, n2: np.ndarray) -> list[Level]:
    """Orders 1 and 2 from the pairs of bytes and how many different bytes stand before each."""
    key1, n1 = suffixes(key2, 1)
    out = []
    for k, n in ((key1, n1), (key2, n2)):
        lower = probability(out, k)
        out.append(Level(k, n, discounts(np.bincount(np.minimum(n, 5), minlength=6)[:5]), lower))
    return out


def high_levels(low: list[Level], key: np.ndarray, n: np.ndarray, taken: dict[int, np.ndarray], order: int) -> list[Level]:
    """All orders, from a shard's n-grams of the highest. taken: the discounts of orders 3 and up."""
    steps = [(key, n)]
    for k in range(order - 1, 2, -1):
        steps.append(suffixes(steps[-1][0], k))
    out = list(low)
    for k, (x, c) in zip(range(3, order + 1), reversed(steps), strict=True):
        out.append(Level(x, c, taken[k], probability(out, x & ((1 << 8 * (k - 1)) - 1))))
    return out


ANSWERS = "chunk string, lang string, half int, keys array<long>, logp array<float>"


def _answers(small: dict, order: int):
    """Joins a shard's model with the n-grams that chunks ask for. small: (lang, variant) -> orders 1 and 2, discounts of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        where, models = None, {}
        for (shard, lang, asked), rows in runs_of(batches, "shard", "lang", "asked"):
            if (shard, lang) != where:
                where, models = (shard, lang), {}
            if not asked:
                key, n0, n1 = (flat(rows, c) for c in ("keys", "n", "n1"))
                for v, n in enumerate((n0, n1, n0 + n1)):
                    if (lang, v) in small:
                        low, taken = small[(lang, v)]
                        models[v] = high_levels(low, key[n > 0], n[n > 0], taken, order)
                continue
            half = np.asarray(column(rows, "half"))
            key = flat(rows, "keys")
            cuts = np.concatenate(([0], np.cumsum(np.diff(np.asarray(column(rows, "keys").offsets)))))
            logp = np.zeros(len(key), np.float32)
            for i, h in enumerate(half.tolist()):
                v = 1 - h if h != NOT_TRUSTED and (lang, 1 - h) in small else 2
                some = slice(cuts[i], cuts[i + 1])
                levels = models.get(v) or (small[(lang, v)][0] if (lang, v) in small else [])
                logp[some] = np.log(probability(levels, key[some]))
            names = ["chunk", "lang", "half"]
            yield pa.RecordBatch.from_arrays([*(column(rows, c) for c in names), lists(key, cuts), lists(logp, cuts)], names=[*names, "keys", "logp"])

    return run


def _score(folder: str, order: int):
    """Per row the sum of its n-grams' log probabilities, its bytes and the share of words that repeat the one before; then columns 4 on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        last, known = None, {}
        for b in batches:
            logp, size, again = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for chunk, lang, half, rows, run_ in _runs(b):
                if chunk != last:
                    known, last = {}, chunk
                    for t in files_of(f"{folder}/chunk={chunk}"):
                        langs, halves = t["lang"].to_pylist(), t["half"].to_pylist()
                        for i, k in enumerate(zip(langs, halves, strict=True)):
                            known.setdefault(k, []).append([np.asarray(t[c][i].values) for c in ("keys", "logp")])
                    for k, parts in known.items():
                        key, p = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
                        by = np.argsort(key)
                        known[k] = key[by], p[by]
                keys, values = known.get((lang, half), (np.zeros(0, np.int64), np.zeros(0, np.float32)))
                key, doc = grams(run_, order)
                i, hit = at(keys, key)
                if not hit.all():
                    raise RuntimeError("the input was split in another way than before; store it first")
                logp[rows] = np.bincount(doc, values[i].astype(np.float64), len(run_))
                size[rows] = [len(t) for t in run_]
                w = words.Words([t[:-1] for t in run_])
                h = w.word_hashes()
                same = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
                again[rows] = np.bincount(w.doc[1:][same], minlength=len(run_)) / np.maximum(w.n, 1)
            own = [pa.array(logp), pa.array(size), pa.array(again)]
            yield pa.RecordBatch.from_arrays([*own, *b.columns[4:]], names=["logp", "n_bytes", "repeats", *b.schema.names[4:]])

    return run


def scored(rows: DataFrame, carry: list[str], order: int = ORDER) -> DataFrame:
    """logp, n_bytes, repeats of each of rows, with the columns carry. rows: text, lang (not null), half (0 and 1 are trusted text, 2 is
    not), chunk. A text without words has 0 bytes."""
    spark = rows.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("chunk", "lang", "half", "text", *carry)
    shrink_executors(spark)
    keys, keys_at = stored(rows.select("chunk", "lang", "half", "text").mapInArrow(_keys(shards, order), KEYS), "kn-keys")
    dealt = keys.where(f"half <> {NOT_TRUSTED}").select("shard", "lang", "half", "keys", "n").repartition(shards, "shard").sortWithinPartitions("shard", "lang", "half")
    model, model_at = stored(dealt.mapInArrow(_merge(order), MODEL), "kn-model")
    small = _small(model, order)
    none = F.lit(None)
    known = model.select("shard", "lang", F.lit(False).alias("asked"), none.cast("string").alias("chunk"), none.cast("int").alias("half"), "keys", F.col("n0").alias("n"), "n1")
    empty = F.array().cast("array<long>")
    asked = keys.select("shard", "lang", F.lit(True).alias("asked"), "chunk", "half", "keys", empty.alias("n"), empty.alias("n1"))
    both = known.union(asked).repartition(shards, "shard").sortWithinPartitions("shard", "lang", "asked")
    shrink_executors(spark)
    answers = both.mapInArrow(_answers(small, order), ANSWERS)
    _, answers_at = stored(answers.repartition(shards, "chunk"), "kn-answers", partition="chunk")
    drop(spark, keys_at)
    drop(spark, model_at)
    release(spark)
    shrink_executors(spark)
    types = dict(rows.dtypes)
    out = rows.mapInArrow(_score(answers_at, order), ", ".join(["logp double", "n_bytes long", "repeats double", *(f"`{c}` {types[c]}" for c in carry)]))
    out, _ = stored(out, "kn-scores")
    drop(spark, answers_at)
    return out


def _small(model: DataFrame, order: int) -> dict:
    """(lang, variant) -> (orders 1 and 2, discounts of the orders above): at most 65,536 pairs of bytes a language."""
    low = model.select("lang", F.explode(F.arrays_zip("variant", "low", "times")).alias("x"))
    low = low.groupBy("lang", "x.variant", "x.low").agg(F.sum("x.times").alias("n")).orderBy("lang", "variant", "low").collect()
    counts = model.select("lang", F.posexplode("counts").alias("i", "c")).groupBy("lang", "i").agg(F.sum("c").alias("c"), F.max("c").alias("one")).collect()
    by: dict = {}
    for r in counts:
        by.setdefault(r.lang, {})[r.i] = (r.c, r.one)
    pairs: dict = {}
    for r in low:
        pairs.setdefault((r.lang, r.variant), []).append((r.low, r.n))
    out = {}
    for (lang, v), x in pairs.items():
        k, n = np.array(x, np.int64).T
        taken = {}
        for i in range(0, len(by[lang]), 6):
            (_, variant), (_, level) = by[lang][i], by[lang][i + 1]  # the same in all shards
            if variant == v:
                taken[level] = discounts(np.array([0, *(by[lang][i + j][0] for j in range(2, 6))]))
        out[(lang, v)] = low_levels(k, n), taken
    return out


def quality(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang, perplexity, threshold, n_bytes, kept of every row of docs; or the columns carry of docs, with kept.

    Trusted text is that of rows labelled quality 1. A language's threshold is margin times the quantile of its trusted texts' perplexity,
    each under the model of the half of trusted texts that it is not in (of all, where the other half is empty);
    a language without trusted text has none, and its texts are kept. A word said over and over is likely if the word is, so perplexity can't
    tell it: a text is rejected too if more of its words repeat the one before than margin times the same quantile of trusted texts'. A null
    lang is a language of its own. A null, empty or blank text has no perplexity and is rejected. Rows that repeat a doc_id are judged each
    by its text; a doc_id labelled twice is trusted if any of its labels says so; a null doc_id is never trusted. Long texts are scored
    whole. Other columns are not read. An empty table gives an empty result."""
    spark = docs.sparkSession
    keep = carry or ["doc_id"]
    docs = docs.select(*[F.col(c).alias(f"own_{c}") for c in keep], F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    good, good_at = stored(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct(), "kn-trusted")
    good = good.withColumn("good", F.lit(True))
    if good.count() <= BROADCAST_IDS:
        docs = by_split(docs, "kn-rows").join(F.broadcast(good), "id", "left")
    else:
        docs = by_split(docs.join(good, "id", "left"), "kn-rows")
    half = F.when(F.col("good"), F.pmod(F.xxhash64("id"), F.lit(2)).cast("int")).otherwise(NOT_TRUSTED)
    own = [f"own_{c}" for c in keep]
    rows = docs.select("chunk", "lang", half.alias("half"), "text", *own, F.col("lang").alias("own_lang_"), half.alias("own_half_"))
    out = scored(rows, [*own, "own_lang_", "own_half_"], order)
    drop(spark, good_at)
    out = out.withColumn("perplexity", F.when(F.col("n_bytes") > 0, F.exp(-F.col("logp") / F.col("n_bytes"))))
    most = [(F.percentile_approx(c, F.lit(quantile), F.lit(20000)) * margin).alias(n) for c, n in (("perplexity", "threshold"), ("repeats", "limit"))]
    limits = out.where(f"own_half_ <> {NOT_TRUSTED} and perplexity is not null").groupBy("own_lang_").agg(*most)
    out = out.join(F.broadcast(limits), "own_lang_", "left")  # one row a language
    kept = F.coalesce((F.col("perplexity") <= F.coalesce("threshold", F.lit(float("inf")))) & (F.col("repeats") <= F.coalesce("limit", F.lit(1.0))), F.lit(False))
    if carry:
        return out.select(*[F.col(f"own_{c}").alias(c) for c in carry], kept.alias("kept"))
    return out.select(F.col("own_doc_id").alias("doc_id"), F.when(F.col("own_lang_") != "", F.col("own_lang_")).alias("lang"), "perplexity", "threshold", "n_bytes", kept.alias("kept"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
