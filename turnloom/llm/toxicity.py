"""Counterfactual-regularised toxicity classifier.

Features are the words of a text and the first 4, 5 and 6 bytes of longer words, present or not, as 64-bit hashes (nothing is folded into
buckets). Features whose presence differs most between the labels are chosen over the whole training sample; on them a logistic regression
is fitted by Newton's method. In labelled texts identity terms are swapped for other terms of their group, and the squared change of the
score is penalised, so that a mere mention of a group moves no score. The training sample is bounded (SAMPLE a label); every text is scored
whole."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import words
from .shared import stored

SAMPLE = 5000  # training texts a label, at most: the labelled rows with the smallest hashes
FEATURES = 600
PREFIXES = (4, 5, 6)
LEAST_Z = 3.5
RIDGE = 0.2
SWAP = 2.0  # weight of the counterfactual penalty
THRESHOLD = 0.7
#: Terms that may stand for each other: fixed values, by language and category. A term may be in tables of several languages.
IDENTITY = {
    "en": (
        "women men girls boys",
        "woman man girl boy",
        "wife husband",
        "muslim christian jewish hindu buddhist atheist catholic",
        "muslims christians jews hindus buddhists atheists catholics",
        "black white asian latino arab african european",
        "gay lesbian straight bisexual transgender queer",
        "immigrant refugee foreigner native",
        "immigrants refugees foreigners natives",
        "disabled deaf blind",
        "elderly young",
    ),
    "de": ("frauen männer mädchen jungen", "frau mann", "muslimisch christlich jüdisch", "muslime christen juden", "schwarz weiß", "schwul lesbisch hetero"),
    "fr": ("femmes hommes", "femme homme", "musulman chrétien juif", "musulmans chrétiens juifs", "noir blanc", "gai hétéro", "lesbienne hétérosexuelle"),
    "es": ("mujeres hombres", "mujer hombre", "musulmán cristiano judío", "musulmanes cristianos judíos", "negro blanco", "gay hetero", "lesbiana heterosexual"),
}
MARKS = ".,!?;:\"'()[]*#$%&|-"  # punctuation at a word's ends


def features(norm: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all words of some normalised texts, with repeats."""
    w = words.Words(norm)
    # Punctuation at a word's ends is not part of its feature.
    mark = np.zeros(256, bool)
    mark[[*MARKS.encode()]] = True
    s, e = w.start.copy(), w.end.copy()
    for _ in range(3):
        e -= (e > s) & mark[w.buf[np.maximum(e - 1, 0)]]
    s += (s < e) & mark[w.buf[s]]
    ok = e > s
    s, e, d = s[ok], e[ok], w.doc[ok]
    docs, feats = [d], [w.hashes(s, e)]
    for k in PREFIXES:
        long = e - s > k
        docs.append(d[long])
        feats.append(words.mix(w.hashes(s[long], s[long] + k) + np.uint64(k)))
    return np.concatenate(docs), np.concatenate(feats)


def _turns(tables, step: int) -> dict[str, dict[str, str]]:
    """Per language each term's stand-in: the one step places on in its category."""
    return {lang: {t: ts[(i + step) % len(ts)] for g in groups for ts in [g.split()] for i, t in enumerate(ts)} for lang, groups in tables.items()}


def swaps(norm: bytes, tables=IDENTITY) -> list[bytes]:
    """Counterfactuals of a text: each with every identity term replaced by another of its category (the next, and the one after).

    The tables of one language are used: of the one that has the most of the text's words, the first of equals. A word is compared without
    the punctuation at its ends, which stays, and without regard to case."""
    ws = norm.decode("utf-8", "replace").split()
    cores = [w.strip(MARKS) for w in ws]
    lower = [c.lower() for c in cores]
    out: list[bytes] = []
    best = None
    for step in (1, 2):
        turns = _turns(tables, step)
        if best is None:
            hits = {lang: sum(x in turn for x in lower) for lang, turn in turns.items()}
            best = max(hits, key=hits.get, default=None)
            if best is None or not hits[best]:
                return out
        turn = turns[best]
        new = " ".join(w.replace(c, turn[x], 1) if x in turn else w for w, c, x in zip(ws, cores, lower, strict=True)).encode()
        if new != norm and new not in out:
            out.append(new)
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        label = np.asarray(b.column(1))
        for start, norm in words.blocks(b.column(0)):
            f, off = words.per_doc_unique(*features(norm), len(norm))
            y = np.repeat(label[start : start + len(norm)], np.diff(off))
            u, at = np.unique(f, return_inverse=True)
            n1, n = np.bincount(at, weights=y, minlength=len(u)), np.bincount(at, minlength=len(u))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n1.astype(np.int64)), pa.array(n.astype(np.int64))], names=["f", "n1", "n"])


def _vectors(keys: np.ndarray):
    """Per training text its label and chosen features, and those of its counterfactuals."""

    def chosen(norm: list[bytes]) -> list[list[int]]:
        f, off = words.per_doc_unique(*features(norm), len(norm))
        at = np.minimum(np.searchsorted(keys, f), len(keys) - 1)
        hit = keys[at] == f
        return [at[a:b][hit[a:b]].tolist() for a, b in zip(off[:-1], off[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(1)
            for start, norm in words.blocks(b.column(0)):
                other = [swaps(x) for x in norm]
                flat = iter(chosen([y for x in other for y in x]) if any(other) else [])
                yield pa.RecordBatch.from_arrays(
                    [label.slice(start, len(norm)), pa.array(chosen(norm), pa.list_(pa.int32())), pa.array([[next(flat) for _ in x] for x in other], pa.list_(pa.list_(pa.int32())))],
                    names=["label", "at", "other"],
                )

    return run


def fit(rows: list, n: int, swap: float = SWAP) -> np.ndarray:
    """Weights (the last is the intercept) by Newton steps on the log-likelihood, less a ridge and swap times the squared change of the
    logit under each counterfactual. rows: (label, features, counterfactuals' features)."""
    x = np.zeros((len(rows), n + 1))
    x[:, n] = 1
    y = np.array([r[0] for r in rows], float)
    diff = []
    for i, (_, at, other) in enumerate(rows):
        x[i, at] = 1
        for o in other:
            z = np.zeros(n + 1)
            z[at] = 1
            z[o] -= 1
            if z.any():
                diff.append(z)
    ridge = np.full(n + 1, RIDGE)
    ridge[n] = 1e-6
    fixed = np.diag(ridge)
    if diff:
        z = np.array(diff)
        fixed += 2 * swap * z.T @ z
    w = np.zeros(n + 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + fixed @ w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + fixed
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = FEATURES, least_z: float = LEAST_Z, swap: float = SWAP) -> tuple[np.ndarray, np.ndarray]:
    """(sorted feature hashes, weights) from labelled rows whose crc32(doc_id) mod 3 is not 1.

    At most sample rows a label are learnt from, those with the smallest hashes of doc_id, equals by doc_id; at most `most` features are
    kept, of those whose presence differs between the labels by least_z standard errors or more, the most different first, equals by hash.
    swap weighs the counterfactual penalty. A doc_id labelled twice is toxic if any of its labels says so; rows of documents that repeat a
    doc_id are each a row of the sample. Null texts and doc_ids teach nothing. Without rows of both labels there are no features, and the
    intercept is 0; an empty table is such a case."""
    lab = labels.where("doc_id is not null and toxic in (0, 1)").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    order = F.xxhash64("doc_id")
    lab = lab.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    ids = lab.where("label = 1").orderBy(order, "doc_id").limit(sample).union(lab.where("label = 0").orderBy(order, "doc_id").limit(sample))
    rows = docs.where("text is not null").join(F.broadcast(ids), "doc_id").select("text", "label")  # two labels' samples
    rows, _ = stored(rows, "toxic-sample")
    size = rows.groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n1")).first()
    if not size.n or not size.n1 or size.n1 == size.n:
        return np.zeros(0, np.uint64), np.array([0.0])
    n, n1 = float(size.n), float(size.n1)
    c = rows.mapInArrow(_counts, "f long, n1 long, n long").groupBy("f").agg(F.sum("n1").alias("a"), F.sum("n").alias("m")).where("m >= 3")
    p = F.col("m") / n
    z = (F.col("a") - F.col("m") * (n1 / n)) / F.sqrt(F.col("m") * (n1 / n) * (1 - n1 / n) * (1 - p) + 1e-9)
    top = c.withColumn("z", z).where(F.abs("z") >= least_z).orderBy(F.desc(F.abs("z")), "f").limit(most).select("f").toPandas()["f"]
    keys = np.sort(top.to_numpy(np.int64).view(np.uint64))
    if not len(keys):
        return keys, np.array([np.log(n1 / (n - n1))])
    seen = [(r.label, r.at, r.other) for r in rows.mapInArrow(_vectors(keys), "label double, at array<int>, other array<array<int>>").collect()]
    return keys, fit(sorted(seen), len(keys), swap)


def _score(keys: np.ndarray, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, norm in words.blocks(b.column(1)):
                total = np.full(len(norm), weights[-1])
                if len(keys):
                    d, f = features(norm)
                    at = np.minimum(np.searchsorted(keys, f), len(keys) - 1)
                    hit = keys[at] == f
                    pair = np.unique(d[hit] * (len(keys) + 1) + at[hit])
                    total += np.bincount(pair // (len(keys) + 1), weights=weights[pair % (len(keys) + 1)], minlength=len(norm))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(norm)), pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, keys: np.ndarray, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Null and empty texts get the intercept's score; a null doc_id counts as the text
    '' for held_out. Other columns are not read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_score(keys, weights), "doc_id long, score double")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, *train(docs, table(spark, sf_dir, "labels")))
