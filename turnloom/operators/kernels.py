"""Queries whose kernels SQL cannot express: the decoder's grammar, similarity, loop detectors, assignment and the revision ledger."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import turns as T
from ..functions.alignment import align, revisions
from ..functions.matching import assign
from ..functions.voices import Calibrator, constrained
from ..identity.evidence import Candidate, VoiceProfile
from ..plans import catalog
from ..session import shards
from ..streaming import binding, ledger, replay

#: What Python's \\s matches.
SPACES = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
LEAST_COSINE = 0.1  # of the calibration query: the vectors of one class are less alike than one voice's

# Types, not texts: a text is parsed by a running Spark, which an import may not need.
TURNS = ArrayType(StructType([StructField("start", DoubleType()), StructField("end", DoubleType()), StructField("speaker", StringType()), StructField("text", StringType())]))


def _parsed(how):
    @F.pandas_udf(TURNS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [x._asdict() for x in how(t or "")])

    return run


@F.pandas_udf(DoubleType())
def similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([T._similar(T.normal(x or ""), T.normal(y or "")) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(BooleanType())
def akin(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([T.related(T.Turn(0, 0, "", x or ""), T.Turn(0, 0, "", y or "")) for x, y in zip(a, b, strict=True)], dtype=bool)


@F.pandas_udf(BooleanType())
def repeats(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: T.repeats(t or ""))


@F.pandas_udf(BooleanType())
def short_text_loop(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: T.short_text_loop(t or ""))


def rendered(dialog: DataFrame) -> DataFrame:
    """Each turn as decoder text."""
    stamp = lambda c: F.concat(F.lit("["), (F.col(c) / 1000).cast("string"), F.lit("]"))
    return dialog.select("rec", "turn", F.concat(stamp("start_ms"), F.lit("["), F.col("label"), F.lit("]"), F.coalesce("text", F.lit("")), stamp("end_ms")).alias("raw"))


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return catalog.view(spark, sf_dir, name)


def parse_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that the grammar finds in each rendered turn."""
    found = rendered(_view(spark, sf_dir, "dialog")).select("rec", "turn", F.posexplode(_parsed(T.parse)("raw")).alias("place", "t"))
    return found.select("rec", "turn", "place", F.round(F.col("t.start") * 1000).cast("long").alias("start_ms"), F.round(F.col("t.end") * 1000).cast("long").alias("end_ms"), F.col("t.speaker").alias("speaker"), F.sha2("t.text", 256).alias("text_sha"))


def parser_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns on which the two parsers differ: none."""
    return rendered(_view(spark, sf_dir, "dialog")).where(_parsed(T.parse)("raw") != _parsed(T.reparse)("raw")).select("rec", "turn")


def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each turn to the turn before it, and whether they are related."""
    w = Window.partitionBy("rec").orderBy("turn")
    d = _view(spark, sf_dir, "dialog").withColumn("before", F.lag("text").over(w)).where("before is not null")
    return d.select("rec", "turn", F.round(similar("before", "text"), 6).alias("similarity"), akin("before", "text").alias("related"))


def repetition_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that end in a runaway loop; every fourth one is given such an end."""
    t = _view(spark, sf_dir, "texts").withColumn("text", F.when(F.col("id") % 4 == 0, F.concat("text", F.repeat(F.lit("ha "), (F.col("id") % 16).cast("int")))).otherwise(F.col("text")))
    # Only the last characters that are no space decide, so long texts stay out of Python. Most have enough of them in a short end.
    near, bare = F.right("text", F.lit(2 * T.LOOP_TAIL)), lambda c: F.right(F.regexp_replace(c, SPACES, ""), F.lit(T.LOOP_TAIL))
    tail = F.when((F.length("text") <= 2 * T.LOOP_TAIL) | (F.length(bare(near)) >= T.LOOP_TAIL), bare(near)).otherwise(bare(F.col("text")))
    return t.where(repeats(tail)).select("id")


def marker_text_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings whose rendered turns end in a dense loop of very short texts. A recording's last turns decide, so only these are gathered."""
    w = Window.partitionBy("rec").orderBy(F.desc("turn"))
    last = rendered(_view(spark, sf_dir, "dialog")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= T.SHORT_TAIL // 8)
    text = last.groupBy("rec").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "raw"))), lambda x: x["raw"]), "").alias("raw"))
    return text.where(short_text_loop("raw")).select("rec")


WINDOWS = 200  # rows of nested turns that are Python objects at a time


def _few(how):
    """how(parts of pandas), fed from Arrow by a few rows at a time: a row is a window's turns, and a batch of them as objects is large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (pd.DataFrame({n: c.to_pylist() for n, c in zip(b.schema.names, b.slice(i, WINDOWS).columns, strict=True)}) for b in batches for i in range(0, b.num_rows, WINDOWS))
        for p in how(parts):
            yield pa.RecordBatch.from_pandas(p, preserve_index=False)

    return run


def _assigned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        out = []
        for rec, edges in zip(p["rec"], p["edges"], strict=True):
            w = {(e["local"], e["output"]): float(e["score"]) for e in edges}
            got = assign(sorted({a for a, _ in w}), sorted({b for _, b in w}), w)
            out += [(rec, a, b, w[a, b]) for a, b in sorted(got.items())]
        yield pd.DataFrame(out, columns=["rec", "local", "output", "score"]).astype({"rec": "int64", "score": "float64"})


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per recording the one-to-one assignment of snapshot labels to dialog labels by shared time. A recording has few labels, so its table of
    scores is small however many turns it has: scores are summed before they are gathered."""
    s, d = _view(spark, sf_dir, "snapshots").alias("s"), _view(spark, sf_dir, "dialog").alias("d")
    met = s.join(d, F.expr("s.rec = d.rec AND s.start_ms < d.end_ms AND d.start_ms < s.end_ms"))
    score = F.sum(F.least("s.end_ms", "d.end_ms") - F.greatest("s.start_ms", "d.start_ms")).alias("score")
    edges = met.groupBy("s.rec", F.col("s.label").alias("local"), F.col("d.label").alias("output")).agg(score)
    return edges.groupBy("rec").agg(F.collect_list(F.struct("local", "output", "score")).alias("edges")).mapInPandas(_assigned, "rec long, local string, output string, score double")


def revision_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.revision_ledger(_view(spark, sf_dir, "dialog"))


def _heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dialog's turns with a voice each: a vector of the class that stands for the recording's label, so that one label sounds alike."""
    w = Window.partitionBy("label").orderBy("id")
    voices = _view(spark, sf_dir, "voices").withColumn("place", F.row_number().over(w) - 1).select(F.col("label").cast("long").alias("class"), "place", "v")
    per = voices.groupBy("class").agg(F.count(F.lit(1)).alias("n"))  # one row a class
    d = _view(spark, sf_dir, "dialog").withColumn("class", F.pmod(F.col("rec") * 3 + F.substring("label", 2, 2).cast("long"), F.lit(10)))
    d = d.join(F.broadcast(per), "class", "left").withColumn("place", F.pmod(F.xxhash64("rec", "turn"), F.col("n")).cast("int"))
    turns = d.join(voices, ["class", "place"], "left")
    seconds = [(F.col(f"{c}_ms") / 1000).alias(c) for c in ("start", "end")]
    return turns.select("rec", F.ceil(F.col("end_ms") / 2000).alias("tick"), F.col("turn").cast("long").alias("turn"), *seconds, F.col("label").alias("local"), F.col("v").alias("voice"), "text")


def speaker_binding_fixed_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lasting labels of the dialog's turns by thresholds."""
    return binding.bind(_heard(spark, sf_dir))


def speaker_binding_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lasting labels of the dialog's turns by the identity model."""
    return binding.bind(_heard(spark, sf_dir), "identity")


def published_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's turns under lasting labels: committed, bound and published tick by tick."""
    h = _heard(spark, sf_dir).select("rec", F.round(F.col("start") * 1000).cast("long").alias("start_ms"), F.round(F.col("end") * 1000).cast("long").alias("end_ms"), F.col("local").alias("label"), "text", "voice")
    return replay.published_speakers(h)


def speaker_binding_clean_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lasting labels of the dialog's turns by clean voice profiles."""
    return binding.bind(_heard(spark, sf_dir), "clean-core")


def _calibrated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, review, rows = None, Calibrator(cosine=LEAST_COSINE), []
    for b in batches:
        for rec, id_, assigned, voice in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if rec != last:
                last, review = rec, Calibrator(cosine=LEAST_COSINE)
            rows.append((rec, id_, assigned, review.review(assigned, voice, 2.0)))
        moved = [r for r in rows if r[2] != r[3]]
        cols = list(zip(*moved, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["rec", "id", "assigned", "pick"])
        rows = []


def calibration_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors, in recordings of 250, whose given label (of every ninth the next one) gives way to one that sounds nearer by what was heard before."""
    v = _view(spark, sf_dir, "units").select(F.expr("id div 250").alias("rec"), F.col("id").cast("long").alias("id"), F.when(F.col("id") % 9 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("string").alias("assigned"), "u")
    return v.repartition("rec").sortWithinPartitions("rec", "id").mapInArrow(_calibrated, "rec long, id long, assigned string, pick string")


def _chosen(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        out = []
        for rec, edges in zip(p["rec"], p["edges"], strict=True):
            rows: dict = {}
            for e in edges:
                rows.setdefault(e["local"], {})[e["output"]] = float(e["score"])
            rows = {k: {**r, f"NEW:{k}": 0.5} for k, r in rows.items()}
            out += [(rec, k, o) for k, o in constrained(rows, itertools.combinations(sorted(rows), 2)).items()]
        yield pd.DataFrame(out, columns=["rec", "local", "output"]).astype({"rec": "int64"})


def constrained_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per recording one speaker, or a new one, a local label, so that labels differ and shared seconds are most."""
    s, d = _view(spark, sf_dir, "revised").alias("s"), _view(spark, sf_dir, "published").alias("d")
    met = s.join(d, F.expr("s.rec = d.rec AND s.start_ms < d.end_ms AND d.start_ms < s.end_ms"))
    score = (F.sum(F.least("s.end_ms", "d.end_ms") - F.greatest("s.start_ms", "d.start_ms")) / 1000).alias("score")
    edges = met.groupBy("s.rec", F.col("s.local").alias("local"), F.col("d.label").alias("output")).agg(score)
    return edges.groupBy("rec").agg(F.collect_list(F.struct("local", "output", "score")).alias("edges")).mapInPandas(_chosen, "rec long, local string, output string")


def _matched(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        out = []
        for rec, tick, now, then in zip(p["rec"], p["tick_ms"], p["now"], p["then"], strict=True):
            sides = [{f"{t['turn']:06d}": T.Turn(t["s"] / 1000, t["e"] / 1000, "", t["text"] or "") for t in side} for side in (now, then)]
            out += [(rec, tick, int(a), int(b)) for a, b in revisions(*sides).items()]
        yield pd.DataFrame(out, columns=["rec", "tick_ms", "turn", "pending"]).astype("int64")


def pending_revision_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a snapshot that revise a turn that the snapshot before showed cut short."""
    turns = F.collect_list(F.struct("turn", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), "text"))
    r, dealt = _view(spark, sf_dir, "revised"), (shards(spark), "rec", "tick_ms")
    now = r.repartition(*dealt).groupBy("rec", "tick_ms").agg(turns.alias("now"))
    then = r.where("not whole").withColumn("tick_ms", F.col("tick_ms") + 2000).repartition(*dealt).groupBy("rec", "tick_ms").agg(turns.alias("then"))
    return now.join(then, ["rec", "tick_ms"]).mapInArrow(_few(_matched), "rec long, tick_ms long, turn long, pending long")


def _deduped(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        out = []
        for rec, tick, turns in zip(p["rec"], p["tick_ms"], p["turns"], strict=True):
            kept = ledger.distinct([T.Turn(t["s"] / 1000, t["e"] / 1000, t["local"], t["text"] or "") for t in turns], ledger.Rules())
            out += [(rec, tick, round(t.start * 1000), round(t.end * 1000), t.speaker) for t in kept]
        yield pd.DataFrame(out, columns=["rec", "tick_ms", "start_ms", "end_ms", "local"]).astype({"rec": "int64", "tick_ms": "int64", "start_ms": "int64", "end_ms": "int64"})


def snapshot_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each snapshot without repeated segmentations of one utterance; every third turn is shown twice, the second time cut by a tenth."""
    r = _view(spark, sf_dir, "revised").select("rec", "tick_ms", "turn", "local", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), "text")
    again = r.where("turn % 3 = 0 and e - s >= 10").withColumn("e", F.col("e") - F.floor((F.col("e") - F.col("s")) / 10)).withColumn("text", F.expr("substring(text, 1, cast(length(text) * 0.9 as int))"))
    shots = r.union(again).repartition(shards(spark), "rec", "tick_ms").groupBy("rec", "tick_ms").agg(F.collect_list(F.struct("local", "s", "e", "text")).alias("turns"))  # one window's turns
    return shots.mapInArrow(_few(_deduped), "rec long, tick_ms long, start_ms long, end_ms long, local string")


def _aligned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["rec", "tick_ms", "local", "best", "score", "row_margin", "column_margin", "selected"]
    for p in parts:
        out = []
        for rec, tick, now, then in zip(p["rec"], p["tick_ms"], p["now"], p["then"], strict=True):
            sides = [[T.Turn(t["s"] / 1000, t["e"] / 1000, t["who"], t["text"] or "") for t in side] for side in (now, then)]
            out += [(rec, tick, local, a.best, max(a.scores.values()), a.row_margin, a.column_margin, a.selected) for local, a in align(*sides).items()]
        yield pd.DataFrame(out, columns=names).astype({"rec": "int64", "tick_ms": "int64", "score": "float64", "row_margin": "float64", "column_margin": "float64"})


def snapshot_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each snapshot's labels aligned one to one with the speakers published before its tick, with margins and uniqueness."""
    turn = lambda who: F.collect_list(F.struct(F.col(who).alias("who"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), "text"))
    now = _view(spark, sf_dir, "revised").groupBy("rec", "tick_ms", "from_ms").agg(turn("local").alias("now"))
    p = _view(spark, sf_dir, "published").select(F.col("rec").alias("r"), "label", "start_ms", "end_ms", "seen_ms", "text")
    then = now.select("rec", "tick_ms", "from_ms").join(p, F.expr("rec = r and seen_ms < tick_ms and end_ms > from_ms")).groupBy("rec", "tick_ms").agg(turn("label").alias("then"))
    return now.join(then, ["rec", "tick_ms"]).mapInArrow(_few(_aligned), "rec long, tick_ms long, local string, best string, score double, row_margin double, column_margin double, selected string")


def _profiled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        out = []
        for label, items in zip(p["label"], p["items"], strict=True):
            profile = VoiceProfile(most=4)
            profile.derive([Candidate(f"{c['id']:08d}", np.array(c["u"]), float(c["id"] % 3), float(c["coverage"]), purity=float(c["purity"])) for c in items])
            out.append((label, profile.state, list(profile.active), len(profile.quarantine)))
        yield pd.DataFrame(out, columns=["label", "state", "active", "quarantined"]).astype({"quarantined": "int64"})


def voice_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label the profile that its twelve heaviest vectors make: complete-linkage clusters, greedy choice, state."""
    w = Window.partitionBy("label").orderBy(F.desc(F.round("weight", 9)), "id")
    top = _view(spark, sf_dir, "weighed").withColumn("place", F.row_number().over(w)).where("place <= 12")
    items = top.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("id", "u", "coverage", "purity"))).alias("items"))
    return items.mapInPandas(_profiled, "label int, state string, active array<string>, quarantined long")


_ALL = (parse_transcript, parser_agreement, text_similarity, repetition_loop, marker_text_loop, assignment, snapshot_duplicates, snapshot_alignment, voice_clusters, revision_ledger, calibration_pick, constrained_assignment, pending_revision_match, speaker_binding_fixed_cosine, speaker_binding_identity, speaker_binding_clean_core, published_speakers)
QUERIES = {f.__name__: f for f in _ALL}
#: The grammar read back what was rendered: the dialog itself, without turns whose text is blank.
ORACLE = {"parse_transcript": "SELECT rec, turn, CAST(0 AS integer) AS place, start_ms, end_ms, label AS speaker, sha256(trim(text)) AS text_sha FROM $dialog WHERE trim(text) <> ''"}
