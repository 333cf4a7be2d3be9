"""Replays of rolling snapshots through the revision ledger, in batch and as a stream.

The decoder is simulated: at each tick it shows the turns of the last minute, cut to it, one character per CHAR_MS. A recording is replayed
in order, with the turns of one window and the ledger's bounded state in memory, however long it is."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.turns import Turn
from ..functions.voices import unit
from ..plans.views import CHAR_MS, CONTEXT_MS, STEP_MS
from ..session import shards
from .binding import Heard, ModelBinder
from .ledger import Ledger

OUT = "rec long, seq long, tick double, start double, end double, speaker string, text string"
KINDS = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.string()]
COLS = [c.split()[0] for c in OUT.split(", ")]
Spoken = tuple[int, int, str, str]  # start and end in ms, label, text


def shown(spoken: Iterable[Spoken], tick: int) -> list[Turn]:
    """The snapshot at a tick (ms): what its window shows of each turn; cut turns end open."""
    out, low = [], max(0, tick - CONTEXT_MS)
    for start, end, label, text in spoken:
        s, e = max(start, low), min(end, tick)
        if s < e:
            part = text[(s - start) // CHAR_MS : -(-(e - start) // CHAR_MS)]
            out.append(Turn(s / 1000, e / 1000, label, part + ("…" if e < end else ""), tick / 1000))
    return out


class Replay:
    """One recording: turns in order of their start go in, rows come out as ticks pass. Memory holds one window's turns."""

    def __init__(self, rec: int, binder=None):
        self.rec, self.ledger, self.seq, self.tick, self.stop = rec, Ledger(), 0, STEP_MS, 0
        self.window: list[Spoken] = []
        self.binder = binder
        self.voices: list[tuple[int, int, object]] = []  # of the window's turns

    def _step(self, tick: int, final: bool) -> Iterator[tuple]:
        low = tick - CONTEXT_MS
        self.window = [t for t in self.window if t[1] > low]
        out = self.ledger.take(tick / 1000, shown(self.window, tick), final)
        self.voices = [v for v in self.voices if v[1] > low - CONTEXT_MS]
        heard = [Heard(i, t.start, t.end, t.speaker, self._voice(t), text=t.text) for i, t in enumerate(out)]
        label = self.binder.take(heard) if self.binder else {}
        for i, t in enumerate(out):
            yield self.rec, self.seq, tick / 1000, t.start, t.end, label.get(i, t.speaker), t.text
            self.seq += 1

    def _voice(self, t: Turn):
        """The voice of the spoken turn that shares most time with a published one."""
        shared = [(min(e / 1000, t.end) - max(s / 1000, t.start), v) for s, e, v in self.voices]
        best = max(shared, key=lambda x: x[0], default=(0.0, None))
        return best[1] if best[0] > 0 else None

    def put(self, turn: Spoken, voice=None) -> Iterator[tuple]:
        while self.tick <= turn[0]:
            yield from self._step(self.tick, False)
            self.tick += STEP_MS
        self.window.append(turn)
        self.voices.append((turn[0], turn[1], voice))
        self.stop = max(self.stop, turn[1])

    def end(self) -> Iterator[tuple]:
        while self.tick < self.stop:
            yield from self._step(self.tick, False)
            self.tick += STEP_MS
        yield from self._step(max(self.stop, round(self.ledger.tick * 1000) + 1, 1), True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(COLS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, KINDS, strict=True)], names=COLS)


def _replay(bound: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: Replay | None = None
        for b in batches:
            rows: list[tuple] = []
            voices = b.column(5).to_pylist() if bound else [None] * b.num_rows
            for rec, start, end, label, text, voice in zip(*(b.column(i).to_pylist() for i in range(5)), voices, strict=True):
                if at is None or at.rec != rec:
                    rows += at.end() if at else ()
                    at = Replay(rec, ModelBinder() if bound else None)
                rows += at.put((start, end, label or "UNK", text or ""), unit(voice))
            yield _batch(rows)
        if at:
            yield _batch(list(at.end()))

    return run


def revision_ledger(dialog: DataFrame) -> DataFrame:
    """Published turns of every recording of dialog (rec, start_ms, end_ms, label, text), in order of release (seq).

    Recordings are independent and dealt by a hash; a recording is a sequence by nature, replayed by one task as a stream of sorted rows.
    Rows without rec or times are left out; a null label is UNK, a null text empty, which publishes nothing."""
    rows = dialog.where("rec is not null and start_ms is not null and end_ms is not null").select("rec", "start_ms", "end_ms", "label", "text")
    return rows.repartition(shards(rows.sparkSession), "rec").sortWithinPartitions("rec", "start_ms", "end_ms", "label", "text").mapInArrow(_replay(False), OUT)


def published_speakers(dialog: DataFrame) -> DataFrame:
    """As revision_ledger, of dialog with a voice a turn (null: none): what a tick publishes has its lasting label from the identity model, in
    the same step."""
    rows = dialog.where("rec is not null and start_ms is not null and end_ms is not null").select("rec", "start_ms", "end_ms", "label", "text", "voice")
    return rows.repartition(shards(rows.sparkSession), "rec").sortWithinPartitions("rec", "start_ms", "end_ms", "label", "text").mapInArrow(_replay(True), OUT)


def snapshots(dialog: DataFrame) -> DataFrame:
    """One row (rec, tick_ms, final, turns) per recording and tick: the input of stream_ledger."""
    spans = dialog.groupBy("rec").agg(F.max("end_ms").alias("stop"))
    ticks = spans.select("rec", "stop", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("stop") / STEP_MS)))).alias("k"))
    ticks = ticks.select("rec", F.least(F.col("k") * STEP_MS, F.greatest("stop", F.lit(1))).alias("tick_ms"), (F.col("k") * STEP_MS >= F.col("stop")).alias("final"))
    cond = "t.rec = d.rec AND d.start_ms < t.tick_ms AND d.end_ms > t.tick_ms - " + str(CONTEXT_MS)
    met = ticks.alias("t").join(dialog.alias("d"), F.expr(cond), "left")
    turn = F.when(F.col("d.rec").isNotNull(), F.struct("d.start_ms", "d.end_ms", "d.label", "d.text"))
    return met.groupBy("t.rec", "t.tick_ms", "t.final").agg(F.collect_list(turn).alias("turns"))


def _advance(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    seq, dump = state.get if state.exists else (0, None)
    ledger = Ledger.load(dump) if dump else Ledger()
    rows: list[tuple] = []
    got = [r for p in parts for r in zip(p["tick_ms"], p["final"], p["turns"], strict=True)]
    for tick, final, turns in sorted(got, key=lambda r: r[0]):
        if tick / 1000 <= ledger.tick:
            continue  # replayed input
        spoken = sorted((t["start_ms"], t["end_ms"], t["label"] or "UNK", t["text"] or "") for t in turns)
        for t in ledger.take(tick / 1000, shown(spoken, int(tick)), bool(final)):
            rows.append((key[0], seq, tick / 1000, t.start, t.end, t.speaker, t.text))
            seq += 1
    state.update((seq, ledger.dump()))
    yield pd.DataFrame(rows, columns=COLS)


def stream_ledger(shots: DataFrame) -> DataFrame:
    """As revision_ledger, over a stream of snapshots: state is a ledger a recording, so a restart goes on where the checkpoint ends.

    Ticks of a recording arrive in order over micro-batches, in any order within one; older ticks than the last are ignored."""
    return shots.groupBy("rec").applyInPandasWithState(_advance, OUT, "seq long, ledger string", "append", "NoTimeout")
