"""Speaker binding: local labels of turns become lasting labels of a recording, by fixed cosine thresholds, by the identity model, or by clean voice profiles.

By thresholds, per tick the new turns are matched one to one with the recording's tracks. A turn keeps the track of its local label unless its voice
contradicts it, and joins another label's track only if the voices are nearly equal; whatever matches none begins a track. Labels are given
once and never rewritten."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alignment import align, lineage, resolve, tier
from ..functions.matching import assign
from ..functions.turns import Turn
from ..functions.voices import unit
from ..identity.evidence import NATIVE, Evidence, assess, bridge
from ..identity.model import IdentityModel, Observation, Settings
from ..identity.registry import Registry, Seen
from ..identity.registry import Track as KnownTrack
from ..session import shards

# Fixed values of the policy.
SAME, PLAIN, OTHER = 0.30, 0.70, 0.90
CORE_SECONDS, CORE_QUALITY, OVERLAP, CORES, SPANS = 1.5, 0.25, 0.10, 120, 256
CONTEXT = 60.0  # seconds of published turns that labels are aligned with


class Heard(NamedTuple):
    key: int
    start: float
    end: float
    local: str
    voice: np.ndarray | None
    quality: float = 1.0
    text: str | None = None


@dataclass
class Track:
    name: str
    locals: set[str] = field(default_factory=set)
    spans: list[tuple[float, float]] = field(default_factory=list)
    cores: list[np.ndarray] = field(default_factory=list)

    def score(self, h: Heard) -> float:
        """Positive if h may be this track's: more with shared time, most with the same local label."""
        shared = max((max(0.0, min(e, h.end) - max(s, h.start)) for s, e in self.spans), default=0.0)
        mine, long = h.local in self.locals, shared >= OVERLAP
        if not (core(h) and self.cores):  # no voice to compare: only the same label at the same time speaks for the track
            base = 0.75 if core(h) else 0.5
            return base + shared if mine and shared > 0 else -1.0
        center = unit(np.mean(self.cores, axis=0))
        cosine = 0.0 if center is None else float(center @ h.voice)
        # (same label, shared time) -> least cosine, bonus
        least, bonus = {(True, True): (SAME, 2.0), (True, False): (PLAIN, 0.5)}.get((mine, long), (OTHER, 0.0))
        return bonus + shared + max(0.0, cosine) if cosine >= least else -1.0

    def add(self, h: Heard) -> None:
        self.locals.add(h.local)
        self.spans = [*self.spans, (h.start, h.end)][-SPANS:]
        if core(h):
            self.cores = [*self.cores, h.voice][-CORES:]


def core(h: Heard) -> bool:
    return h.voice is not None and h.end - h.start + 1e-9 >= CORE_SECONDS and h.quality + 1e-9 >= CORE_QUALITY


class Binder:
    """The tracks of one recording."""

    def __init__(self):
        self.tracks: list[Track] = []

    def take(self, heard: list[Heard]) -> dict[int, str]:
        """key -> label of one tick's turns. Turns of one local label that share voices go to one track."""
        parts: dict[str, list[Heard]] = {}
        for h in sorted(heard, key=lambda h: (h.start, h.end, h.key)):
            parts.setdefault(h.local, []).append(h)
        names = [t.name for t in self.tracks]
        by = dict(zip(names, self.tracks, strict=True))
        score = {(p, n): max(by[n].score(h) for h in hs) for p, hs in parts.items() for n in names}
        got = assign(sorted(parts), names, score)
        out = {}
        for p, hs in sorted(parts.items(), key=lambda x: x[1][0].start):
            track = by.get(got.get(p))
            if track is None:
                track = Track(f"Speaker {len(self.tracks) + 1}")
                self.tracks.append(track)
            for h in hs:
                track.add(h)
                out[h.key] = track.name
        return out


def quality(h: Heard, heard: list[Heard]) -> float:
    """1 less the greatest share of a turn that one turn under another label covers; 0 for a turn without duration."""
    if h.end <= h.start:
        return 0.0
    return max(0.0, 1 - max((max(0.0, min(h.end, o.end) - max(h.start, o.start)) / max(1e-6, h.end - h.start) for o in heard if o is not h and o.local != h.local), default=0.0))


class ModelBinder:
    """Labels by the identity model. Every tick each local label is one observation; a turn's label is never rewritten."""

    def __init__(self, settings: Settings | None = None):
        self.model, self.made, self.tick, self.published = IdentityModel(settings), 0, 0, {}

    def _evidence(self, hs: list[Heard], heard: list[Heard], context: dict[str, float]) -> Evidence:
        """The best evidence of a local label's turns; what others talk over is none."""
        out = []
        for h in hs:
            q = quality(h, heard)
            short = h.end - h.start < NATIVE
            views, spans = ([h.voice], [(h.start, h.end if short else h.start + NATIVE)]) if h.voice is not None else ([], [])
            out.append(assess(str(h.key), views, spans, text=h.text, purity=q, context=context, padded=short, mixed=q < 1 - 1e-9))
        return min(out, key=lambda e: (-e.route, -e.profile, -e.novelty, e.key))

    def take(self, heard: list[Heard]) -> dict[int, str]:
        self.tick += 1
        parts: dict[str, list[Heard]] = {}
        for h in sorted(heard, key=lambda h: (h.start, h.end, h.key)):
            parts.setdefault(h.local, []).append(h)
        if not parts:
            return {}
        now = [Turn(h.start, h.end, h.local, h.text or "") for h in heard]
        low = min(h.start for h in heard) - CONTEXT
        self.published = {k: t for k, t in self.published.items() if t.end > low}
        aligned = align(now, list(self.published.values()))
        names = {local: f"{self.tick:08d}:{local}" for local in parts}
        seen = []
        for local, hs in sorted(parts.items()):
            a = aligned.get(local)
            e = self._evidence(hs, heard, a.scores if a else {})
            root = lineage(local, a.best, now, self.published) if a and a.best else None
            link = bridge(a.best, a.scores, (a.row_margin, a.column_margin), (a.row_unique, a.column_unique), a.selected == a.best, root, e) if a else None
            barred = frozenset(x.selected for other, x in aligned.items() if other != local and x.selected)
            seen.append(Observation(names[local], e, (link,) if link else (), barred))
        apart = list(itertools.combinations(sorted(names.values()), 2))
        plan = self.model.infer(seen, apart)
        labels = {}
        for d in plan.decisions:
            if d.label is None:
                self.made += 1
                labels[d.key] = f"S{self.made:02d}"
        self.model.commit(plan, labels)
        chosen = {d.key: d.label or labels[d.key] for d in plan.decisions}
        evidence = {o.key: o.evidence for o in seen}
        for key, label in labels.items():
            self.model.add_label(label, evidence[key])
        out = {}
        for local, hs in parts.items():
            for h in hs:
                out[h.key] = chosen[names[local]]
                self.published[str(h.key)] = Turn(h.start, h.end, out[h.key], h.text or "")
        return out


class CleanCoreBinder:
    """Labels by clean voice profiles. A turn joins the one track it surely sounds like; a track gets a label once its profile is established and
    sounds like no labelled one. What is undecided after `waits` ticks takes the best there is."""

    def __init__(self, waits: int = 1, seconds: float = 0.0, windows: int = 2):
        self.registry, self.tick, self.waits, self.seconds, self.windows = Registry(), 0, waits, seconds, windows
        self.open: dict[str, tuple[int, Heard]] = {}  # turns without a label, and the tick they came in

    def _floor(self, t: KnownTrack) -> float:
        """Cosine from which a voice is the track's."""
        return PLAIN if t.label is None else max(PLAIN, 0.8 * (t.cohesion() or 0.0))

    def _score(self, t: KnownTrack, h: Heard) -> float:
        shared = max((max(0.0, min(o.end, h.end) - max(o.start, h.start)) for o in t.evidence.values()), default=0.0)
        if core(h):
            near = t.nearest([h.voice])
            if near is not None:
                return near if near + 1e-12 >= self._floor(t) else -1.0
        return (0.75 if core(h) else 0.5) + shared if h.local in t.locals and shared > 1e-9 else -1.0

    def _candidates(self, hs: list[Heard]) -> dict[str, float]:
        """Tracks that a local label's turns may belong to; of labelled ones only the best, if it is the only best."""
        score = {n: max(self._score(t, h) for h in hs) for n, t in self.registry.tracks.items()}
        named = sorted(((s, n) for n, s in score.items() if s > 0 and self.registry.tracks[n].label), reverse=True)
        sole = named[0][1] if named and (len(named) == 1 or named[0][0] - named[1][0] > 1e-12) else None
        return {n: s for n, s in score.items() if s > 0 and (self.registry.tracks[n].label is None or n == sole)}

    def _settle(self) -> None:
        """Tracks without label that surely sound like a labelled one join it, the surest first, one to one; established others get a label."""
        r = self.registry
        loose = [t for t in r.tracks.values() if t.label is None]
        proposals = sorted(((near, t.name, k.name) for t in loose for k in r.tracks.values() if k.label and (near := t.nearest(k.vectors)) is not None and near + 1e-12 >= self._floor(k)), key=lambda x: (-x[0], x[1], x[2]))
        used: set[str] = set()
        for _, a, b in proposals:
            if not {a, b} & used and r.move(a, b, reason="profile"):
                used |= {a, b}
        for t in sorted((t for t in r.tracks.values() if t.label is None), key=lambda t: t.name):
            rivals = [x for k in r.tracks.values() if k.label and (x := t.nearest(k.vectors)) is not None and x + 1e-12 >= self._floor(k)]
            if t.profile.state == "established" and t.confirmed(self.seconds, self.windows) and not rivals:
                r.new_label(t.name)

    def take(self, heard: list[Heard], final: bool = False) -> dict[int, str]:
        """Labels that are decided now: of this tick's turns, or of earlier ones."""
        self.tick += 1
        r, parts = self.registry, {}
        for h in sorted(heard, key=lambda h: (h.start, h.end, h.key)):
            parts.setdefault(h.local, []).append(h)
        rows = {p: self._candidates(hs) for p, hs in parts.items()}
        got = assign(sorted(parts), sorted(r.tracks), {(p, n): s for p, row in rows.items() for n, s in row.items()})
        for p, hs in sorted(parts.items(), key=lambda x: x[1][0].start):
            name = got.get(p) or r.new_track().name
            for h in hs:
                r.observe(Seen(str(h.key), self.tick, h.local, h.start, h.end, float(self.tick), h.voice if core(h) else None, quality(h, heard), h.text), name)
                self.open[str(h.key)] = (self.tick, h)
        self._settle()
        late: dict[str, list] = {}
        for k, (since, h) in self.open.items():
            t = r.owner(k)
            if r.tracks[t].label is None:
                late.setdefault(t, []).append((since, Turn(h.start, h.end, h.local, h.text or "")))
        due = {t: x for t, x in late.items() if final or any(self.tick - since >= self.waits for since, _ in x)}

        def tiers(track: str, label: str) -> tuple[float, float, str]:
            known = r.of_label(label)
            gaps = [max(0.0, t.start - o.end, o.start - t.end) for _, t in due[track] for o in known.evidence.values()]
            return tier(r.tracks[track].nearest(known.vectors), [], bool({t.speaker for _, t in due[track]} & known.locals), min(gaps, default=None))

        names: dict[str, str] = {}

        def fresh() -> str:
            self.registry.named += 1
            return f"S{self.registry.named:02d}"

        for track, (label, _) in resolve(due, r.labels, tiers, fresh).items():
            names[track] = label
        for track, label in names.items():
            known = next((t for t in r.tracks.values() if t.label == label), None)
            if known is None:
                r.tracks[track].label = label
            else:
                r.move(track, known.name, reason="deadline")
        out = {}
        for k in list(self.open):
            label = r.tracks[r.owner(k)].label
            if label is not None:
                out[self.open.pop(k)[1].key] = label
                r.published.add(k)
        return out

    def end(self) -> dict[int, str]:
        return self.take([], final=True)


POLICIES = {"fixed-cosine": Binder, "identity": ModelBinder, "clean-core": CleanCoreBinder}


def _bind(policy: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = POLICIES[policy]
        rec, tick, binder, waiting = None, None, make(), []
        rows: list[tuple] = []

        def flush() -> None:
            rows.extend((rec, k, label) for k, label in sorted(binder.take(waiting).items()))
            waiting.clear()

        def close() -> None:
            flush()
            rows.extend((rec, k, label) for k, label in sorted(getattr(binder, "end", dict)().items()))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["rec", "turn", "speaker"])

        for b in batches:
            for r, t, key, start, end, local, voice, text in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if r != rec:
                    close()
                    binder = make()
                elif t != tick:
                    flush()
                rec, tick = r, t
                waiting.append(Heard(key, start, end, local or "UNK", unit(voice), text=text))
            yield batch()
        close()
        yield batch()

    return run


def bind(turns: DataFrame, policy: str = "fixed-cosine") -> DataFrame:
    """rec, turn, speaker of turns (rec, tick, turn, start, end, local, voice, and text if there is one). A recording is a sequence: one task
    reads it in order and holds its tracks, or its identity model, only. Rows without rec, tick or turn are left out; a null, zero or
    non-finite voice is no evidence."""
    if policy not in POLICIES:
        raise ValueError(f"no policy {policy!r}")
    text = F.col("text").cast("string") if "text" in turns.columns else F.lit(None).cast("string")
    rows = turns.where("rec is not null and tick is not null and turn is not null").select("rec", "tick", "turn", "start", "end", "local", "voice", text.alias("text"))
    return rows.repartition(shards(rows.sparkSession), "rec").sortWithinPartitions("rec", "tick", "turn").mapInArrow(_bind(policy), "rec long, turn long, speaker string")
