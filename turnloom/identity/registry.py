"""Tracks of a recording and the evidence they own. What a turn says is owned by one track; moves are all or nothing and are all recorded."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np

from ..functions.voices import unit
from .evidence import Candidate, VoiceProfile, union_length


class Seen(NamedTuple):
    """One observation of a turn: key names the turn, a later revision of it replaces an earlier one."""

    key: str
    revision: int
    local: str
    start: float
    end: float
    tick: float
    voice: np.ndarray | None = None
    quality: float = 1.0
    text: str | None = None


class Record(NamedTuple):
    sequence: int
    event: str
    key: str
    revision: int
    track: str
    reason: str


@dataclass
class Track:
    name: str
    label: str | None = None
    evidence: dict[str, Seen] = field(default_factory=dict)
    profile: VoiceProfile = field(default_factory=VoiceProfile)

    @property
    def support(self) -> float:
        """Seconds of audio that its evidence covers: the same audio shown twice counts once."""
        return union_length((o.start, o.end) for o in self.evidence.values())

    @property
    def ticks(self) -> set[float]:
        return {o.tick for o in self.evidence.values()}

    @property
    def locals(self) -> set[str]:
        return {o.local for o in self.evidence.values()}

    @property
    def vectors(self) -> list[np.ndarray]:
        return [unit(self.evidence[k].voice) for k in self.profile.active if k in self.evidence]

    def rebuild(self) -> None:
        """The profile follows from the evidence alone."""
        self.profile.derive(Candidate(k, unit(o.voice), o.tick, max(0.0, o.end - o.start), o.text, o.quality) for k, o in sorted(self.evidence.items()) if unit(o.voice) is not None)

    def cohesion(self) -> float | None:
        """Of all its vectors the least cosine to their nearest; None for fewer than two."""
        v = self.vectors
        if len(v) < 2:
            return None
        m = np.array(v) @ np.array(v).T
        np.fill_diagonal(m, -np.inf)
        return float(m.max(1).min())

    def nearest(self, vectors: Sequence[np.ndarray]) -> float | None:
        """The greatest cosine between its vectors and others."""
        mine = self.vectors
        return float((np.array(mine) @ np.array(vectors).T).max()) if mine and len(vectors) else None

    def confirmed(self, seconds: float, windows: int) -> bool:
        return self.support + 1e-9 >= seconds and len(self.ticks) >= windows


class Registry:
    def __init__(self):
        self.tracks: dict[str, Track] = {}
        self.ledger: list[Record] = []
        self.published: set[str] = set()
        self.made = self.named = 0

    def _note(self, event: str, o: Seen, track: str, reason: str) -> None:
        self.ledger.append(Record(len(self.ledger), event, o.key, o.revision, track, reason))

    def owner(self, key: str) -> str | None:
        """The track that owns the latest revision of a turn."""
        held = [(t.evidence[key].revision, t.name) for t in self.tracks.values() if key in t.evidence]
        return max(held)[1] if held else None

    def new_track(self) -> Track:
        self.made += 1
        t = self.tracks[f"G{self.made:03d}"] = Track(f"G{self.made:03d}")
        return t

    def new_label(self, track: str) -> str:
        t = self.tracks[track]
        if t.label is None:
            self.named += 1
            t.label = f"S{self.named:02d}"
        return t.label

    def of_label(self, label: str) -> Track:
        return next(t for t in self.tracks.values() if t.label == label)

    @property
    def labels(self) -> list[str]:
        return sorted(t.label for t in self.tracks.values() if t.label)

    def observe(self, o: Seen, track: str, reason: str = "observed") -> bool:
        """Give an observation to a track; an older revision than what is known changes nothing. A turn leaves the track that had it before."""
        had = self.owner(o.key)
        if had is not None and self.tracks[had].evidence[o.key].revision >= o.revision:
            return False
        if had is not None and had != track:
            del self.tracks[had].evidence[o.key]
            self.tracks[had].rebuild()
        self.tracks[track].evidence[o.key] = o
        self.tracks[track].rebuild()
        self._note("observed" if had is None else "revised", o, track, reason)
        return True

    def move(self, source: str, target: str, keys: Iterable[str] | None = None, reason: str = "transfer") -> tuple[str, ...]:
        """Move evidence (all, or the given turns) to another track. If one of them is missing, or published, nothing moves. A track that is left
        empty, without label, goes."""
        a, b = self.tracks[source], self.tracks[target]
        wanted = tuple(sorted(a.evidence if keys is None else set(keys)))
        if source == target or not wanted or any(k not in a.evidence or k in self.published or k in b.evidence for k in wanted):
            return ()
        for k in wanted:
            b.evidence[k] = a.evidence.pop(k)
            self._note("moved", b.evidence[k], target, reason)
        a.rebuild()
        b.rebuild()
        if not a.evidence and a.label is None:
            del self.tracks[source]
        return wanted

    def discard(self, track: str) -> bool:
        """Drop a track without label, none of whose turns are published, and what it owns."""
        t = self.tracks.get(track)
        if t is None or t.label is not None or set(t.evidence) & self.published:
            return False
        for o in t.evidence.values():
            self._note("discarded", o, track, "unpublished")
        del self.tracks[track]
        return True

    def replace(self, old: str, new: Seen) -> bool:
        """Put a turn's new form in the place of its old one, in the same track; not if it was published, or the new one is known."""
        had = self.owner(old)
        if had is None or old in self.published or self.owner(new.key) is not None:
            return False
        del self.tracks[had].evidence[old]
        return self.observe(new, had, "replaced")
