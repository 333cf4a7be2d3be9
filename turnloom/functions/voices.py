"""Voice evidence: views of a turn, their medoid, how far they may be trusted, and profile scores."""

from __future__ import annotations

import heapq
from collections.abc import Hashable, Iterable, Mapping, Sequence

import numpy as np


def unit(v) -> np.ndarray | None:
    """v scaled to length one; None if it has none, is null or not finite."""
    if v is None:
        return None
    x = np.array([np.nan if c is None else c for c in v], np.float64)
    n = np.linalg.norm(x) if x.size else 0.0
    return x / n if np.isfinite(n) and n > 1e-12 else None


def view_starts(start: float, end: float, native: float = 1.5, most: int = 4) -> list[float]:
    """Where the views of a turn begin: one if it is shorter than the native window, else up to `most`, equally spaced."""
    n = min(most, int((end - start) // native))
    return [start] if n < 1 else np.linspace(start, end - native, n).tolist() if n > 1 else [start]


def medoid(views: Sequence[np.ndarray]) -> tuple[np.ndarray, float]:
    """The view with the least sum of angles (of equals the smallest by components), and the median of its angles, its own zero included.
    A sole view counts as unstable by a third of a half-turn."""
    ordered = sorted(views, key=lambda v: v.tolist())
    m = np.array(ordered)
    angle = np.arccos(np.clip(m @ m.T, -1, 1))
    np.fill_diagonal(angle, 0.0)
    i = int(np.argmin(np.round(angle.sum(1), 12)))
    return ordered[i], float(np.median(angle[i])) if len(ordered) > 1 else np.pi / 3


def precision(purity: float, coverage: float, native: float, instability: float) -> float:
    return float(np.clip(purity, 0, 1) * np.clip(coverage / native, 0, 1) / (1 + np.clip(instability / np.pi, 0, 1)))


def profile_score(views: Iterable[np.ndarray], prototype: np.ndarray, exemplars: Sequence[np.ndarray]) -> float:
    """Mean over the views, without the least and the greatest of three or more, of 0.7 prototype and 0.3 the two nearest exemplars."""
    e = np.array(exemplars)
    each = sorted(0.7 * float(v @ prototype) + 0.3 * float(np.sort(e @ v)[-2:].mean()) for v in views)
    return float(np.mean(each[1:-1] if len(each) >= 3 else each))


class Views:
    """Views and vectors of turns by an extractor, each asked for once. What was said after the cutoff is never heard.

    extract(spans) gives a vector a span: by a model, or from a table of vectors."""

    def __init__(self, extract, native: float = 1.5):
        self.extract, self.native, self.known, self.calls = extract, native, {}, 0

    def _heard(self, spans: tuple) -> list[np.ndarray] | None:
        if spans not in self.known:
            self.calls += len(spans)
            got = [unit(v) for v in self.extract(list(spans))]
            self.known[spans] = got if len(got) == len(spans) and all(v is not None for v in got) else None
        return self.known[spans]

    def _check(self, end: float, cutoff: float) -> None:
        if not 0 <= cutoff < float("inf") or end > cutoff + 1e-9:
            raise ValueError("the turn ends after what may be heard")

    def views(self, start: float, end: float, cutoff: float) -> tuple[list[np.ndarray], list[tuple[float, float]], bool] | None:
        """(vectors, spans, padded) of up to four views of a turn; None if one of them can't be had."""
        self._check(end, cutoff)
        spans = tuple((round(s, 6), round(min(end, s + self.native), 6)) for s in view_starts(start, end, self.native))
        got = self._heard(spans)
        return None if got is None else (got, list(spans), end - start + 1e-9 < self.native)

    def whole(self, start: float, end: float, cutoff: float) -> np.ndarray | None:
        """The vector of a whole turn."""
        self._check(end, cutoff)
        got = self._heard(((round(start, 6), round(end, 6)),))
        return got[0] if got else None


class Calibrator:
    """Reviews labels as turns are published: a rival label whose voice, so far, is nearer by `gain` and near enough takes the turn. The voice
    counts for the label it was first given, so that an early mistake does not feed on itself."""

    def __init__(self, gain: float = 0.05, cosine: float = 0.50, seconds: float = 1.5):
        self.gain, self.cosine, self.seconds = gain, cosine, seconds
        self.sums: dict[str, np.ndarray] = {}

    def review(self, label: str, voice, seconds: float) -> str:
        v = unit(voice)
        if v is None or seconds < self.seconds:
            return label
        near = {k: float(v @ s / n) for k, s in self.sums.items() if (n := np.linalg.norm(s)) > 0}
        best = min(near, key=lambda k: (-near[k], k), default=label)
        moved = len(near) >= 2 and label in near and best != label and near[best] - near[label] >= self.gain and near[best] >= self.cosine
        self.sums[label] = self.sums.get(label, 0.0) + v
        return best if moved else label


def constrained(candidates: Mapping[Hashable, Mapping[str, float]], apart: Iterable[tuple]) -> dict:
    """One candidate a row, of greatest total, where rows that are `apart` differ. Of equal totals (to 1e-12) the first by rows, then names.

    A best-first search: a partial choice is ranked by its total plus the best that each open row could add, then by the choices, so the
    first complete choice taken from the queue is the answer."""
    rows = sorted(candidates)
    place = {r: i for i, r in enumerate(rows)}
    before: dict[int, set[int]] = {i: set() for i in range(len(rows))}
    for a, b in apart:
        i, j = sorted((place[a], place[b]))
        before[j].add(i)
    rest = np.cumsum([0.0] + [max(candidates[r].values(), default=-np.inf) for r in reversed(rows)])[::-1]
    queue: list[tuple[float, tuple, float]] = [(-float(rest[0]), (), 0.0)]
    while queue:
        _, chosen, total = heapq.heappop(queue)
        i = len(chosen)
        if i == len(rows):
            return dict(zip(rows, chosen, strict=True))
        for name, score in candidates[rows[i]].items():
            if all(chosen[j] != name for j in before[i]):
                heapq.heappush(queue, (-round(total + score + float(rest[i + 1]), 12), (*chosen, name), total + score))
    raise ValueError("no choice keeps all rows apart")
