"""Evidence of a voice: what one observation may be used for, claims that link it to a label, and profiles of a voice."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np

from ..functions.voices import medoid, precision, unit

# The native window of the encoder in seconds, and how much a bank keeps.
NATIVE = 1.5
UNIT = re.compile(r"[A-Za-z0-9]+|[㐀-鿿]")


def lexical_units(text: str | None) -> list[str]:
    return [u.casefold() for u in UNIT.findall(text or "")]


def union_length(spans: Iterable[tuple[float, float]]) -> float:
    """Seconds that the spans cover together."""
    total, reach = 0.0, -np.inf
    for s, e in sorted(spans):
        total += max(0.0, e - max(s, reach))
        reach = max(reach, e)
    return total


@dataclass(frozen=True)
class Evidence:
    """One observation's voice. route, profile and novelty say how far it may be used to find a label, to shape a profile and to begin one."""

    key: str
    views: tuple = ()
    center: np.ndarray | None = None
    instability: float = 0.0
    coverage: float = 0.0
    route: float = 0.0
    profile: float = 0.0
    novelty: float = 0.0
    context: Mapping[str, float] = field(default_factory=dict)


def scaled(context: Mapping[str, float]) -> dict[str, float]:
    """Scores divided by the largest in size; all 0 if they are."""
    top = max((abs(v) for v in context.values()), default=0.0)
    return {k: float(np.clip(v / top, -1, 1)) if top else 0.0 for k, v in sorted(context.items())}


def assess(key: str, views: Sequence, spans: Sequence[tuple[float, float]], *, text: str | None = None, purity: float = 1.0, context: Mapping[str, float] | None = None, padded: bool = False, profile_ok: bool = True, novelty_ok: bool = True, mixed: bool = False, duplicate: bool = False, native: float = NATIVE) -> Evidence:
    """The evidence of up to four views of one turn, each a vector and the span that it was heard in.

    Mixed or repeated speech is no evidence. A view that was padded, and a text of less than two units or kinds of units, shapes no profile."""
    near = scaled(context or {})
    heard = [u for u in map(unit, views) if u is not None]
    if len(heard) != len(views) or len(views) > 4:
        raise ValueError("one to four finite views that are not zero")
    if not heard:
        return Evidence(key, context=near)
    center, instability = medoid(heard)
    coverage = union_length(spans)
    route = precision(purity, coverage, native, instability)
    usable = route > 0 and not mixed and not duplicate
    units = lexical_units(text)
    rich = text is None or (len(units) >= 2 and len(set(units)) >= 2)
    shapes = usable and profile_ok and not padded and rich
    return Evidence(key, tuple(sorted(heard, key=lambda v: v.tolist())), center, instability, coverage, route * usable, route * shapes, route * (shapes and novelty_ok), near)


@dataclass(frozen=True)
class Bridge:
    """A claim that an observation belongs to a label, because a published turn of that label lay in its time; all shares are in [0, 1]."""

    label: str
    lineage: str
    provenance: str = "current_snapshot_overlap"
    structure: float = 1.0
    row: float = 1.0
    column: float = 1.0
    conflict: bool = False
    authority: float = 1.0

    def __post_init__(self):
        if not (self.label and self.lineage and all(0 <= x <= 1 for x in (self.structure, self.row, self.column, self.authority))):
            raise ValueError("a bridge needs a label, a lineage and shares from 0 to 1")

    @property
    def weight(self) -> float:
        return 0.0 if self.conflict else self.authority * self.structure * min(self.row, self.column)


def share(value: float, scale: float) -> float:
    """max(0, value) as a part of the scale, at most 1; 0 for what is not finite."""
    return float(min(1.0, max(0.0, value) / max(abs(scale), 1e-12))) if np.isfinite(value) and np.isfinite(scale) else 0.0


def bridge(best: str | None, scores: Mapping[str, float], margins: tuple[float, float], unique: tuple[bool, bool], selected: bool, lineage: str | None, evidence: Evidence, conflict: bool = False) -> Bridge | None:
    """The claim of one alignment: best label, all its scores, row and column margin and whether these are unique."""
    if not best:
        return None
    scale = max([abs(s) for s in scores.values()] + [1e-12])
    good = not conflict and all(unique) and min(margins) > 1e-12 and selected and bool(lineage)
    return Bridge(best, lineage or evidence.key, structure=share(scores[best], scale), row=share(margins[0], scale) * unique[0], column=share(margins[1], scale) * unique[1], conflict=not good, authority=min(1.0, evidence.route) * good)


class Exemplars:
    """The exemplars of one voice, three to five; the prototype is their angular medoid."""

    def __init__(self, capacity: int = 4):
        if capacity not in (3, 4, 5):
            raise ValueError("a profile holds three, four or five exemplars")
        self.capacity = capacity
        self.items: dict[str, tuple[np.ndarray, float, float]] = {}  # vector, weight, seconds covered
        self.prototype: np.ndarray | None = None
        self.dispersion = 0.0

    @staticmethod
    def middle(items: Mapping[str, tuple]) -> tuple[np.ndarray, float]:
        keys = sorted(items)
        m = np.array([items[k][0] for k in keys])
        angle = np.arccos(np.clip(m @ m.T, -1, 1))
        np.fill_diagonal(angle, 0)
        i = min(range(len(keys)), key=lambda i: (round(float(angle[i].sum()), 12), m[i].tolist(), keys[i]))
        return m[i], float(np.median(angle[i])) if len(keys) > 1 else 0.0

    @classmethod
    def utility(cls, items: Mapping[str, tuple]) -> float:
        w = np.array([(min(1.0, x[1]), x[2] / (x[2] + 1.5)) for x in items.values()])
        return float(w[:, 0].mean() + 0.15 * w[:, 1].mean() - cls.middle(items)[1] / np.pi)

    @property
    def support(self) -> float:
        return sum(min(1.0, w) for _, w, _ in self.items.values())

    def admit(self, e: Evidence, weight: float) -> str:
        """duplicate, inadmissible, admitted or quarantined: of one exemplar too many the subset of greatest utility stays."""
        if e.key in self.items:
            return "duplicate"
        if not e.profile or e.center is None or not 0 < weight < np.inf:
            return "inadmissible"
        pool = {**self.items, e.key: (e.center, min(1.0, weight), max(0.0, e.coverage))}
        if len(pool) > self.capacity:
            subsets = ({k: pool[k] for k in keys} for keys in itertools.combinations(sorted(pool), self.capacity))
            pool = max(subsets, key=lambda s: (self.utility(s), tuple(s)))
        self.items = dict(sorted(pool.items()))
        self.prototype, self.dispersion = self.middle(self.items)
        return "admitted" if e.key in self.items else "quarantined"

    def score(self, views: Sequence[np.ndarray], prototype_share: float = 0.7) -> float:
        """Mean over the views, less the least and greatest of three or more, of the prototype's cosine and the two nearest exemplars'."""
        near = np.sort(np.array(views) @ np.array([x[0] for x in self.items.values()]).T, axis=1)[:, -2:].mean(1)
        each = np.sort(prototype_share * (np.array(views) @ self.prototype) + (1 - prototype_share) * near)
        return float(each[1:-1].mean() if len(each) >= 3 else each.mean())


@dataclass(frozen=True)
class Candidate:
    """A vector that may enter a voice profile."""

    key: str
    vector: np.ndarray
    tick: float
    seconds: float
    text: str | None = None
    purity: float = 1.0

    @property
    def strength(self) -> float:
        rich = 0.5 if self.text is None else min(1.0, len(set(lexical_units(self.text))) / 8)
        return min(1.0, max(0.0, self.purity)) * (0.55 * min(1.0, self.seconds / 6) + 0.45 * rich)

    def permissions(self, least_seconds: float, least_purity: float) -> tuple[bool, bool, bool]:
        """Whether it may route, shape a profile, and begin one."""
        pure = self.purity + 1e-12 >= least_purity
        units = lexical_units(self.text)
        rich = self.text is None or (len(units) >= 2 and len(set(units)) >= 2)
        shapes = pure and rich and self.seconds + 1e-9 >= least_seconds
        return pure, shapes, shapes and self.seconds + 1e-9 >= max(3.0, 2 * least_seconds)


class VoiceProfile:
    """A bounded profile: unseeded, provisional or established. A coherent profile withstands one stray observation, and gives way to a better
    cohort from two ticks or more."""

    def __init__(self, most: int = 8, least_seconds: float = 1.5, least_purity: float = 0.25, cohesion: float = 0.3):
        self.most, self.least_seconds, self.least_purity, self.cohesion = most, least_seconds, least_purity, cohesion
        self.active: tuple[str, ...] = ()
        self.quarantine: tuple[str, ...] = ()
        self.state, self.reason = "unseeded", "empty"

    @staticmethod
    def utility(group: Sequence[Candidate]) -> float:
        if not group:
            return 0.0
        m = np.array([unit(c.vector) for c in group])
        pairs = (m @ m.T)[np.triu_indices(len(group), 1)]
        spread, hold = (float((1 - pairs).mean()), float(pairs.min())) if len(pairs) else (0.0, 1.0)
        units = {u for c in group for u in lexical_units(c.text)}
        return sum(c.strength for c in group) + 0.08 * len({c.tick for c in group}) + 0.02 * min(12, len(units)) + 0.05 * spread + 0.05 * hold

    def clusters(self, group: Iterable[Candidate]) -> list[list[Candidate]]:
        """Complete linkage, strongest first: a candidate joins the cluster of greatest utility of those whose members are all near it."""
        out: list[list[Candidate]] = []
        for c in sorted(group, key=lambda c: (-c.strength, c.key)):
            fits = [g for g in out if all(float(unit(c.vector) @ unit(o.vector)) + 1e-12 >= self.cohesion for o in g)]
            if fits:
                max(fits, key=lambda g: (self.utility([*g, c]), sorted(o.key for o in g))).append(c)
            else:
                out.append([c])
        return [sorted(g, key=lambda c: c.key) for g in out]

    def select(self, group: Sequence[Candidate]) -> list[Candidate]:
        """Up to `most` candidates, each time the one that makes the greatest utility."""
        left, chosen = list(group), []
        while left and len(chosen) < self.most:
            best = max(left, key=lambda c: (self.utility([*chosen, c]), c.key))
            chosen.append(best)
            left.remove(best)
        return sorted(chosen, key=lambda c: c.key)

    def _cohort(self, group: Sequence[Candidate]) -> bool:
        return len({c.tick for c in group}) >= 2 and sum(c.seconds for c in group) + 1e-9 >= max(1.5, 2 * self.least_seconds)

    def derive(self, candidates: Iterable[Candidate]) -> None:
        allowed = {c.key: (c, *c.permissions(self.least_seconds, self.least_purity)) for c in candidates}
        routing = sorted(k for k, (_, route, _, _) in allowed.items() if route)
        parts = self.clusters([c for c, _, shapes, _ in allowed.values() if shapes])
        worth = lambda g: self.utility(self.select(g))
        ranked = sorted(parts, key=lambda g: (-worth(g), [c.key for c in g]))
        chosen, self.reason = (self.select(ranked[0]), "set_utility") if ranked else ([], "no_profile_permission")
        own = next((g for g in parts if set(self.active) & {c.key for c in g}), None)
        if self.state == "established" and own is not None:
            better = next((g for g in ranked if g is not own and self._cohort(g) and worth(g) > worth(own) + 1e-12), None)
            chosen = self.select(better or own)
            self.reason = "coherent_cohort_refresh" if better else "set_utility" if tuple(c.key for c in chosen) != self.active else "established_outlier_resistance"
        self.active = tuple(c.key for c in chosen)
        self.quarantine = tuple(k for k in routing if k not in self.active)
        firm = any(allowed[k][3] for k in self.active) or self._cohort(chosen)
        self.state = ("established" if firm else "provisional") if chosen else ("provisional" if routing else "unseeded")
