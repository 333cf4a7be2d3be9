"""Alignment of a snapshot's local labels with published speakers, revisions of withheld turns, and what must be decided at a deadline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from .matching import assign
from .turns import Turn, common, iou, similarity

LEAST_OVERLAP = 0.1  # seconds that two turns share at least
TIE = 1e-12


class Aligned(NamedTuple):
    """A local label's best speaker (None if tied), all its scores, how far it leads in its row and column, and the speaker it is assigned."""

    best: str | None
    scores: dict[str, float]
    row_margin: float
    column_margin: float
    row_unique: bool
    column_unique: bool
    selected: str | None


def edge(current: Sequence[Turn], resolved: Sequence[Turn]) -> float:
    """Sum over the local turns of the best pair: shared seconds, times 0.55 of the share covered, 0.25 IoU and 0.20 similarity of texts."""
    total = 0.0
    for t in current:
        pairs = [(common(t, p), p) for p in resolved]
        total += max((c * (0.55 * c / max(t.seconds, TIE) + 0.25 * iou(t, p) + 0.20 * similarity(t, p)) for c, p in pairs if c + TIE >= LEAST_OVERLAP), default=0.0)
    return total


def _lead(scores: Mapping[str, float], name: str) -> tuple[float, bool]:
    """How far name's score is above the best other, and whether it alone is the best."""
    rival = max((s for n, s in scores.items() if n != name), default=None)
    lead = scores[name] - (rival or 0.0)
    return max(0.0, lead), rival is None or scores[name] - rival > TIE * max(1.0, abs(scores[name]))


def align(current: Sequence[Turn], resolved: Sequence[Turn]) -> dict[str, Aligned]:
    """Per local label that shares time with a published speaker, its alignment. Only labels whose best speaker is unique are assigned."""
    groups: tuple[dict, dict] = ({}, {})
    for side, turns in zip(groups, (current, resolved), strict=True):
        for t in dict.fromkeys(turns):
            side.setdefault(t.speaker, []).append(t)
    rows = {a: {b: s for b, y in sorted(groups[1].items()) if (s := edge(x, y)) > 0} for a, x in sorted(groups[0].items())}
    rows = {a: r for a, r in rows.items() if r}
    top = {a: min(r, key=lambda b: (-r[b], b)) for a, r in rows.items()}
    firm = [a for a, r in rows.items() if _lead(r, top[a])[1]]
    chosen = assign(firm, sorted(groups[1]), {(a, b): s for a in firm for b, s in rows[a].items()})
    out = {}
    for a, r in rows.items():
        margin, unique = _lead(r, top[a])
        column = {x: rows[x][top[a]] for x in rows if top[a] in rows[x]}
        lead, alone = _lead(column, a)
        alone = alone and unique
        out[a] = Aligned(top[a] if unique else None, r, margin, lead if alone else 0.0, unique, alone, chosen.get(a))
    return out


def lineage(local: str, label: str, current: Sequence[Turn], published: Mapping[str, Turn]) -> str | None:
    """The published turn of the label that shares most time with the local turns; None if two share equally much."""
    shared = {k: sum(common(t, p) for t in current if t.speaker == local) for k, p in published.items() if p.speaker == label}
    best = sorted(((s, k) for k, s in shared.items() if s > 0), key=lambda x: (-x[0], x[1]))
    return best[0][1] if best and (len(best) == 1 or best[0][0] > best[1][0] + TIE) else None


def revision(t: Turn, p: Turn) -> float | None:
    """How surely t is a withheld p, revised; None if it is not."""
    x, y = len(t.norm), len(p.norm)
    if min(x, y) < 4:
        return None
    overlap, ratio = iou(t, p), min(x, y) / max(x, y)
    if ratio < 0.80 or overlap < 0.75:  # before the texts are compared, which costs most
        return None
    s = similarity(t, p)
    return s + ratio + overlap if s >= 0.82 else None


def revisions(current: Mapping[str, Turn], pending: Mapping[str, Turn]) -> dict[str, str]:
    """Pairs of current and withheld turns that are each other's only best match, assigned either way round."""
    scores = {(a, b): s for a, t in current.items() for b, p in pending.items() if (s := revision(t, p)) is not None}
    there = assign(sorted(current), sorted(pending), scores)
    back = assign(sorted(pending), sorted(current), {(b, a): s for (a, b), s in scores.items()})

    def sole(side: int, name: str, score: float) -> bool:
        return sum(k[side] == name and abs(s - score) <= TIE for k, s in scores.items()) == 1

    return {a: b for a, b in there.items() if back.get(b) == a and sole(0, a, scores[a, b]) and sole(1, b, scores[a, b])}


def deadline_groups(tracks: Mapping[str, Sequence[tuple[int, Turn]]]) -> list[list[str]]:
    """Tracks that must be told apart, in groups that hang together: those first heard in one round, or sharing time. tracks: (round, turn)."""
    left, out = set(tracks), []

    def tied(a: str, b: str) -> bool:
        rounds = {r for r, _ in tracks[a]} & {r for r, _ in tracks[b]}
        return bool(rounds) or any(common(s, t) > 1e-9 for _, s in tracks[a] for _, t in tracks[b])

    while left:
        group, todo = set(), [min(left)]
        while todo:
            a = todo.pop()
            group.add(a)
            left.discard(a)
            near = {b for b in left if tied(a, b)}
            left -= near
            todo += sorted(near)
        out.append(sorted(group))
    return out


def tier(acoustic: float | None, context: Sequence[float], same: bool, gap: float | None) -> tuple[float, float, str]:
    """(score, confidence, source) of a candidate at the deadline, by the best kind of evidence there is."""
    heard = None if acoustic is None else min(1.0, max(0.0, acoustic))
    said = max((max(0.0, c) / (1 + max(0.0, c)) for c in context), default=None)
    if heard is not None:
        return (5 + max(heard, said), max(heard, said), "fused") if said is not None else (4 + heard, heard, "acoustic")
    if said is not None:
        return 3 + said, said, "context"
    if same:
        return 2.5, 0.5, "local_continuity"
    return (1 + 1 / (1 + gap), 1 / (1 + gap), "neighbor") if gap is not None else (0.1, 0.0, "registry_prior")


def resolve(tracks: Mapping[str, Sequence[tuple[int, Turn]]], labels: Sequence[str], score, fresh) -> dict[str, tuple[str, str]]:
    """track -> (label, source) for tracks that must be decided now. score(track, label) gives a tier, fresh() a new label.

    In a group of several each gets a label of its own; a track alone gets the best there is."""
    known, out = list(labels), {}
    for group in deadline_groups(tracks):
        tiers = {(t, o): score(t, o) for t in group for o in known}
        got = assign(group, sorted(known), {k: x[0] for k, x in tiers.items()})
        for t in group:
            if t in got:
                out[t] = got[t], tiers[t, got[t]][2]
            elif len(group) == 1 and known:
                best = max(sorted(known), key=lambda o: tiers[t, o][0])
                out[t] = best, tiers[t, best][2]
            else:
                known.append(fresh())
                out[t] = known[-1], "structural_separation" if len(group) > 1 else "bootstrap"
    return out
