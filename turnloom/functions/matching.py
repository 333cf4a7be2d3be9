"""One-to-one assignment of greatest total weight; rows and columns may stay alone."""

from __future__ import annotations

from collections.abc import Hashable, Mapping, Sequence


def assign(rows: Sequence[Hashable], cols: Sequence[Hashable], weight: Mapping[tuple, float]) -> dict:
    """row -> column of the matching with the greatest total of weights; only pairs of positive weight are used.

    Rows enter in order. Each augments along the path of greatest gain, found by relaxation over the residual graph, where the path may end
    at a free column or at a row that gives its column up. Of paths with equal gain the first found stays, hence ties go by the caller's order."""
    left = {r: {c: weight[r, c] for c in cols if weight.get((r, c), 0.0) > 0} for r in rows}
    of_row: dict = {}
    of_col: dict = {}
    for new in rows:
        gain, via = {new: 0.0}, {}
        changed = True
        while changed:
            changed = False
            for r in list(gain):
                for c, w in left[r].items():
                    owner = of_col.get(c)
                    if owner == r or owner is None:
                        continue
                    g = gain[r] + w - left[owner][c]
                    if g > gain.get(owner, float("-inf")) + 1e-12:
                        gain[owner], via[owner] = g, (r, c)
                        changed = True
        best, stop = 0.0, None  # leaving the new row alone gains nothing
        for r in gain:
            for c, w in left[r].items():
                if c not in of_col and gain[r] + w > best + 1e-12:
                    best, stop = gain[r] + w, (r, c)
            if r != new and gain[r] > best + 1e-12:
                best, stop = gain[r], (r, None)
        if stop is None:
            continue
        r, c = stop
        chain = [(r, c)]
        while r != new:
            r, c = via[r]
            chain.append((r, c))
        for r, _ in chain:
            of_row.pop(r, None)
        for r, c in chain:
            if c is not None:
                of_row[r], of_col[c] = c, r
    return of_row
