"""Pure functions on turns and decoder text: similarity, grammar, loop detectors, time arithmetic."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

# Fixed values of the decoder's text format and of its loop detectors.
START = re.compile(r"\[(\d+(?:\.\d+)?)\]\[([SG][^\]]*)\]")
STAMP = re.compile(r"\[(\d+(?:\.\d+)?)\]")
LABEL = re.compile(r"\s*[SG](\d+)\s*")
LOOP_TAIL, LOOP_LEAST, LOOP_RUNS, LOOP_UNIT = 1024, 16, 8, 128
MARKERS_LEAST, MARKER_STRIP = 8, ".,，。!！?？;；:：-—…[]"
SHORT_TAIL, SHORT_LEAST, SHORT_SEEN, SHORT_SHARE, SHORT_RATE = 2048, 24, 36, 0.65, 2.5
RELATED = 0.55


class Turn(NamedTuple):
    """A timestamped utterance in seconds; tick is the snapshot that showed it, None for authoritative turns."""

    start: float
    end: float
    speaker: str
    text: str
    tick: float | None = None

    @property
    def seconds(self) -> float:
        return max(0.0, self.end - self.start)

    @property
    def norm(self) -> str:
        return normal(self.text)


class _Bare(dict):
    """str.translate's table of characters that a normalised text leaves out, filled as they are met."""

    def __missing__(self, code: int) -> int | None:
        c = chr(code)
        self[code] = None if c.isspace() or unicodedata.category(c)[0] in "PS" else code
        return self[code]


_BARE = _Bare()
# Caches hold what one window's turns need again in the next ticks, not a recording: their texts are long, and each worker has its own.
RECENT = 4096


@lru_cache(maxsize=RECENT)
def normal(text: str) -> str:
    """Case-folded text without space, punctuation and symbols."""
    return text.casefold().translate(_BARE)


def cut_at(text: str, n: int) -> int:
    """Where in text its first n normalised characters end."""
    if n <= 0:
        return 0
    got = 0
    for i, c in enumerate(text):
        got += len(normal(c))
        if got >= n:
            return i + 1
    return len(text)


def ratio(a: str, b: str, autojunk: bool = True) -> float:
    """SequenceMatcher(None, a, b, autojunk).ratio(), by searches for substrings instead of chains of places.

    The longest block that begins first in a, then first in b, is found by asking, place by place of a, for a longer one than the best so
    far. Characters that are frequent in a long b begin no block; they only extend one, as there."""
    x, y = a, b
    if autojunk and len(b) >= 200:
        often = [ord(c) for c, n in Counter(b).items() if n > len(b) // 100 + 1]
        # Two lone surrogates, which no text that Spark holds has, so that frequent characters meet nothing.
        x, y = a.translate(dict.fromkeys(often, "\udfff")), b.translate(dict.fromkeys(often, "\udffe"))
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        i, size, j = alo, 0, blo
        for at in range(alo, ahi):
            if at + size >= ahi:
                break
            while at + size < ahi and (k := y.find(x[at : at + size + 1], blo, bhi)) >= 0:
                i, size, j = at, size + 1, k
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        if size:
            total += size
            if alo < i and blo < j:
                todo.append((alo, i, blo, j))
            if i + size < ahi and j + size < bhi:
                todo.append((i + size, ahi, j + size, bhi))
    return 2.0 * total / (len(a) + len(b)) if a or b else 1.0


@lru_cache(maxsize=RECENT)
def _similar(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    short, long = sorted((a, b), key=len)
    if short in long:
        return len(short) / len(long)
    return ratio(a, b)


def similarity(a: Turn, b: Turn) -> float:
    """Ratio of lengths if one text contains the other, else that of matching characters; 0 if either is empty."""
    return _similar(a.norm, b.norm)


def related(a: Turn, b: Turn) -> bool:
    x, y = a.norm, b.norm
    if not x or not y or x in y or y in x:
        return bool(x and y)
    return 2.0 * min(len(x), len(y)) / (len(x) + len(y)) >= RELATED and _similar(x, y) >= RELATED


def common(a: Turn, b: Turn) -> float:
    return max(0.0, min(a.end, b.end) - max(a.start, b.start))


def iou(a: Turn, b: Turn) -> float:
    whole = max(a.end, b.end) - min(a.start, b.start)
    return common(a, b) / whole if whole > 0 else 0.0


def canonical(label: str) -> str:
    """S01 for S1, S01 or G1; raises ValueError for what is no label with an ordinal above zero."""
    m = LABEL.fullmatch(label)
    if not m or not int(m[1]):
        raise ValueError(f"no speaker label: {label!r}")
    return f"S{int(m[1]):02d}"


def scan(text: str) -> list[tuple[Turn | None, str | None]]:
    """Per start marker its turn, or None and why it is dropped."""
    out: list[tuple[Turn | None, str | None]] = []
    for m in START.finditer(text):
        who, begin = canonical(m[2]), float(m[1])
        stop = STAMP.search(text, m.end())
        body = text[m.end() : stop.start()].strip() if stop else ""
        why = "no end" if not stop else "ends early" if float(stop[1]) < begin else None if body else "no text"
        out.append((None, why) if why else (Turn(begin, float(stop[1]), who, body), None))
    return out


def parse(text: str) -> list[Turn]:
    """The turns of decoder text `[start][Sxx]text[end]`; an end that is missing is the next number in brackets."""
    return [t for t, _ in scan(text) if t]


def reparse(text: str) -> list[Turn]:
    """As parse(), by a second method: the text's stamps as tokens, from the last to the first."""
    out, stop = [], None
    for m in reversed(list(re.finditer(r"\[(\d+(?:\.\d+)?)\](?:\[([SG][^\]]*)\])?", text))):
        if m[2] is not None:
            who = canonical(m[2])
            body = text[m.end() : stop[0]].strip() if stop else ""
            if body and stop[1] >= float(m[1]):
                out.append(Turn(float(m[1]), stop[1], who, body))
        stop = m.start(), float(m[1])
    return out[::-1]


def repeats(text: str) -> bool:
    """Whether the text ends in eight copies of a unit of up to 128 characters, one of them a letter or digit."""
    tail = re.sub(r"\s+", "", text)[-LOOP_TAIL:]
    if len(tail) < LOOP_LEAST:
        return False
    for n in range(1, min(LOOP_UNIT, len(tail) // LOOP_RUNS) + 1):
        if tail[-n * LOOP_RUNS :] == tail[-n:] * LOOP_RUNS and any(c.isalnum() for c in tail[-n:]):
            return True
    return False


def only_markers(text: str) -> bool:
    bare = re.sub(r"\s+", "", text)
    return len(START.findall(bare)) >= MARKERS_LEAST and not STAMP.sub("", START.sub("", bare)).strip(MARKER_STRIP)


def short_text_loop(text: str) -> bool:
    """Whether the last turns are mostly one text of up to two characters, at an impossible rate."""
    bare = re.sub(r"\s+", "", text)
    if len(START.findall(bare)) < SHORT_LEAST:
        return False
    try:
        seen = parse(bare[-SHORT_TAIL:])[-SHORT_SEEN:]
    except ValueError:
        return False
    by_text: dict[str, list[Turn]] = {}
    for t in seen:
        key = t.text.strip(MARKER_STRIP + "、")
        if 0 < len(key) <= 2:
            by_text.setdefault(key, []).append(t)
    top = max(by_text.values(), key=len, default=[])
    if sum(map(len, by_text.values())) < SHORT_LEAST or len(top) < max(SHORT_LEAST, SHORT_SHARE * len(seen)):
        return False
    return len(top) >= SHORT_RATE * max(0.1, max(t.end for t in top) - min(t.start for t in top))


def terminal(text: str) -> bool:
    return bool(re.search(r"[.!?。！？]$", re.sub(r"[\"'”’)\]]+$", "", text.strip()))) and not open_ended(text)


def open_ended(text: str) -> bool:
    return bool(re.search(r"(\.{2,}|[…⋯])\s*$", text))
