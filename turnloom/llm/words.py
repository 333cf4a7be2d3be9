"""Vectorised words, hashes and shingles of a batch of texts.

A word is a maximal run of bytes outside space and \\t \\n \\v \\f \\r of the UTF-8 text with A-Z lowered. Hashes are 64-bit polynomial
hashes over the words joined by one space, finished with a bijective mixer, so equal word sequences have equal hashes in every process."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PI = np.uint64(pow(int(_P), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}
BLOCK = 1 << 18  # bytes of text handled at once


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int, base: np.uint64, name: str) -> np.ndarray:
    have = _tables.get(name)
    if have is None or len(have) < n:
        n = max(n, BLOCK + (1 << 16))
        x = np.full(n, base, np.uint64)
        x[0] = 1
        _tables[name] = have = np.multiply.accumulate(x)
    return have


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """At least n powers of the base of the hashes, or of its inverse."""
    return _powers(n, _PI, "i") if inverse else _powers(n, _P, "p")


def each(column, step: int = 128) -> Iterator:
    """The values of an Arrow column, a few at a time: a batch's texts are never all Python objects at once."""
    for i in range(0, len(column), step):
        yield from column.slice(i, step).to_pylist()


def blocks(texts, size: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts (an Arrow column or a list) as (first index, normalised UTF-8 texts), each run about size bytes; a longer text is a run of its own."""
    start, total, run = 0, 0, []
    for i, t in enumerate(texts if isinstance(texts, list) else each(texts)):
        b = b" ".join((t or "").encode("utf-8", "replace").lower().split())
        if run and total + len(b) > size:
            yield start, run
            start, total, run = i, 0, []
        run.append(b)
        total += len(b) + 1
    if run:
        yield start, run


class Words:
    """Words of some normalised texts: doc (index of the text), start and end (bytes), first (each text's first word), n (words of each)."""

    def __init__(self, norm: list[bytes]):
        buf = np.frombuffer(b"\n".join(norm) + b"\n", np.uint8)
        end = np.flatnonzero((buf == 32) | (buf == 10))
        start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
        doc = np.cumsum(buf[end] == 10) - (buf[end] == 10)
        real = end > start
        self.start, self.end, self.doc = start[real], end[real], doc[real]
        self.n = np.bincount(self.doc, minlength=len(norm)).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.n)[:-1])).astype(np.int64)
        self.buf = buf
        pre = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(len(buf) + 1, _P, "p")[: len(buf)], out=pre[1:])
        self._pre = pre

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inv = _powers(len(self.buf) + 1, _PI, "i")
        return mix((self._pre[end] - self._pre[start]) * inv[start] ^ (end - start).astype(np.uint64))

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.start, self.end)

    def shingles(self, k: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, word position, hash) of every k-word shingle; a text of fewer words gives its whole sequence if whole."""
        n = len(self.start)
        at = np.arange(n)
        pos = at - self.first[self.doc] if n else at
        full = pos + k <= self.n[self.doc] if n else np.zeros(0, bool)
        i = at[full]
        last = i + k - 1
        if whole and n:
            short = at[(pos == 0) & (self.n[self.doc] < k)]
            last = np.concatenate((last, short + self.n[self.doc[short]] - 1))
            i = np.concatenate((i, short))
            order = np.argsort(i, kind="stable")
            i, last = i[order], last[order]
        return self.doc[i], pos[i], self.hashes(self.start[i], self.end[last])


def per_doc_unique(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each doc, flat, with offsets of length n_docs + 1."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    keep = np.ones(len(x), bool)
    keep[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    d, x = d[keep], x[keep]
    return x, np.concatenate(([0], np.cumsum(np.bincount(d, minlength=n_docs)))).astype(np.int64)
