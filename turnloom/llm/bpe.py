"""BPE encoding and decoding with a pair occurrence index.

Texts fall into chunks at white space and chunks into words. Of a block of texts all words not yet known are encoded together: their
symbols lie in one array, an index maps the rank of each adjacent pair to all its positions, and active ranks are applied in ascending
order; each merge updates the lists of the two pairs beside it. Known words stay in a bounded cache for the rest of the task."""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import table
from .shared import trim

CACHE = 400_000  # words and chunks kept from one block to the next
BLOCK = 1 << 23  # characters of text whose words are encoded together
END = "</w>"
LATIN = "\u0250"  # below it, character classes are the same in every Unicode version
SPACES = regex.compile(r"\p{White_Space}+")
ODD = regex.compile(r"[\x1c-\x1f]")  # white space for str.split, but not for the vocabulary's normaliser


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable in Latin-1, else the next free code point from 256."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    fresh = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(fresh)) for b in range(256)]


class Vocabulary:
    """A vocabulary file of word-end BPE: lower case, NFC, white space dropped, special tokens matched in the raw text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.word = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split").replace(r"\s", r"\p{White_Space}"))
        marks = byte_symbols()
        self.byte = {c: b for b, c in enumerate(marks)}
        self.library = Tokenizer.from_file(path)
        self.inner = np.array([vocab[c] for c in marks], np.int64)
        self.final = np.array([vocab[c + END] for c in marks], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = [vocab[a + b] for a, b in pairs]
        keys = left << 20 | right
        self.key_list = keys.tolist()
        order = np.argsort(keys, kind="stable")
        self.sorted_keys, self.sorted_rank = keys[order], order
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def split_rare(self, chunk: str) -> list[str]:
        marked = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        return [bytes([self.byte[c] for c in w]).decode() for w, _ in marked]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: their tokens joined by spaces, as the vocabulary has no decoder of its own."""
        return " ".join(map(self.token.__getitem__, ids))

    def ranks_of(self, key: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        at = np.minimum(np.searchsorted(self.sorted_keys, key), len(self.sorted_keys) - 1)
        return np.where(self.sorted_keys[at] == key, self.sorted_rank[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (UTF-8), one after the other, and where each word's begin, by one pair occurrence index over all of them."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        n = len(raw)
        sym = self.inner[raw]
        sym[ends - 1] = self.final[raw[ends - 1]]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends - 1] = -1
        prv[np.concatenate(([0], ends[:-1]))] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(pos: np.ndarray, ranks: np.ndarray) -> None:
            """Put positions on the lists of their pairs' ranks; positions without a rank go nowhere."""
            some = ranks >= 0
            if not some.any():
                return
            pos, ranks = pos[some], ranks[some]
            order = np.argsort(ranks, kind="stable")
            pos, ranks = pos[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            begin = 0
            for r, end in zip(ranks[np.concatenate((cuts - 1, [len(ranks) - 1]))].tolist(), [*cuts.tolist(), len(ranks)], strict=True):
                have = index.get(r)
                if have is None:
                    index[r] = [pos[begin:end]]
                    heapq.heappush(heap, r)
                else:
                    have.append(pos[begin:end])
                begin = end

        first = np.flatnonzero(nxt >= 0)
        enter(first, self.ranks_of(sym[first] << 20 | sym[first + 1]))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            pos = lists[0] if len(lists) == 1 else np.concatenate(lists)
            key, new = self.key_list[r], self.merged[r]
            a, b = key >> 20, key & 0xFFFFF
            j = nxt[pos]
            ok = (sym[pos] == a) & (j >= 0)
            ok[ok] = sym[j[ok]] == b
            pos = pos[ok]
            if len(lists) > 1 or a == b:
                pos = np.unique(pos)
            if a == b and len(pos) > 1:  # in a run of equal symbols every other pair is merged, from the left
                keep, taken = [], -1
                for i, k in zip(pos.tolist(), nxt[pos].tolist(), strict=True):
                    if i != taken:
                        keep.append(i)
                        taken = k
                pos = np.array(keep)
            if not len(pos):
                continue
            j = nxt[pos]
            k = nxt[j]
            sym[pos], sym[j], nxt[pos] = new, -1, k
            more = k >= 0
            prv[k[more]] = pos[more]
            right = pos[more]
            p = prv[pos]
            left = p[p >= 0]
            keys = np.concatenate((new << 20 | sym[k[more]], sym[left] << 20 | new))
            if len(keys):
                enter(np.concatenate((right, left)), self.ranks_of(keys))
        live = sym >= 0
        starts = np.concatenate(([0], ends))
        return sym[live], np.concatenate(([0], np.cumsum(live)))[starts]


class Encoder:
    """Encodes texts block by block. For each known chunk it keeps its ids and its tokens, joined by spaces."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.word_ids: dict[str, str] = {}
        self.word_tokens: dict[str, str] = {}
        self.ids: dict = {}
        self.tokens: dict = {}
        self.blank = False  # whether some chunk has no ids

    def split(self, chunk: str) -> list[str]:
        if chunk.isascii() or max(chunk) < LATIN:
            low = chunk.lower()
            if low.isalpha():
                return [low]
            if low[-1] in ",.!?;:" and low[:-1].isalpha():
                return [low[:-1], low[-1]]
            return self.v.word.findall(low)
        # Classes of rarer characters differ between Unicode versions: the vocabulary's own library splits these.
        return self.v.split_rare(chunk)

    def learn(self, seen: set) -> None:
        if len(self.ids) + len(self.word_ids) > CACHE:
            for known in (self.ids, self.tokens, self.word_ids, self.word_tokens):
                known.clear()
        ids, tokens, word_ids, word_tokens = self.ids, self.tokens, self.word_ids, self.word_tokens
        parts, todo = {}, {}
        for c in seen - ids.keys():
            if not isinstance(c, str):
                ids[c], tokens[c] = str(c), self.v.token[c]
                continue
            parts[c] = ws = self.split(c)
            for w in ws:
                if w not in word_ids:
                    todo[w] = None
        if todo:
            flat, at = self.v.encode_words([w.encode() for w in todo])
            at = at.tolist()
            flat = flat.tolist()
            numbers = list(map(str, flat))
            for k, w in enumerate(todo):
                word_ids[w] = " ".join(numbers[at[k] : at[k + 1]])
                word_tokens[w] = self.v.decode(flat[at[k] : at[k + 1]])
        for c, ws in parts.items():
            if len(ws) == 1:
                ids[c], tokens[c] = word_ids[ws[0]], word_tokens[ws[0]]
            else:
                ids[c], tokens[c] = " ".join([word_ids[w] for w in ws]), " ".join([word_tokens[w] for w in ws])
                self.blank |= not ws

    def pieces(self, text: str) -> list:
        """The text's chunks; a special token is its id."""
        if self.v.split and any(s in text for s in self.v.special):
            return [y for x in self.v.split.split(text) for y in ([self.v.special[x]] if x in self.v.special else self.chunked(x))]
        return self.chunked(text)

    @staticmethod
    def chunked(text: str) -> list[str]:
        return [x for x in SPACES.split(text) if x] if ODD.search(text) else text.split()

    def encode(self, texts: list) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids, decoded text) of each text."""
        start = 0
        while start < len(texts):
            end, total, seen = start, 0, set()
            while end < len(texts) and total < BLOCK:
                text = texts[end] or ""
                seen.update(self.pieces(text))
                total += len(text) + 1
                end += 1
            self.learn(seen)
            del seen
            ids, tokens = self.ids.__getitem__, self.tokens.__getitem__
            for text in texts[start:end]:
                p = self.pieces(text or "")
                if self.blank:
                    p = [c for c in p if ids(c)]
                x = " ".join(map(ids, p))
                yield x.count(" ") + 1 if x else 0, x, " ".join(map(tokens, p))
            start = end


def bpe_round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and ids and decoded if whole.

    A null, empty or blank text has no ids. doc_id is passed on as it is, null or repeated; other columns are not read; an empty table
    gives an empty result. The vocabulary's path must be readable on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        encoder = Encoder(path)
        was = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and the collector would walk the cache again and again
        try:
            yield from encoded(encoder, batches)
        finally:
            if was:  # the worker may run other code after this
                gc.enable()

    def encoded(encoder: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for b in batches:
            n, ids, out, full = [], [], [], []
            for k, x, y in encoder.encode(b.column(1).to_pylist()):
                n.append(k)
                ids.append(sha(x))
                out.append(sha(y))
                if whole:
                    full.append((x, y))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if whole:
                cols += [pa.array([[int(i) for i in x.split()] for x, _ in full], pa.list_(pa.int32())), pa.array([y for _, y in full], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if whole else "")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def bpe_decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows with the column decoded, the text of each row's ids. Null or empty ids give an empty text; an id that the vocabulary does not
    have, or a null one, is an error. An empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(path)
        for b in batches:
            at = b.schema.get_field_index(ids)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([v.decode(x or []) for x in b.column(at).to_pylist()], pa.string())], names=[*b.schema.names, "decoded"])

    return rows.drop("decoded").mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in rows.drop("decoded").dtypes), "decoded string"]))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_path())
