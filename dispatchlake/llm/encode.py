"""Encoding a corpus with a byte-level BPE by replaying the merges over its words.

A task collects the distinct words of its part of the corpus, lays their bytes out in one array and keeps an
inverted index from token pair to the positions where it stands. The merges are applied in rank order, each at all
of its positions at once; only the neighbours that a merge touches enter the index anew. A word's ids don't depend
on other words, so parts of the corpus are encoded where they lie, without a shuffle; words met before by the same
worker keep their ids.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from dispatchlake.functions.tables import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Words that a worker remembers; beyond that it forgets all and starts again (a memory bound, without effect on results).
REMEMBERED = 1_500_000
#: Characters of text that are encoded together at most, unless one text is longer.
CHUNK = 12_000_000

_EXACT = regex.compile(
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: The same for texts of which every character has the class that the re module gives it.
_FAST = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_CLASSES = [(re.compile(a), regex.compile(b)) for a, b in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\p{White_Space}"))]


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files of this kind."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(moved)}


class Merges:
    """The merge table of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte = np.zeros(256, np.int64)
        for c, b in _byte_symbols().items():
            self.byte[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = self.left << 32 | self.right
        self.rank_of = np.argsort(key, kind="stable")
        self.keys = key[self.rank_of]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 where it is never merged."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and where each word begins (one more entry than words)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        total = int(size.sum())
        begin = np.zeros(len(words) + 1, np.int64)
        np.cumsum(size, out=begin[1:])
        # A gap that never merges parts the words: the symbol of a word's end has no next.
        sym = np.append(self.byte[np.frombuffer(b"".join(words), np.uint8)], -1)
        nxt, prv = np.arange(1, total + 2), np.arange(-1, total)
        nxt[begin[1:][size > 0] - 1] = total
        prv[begin[:-1][size > 0]] = total
        prv[total] = total
        nxt[total] = total
        alive = np.ones(total + 1, bool)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(rank: np.ndarray, pos: np.ndarray) -> None:
            keep = rank >= 0
            if not keep.any():
                return
            rank, pos = rank[keep], pos[keep]
            if len(rank) > 1:
                order = np.argsort(rank, kind="stable")
                rank, pos = rank[order], pos[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, p in zip(rank[np.append(0, cuts)].tolist(), np.split(pos, cuts) if len(cuts) else [pos]):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(queue, r)

        at = np.arange(total)
        enter(self.ranks(sym[:total], sym[nxt[:total]]), at)
        while queue:
            r = heapq.heappop(queue)
            found = index.pop(r)
            p = found[0] if len(found) == 1 else np.concatenate(found)
            a, b, made = self.left[r], self.right[r], self.made[r]
            p = p[alive[p] & (sym[p] == a) & (sym[nxt[p]] == b)]
            if not len(p):
                continue
            if len(found) > 1 or a == b:
                p = np.unique(p)
            if a == b and len(p) > 1:  # in a run of equal symbols every other pair is merged, from the left
                chained = np.append(False, nxt[p[:-1]] == p[1:])
                start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(p))))
                p = p[(np.arange(len(p)) - start) % 2 == 0]
            gone = nxt[p]
            alive[gone] = False
            sym[p] = made
            after = nxt[gone]
            nxt[p] = after
            inner = after != total
            prv[after[inner]] = p[inner]
            enter(self.ranks(sym[p], sym[after]), p)
            before = prv[p]
            led = before != total
            if led.any():
                enter(self.ranks(sym[before[led]], sym[p[led]]), before[led])
        alive = alive[:total]
        kept = np.zeros(total + 1, np.int64)
        np.cumsum(alive, out=kept[1:])
        return sym[:total][alive].astype(np.int32), kept[begin]


class Words(dict):
    """Numbers for words in order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    def __init__(self, path: str):
        self.merges = Merges(path)
        self.seen: set[str] = set()
        self.odd = ""
        self.forget()

    def forget(self) -> None:
        self.words, self.done = Words(), 0
        self.ids, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _split(self, text: str) -> list[str]:
        return (_EXACT if self.odd and any(c in text for c in self.odd) else _FAST).findall(text)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of texts their ids one after another and the number of ids of each text."""
        for chars in [set().union(*texts[i : i + 256]) for texts in ([t for t in texts if t],) for i in range(0, len(texts), 256)]:
            for c in chars - self.seen:
                if any(bool(a.match(c)) != bool(b.match(c)) for a, b in _CLASSES):
                    self.odd += c
            self.seen |= chars
        start = 0
        while start < len(texts):
            end, held = start, 0
            while end < len(texts) and (end == start or held + len(texts[end] or "") <= CHUNK):
                held += len(texts[end] or "")
                end += 1
            if len(self.words) > REMEMBERED:
                self.forget()
            which, number = [], self.words.__getitem__
            for t in texts[start:end]:
                w = self._split(t) if t else []
                which.append(np.fromiter(map(number, w), np.int32, len(w)))
            self._learn()
            size = np.diff(self.begin)
            for i in range(0, len(which), 500):
                part = which[i : i + 500]
                n, w = np.fromiter(map(len, part), np.int64, len(part)), np.concatenate(part)
                each = size[w]
                ends = np.cumsum(each)
                flat = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[w] - ends + each, each)]
                yield flat, np.diff(np.append(0, np.append(0, ends)[np.cumsum(n)]))
            start = end

    def _learn(self) -> None:
        new = [w.encode("utf8", "surrogatepass") for w in list(self.words)[self.done :]] if len(self.words) > self.done else []
        if new:
            ids, begin = self.merges.replay(new)
            self.begin = np.append(self.begin, begin[1:] + len(self.ids))
            self.ids = np.append(self.ids, ids)
            self.done = len(self.words)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def _runs(batch: pa.RecordBatch, path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return encoder(path).encode(batch.column(1).to_pylist())


def encode_texts(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row: the text's ids as a list of integers, without special tokens.

    An empty and a null text have an empty list; text that spells a special token is plain text. Rows are neither
    merged nor dropped, whatever their key; other columns are ignored. Texts of any length are encoded whole.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for flat, n in _runs(b, path):
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n)), ids], names=["key", "ids"])
                at += len(n)

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every row, with 0 for an empty and a null text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.concatenate([np.zeros(0, np.int64), *[n for _, n in _runs(b, path)]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["key", "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long")


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_ids of TESTDATA.md."""
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")
