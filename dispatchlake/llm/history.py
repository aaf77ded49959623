"""Deduplicating new batches against all history.

A store in a folder holds, batch by batch, the keys of all items and their profiles; it can be closed and opened again.
Keys are addresses, fingerprints of title and content, and rare words. A new batch is read once; Bloom filters, one for
each part of the keys, screen its keys, only the parts that are hit are looked up, and of the profiles only the ranges
that hold a candidate are read. No text of history is read again: a profile holds hashes of the words, which is all that
verification needs.

Two texts that differ in at most DIFFER of their words share one of their first words in any fixed order of words, if
each text gives the share that may differ and one more. The order is by how common words are in the first batch and
stays with the store. Every word leads to all pairs of the texts that give it, however many they are; words that more
than HOT texts give are dealt over several tasks. Pairs are looked at in blocks, on bits of their words that are the more
the longer the texts are and never differ in more places than the words do, so that few pairs are left to verify. No
pair is lost and none has to share a place. Bits are stored once a text; the table of words holds no more than its texts.
Copies of one text are linked to the first and looked up as one.
"""

from __future__ import annotations

import gc
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.functions.ids import normalized_url
from dispatchlake.functions.tables import Scratch, cut, file_system, remove, shared_folder, table
from dispatchlake.llm import components, residue, vectors
from dispatchlake.llm.hashing import mix
from dispatchlake.llm.lookalike import skeleton

#: Share of the words (characters for zh) in which two texts may differ.
DIFFER = 0.15
COSINE = 0.98
#: Texts that may give a word for all its pairs to be looked at in one task; those of more are dealt over several.
HOT = 65_536
#: Texts from which the order of words is taken, about, and words that have a place of their own in it; any order is right.
ORDER_TEXTS, ORDER_WORDS = 20_000, 1 << 17
#: Words whose hashes a task remembers, at most.
KNOWN_WORDS = 1 << 18
#: Words of a text up to which it has 256 bits; each doubling has twice as many.
SHORT = 150
#: Rows of a task, about, pairs that are looked at together, and texts of one side of a block.
ROWS, PAIRS, BLOCK = 250_000, 1 << 19, 64
#: Keys of one Bloom filter, about; a batch has a power of two of them. And bits for each key.
FILTER_KEYS, BITS = 500_000, 12
#: Profiles are kept in ranges of so many item_seq.
RANGE = 1 << 18
_CJK = re.compile("[㐀-鿿豈-﫿]")
_SPACE = re.compile(r"\s+")
#: Addresses that are in their normal form already.
_PLAIN_URL = r"^https?://[a-z0-9.-]+(?:/[^?#\s]*[^?#/\s])?\z"


def pieces(title: str | None, content: str | None, lang: str | None) -> tuple[list[str], bool]:
    """Words of title (as it looks) and content, or their characters for texts in Chinese."""
    text = f"{skeleton(title or '')} {content or ''}"
    if lang == "zh" or lang is None and 2 * len(_CJK.findall(text)) > len(text):
        return list(_SPACE.sub("", text)), True
    return text.split(), False


class _Hashes(dict):
    """Words with their hashes: a word that comes again is not hashed again."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = h
        return h


_HASH = _Hashes()


def _hashes(words: Iterable[str], n: int | None = None) -> np.ndarray:
    return np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words) if n is None else n)


Order = tuple[np.ndarray, np.ndarray]
_NO_ORDER = (np.zeros(1, np.uint32), np.zeros(1, np.int64))


def fingerprints(words: list[str], characters: bool, order: Order = _NO_ORDER) -> np.ndarray:
    """The first words (characters alike) in the order, each with its count, of which any text within DIFFER shares one."""
    return _firsts(counted(_hashes(words)), np.array([0, len(words)]), order)[0]


def _firsts(h: np.ndarray, begin: np.ndarray, order: Order) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of up to 2048 texts whose counted words begin there, and how many each has."""
    low, n = h.astype(np.uint32), np.diff(begin)
    at = np.searchsorted(order[0], low).clip(max=len(order[0]) - 1)
    common = np.where(order[0][at] == low, order[1][at], 0).clip(max=(1 << 21) - 1).astype(np.uint64)
    own = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    sorted_ = np.sort(own << np.uint64(53) | common << np.uint64(32) | low)
    gives = np.minimum(np.floor(DIFFER * n + 1e-9).astype(np.int64) + 1, n)
    return sorted_[np.arange(len(h)) - np.repeat(begin[:-1], n) < np.repeat(gives, n)].astype(np.uint32), gives


def distance(a: list[str], b: list[str]) -> float:
    """Share of the longer text's words that the other lacks, whatever their order."""
    if not a and not b:
        return 0.0
    return 1 - sum((Counter(a) & Counter(b)).values()) / max(len(a), len(b))


def counted(h: np.ndarray, begin: np.ndarray | None = None) -> np.ndarray:
    """Each word's hash with how often the text had it before, so that the common part of two texts is that of two sets.

    ``begin``: where texts begin and end, if there are several; the words of each come out in another order.
    """
    s, begin = h.copy(), np.array([0, len(h)]) if begin is None else begin
    for a, b in pairwise(begin.tolist()):
        s[a:b].sort()
    place = np.arange(len(s))
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    new[begin[:-1][np.diff(begin) > 0]] = True
    nth = place - np.maximum.accumulate(np.where(new, place, 0))
    return mix(s + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_PROFILE = "seq long, n int, words array<int>, rare array<long>, bits binary, text long, exact array<long>"


def _bits(h: np.ndarray) -> bytes:
    """256 bits and more: which places an odd number of words has; two texts differ in no more places than words, at any width both have."""
    return _bits_of(h, np.array([0, len(h)]))[0].tobytes()


def _bits_of(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of several texts whose counted words begin there, as bytes, and where those of each begin and end."""
    n = np.diff(begin)
    places = 256 << np.ceil(np.log2(np.maximum(n - 1, 0) // SHORT + 1)).astype(np.int64)
    start = np.append(0, np.cumsum(places))
    at = (h >> np.uint64(32)).astype(np.int64) & np.repeat(places - 1, n)
    return np.packbits((np.bincount(at + np.repeat(start[:-1], n), minlength=start[-1]) & 1).astype(np.uint8)), start // 8


def _exact(kind: str, value: str | None) -> tuple[int | None, int | None]:
    """Key and check of an address or a whole story."""
    if value is None:
        return None, None
    h = xxhash.xxh3_128_intdigest(f"{kind}{value}".encode("utf8", "surrogatepass"))
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def _profiles(order: Order) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each item its words and its first in the order as hashes, its bits, the hash of its whole text, and what it has in common with its copies."""

    def lists(flat: np.ndarray, begin: np.ndarray, kind: pa.DataType) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(flat, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 2000):
                part = b.slice(i, 2000)
                titles, contents, langs, addresses = (part.column(j).to_pylist() for j in range(1, 5))
                words = [pieces(*x)[0] for x in zip(titles, contents, langs)]
                n = np.fromiter(map(len, words), np.int64, len(words))
                begin = np.append(0, np.cumsum(n))
                h = _hashes(chain.from_iterable(words), int(begin[-1]))
                texts = [xxhash.xxh64_intdigest(h[x:y].tobytes()) - (1 << 63) for x, y in pairwise(begin.tolist())]
                each = counted(h, begin)
                first, gives = _firsts(each, begin, order)
                bits, start = _bits_of(each, begin)
                same = [(*_exact("u", a), *_exact("c", " ".join(f"{t or ''}\n{c or ''}".split()).lower())) for t, c, a in zip(titles, contents, addresses)]  # content_fingerprint's text
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(n, pa.int32()), lists(each.astype(np.uint32).view(np.int32), begin, pa.int32()), lists(first.astype(np.int64), np.append(0, np.cumsum(gives)), pa.int64()),
                        pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(start.astype(np.int32)), pa.py_buffer(bits)]), pa.array(texts, pa.int64()), pa.array(same, pa.list_(pa.int64())),
                    ],
                    names=["seq", "n", "words", "rare", "bits", "text", "exact"],
                )

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each batch hold a word."""
    for b in batches:
        words = [pieces(*x)[0] for x in zip(*(b.column(j).to_pylist() for j in range(3)))]
        begin = np.append(0, np.cumsum([len(w) for w in words], dtype=np.int64))
        word, held = np.unique(counted(_hashes(chain.from_iterable(words), int(begin[-1])), begin).astype(np.uint32), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(held.astype(np.int64))], names=["word", "held"])


def _widths(bits: pa.BinaryArray, words: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width in 64-bit words, from the widest: a matrix with a column for each text that has as many, and the text's column; halves fold."""
    flat, begin = np.frombuffer(b"".join(bits.to_pylist()), np.uint64), np.append(0, np.cumsum(words))
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for w in (int(words.max()) >> k for k in range(int(words.max()).bit_length() - 2)):
        place = np.cumsum(words >= w) - 1
        wide = np.empty((w, place[-1] + 1), np.uint64)
        own = np.flatnonzero(words == w)
        wide[:, place[own]] = flat[begin[own] + np.arange(w)[:, None]]
        if 2 * w in out:
            more = out[2 * w][0]
            wide[:, place[words > w]] = more[:w] ^ more[w:]
        out[w] = wide, place
    return out


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, first) of all pairs of a new text and another that give a word, but those whose bits differ too much.

    Rows with the same key, lo and hi are looked at together; if lo and hi differ, only those of different slices are paired.
    """
    if not (parts := list(batches)):
        return
    rows = pa.Table.from_batches(parts)
    key, lo, hi, part, new, n, seq = (rows[c].to_numpy() for c in ("key", "lo", "hi", "slice", "new", "n", "seq"))
    by = np.lexsort((n, new, part, hi, lo, key))
    key, lo, hi, part, new, n, seq = (x[by] for x in (key, lo, hi, part, new, n.astype(np.int64), seq))
    bits = rows["bits"].combine_chunks().take(pa.array(by))
    bits = bits.combine_chunks() if isinstance(bits, pa.ChunkedArray) else bits
    words = pa.compute.binary_length(bits).to_numpy().astype(np.int64) // 8
    widths, shorter = _widths(bits, words), 2 * (1 - DIFFER) - 1

    def left(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words, at most, that are in one of two texts of a and b words only, and a little."""
        return np.minimum(a - shorter * b, b - shorter * a) + 0.01

    def wider(i: np.ndarray, j: np.ndarray, done: int) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs that differ little at all widths beyond ``done`` that both have."""
        for w in sorted(w for w in widths if w > done):
            both = np.minimum(words[i], words[j]) >= w
            bit, place = widths[w]
            near = ~both
            near[both] = np.bitwise_count(bit[:, place[i[both]]] ^ bit[:, place[j[both]]]).sum(axis=0) <= left(n[i[both]], n[j[both]])
            i, j = i[near], j[near]
        return i, j

    # Runs of one group, slice and age, by size; run r is held against itself and the up to three after it in its group.
    group = np.cumsum(np.append(0, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
    begin = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (part[1:] != part[:-1]) | (new[1:] != new[:-1])))
    end, jobs = np.append(begin[1:], len(key)), []
    for d in range(min(4, len(begin))):
        r, o = begin[: len(begin) - d], begin[d:]
        fit = (group[r] == group[o]) & (new[r] | new[o]) & ((lo[r] == hi[r]) | (part[r] != part[o])) & (d > 0 or lo[r] == hi[r])
        jobs.append(np.stack([r, end[: len(begin) - d], o, end[d:]])[:, fit])
    q0, q1, t0, t1 = np.concatenate(jobs, axis=1)
    size = (q1 - q0) * (t1 - t0)

    def few() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        small = size < BLOCK * 16
        a, b, across, upto = q0[small], t0[small], (t1 - t0)[small], np.append(0, np.cumsum(size[small]))
        for first in range(0, int(upto[-1]), PAIRS):
            p = np.arange(first, min(first + PAIRS, upto[-1]))
            j = np.searchsorted(upto, p, "right") - 1
            p = p - upto[j]
            i, j = a[j] + p // across[j], b[j] + p % across[j]
            ok = (i < j) & (left(n[i], n[j]) >= 0)
            yield wider(i[ok], j[ok], 0)

    def many() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b, c, d in zip(*(x[size >= BLOCK * 16].tolist() for x in (q0, q1, t0, t1))):
            for s in range(a, b, BLOCK):
                e = min(s + BLOCK, b)
                start = s if a == c else c + int(np.searchsorted(n[c:d], int(n[s] * (1 - DIFFER) - 1e-6)))
                stop = c + int(np.searchsorted(n[c:d], n[e - 1] / (1 - DIFFER) + 1e-6, "right"))
                for u in range(start, stop, 8 * BLOCK):
                    v = min(u + 8 * BLOCK, stop)
                    bit, place = widths[int(min(words[s], words[u]))]
                    q, t = bit[:, place[s] : place[e - 1] + 1], bit[:, place[u] : place[v - 1] + 1]
                    differ = np.zeros((e - s, v - u), np.int32 if len(bit) > 256 else np.int16)
                    for x, y in zip(q, t):
                        differ += np.bitwise_count(x[:, None] ^ y)
                    i, j = np.nonzero(differ <= left(n[s:e, None].astype(np.float32), n[u:v].astype(np.float32)))
                    i, j = i + s, j + u
                    yield wider(i[i < j], j[i < j], len(bit))

    def pairs(of: list[np.ndarray]) -> pa.RecordBatch:
        pair = np.unique(np.concatenate(of, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["seq", "first"])

    held: list[np.ndarray] = []
    count = 0
    for i, j in chain(few(), many()):
        i, j = i[seq[i] != seq[j]], j[seq[i] != seq[j]]
        held.append(np.stack([np.maximum(seq[i], seq[j]), np.minimum(seq[i], seq[j])]))
        count += len(i)
        if count > PAIRS or len(held) > 1000:
            held = [np.unique(np.concatenate(held, axis=1), axis=1)]
            if held[0].shape[1] > PAIRS // 2:
                yield pairs(held)
                held = []
            count = sum(x.shape[1] for x in held)
    if held:
        yield pairs(held)


class _Filter:
    """A Bloom filter of 64-bit keys."""

    def __init__(self, bits: bytearray):
        self.bits = np.frombuffer(bits, np.uint8).copy()

    @classmethod
    def sized(cls, n: int) -> _Filter:
        return cls(bytearray(1 << max(10, int(np.ceil(np.log2(BITS * max(n, 1) / 8))))))

    def _at(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        h = mix(keys.view(np.uint64))
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(6):
            yield (h + np.uint64(i) * step) & np.uint64(len(self.bits) * 8 - 1)

    def add(self, keys: np.ndarray) -> None:
        for at in self._at(keys):
            np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self._at(keys):
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def _build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A filter of each part among the rows of a task."""
    rows = [f.drop_duplicates() for f in frames]
    for (parts, part), f in pd.concat(rows).groupby(["parts", "part"]) if rows else ():
        keys = f["key"].drop_duplicates().to_numpy()
        b = _Filter.sized(len(keys))
        b.add(keys)
        yield pd.DataFrame({"parts": [parts], "part": [part], "bits": [b.bits.tobytes()]})


def _screen(key: tuple, keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    hit = np.zeros(len(keys), bool)
    for bits in filters["bits"]:
        hit |= _Filter(bytearray(bits)).has(keys["key"].to_numpy())
    return keys.loc[hit, ["key", "parts", "part"]]


def _dealt(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows with the groups (key, lo, hi) that they are looked at in: of a key in ``hot`` (key, slices) one for any two of its slices, else one."""
    one = lambda c: F.lit(0).alias(c)
    if hot.isEmpty():
        return rows.select("*", one("slice"), one("lo"), one("hi"))
    slices = F.coalesce("slices", F.lit(1))
    sliced = rows.join(hot.select("key", "slices"), "key", "left").withColumn("slice", F.pmod(F.xxhash64("seq"), slices).cast("int"))
    other = sliced.withColumn("other", F.explode(F.sequence(F.lit(0), slices - 1)))
    return other.select(*rows.columns, "slice", F.least("slice", "other").alias("lo"), F.greatest("slice", "other").alias("hi"))


def _let_go(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffles and broadcasts of what is no longer referred to."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


class History:
    """The persistent store under ``path``: opened if it is there, else begun."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, done = spark, path.rstrip("/"), f"{path.rstrip('/')}/done"
        fs, at = file_system(spark, done)
        #: Of each batch the number of parts of its keys; a batch without its row here was broken off and is written again.
        self.parts = [r["parts"] for r in spark.read.schema("batch int, parts int").parquet(done).orderBy("batch").toLocalIterator()] if fs.exists(at) else []

    def _write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        here = f"{self.path}/{name}/{len(self.parts)}"
        write = df.write.option("parquet.enable.dictionary", name != "profiles")  # hashes hardly recur there
        (write.partitionBy(by) if by else write).mode("overwrite").parquet(here)
        return self.spark.read.schema(df.schema).parquet(here)

    def _old(self, name: str, schema: str, only: dict[int, list[int]] | None = None, by: str = "part") -> DataFrame:
        """A table of all batches before; with ``only`` the named parts of each, so that no other folder is read."""
        out = self.spark.createDataFrame([], schema)
        for n in range(len(self.parts)):
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{n}")
            out = out.unionByName(rows if only is None else rows.where(F.col(by).isin(only.get(n, []))))
        return out

    def _found(self, name: str, schema: str, keys: DataFrame) -> DataFrame:
        """Rows of ``name`` in the batches before whose key is among ``keys`` (key, each once), by Bloom filter and hit parts."""
        if not self.parts:
            return self.spark.createDataFrame([], schema)
        sizes = sorted(set(self.parts))
        split = max(1, keys.count() // (FILTER_KEYS * min(sizes)))
        part = lambda p: F.struct(F.lit(p).alias("parts"), F.pmod("key", F.lit(p)).cast("int").alias("part"))
        asks = keys.select("key", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(split)).alias("split"), F.inline(F.array(*map(part, sizes))))
        bits = self._old(f"{name}_filters", "parts int, part int, bits binary").select("*", F.explode(F.expr(f"sequence(0L, {split - 1}L)")).alias("split"))
        by = ["parts", "part", "split"]
        passed = cut(asks.groupBy(*by).cogroup(bits.groupBy(*by)).applyInPandas(_screen, "key long, parts int, part int"))
        hit: dict[int, list[int]] = {}
        for r in passed.select("parts", "part").distinct().toLocalIterator():  # no more than the parts of the store
            hit.setdefault(r["parts"], []).append(r["part"])
        rows = self._old(name, schema, {n: hit.get(p, []) for n, p in enumerate(self.parts)})
        return rows.join(passed.select("key").distinct(), "key", "left_semi")

    def _keep(self, rows: DataFrame, name: str, parts: int) -> None:
        """Rows by part of their key, and the parts' Bloom filters."""
        rows = rows.withColumn("part", F.pmod("key", F.lit(parts)).cast("int")).repartition("part")
        kept = self._write(rows, name, "part")
        self._write(kept.select("key", "part", F.lit(parts).alias("parts")).mapInPandas(_build, "parts int, part int, bits binary"), f"{name}_filters")

    def add(self, items: DataFrame, left_out: DataFrame) -> DataFrame:
        """Links (seq, first) of each new item to earlier ones, of the store or its own batch; then the batch is stored.

        ``items``: item_seq, title, content, lang, url, with item_seq above those in the store. Items whose item_seq is
        in ``left_out`` have no keys. The work follows the batch, but that holders of its words that many give are read.
        """
        scratch = Scratch(self.spark)
        address = F.when(F.trim("url") != "", F.when(F.col("url").rlike(_PLAIN_URL), F.col("url")).otherwise(normalized_url(F.col("url"))))
        read = items.select("item_seq", "title", "content", "lang", address.alias("address"))
        made = read.mapInArrow(_profiles(self._order(items)), _PROFILE)
        mine = self._write(made.withColumn("range", F.floor(F.col("seq") / RANGE).cast("int")), "profiles", "range")

        kept = mine.join(left_out.select(F.col("item_seq").alias("seq")).distinct(), "seq", "left_anti")  # without a shuffle of texts

        # What is the same: the first holder of a key stands for all.
        whole = F.when(F.col("n") > 0, F.struct(F.col("text").alias("key"), F.lit(0).cast("long").alias("check"), F.lit(True).alias("whole")))
        told = [F.struct(F.col("exact")[i].alias("key"), F.col("exact")[i + 1].alias("check"), F.lit(False).alias("whole")) for i in (0, 2)]
        same = scratch.keep(kept.select("seq", F.inline(F.filter(F.array(*told, whole), lambda x: x.isNotNull() & x["key"].isNotNull()))))
        firsts = scratch.keep(same.groupBy("key", "check").agg(F.min("seq").alias("first")))
        schema = "key long, check long, first long, part int"
        before = scratch.keep(self._found("exact", schema, firsts.select("key").distinct()).select("key", "check", "first"))
        least = firsts.unionByName(before).groupBy("key", "check").agg(F.min("first").alias("first"))
        links = scratch.keep(same.join(least, ["key", "check"]).where("first < seq").select("seq", "first", "whole"))
        _let_go(self.spark)

        # What is near: different texts by their first words in the order.
        texts = kept.join(links.where("whole").select("seq"), "seq", "left_anti")
        keys = texts.select(F.explode("rare").alias("key"), "seq")
        given = mine.agg(F.sum(F.size("rare"))).first()[0] or 0
        every = texts.select(F.explode("rare").alias("key"), "seq", "n", "bits", F.lit(True).alias("new"))
        gave = keys.select("key")
        if self.parts:
            old = scratch.keep(self._found("holders", "key long, seq long, part int", scratch.keep(gave.distinct())).select("key", "seq"))
            gave = gave.unionByName(old.select("key"))
            every = every.unionByName(self._profiles_of(old, None).select("key", "seq", "n", "bits", F.lit(False).alias("new")))
            _let_go(self.spark)
        held = gave.groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > HOT)
        hot = scratch.keep(held.select("key", "held", F.ceil(F.col("held") / HOT).cast("int").alias("slices")))
        more = hot.agg(F.sum(F.col("held") * (F.col("slices") - 1))).first()[0] or 0
        parts = 1 + (more + (gave.count() if self.parts else given)) // ROWS
        pairs = scratch.keep(_dealt(every, hot).repartition(parts, "key", "lo", "hi").mapInArrow(_meet, "seq long, first long"))
        _let_go(self.spark)
        pairs = scratch.keep(pairs.distinct())
        used = pairs.select("seq", F.lit(True).alias("new")).unionByName(pairs.select(F.col("first").alias("seq"), F.lit(True).alias("new"))).distinct()
        words = scratch.keep(self._profiles_of(used, mine).select("seq", "n", "words"))
        both = pairs.join(words, "seq").join(words.select(F.col("seq").alias("first"), F.col("n").alias("n_first"), F.col("words").alias("words_first")), "first")
        common = F.size(F.array_intersect("words", "words_first"))
        near = both.where(1 - common / F.greatest("n", "n_first", F.lit(1)) <= DIFFER).select("seq", "first")
        links = self._write(links.select("seq", "first").unionByName(near).distinct(), "links")

        _let_go(self.spark)
        parts = 1 << max(4, (given // FILTER_KEYS).bit_length())
        self._keep(keys, "holders", parts)
        self._keep(firsts.join(before.select("key", "check"), ["key", "check"], "left_anti"), "exact", parts)
        remove(self.spark, scratch.path)
        self.spark.createDataFrame([(len(self.parts), parts)], "batch int, parts int").coalesce(1).write.mode("append").parquet(f"{self.path}/done")
        self.parts.append(parts)
        links = self.spark.read.schema(links.schema).parquet(f"{self.path}/links/{len(self.parts) - 1}")
        _let_go(self.spark)
        return links

    def _order(self, items: DataFrame) -> Order:
        """Words and how many texts hold them, of a part of the store's first batch; of the others none is known."""
        at = f"{self.path}/order"
        if not self.parts:
            some = items.where(F.pmod(F.xxhash64("item_seq", F.lit(5)), F.lit(max(1, items.count() // ORDER_TEXTS))) == 0)
            words = some.select("title", "content", "lang").mapInArrow(_counts, "word long, held long").groupBy("word").agg(F.sum("held").alias("held"))
            words.where("held > 1").orderBy(F.desc("held"), "word").limit(ORDER_WORDS).write.mode("overwrite").parquet(at)
        rows = self.spark.read.schema("word long, held long").parquet(at).toArrow().sort_by("word")  # at most ORDER_WORDS
        return (rows["word"].to_numpy().astype(np.uint32), rows["held"].to_numpy()) if len(rows) else _NO_ORDER

    def _profiles_of(self, wanted: DataFrame, mine: DataFrame | None) -> DataFrame:
        """Profiles of the wanted items (seq and what else), read only from the ranges of earlier batches that hold one, and of ``mine``."""
        schema = f"{_PROFILE}, range int"
        ranges = [r["range"] for r in wanted.select(F.floor(F.col("seq") / RANGE).cast("int").alias("range")).distinct().toLocalIterator()]  # one number a range
        old = self._old("profiles", schema, dict.fromkeys(range(len(self.parts)), ranges), "range")
        return (old.unionByName(mine.select(*old.columns)) if mine is not None else old).join(wanted, "seq")

    def links(self) -> DataFrame:
        """All links found so far."""
        return self._old("links", "seq long, first long")


def stories(links: DataFrame) -> DataFrame:
    """(seq, first) of every item that a link leads to an earlier one; first is the earliest item of all it is linked to, however indirectly."""
    links = cut(links.select("seq", "first").distinct())
    member = components.connected_groups(links.select(F.col("seq").cast("string").alias("a"), F.col("first").cast("string").alias("b")))
    member = cut(member.select(F.col("member").cast("long").alias("seq"), "group"))
    least = member.groupBy("group").agg(F.min("seq").alias("first"))
    return member.join(least, "group").join(links.select("seq").distinct(), "seq", "left_semi").select("seq", "first")


def repeats(items: DataFrame, vecs: DataFrame, path: str | None = None) -> DataFrame:
    """(first_seq, dup_seq) of every item of a later batch that repeats an item before it.

    ``items``: item_seq, batch_no, item_id, title, content, lang, url; ``vecs``: vec_id, item_id, embedding, model. Batch
    0 or null is history. The store is kept under ``path``, or else removed at the end. Batches given together have the
    same rows as one after another. Items whose content is template residue are left out. Null or empty titles, contents
    and addresses count as empty, and an empty address is nobody's. Repeated rows count once; other columns are ignored.
    """
    spark = items.sparkSession
    items = items.select("item_seq", F.coalesce("batch_no", F.lit(0)).alias("batch_no"), "item_id", "title", "content", "lang", "url").where("item_seq is not null")
    store, old = History(spark, path or f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"), F.col("batch_no") == 0
    bad = cut(residue.residue(items).where("field = 'content'").select("item_seq").distinct())
    _let_go(spark)
    if not items.where(old).isEmpty():  # the order of words is that of the first batch
        store.add(items.where(old), bad)
    store.add(items.where(~old), bad)
    good = items.select("item_id", F.col("item_seq").alias("seq")).join(bad.select(F.col("item_seq").alias("seq")), "seq", "left_anti").distinct()
    # Vectors are numbered in the order of their items, so that the least partner is the earliest item's.
    ordered = vecs.join(good, "item_id").select("seq", "vec_id", "embedding", "model").distinct().orderBy("seq", "vec_id")
    ordered = cut(ordered.select(F.monotonically_increasing_id().alias("vec_id"), "seq", "embedding", "model"))
    close = vectors.links(ordered, COSINE)
    owner = ordered.select("vec_id", "seq")
    like = close.join(owner, "vec_id").join(owner.select(F.col("vec_id").alias("other"), F.col("seq").alias("first")), "other").where("first < seq")
    later = items.where(~old).select(F.col("item_seq").alias("seq")).distinct()
    out = stories(store.links().unionByName(like.select("seq", "first"))).join(later, "seq", "left_semi")
    out = cut(out.select(F.col("first").alias("first_seq"), F.col("seq").alias("dup_seq")))
    if path is None:
        remove(spark, store.path)
    return out


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_found of TESTDATA.md."""
    return repeats(table(spark, sf_dir, "news_items"), table(spark, sf_dir, "item_vectors"))
