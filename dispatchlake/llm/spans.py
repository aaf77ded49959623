"""Long exact spans shared between records.

Every window of ``span`` code points is owned by the least hash among the shorter grams in it, so equal windows have
equal owners wherever they stand, and neighbouring windows mostly share one. A run of windows of one owner is one
row. A count-min sketch of the owners, made in each partition and merged, overestimates how often each occurs; a second
pass groups exactly those runs whose owner it estimates to be repeated, which loses none. Runs with the same owner and
the same text are settled at once; only where one owner has different runs are the windows themselves compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dispatchlake.functions.tables import cut, table
from dispatchlake.llm.hashing import Rolling, sliding_min

SPAN = 200
#: Cells of a sketch row as a power of two, at most: two rows of bits, 32 MB, are broadcast. A larger corpus only has more false alarms.
MOST_BITS = 27
_CHUNK_BITS = 18
#: Characters whose sketches are merged in one place; the merged ones are joined.
_MERGED = 4_000_000_000
_CHARS = 1_000_000


def _chunks(ids: list, texts: list[str | None], least: int) -> Iterator[tuple[np.ndarray, Rolling]]:
    held, size = [], 0
    for n, t in enumerate(texts):
        if t is None or len(t) < least or ids[n] is None:
            continue
        if held and size + len(t) > _CHARS:
            yield np.array([ids[i] for i in held], np.int64), Rolling([texts[i] for i in held])
            held, size = [], 0
        held.append(n)
        size += len(t)
    if held:
        yield np.array([ids[i] for i in held], np.int64), Rolling([texts[i] for i in held])


def owned_runs(r: Rolling, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, text number, first and last window start (within all texts) of each run of windows of one owner."""
    k = span // 2
    low = sliding_min(r.grams(k), span - k + 1)
    owner = np.repeat(np.arange(len(r.size)), np.maximum(r.size - span + 1, 0))
    start = np.arange(len(owner)) - np.repeat(np.append(0, np.cumsum(np.maximum(r.size - span + 1, 0)))[:-1] - r.begin[:-1], np.maximum(r.size - span + 1, 0))
    if not len(start):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    low = low[start]
    new = np.append(True, (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return low[first], owner[first], start[first], start[last]


def _cells(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(h * np.uint64(m)) >> np.uint64(64 - bits) for m in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _sketch(batches: Iterator[pa.RecordBatch], span: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The partition's sketch as rows (chunk of cells, cells, counts)."""
    each: list[list[np.ndarray]] = [[], []]
    for b in batches:
        for _, r in _chunks(b.column(0).to_pylist(), b.column(1).to_pylist(), span):
            for row, c in zip(each, _cells(owned_runs(r, span)[0], bits)):
                row.append(c)
    for row, cells in enumerate(each):
        if not cells:
            continue
        cell, n = np.unique(np.concatenate(cells), return_counts=True)
        n = np.minimum(n, 2).astype(np.uint8)
        chunk = cell >> np.uint64(_CHUNK_BITS)
        at = np.append(np.append(0, np.flatnonzero(chunk[1:] != chunk[:-1]) + 1), len(cell))
        inner = (cell & np.uint64((1 << _CHUNK_BITS) - 1)).astype(np.uint32)
        for a, z in zip(at[:-1], at[1:]):
            yield pa.RecordBatch.from_pydict({"chunk": [row << 32 | int(chunk[a])], "cells": [inner[a:z].tobytes()], "counts": [n[a:z].tobytes()]})


def _merge(f: pd.DataFrame) -> pd.DataFrame:
    """Sum of sketches of one chunk: bits of the cells that hold anything, and of those that hold two or more."""
    total = np.zeros(1 << _CHUNK_BITS, np.uint8)
    for cells, counts in zip(f["cells"], f["counts"]):
        at = np.frombuffer(cells, np.uint32)
        total[at] = np.minimum(total[at] + np.frombuffer(counts, np.uint8), 2)
    return pd.DataFrame({"chunk": f["chunk"].iloc[:1], "some": [np.packbits(total > 0).tobytes()], "bits": [np.packbits(total > 1).tobytes()]})


def _join(f: pd.DataFrame) -> pd.DataFrame:
    some, bits = (np.frombuffer(b"".join(f[c]), np.uint8).reshape(len(f), -1) for c in ("some", "bits"))
    seen, twice = np.zeros_like(some[0]), np.zeros_like(some[0])
    for a, b in zip(some, bits):
        twice |= b | (seen & a)
        seen = seen | a
    return pd.DataFrame({"chunk": f["chunk"].iloc[:1], "bits": [twice.tobytes()]})


def repeated_sketch(docs: DataFrame, span: int) -> tuple[int, list[np.ndarray]]:
    """Bits of the cells whose merged count is two or more, for both rows of the sketch."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(4 * chars / (span / 4) + 1)), _CHUNK_BITS, MOST_BITS))
    parts = docs.mapInArrow(lambda b: _sketch(b, span, bits), "chunk long, cells binary, counts binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(1 + chars // _MERGED)))
    merged = parts.groupBy("chunk", "part").applyInPandas(_merge, "chunk long, some binary, bits binary").groupBy("chunk").applyInPandas(_join, "chunk long, bits binary")
    out = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(2)]
    step = (1 << _CHUNK_BITS) // 8
    for chunk, packed in merged.toLocalIterator():
        at = (chunk & 0xFFFFFFFF) * step
        out[chunk >> 32][at : at + step] = np.frombuffer(packed, np.uint8)
    return bits, out


def _estimated(h: np.ndarray, bits: int, sketch: list[np.ndarray]) -> np.ndarray:
    keep = np.ones(len(h), bool)
    for row, c in zip(sketch, _cells(h, bits)):
        c = c.astype(np.int64)
        keep &= (row[c >> 3] >> (7 - (c & 7)) & 1).astype(bool)
    return keep


def shared_marks(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, start, end): stretches of a text in runs of ``span`` or more found in the text of another doc_id.

    The stretches may overlap; together they cover exactly the shared code points. Null ids and texts, and texts under
    ``span``, have none; rows repeated under one doc_id and repeats inside a text don't count; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits, sketch = repeated_sketch(docs, span)
    kept = docs.sparkSession.sparkContext.broadcast(sketch)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, r in _chunks(b.column(0).to_pylist(), b.column(1).to_pylist(), span):
                h, doc, first, last = owned_runs(r, span)
                k = _estimated(h, bits, kept.value)
                h, doc, first, last = h[k], doc[k], first[k], last[k]
                text = r.of(first, last + span)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (h.view(np.int64), text.view(np.int64), ids[doc], (first - r.begin[doc]).astype(np.int32), (last - r.begin[doc]).astype(np.int32))],
                    names=["owner", "run", "doc_id", "first", "last"],
                )

    every = cut(docs.mapInArrow(runs, "owner long, run long, doc_id long, first int, last int"))
    each = every.groupBy("owner", "run").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(F.struct("doc_id", "first", "last")).alias("at"))
    owners = each.groupBy("owner").agg(F.min("lo").alias("least"), F.max("hi").alias("most"), F.count("*").alias("n")).where("least <> most")
    each = cut(each.join(owners.select("owner", "n"), "owner"))
    same = each.where("lo <> hi").select("owner", "run")
    settled = every.join(same, ["owner", "run"]).select("doc_id", F.col("first").alias("start"), (F.col("last") + span).alias("end"))

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), 2000):
                g = f.iloc[i : i + 2000]
                r = Rolling([t[a : z + span] for t, a, z in zip(g["text"], g["first"], g["last"])])
                n = r.size - span + 1
                off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(r.begin[:-1], n) + off
                row = np.repeat(np.arange(len(g)), n)
                yield pd.DataFrame({"owner": g["owner"].to_numpy()[row], "run": g["run"].to_numpy()[row], "off": off, "window": r.of(at, at + span).view(np.int64), "lo": g["lo"].to_numpy()[row], "hi": g["hi"].to_numpy()[row]})

    open_ = each.where("n > 1").select("owner", "run", "lo", "hi", F.col("at.doc_id").alias("doc_id"), F.col("at.first").alias("first"), F.col("at.last").alias("last"))
    texts = docs.where(F.length("text") >= span)
    cutout = open_.join(texts, "doc_id").select("owner", "run", "lo", "hi", F.lit(0).alias("first"), (F.col("last") - F.col("first")).alias("last"), F.substring("text", F.col("first") + 1, F.col("last") - F.col("first") + span).alias("text"))
    seen = cutout.mapInPandas(windows, "owner long, run long, off int, window long, lo long, hi long")
    seen = cut(seen)
    both = seen.groupBy("owner", "window").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).where("least <> most").select("owner", "window")
    hits = seen.where("lo = hi").join(both, ["owner", "window"]).select("owner", "run", "off").distinct()
    compared = every.join(hits, ["owner", "run"]).select("doc_id", (F.col("first") + F.col("off")).alias("start"), (F.col("first") + F.col("off") + span).alias("end"))
    return settled.unionByName(compared)


def merge_spans(marks: DataFrame) -> DataFrame:
    """Maximal stretches: overlapping and adjoining ones joined. A text's own stretches are sorted together."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    so_far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(F.col("start") <= F.col("so_far"), 0).otherwise(1)).over(w)
    return (
        marks.withColumn("so_far", so_far).withColumn("part", part).groupBy("doc_id", "part")
        .agg(F.min("start").alias("span_start"), F.max("end").alias("span_end")).drop("part")
    )


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p10_found of TESTDATA.md."""
    spans = merge_spans(shared_marks(table(spark, sf_dir, "documents")))
    return spans.select("doc_id", F.col("span_start").cast("int"), F.col("span_end").cast("int"))


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share) of every document; null and empty texts have 0 of 0 and share 0."""
    docs = table(spark, sf_dir, "documents")
    held = found(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"))
    n = F.coalesce(F.length("text"), F.lit(0))
    return docs.select("doc_id", n.cast("long").alias("n_chars")).distinct().join(held, "doc_id", "left").select(
        "doc_id", "n_chars", F.coalesce("shared", F.lit(0)).cast("long").alias("shared_chars"),
        F.when(F.col("n_chars") > 0, F.round(F.coalesce("shared", F.lit(0)) / F.col("n_chars"), 6)).otherwise(0.0).alias("share"),
    )
