"""Filling containers of fixed capacity with items.

Items are spread evenly by a hash over groups of a bounded number; each group is packed by itself, greedily largest
first, and then improved by local search: documents are moved, exchanged one for one or two for one between underfull
containers, each step raising the sum of squared fills, until containers run empty. A group loses at most about one
container against packing all items at once.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.functions.tables import cut, table
from dispatchlake.llm.encode import count_tokens

#: Items of a group on average; the number of groups follows the number of items.
GROUP = 20_000
#: Donor visits in one pass over the underfull containers end when a pass empties and improves nothing, or after so many.
PASSES = 6


def fill_greedily(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of item numbers: each takes the largest item that still fits, again and again."""
    by_size: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(sizes):
        by_size[s].append(i)
    present = sum(1 << s for s in by_size)
    bins = []
    while present:
        room, held = capacity, []
        while fits := present & ((1 << (room + 1)) - 1):
            s = fits.bit_length() - 1
            held.append(by_size[s].pop())
            room -= s
            if not by_size[s]:
                present ^= 1 << s
        bins.append(held)
    return bins


class _Search:
    """Local search over the underfull containers of one packing."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins, self.sizes, self.capacity = bins, sizes, capacity
        self.room = [capacity - sum(sizes[i] for i in b) for b in bins]
        self.version = [0] * len(bins)
        self.by_room: dict[int, list[tuple[int, int]]] = defaultdict(list)
        #: (most that the container can take in exchange) -> (container, version, items given back)
        self.give: dict[int, list[tuple[int, int, tuple[int, ...]]]] = defaultdict(list)
        self.rooms = self.gives = 0
        for b in range(len(bins)):
            self._enter(b)

    def _enter(self, b: int) -> None:
        room, held, v = self.room[b], self.bins[b], self.version[b]
        if not held or not room:
            return
        self.by_room[room].append((b, v))
        self.rooms |= 1 << room
        items = held if len(held) <= 8 else held[:4] + held[-4:]
        for n, i in enumerate(items):
            self._offer(self.sizes[i] + room, (b, v, (i,)))
            for j in items[n + 1 :]:
                self._offer(self.sizes[i] + self.sizes[j] + room, (b, v, (i, j)))

    def _offer(self, most: int, entry: tuple) -> None:
        self.give[most].append(entry)
        self.gives |= 1 << most

    def _change(self, b: int, out: tuple[int, ...], new: tuple[int, ...]) -> None:
        for i in out:
            self.bins[b].remove(i)
        self.bins[b].extend(new)
        self.room[b] += sum(self.sizes[i] for i in out) - sum(self.sizes[i] for i in new)
        self.version[b] += 1

    def _roomy(self, size: int, donor: int) -> int | None:
        """The fullest other container with room for ``size``."""
        while (mask := self.rooms >> size) and (key := size + ((mask & -mask).bit_length() - 1)) >= size:
            stack = self.by_room[key]
            while stack and (self.version[stack[-1][0]] != stack[-1][1] or not self.bins[stack[-1][0]]):
                stack.pop()
            if not stack:
                self.rooms &= ~(1 << key)
                continue
            if stack[-1][0] != donor:
                return stack[-1][0]
            return stack[-2][0] if len(stack) > 1 and self.version[stack[-2][0]] == stack[-2][1] else None
        return None

    def _exchange(self, size: int, donor: int, tries: int = 24) -> tuple[int, tuple[int, ...]] | None:
        """Another, fuller container and items in it of less than ``size``, which it can give up to take ``size`` in."""
        mask = self.gives >> size
        low = size - 1
        while mask and tries:
            step = (mask & -mask).bit_length()
            mask >>= step
            low += step
            stack = self.give[low]
            while stack and self.version[stack[-1][0]] != stack[-1][1]:
                stack.pop()
            if not stack:
                self.gives &= ~(1 << low)
                continue
            for b, v, items in stack[: -min(len(stack), 4) - 1 : -1]:
                tries -= 1
                back = sum(self.sizes[i] for i in items)
                if b != donor and self.version[b] == v and back < size and self.room[b] <= self.room[donor] + size - back:
                    return b, items
        return None

    def run(self) -> list[list[int]]:
        least = -(-sum(self.sizes) // self.capacity)
        for _ in range(PASSES):
            if sum(map(bool, self.bins)) <= least:
                break
            improved = False
            for donor in sorted((b for b, held in enumerate(self.bins) if held and self.room[b]), key=lambda b: -self.room[b]):
                for i in sorted(self.bins[donor], key=lambda i: -self.sizes[i]):
                    size = self.sizes[i]
                    if (b := self._roomy(size, donor)) is not None and self.room[b] <= self.room[donor] + size:
                        self._change(donor, (i,), ())
                        self._change(b, (), (i,))
                        self._enter(b)
                        improved = True
                    elif (hit := self._exchange(size, donor)) and self.room[hit[0]] < self.room[donor]:
                        b, items = hit
                        self._change(b, items, (i,))
                        self._change(donor, (i,), items)
                        self._enter(b)
                        improved = True
                self._enter(donor)
            if not improved:
                break
        return [b for b in self.bins if b]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of item numbers; every size is in 1..capacity."""
    return _Search(fill_greedily(sizes, capacity), sizes, capacity).run()


_OUT = "limit_name string, capacity int, container string, doc_id long, part int, first_token long, n_tokens int, fill int"


def _pack_group(f: pd.DataFrame) -> pd.DataFrame:
    f = f.sort_values(["doc_id"], kind="stable")
    name, capacity, group = f["limit_name"].iloc[0], int(f["capacity"].iloc[0]), int(f["grp"].iloc[0])
    n, ids = f["n_tokens"].to_numpy(), f["doc_id"].to_numpy()
    whole = n // capacity
    row = np.repeat(np.arange(len(n)), whole)
    part = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
    rest = np.flatnonzero(n % capacity)
    bins = pack((n[rest] % capacity).tolist(), capacity)
    out = [(ids[row], part, np.full(len(row), capacity), np.arange(len(row)))]
    if bins:
        item = rest[np.fromiter((i for b in bins for i in b), np.int64)]
        out.append((ids[item], whole[item], n[item] % capacity, len(row) + np.repeat(np.arange(len(bins)), [len(b) for b in bins])))
    doc, part, size, box = (np.concatenate(x) for x in zip(*out))
    fill = np.bincount(box, size).astype(np.int64)
    return pd.DataFrame({
        "limit_name": name, "capacity": capacity, "container": [f"{name}-{group}-{b}" for b in box.tolist()], "doc_id": doc,
        "part": part, "first_token": part.astype(np.int64) * capacity, "n_tokens": size, "fill": fill[box],
    })


def pack_containers(sizes: DataFrame, limits: list[tuple[str, int]], group: int = GROUP) -> DataFrame:
    """One row per piece of an item in a container, for every (name, capacity) of ``limits``.

    ``sizes`` has doc_id and n_tokens. Items with a null id or without tokens are in no container; an item given more
    than once counts once, with its largest size. An item above the capacity fills whole containers and leaves its
    remainder as a piece; no other is split. Limits that are null or under 1 are left out.
    """
    items = cut(sizes.where("doc_id is not null and n_tokens > 0").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("n_tokens").cast("long").alias("n_tokens")))
    groups = max(1, -(-items.count() // group))
    kinds = [F.struct(F.lit(n).alias("limit_name"), F.lit(int(c)).alias("capacity")) for n, c in sorted(set(limits)) if n is not None and c and c > 0]
    if not kinds:
        return items.sparkSession.createDataFrame([], _OUT)
    rows = items.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int")).select("*", F.inline(F.array(*kinds)))
    return rows.groupBy("limit_name", "capacity", "grp").applyInPandas(_pack_group, _OUT)


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p9_containers: every document in containers of each capacity of pack_limits; pack_limits is a table of settings."""
    limits = [(r.limit_name, r.max_tokens) for r in table(spark, sf_dir, "pack_limits").select("limit_name", "max_tokens").toLocalIterator()]
    return pack_containers(count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text"), limits)


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p9_report: containers, tokens and unused room of each capacity."""
    each = containers(spark, sf_dir).groupBy("limit_name", "capacity", "container").agg(F.sum("n_tokens").alias("n"))
    return each.groupBy("limit_name", "capacity").agg(
        F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.sum(F.col("capacity") - F.col("n")).alias("unused"),
        F.ceil(F.sum("n") / F.first("capacity")).alias("least_possible"),
    )
