"""The most similar vectors of every vector.

An index is fitted on a bounded sample: centroids on two levels, and a four-bit code trained with the score-aware loss,
which weighs the part of the residual along the vector more than the part across it. Every vector is put into its
nearest lists; within a list, tables of the query's products with the code's centroids are summed over the codes of all
vectors, and what comes near enough to the threshold, or to the k best, is reranked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dispatchlake.functions.tables import cut, table

K = 10
THRESHOLD = 0.90
#: Vectors of a model that its index is fitted on, at most.
SAMPLE = 30_000
#: Vectors of a list on average; the number of lists follows the number of vectors up to MOST_LISTS, then lists grow.
LIST = 220
MOST_LISTS = 16_384
#: Lists that a vector is put into.
SPREAD = 3
#: Rows of a block; longer lists are searched as a grid of blocks.
BLOCK = 3_000
#: Score threshold of the anisotropic loss.
ANISOTROPY = 0.2
_SEED = 12345


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def spherical_kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    if k >= len(x):
        return x.copy()
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        empty = np.bincount(near, minlength=k) == 0
        total[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = _unit(total)
    return c.astype(np.float32)


@dataclass
class Code:
    """Four bits for each pair of dimensions."""

    centres: np.ndarray  # (parts, 16, 2)
    weight: float
    slack: float = 1.0

    @classmethod
    def fit(cls, x: np.ndarray, rng: np.random.Generator) -> Code:
        p = _pairs(x)
        d = x.shape[1]
        weight = max(1.0, (d - 1) * ANISOTROPY**2 / (1 - ANISOTROPY**2))
        centres = np.stack([_kmeans2(p[:, m], rng) for m in range(p.shape[1])])
        self = cls(centres, weight)
        for _ in range(2):
            self._refit(p, self.encode(x))
        codes = self.encode(x)
        y = _unit(0.9 * x + (1 - 0.9**2) ** 0.5 * _unit(rng.standard_normal(x.shape) - 0))
        error = np.einsum("ij,ij->i", y, x - self.decode(codes)[:, :d])
        self.slack = float(np.quantile(error, 0.9999) + 0.01)
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes by coordinate descent on the score-aware loss |r|^2 + (weight - 1) (r.x)^2."""
        p = _pairs(x)
        parts = p.shape[1]
        codes = np.stack([np.argmin(((p[:, m, None] - self.centres[m]) ** 2).sum(2), 1) for m in range(parts)], 1)
        r = p - self.centres[np.arange(parts), codes]
        along = np.einsum("imd,imd->i", r, p)
        for _ in range(1):
            for m in range(parts):
                rest = along - np.einsum("id,id->i", r[:, m], p[:, m])
                option = p[:, m, None] - self.centres[m]
                dot = np.einsum("icd,id->ic", option, p[:, m])
                codes[:, m] = np.argmin((option**2).sum(2) + (self.weight - 1) * (rest[:, None] + dot) ** 2, 1)
                r[:, m] = p[:, m] - self.centres[m][codes[:, m]]
                along = rest + np.einsum("id,id->i", r[:, m], p[:, m])
        return codes.astype(np.uint8)

    def _refit(self, p: np.ndarray, codes: np.ndarray) -> None:
        r = p - self.centres[np.arange(p.shape[1]), codes]
        along = np.einsum("imd,imd->i", r, p)
        w = self.weight - 1
        for m in range(p.shape[1]):
            x, rest = p[:, m], along - np.einsum("id,id->i", r[:, m], p[:, m])
            for c in range(16):
                if (own := codes[:, m] == c).sum() > 2:
                    a = own.sum() * np.eye(2) + w * x[own].T @ x[own]
                    b = (x[own] * (1 + w * (rest[own] + (x[own] ** 2).sum(1)))[:, None]).sum(0)
                    self.centres[m, c] = np.linalg.solve(a, b)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.centres[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)

    def scan(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Estimated products (queries, vectors): two four-bit tables at a time, joined to one of 256 entries."""
        tables = np.einsum("qmd,mcd->mcq", _pairs(q), self.centres).astype(np.float32)
        total = np.zeros((len(codes), len(q)), np.float32)
        for m in range(0, codes.shape[1] - 1, 2):
            both = (tables[m][:, None] + tables[m + 1][None]).reshape(256, len(q))
            total += both[codes[:, m].astype(np.int64) * 16 + codes[:, m + 1]]
        if codes.shape[1] % 2:
            total += tables[-1][codes[:, -1]]
        return total.T


def _pairs(x: np.ndarray) -> np.ndarray:
    if x.shape[1] % 2:
        x = np.pad(x, ((0, 0), (0, 1)))
    return x.reshape(len(x), -1, 2)


def _kmeans2(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), 16, replace=len(x) < 16)].astype(np.float64)
    for _ in range(8):
        near = np.argmin(((x[:, None] - c) ** 2).sum(2), 1)
        for j in range(16):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return c


@dataclass
class Index:
    top: np.ndarray
    lists: np.ndarray
    of_top: list[np.ndarray]
    code: Code

    @classmethod
    def fit(cls, x: np.ndarray, n: int) -> Index:
        rng = np.random.default_rng(_SEED)
        x = _unit(x.astype(np.float32))
        k = int(np.clip(n // LIST, 1, min(MOST_LISTS, max(1, len(x) // 4))))
        top = spherical_kmeans(x, max(1, round(k**0.5)), rng)
        near = np.argmax(x @ top.T, axis=1)
        lists, of_top = [], []
        for j in range(len(top)):  # dense places get more lists
            own = x[near == j]
            made = spherical_kmeans(own, max(1, round(k * len(own) / len(x))), rng) if len(own) else top[j : j + 1]
            of_top.append(np.arange(len(made)) + sum(map(len, lists)))
            lists.append(made)
        return cls(top, np.concatenate(lists), of_top, Code.fit(x[: SAMPLE // 3], rng))

    def nearest_lists(self, x: np.ndarray) -> np.ndarray:
        """The SPREAD nearest lists of each vector, searched under its nearest top centroids; -1 where there are fewer."""
        under = min(len(self.top), max(4, len(self.top) // 4))
        score = x @ self.top.T
        reach = np.argpartition(-score, under - 1, axis=1)[:, :under] if under < len(self.top) else np.tile(np.arange(len(self.top)), (len(x), 1))
        best = np.full((len(x), SPREAD), -np.inf, np.float32)
        out = np.full((len(x), SPREAD), -1)
        for j in range(len(self.top)):
            rows = np.flatnonzero((reach == j).any(1))
            if not len(rows) or not len(self.of_top[j]):
                continue
            s = np.concatenate([best[rows], x[rows] @ self.lists[self.of_top[j]].T], 1)
            names = np.concatenate([out[rows], np.broadcast_to(self.of_top[j], (len(rows), len(self.of_top[j])))], 1)
            keep = np.argpartition(-s, SPREAD - 1, axis=1)[:, :SPREAD]
            best[rows], out[rows] = np.take_along_axis(s, keep, 1), np.take_along_axis(names, keep, 1)
        out[~np.isfinite(best)] = -1
        return out


def usable(vectors: DataFrame, asks: str | None = None) -> DataFrame:
    """(vec_id, kind, embedding, asks) of vectors that have a direction; kind is model and dimension."""
    ok = F.expr("size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < float('1e18')) and exists(embedding, x -> abs(x) > float('1e-18'))")
    return vectors.where("vec_id is not null and embedding is not null").where(ok).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.concat_ws(":", F.coalesce("model", F.lit("")), F.size("embedding")).alias("kind"), F.col("embedding").cast("array<float>").alias("embedding"), (F.coalesce(F.col(asks), F.lit(False)) if asks else F.lit(True)).alias("asks")
    )


def fit_indexes(vectors: DataFrame) -> dict[str, Index]:
    """An index for each kind, on a sample of at most SAMPLE vectors of it."""
    out = {}
    for r in vectors.groupBy("kind").count().orderBy("kind").toLocalIterator():
        own = vectors.where(F.col("kind") == r["kind"])
        share = min(1.0, SAMPLE / r["count"])
        rows = own.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(int(SAMPLE * 1.2)).select("embedding").toArrow()
        out[r["kind"]] = Index.fit(_matrix(rows.column(0).combine_chunks()), r["count"])
    return out


def _matrix(a: pa.ListArray) -> np.ndarray:
    flat = a.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(a), -1) if len(a) else np.zeros((0, 1), np.float32)


_ROW = "kind string, list int, b1 int, b2 int, side int, vec_id long, embedding array<float>, codes binary, asks boolean"


def _spread(vectors: DataFrame, indexes, long_lists: dict[tuple[str, int], int], narrow: bool) -> DataFrame:
    """Each vector once for each of its lists (narrow: kind and list only), and there once for each block it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = np.array(b.column(1).to_pylist(), dtype=object)
            ids = b.column(0).to_numpy()
            for kind in sorted(set(kinds)):
                index = indexes.value[kind]
                rows = np.flatnonzero(kinds == kind)
                own = b.column(2).take(pa.array(rows))
                x = _unit(_matrix(own).astype(np.float64)).astype(np.float32)
                lists = index.nearest_lists(x)
                row, _ = np.nonzero(lists >= 0)
                name = lists[lists >= 0]
                if narrow:
                    yield pa.RecordBatch.from_pydict({"kind": [kind] * len(name), "list": pa.array(name, pa.int32())})
                    continue
                codes = index.code.encode(x.astype(np.float64))
                blocks = np.array([long_lists.get((kind, int(n)), 1) for n in name])
                own_block = np.where(blocks > 1, (ids[rows][row] * 2654435761 % 4294967291) % np.maximum(blocks, 1), 0)
                times = np.repeat(np.arange(len(name)), blocks)
                other = np.arange(len(times)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                mine = own_block[times]
                take = row[times]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([kind] * len(times), pa.string()), pa.array(name[times], pa.int32()),
                        pa.array(np.minimum(mine, other), pa.int32()), pa.array(np.maximum(mine, other), pa.int32()),
                        pa.array((mine > other).astype(np.int32)), pa.array(ids[rows][take]),
                        own.take(pa.array(take)).cast(pa.list_(pa.float32())), pa.array([codes[i].tobytes() for i in take], pa.binary()),
                        b.column(3).take(pa.array(rows[take])),
                    ],
                    names=["kind", "list", "b1", "b2", "side", "vec_id", "embedding", "codes", "asks"],
                )

    return vectors.select("vec_id", "kind", "embedding", "asks").mapInArrow(run, "kind string, list int" if narrow else _ROW)


def best_of(ids: np.ndarray, query: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best candidates: score descending, then id."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    start = np.maximum.accumulate(np.where(np.append(True, q[1:] != q[:-1]), np.arange(len(q)), 0)) if len(q) else np.zeros(0, int)
    return order[np.arange(len(q)) - start < k]


def _search(code: Code, qx, qid, dx, did, dcodes, k: int, least: float | None):
    """(query id, vector id, cosine) of the k best of each query, of at least ``least``: a scan of the codes, then exact."""
    out = []
    step = max(1, 4_000_000 // max(1, len(dx)))
    for a in range(0, len(qx), step):
        q = qx[a : a + step]
        s = code.scan(q, dcodes)
        if least is not None:
            i, j = np.nonzero(s >= least - code.slack)
        else:
            near = min(s.shape[1], 6 * k + 20)
            j = np.argpartition(-s, near - 1, axis=1)[:, :near].ravel() if near < s.shape[1] else np.tile(np.arange(s.shape[1]), len(q))
            i = np.repeat(np.arange(len(q)), near)
        other = qid[a + i] != did[j]
        i, j = i[other], j[other]
        exact = np.concatenate([np.zeros(0)] + [np.einsum("ij,ij->i", q[i[c : c + 200_000]], dx[j[c : c + 200_000]]) for c in range(0, len(i), 200_000)])
        if least is not None:
            keep = exact >= least
            i, j, exact = i[keep], j[keep], exact[keep]
        best = best_of(did[j], i, exact, k)
        out.append((qid[a + i[best]], did[j[best]], exact[best]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]


def similar_pairs(vectors: DataFrame, k: int = K, least: float = THRESHOLD, asks: str | None = None) -> DataFrame:
    """(vec_id, other, cosine, rank): of each vector its k most similar of the same model with a cosine of at least ``least``.

    With ``asks``, a boolean column, only its vectors are searched for; the others are there to be found.

    Null vectors, vectors of zeros or with parts that are no number have no row; vectors of different dimension are
    never compared; ties go to the lesser id; a row repeated under one vec_id counts once. Equal vectors are searched
    as one, so a group of copies of any size costs no more than its number. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, asks)
    key = ["kind", "h1", "h2"]
    hashed = rows.select("vec_id", "asks", "kind", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(3), "embedding").alias("h2")).distinct()
    copies = hashed.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.max("asks").alias("any_asks")).where("n > 1")
    copies = cut(copies)
    members = cut(hashed.join(copies, key).select("vec_id", "rep"))
    firsts = (
        members.withColumn("rn", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).where(f"rn <= {k + 1}")
        .groupBy("rep").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    alone = rows.join(members.where("vec_id <> rep").select("vec_id"), "vec_id", "left_anti")
    if asks:
        told = copies.select(F.col("rep").alias("vec_id"), "any_asks")
        alone = alone.join(told, "vec_id", "left").withColumn("asks", F.coalesce("any_asks", "asks"))
    fitted = fit_indexes(rows)
    if not fitted:
        return spark.createDataFrame([], "vec_id long, other long, cosine double, rank int")
    indexes = spark.sparkContext.broadcast(fitted)
    counts = _spread(rows, indexes, {}, True).groupBy("kind", "list").count().where(f"count > {BLOCK}")
    # At most MOST_LISTS rows for each kind.
    long_lists = {(r["kind"], r["list"]): -(-r["count"] // BLOCK) for r in counts.toLocalIterator()}

    def search(f: pd.DataFrame) -> pd.DataFrame:
        code = indexes.value[f["kind"].iloc[0]].code
        f = f.drop_duplicates(["vec_id", "side"])
        x = _unit(np.stack(f["embedding"].to_numpy()).astype(np.float64))
        ids = f["vec_id"].to_numpy()
        codes = np.frombuffer(b"".join(f["codes"]), np.uint8).reshape(len(f), -1)
        a, b = (np.flatnonzero(f["side"].to_numpy() == s) for s in (0, 1))
        meets = ((a, a),) if f["b1"].iloc[0] == f["b2"].iloc[0] else ((a, b), (b, a))
        queries = f["asks"].to_numpy(bool)
        found_ = [_search(code, x[p], ids[p], x[o], ids[o], codes[o], k, least) for p, o in ((p[queries[p]], o) for p, o in meets) if len(p) and len(o)]
        q, n, s = (np.concatenate([y[i] for y in found_] or [np.zeros(0)]) for i in range(3))
        return pd.DataFrame({"q": q.astype(np.int64), "n": n.astype(np.int64), "cosine": s})

    near = _spread(alone, indexes, long_lists, False).groupBy("kind", "list", "b1", "b2").applyInPandas(search, "q long, n long, cosine double")
    near = cut(near.distinct())
    both = near.unionAll(near.select(F.col("n").alias("q"), F.col("q").alias("n"), "cosine")).groupBy("q", "n").agg(F.max("cosine").alias("cosine"))
    order = Window.partitionBy("q").orderBy(F.desc("cosine"), "n")
    top = both.withColumn("rn", F.row_number().over(order)).where(f"rn <= {k + 1}").drop("rn")
    listed = top.join(firsts.withColumnRenamed("rep", "n"), "n", "left").select("q", "cosine", F.explode(F.coalesce("ids", F.array("n"))).alias("other"))
    own = firsts.select(F.col("rep").alias("q"), F.lit(1.0).alias("cosine"), F.explode("ids").alias("other"))
    every = listed.unionByName(own).join(members.withColumnRenamed("rep", "q"), "q", "left").withColumn("vec_id", F.coalesce("vec_id", "q")).where("vec_id <> other")
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "other")))
    return ranked.where(f"rank <= {k}").select("vec_id", "other", "cosine", "rank")


def _links(code: Code, qx, qid, dx, did, dcodes, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (lesser, greater id) that stand for all pairs with a cosine of at least ``least``.

    The least partner of every vector that has a lesser one is among them, and they connect what all pairs connect.
    """
    ids = np.unique(np.concatenate([qid, did]))
    least_of, label, kept = np.arange(len(ids)), np.arange(len(ids)), []
    step = max(1, 4_000_000 // max(1, len(dx)))
    for a in range(0, len(qx), step):
        q = qx[a : a + step]
        i, j = np.nonzero(code.scan(q, dcodes) >= least - code.slack)
        exact = np.concatenate([np.zeros(0)] + [np.einsum("ij,ij->i", q[i[c : c + 200_000]], dx[j[c : c + 200_000]]) for c in range(0, len(i), 200_000)])
        near = exact >= least
        x, y = np.searchsorted(ids, qid[a + i[near]]), np.searchsorted(ids, did[j[near]])
        x, y = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(least_of, y, x)
        while (apart := label[x] != label[y]).any():
            x, y = x[apart], y[apart]
            low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
            hooked, by = np.unique(high, return_index=True)
            kept.append((x[by], y[by]))
            to = np.arange(len(ids))
            to[hooked] = low[by]
            while (to[to] != to).any():
                to = to[to]
            label = to[label]
    has = np.flatnonzero(least_of < np.arange(len(ids)))
    low, high = (np.concatenate(z) for z in zip((least_of[has], has), *kept))
    return ids[low], ids[high]


def links(vectors: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """(vec_id, other), other < vec_id, for the pairs of one model with a cosine of at least ``least``, however many a vector has.

    Of all these pairs each vector that has a lesser partner keeps the least one in every block, and enough more are
    kept to connect what all pairs connect; so a group of any size has rows in proportion to its size. Vectors without
    a direction have no row; equal vectors are searched as one.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    key = ["kind", "h1", "h2"]
    hashed = rows.select("vec_id", "kind", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(3), "embedding").alias("h2")).distinct()
    copies = hashed.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    members = cut(hashed.join(copies, key).where("vec_id <> rep").select("vec_id", F.col("rep").alias("other")))
    alone = rows.join(members.select("vec_id"), "vec_id", "left_anti")
    fitted = fit_indexes(rows)
    if not fitted:
        return spark.createDataFrame([], "vec_id long, other long")
    indexes = spark.sparkContext.broadcast(fitted)
    counts = _spread(alone, indexes, {}, True).groupBy("kind", "list").count().where(f"count > {BLOCK}")
    # At most MOST_LISTS rows for each kind.
    long_lists = {(r["kind"], r["list"]): -(-r["count"] // BLOCK) for r in counts.toLocalIterator()}

    def search(t: pa.Table) -> pa.Table:
        code = indexes.value[t["kind"][0].as_py()].code
        t = t.take(np.flatnonzero(~t.select(["vec_id", "side"]).to_pandas().duplicated().to_numpy()))
        x = _unit(_matrix(t["embedding"].combine_chunks()).astype(np.float64))
        ids, side = t["vec_id"].to_numpy(), t["side"].to_numpy()
        codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(len(t), -1)
        a, b = (np.flatnonzero(side == s) for s in (0, 1))
        if t["b1"][0].as_py() == t["b2"][0].as_py():
            b = a
        low, high = _links(code, x[a], ids[a], x[b], ids[b], codes[b], least) if len(a) and len(b) else (ids[:0], ids[:0])
        return pa.table({"vec_id": pa.array(high, pa.int64()), "other": pa.array(low, pa.int64())})

    near = _spread(alone, indexes, long_lists, False).groupBy("kind", "list", "b1", "b2").applyInArrow(search, "vec_id long, other long")
    return near.unionByName(members).distinct()


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_found of TESTDATA.md."""
    pairs = similar_pairs(table(spark, sf_dir, "item_vectors").select("vec_id", "embedding", "model"))
    return pairs.select(F.least("vec_id", "other").alias("vec_lo"), F.greatest("vec_id", "other").alias("vec_hi")).distinct()


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K, block: int = 16_000) -> DataFrame:
    """(vec_id, other, cosine, rank): of each query its k most similar among all ``vectors`` of its model, in blocks.

    All codes are scanned for each query, so the work is their product: it is meant for a stated set of queries.
    """
    spark = vectors.sparkSession
    rows, asked = usable(vectors), usable(queries)
    fitted = fit_indexes(rows)
    if not fitted:
        return spark.createDataFrame([], "vec_id long, other long, cosine double, rank int")
    codes = spark.sparkContext.broadcast({kind: i.code for kind, i in fitted.items()})
    blocks = {name: max(1, -(-df.count() // size)) for name, df, size in (("q", asked, block // 4), ("d", rows, block))}
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.dropDuplicates(["vec_id"]).select("*", part(blocks["q"]).alias("qb"), each(blocks["d"]).alias("db"))
    d = rows.dropDuplicates(["vec_id"]).select("*", part(blocks["d"]).alias("db"), each(blocks["q"]).alias("qb"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"vec_id": [], "other": [], "cosine": []})
        code = codes.value[left["kind"].iloc[0]]
        x, y = (_unit(np.stack(f["embedding"].to_numpy()).astype(np.float64)) for f in (left, right))
        a, b, s = _search(code, x, left["vec_id"].to_numpy(), y, right["vec_id"].to_numpy(), code.encode(y), k, None)
        return pd.DataFrame({"vec_id": a, "other": b, "cosine": s})

    key = ["kind", "qb", "db"]
    best = q.groupBy(*key).cogroup(d.groupBy(*key)).applyInPandas(search, "vec_id long, other long, cosine double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "other")))
    return ranked.where(f"rank <= {k}")


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_neighbours: the ten most similar vectors, with cosine, of every vector whose id is divisible by 20, against all."""
    vectors = table(spark, sf_dir, "item_vectors").select("vec_id", "embedding", "model")
    return top_k(vectors.where("vec_id % 20 = 0"), vectors).select("vec_id", "other", F.round("cosine", 6).alias("cosine"), "rank")
