"""Headlines that came to stand over another item of their batch, found and put right."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def plan_repair(similarity: np.ndarray, floor: float, margin: float) -> dict[int, int | None]:
    """For each drifted headline the body it belongs to, or None. Rows are headlines, columns bodies.

    A headline has drifted where its own similarity is under the floor and another's is greater by more than the
    margin. The drifted are matched among themselves, the most similar pair first; what stays under the floor has none.
    """
    n = len(similarity)
    own = np.diag(similarity)
    rest = similarity - np.eye(n) * 1e9
    drifted = [i for i in range(n) if n > 1 and own[i] < floor and rest[i].max() - own[i] > margin]
    plan: dict[int, int | None] = dict.fromkeys(drifted)
    pairs = sorted(((-similarity[i, j], i, j) for i in drifted for j in drifted if i != j and similarity[i, j] >= floor))
    taken: set[int] = set()
    for _, i, j in pairs:
        if plan[i] is None and j not in taken:
            plan[i] = j
            taken.add(j)
    return plan


def repair_headlines(cards: DataFrame, batch: str, key: str, headline: str, body: str, floor: float = 0.45, margin: float = 0.1) -> DataFrame:
    """(batch, key, belongs_to): for drifted headlines of a batch the key of their body, null where none fits.

    ``headline`` and ``body`` are vectors of one size; a batch is what one request made, some twenty cards at most.
    """
    cards = cards.select(batch, key, headline, body)
    kinds = {c: cards.schema[c].dataType.simpleString() for c in (batch, key)}

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.dropna(subset=[headline, body]).sort_values(key)
        keys = f[key].tolist()
        if not keys:
            return pd.DataFrame(columns=[batch, key, "belongs_to"], dtype=object)
        h, b = (np.stack(f[c].to_numpy()).astype(float) for c in (headline, body))
        h, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30) for x in (h, b))
        plan = plan_repair(h @ b.T, floor, margin)
        fits = [None if j is None else keys[j] for j in plan.values()]
        return pd.DataFrame({batch: [f[batch].iloc[0]] * len(plan), key: [keys[i] for i in plan], "belongs_to": fits}, dtype=object)

    return cards.groupBy(batch).applyInPandas(run, f"{batch} {kinds[batch]}, {key} {kinds[key]}, belongs_to {kinds[key]}")
