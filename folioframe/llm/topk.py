"""Exact top-k inner products by pivot elimination.

Every vector keeps its distances to `n_pivots` pivots (a bounded sample drawn by a hash of the ids, chosen farthest first).
For a query q and a candidate x the triangle inequality gives |d(q,p) - d(x,p)| <= d(q,x) for each pivot p; the largest of these
bounds the inner product from above, (|q|^2 + |x|^2 - bound^2) / 2. Candidates are evaluated in the order of that upper bound and the
search stops once the k-th score found is above the next upper bound, so nothing that could enter the answer is left out.

The stated queries meet the candidates block by block: a candidate block and a query block of bounded sizes form one task, each
block pair returns at most k rows a query, and one aggregation merges them. Inner products are exact integers.

Components are floor(scale * x) taken as doubles; their magnitudes must stay below 2^24, so that sums stay exact.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do rows without an id; an id that
comes more than once stands for one vector, the smallest; only vectors of one length meet; ties go to the smaller id; a query with fewer than
k candidates gets all of them; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import cut_lineage

RESULT = "query_id long, vec_id long, score long"


def quantise(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """One row (vec_id, v) per usable id; v holds whole numbers."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return (
        vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(sound)
        .select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long")).alias("v"))
        .groupBy("vec_id").agg(F.min("v").alias("v"))
    )


def pivots_of(points: DataFrame, n_pivots: int, sample: int) -> dict[int, np.ndarray]:
    """Per vector length, pivots chosen farthest first from the `sample` rows whose ids hash lowest."""
    rows = points.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(len(r["v"]), []).append(r["v"])
    found = {}
    for length, members in by_length.items():
        pool = np.array(members, dtype=np.float64).reshape(len(members), length)
        chosen = [0]
        nearest = np.linalg.norm(pool - pool[0], axis=1)
        while len(chosen) < min(n_pivots, len(pool)) and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, np.linalg.norm(pool - pool[chosen[-1]], axis=1))
        found[length] = pool[chosen]
    return found


def _search(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best k of one candidate block for each query of one query block."""
    if queries.empty or block.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    x, xp = np.array(block["v"].tolist(), dtype=np.int64), np.array(block["to_pivots"].tolist(), dtype=np.float64)
    x = x.reshape(len(block), -1)
    xp = xp.reshape(len(block), -1)
    ids = block["vec_id"].to_numpy()
    norms = (x.astype(np.float64) ** 2).sum(axis=1)
    out = []
    for qid, qv, qp in zip(queries["vec_id"], queries["v"], queries["to_pivots"]):
        q, p = np.array(qv, dtype=np.int64), np.array(qp, dtype=np.float64)
        low = np.zeros(len(ids))
        for i in range(len(p)):
            np.maximum(low, np.abs(xp[:, i] - p[i]), out=low)
        low = np.maximum(0.0, low * (1 - 1e-9) - 1e-6)  # rounding may only loosen the bound
        upper = (norms + float((q.astype(np.float64) ** 2).sum()) - low * low) / 2 + 1e-3
        upper[ids == qid] = -np.inf
        order = np.argsort(-upper, kind="stable")
        order = order[: np.count_nonzero(upper > -np.inf)]
        best_s, best_i = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        at, step = 0, 64
        while at < len(order):
            if len(best_s) == k and best_s[-1] > upper[order[at]]:
                break
            part = order[at:at + step]
            best_s = np.concatenate([best_s, x[part] @ q])
            best_i = np.concatenate([best_i, ids[part]])
            rank = np.lexsort((best_i, -best_s))[:k]
            best_s, best_i = best_s[rank], best_i[rank]
            at += step
        out.append(pd.DataFrame({"query_id": np.full(len(best_s), qid), "vec_id": best_i, "score": best_s}))
    return pd.concat(out, ignore_index=True).astype("int64")


def exact_top_k(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256,
                n_pivots: int = 24, sample: int = 1024, block_rows: int = 4096, query_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `is_query` (a condition on vec_id) holds for, its k best other rows."""
    points = cut_lineage(quantise(vectors, key, vector, scale))
    pivots = pivots_of(points, n_pivots, sample)
    total = points.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    blocks, query_blocks = max(1, math.ceil(total["n"] / block_rows)), max(1, math.ceil(total["q"] / query_rows))

    def measure(frames):
        for frame in frames:
            far = []
            for v in frame["v"]:
                p = pivots.get(len(v))
                far.append(np.linalg.norm(p - np.array(v, dtype=np.float64), axis=1) if p is not None else np.empty(0))
            yield frame.assign(to_pivots=far)

    measured = points.mapInPandas(measure, "vec_id long, v array<long>, to_pivots array<double>").withColumn("dims", F.size("v"))
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    query_block = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(query_blocks)).cast("int")
    # A block of queries visits every candidate block and back; both keys are counts, so each task stays of bounded size.
    asked = measured.where(is_query).withColumn("query_block", query_block).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = measured.withColumn("block", block).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    keys = ("dims", "block", "query_block")
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(lambda q, c: _search(q, c, k), RESULT)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
