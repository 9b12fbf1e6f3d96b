"""Nearest neighbours by inner product: a block matrix join over int8 codes.

Vectors are coded to int8 with one scale each. Queries and candidates are cut into blocks by the hash of their id, and one
task multiplies the codes of a block pair. The lengths of what coding left out bound the error of each
product, so a candidate is dropped only if it cannot be among the best k of its block. What survives is
recomputed in double precision from the original vectors and heaps of k are merged over the blocks. The result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from anchorgrid.llm.common import stash

_FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) without null, empty or zero vectors and without null or non-finite components."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return rows.where("vec_id IS NOT NULL AND v IS NOT NULL").where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))


def code(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, length of the coded vector, length of the rest) of each row."""
    scale = np.abs(v).max(axis=1, keepdims=True) / 127
    codes = np.rint(v / scale).astype(np.int8)
    near = codes * scale
    return codes, scale[:, 0], np.linalg.norm(near, axis=1), np.linalg.norm(v - near, axis=1)


def _tile(k: int, rows: int = 256):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        candidates = candidates.sort_values("vec_id", kind="stable")
        x, y = np.array(queries["v"].tolist()), np.array(candidates["v"].tolist())
        xi, yi = queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
        first = np.flatnonzero(np.append(True, yi[1:] != yi[:-1]))  # rows of one id lie together
        xc, xs, xn, xr = code(x)
        yc, ys, yn, yr = code(y)
        kind = np.float32 if x.shape[1] <= 1024 else np.float64  # holds sums of int8 products without rounding
        right = yc.astype(kind).T
        out = []
        for at in range(0, len(x), rows):
            part = slice(at, at + rows)
            product = (xc[part].astype(kind) @ right).astype(np.float64) * xs[part, None] * ys
            # |x.y - x'.y'| <= |x'| |y - y'| + |x - x'| |y|, and |y| <= |y'| + |y - y'|
            slack = (xn[part, None] * yr + xr[part, None] * (yn + yr)) * (1 + 1e-9) + 1e-12 * xn[part, None] * yn
            low = np.where(xi[part, None] == yi, -np.inf, product - slack)
            if len(first) < len(yi):  # k ids, not k rows, bound what can be left out
                low = np.maximum.reduceat(low, first, axis=1)
            kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
            q, c = np.nonzero((product + slack >= kth[:, None]) & (xi[part, None] != yi))
            exact = np.zeros(len(q))
            for d in range(x.shape[1]):  # summed in order of the components
                exact += x[at + q, d] * y[c, d]
            for i in range(len(low)):
                mine = slice(*np.searchsorted(q, [i, i + 1]))
                best = heapq.nsmallest(k, set(zip((-exact[mine]).tolist(), yi[c[mine]].tolist())))
                out += [(int(xi[at + i]), v, -s) for s, v in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def _heaps(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by query: one heap of k at a time."""
        now, heap = None, []

        def ranked():
            best = sorted(set(heap), key=lambda x: (-x[0], -x[1]))  # repeated rows of one id count once
            return [(now, i + 1, -v, s) for i, (s, v) in enumerate(best[:k])]

        names = ["query_id", "rank", "vec_id", "score"]
        for batch in batches:
            out = []
            for query, vec, score in zip(batch["query_id"].tolist(), batch["vec_id"].tolist(), batch["score"].tolist()):
                if query != now:
                    out += ranked()
                    now, heap = query, []
                item = (score, -vec)
                if item in heap:
                    continue
                if len(heap) < k:
                    heapq.heappush(heap, item)
                else:
                    heapq.heappushpop(heap, item)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(ranked(), columns=names)

    return run


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 20, query_block: int = 4096, candidate_block: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` candidates with the largest inner product, its own id left out.

    Ties go to the smaller vec_id; with fewer candidates all are returned. Vectors that are null, empty, zero or hold null or
    non-finite components take no part, as do rows without an id. Only vectors of one length are compared. Rows that
    repeat a vec_id count as one candidate for each different score. Empty tables give no rows.
    """
    q, c = stash(usable(queries), "queries"), stash(usable(candidates), "candidates")
    nq, nc = -(-q.count() // query_block) or 1, -(-c.count() // candidate_block) or 1
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    size = F.size("v").alias("size")
    q = q.select("vec_id", "v", size, part(nq).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("cb"))
    c = c.select("vec_id", "v", size, part(nc).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))
    keys = ["size", "qb", "cb"]
    tiles = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(_tile(k), _FOUND)
    merged = tiles.repartition("query_id").sortWithinPartitions("query_id")
    return merged.mapInPandas(_heaps(k), "query_id long, rank int, vec_id long, score double")
