"""Approximate nearest neighbours by a block matrix join of int8 tiles.

Vectors are coded to int8 with a scale of their own.  Queries and vectors are
dealt to blocks, and a pair of blocks is one tile: the product of its codes,
taken in float32 (whole numbers below 2**24, so exact), gives inner products up
to a bound that follows from the lengths of the coding errors.  For each query
the tile keeps every vector whose upper bound reaches the k-th largest lower
bound of distinct ids, recomputes those in double precision and hands on its k best; tiles are
merged by heaps, in shares of ``FAN`` tiles at most, until one list is left.
No true neighbour is lost, so recall is 1.

Defined cases: vectors that are NULL, zero, or hold NULL, NaN or infinite
components take no part, as query or as candidate; only vectors of equal length
are compared; a query's own rows (the same vec_id) are no candidates; of rows
that repeat a vec_id, the largest product counts; ties go to the smaller vec_id;
a query with fewer than k candidates gets all of them; rows with a NULL vec_id
take no part.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statlens.llm.common import written

BLOCK_ROWS = 16_384
BLOCK_QUERIES = 16_384
TILE = 256
FAN = 64


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim) of the vectors that take part, components as double."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
            .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
            .filter(finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v")))


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as float32), length of each coded vector, of each vector and
    of each coding error."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None])
    back = codes * scale[:, None]
    return codes.astype(np.float32), scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def tile(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int):
    """For each query its k best of ``x``: lists of (query row, id, score)."""
    qc, qs, ql, qe = coded(q)
    by_id = np.argsort(xid, kind="stable")
    xid, x = xid[by_id], x[by_id]
    firsts = np.flatnonzero(np.r_[True, xid[1:] != xid[:-1]])
    xc, xs, xl, xe = coded(x)
    rows: list[tuple] = []
    pieces = range(0, q.shape[1], 1040)  # 1040 * 127 * 127 < 2**24
    for a in range(0, len(q), TILE):
        at = slice(a, a + TILE)
        near = sum((qc[at, j:j + 1040] @ xc[:, j:j + 1040].T).astype(np.float64) for j in pieces)
        near *= qs[at, None] * xs[None]
        # q.x = q'.x' + q'.(x-x') + (q-q').x, so the error is at most:
        slack = (ql[at, None] * xe[None] + qe[at, None] * (xl + xe)[None]) * (1 + 1e-9) + 1e-12 * (ql[at, None] * xl[None])
        own = qid[at, None] == xid[None]
        low = np.where(own, -np.inf, near - slack)
        if len(firsts) < len(x):  # an id's vectors count once, or k of them would hide the other ids
            low = np.maximum.reduceat(low, firsts, axis=1)
        if len(firsts) > k:
            floor = np.partition(low, len(firsts) - k, axis=1)[:, len(firsts) - k]
        else:
            floor = np.full(len(low), -np.inf)
        for r, (hit, mine) in enumerate(zip(near + slack >= floor[:, None], own)):
            hit = np.flatnonzero(hit & ~mine)
            score = np.add.accumulate(x[hit] * q[a + r], axis=1)[:, -1]  # summed in the order of components
            order = np.lexsort((xid[hit], -score))
            rows.append((qid[a + r], xid[hit][order], score[order]))
    return rows


def first_of(ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[float, int]]:
    """The first k distinct ids of a list in order."""
    out, seen = [], set()
    for i, s in zip(ids.tolist(), scores.tolist()):
        if i not in seen:
            seen.add(i)
            out.append((-s, i))
            if len(out) == k:
                break
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, rows: int = BLOCK_ROWS, queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of each
    query: the rows of ``vectors`` (vec_id, embedding) where ``is_query``."""
    spark = vectors.sparkSession
    data = written(usable(vectors).dropDuplicates(["vec_id", "v"]), "vectors")  # else a repeated row would fill a block
    n, m = data.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    blocks, groups = max(1, -(-n // rows)), max(1, -(-m // queries))
    spread = F.xxhash64("vec_id", "v")

    def each(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    left = (data.filter(is_query)
            .select(F.col("vec_id").alias("qi"), F.col("v").alias("qv"), F.col("dim").alias("qd"),
                    F.pmod(spread, F.lit(groups)).alias("qg"), each(blocks).alias("qb")))
    right = data.select(F.col("vec_id").alias("xi"), F.col("v").alias("xv"), F.col("dim").alias("d"),
                        F.pmod(spread, F.lit(blocks)).alias("b"), each(groups).alias("g"))

    def tiles(key, q: pa.Table, x: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if q.num_rows and x.num_rows:
            qv, xv = (np.array(c.combine_chunks().flatten()).reshape(len(c), -1) for c in (q["qv"], x["xv"]))
            qi, xi = q["qi"].to_numpy(), x["xi"].to_numpy()
            for query, ids, scores in tile(qv, qi, xv, xi, k):
                out += [(int(query), i, -s) for s, i in first_of(ids, scores, k)]
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()),
                         pa.array([key[2].as_py()] * len(out), pa.int64())], ["query_id", "vec_id", "score", "b"])

    found = left.groupBy("qd", "qg", "qb").cogroup(right.groupBy("d", "g", "b")).applyInArrow(
        tiles, "query_id long, vec_id long, score double, b long")

    def merged(t: pd.DataFrame) -> pd.DataFrame:
        heap = list(zip((-t["score"]).tolist(), t["vec_id"].tolist()))
        heapq.heapify(heap)
        best: dict[int, float] = {}  # of a repeated id, the first is the best
        while heap and len(best) < k:
            s, i = heapq.heappop(heap)
            best.setdefault(i, -s)
        return pd.DataFrame({"query_id": t["query_id"].iloc[0], "rank": np.arange(1, len(best) + 1, dtype=np.int32),
                             "vec_id": list(best), "score": list(best.values())})

    schema = "query_id long, rank int, vec_id long, score double"
    while blocks > FAN:
        blocks = -(-blocks // FAN)
        found = found.withColumn("b", F.floor(F.col("b") / FAN))
        found = (written(found, "merged").groupBy("query_id", "b").applyInPandas(
            lambda key, t: merged(t).assign(b=key[1]).drop(columns="rank"), "query_id long, vec_id long, score double, b long"))
    return found.groupBy("query_id").applyInPandas(merged, schema)


#: op2 in DuckDB SQL.
ORACLE_SQL = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, max(list_dot_product(c.v, q.v)) AS score FROM v q JOIN v c
      ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v) GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
