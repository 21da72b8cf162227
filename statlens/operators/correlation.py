"""Pearson correlation with significance and Fisher intervals.

Counts and moments of a pair are over the rows where both are present: masked Gram
matrices (numpy on Arrow batches, columns shifted by their means), in tiles of
``SIDE`` x ``SIDE`` columns, upper half only.  A task holds at most ``TILES`` tiles; tables with
more columns are read in several scans, each of the columns its tiles need.  Sums of
the tiles' rows are combined by Spark.  Constant columns give NULL.  p-values are
computed on the small result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statlens.functions.columns import as_double, as_list, join_on, numeric_columns, q
from statlens.functions.dist import two_sided_z
from statlens.functions.udfs import t_two_sided_p

_SUMS = ("n", "x", "y", "xx", "yy", "xy")
#: Columns of a tile, tiles whose sums a task holds (3 MB each), doubles of the rows it works on at once.
SIDE, TILES, CELLS = 256, 64, 1 << 20


def _tile_rows(cols: list[int], tiles: list[tuple[int, int]], by: list[str]):
    """Per task and group, for each tile (p, q) and column i of block p: the six sums over the rows where i and j of block q are present.

    ``cols`` are the blocks' columns in the order of the rows' array."""
    at = {c: k for k, c in enumerate(cols)}
    blocks = {b: [k for c, k in at.items() if c // SIDE == b] for b in {x for t in tiles for x in t}}
    span = {b: slice(k[0], k[-1] + 1) for b, k in blocks.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, dict] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for key, sums in total.items():
                for (p, q_), part in sums.items():
                    i = len(part[0])
                    flat = part.transpose(1, 0, 2).reshape(i, -1)
                    cells = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32), flat.ravel())
                    fixed = [pa.array([v] * i, t) for v, t in zip(key, types)]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array([p] * i, pa.int32()), pa.array([q_] * i, pa.int32()),
                                                      pa.array(range(i), pa.int32()), cells], [*by, "_p", "_q", "_i", "_sums"])
            total.clear()

        types: list[pa.DataType] = []
        for whole in batches:
            types = [whole.schema.field(b).type for b in range(len(by))]
            step = max(1, CELLS // len(cols))
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                x = b.column(len(by)).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(cols))
                keys = list(zip(*(b.column(c).to_pylist() for c in range(len(by))))) if by else [()] * b.num_rows
                groups: dict[tuple, list[int]] = {}
                for r, key in enumerate(keys):
                    groups.setdefault(key, []).append(r)
                for key, rows in groups.items():
                    a = x[rows] if len(groups) > 1 else x
                    m = (~np.isnan(a)).astype(float)
                    a = np.nan_to_num(a)
                    sums = total.setdefault(key, {})
                    for t in tiles:
                        (a0, m0), (a1, m1) = ((a[:, span[e]], m[:, span[e]]) for e in t)
                        part = np.stack([m0.T @ m1, a0.T @ m1, m0.T @ a1, (a0 * a0).T @ m1, m0.T @ (a1 * a1), a0.T @ a1])
                        sums[t] = sums[t] + part if t in sums else part
                    if sum(map(len, total.values())) > TILES and len(total) > 1:  # many groups: Spark adds up the rest
                        yield from out()
        yield from out()

    return run


def _tile_groups(k: int) -> list[list[tuple[int, int]]]:
    """The tiles of k columns in groups that one scan sums: squares of blocks on and above the diagonal."""
    blocks, side = -(-k // SIDE), math.isqrt(TILES)
    out = []
    for a in range(0, blocks, side):
        for b in range(a, blocks, side):
            out.append([(p, q_) for p in range(a, min(a + side, blocks)) for q_ in range(max(b, p), min(b + side, blocks))])
    return out


def _pairs(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """(by..., var1, var2, n, corr) of every ordered pair and the diagonal."""
    k, keys = len(cols), [q(c) for c in by]
    base = df.select(*keys, *[as_double(c).alias(f"_x{i}") for i, c in enumerate(cols)])
    means = base.groupBy(*keys).agg(F.array(*[F.avg(f"_x{i}") for i in range(k)]).alias("_m"))
    centred = join_on(base, means, by)
    schema = T.StructType([df.schema[c] for c in by] + T._parse_datatype_string("_p int, _q int, _i int, _sums array<double>").fields)
    parts = []
    for tiles in _tile_groups(k):
        used = sorted({c for t in tiles for b in t for c in range(b * SIDE, min(b * SIDE + SIDE, k))})
        rows = centred.select(*keys, F.array(*[F.col(f"_x{i}") - F.col("_m")[i] for i in used]).alias("_x"))
        if k > SIDE:  # the sums of a task outweigh its rows: no more tasks than can run
            rows = rows.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))
        parts.append(rows.mapInArrow(_tile_rows(used, tiles, by), schema))
    summed = _union(parts).groupBy(*keys, "_p", "_q", "_i").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("_sums")))).alias("_sums"))
    name = F.array(*[F.lit(c) for c in cols])
    width = F.size("_sums") / len(_SUMS)
    cells = F.transform(F.sequence(F.lit(0), (width - 1).cast("int")), lambda j: F.struct(j.alias("j"), *[
        F.get("_sums", (s * width + j).cast("int")).alias(nm) for s, nm in enumerate(_SUMS)]))
    upper = summed.select(*keys, "_p", "_q", (F.col("_p") * SIDE + F.col("_i")).alias("i"), F.inline(cells)).withColumn("j", F.col("_q") * SIDE + F.col("j"))
    # A tile off the diagonal holds each of its pairs in one order: the other has x and y swapped.
    turned = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "n", F.col("y").alias("x"), F.col("x").alias("y"),
                      F.col("yy").alias("xx"), F.col("xx").alias("yy"), "xy")
    both = F.array(F.struct("i", "j", *_SUMS), F.when(F.col("_p") != F.col("_q"), turned))
    each = upper.select(*keys, F.inline(F.array_compact(both)))
    n = F.col("n")
    cov = F.col("xy") - F.try_divide(F.col("x") * F.col("y"), n)
    vx, vy = (F.col(a + a) - F.try_divide(F.col(a) * F.col(a), n) for a in ("x", "y"))
    # what rounding leaves of a constant column's variance counts as none
    flat = (vx <= 1e-12 * F.col("xx")) | (vy <= 1e-12 * F.col("yy"))
    r = F.when(~flat, F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)))
    # least and greatest pass over NULL, so it is kept out
    r = F.when(F.col("j") == F.col("i"), F.lit(1.0)).when((n >= 3) & r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return each.select(*keys, F.get(name, F.col("i")).alias("var1"), F.get(name, F.col("j")).alias("var2"), n.cast("long").alias("n"), r.alias("corr"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def corr_test(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (),
              level: float = 0.95, with_p: bool = True) -> DataFrame:
    """C1-C4 long form, one row per ordered pair incl. the diagonal:
    (var1, var2, n, corr, p_value, ci_low, ci_high)."""
    by = as_list(by)
    cols = as_list(columns) or numeric_columns(df, exclude=by)
    if len(cols) < 2:
        raise ValueError("need at least two numeric columns")
    pairs = _pairs(df, cols, by)
    n = F.col("n")
    r = F.when(F.col("var1") != F.col("var2"), F.col("corr"))  # the diagonal has no test
    t = r * F.sqrt(F.try_divide((n - 2).cast("double"), 1 - r * r))
    zc = two_sided_z(level)
    z = F.atanh(r)
    se = F.try_divide(F.lit(1.0), F.sqrt((n - 3).cast("double")))
    lo = F.when(n == 3, F.lit(-1.0)).otherwise(F.tanh(z - zc * se))
    hi = F.when(n == 3, F.lit(1.0)).otherwise(F.tanh(z + zc * se))
    stats = pairs.select(*[q(c) for c in by], "var1", "var2", "n", "corr",
                        F.when(r.isNotNull(), t).alias("_t"),
                        F.when(r.isNotNull(), lo).alias("ci_low"), F.when(r.isNotNull(), hi).alias("ci_high"))
    if with_p:
        pv = F.when(F.abs(r) == 1.0, F.lit(0.0)).otherwise(t_two_sided_p(F.col("_t"), (n - 2).cast("double")))
        stats = stats.withColumn("p_value", F.when(r.isNotNull(), pv))
    else:
        stats = stats.withColumn("p_value", F.lit(None).cast("double"))
    return stats.select(*[q(c) for c in by], "var1", "var2", "n", "corr", "p_value", "ci_low", "ci_high")


def corr_matrix(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(var1, var2, n, corr) for every ordered pair; diagonal 1."""
    by = as_list(by)
    return corr_test(df, columns, by, with_p=False).select(*by, "var1", "var2", "n", "corr")


def significant_corrs(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (),
                      alpha: float = 0.05, level: float = 0.95) -> DataFrame:
    """Pairs i < j (column order) with p < alpha, strongest first."""
    by = as_list(by)
    cols = as_list(columns) or numeric_columns(df, exclude=by)
    order = {c: i for i, c in enumerate(cols)}
    pos = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])
    t = corr_test(df, cols, by, level)
    return (t.where((pos[F.col("var1")] < pos[F.col("var2")]) & (F.col("p_value") < alpha))
            .orderBy(*[q(c) for c in by], F.desc(F.abs(F.col("corr"))), "var1", "var2"))
