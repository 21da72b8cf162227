"""Exact quantiles (linear interpolation, nulls skipped) without holding a
whole group in one task.

Spark's ``percentile`` keeps a map of every distinct value of a group in one
buffer, and an ungrouped aggregate ends in one task: fine for thousands of
rows, not for a column of a 100 TB table.  This is a selection plan instead:

1. one aggregate: ``n`` and, by ``percentile_approx`` (a mergeable sketch of
   bounded size), a bracket ``[lo, hi]`` around each wanted quantile.  Brackets
   follow ranks, so neither spread nor extreme values matter;
2. while a bracket may hold more than ``LIMIT`` rows, it is narrowed by the
   quantiles of the rows inside it (from about 10^9 rows on);
3. one aggregate: rows inside a bracket are counted per value, which collapses
   repeated values map-side, rows between brackets are counted together.  The
   running count over these few groups gives each wanted rank its value.

No window sees more than ``LIMIT`` distinct values for each wanted quantile.
The wanted ranks are those of numpy/pandas' linear method: ``h = (n-1)p``,
value = ``v[floor h] + (h - floor h) * (v[ceil h] - v[floor h])``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statlens.functions.columns import join_on, q
from statlens.session import written

ACCURACY = 10_000
#: Half width of a bracket as a share of the rows: five times the sketch's error.
MARGIN = 5 / ACCURACY
LIMIT = 1_000_000
GRID = 256


def _clip(p: float) -> float:
    return min(1.0, max(0.0, p))


def _bracketed(cells: DataFrame, brackets: DataFrame, keys: list[str], small_keys: bool) -> DataFrame:
    return join_on(cells.where(F.col("_v").isNotNull()), brackets.select(*[q(k) for k in keys], "_n", "_q"), keys, small=small_keys)


def _narrowed(cells: DataFrame, brackets: DataFrame, keys: list[str], probs: list[float], small_keys: bool) -> DataFrame:
    """Brackets narrowed by a grid of quantiles of the rows inside them."""
    names = [q(k) for k in keys]
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.get("_q", F.lit(2 * i)).alias("lo"),
                               F.get("_q", F.lit(2 * i + 1)).alias("hi")) for i, p in enumerate(probs)])
    rows = (_bracketed(cells, brackets, keys, small_keys).select(*names, "_n", "_v", F.explode(pairs).alias("b"))
            .where(F.col("_v") <= F.col("b.hi")))
    inside = F.col("_v") >= F.col("b.lo")
    grid = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
    got = rows.groupBy(*names, "_n", "b").agg(F.count_if(~inside).alias("below"), F.count_if(inside).alias("m"),
                                             F.percentile_approx(F.when(inside, F.col("_v")), grid, ACCURACY).alias("g"))
    rank = F.floor((F.col("_n") - 1) * F.col("b.p"))
    at = [((rank - F.col("below")) / F.col("m") - MARGIN) * GRID, ((rank + 2 - F.col("below")) / F.col("m") + MARGIN) * GRID]
    lo = F.get("g", F.greatest(F.lit(0), F.floor(at[0])).cast("int"))
    hi = F.get("g", F.least(F.lit(GRID), F.ceil(at[1])).cast("int"))
    return (got.select(*names, "_n", F.struct(F.col("b.i").alias("i"), F.array(lo, hi).alias("e")).alias("e"))
            .groupBy(*names, "_n").agg(F.sort_array(F.collect_list("e")).alias("e"))
            .select(*names, "_n", F.flatten(F.transform("e", lambda x: x["e"])).alias("_q")))


def exact_quantiles(long: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    small_keys: bool = False, extra_aggs: Sequence[Column] = (), limit: int = LIMIT) -> DataFrame:
    """Quantiles of ``value`` per ``keys``: rows (keys..., p, n, quantile).

    ``small_keys`` states that the number of distinct keys is bounded by the
    caller (e.g. the key is a column name): the per-key tables are then
    broadcast explicitly; otherwise AQE picks the join at run time from the
    measured size.  ``extra_aggs`` (over ``_v``, nulls included) ride along
    in the first aggregate and come out as extra columns.  NULL keys are keys.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    names = [q(k) for k in keys]
    cells = long.select(*names, F.col(value).alias("_v"))
    extra_names = [f"_x{i}" for i in range(len(extra_aggs))]
    ends = F.array(*[F.lit(_clip(e)) for p in probs for e in (p - MARGIN, p + MARGIN)])
    stats = cells.groupBy(*names).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", ends, ACCURACY).alias("_q"),
                                      *[e.alias(nm) for e, nm in zip(extra_aggs, extra_names)])
    stats = written(stats.where(F.col("_n") > 0), "brackets")
    brackets = stats
    # A bracket holds at most the margin and the sketch's error on either side; each narrowing leaves a grid step and the error.
    held = (stats.agg(F.max("_n")).first()[0] or 0) * 2.4 * MARGIN
    while held > limit:
        brackets = written(_narrowed(cells, brackets, keys, probs, small_keys), "brackets")
        held *= 4 / GRID

    lo = [F.get("_q", F.lit(2 * i)) for i in range(len(probs))]
    hi = [F.get("_q", F.lit(2 * i + 1)) for i in range(len(probs))]
    v = F.col("_v")
    inside, gap = F.lit(False), F.lit(0)
    for a, b in zip(lo, hi):
        inside = inside | ((v >= a) & (v <= b))
        gap = gap + F.when(v > b, 1).otherwise(0)
    groups = (_bracketed(cells, brackets, keys, small_keys)
              .groupBy(*names, F.when(inside, F.lit(-1)).otherwise(gap).alias("_gap"), F.when(inside, v).alias("_at"))
              .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most")))
    run = Window.partitionBy(*names).orderBy("_most").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_before", F.coalesce(F.sum("_c").over(run), F.lit(0)))

    want = (stats.select(*names, "_n", *extra_names, F.explode(F.array(*map(F.lit, probs))).alias("p"))
            .withColumn("_h", (F.col("_n") - 1).cast("double") * F.col("p"))
            .withColumn("_r0", F.floor("_h").cast("long"))
            .withColumn("_r1", F.least(F.col("_r0") + 1, F.col("_n") - 1))
            .withColumn("_frac", F.col("_h") - F.col("_r0")))
    near = join_on(want, groups, keys).where((F.col("_before") <= F.col("_r1")) & (F.col("_r0") < F.col("_before") + F.col("_c")))

    def value_at(rank: Column) -> Column:
        """The value of a rank in a group: its only one, or the first or last of a gap."""
        place = rank - F.col("_before")
        known = (F.when(F.col("_least") == F.col("_most"), F.col("_least")).when(place == 0, F.col("_least"))
                 .when(place == F.col("_c") - 1, F.col("_most"))
                 .otherwise(F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")))
        return F.max(F.when((place >= 0) & (place < F.col("_c")), known))

    out = (near.groupBy(*names, "p", "_n", "_frac", *extra_names)
           .agg(value_at(F.col("_r0")).alias("_v0"), value_at(F.col("_r1")).alias("_v1")))
    return out.select(*names, "p", F.col("_n").alias("n"), *extra_names,
                      (F.col("_v0") + F.col("_frac") * (F.col("_v1") - F.col("_v0"))).alias("quantile"))


def quantile_table(long: DataFrame, keys: Sequence[str], value: str,
                   probs: Sequence[float], names: Sequence[str], **kw) -> DataFrame:
    """Wide form: one row per key, one column per probability (named).
    ``extra={name: aggregate over _v}`` adds columns from the first pass."""
    extra = dict(kw.pop("extra", {}))
    qs = exact_quantiles(long, keys, value, probs, extra_aggs=list(extra.values()), **kw)
    aggs = [F.max(F.when(F.col("p") == float(p), F.col("quantile"))).alias(nm) for p, nm in zip(probs, names)]
    carried = [F.max(f"_x{i}").alias(nm) for i, nm in enumerate(extra)]
    return qs.groupBy(*[q(k) for k in keys]).agg(F.max("n").alias("n"), *carried, *aggs)


#: Columns of one wide plan; more are handled in several.
COLUMNS = 64
#: Half width of a wider bracket, and the rows from which on either bracket surely holds its quartile.
WIDE, SURE = 0.01, 4


def _sql(value) -> str:
    """A driver's number as SQL."""
    return "CAST(NULL AS DOUBLE)" if value is None else f"{value}L" if isinstance(value, int) else f"CAST('{value!r}' AS DOUBLE)"


class _Wide:
    """Columns ``_v0`` .. of a table next to the statistics of their group: names in SQL, or numbers where
    there is one group only."""

    def __init__(self, wide: DataFrame, keys: list[str], stats: DataFrame):
        row = None if keys else (stats.first() or {}).asDict()
        self.rows = join_on(wide, stats, keys) if keys else wide
        self.at = (lambda c: c) if keys else (lambda c: _sql(row[c]))

    def agg(self, keys: list[str], exprs: list[str]) -> DataFrame:
        return self.rows.groupBy(*[q(c) for c in keys]).agg(*map(F.expr, exprs))


def _wide_brackets(wide: DataFrame, keys: list[str], k: int, probs: list[float], limit: int) -> DataFrame:
    """One row per key: for column i count ``_n``, mean ``_mu``, deviation ``_sd``, brackets ``_lo{i}_{j}``, ``_hi{i}_{j}``
    and ``_a{i}_{j}``, ``_z{i}_{j}``, between which the quantile lies for certain (NULL where the rows are too few to say)."""
    names = [q(c) for c in keys]
    ends = ", ".join(f"{_clip(e)!r}D" for p in probs for e in (p - MARGIN, p + MARGIN, p - WIDE, p + WIDE))
    aggs = ["count(1) AS _rows"]
    for i in range(k):
        aggs += [f"count(_v{i}) AS _n{i}", f"avg(_v{i}) AS _mu{i}", f"stddev_pop(_v{i}) AS _sd{i}", f"percentile_approx(_v{i}, array({ends}), {ACCURACY}) AS _q{i}"]
    pairs = [(i, j) for i in range(k) for j in range(len(probs))]
    kept = ["_rows", *[f"{c}{i}" for i in range(k) for c in ("_n", "_mu", "_sd")]]
    got = []
    for i, j in pairs:
        lo, hi, a, z = (f"get(_q{i}, {4 * j + e})" for e in range(4))
        got += [f"{lo} AS _lo{i}_{j}", f"{hi} AS _hi{i}_{j}"]
        got += [f"CASE WHEN _n{i} * {MARGIN}D >= {SURE} THEN {near} WHEN _n{i} * {WIDE}D >= {SURE} THEN {far} END AS _{side}{i}_{j}"
                for side, near, far in (("a", lo, a), ("z", hi, z))]
    stats = written(wide.groupBy(*names).agg(*map(F.expr, aggs)).select(*names, *kept, *map(F.expr, got)), "brackets")
    kept += [f"_{side}{i}_{j}" for i, j in pairs for side in "az"]
    most = "greatest(" + ", ".join(["0", "0", *[f"_n{i}" for i in range(k)]]) + ")"
    held = (stats.agg(F.max(F.expr(most))).first()[0] or 0) * 2.4 * MARGIN
    grid = ", ".join(f"{g / GRID!r}D" for g in range(GRID + 1))
    while held > limit:  # by the quantiles of the rows inside, as far as needed
        near, aggs, ends = _Wide(wide, keys, stats), [], []
        for i, j in pairs:
            lo, hi = near.at(f"_lo{i}_{j}"), near.at(f"_hi{i}_{j}")
            inside = f"_v{i} >= {lo} AND _v{i} <= {hi}"
            aggs += [f"count_if(_v{i} < {lo}) AS _b{i}_{j}", f"count_if({inside}) AS _m{i}_{j}",
                     f"percentile_approx(CASE WHEN {inside} THEN _v{i} END, array({grid}), {ACCURACY}) AS _g{i}_{j}"]
            rank = f"floor((_n{i} - 1) * {probs[j]!r}D) - _b{i}_{j}"
            ends += [f"get(_g{i}_{j}, CAST(greatest(0, floor((try_divide({rank}, _m{i}_{j}) - {MARGIN}D) * {GRID})) AS INT)) AS _lo{i}_{j}",
                     f"get(_g{i}_{j}, CAST(least({GRID}, ceil((try_divide({rank} + 2, _m{i}_{j}) + {MARGIN}D) * {GRID})) AS INT)) AS _hi{i}_{j}"]
        got = join_on(stats, near.agg(keys, aggs), keys)
        stats = written(got.select(*names, *kept, *map(F.expr, ends)), "brackets")
        held *= 4 / GRID
    return stats


def fence_table(df: DataFrame, columns: Sequence[tuple[str, Column]], by: Sequence[str], name: str, *, z_k: float = 3.0,
                iqr_k: float = 1.5, limit: int = LIMIT) -> DataFrame:
    """Quartiles, fences and outlier counts of many columns in three scans of ``df``, without
    one row per cell.

    Rows (by..., ``name``, n_rows, n, mean, std_pop, q1, q3, lower, upper, z_outliers, iqr_outliers):
    population z-scores beyond ``z_k`` and values strictly outside ``q1 - iqr_k * iqr``
    and ``q3 + iqr_k * iqr``.  ``columns`` are (name, double Column).

    1. one wide aggregate: moments and a bracket around either quartile of each column;
    2. one wide aggregate: how many values lie below each bracket, the values next to it, the
       z-scores beyond ``z_k`` (exact by now) and the values that are outside wherever in
       their brackets the quartiles lie;
    3. the few cells inside a bracket, or where a fence may lie, counted per value.

    Each scan's small result is written, so no scan is repeated.
    """
    by = list(by)
    if len(columns) > COLUMNS:
        out = [fence_table(df, columns[a:a + COLUMNS], by, name, z_k=z_k, iqr_k=iqr_k, limit=limit) for a in range(0, len(columns), COLUMNS)]
        return _all(out)
    probs, k = [0.25, 0.75], len(columns)
    names = [q(c) for c in by]
    wide = df.select(*names, *[c.alias(f"_v{i}") for i, (_, c) in enumerate(columns)])
    stats = _wide_brackets(wide, by, k, probs, limit)
    near = _Wide(wide, by, stats)
    aggs, cells, here, parts = [], [], [], []
    for i in range(k):
        v = f"_v{i}"
        a, b, c, d = (near.at(f"_{side}{i}_{j}") for j in (0, 1) for side in "az")
        # where the fences may lie, from what is certain of both quartiles
        low = f"{a} - {iqr_k}D * ({d} - {a})", f"{b} - {iqr_k}D * greatest({c} - {b}, 0D)"
        high = f"{c} + {iqr_k}D * greatest({c} - {b}, 0D)", f"{d} + {iqr_k}D * ({d} - {a})"
        z = f"abs(try_divide({v} - {near.at(f'_mu{i}')}, {near.at(f'_sd{i}')})) > {float(z_k)!r}D"
        aggs += [f"count_if({z}) AS _z{i}", f"count_if({v} < {low[0]} OR {v} > {high[1]}) AS _sure{i}"]
        # a fence or a quartile that can be one value only asks for no cells
        found = [(2 + e, f"coalesce({f[0]} < {f[1]} AND {v} >= {f[0]} AND {v} <= {f[1]}, {v} IS NOT NULL)") for e, f in enumerate((low, high))]
        for j in range(2):
            lo, hi = near.at(f"_lo{i}_{j}"), near.at(f"_hi{i}_{j}")
            aggs += [f"count_if({v} < {lo}) AS _b{i}_{j}", f"count_if({v} >= {lo} AND {v} <= {hi}) AS _m{i}_{j}",
                     f"max(CASE WHEN {v} < {lo} THEN {v} END) AS _p{i}_{j}", f"min(CASE WHEN {v} > {hi} THEN {v} END) AS _s{i}_{j}"]
            found.append((j, f"{lo} < {hi} AND {v} >= {lo} AND {v} <= {hi}"))
        here += [inside for _, inside in found]
        cells += [f"CASE WHEN {inside} THEN struct({i} AS i, {j} AS j, {v} AS v) END" for j, inside in found]
        ends = ", ".join("struct(" + ", ".join(f"_{c}{i}_{j} AS {c}" for c in ("b", "m", "p", "s", "lo", "hi")) + ")" for j in range(2))
        parts.append(f"struct({i} AS i, _n{i} AS n, _mu{i} AS mean, _sd{i} AS sd, _z{i} AS z, _sure{i} AS sure, array({ends}) AS ends)")
    counts = join_on(stats, near.agg(by, aggs), by)
    one = written(counts.select(*names, "_rows", F.expr(f"inline(array({', '.join(parts)}))")), "counts")
    groups = written(near.rows.where(" OR ".join(here)).select(*names, F.expr(f"inline(array_compact(array({', '.join(cells)})))"))
                     .groupBy(*names, "i", "j", "v").agg(F.count(F.lit(1)).alias("c")), "cells")
    # Ranks inside the brackets.
    run = Window.partitionBy(*names, "i", "j").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    inside = groups.where("j < 2").withColumn("before", F.coalesce(F.sum("c").over(run), F.lit(0)))
    h = (F.col("n") - 1).cast("double") * F.when(F.col("j") == 0, probs[0]).otherwise(probs[1])
    want = (one.select(*names, "i", "n", F.posexplode("ends").alias("j", "e")).select("*", F.floor(h).cast("long").alias("r0"))
            .select(*names, "i", "j", "e", (h - F.col("r0")).alias("share"), (F.col("r0") - F.col("e.b")).alias("r0"),
                    (F.least(F.col("r0") + 1, F.col("n") - 1) - F.col("e.b")).alias("r1")).where("r1 IS NOT NULL"))
    met = join_on(want, inside, by + ["i", "j"], "left")

    def value_at(rank: str) -> Column:
        """The value of a rank (from the bracket's first): inside, or the one next to the bracket."""
        return F.expr(f"""CASE WHEN max({rank}) >= 0 AND max({rank}) < max(e.m) 
              THEN coalesce(max(CASE WHEN {rank} >= before AND {rank} < before + c THEN v END), max(CASE WHEN e.lo = e.hi THEN e.lo END))
            WHEN max({rank}) = -1 THEN max(e.p) WHEN max({rank}) = max(e.m) THEN max(e.s)
            ELSE CAST(raise_error('a quantile lies outside its bracket') AS DOUBLE) END""")

    values = met.groupBy(*names, "i", "j").agg(value_at("r0").alias("v0"), value_at("r1").alias("v1"), F.max("share").alias("share"))
    value = F.col("v0") + F.col("share") * (F.col("v1") - F.col("v0"))
    quartiles = values.groupBy(*names, "i").agg(*[F.max(F.when(F.col("j") == j, value)).alias(nm) for j, nm in ((0, "q1"), (1, "q3"))])
    iqr = F.col("q3") - F.col("q1")
    quartiles = quartiles.select(*names, "i", "q1", "q3", (F.col("q1") - iqr_k * iqr).alias("lower"), (F.col("q3") + iqr_k * iqr).alias("upper"))
    # Cells where a fence may lie.
    table = join_on(one, quartiles, by + ["i"], "left")
    beyond = (join_on(groups.where("j >= 2"), quartiles, by + ["i"]).where("(j = 2 AND v < lower) OR (j = 3 AND v > upper)")
              .groupBy(*names, "i").agg(F.sum("c").alias("more")))
    label = F.element_at(F.array(*[F.lit(c) for c, _ in columns]), F.col("i") + 1)
    table = join_on(table, beyond, by + ["i"], "left")
    return table.select(*names, label.alias(name), F.col("_rows").alias("n_rows"), "n", "mean", F.col("sd").alias("std_pop"), "q1", "q3", "lower", "upper",
                        F.col("z").alias("z_outliers"), (F.col("sure") + F.coalesce("more", F.lit(0))).alias("iqr_outliers"))


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
