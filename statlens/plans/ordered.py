"""Ordered-series building blocks that never put a whole series in one task.

``Window.orderBy(ts)`` without a partition key moves every row to a single
task.  Everything here starts from a range partitioning instead:

* ``dense_index``: rows are range-partitioned by (by, order), which also splits
  a hot group or a hot time stamp, sorted inside the partitions, numbered there
  and written once to the shared folder.  One small aggregate (rows per group
  and partition) gives each partition's offset.  NULL sorts first and NaN last,
  as in Spark's ORDER BY; rows that tie in the order columns are ordered by a
  hash of the row, so the index is the same in every run and use.
* ``framed``: a row frame is evaluated in blocks of consecutive indexes.  Rows
  near a block's edge are also sent to the neighbouring block, so one exchange
  serves all frames and no window runs over a whole series.
* ``running_sums``: running sums inside the blocks plus the blocks' offsets.
* ``wide_frame``: frames that grow with n (w = n/10) are merged from the tail of
  one stretch of w rows and the head of the next, each of which is computed once
  for every row; one exchange brings both to the row of the frame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statlens.functions.columns import join_on, q
from statlens.session import written

#: Consecutive rows of a series that one window sorts together.
BLOCK = 65_536
#: Blocks whose moments are merged at once, per level.
FAN = 128
#: Ranges of an index where the caller names none; None: as many as the session shuffles to.
PARTITIONS: int | None = None
_LOW = (1 << 33) - 1  # monotonically_increasing_id: partition above bit 33, row below


def dense_index(df: DataFrame, order_by: Sequence[str], by: Sequence[str] = (), *,
                idx: str = "idx", size: str | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``idx`` = 0-based position in ``order_by`` within each ``by`` group
    and, if named, ``size`` = rows of the group.

    ``partitions`` is the number of ranges, by default the session's shuffle
    partitions, as for any sort (AQE joins small neighbours).  Rows equal in
    ``order_by`` get an arbitrary but repeatable order.
    """
    by, order_by = list(by), list(order_by)
    hashable = [q(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    keys = [q(c) for c in dict.fromkeys(by + order_by)] + [F.xxhash64(*hashable)]
    n = partitions or PARTITIONS
    ranged = df.repartitionByRange(n, *keys) if n else df.repartitionByRange(*keys)
    base = written(ranged.sortWithinPartitions(*keys)
                   .withColumn("_m", F.monotonically_increasing_id()), "ordered")
    base = base.select(*[q(c) for c in df.columns], F.shiftright("_m", 33).alias("_b"),
                       F.col("_m").bitwiseAND(F.lit(_LOW)).alias("_pos"))
    counts = base.groupBy(*[q(c) for c in by], "_b").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_pos").alias("_first"))
    own = Window.partitionBy(*[q(c) for c in by])
    before = own.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*[q(c) for c in by], "_b", (F.coalesce(F.sum("_cnt").over(before), F.lit(0)) - F.col("_first")).alias("_off"),
                         *([F.sum("_cnt").over(own).alias(size)] if size else []))
    # ungrouped: one row per range partition, a proven bound
    out = join_on(base, offs, by + ["_b"], small=not by)
    return out.select(*[q(c) for c in df.columns], (F.col("_off") + F.col("_pos")).alias(idx), *([q(size)] if size else []))


def frame_bounds(w: int) -> tuple[int, int]:
    """Rows before / after the current row in a centred window of width w
    (pandas ``rolling(w, center=True)``)."""
    return w // 2, (w - 1) // 2


def framed_index(ix: DataFrame, by: Sequence[str] = (), *, lo: int, hi: int,
                 aggs: Callable[[WindowSpec], dict[str, Column]], idx: str = "idx", block: int | None = None) -> DataFrame:
    """Window aggregates over the row frame [idx-lo, idx+hi] of an indexed series.

    ``aggs(frame)`` returns {name: window expression}.
    """
    by, cols = list(by), ix.columns
    size = max(block or BLOCK, lo + hi + 1)
    own, place = F.floor(q(idx) / size).cast("long"), F.pmod(q(idx), F.lit(size))
    blocks = F.array(own, F.when((place < hi) & (own > 0), own - 1), F.when(place >= size - lo, own + 1))
    sent = ix.select("*", F.explode(F.array_compact(blocks)).alias("_blk"))
    frame = Window.partitionBy(*[q(c) for c in by], "_blk").orderBy(q(idx)).rowsBetween(-lo, hi)
    out = sent.select(*[q(c) for c in cols], "_blk", *[c.alias(nm) for nm, c in aggs(frame).items()])
    return out.where(F.col("_blk") == own).drop("_blk")


def framed(df: DataFrame, order_by: Sequence[str], by: Sequence[str] = (), *, lo: int, hi: int,
           aggs: Callable[[WindowSpec], dict[str, Column]], idx: str = "idx", size: str | None = None,
           partitions: int | None = None, block: int | None = None) -> DataFrame:
    """``dense_index`` and ``framed_index`` in one."""
    ix = dense_index(df, order_by, by, idx=idx, size=size, partitions=partitions)
    return framed_index(ix, by, lo=lo, hi=hi, aggs=aggs, idx=idx, block=block)


def rolling_frame(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = (),
                  *, w: int, idx: str = "idx", partitions: int | None = None, block: int | None = None) -> DataFrame:
    """Centred rolling ``count/mean/std`` of ``value`` over w rows (sample std).

    Adds ``idx``, ``_wcount``, ``_wmean``, ``_wstd``; the caller applies
    min-periods rules.
    """
    lo, hi = frame_bounds(w)
    v = q(value)
    return framed(df, order_by, by, lo=lo, hi=hi, idx=idx, partitions=partitions, block=block,
                  aggs=lambda fr: {"_wcount": F.count(v).over(fr), "_wmean": F.avg(v).over(fr),
                                   "_wstd": F.stddev_samp(v).over(fr)})


def running_sums(ix: DataFrame, columns: Sequence[str], by: Sequence[str] = (), *, idx: str = "idx",
                 block: int | None = None) -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` (NULL as 0) over the rows up to and with this one."""
    by = list(by)
    keys = [q(c) for c in by]
    cells = {c: F.coalesce(q(c), F.lit(0)) for c in columns}
    d = ix.withColumn("_blk", F.floor(q(idx) / (block or BLOCK)).cast("long"))
    run = Window.partitionBy(*keys, "_blk").orderBy(q(idx)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*keys, "_blk").agg(*[F.sum(x).alias(f"_tot_{c}") for c, x in cells.items()])
    offs = totals.select(*keys, "_blk", *[F.coalesce(F.sum(f"_tot_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in columns])
    d = d.select("*", *[F.sum(x).over(run).alias(f"_run_{c}") for c, x in cells.items()])
    return join_on(d, offs, by + ["_blk"]).select(
        *[q(c) for c in ix.columns], *[(F.col(f"_off_{c}") + F.col(f"_run_{c}")).alias(f"cum_{c}") for c in columns])


def _moments(n: Column, mean: Column, squares: Column) -> Column:
    """Count, mean and sum of squared deviations of a stretch of rows."""
    return F.struct(n.alias("n"), mean.alias("m"), squares.alias("s"))


def _both(a: Column, b: Column) -> Column:
    """Moments of two disjoint stretches as one (Chan, Golub and LeVeque): only sums of what the
    stretches hold, so a value outside of them has no influence on the rounding."""
    n, apart = a["n"] + b["n"], b["m"] - a["m"]
    share = b["n"] / F.greatest(n, F.lit(1))
    return (F.when(b["n"] == 0, a).when(a["n"] == 0, b)
            .otherwise(_moments(n, a["m"] + apart * share, a["s"] + b["s"] + apart * apart * a["n"] * share)))


def _all_of(parts: Column) -> Column:
    return F.aggregate(parts, _moments(F.lit(0).cast("long"), F.lit(0.0), F.lit(0.0)), _both)


def _around(totals: DataFrame, keys: list[str], place: str, last: int) -> DataFrame:
    """Add to every row the moments of all rows ``before`` and ``after`` it in ``place`` (0 .. ``last``)
    among those with its keys.  ``FAN`` neighbours are merged at once and their totals one level up."""
    cols, up = totals.columns, place + "u"
    own = totals.withColumn(up, F.floor(q(place) / FAN).cast("long"))
    group = Window.partitionBy(*[q(c) for c in keys], up)
    past = (Window.unboundedPreceding, -1)
    own = own.select("*", _all_of(F.collect_list("t").over(group.orderBy(place).rowsBetween(*past))).alias("before"),
                     _all_of(F.collect_list("t").over(group.orderBy(F.desc(place)).rowsBetween(*past))).alias("after"))
    if last < FAN:
        return own.drop(up)
    upper = own.groupBy(*[q(c) for c in keys], up).agg(_all_of(F.collect_list("t")).alias("t"))
    upper = _around(upper, keys, up, last // FAN).select(*[q(c) for c in keys], up, F.col("before").alias("_b"), F.col("after").alias("_a"))
    return join_on(own, upper, keys + [up]).select(*cols, _both(F.col("_b"), F.col("before")).alias("before"),
                                                      _both(F.col("after"), F.col("_a")).alias("after"))


def wide_frame(ix: DataFrame, value: str, by: Sequence[str] = (), *, lo: int | Column, hi: int | Column,
               idx: str = "idx", block: int | None = None) -> DataFrame:
    """Rolling ``count/mean/std`` over rows [idx-lo, idx+hi] of an indexed series
    (``dense_index``) of any width.

    ``lo``/``hi`` may be columns that are constant per group.  The series is cut
    into stretches as long as the frame, so a frame is the tail of one stretch
    and the head of the next: every row gets the moments of the head that ends with it
    and of the tail that starts with it, and each frame merges one of each.
    Stretches longer than a block are cut into blocks; heads and tails then run
    inside the blocks and are merged with those of the whole blocks before and
    after (:func:`_around`).  Nothing is ever subtracted: values outside a frame
    don't touch its result, however large they are.
    Adds ``_wcount``, ``_wmean``, ``_wstd``, NULL where an end of the series cuts the frame.
    """
    by, size = list(by), block or BLOCK
    keys = [q(c) for c in by]
    lo_c, hi_c = (c if isinstance(c, Column) else F.lit(c) for c in (lo, hi))
    wide = (lo_c + hi_c + 1).cast("long")
    d = ix.select(*keys, q(idx).alias("_i"), q(value).alias("_v"), wide.alias("_w"))
    if isinstance(lo, Column) or isinstance(hi, Column):
        longest = d.agg(F.max("_w")).first()[0] or 1
    else:
        longest = lo + hi + 1
    d = d.select("*", F.floor(F.col("_i") / F.col("_w")).cast("long").alias("_s"),
                 F.floor(F.col("_i") % F.col("_w") / size).cast("long").alias("_j"))
    part = Window.partitionBy(*keys, "_s", "_j")

    def moments(over):
        n = F.count("_v").over(over)
        return _moments(n, F.coalesce(F.avg("_v").over(over), F.lit(0.0)), F.coalesce(F.var_pop("_v").over(over), F.lit(0.0)) * n)

    run = (Window.unboundedPreceding, Window.currentRow)
    ends = d.select(*keys, "_i", "_w", "_s", "_j", moments(part.orderBy("_i").rowsBetween(*run)).alias("head"),
                    moments(part.orderBy(F.desc("_i")).rowsBetween(*run)).alias("tail"))
    if longest > size:
        totals = d.groupBy(*keys, "_s", "_j").agg(_moments(F.count("_v"), F.coalesce(F.avg("_v"), F.lit(0.0)),
                                                           F.coalesce(F.var_pop("_v"), F.lit(0.0)) * F.count("_v")).alias("t"))
        totals = _around(totals, by + ["_s"], "_j", (longest - 1) // size).drop("t")
        ends = join_on(ends, totals, by + ["_s", "_j"]).select(
            *keys, "_i", "_w", _both(F.col("before"), F.col("head")).alias("head"), _both(F.col("tail"), F.col("after")).alias("tail"))
    # A head goes to the frame that ends with it, a tail to the frame that starts with it; frames go by their first row.
    none = F.lit(None).cast("struct<n:bigint,m:double,s:double>")
    sent = ends.select(*keys, F.inline(F.array(
        F.struct((F.col("_i") - F.col("_w") + 1).alias("_at"), F.col("head").alias("head"), none.alias("tail")),
        F.struct(F.col("_i").alias("_at"), none.alias("head"), F.col("tail").alias("tail"))))).where("_at >= 0")
    fields = [(side, f) for side in ("head", "tail") for f in "nms"]
    met = sent.groupBy(*keys, "_at").agg(*[F.max(f"{side}.{f}").alias(f"_{side}_{f}") for side, f in fields])
    rows = join_on(ix.withColumn("_at", q(idx) - lo_c.cast("long")), met, by + ["_at"], "left")
    head, tail = (_moments(*[F.col(f"_{side}_{f}") for f in "nms"]) for side in ("head", "tail"))
    whole = F.when(F.col("_at") % wide == 0, head).otherwise(_both(tail, head))
    found = rows.select(*[q(c) for c in ix.columns], F.when(F.col("_head_n").isNotNull() & F.col("_tail_n").isNotNull(), whole).alias("_f"))
    n = F.col("_f.n")
    return found.select(*[q(c) for c in ix.columns], n.alias("_wcount"), F.when(n > 0, F.col("_f.m")).alias("_wmean"),
                        F.when(n > 1, F.sqrt(F.col("_f.s") / (n - 1))).alias("_wstd"))
