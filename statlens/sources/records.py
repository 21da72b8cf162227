"""Records of large CSV files whose quoted cells hold line breaks, by many tasks.

A line belongs to a record that began on an earlier line when a quoted cell is open at its
start, which depends on all of the file before it.  But each line only maps "open or not
at its start" to "open or not at its end", such maps can be composed, and nearly all
are the identity.  So one scan composes the maps of each split (byte range) of a file; a
prefix over the splits gives the state each one starts in; a second scan then cuts
every split into records on its own.  A record that crosses splits comes out in
pieces, which are joined by one small aggregate.

The driver holds one row per split that changes the state, which is less than
what it holds to schedule the split.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds of pieces: a whole record, the rest of an earlier split's, one that goes on in the next split, the header that does.
WHOLE, REST, BEGUN, HEADER = 0, 1, 2, 3
_OUT, _IN, _CLOSED, _START = 0, 1, 2, 3


def _open_after(line: Column, state: int, delimiter: str) -> Column:
    """Whether a quoted cell is open at the line's end if the line starts in ``state``.

    A quote opens a cell at the cell's start only, two quotes in an open cell are
    one of its characters, and any other quote is text."""
    before = F.split(line, '"', -1)

    def step(s, text):
        opens = text.endswith(delimiter) | ((text == "") & s.isin(_CLOSED, _START))
        return F.when(s == _IN, F.lit(_CLOSED)).when(opens, F.lit(_IN)).otherwise(F.lit(_OUT))

    quoted = F.aggregate(F.slice(before, 1, F.size(before) - 1), F.lit(state), step) == _IN
    return F.when(F.instr(line, '"') > 0, quoted).otherwise(F.lit(state == _IN))


def _lines(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """Lines in the order of their files: split (file, at), text and both ends of their map."""
    text = F.col("value")
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), text.alias("line"),
                    _open_after(text, _START, delimiter).alias("shut"), _open_after(text, _IN, delimiter).alias("open")))


def split_maps(spark: SparkSession, path: str, delimiter: str = ",") -> dict[int, list[tuple[int, bool, bool]]]:
    """Per file (hash of its path) the splits whose map isn't the identity, in order: (start, state at
    the end if shut at the start, the same if open)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shut, opened, out = None, False, True, []
        for b in batches:
            for *k, s, o in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    out += [(*key, shut, opened)] if key else []
                    key, shut, opened = k, False, True
                shut, opened = (o if shut else s), (o if opened else s)
        out += [(*key, shut, opened)] if key else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["file", "at", "shut", "open"])

    changing = _lines(spark, path, delimiter).where("shut OR NOT open").select("file", "at", "shut", "open")
    rows = changing.mapInArrow(run, "file long, at long, shut boolean, open boolean").collect()  # at most one a split
    maps: dict[int, list] = {}
    for r in sorted(rows):
        maps.setdefault(r["file"], []).append((r["at"], r["shut"], r["open"]))
    return maps


def _states(maps: dict[int, list[tuple[int, bool, bool]]]) -> dict[int, tuple[list[int], list[bool]]]:
    """Per file the starts of the changing splits and the state after each."""
    out = {}
    for file, splits in maps.items():
        state, after = False, []
        for _, shut, opened in splits:
            state = opened if state else shut
            after.append(state)
        out[file] = ([at for at, *_ in splits], after)
    return out


def pieces(spark: SparkSession, path: str, maps: dict[int, list[tuple[int, bool, bool]]], delimiter: str = ",") -> DataFrame:
    """Records and pieces of records of all files without their headers: (file, at, kind, record)."""
    states = _states(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, kind, kept = None, False, WHOLE, []

        def begin(k):
            """State and kind of the first record of a split."""
            at, after = states.get(k[0], ([], []))
            before = bisect_left(at, k[1])
            inside = after[before - 1] if before else False
            return inside, REST if inside else HEADER if k[1] == 0 else WHOLE

        for b in batches:
            file, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(at) != 0)) + 1
            for a, z in zip([0, *cuts], [*cuts, b.num_rows]):
                if z == a:
                    continue
                part, rows = b.slice(a, z - a), []
                if key != (file[a], at[a]):
                    if kept:  # the split before ended inside a record
                        yield _out([(*key, kind if kind != WHOLE else BEGUN, "\n".join(kept))])
                    key, kept = (file[a], at[a]), []
                    state, kind = begin(key)
                shut, opened = (part.column(c).to_numpy(zero_copy_only=False) for c in (3, 4))
                start = np.empty(part.num_rows, bool)
                last = 0
                for i in np.flatnonzero(shut | ~opened):
                    start[last:i + 1] = state
                    state, last = (opened[i] if state else shut[i]), i + 1
                start[last:] = state
                end = np.where(start, opened, shut)
                alone = ~start & ~end
                if kind != WHOLE:  # the first record of a split is not like the others
                    first = int(np.argmax(~end)) if (~end).any() else part.num_rows
                    alone[:first + 1] = False
                lines = part.column(2)
                for i in np.flatnonzero(~alone):
                    kept.append(lines[int(i)].as_py())
                    if not end[i]:
                        if kind != HEADER:
                            rows.append((*key, kind, "\n".join(kept)))
                        kind, kept = WHOLE, []
                whole = lines.filter(pa.array(alone))
                yield _out(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(whole), v), t) for v, t in ((key[0], pa.int64()), (key[1], pa.int64()), (WHOLE, pa.int32()))] + [whole],
                    ["file", "at", "kind", "record"])
        if kept:
            yield _out([(*key, kind if kind != WHOLE else BEGUN, "\n".join(kept))])

    return _lines(spark, path, delimiter).mapInArrow(run, "file long, at long, kind int, record string")


def _out(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 4
    types = (pa.int64(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["file", "at", "kind", "record"])


def csv_records(spark: SparkSession, path: str, maps: dict[int, list[tuple[int, bool, bool]]], delimiter: str = ",") -> DataFrame:
    """The records (text) of all files without their headers and without empty lines; a carriage return
    before the line feed that ends a record goes.  ``maps`` are those of :func:`split_maps`."""
    found = pieces(spark, path, maps, delimiter)
    records = found.where(F.col("kind") == WHOLE).select("record")
    if any(after and after[:-1].count(True) + after[-1] for _, after in _states(maps).values()):
        # A record begins with its BEGUN piece and goes on with the REST pieces of the splits after it.
        order = Window.partitionBy("file").orderBy("at", "kind")
        own = (found.where(F.col("kind") != WHOLE)
               .withColumn("no", F.sum((F.col("kind") != REST).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))))
        joined = own.groupBy("file", "no").agg(F.sort_array(F.collect_list(F.struct("at", "kind", "record"))).alias("all"))
        records = records.union(joined.where(F.col("all")[0]["kind"] != HEADER).select(F.array_join(F.col("all.record"), "\n")))
    text = F.col("record")
    text = F.when(text.endswith("\r"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return records.select(text.alias("record")).where("record <> ''")
