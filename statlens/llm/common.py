"""Helpers shared by the operators: written tables, folds, columns from texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from statlens import session


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder (``statlens.session.written``)."""
    return session.written(df, f"llm-{name}")


def forget(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that no later plan reads."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        folder = f.rsplit("/", 1)[0]
        if "/llm-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key with more than 1 / TASKS of all rows is joined by broadcast.
TASKS = 1 << 13


def hot_join(rows: DataFrame, keys: DataFrame, on: list[str], total: int, tasks: int = TASKS) -> DataFrame:
    """``rows`` joined with ``keys``, a written table of distinct ``on`` with the number ``c`` of their rows
    among ``total`` (dropped) and any other columns.

    Frequent keys come by broadcast, which at most ``tasks`` can be, so their rows stay spread over
    the tasks that read them; the rest by an ordinary join, in which no key has more than 1 / tasks of all rows."""
    often = F.col("c") > total // tasks
    if keys.filter(often).isEmpty():
        return rows.join(keys.drop("c"), on)
    hot = F.broadcast(keys.filter(often).drop("c"))
    rest = rows.join(hot.select(*on), on, "left_anti").join(keys.filter(~often).drop("c"), on)
    return rows.join(hot, on).unionByName(rest)


DRAWS = 1 << 40


def bounded_sample(rows: DataFrame, group: str, hashed: Column, sizes: dict, sample: int) -> DataFrame:
    """At most ``sample`` rows of each ``group`` (``sizes``: its number of rows): those with the least ``_draw``, from a
    64-bit hash of what makes a row; copies of a row count once.

    A share of the rows that holds twice as many is looked at; only its draws, a few thousand numbers, go to the driver."""
    part = F.lit(0)
    for g, n in sorted(sizes.items()):
        part = F.when(F.col(group) == g, int(DRAWS * min(1.0, 2 * sample / n))).otherwise(part)
    some = rows.withColumn("_draw", F.pmod(hashed, F.lit(DRAWS))).filter(F.col("_draw") < part)
    draws: dict = {}
    for r in some.select(group, "_draw").distinct().collect():
        draws.setdefault(r[group], []).append(r["_draw"])
    last = F.lit(-1)
    for g, found in sorted(draws.items()):
        last = F.when(F.col(group) == g, sorted(found)[:sample][-1]).otherwise(last)
    return some.filter(F.col("_draw") <= last).dropDuplicates([group, "_draw"])


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod`` (NULL ids: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def with_text_columns(df: DataFrame, make, fields: list[tuple[str, str]], text: str = "text", rows: int = 256) -> DataFrame:
    """``df`` with columns that ``make(texts)`` returns for lists of whole texts.

    ``make`` gives one list for each of ``fields`` (name, SQL type); it gets at
    most ``rows`` texts at a time, so a task holds few of them as objects.  All
    columns of ``df`` pass through unchanged.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    types = [to_arrow_type(f.dataType) for f in schema.fields[len(df.columns):]]
    names, at = schema.names, df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                b = whole.slice(start, rows)
                new = make(b.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(b.columns + [pa.array(x, t) for x, t in zip(new, types)], names)

    return df.mapInArrow(run, schema)
