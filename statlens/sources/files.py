"""Sources and sinks.

CSV is read as strings, the missing-value tokens become NULL, and each
column is then typed by ONE aggregate that counts how many values parse as
integer / double / boolean (Spark's ``inferSchema`` knows a single null
token only, so a cell ``N/A`` would turn the column into text).
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statlens.functions.columns import STRING_TYPES, q
from statlens.sources import records

# Cell texts read as missing (pandas' default NA tokens).
DEFAULT_NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
              "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# Name fragments that mark a date column.
DATE_NAME_PARTS = ("date", "time")


# Date formats tried on text columns, in this order, after ISO 8601;
# each also with a time of day behind a space.
DATE_FORMATS = ("MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "MM-dd-yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "MMM d, yyyy", "MMMM d, yyyy",
                "d MMM yyyy", "d MMMM yyyy", "yyyyMMdd")
TIMES = ("", " HH:mm", " HH:mm:ss")

_INTEGER = r"^[+-]?[0-9]+$"
_NUMBER = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity)$"
_SURPLUS = "_statlens_surplus"


_CSV = {"escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _csv_reader(spark: SparkSession, multi_line: bool):
    """Line ends are LF or CRLF, found by the reader for each file."""
    return spark.read.options(**_CSV, header=True, inferSchema=False, multiLine=multi_line)


def _raw_csv(spark: SparkSession, path: str, text: str, multi_line: bool) -> DataFrame:
    """The cells of all files as text columns ``text``.

    The reader cuts files into splits only where no cell holds a line break, so files that are larger
    than a split are looked at first: without such cells they are read by lines, with them by
    the records that :mod:`statlens.sources.records` finds in each split.  Files that end their
    lines in CRLF go the same way, because the reader would change these line ends inside of cells."""
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    listed = spark.read.format("binaryFile").load(path).where(~F.lower("path").rlike(r"[.](gz|bz2|zst|xz|lz4|snappy|deflate)$"))
    crlf = [r[0][-1:] for r in spark.read.option("lineSep", "\n").text(path).take(1)] == ["\r"]
    if multi_line and (crlf or listed.where(F.col("length") > split).select("length").take(1)):  # lists files, reads none
        maps = records.split_maps(spark, path)
        if maps:
            cells = F.from_csv("record", text, {**_CSV, "multiLine": "true"})
            return records.csv_records(spark, path, maps).select(cells.alias("r")).select("r.*")
        multi_line = False
    return _csv_reader(spark, multi_line).schema(text).csv(path)


def _name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


class _Types:
    """Counts of one aggregate that decide the types of text columns, and what they decide."""

    def __init__(self, df: DataFrame, columns: Sequence[str]):
        self.df, self.cols, self.aggs = df, list(columns), [F.count(F.lit(1)).alias("_rows")]
        self.whole, self.number = {}, {}
        for i, c in enumerate(self.cols):
            s = F.trim(q(c))
            # the patterns keep out what a cast alone takes, such as 10d or 0x1p3
            self.whole[c] = F.when(s.rlike(_INTEGER), F.expr(f"try_cast(trim({_name(c)}) AS BIGINT)"))
            self.number[c] = F.when(s.rlike(_NUMBER), F.expr(f"try_cast(trim({_name(c)}) AS DOUBLE)"))
            self.aggs += [F.count(q(c)).alias(f"_n{i}"), F.count(self.whole[c]).alias(f"_l{i}"), F.count(self.number[c]).alias(f"_d{i}"),
                          F.count_if(F.lower(s).isin("true", "false")).alias(f"_b{i}")]

    def decided(self, counts) -> dict[str, Column]:
        """Columns that are no text, from the aggregate's row."""
        out = {}
        for i, c in enumerate(self.cols if counts["_rows"] else []):
            n = counts[f"_n{i}"]
            if n and counts[f"_l{i}"] == n:
                out[c] = self.whole[c].alias(c)
            elif counts[f"_d{i}"] == n:
                out[c] = self.number[c].alias(c)
            elif counts[f"_b{i}"] == n:
                out[c] = (F.lower(F.trim(q(c))) == "true").alias(c)
        return out


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, STRING_TYPES)]


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cast string columns to bigint / double / boolean when every non-null
    value reads as such (one aggregate over the data).  A column with rows but
    no value is double, like any all-missing column."""
    cols = list(columns) if columns is not None else _text_columns(df)
    if not cols:
        return df
    types = _Types(df, cols)
    typed = types.decided(df.agg(*types.aggs).first())  # 4 numbers per column
    return df.select(*[typed.get(c, q(c)) for c in df.columns])


def load_csv(spark: SparkSession, path: str, schema=None, na_values: Sequence[str] = DEFAULT_NA,
             infer: bool = True, multi_line: bool = True, dates: bool = False) -> DataFrame:
    """CSV with a header row; ``na_values`` cells are NULL; types
    inferred from the values (or ``schema`` applied); with ``dates`` also those of
    :func:`infer_dates`, in the same scan.

    Quoted cells may hold line breaks.  A file that is larger than a split is read by many
    tasks all the same, after a scan that finds its records; ``multi_line=False``
    saves that scan where no cell holds a line break.  Lines end in LF or CRLF.
    Missing cells at a line's end are NULL; a line with more cells than the
    header raises an error.
    """
    names = _csv_reader(spark, multi_line).csv(path).columns
    text = ", ".join(f"{_name(c)} STRING" for c in [*names, _SURPLUS])
    raw = _raw_csv(spark, path, text, multi_line)
    tokens = list(na_values)
    surplus = F.raise_error(F.concat(F.lit(f"a line has more than {len(names)} cells: "), q(_SURPLUS)))
    first, *rest = names
    cells = [F.when(q(_SURPLUS).isNotNull(), surplus.cast("string")).otherwise(F.when(~q(first).isin(tokens), q(first))).alias(first)]
    raw = raw.select(*cells, *[F.when(~q(c).isin(tokens), q(c)).alias(c) for c in rest])
    if schema is not None:
        return raw.select(*[q(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    if not infer:
        return raw
    if not dates:
        return infer_types(raw)
    cols = _text_columns(raw)
    types, times = _Types(raw, cols), _Dates(raw, DATE_NAME_PARTS, DATE_FORMATS)
    counts = raw.agg(*types.aggs, *times.aggs).first()
    chosen = times.decided(counts) | types.decided(counts)
    return raw.select(*[chosen.get(c, q(c)) for c in raw.columns])


def _shapes(fmt: str) -> list[str]:
    """Shapes of the texts that a date format reads: 9 for a digit, a for letters."""
    out = [""]
    for token in re.findall(r"([A-Za-z])(\1*)|(.)", fmt):
        text = token[0] + token[1] if token[0] else token[2]
        if text == "d":
            more = ["9", "99"]
        elif token[0]:
            more = ["a"] if text in ("MMM", "MMMM") else ["9" * len(text)]
        else:
            more = [text]
        out = [a + b for a in out for b in more]
    return out


class _Dates:
    """Counts of one aggregate that decide which text columns are dates, and in what form.

    A value is reduced to its shape first (digits to 9, letters to a), and only the few
    formats with that shape try to read it."""

    def __init__(self, df: DataFrame, name_parts: Sequence[str], formats: Sequence[str]):
        self.aggs, self.forms = [], {}
        for i, c in enumerate(c for c in _text_columns(df) if any(p in c.lower() for p in name_parts)):
            text = F.trim(q(c))
            shape = F.regexp_replace(F.translate(text, "012345678", "999999999"), r"\p{L}+", "a")
            # a year first; what else ISO 8601 allows is the cast's to say
            forms = [F.when(shape.rlike(r"^[+-]?9"), F.expr(f"try_cast({_name(c)} AS TIMESTAMP_NTZ)"))]
            forms += [F.when(shape.isin(_shapes(f + t)), F.try_to_timestamp(text, F.lit(f + t)).cast("timestamp_ntz")) for f in formats for t in TIMES]
            self.forms[c] = forms
            self.aggs += [F.count(q(c)).alias(f"_t{i}"), *[F.count(x).alias(f"_t{i}_{k}") for k, x in enumerate(forms)]]

    def decided(self, counts) -> dict[str, Column]:
        """Columns that are dates, from the aggregate's row: the first form that reads all values."""
        out = {}
        for i, (c, forms) in enumerate(self.forms.items()):
            k = next((k for k in range(len(forms)) if counts[f"_t{i}_{k}"] == counts[f"_t{i}"]), None)
            if k is not None:
                out[c] = forms[k].alias(c)
        return out


def infer_dates(df: DataFrame, name_parts: Sequence[str] = DATE_NAME_PARTS,
                formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """String columns whose lower-cased name contains a part are turned
    into timestamps when every non-null value reads in one form: ISO 8601, or
    the first of ``formats`` that fits them all; otherwise left as they are (all
    or nothing; one aggregate for all columns and forms)."""
    dates = _Dates(df, name_parts, formats)
    if not dates.aggs:
        return df
    chosen = dates.decided(df.agg(*dates.aggs).first())
    return df.select(*[chosen.get(c, q(c)) for c in df.columns])


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with a header, one part file per task (no index column)."""
    (df.write.mode(mode).option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
     .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSSXXX").csv(path))
    return path


_READERS = {".parquet": "parquet", ".orc": "orc", ".json": "json", ".jsonl": "json"}


def _suffix(uri: str) -> str | None:
    low = uri.lower().rstrip("/")
    known = [".csv", ".csv.gz", ".xlsx", *_READERS]
    return next((x for x in known if low.endswith(x)), None)


def load_any(spark: SparkSession, uri: str, **kw) -> DataFrame:
    """S3: pick the reader from the file's (or folder's) suffix; without a known
    one, from that of the files in the folder; else a workbook is known by its
    first bytes, other binary files are refused, and text is CSV."""
    suffix = _suffix(uri)
    if suffix is None:
        inside = spark.read.format("binaryFile").load(uri).select("path").take(1)  # lists files, reads none
        suffix = _suffix(inside[0]["path"]) if inside else None
    if suffix is None:
        start = spark.read.text(uri).take(1)
        start = start[0][0] if start else ""
        if "\0" in start and not start.startswith("PK\3\4"):
            raise ValueError(f"Unsupported file format: {os.path.basename(uri)} (use CSV, XLSX, Parquet, ORC or JSON)")
        suffix = ".xlsx" if start.startswith("PK\3\4") else ".csv"
    if suffix.startswith(".csv"):
        return load_csv(spark, uri, **kw)
    if suffix == ".xlsx":
        from statlens.sources.workbooks import load_workbooks
        return load_workbooks(spark, uri, **kw)
    return spark.read.format(_READERS[suffix]).load(uri)


def sample_table(spark: SparkSession, n: int = 200, seed: int = 42) -> DataFrame:
    """The demo table (daily from 2020-01-01: sales = trend + 30-day
    season + noise, temperature, spend, visits, region, category, rating,
    budget).  Random draws are hashes of (seed, column, row), so the table
    does not depend on partitioning; it equals numpy's draws in distribution
    only."""
    i = F.col("id")

    def u(tag: str):
        h = F.xxhash64(F.lit(seed), F.lit(tag), i)
        return (F.pmod(h, F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)

    def normal(tag: str, mu: float, sd: float):
        return mu + sd * F.sqrt(-2.0 * F.log(u(tag + "a"))) * F.cos(2 * math.pi * u(tag + "b"))

    trend = 100.0 + 50.0 * i / max(n - 1, 1)
    season = 10.0 * F.sin(2 * math.pi * i / 30.0)
    # Category labels of the demo table.
    regions = F.array(*[F.lit(x) for x in ("North", "South", "East", "West")])
    cats = F.array(*[F.lit(x) for x in ("Electronics", "Clothing", "Home", "Books")])
    pick = lambda tag, arr: F.element_at(arr, (F.floor(u(tag) * 4) + 1).cast("int"))
    return spark.range(n).select(
        F.expr("timestamp_ntz'2020-01-01 00:00:00'").alias("_d0"), i).select(
        (F.col("_d0") + F.make_dt_interval(i.cast("int"))).alias("date"),
        (trend + season + normal("noise", 0.0, 5.0)).alias("sales"),
        normal("temp", 25.0, 5.0).alias("temperature"),
        (-1000.0 * F.log(1.0 - u("spend"))).alias("marketing_spend"),
        (F.round(normal("visits", 500.0, math.sqrt(500.0))).cast("long") + F.floor(trend).cast("long"))
        .alias("website_visits"),
        pick("region", regions).alias("region"),
        pick("category", cats).alias("product_category"),
        (1.0 + 4.0 * u("rating")).alias("customer_rating"),
        normal("budget", 5000.0, 1500.0).alias("advertising_budget"))
