"""A folder of ``.xlsx`` workbooks as one table (first sheet, header row).

Spark has no Excel source.  Files are read with the ``binaryFile`` source;
each task unpacks its own workbooks (zip + XML from the standard library)
inside ``mapInPandas`` and emits one row per sheet row, written once to the
shared folder.  Each workbook's own header row names its columns, so other column
orders and further columns are matched by name.  Cells in a date format become
ISO time stamps; values are typed like CSV cells.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statlens.functions.columns import q
from statlens.session import written
from statlens.sources.files import DEFAULT_NA, infer_types

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PR = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


# Built-in number formats of the file format that show dates or times.
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Indexes of the cell styles whose number format shows a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {}
    for f in root.iter(_M + "numFmt"):
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode") or "")
        own[int(f.get("numFmtId"))] = bool(re.search(r"[dmyhs]", code, re.I)) and "General" not in code
    xfs = root.find(_M + "cellXfs")
    return {i for i, x in enumerate(xfs if xfs is not None else ())
            if own.get(k := int(x.get("numFmtId") or 0), k in _DATE_FORMATS)}


def _timestamp(serial: str, since_1904: bool) -> str:
    """A date serial as text: days since the epoch, to the microsecond."""
    start = dt.datetime(1904, 1, 1) if since_1904 else dt.datetime(1899, 12, 30)
    try:
        when = start + dt.timedelta(milliseconds=round(float(serial) * 86_400_000))
    except (ValueError, OverflowError):
        return serial
    return when.isoformat(sep=" ")


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(_M + "t"))


def parse_first_sheet(content: bytes) -> list[list[str | None]]:
    """Rows of the first sheet as text (shared strings resolved)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        dates = _date_styles(z)
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        props = wb.find(_M + "workbookPr")
        since_1904 = props is not None and props.get("date1904") in ("1", "true")
        first = wb.find(f"{_M}sheets/{_M}sheet")
        target = "worksheets/sheet1.xml"
        if first is not None and "xl/_rels/workbook.xml.rels" in names:
            rid = first.get(_R + "id")
            rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
            for rel in rels.iter(_PR + "Relationship"):
                if rel.get("Id") == rid:
                    target = rel.get("Target").lstrip("/").removeprefix("xl/")
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [_text(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(_M + "si")]
        sheet = ET.fromstring(z.read("xl/" + target))
    rows = []
    for row in sheet.iter(_M + "row"):
        cells: dict[int, str | None] = {}
        for pos, c in enumerate(row.iter(_M + "c")):
            idx = _col_index(c.get("r")) if c.get("r") else pos
            kind = c.get("t")
            v = c.find(_M + "v")
            if kind == "s" and v is not None:
                val = shared[int(v.text)]
            elif kind == "inlineStr":
                val = _text(c)
            elif kind == "b" and v is not None:
                val = "True" if v.text == "1" else "False"
            elif v is not None and v.text and kind in (None, "n") and int(c.get("s") or 0) in dates:
                val = _timestamp(v.text, since_1904)
            else:
                val = v.text if v is not None else None
            cells[idx] = val
        width = max(cells) + 1 if cells else 0
        rows.append([cells.get(i) for i in range(width)])
    return rows


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            for i, values in enumerate(parse_first_sheet(bytes(content))):
                out.append((path, i, values))
        yield pd.DataFrame(out, columns=["path", "row", "values"])


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, values array<string>) for every row of every workbook."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx")
             .option("recursiveFileLookup", "true").load(path))
    return files.select("path", "content").mapInPandas(_parse, "path string, row int, values array<string>")


def load_workbooks(spark: SparkSession, path: str, na_values: Sequence[str] = DEFAULT_NA,
                   infer: bool = True) -> DataFrame:
    """One row per data row of every workbook.

    Columns are matched by the names in each workbook's first row; a name that a
    workbook lacks is NULL there.  Columns come in the order of the first
    workbook (by path), further names after them.  A nameless column is
    ``column_<position>``; a cell beyond the header raises an error.
    """
    rows = written(workbook_rows(spark, path), "workbooks")  # parsed once
    heads = rows.where(F.col("row") == 0).select("path", "values")
    named = F.transform("values", lambda v, i: F.when(F.coalesce(F.trim(v), F.lit("")) == "", F.concat(F.lit("column_"), i.cast("string"))).otherwise(v))
    heads = heads.select("path", named.alias("header"))
    order = (heads.select("path", F.posexplode("header").alias("at", "name")).groupBy("name")
             .agg(F.min(F.struct("path", "at")).alias("first")).orderBy("first").collect())  # one row per column
    if not order:
        raise ValueError(f"no .xlsx rows under {path}")
    data = rows.where(F.col("row") > 0).join(heads, "path")
    surplus = F.exists(F.slice("values", F.size("header") + 1, F.greatest(F.size("values") - F.size("header"), F.lit(0))), lambda v: v.isNotNull())
    tokens = list(na_values)
    cols = []
    for k, r in enumerate(order):
        at = F.array_position("header", r["name"])
        v = F.when(at > 0, F.get("values", (at - 1).cast("int")))
        v = F.when(~v.isin(tokens), v)
        if k == 0:
            v = F.when(surplus, F.raise_error(F.concat(F.lit("cells beyond the header in "), F.col("path"))).cast("string")).otherwise(v)
        cols.append(v.alias(r["name"]))
    data = data.select(*cols)
    return infer_dates_iso(infer_types(data)) if infer else data


def infer_dates_iso(df: DataFrame) -> DataFrame:
    """Text columns in which every value is a time stamp as written by
    ``_timestamp`` become timestamps (dates are known by their cell format, not
    by a column's name)."""
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if not text:
        return df
    form = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?$"
    counts = df.agg(*[x for i, c in enumerate(text) for x in (F.count(q(c)).alias(f"n{i}"), F.count_if(q(c).rlike(form)).alias(f"d{i}"))]).first()
    dates = {c for i, c in enumerate(text) if counts[f"n{i}"] and counts[f"n{i}"] == counts[f"d{i}"]}
    return df.select(*[q(c).cast("timestamp_ntz").alias(c) if c in dates else q(c) for c in df.columns])
