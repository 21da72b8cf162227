"""Sources: CSV NA tokens and typing, date inference, workbooks, demo table."""

import csv
import os
import random
import re
import tempfile
import zipfile

import pytest

from pyspark.sql import types as T

from statlens.sources import files
from statlens.sources.workbooks import load_workbooks

WB = """<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"
 xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">
<sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>"""
RELS = """<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">
<Relationship Id="rId1" Type="worksheet" Target="worksheets/sheet1.xml"/></Relationships>"""
SST = """<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">
<si><t>id</t></si><si><t>name</t></si><si><t>amount</t></si><si><t>NA</t></si></sst>"""


def sheet(rows):
    body = []
    for r, cells in enumerate(rows, start=1):
        cs = "".join(f'<c r="{chr(65 + i)}{r}"{a}>{v}</c>' for i, (a, v) in enumerate(cells) if v is not None)
        body.append(f'<row r="{r}">{cs}</row>')
    return ('<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
            + "".join(body) + "</sheetData></worksheet>")


def write_xlsx(path, rows):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", WB)
        z.writestr("xl/_rels/workbook.xml.rels", RELS)
        z.writestr("xl/sharedStrings.xml", SST)
        z.writestr("xl/worksheets/sheet1.xml", sheet(rows))


def test_workbook_folder(spark):
    d = tempfile.mkdtemp(prefix="statlens-xlsx-")
    hdr = [(' t="s"', "<v>0</v>"), (' t="s"', "<v>1</v>"), (' t="s"', "<v>2</v>")]
    write_xlsx(os.path.join(d, "a.xlsx"), [hdr, [("", "<v>1</v>"), (' t="inlineStr"', "<is><t>x</t></is>"), ("", "<v>2.5</v>")],
                                             [("", "<v>2</v>"), (' t="s"', "<v>3</v>"), ("", None)]])
    write_xlsx(os.path.join(d, "b.xlsx"), [hdr, [("", "<v>3</v>"), (' t="inlineStr"', "<is><t>z</t></is>"), ("", "<v>4</v>")]])
    df = load_workbooks(spark, d)
    assert df.columns == ["id", "name", "amount"]
    assert isinstance(df.schema["id"].dataType, T.LongType)
    assert isinstance(df.schema["amount"].dataType, T.DoubleType)
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [(1, "x", 2.5), (2, None, None), (3, "z", 4.0)]
    assert files.load_any(spark, os.path.join(d, "a.xlsx")).count() == 2


STYLES = """<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">
<numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts>
<cellXfs count="4"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="2"/></cellXfs></styleSheet>"""


def test_workbook_dates_orders_and_widths(spark, tmp_path):
    def text(x):
        return (' t="inlineStr"', f"<is><t>{x}</t></is>")

    def book(name, rows):
        write_xlsx(str(tmp_path / name), rows)
        with zipfile.ZipFile(str(tmp_path / name), "a") as z:
            z.writestr("xl/styles.xml", STYLES)

    book("a.xlsx", [[text("id"), text("day"), text("price")], [("", "<v>1</v>"), (' s="1"', "<v>45292</v>"), (' s="3"', "<v>2.5</v>")]])
    book("b.xlsx", [[text("day"), text("id"), text("note")], [(' s="2"', "<v>45293.5</v>"), ("", "<v>2</v>"), text("new")]])
    df = load_workbooks(spark, str(tmp_path))
    assert df.columns == ["id", "day", "price", "note"]
    rows = sorted(tuple(str(v) for v in r) for r in df.collect())
    assert rows == [("1", "2024-01-01 00:00:00", "2.5", "None"), ("2", "2024-01-02 12:00:00", "None", "new")]
    book("c.xlsx", [[text("id")], [("", "<v>3</v>"), text("beyond")]])
    with pytest.raises(Exception, match="beyond the header"):
        load_workbooks(spark, str(tmp_path)).collect()


def test_csv_tokens_and_dates(spark):
    d = tempfile.mkdtemp(prefix="statlens-csv-")
    p = os.path.join(d, "t.csv")
    with open(p, "w") as f:
        f.write("id,score,label,event_date,bad_date,runtime\n")
        f.write("1,1.5,a,2024-01-02,2024-01-02,10\n")
        f.write("2,N/A,NA,2024-01-03 10:00:00,oops,20\n")
        f.write("3,#N/A,,2024-01-04,2024-01-04,\n")
    df = files.infer_dates(files.load_csv(spark, p))
    types = {f.name: f.dataType for f in df.schema.fields}
    assert isinstance(types["id"], T.LongType) and isinstance(types["score"], T.DoubleType)
    assert isinstance(types["event_date"], T.TimestampNTZType)
    assert isinstance(types["bad_date"], T.StringType)  # all or nothing
    assert isinstance(types["runtime"], T.LongType)  # numeric 'time' column stays numeric (K9)
    r = {row["id"]: row for row in df.collect()}
    assert r[2]["score"] is None and r[2]["label"] is None and r[3]["score"] is None


def test_csv_line_breaks_numbers_and_lines(spark, tmp_path):
    rows = [(1, 'a "quoted"\nline', "10d", None), (2, "  spaces, and\n\ncommas ", "0x1p3", None), (3, "back\\slash", "20f", None)]
    df = spark.createDataFrame(rows, "id long, text string, size string, nothing string")
    got = files.load_any(spark, files.export_csv(df, str(tmp_path / "out")))  # a folder without a suffix
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["bigint", "string", "string", "double"]
    assert sorted(tuple(r) for r in got.collect()) == rows
    short = tmp_path / "short.csv"
    short.write_text("a,`b`,c\n1,2\n3,4,5\n")
    assert sorted(tuple(r) for r in files.load_csv(spark, str(short)).collect()) == [(1, 2, None), (3, 4, 5)]
    long = tmp_path / "long.csv"
    long.write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="more than 2 cells"):
        files.load_csv(spark, str(long)).collect()


def test_date_formats(spark):
    rows = [("01/31/2024", "31.01.2024 10:05", "Jan 5, 2024", "20240131", "01/31/2024"), ("12/01/2024", "01.02.2024 00:00", "Feb 10, 2024", "20231201", "31/01/2024")]
    df = files.infer_dates(spark.createDataFrame(rows, "us_date string, time1 string, date2 string, date3 string, mixed_date string"))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["timestamp_ntz"] * 4 + ["string"]
    assert str(df.first()["us_date"]) == "2024-01-31 00:00:00" and str(df.first()["time1"]) == "2024-01-31 10:05:00"


def test_sample_table(spark):
    df = files.sample_table(spark)
    assert df.count() == 200
    assert df.columns == ["date", "sales", "temperature", "marketing_spend", "website_visits", "region",
                          "product_category", "customer_rating", "advertising_budget"]
    s = df.selectExpr("min(customer_rating) a", "max(customer_rating) b", "count(distinct region) r").first()
    assert 1 <= s["a"] and s["b"] <= 5 and s["r"] == 4


def _split(spark, size):
    """Files in splits of ``size`` bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)


@pytest.fixture
def small_splits(spark):
    yield lambda size: _split(spark, size)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_split_inside_quoted_cells(spark, tmp_path, small_splits):
    """Cells with line breaks, quotes and delimiters against Python's reader, cut at any byte."""
    r = random.Random(1)
    texts = ["plain", "", "a\nb", "\n\n", 'say "hi"', '"', '""\n"', "x,y\n,", "tail\n", "é\n" * 30, 'a "b\nc" d', "  pad ", "w" * 200]
    rows = [(k, r.choice(texts), r.choice(texts)) for k in range(40)]
    for name, end in (("lf", "\n"), ("crlf", "\r\n")):
        path = tmp_path / name
        path.mkdir()
        for part in range(2):
            with open(path / f"p{part}.csv", "w", newline="", encoding="utf-8") as f:
                w = csv.writer(f, lineterminator=end)
                w.writerow(["id", "te\nxt", "last"] if name == "lf" else ["id", "te xt", "last"])
                w.writerows(rows[part::2])
        whole = sorted(tuple(x) for x in files.load_csv(spark, str(path), na_values=["none"]).collect())
        assert whole == [(a, b or None, c or None) for a, b, c in rows]
        for size in (1 << 20, 299, 41):
            small_splits(size)
            got = files.load_csv(spark, str(path), na_values=["none"])
            assert sorted(tuple(x) for x in got.collect()) == whole, (name, size)
            assert size > 1000 or got.rdd.getNumPartitions() > 5
        small_splits(1 << 20)


def test_csv_quotes_inside_cells_are_text(spark, tmp_path, small_splits):
    f = tmp_path / "q.csv"
    f.write_text('size,name\n5" pipe,x\n3" a "b,"open\ncell"\n6,"a"\n7" ,""\n' * 8)
    want = [tuple(x) for x in files.load_csv(spark, str(f), infer=False).collect()]
    small_splits(50)
    got = [tuple(x) for x in files.load_csv(spark, str(f), infer=False).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and ('3" a "b', "open\ncell") in got


def test_csv_crlf_files(spark, tmp_path, small_splits):
    f = tmp_path / "w.csv"
    f.write_bytes(b"id,when_date,note\r\n1,2024-01-02,NA\r\n2,2024-01-03,b\r\n\r\n3,2024-01-04,\"x\r\ny\"\r\n")
    for size in (1 << 20, 9):
        small_splits(size)
        df = files.infer_dates(files.load_csv(spark, str(f)))
        assert df.columns == ["id", "when_date", "note"]
        assert sorted((r["id"], str(r["when_date"]), r["note"]) for r in df.collect()) == [
            (1, "2024-01-02 00:00:00", None), (2, "2024-01-03 00:00:00", "b"), (3, "2024-01-04 00:00:00", "x\r\ny")]
    plain = tmp_path / "p.csv"
    plain.write_bytes(b"a,b\r\n1,NA\r\n2,x\r\n")
    for many in (True, False):
        small_splits(5 if many else 1 << 20)
        assert sorted(tuple(r) for r in files.load_csv(spark, str(plain), multi_line=many).collect()) == [(1, None), (2, "x")]


def test_errors_of_a_file_without_a_suffix(spark, tmp_path):
    (tmp_path / "long").write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="more than 2 cells"):
        files.load_any(spark, str(tmp_path / "long")).collect()
    (tmp_path / "bin").write_bytes(b"\x00\x01\x02\xff")
    with pytest.raises(ValueError, match="Unsupported file format"):
        files.load_any(spark, str(tmp_path / "bin"))


def test_dates_by_shapes(spark, tmp_path):
    """Every format with every time of day; what one value rules out; one scan with the types."""
    import datetime as dt
    days = [dt.datetime(2024, 1, 31, 10, 5, 7), dt.datetime(1999, 12, 9, 23, 59, 0), dt.datetime(2024, 2, 29, 0, 0, 30)]
    as_python = {"MM": "%m", "dd": "%d", "yyyy": "%Y", "MMM": "%b", "MMMM": "%B", "HH": "%H", "mm": "%M", "ss": "%S"}

    def show(x, fmt):
        return re.sub(r"([A-Za-z])\1*", lambda m: str(x.day) if m[0] == "d" else x.strftime(as_python[m[0]]), fmt)

    cells, want = {}, {}
    for k, f in enumerate(files.DATE_FORMATS):
        for t in files.TIMES:
            name = f"date_{k}_{len(t)}"
            cells[name] = [show(x, f + t) for x in days]
            want[name] = [dt.datetime.strptime(show(x, f + t), re.sub(r"([A-Za-z])\1*", lambda m: "%d" if m[0] == "d" else as_python[m[0]], f + t)) for x in days]
    plain = {"iso_time": ["2024-01-31T10:05:07.123456", "1999-12-09", " 2024-02-29 00:00:30 "], "bad_date": ["01/31/2024", "31/01/2024", "02/29/2024"],
             "feb_date": ["02/29/2024", "02/30/2024", "01/01/2024"], "mixed_time": ["2024-01-31", "01/31/2024", None], "gap_date": [None, "Jan 5, 2024", None],
             "no_date": [None, None, None], "word_date": ["January", "5", "2024 AD"], "plain": ["2024-01-31"] * 3}
    table = {**cells, **plain}
    df = spark.createDataFrame(list(zip(*table.values())), ", ".join(f"{c} string" for c in table))
    got = files.infer_dates(df)
    kept = {f.name for f in got.schema.fields if f.dataType.simpleString() == "string"}
    assert kept == {"bad_date", "feb_date", "mixed_time", "word_date", "plain"}
    rows = got.collect()
    for c, x in want.items():
        assert [r[c] for r in rows] == x, c
    assert [str(r["iso_time"]) for r in rows] == ["2024-01-31 10:05:07.123456", "1999-12-09 00:00:00", "2024-02-29 00:00:30"]
    f = tmp_path / "d.csv"
    f.write_text("id,when_date,time_n,x\n1,31.01.2024,10,a\n2,NA,20,b\n3,01.02.2024,,c\n")
    one, two = files.load_csv(spark, str(f), dates=True), files.infer_dates(files.load_csv(spark, str(f)))
    assert one.schema == two.schema and one.collect() == two.collect()
    assert [c.dataType.simpleString() for c in one.schema.fields] == ["bigint", "timestamp_ntz", "bigint", "string"]
