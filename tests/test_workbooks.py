"""Workbooks: round trips, other writers' archives, ranges, failures."""

import random
import resource
import zipfile

import pytest
from pyspark.sql import functions as F

from quirelake.sources import workbooks

ODD = ["plain", " spaced ", "a<b>&\"c'", "é 日本", "line\nfeed", "car\rriage", "bell\x07", "_x0041_", "0", "1.50"]


def test_round_trip_by_key_and_sheet(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["A 1", "b/2", "c", None]), rng.choice(["OCCM", "HT", "a:b"]), i, rng.choice([*ODD, None, ""]), rng.choice(ODD)) for i in range(400)]
    df = spark.createDataFrame(rows, "airframe string, sheet string, no int, part string, note string").repartition(5)
    workbooks.write_workbooks(df, f"file://{tmp_path}/out", "airframe", "sheet", order=("no",))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["%.xlsx", "A 1.xlsx", "b%2F2.xlsx", "c.xlsx"]
    got = spark.read.format("workbook").option("rowsPerPartition", "40").load(f"file://{tmp_path}/out/*.xlsx")
    assert got.columns == ["no", "part", "note", "_path", "_sheet"]
    back = {(r["_path"].rsplit("/", 1)[1], r["_sheet"], r["no"]): (r["part"], r["note"]) for r in got.collect()}
    want = {(f"{workbooks.file_name(k or '')}.xlsx", s.replace(":", "_"), str(n)): (p or None, t) for k, s, n, p, t in rows}
    assert back == want
    one = spark.read.format("workbook").option("sheet", "HT").load(f"file://{tmp_path}/out/c.xlsx")
    assert [int(r["no"]) for r in one.collect()] == sorted(n for k, s, n, *_ in rows if (k, s) == ("c", "HT"))
    assert spark.read.format("workbook").load(f"file://{tmp_path}/out").count() == 400
    workbooks.write_workbooks(df.limit(0), f"file://{tmp_path}/none", "airframe", "sheet")
    assert not (tmp_path / "none").exists() or not list((tmp_path / "none").glob("*.xlsx"))


def test_other_archives(spark, tmp_path):
    """Shared strings, numbers, booleans, cells without places, blank and repeated headers, no dimension, short rows."""
    sheet = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>0</v></c></row><row r="3"><c r="A3"><v>1.5</v></c><c r="C3" t="b"><v>1</v></c><c r="Z3"><v>9</v></c></row><row><c t="s"><v>1</v></c></row>'
    path = tmp_path / "x.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{workbooks.MAIN}" xmlns:r="{workbooks.LINKS}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{workbooks.PACKAGE}/relationships"><Relationship Id="r1" Type="t" Target="/xl/s.xml"/></Relationships>')
        z.writestr("xl/s.xml", f'<worksheet xmlns="{workbooks.MAIN}"><sheetData>{sheet}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{workbooks.MAIN}"><si><t>ATA</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>')
    got = spark.read.format("workbook").load(str(path)) if workbooks.register(spark) is None else None
    assert got.columns == ["ATA", "B", "ATA_C", "_path", "_sheet"]
    assert [tuple(r)[:3] for r in got.collect()] == [("1.5", None, "1"), ("two runs", None, None)]


def test_a_million_rows_in_bounded_memory(tmp_path):
    """Written and read by one process, whose memory does not grow with the rows."""
    n = 1_000_000
    book = workbooks.Workbook(str(tmp_path / "big.xlsx"), ["no", "part"])
    for i in range(1000):
        book.add("s", [str(i), f"P{i}"])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for i in range(1000, n):
        book.add("s", [str(i), f"P{i}"])
    book.close()
    with zipfile.ZipFile(tmp_path / "big.xlsx") as z:
        assert sum(1 for _ in workbooks.sheet_rows(z, "xl/worksheets/sheet1.xml", [])) == n + 1
        assert list(workbooks.sheet_rows(z, "xl/worksheets/sheet1.xml", [], 999_999, 1_000_000)) == [{0: "999997", 1: "P999997"}, {0: "999998", 1: "P999998"}]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 60_000  # KB


def test_a_full_sheet_goes_on_in_another(tmp_path, monkeypatch):
    monkeypatch.setattr(workbooks, "MOST_ROWS", 3)
    book = workbooks.Workbook(str(tmp_path / "b.xlsx"), ["a"])
    for i in range(5):
        book.add("s" * 40, [str(i)])
    book.close()
    with zipfile.ZipFile(tmp_path / "b.xlsx") as z:
        found = workbooks._sheets(z)
        assert [len(name) <= 31 for name, _ in found] == [True] * 3 and len({name for name, _ in found}) == 3
        assert [[r.get(0) for r in workbooks.sheet_rows(z, part, [])] for _, part in found] == [["a", "0", "1"], ["a", "2", "3"], ["a", "4"]]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    fail = F.udf(lambda i: 1 // (i - 7) and str(i), "string")
    df = spark.range(20).select(F.lit("k").alias("k"), F.lit("s").alias("s"), fail("id").alias("v"))
    with pytest.raises(Exception):
        workbooks.write_workbooks(df, f"file://{tmp_path}/out", "k", "s")
    assert not list(tmp_path.glob("out/*"))
