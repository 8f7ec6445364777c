"""Records that do not fit are set apart in the scan that reads the others."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from podium.sources import read_csv_checked, read_csv_text, reject_report
from podium.sources.quarantine import checked_records

SCHEMA = "ID int, Name string, Age double, Games string, Born date"
HEADER = "ID,Name,Age,Games,Born"
GOOD = {
    '1,"Al ""Bob"", Jr.",24,1956 Summer,1930-01-02': (1, 'Al "Bob", Jr.', 24.0, "1956 Summer", "1930-01-02"),
    "2,Cy,NA,1960 Summer,NA": (2, "Cy", None, "1960 Summer", None),
    "3,NA,7.5,,": (3, "NA", 7.5, None, None),
}
BAD = {
    r'4,"Di \"Bob\", Jr.",24,1956 Summer,1930-01-02': ["fields"],  # quotes not doubled: shifted
    "5,Ed,24,1956 Summer": ["fields"],
    "6,Flo,24,1956 Summer,1930-01-02,more": ["fields"],
    "7,Gus,old,1956 Summer,1930-01-02": ["type of Age"],
    "x,Hal,old,1956 Summer,yesterday": ["type of ID", "type of Age", "type of Born"],
    "8,Ida,24,SWE,1930-01-02": ["games"],
}


@pytest.fixture
def checks(spark):
    return {"games": F.col("Games").rlike(r"^\d{4} (Summer|Winter)$")}


@pytest.fixture
def files(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("\n".join([HEADER, *GOOD, *list(BAD)[:3]]) + "\n")
    (folder / "b.csv").write_text("\n".join([HEADER, *list(BAD)[3:]]) + "\n")
    return str(folder)


def test_rows_and_rejected_make_up_the_files(spark, files, checks):
    rows, rejected = read_csv_checked(spark, files, SCHEMA, checks=checks)
    assert rows.schema.simpleString() == "struct<ID:int,Name:string,Age:double,Games:string,Born:date>"
    assert {tuple(str(v) if hasattr(v, "year") else v for v in r) for r in rows.collect()} == set(GOOD.values())
    got = {r.record: (os.path.basename(r.file), r.reasons) for r in rejected.collect()}
    assert got == {text: ("a.csv" if i < 3 else "b.csv", why) for i, (text, why) in enumerate(BAD.items())}
    assert {tuple(r) for r in reject_report(rejected).collect()} == {
        ("fields", 3), ("type of ID", 1), ("type of Age", 2), ("type of Born", 1), ("games", 1),
    }


def test_one_scan_parses_both(spark, files, checks):
    records, _ = checked_records(spark, files, SCHEMA, checks=checks)
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and "Exchange" not in plan and "Python" not in plan
    rows, rejected = read_csv_checked(spark, files, SCHEMA)
    for part, flag in ((rows, "false"), (rejected, "true")):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "FileScan parquet" in plan and "PartitionFilters" in plan and "csv" not in plan, flag


def test_an_unknown_condition_is_no_fault(spark, files, checks):
    rows, _ = read_csv_checked(spark, files, SCHEMA, checks=checks)
    assert rows.filter("Games IS NULL").count() == 1


def test_without_missing_text(spark, files, checks):
    _, rejected = read_csv_checked(spark, files, SCHEMA, missing=None)
    assert {"type of Age", "type of Born"} <= set(rejected.filter("record LIKE '2,%'").first().reasons)


@pytest.mark.parametrize("kept", ["good", "bad", "none"])
def test_files_of_one_kind(spark, tmp_path, kept, checks):
    lines = {"good": GOOD, "bad": BAD, "none": []}[kept]
    (tmp_path / "a.csv").write_text("\n".join([HEADER, *lines]) + "\n")
    rows, rejected = read_csv_checked(spark, str(tmp_path / "a.csv"), SCHEMA, checks=checks)
    assert (rows.count(), rejected.count()) == (len(GOOD) if kept == "good" else 0, len(BAD) if kept == "bad" else 0)


def test_clashing_names_and_repeats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("file,record,reasons,broken,rejected,value0\n" + "1,a,b,c,d,e\n" * 3 + "1,a\n" * 2)
    rows, rejected = read_csv_checked(spark, str(tmp_path / "a.csv"), "file int, record string, reasons string, broken string, rejected string, value0 string")
    assert [tuple(r) for r in rows.collect()] == [(1, "a", "b", "c", "d", "e")] * 3
    assert [(r.record, r.reasons) for r in rejected.collect()] == [("1,a", ["fields"])] * 2


def test_what_was_rejected_can_be_mended_and_read(spark, files, tmp_path, checks):
    """Records are kept as text, so a repaired copy is a file again."""
    _, rejected = read_csv_checked(spark, files, SCHEMA, checks=checks)
    mended = rejected.select(F.regexp_replace("record", r'\\"', '""').alias("value")).filter("value LIKE '4,%'")
    target = str(tmp_path / "mended")
    mended.coalesce(1).write.text(target)
    part = next(p for p in os.listdir(target) if p.startswith("part"))
    text = open(f"{target}/{part}").read()
    (tmp_path / "again.csv").write_text(f"{HEADER}\n{text}")
    rows, bad = read_csv_checked(spark, str(tmp_path / "again.csv"), SCHEMA)
    assert bad.isEmpty() and rows.first().Name == 'Di "Bob", Jr.'
    assert read_csv_text(spark, str(tmp_path / "again.csv")).count() == 1
