"""CSV robustness (reference cases), versioned writes and the driver contract."""

import uuid

from loomstat.session import ensure_checkpoint_dir
from loomstat.sources import csv as CSV
from loomstat.sources import sinks as SK


def _write(spark, data: bytes) -> str:
    import os
    d = f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    os.makedirs(d)
    with open(f"{d}/f.csv", "wb") as fh:
        fh.write(data)
    return d


def test_csv_bom_padded_header_separator_na(spark):
    p = _write(spark, "﻿ a ; b \n1;x\n2;NA\n3;\n".encode("utf-8"))
    df = CSV.read_csv(spark, p, separator=";")
    assert df.columns == ["a", "b"] and df.where("b IS NULL").count() == 2


def test_csv_latin1_fallback_and_bad_lines(spark):
    p = _write(spark, "name,v\ncaf\xe9,1\nna\xefve,2,extra\nx,3\n".encode("latin-1"))
    df = CSV.read_csv(spark, p)
    assert sorted(r["name"] for r in df.collect()) == ["café", "x"]
    assert CSV.bad_line_count(spark, p) == 1


def test_csv_max_rows(spark):
    p = _write(spark, ("a\n" + "\n".join(str(i) for i in range(50)) + "\n").encode())
    assert [r["a"] for r in CSV.read_csv(spark, p, max_rows=5).collect()] == [0, 1, 2, 3, 4]


def test_versions_restore(spark):
    root = f"{ensure_checkpoint_dir(spark)}/v-{uuid.uuid4().hex}"
    a = spark.createDataFrame([(1,), (2,)], "x long")
    SK.write_version(a, root, "20260101T000000000000Z")
    SK.write_version(a.where("x = 1"), root, "20260102T000000000000Z")
    assert SK.read_version(spark, root).count() == 1
    SK.restore_version(spark, root, "0101")
    assert SK.read_version(spark, root).count() == 2
    assert SK.list_versions(spark, root).count() == 3


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert set(df.columns) == {"alert_type", "severity", "column_name", "column_b", "value"}
    df.collect()
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) > 150
