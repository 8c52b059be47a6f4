"""CSV reading on awkward files, and NaN as a missing value."""

import datetime

import pytest
from pyspark.sql import functions as F

from loomstat.functions.ordered import fill_forward
from loomstat.operators import clean as C
from loomstat.operators import profile as P
from loomstat.sources import sinks as S
from loomstat.sources.csv import bad_line_count, read_csv
from loomstat.sources.slice import read_rows


@pytest.fixture
def put(tmp_path):
    def write(name, data):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
        return str(tmp_path / name)
    return write


def test_number_columns_stay_numeric(spark, put):
    df = read_csv(spark, put("a.csv", b"\xef\xbb\xbfid , age,flag,s\n1,1,True,1d\n2,NA,False,x\n3, n/a,,y\n4,2.5,null, NA \n"))
    assert df.dtypes == [("id", "bigint"), ("age", "string"), ("flag", "boolean"), ("s", "string")]
    assert [r.s for r in df.collect()] == ["1d", "x", "y", " NA "]
    df = read_csv(spark, put("b.csv", b"age,f\n1,1\nNA,\n3,2.5\nN/A,null\n"))
    assert df.dtypes == [("age", "bigint"), ("f", "double")]
    assert [tuple(r) for r in df.collect()] == [(1, 1.0), (None, None), (3, 2.5), (None, None)]


def test_quotes_and_bad_lines(spark, put):
    path = put("a.csv", b'a,b,c\n"x,y",1,2\n"li""ne\nbreak",3,\nshort\n4,"x,y,z"\ntoo,2,3,4\n"q,w",2,3,"4,5"\n')
    assert [tuple(r) for r in read_csv(spark, path).collect()] == [
        ("x,y", "1", 2), ('li"ne\nbreak', "3", None), ("short", None, None), ("4", "x,y,z", None)]
    assert bad_line_count(spark, path) == 2
    assert read_csv(spark, path).select("b").count() == 4


def test_cp1252_separator_and_empty(spark, put):
    df = read_csv(spark, put("a.csv", "id;näme–x\n1;“q” – café €\n".encode("cp1252")), separator=";")
    assert df.columns == ["id", "näme–x"] and df.first()[1] == "“q” – café €"
    assert read_csv(spark, put("b.csv", b"a,b\n")).count() == 0


def test_max_rows_are_the_first_in_file_order(spark, put, tmp_path):
    for k, n in enumerate((3, 500, 40)):
        put(f"d/p{k}.csv", ("k,v\n" + "".join(f"{k},{i}\n" for i in range(n))).encode())
    rows = [tuple(r) for r in read_csv(spark, f"{tmp_path}/d", max_rows=10).collect()]
    assert sorted(rows) == [(0, i) for i in range(3)] + [(1, i) for i in range(7)]


@pytest.fixture(scope="module")
def holes(spark):
    return spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 3.0), (4, None)], "k long, x double")


def test_nan_is_missing(holes):
    for strategy, want in (("mean", 2.0), ("median", 2.0), ("zero", 0.0), ("mode", 1.0)):
        out, _ = C.fill_nulls(holes, "x", strategy)
        assert [r.x for r in out.orderBy("k").collect()] == [1.0, want, 3.0, want], strategy
    out, _ = C.fill_nulls(holes, "x", "ffill", "k")
    assert [r.x for r in out.orderBy("k").collect()] == [1.0, 1.0, 3.0, 3.0]
    assert C.count_nulls(holes, "x") == 2
    assert P.inspect_dataset(holes).where("column_name = 'x'").first().null_count == 2
    assert P.column_profile(holes, "x").first().null_count == 2
    assert P.value_counts_long(holes, ["x"]).where("value IS NULL").first().cnt == 2
    assert P.duplicate_count(holes.select("x")).first().dup_count == 1


def test_duplicates_tell_null_patterns_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", None), ("", "a"), ("a", "")], "x string, y string")
    assert P.duplicate_count(df).first().dup_count == 1


def test_outlier_samples_take_the_first_of_each_column(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), F.when(F.col("id") % 50 == 7, 1e6 + F.col("id"))
                                  .otherwise(F.col("id") % 10).alias("x"))
    assert [(r.k, r.value) for r in P.outlier_samples(df, "k", ["x"]).orderBy("k").collect()] == [
        (7 + 50 * i, 1e6 + 7 + 50 * i) for i in range(5)]


def test_slice_of_wide_keys_and_text_keys(spark):
    df = spark.range(200).select((F.lit(2**60) + F.col("id")).alias("k"), F.format_string("Name#%09d", "id").alias("t"))
    df = df.repartition(7)
    assert sorted(r.k - 2**60 for r in read_rows(df, "k", 10, 130).collect()) == list(range(10, 130))
    assert sorted(int(r.t[5:]) for r in read_rows(df, "t", 190, 400).collect()) == list(range(190, 200))
    assert read_rows(df, "k", 5, 5).count() == 0


def test_fill_by_a_text_key(spark):
    df = spark.createDataFrame([(f"k{i:03}", None if i % 3 else float(i)) for i in range(100)], "k string, x double")
    out = fill_forward(df.repartition(5), ["x"], "k", n_buckets=6).orderBy("k").collect()
    assert [r.x for r in out] == [float(i - i % 3) for i in range(100)]
    day = datetime.date(2024, 1, 1)
    df = spark.createDataFrame([(day, 1.0), (day, None)], "k date, x double")
    assert fill_forward(df, ["x"], "k").count() == 2


def test_versions_keep_their_own_columns(spark, tmp_path):
    root = f"{tmp_path}/v"
    S.write_version(spark.createDataFrame([(1,)], ["a"]), root, "20260101T0")
    S.write_version(spark.createDataFrame([(2, 3)], ["a", "b"]), root, "20260102T0")
    assert S.read_version(spark, root).columns == ["a", "b"]
    assert S.read_version(spark, root, "20260101").columns == ["a"]
    S.restore_version(spark, root, "20260101")
    assert [tuple(r) for r in S.read_version(spark, root).collect()] == [(1,)]
