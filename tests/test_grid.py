import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallow.functions.paths import archive_path, object_key
from tallow.operators.grid import date_spine, job_grid
from tallow.sources.archive import archive_url


def days(df):
    return sorted(r["date"] for r in df.collect())


def test_spine_includes_both_ends(spark):
    spine = date_spine(spark, "2024-02-28", dt.date(2024, 3, 1))
    assert days(spine) == ["2024-02-28", "2024-02-29", "2024-03-01"]


def test_spine_of_one_day_and_of_none(spark):
    assert days(date_spine(spark, "2024-01-01", "2024-01-01")) == ["2024-01-01"]
    assert days(date_spine(spark, "2024-01-02", "2024-01-01")) == []
    assert days(date_spine(spark, "2024-05-01", "2024-01-01")) == []


def test_grid_pairs_every_symbol_with_every_day(spark):
    symbols = spark.createDataFrame([("A",), ("B",)], "symbol string")
    grid = job_grid(symbols, "klines", None, "2024-01-01", "2024-01-03")
    assert {tuple(r) for r in grid.collect()} == {
        (s, "None", f"2024-01-0{d}", "klines") for s in "AB" for d in (1, 2, 3)
    }
    assert "Join" not in grid._jdf.queryExecution().executedPlan().toString()


ROOT = "https://example.org/daily//"


@pytest.mark.parametrize(
    "source, interval, expected",
    [
        ("klines", "1m", "https://example.org/daily/klines/QXZUSDT/1m/QXZUSDT-1m-2031-07-09.zip"),
        ("oddTicks", None,
         "https://example.org/daily/oddTicks/QXZUSDT/QXZUSDT-oddTicks-2031-07-09.zip"),
        ("oddTicks", "",
         "https://example.org/daily/oddTicks/QXZUSDT/QXZUSDT-oddTicks-2031-07-09.zip"),
    ],
)
def test_archive_path(spark, source, interval, expected):
    row = spark.createDataFrame(
        [(source, "QXZUSDT", interval, "2031-07-09")], "s string, y string, i string, d string"
    )
    path = archive_path(ROOT, *(F.col(c) for c in "syid"))
    assert row.select(path).first()[0] == expected
    assert archive_url(ROOT, source, "QXZUSDT", interval, "2031-07-09") == expected


@pytest.mark.parametrize(
    "prefix, interval, expected",
    [
        ("raw", "1m", "raw/klines/symbol=A/interval=1m/date=2024-01-01/data.parquet"),
        ("/a/b//", "1m", "a/b/klines/symbol=A/interval=1m/date=2024-01-01/data.parquet"),
        ("", "1m", "klines/symbol=A/interval=1m/date=2024-01-01/data.parquet"),
        ("raw", None, "raw/klines/symbol=A/interval=None/date=2024-01-01/data.parquet"),
    ],
)
def test_object_key(spark, prefix, interval, expected):
    row = spark.createDataFrame([(interval,)], "i string")
    key = object_key(prefix, F.lit("klines"), F.lit("A"), F.col("i"), F.lit("2024-01-01"))
    assert row.select(key).first()[0] == expected
