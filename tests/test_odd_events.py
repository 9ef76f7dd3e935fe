"""Queries against their SQL on events with odd keys, numbers and times."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from check_oracles import difference
from tallow.fixtures import number_text

EVENTS = "/root/testdata/sf0.001/events.parquet"

# What takes the place of a column.
ODD = {
    # products from 1e7 up, which Spark writes with an exponent
    "large_users": "user_id + 90000 as user_id",
    "negative_ids": "event_id - 900 as event_id",
    # one id is null in all; more on a day would leave their order open
    "null_id": "if(event_id = 203, null, event_id) as event_id",
    "null_times": "if(event_id % 9 = 3, null, ts) as ts",
    "no_times": "null::timestamp as ts",
    # asked for as the symbol nobody has archives of
    "unknown_type": "if(event_id % 9 = 3, 'nosuch', event_type) as event_type",
}


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Folder and SQL connection of each odd table."""
    made = {}
    for name, column in ODD.items():
        folder = tmp_path_factory.mktemp(name)
        con = duckdb.connect()
        con.sql(f"copy (select * replace ({column}) from '{EVENTS}') to '{folder}/events.parquet' (format parquet)")
        con.sql(f"create view events as select * from '{folder}/events.parquet'")
        made[name] = str(folder), con
    return made


def check(spark, folder, con, query):
    ours = entry_points.queries()[query](spark, folder).toPandas()
    assert difference(ours, con.sql(entry_points.oracle_sql()[query]).df()) is None


@pytest.mark.parametrize("query", ["drop_all_null_rows", "archive_scan", "candle_archive_pushdown", "candle_archive_source", "headerless_archive_scan", "csv_scan_header_discard"])
def test_large_numbers_as_text(spark, odd, query):
    check(spark, *odd["large_users"], query)


NUMBERS = [
    0.0, -0.0, 1e-3, 9.99e-4, 4.2e-4, 1e-4, 9.99e-5, 1.05e-5, 5e-324, 9999999.5, 1e7, -15747136.430000002,
    3.92e13, 9007199254740993.0, 9999999999999998.0, 1e16, 1.371306e16, 6.613556112256402e18, 8.41e21, 2e23,
    1.7976931348623157e308, float("inf"), float("-inf"), float("nan"), None,
]


def test_number_text(spark):
    numbers = spark.createDataFrame([(x,) for x in NUMBERS], "x double")
    rows = numbers.select("x", F.expr(number_text("x")).alias("text")).collect()
    # Python spells numbers as DuckDB does
    assert [r["text"] for r in rows] == [None if r["x"] is None else repr(r["x"]) for r in rows]


def test_csv_positions_of_split_files(spark, odd):
    """Positions have no gaps where several tasks read one file."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        check(spark, *odd["large_users"], "csv_scan_header_discard")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("table", ["negative_ids", "null_id"])
@pytest.mark.parametrize("query", ["coerce_float32", "coerce_int64"])
def test_odd_ids(spark, odd, query, table):
    check(spark, *odd[table], query)


@pytest.mark.parametrize("table", ["null_id", "null_times"])
@pytest.mark.parametrize("query", ["day_gate", "epoch_ms_to_utc", "drop_null_timestamp", "dedup_keep_first", "candle_normalize", "landed_csv_normalize"])
def test_days_of_odd_rows(spark, odd, query, table):
    check(spark, *odd[table], query)


@pytest.mark.parametrize("table", ["null_times", "no_times", "unknown_type"])
def test_archives_of_odd_days(spark, odd, table):
    check(spark, *odd[table], "archive_scan")


@pytest.fixture(scope="module")
def unsorted(tmp_path_factory):
    """Folder and SQL connection of events that do not lie in the order of their ids."""
    folder = tmp_path_factory.mktemp("unsorted")
    con = duckdb.connect()
    con.sql(f"copy (select * from '{EVENTS}' order by hash(event_id)) to '{folder}/events.parquet' (format parquet)")
    con.sql(f"create view events as select * from '{folder}/events.parquet'")
    return str(folder), con


@pytest.mark.parametrize("query", ["landed_csv_normalize", "csv_scan_header_discard"])
def test_unsorted_events(spark, unsorted, query):
    check(spark, *unsorted, query)


WHOLE = [
    9.203579927868276e17, -9.550299547244212e17, 1.3857576053419028e18, 2.0003685697692052e18, 3.4028235677973366e28,
    1e16, 1e17, 2e17, 9.9999999999999997e22, 1.2e28, -8.41e21,
]


def test_text_of_large_whole_numbers(spark):
    """The digits nearest to the number, also where Java's own text of it is a digit off."""
    numbers = spark.createDataFrame([(x,) for x in WHOLE], "x double")
    rows = numbers.select(F.expr(number_text("x")).alias("text")).collect()
    assert [r["text"] for r in rows] == [repr(x) for x in WHOLE]
