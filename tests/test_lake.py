"""What lies in the lake after a write."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallow.fixtures import raw_candles
from tallow.operators.clean import type_candles
from tallow.operators.days import day_stats, run_manifest
from tallow.plans.ingest import load_days
from tallow.plans.normalize import normalize
from tallow.schema import DAY_KEY, LAKE_SCHEMA, NO_TIME, OUTPUT_COLUMNS
from tallow.session import stage
from tallow.sinks.lake import cluster_days, read_lake, read_nanosecond_lake, write_days

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def landed(spark):
    return stage(type_candles(raw_candles(spark, DATA)), "landing")


def files_by_day(lake):
    days = {}
    for f in Path(lake).rglob("*.parquet"):
        days.setdefault(f.parent, []).append(f)
    return days


def test_files_are_sorted_and_typed(spark, landed, tmp_path):
    load_days(landed, day_stats(landed), str(tmp_path), "klines")
    days = files_by_day(tmp_path)
    assert len(days) == 149
    for files in days.values():
        file = pq.ParquetFile(files[0])
        assert file.metadata.row_group(0).column(0).compression == "ZSTD"
        assert file.schema_arrow.names == OUTPUT_COLUMNS
        assert file.schema_arrow.field("timestamp").type == pa.timestamp("us", "UTC")
        assert file.schema_arrow.field("open").type == pa.float32()
        times = file.read(["open_time"]).column(0).to_pylist()
        assert times == sorted(set(times))


def test_days_are_cut_by_time_where_large(spark, landed, tmp_path):
    load_days(landed, day_stats(landed), str(tmp_path), "klines")
    days = files_by_day(tmp_path)
    assert len(days) == 149
    for folder, files in days.items():
        spans = []
        for f in files:
            times = pq.ParquetFile(f).read(["open_time"]).column(0).to_pylist()
            assert times == sorted(set(times))
            spans.append((times[0], times[-1]))
        spans.sort()
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert sum(map(len, days.values())) < 149 + 4 + 1  # cut at range bounds only
    wanted = normalize(raw_candles(spark, DATA)).select(*LAKE_SCHEMA.fieldNames())
    stored = read_lake(spark, str(tmp_path), "klines")
    assert stored.exceptAll(wanted).isEmpty() and stored.count() == wanted.count()


def test_overwrite_touches_only_its_days(spark, landed, tmp_path):
    prefix, stats = str(tmp_path), day_stats(landed)
    load_days(landed, stats, prefix, "klines")
    before = {f for files in files_by_day(tmp_path).values() for f in files}
    one_day = F.col("date") == "2024-01-05"
    for _ in range(2):
        load_days(landed.where(one_day), stats.where(one_day), prefix, "klines")
    after = {f for files in files_by_day(tmp_path).values() for f in files}
    assert len(after) == len(before)
    assert {f.parent.name for f in before - after} == {"date=2024-01-05"}
    nothing = landed.where(F.lit(False))
    load_days(nothing, day_stats(nothing), prefix, "klines")
    assert {f for files in files_by_day(tmp_path).values() for f in files} == after


def test_a_day_that_comes_to_nothing_loses_its_rows(spark, landed, tmp_path):
    prefix = str(tmp_path)
    load_days(landed, day_stats(landed), prefix, "klines")
    one = (F.col("date") == "2024-01-05") & (F.col("symbol") == "CLICKUSDT")
    timeless = landed.where(one).withColumn("open_time", F.lit(NO_TIME))
    stats = day_stats(timeless)
    load_days(timeless, stats, prefix, "klines")
    assert len(files_by_day(tmp_path)) == 148
    folder = tmp_path / "klines/symbol=CLICKUSDT/interval=15m/date=2024-01-05"
    assert not folder.exists() and folder.parent.is_dir()
    manifest = run_manifest(timeless.select(*DAY_KEY).distinct(), stats, prefix)
    assert [(r.status, r.path) for r in manifest.collect()] == [("DONE", None)]


def test_folders_in_the_manifest_hold_the_files(spark, landed, tmp_path):
    one = landed.where((F.col("date") == "2024-01-05") & (F.col("symbol") == "CLICKUSDT"))
    for symbol in ("CLICKUSDT", "A%B:C", "it's {x}^[1]"):
        named = one.withColumn("symbol", F.lit(symbol))
        stats = day_stats(named)
        load_days(named, stats, str(tmp_path), "klines")
        row = run_manifest(named.select(*DAY_KEY).distinct(), stats, str(tmp_path)).first()
        assert list(Path(row.path).glob("part-*.parquet"))


def candle(spark, interval):
    candles = normalize(raw_candles(spark, DATA))
    one = candles.where((F.col("symbol") == "CLICKUSDT") & (F.col("date") == "2024-01-01"))
    return one.withColumn("interval", F.lit(interval).cast("string"))


@pytest.mark.parametrize("interval, stored", [("1d", "1d"), ("1.0", "1.0"), (None, "None")])
def test_interval_survives_as_text(spark, tmp_path, interval, stored):
    write_days(cluster_days(candle(spark, interval)), str(tmp_path), "klines")
    lake = read_lake(spark, str(tmp_path), "klines")
    assert [r[0] for r in lake.select("interval").distinct().collect()] == [stored]
    assert (tmp_path / f"klines/symbol=CLICKUSDT/interval={stored}/date=2024-01-01").is_dir()


def test_partition_and_row_filters_reach_the_scan(spark, landed, tmp_path):
    load_days(landed, day_stats(landed), str(tmp_path), "klines")
    lake = read_lake(spark, str(tmp_path), "klines")
    query = lake.where("date = '2024-01-05' and open_time > 5").select("close")
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert "GreaterThan(open_time,5)" in plan
    assert "ReadSchema: struct<open_time:bigint,close:float>" in plan


def test_files_with_nanosecond_times(spark, tmp_path):
    write_days(cluster_days(candle(spark, "1m")), str(tmp_path / "micros"), "klines")
    source = next((tmp_path / "micros").rglob("*.parquet"))
    table = pq.ParquetFile(source).read()
    nanos = table.column("timestamp").cast(pa.timestamp("ns", "UTC"))
    folder = tmp_path / "nanos" / source.parent.relative_to(tmp_path / "micros")
    folder.mkdir(parents=True)
    pq.write_table(table.set_column(0, "timestamp", nanos), folder / "data.parquet")
    old = read_nanosecond_lake(spark, str(tmp_path / "nanos"), "klines")
    new = read_lake(spark, str(tmp_path / "micros"), "klines")
    assert old.schema == new.schema
    assert old.exceptAll(new).isEmpty() and old.count() == new.count() > 0


def test_candles_and_times_agree(spark, landed, tmp_path):
    load_days(landed, day_stats(landed), str(tmp_path), "klines")
    lake = read_lake(spark, str(tmp_path), "klines")
    assert lake.where("unix_millis(timestamp) <> open_time").isEmpty()
