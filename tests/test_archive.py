"""Edge files, one archive each, through the whole job."""

import csv as csv_module
import io
import math
import re
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from helpers import HEADER, T0, archive_file, csv_text, row, write_archive
from tallow.plans.ingest import ingest
from tallow.schema import NO_TIME, OUTPUT_COLUMNS
from tallow.session import shared_path
from tallow.sinks.lake import read_lake
from tallow.plans.normalize import normalize
from tallow.sources import archive
from tallow.sources.archive import ArchiveReader, register, scan_archives
from tallow.sources.landed import read_landed_csv, scan_landed_zips
from tallow.sources.member import BATCH_ROWS, candle_rows

NARROW = "id,price,qty,quote_qty,time,is_buyer_maker,is_best"
NULLS = "," * 11

# symbol -> (members, expected status, error, stored rows as {column: values by open_time})
EDGE_FILES = {
    "HEADERED": ([csv_text(row(0), row(1))], "DONE", None, {"open": [1.5, 1.5]}),
    "HEADERLESS": ([csv_text(row(1), header=row(0))], "DONE", None, {"open_time": [T0 + 60000]}),
    "ELEVEN": ([csv_text(row(0, width=11), header=HEADER.removesuffix(",ignore"))],
               "DONE", None, {"taker_buy_quote": [4.5]}),
    "FOURTEEN": ([csv_text(row(0) + ",8,9", header=HEADER + ",a,b")], "DONE", None, {"trades": [7]}),
    "NARROWEMPTY": ([csv_text(header=NARROW)], "SKIP", None, {}),
    "NARROWNULL": ([csv_text(",,,,,,", header=NARROW)], "SKIP", None, {}),
    "SEVEN": ([csv_text("1,2,3,4,5,6,7", header=NARROW)], "ERROR", "7 columns, 11 needed", {}),
    "HEADERONLY": ([csv_text()], "SKIP", None, {}),
    "HEADERNONEWLINE": ([HEADER], "SKIP", None, {}),
    "ALLNULL": ([csv_text(NULLS, "NA,null,NaN" + "," * 9)], "SKIP", None, {}),
    "SOMENULL": ([csv_text(NULLS, row(0), NULLS)], "DONE", None, {"trades": [7]}),
    "ZEROBYTE": ([""], "ERROR", "ValueError: the first member is empty", {}),
    "NOMEMBER": ([], "ERROR", "ValueError: the archive has no member", {}),
    "TWOMEMBERS": ([csv_text(row(0)), csv_text(row(1), row(2))], "DONE", None, {"open_time": [T0]}),
    "ONLYEXTRA": ([csv_text("," * 11 + "5")], "ERROR", "open_time is not an integer", {}),
    "BADTRADES": ([csv_text(row(0), row(1, trades="x"))], "ERROR", "trades is not an integer", {}),
    "NOCLOSETIME": ([csv_text(row(0, close_time=""))], "ERROR", "close_time is not an integer", {}),
    "BADOPEN": ([csv_text(row(0, open="x"), row(1))], "DONE", None, {"open": [None, 1.5]}),
    "NATOKENS": ([csv_text(row(0, open="NA", high="null", low="NaN", close="N/A", volume=""))],
                 "DONE", None, {c: [None] for c in ["open", "high", "low", "close", "volume"]}),
    "SUFFIX": ([csv_text(row(0, open="1.5d", high="1.5f", low="0x1p3"))],
               "DONE", None, {"open": [None], "high": [None], "low": [None], "close": [1.25]}),
    "INF": ([csv_text(row(0, open="inf", high="1e39", low="-inf"))],
            "DONE", None, {"open": [math.inf], "high": [math.inf], "low": [-math.inf]}),
    "FRACINT": ([csv_text(row(0, trades="12.7", close_time="1e3"))],
                "DONE", None, {"trades": [12], "close_time": [1000]}),
    "BIGINT": ([csv_text(row(0, trades="9223372036854775808"))],
               "ERROR", "trades is not an integer", {}),
    "DUPS": ([csv_text(row(0, close=1), row(0, close=2), row(1, close=3), row(0, close=4))],
             "DONE", None, {"close": [1.0, 3.0]}),
    "BADDUP": ([csv_text(row(0), row(0, trades="x"))], "ERROR", "trades is not an integer", {}),
    "UNSORTED": ([csv_text(row(2), row(1), row(0))],
                 "DONE", None, {"open_time": [T0, T0 + 60000, T0 + 120000]}),
    "MICROS": ([csv_text(row(0, open_time=T0 * 1000))], "ERROR", "open_time is out of range", {}),
    "NATSENTINEL": ([csv_text(row(0), row(1, open_time=NO_TIME))],
                    "DONE", None, {"open_time": [T0]}),
    "ONLYSENTINEL": ([csv_text(row(0, open_time=NO_TIME))], "DONE", None, {}),
    "OTHERDAY": ([csv_text(row(0, open_time=0))], "DONE", None, {"open_time": [0]}),
    "SHORTROW": ([csv_text(row(0), row(1, width=11), row(2))], "DONE", None, {"trades": [7, 7, 7]}),
    "SHORTINT": ([csv_text(row(0), row(1, width=6))], "ERROR", "close_time is not an integer", {}),
    "LONGROW": ([csv_text(row(0), row(1) + ",1")],
                "ERROR", "ValueError: line 3: 13 fields, the header has 12", {}),
    "BLANKLINES": (["\n\n" + csv_text("", row(0), "", "   ", row(1)) + "\n"],
                   "DONE", None, {"trades": [7, 7]}),
    "QUOTED": ([csv_text(row(0, open='"2.5"', trades='"9"'))],
               "DONE", None, {"open": [2.5], "trades": [9]}),
    "CRLF": ([csv_text(row(0), row(1)).replace("\n", "\r\n")], "DONE", None, {"trades": [7, 7]}),
    "BOM": (["﻿" + csv_text(row(0))], "DONE", None, {"trades": [7]}),
}


@pytest.fixture(scope="module")
def outcome(spark, tmp_path_factory):
    root, prefix = tmp_path_factory.mktemp("archive"), str(tmp_path_factory.mktemp("lake"))
    for symbol, (members, *_) in EDGE_FILES.items():
        write_archive(root, symbol, *members)
    archive_file(root, "NOTAZIP").write_bytes(b"no zip at all")
    archive_file(root, "LATIN").write_bytes(
        zip_bytes(csv_text(row(0, open="é")).encode("latin-1"))
    )
    manifest = ingest(
        spark, source="klines", symbols=[*EDGE_FILES, "NOTAZIP", "LATIN", "ABSENT"],
        interval="1m", start="2024-01-02", end="2024-01-02", root=str(root), prefix=prefix,
        retries=1,
    )
    stored = {}
    for r in read_lake(spark, prefix, "klines").orderBy("open_time").collect():
        stored.setdefault(r["symbol"], []).append(r)
    return {r["symbol"]: r for r in manifest.collect()}, stored


def zip_bytes(content):
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("member.csv", content)
    return body.getvalue()


@pytest.mark.parametrize("symbol", EDGE_FILES)
def test_edge_file(outcome, symbol):
    manifest, stored = outcome
    _, status, error, columns = EDGE_FILES[symbol]
    assert (manifest[symbol]["status"], manifest[symbol]["error"]) == (status, error)
    if not columns:
        assert symbol not in stored
    for column, values in columns.items():
        assert [r[column] for r in stored[symbol]] == values


def test_absent_and_damaged_archives(outcome):
    manifest, stored = outcome
    assert manifest["ABSENT"]["status"] == "SKIP"
    assert manifest["NOTAZIP"]["status"] == "ERROR"
    assert "BadZipFile" in manifest["NOTAZIP"]["error"]
    assert "UnicodeDecodeError" in manifest["LATIN"]["error"]
    assert not {"ABSENT", "NOTAZIP", "LATIN"} & set(stored)


def test_manifest_names_the_folder_only_when_there_are_files(outcome):
    manifest, stored = outcome
    for symbol, r in manifest.items():
        assert (r["path"] is not None) == (symbol in stored)
        assert r["path"] is None or list(Path(r["path"]).glob("*.parquet"))
    path = manifest["HEADERED"]["path"]
    assert path.endswith("klines/symbol=HEADERED/interval=1m/date=2024-01-02")
    assert manifest["SEVEN"]["path"] is None and manifest["ONLYSENTINEL"]["path"] is None
    assert manifest["DUPS"]["n_rows"] == 4


def test_rows_before_a_failure_do_not_get_through(spark, tmp_path):
    """The failure comes after batches have been handed on; the day must still go whole."""
    rows = [row(i) for i in range(BATCH_ROWS * 2)]
    write_archive(tmp_path, "LATE", csv_text(*rows, row(0) + ",1"))
    prefix = str(tmp_path / "lake")
    manifest = ingest(
        spark, source="klines", symbols=["LATE"], interval="1m", start="2024-01-02",
        end="2024-01-02", root=str(tmp_path), prefix=prefix, retries=1,
    )
    assert [r["status"] for r in manifest.collect()] == ["ERROR"]
    assert not (tmp_path / "lake" / "klines" / "symbol=LATE").exists()


def test_source_format(spark, tmp_path):
    write_archive(tmp_path, "A", csv_text(row(0), row(1)))
    write_archive(tmp_path, "B", csv_text(row(0)), date="2024-01-04")
    register(spark)
    scanned = (
        spark.read.format("candle_archive")
        .option("root", str(tmp_path)).option("source", "klines").option("symbols", "A, B")
        .option("interval", "1m").option("start", "2024-01-01").option("end", "2024-01-04")
        .option("daysPerTask", "3").load()
    )
    statuses = scanned.where(F.col("status").isNotNull()).groupBy("symbol", "status").count()
    assert {tuple(r) for r in statuses.collect()} == {
        ("A", "FETCHED", 1), ("A", "ABSENT", 3), ("B", "FETCHED", 1), ("B", "ABSENT", 3)
    }
    rows = scanned.where(F.col("row_pos").isNotNull()).orderBy("symbol", "row_pos").collect()
    assert [(r["symbol"], r["date"], r["row_pos"], r["n_fields"]) for r in rows] == [
        ("A", "2024-01-02", 0, 12), ("A", "2024-01-02", 1, 12), ("B", "2024-01-04", 0, 12)
    ]


def test_source_format_with_reversed_dates_is_empty(spark, tmp_path):
    register(spark)
    options = {"root": str(tmp_path), "source": "klines", "symbols": "A", "interval": "1m",
               "start": "2024-01-02", "end": "2024-01-01"}
    assert ArchiveReader(options).partitions() == []
    assert spark.read.format("candle_archive").options(**options).load().count() == 0


def fetched_days(spark, root, condition, **options):
    """Days the source looks for under ``condition``, and the rows of its status."""
    register(spark)
    asked = {"root": str(root), "source": "klines", "symbols": "A,B,C", "interval": "1m", "retries": "1",
             "start": "2024-01-01", "end": "2024-01-10", "daysPerTask": "4", **options}
    scanned = spark.read.format("candle_archive").options(**asked).load().where(condition)
    days = scanned.where("status is not null").select("symbol", "date", "status").collect()
    return sorted((r["symbol"], r["date"]) for r in days), scanned


@pytest.mark.parametrize(
    "condition, symbols, dates",
    [
        ("symbol = 'B'", "B", range(1, 11)),
        ("symbol in ('A', 'C') and date >= '2024-01-08'", "AC", range(8, 11)),
        ("date > '2024-01-03' and date <= '2024-01-05' and interval = '1m'", "ABC", range(4, 6)),
        ("symbol <> 'A' and date < '2024-01-02'", "BC", [1]),
        ("date like '%-05' and symbol like 'A%'", "A", [5]),
        ("date like '%01-1%'", "ABC", [10]),
        ("date is null", "", []),
        ("symbol <=> 'C' and source = 'klines'", "C", range(1, 11)),
        ("interval = '1h'", "", []),
        ("source = 'other'", "", []),
        ("not (symbol in ('A', 'B')) and date in ('2024-01-03', '2024-01-07')", "C", [3, 7]),
        ("(symbol = 'A' and date = '2024-01-02') or (symbol = 'B' and date = '2024-01-03')", None, None),
        ("upper(symbol) = 'A' and date = '2024-01-04'", None, None),
    ],
)
def test_conditions_on_days_prune_what_is_fetched(spark, tmp_path, condition, symbols, dates):
    """Each looked-for archive lies there as a broken file and its look is an ERROR row."""
    for symbol in "ABC":
        for d in range(1, 11):
            archive_file(tmp_path, symbol, date=f"2024-01-{d:02}").write_bytes(b"no zip")
    got, scanned = fetched_days(spark, tmp_path, condition)
    everything, _ = fetched_days(spark, tmp_path, "true")
    assert len(everything) == 30
    grid = spark.createDataFrame(everything, "symbol string, date string")
    grid = grid.withColumns({"interval": F.lit("1m"), "source": F.lit("klines")})
    assert got == sorted((r["symbol"], r["date"]) for r in grid.where(condition).collect())
    if symbols is not None:
        assert got == sorted((s, f"2024-01-{d:02}") for s in symbols for d in dates)
        # the source itself gives no more than these: nothing else was looked for
        plan = scanned._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Filter .*(symbol|date)#", plan)
        assert scanned.rdd.getNumPartitions() <= max(1, len(symbols) * -(-len(dates) // 4))


def test_fetches_are_counted_under_pushed_conditions(tmp_path, monkeypatch):
    """The reader as a task has it, with its opening of archives counted."""
    opened = []
    monkeypatch.setattr(archive, "open_archive", lambda url, **_: opened.append(url))
    options = {"root": "r", "source": "k", "symbols": "A,B,C", "interval": "1m", "start": "2024-01-01",
               "end": "2024-12-31"}

    def fetches(*filters):
        opened.clear()
        reader = ArchiveReader(options)
        left = list(reader.pushFilters(list(filters)))
        for span in reader.partitions():
            list(reader.read(span))
        return len(opened), left

    other = ds.EqualTo(("open_time",), "5")
    typed = ds.GreaterThan(("date",), 5)
    nested = ds.EqualTo(("date", "x"), "2024-01-01")
    assert fetches() == (3 * 366, [])
    assert fetches(ds.EqualTo(("symbol",), "B"), other) == (366, [other])
    assert fetches(ds.StringEndsWith(("date",), "-01"), typed, nested) == (36, [typed, nested])
    assert fetches(ds.Not(ds.In(("symbol",), ("A", "B"))), ds.LessThan(("date",), "2024-01-03")) == (2, [])
    assert fetches(ds.Not(other)) == (3 * 366, [ds.Not(other)])
    assert fetches(ds.EqualTo(("interval",), "5m")) == (0, [])


HEADERLESS = {
    "PLAIN": ("\n".join([row(0), row(1)]) + "\n", 2, 1),
    "ONEROW": (row(0), 1, 0),
    "HEADED": (csv_text(row(0), row(1)), 2, 2),
    "BLANKFIRST": ("\n\n" + row(0) + "\n" + row(1) + "\n", 2, 1),
    "UNEVEN": ("\n".join([row(0), row(1, width=11), row(2)]), 3, 2),
    "HEADEDUNEVEN": (csv_text(row(0), row(1, width=11), row(2)), 3, 3),
    "QUOTEDFIRST": ('"%s",%s' % tuple(row(0).split(",", 1)) + "\n" + row(1), 2, 1),
    "NOTIMEFIRST": (row(0, open_time=T0).replace(str(T0) + ",", ",", 1) + "\n" + row(1), 2, 1),
}


def test_a_first_line_of_numbers_stays_where_headers_are_detected(spark, tmp_path):
    for name, (text, *_) in HEADERLESS.items():
        write_archive(tmp_path / "zips", name, text)
        folder = tmp_path / "csv" / f"symbol={name}" / "interval=1m" / "date=2024-01-02"
        folder.mkdir(parents=True)
        (folder / "a.csv").write_text(text)
    register(spark)
    grid = spark.createDataFrame([(n,) for n in HEADERLESS], "symbol string").withColumns(
        {"interval": F.lit("1m"), "date": F.lit("2024-01-02"), "source": F.lit("klines")}
    )
    zips, options = str(tmp_path / "zips"), {"source": "klines", "interval": "1m", "symbols": ",".join(HEADERLESS)}
    for detect in (False, True):
        lanes = {
            "grid": scan_archives(grid, zips, detect_header=detect, retries=1),
            "format": spark.read.format("candle_archive").options(root=zips, retries="1", **options)
            .options(start="2024-01-02", end="2024-01-02", detectHeader=str(detect).lower()).load(),
            "landed": scan_landed_zips(spark, zips, detect_header=detect),
            "csv": read_landed_csv(spark, str(tmp_path / "csv"), "klines", detect_header=detect),
        }
        seen = {}
        for lane, raw in lanes.items():
            rows = raw.where("row_pos is not null").orderBy("symbol", "row_pos").collect()
            seen[lane] = [(r["symbol"], r["open_time"], r["trades"]) for r in rows]
            counts = {n: sum(r["symbol"] == n for r in rows) for n in HEADERLESS}
            wanted = {n: kept if detect else lost for n, (_, kept, lost) in HEADERLESS.items()}
            assert counts == wanted, lane
        # the CSV lane reads an empty first field as a missing value, like the other
        blank = [[tuple(v or None for v in r) for r in rows] for rows in seen.values()]
        assert all(rows == blank[0] for rows in blank)


def test_detected_headers_through_the_whole_job(spark, tmp_path):
    write_archive(tmp_path, "A", row(0) + "\n" + row(1) + "\n")
    found = []
    for detect in (False, True):
        prefix = str(tmp_path / f"lake-{detect}")
        manifest = ingest(
            spark, source="klines", symbols=["A"], interval="1m", start="2024-01-02", end="2024-01-02",
            root=str(tmp_path), prefix=prefix, detect_header=detect,
        )
        found.append((manifest.first()["n_rows"], read_lake(spark, prefix, "klines").count()))
    assert found == [(1, 1), (2, 2)]


def test_plain_archives_without_interval(spark, tmp_path):
    write_archive(tmp_path, "A", csv_text(row(0)), interval=None)
    prefix = str(tmp_path / "lake")
    manifest = ingest(
        spark, source="klines", symbols=["A"], interval=None, start="2024-01-02",
        end="2024-01-02", root=str(tmp_path), prefix=prefix,
    )
    assert [(r["interval"], r["status"]) for r in manifest.collect()] == [("None", "DONE")]
    assert (tmp_path / "lake/klines/symbol=A/interval=None/date=2024-01-02").is_dir()


def test_landed_zips_read_like_fetched_ones(spark, tmp_path):
    write_archive(tmp_path, "A", csv_text(row(1), row(0)))
    write_archive(tmp_path, "B-C", csv_text(row(0)), interval=None)
    archive_file(tmp_path, "D").write_bytes(b"no zip")
    landed = scan_landed_zips(spark, str(tmp_path))
    grid = spark.createDataFrame(
        [("A", "1m"), ("B-C", "None"), ("D", "1m")], "symbol string, interval string"
    ).withColumns({"date": F.lit("2024-01-02"), "source": F.lit("klines")})
    fetched = scan_archives(grid, str(tmp_path), retries=1)
    assert landed.exceptAll(fetched).count() == fetched.exceptAll(landed).count() == 0
    assert landed.count() == 2 + 1 + 1 + 1 + 1  # rows and statuses
    assert "content" not in landed._jdf.queryExecution().executedPlan().toString()


def test_landed_zip_without_a_date_is_an_error(spark, tmp_path):
    (tmp_path / "k" / "A" / "1m").mkdir(parents=True)
    (tmp_path / "k" / "A" / "1m" / "A-1m.zip").write_bytes(b"x")
    rows = scan_landed_zips(spark, str(tmp_path)).collect()
    assert [r["status"] for r in rows] == ["ERROR"] and "no date" in rows[0]["error"]


def test_landed_csv_of_several_tasks_keeps_the_first(spark, tmp_path):
    """Positions rise through a file that many tasks read, so the first of each time stays."""
    folder = tmp_path / "symbol=A" / "interval=1m" / "date=2024-01-02"
    folder.mkdir(parents=True)
    rows = [row(i % 500, close=i) for i in range(5000)]
    (folder / "a.csv").write_text(csv_text(*rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = read_landed_csv(spark, str(tmp_path), "klines")
        assert raw.rdd.getNumPartitions() > 3
        closes = [r["close"] for r in raw.orderBy("row_pos").collect()]
        kept = sorted(r["close"] for r in normalize(raw).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert closes == [str(i) for i in range(5000)]
    assert kept == [float(i) for i in range(500)]


def test_landed_csv_row_too_wide_fails_its_day(spark, tmp_path):
    folder = tmp_path / "symbol=A" / "interval=1m" / "date=2024-01-02"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text(csv_text(row(0), row(1) + ",9"))
    assert normalize(read_landed_csv(spark, str(tmp_path), "klines")).count() == 0


def test_number_of_tasks_follows_the_grid_up_to_a_bound(monkeypatch):
    tasks = archive.scan_tasks
    assert tasks(1, 2) == 8 and tasks(3200, 2) == 100 and tasks(10**9, 2) == archive.MAX_TASKS
    assert tasks(10**9, 10_000) == 40_000
    monkeypatch.setattr(archive, "MAX_TASKS", 10)
    options = {"root": "r", "source": "k", "symbols": "A,B,C", "start": "2020-01-01", "end": "2024-12-31"}
    reader = ArchiveReader(options)
    spans = reader.partitions()
    assert len(spans) <= 12
    days = [(s.symbol, d) for s in spans for d in reader.dates[s.first : s.first + s.n_days]]
    assert len(days) == len(set(days)) == 3 * 1827


def test_landing_is_never_overwritten_and_scratch_goes(spark, tmp_path):
    write_archive(tmp_path, "A", csv_text(row(0)))
    job = dict(source="klines", symbols=["A"], interval="1m", start="2024-01-02", end="2024-01-02",
               root=str(tmp_path), prefix=str(tmp_path / "lake"))
    scratch = Path(shared_path(spark, "x")).parent
    before = {p.name for p in scratch.glob("tallow-ingest-*")}
    assert ingest(spark, **job, landing=str(tmp_path / "landing")).first()["status"] == "DONE"
    assert list((tmp_path / "landing").glob("*.parquet"))
    with pytest.raises(Exception, match="already exists"):
        ingest(spark, **job, landing=str(tmp_path / "landing"))
    assert ingest(spark, **job).first()["status"] == "DONE"
    left = {p.name for p in scratch.glob("tallow-ingest-*")} - before
    assert len(left) <= 1  # that of the run that was refused


def test_blocks_equal_a_plain_csv_reading():
    """Both parsers, and the switch between them, against the csv module on a large member."""
    rows = [row(i, open=f"{i}.25") for i in range(60_000)]
    for i in (45_000, 59_999):
        rows[i] = row(i, width=9)
    text = csv_text(*rows)
    found = []
    for width, columns in candle_rows(io.BytesIO(zip_bytes(text.encode()))):
        assert width == 12
        found += zip(*(c.to_pylist() for c in columns))
    wanted = [tuple(r + [None] * (12 - len(r))) for r in csv_module.reader(io.StringIO(text))][1:]
    assert found == wanted


def test_output_columns(spark, outcome):
    _, stored = outcome
    assert stored["HEADERED"][0].asDict().keys() == {*OUTPUT_COLUMNS, "symbol", "interval", "date"}
