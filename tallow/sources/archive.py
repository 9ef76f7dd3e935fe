"""Daily archives as a source: one zipped CSV per (source, symbol, interval, day).

Two ways in, one reader:

* ``spark.read.format("candle_archive")`` expands symbols and a date range from options;
* ``scan_archives(grid, root)`` takes the days from a DataFrame, of any size.

Each day yields its rows with their position in the file, then one status row. A day that
fails yields an ERROR row and does not stop the others.
"""

import datetime as dt
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from tallow.functions.paths import archive_path
from tallow.schema import (
    ABSENT,
    CANDLE_COLUMNS,
    DAY_KEY,
    ERROR,
    FETCHED,
    NO_INTERVAL,
    RAW_SCHEMA,
)
from tallow.sources.fetch import open_archive
from tallow.sources.member import candle_rows

# Small enough that a lost or slow task costs little; grids beyond MAX_TASKS runs of this
# length get longer runs, so that the number of tasks does not grow without end.
DAYS_PER_TASK = 32
MAX_TASKS = 10_000

_ARROW_SCHEMA = to_arrow_schema(RAW_SCHEMA)
_TEXT_COLUMNS = [*CANDLE_COLUMNS, "extra"]


def _batch(day: dict[str, str], n_rows: int, **columns) -> pa.RecordBatch:
    """A raw batch of one day; columns not given are null."""
    arrays = []
    for field in _ARROW_SCHEMA:
        value = day.get(field.name, columns.get(field.name))
        if not isinstance(value, pa.Array):
            value = pa.repeat(pa.scalar(value, field.type), n_rows)
        arrays.append(value)
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW_SCHEMA)


def read_day(
    day: dict[str, str], open_day: Callable[[], BinaryIO | None], detect_header: bool = False
) -> Iterator[pa.RecordBatch]:
    """Rows of one day, then its status. Errors become part of the data."""
    try:
        archive = open_day()
        if archive is None:
            yield _batch(day, 1, status=ABSENT)
            return
        position = 0
        with archive:
            for width, arrays in candle_rows(archive, detect_header):
                n = len(arrays[0])
                yield _batch(
                    day,
                    n,
                    row_pos=pa.array(np.arange(position, position + n)),
                    n_fields=width,
                    **dict(zip(_TEXT_COLUMNS, arrays)),
                )
                position += n
        yield _batch(day, 1, status=FETCHED)
    except Exception as error:
        yield _batch(day, 1, status=ERROR, error=f"{type(error).__name__}: {error}")


def archive_url(root: str, source: str, symbol: str, interval: str | None, date: str) -> str:
    label = interval or source
    folders = [root.rstrip("/"), source, symbol] + ([interval] if interval else [])
    return "/".join([*folders, f"{symbol}-{label}-{date}.zip"])


@dataclass
class DaySpan(InputPartition):
    """A run of the reader's days, for one symbol."""

    symbol: str
    first: int
    n_days: int


# What a filter of Spark says of a text that is never null.
_TESTS: dict[type, Callable] = {
    ds.EqualTo: lambda text, f: text == f.value,
    ds.EqualNullSafe: lambda text, f: text == f.value,
    ds.In: lambda text, f: text in f.value,
    ds.GreaterThan: lambda text, f: text > f.value,
    ds.GreaterThanOrEqual: lambda text, f: text >= f.value,
    ds.LessThan: lambda text, f: text < f.value,
    ds.LessThanOrEqual: lambda text, f: text <= f.value,
    ds.StringStartsWith: lambda text, f: text.startswith(f.value),
    ds.StringEndsWith: lambda text, f: text.endswith(f.value),
    ds.StringContains: lambda text, f: f.value in text,
    ds.IsNull: lambda text, f: False,
    ds.IsNotNull: lambda text, f: True,
}


def key_filter(f: ds.Filter) -> tuple[str, Callable[[str], bool]] | None:
    """Column of the day key and test of its text, if that is all the filter asks for.

    Python and Spark order text alike, by code points.
    """
    if isinstance(f, ds.Not):
        inner = key_filter(f.child)
        return inner and (inner[0], lambda text: not inner[1](text))
    test = _TESTS.get(type(f))
    if test is None or len(f.attribute) != 1 or f.attribute[0] not in DAY_KEY:
        return None
    value = getattr(f, "value", "")
    values = value if isinstance(value, (tuple, list)) else [value]
    if not all(isinstance(v, str) for v in values):
        return None
    return f.attribute[0], lambda text: test(text, f)


class ArchiveReader(DataSourceReader):
    """Days that conditions on the day key leave out are not fetched."""

    def __init__(self, options):
        self.root = options["root"]
        self.source = options["source"]
        self.symbols = [s.strip() for s in options["symbols"].split(",") if s.strip()]
        self.interval = options.get("interval") or None
        start, end = (dt.date.fromisoformat(options[k]) for k in ("start", "end"))
        n_days = max(0, (end - start).days + 1)
        self.dates = [(start + dt.timedelta(i)).isoformat() for i in range(n_days)]
        self.days_per_task = int(options.get("daysPerTask") or 0)
        self.detect_header = str(options.get("detectHeader", "false")).lower() == "true"
        self.fetching = {
            "retries": int(options.get("retries", 3)),
            "backoff": int(options.get("backoff", 2)),
            "connect_timeout": float(options.get("connectTimeout", 10)),
            "read_timeout": float(options.get("readTimeout", 60)),
        }

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            known = key_filter(f)
            if known is None:
                yield f
                continue
            column, passes = known
            if column == "date":
                self.dates = [d for d in self.dates if passes(d)]
            elif column == "symbol":
                self.symbols = [s for s in self.symbols if passes(s)]
            elif not passes(self.source if column == "source" else self.interval or NO_INTERVAL):
                self.symbols = []

    def partitions(self) -> list[DaySpan]:
        total = len(self.symbols) * len(self.dates)
        run = self.days_per_task or max(DAYS_PER_TASK, -(-total // MAX_TASKS))
        return [
            DaySpan(symbol, i, min(run, len(self.dates) - i))
            for symbol in self.symbols
            for i in range(0, len(self.dates), run)
        ]

    def read(self, span: DaySpan) -> Iterator[pa.RecordBatch]:
        if span is None:  # an empty grid still gets one call
            return
        for date in self.dates[span.first : span.first + span.n_days]:
            url = archive_url(self.root, self.source, span.symbol, self.interval, date)
            day = {
                "source": self.source,
                "symbol": span.symbol,
                "interval": self.interval or NO_INTERVAL,
                "date": date,
            }
            yield from read_day(
                day, lambda: open_archive(url, **self.fetching), self.detect_header
            )


class CandleArchive(DataSource):
    """Options: root, source, symbols (comma list), interval, start, end, retries, backoff,
    connectTimeout, readTimeout, daysPerTask, detectHeader (whether a first line that holds a
    number is a row; false). Conditions on symbol, interval, date and source are pushed down:
    only days that meet them are fetched."""

    @classmethod
    def name(cls) -> str:
        return "candle_archive"

    def schema(self):
        return RAW_SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CandleArchive)


def scan_tasks(days: int, cores: int) -> int:
    """Tasks for so many downloads: four a core or more, and MAX_TASKS or four a core at most."""
    return max(min(-(-days // DAYS_PER_TASK), MAX_TASKS), 4 * cores)


def scan_archives(
    grid: DataFrame, root: str, tasks: int | None = None, detect_header: bool = False, **fetching
) -> DataFrame:
    """Raw rows and statuses of the days in ``grid``. With ``detect_header`` a first line that
    holds a number is a row.

    Grid rows are tiny but each stands for a download, so they are spread by count: the
    size-based defaults would put them all into one task. They are counted first, so store a
    grid that is dear to compute.
    """
    if tasks is None:
        tasks = scan_tasks(grid.count(), grid.sparkSession.sparkContext.defaultParallelism)
    path = archive_path(root, *(F.col(c) for c in ["source", "symbol", "interval", "date"]))
    days = grid.select(*DAY_KEY, path.alias("url")).repartition(tasks, "url")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                url = row.pop("url")
                yield from read_day(row, lambda: open_archive(url, **fetching), detect_header)

    return days.mapInArrow(scan, RAW_SCHEMA)
