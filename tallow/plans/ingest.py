"""The job: archives in, candle lake and manifest out."""

from pyspark.sql import DataFrame, SparkSession

from tallow.operators.clean import type_candles
from tallow.operators.days import (
    day_stats,
    gate_days,
    run_manifest,
    shuffle_tasks,
    sound_days,
)
from tallow.operators.grid import job_grid
from tallow.plans.normalize import finish
from tallow.session import configure, remove, shared_path, stage
from tallow.sinks.lake import cluster_days, write_days
from tallow.sources.archive import scan_archives


def load_days(
    landed: DataFrame, stats: DataFrame, prefix: str, source: str, outcomes: str | None = None
) -> DataFrame:
    """Write the sound days of landed rows to the lake; per day what kept it out, or null.

    ``stats`` are stored, so Spark knows how few the failed days are. A day that succeeds
    without a row to store loses what is stored of it.
    """
    candles = finish(gate_days(landed, stats))
    clustered = cluster_days(candles, shuffle_tasks(stats))
    return write_days(clustered, prefix, source, sound_days(stats), outcomes)


def ingest(
    spark: SparkSession,
    *,
    source: str,
    symbols: list[str] | DataFrame,
    interval: str | None,
    start,
    end,
    root: str,
    prefix: str,
    landing: str | None = None,
    **fetching,
) -> DataFrame:
    """Fetch, normalise and store every symbol and day; return the outcome of each day.

    The typed rows are landed once, as the counts, the lake and the manifest all read them
    and none may fetch again. They are removed at the end, unless ``landing`` names a place
    for them, which must not exist yet. ``fetching`` takes retries, backoff, connect_timeout,
    read_timeout and detect_header. A day that cannot be stored is an ERROR in the outcome.
    """
    configure(spark)
    if isinstance(symbols, list):
        symbols = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    scratch = shared_path(spark, "ingest")
    days = job_grid(symbols, source, interval, start, end)
    grid = stage(days, "grid", f"{scratch}/grid")
    typed = type_candles(scan_archives(grid, root, **fetching))
    landed = stage(typed, "landing", landing or f"{scratch}/landing")
    stats = stage(day_stats(landed), "day-stats", f"{scratch}/stats")
    published = load_days(landed, stats, prefix, source, f"{scratch}/published")
    manifest = stage(run_manifest(grid, stats, prefix, published), "manifest")
    remove(spark, scratch)
    return manifest
