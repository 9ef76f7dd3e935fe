"""The work grid: which days of which symbols to run."""

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.functions.paths import day_text, parse_day
from tallow.schema import DAY_KEY, NO_INTERVAL


def as_day(bound: Column | dt.date | str) -> Column:
    """A date bound as a column; text is parsed as yyyy-MM-dd."""
    if isinstance(bound, Column):
        return bound
    return parse_day(F.lit(bound)) if isinstance(bound, str) else F.lit(bound)


def with_days(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row per input row and day of start..end, both included; none if start > end.

    ``sequence`` raises on reversed bounds, hence the clamp and the filter.
    """
    days = F.explode(F.sequence(start, F.greatest(start, end)))
    return df.withColumn("day", days).where(F.col("day") <= end)


def date_spine(spark: SparkSession, start, end) -> DataFrame:
    """Days from start to end as text, one row each."""
    one = spark.range(1).select()
    return with_days(one, as_day(start), as_day(end)).select(day_text(F.col("day")).alias("date"))


def job_grid(symbols: DataFrame, source: str, interval: str | None, start, end) -> DataFrame:
    """Every symbol over the whole range, keyed by day.

    A generator on the symbols, not a join: it streams, shuffles nothing, and grows only
    with its output.
    """
    days = with_days(symbols.select("symbol"), as_day(start), as_day(end))
    return days.select(
        "symbol",
        F.lit(interval or NO_INTERVAL).alias("interval"),
        day_text(F.col("day")).alias("date"),
        F.lit(source).alias("source"),
    ).select(*DAY_KEY)
