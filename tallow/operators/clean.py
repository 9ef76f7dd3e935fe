"""From raw text rows to typed candles. Narrow projections and filters only: no shuffle."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallow.functions.coerce import (
    any_present,
    epoch_ms_in_range,
    epoch_ms_to_utc,
    may_be_java,
    na_to_null,
    to_float32,
    to_int64,
)
from tallow.schema import (
    CANDLE_COLUMNS,
    DAY_KEY,
    ERROR,
    FLOAT_COLUMNS,
    INT_COLUMNS,
    NO_INTERVAL,
    NO_TIME,
    OUTPUT_COLUMNS,
)


def na_tokens_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: na_to_null(c) for c in columns})


def drop_all_null_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows in which every source column, truncated ones included, is missing."""
    return df.where(any_present(columns))


def positional_project(df: DataFrame, keep: list[str]) -> DataFrame:
    """First 11 source columns, renamed by position; ``keep`` is carried along."""
    source = [c for c in df.columns if c not in keep]
    if len(source) < len(CANDLE_COLUMNS):
        raise ValueError(f"{len(source)} columns, {len(CANDLE_COLUMNS)} needed")
    renamed = [F.col(c).alias(name) for c, name in zip(source, CANDLE_COLUMNS)]
    return df.select(*keep, *renamed)


def coerce_float32(df: DataFrame) -> DataFrame:
    suspect = may_be_java(FLOAT_COLUMNS)
    floats = {c: to_float32(c, "suspect") for c in FLOAT_COLUMNS}
    return df.withColumn("suspect", suspect).withColumns(floats).drop("suspect")


def coerce_int64(df: DataFrame) -> DataFrame:
    return df.withColumns({c: to_int64(c) for c in INT_COLUMNS})


def with_timestamp(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", epoch_ms_to_utc("open_time"))


def is_data() -> Column:
    """True for a row of a file, also for one of unknown position; false for the row that only
    carries a day's fetch status."""
    return F.col("row_pos").isNotNull() | F.col("status").isNull()


def _problem() -> Column:
    """Why a row fails its whole day; null for a sound row."""
    n_columns = len(CANDLE_COLUMNS)
    reason = F.when(F.col("status") == ERROR, F.coalesce("error", F.lit("unknown error")))
    reason = reason.when(
        F.col("n_fields") < n_columns,
        F.concat(F.col("n_fields"), F.lit(f" columns, {n_columns} needed")),
    )
    data = is_data()
    for c in INT_COLUMNS:
        reason = reason.when(data & F.col(c).isNull(), F.lit(f"{c} is not an integer"))
    outside = ~epoch_ms_in_range("open_time") & (F.col("open_time") != NO_TIME)
    return reason.when(data & outside, F.lit("open_time is out of range"))


def type_candles(raw: DataFrame) -> DataFrame:
    """Raw rows with all-missing rows dropped, columns typed and bad rows marked.

    Bad rows stay, marked by ``problem``: they decide over their day later on. Rows that
    only carry a fetch status stay as well. The timestamp is left for after the shuffle,
    being a copy of ``open_time``.
    """
    source_columns = [*CANDLE_COLUMNS, "extra"]
    keyed = raw.withColumn("interval", F.coalesce("interval", F.lit(NO_INTERVAL)))
    present = keyed.where(~is_data() | any_present(source_columns))
    typed = present.transform(coerce_float32).transform(coerce_int64)
    return typed.select(
        *DAY_KEY, "row_pos", "status", _problem().alias("problem"), *CANDLE_COLUMNS
    )


def drop_null_timestamp(df: DataFrame) -> DataFrame:
    return df.where(F.col("timestamp").isNotNull())


def reorder_columns(df: DataFrame) -> DataFrame:
    return df.select(*DAY_KEY, *OUTPUT_COLUMNS)
