"""The composite transform: raw rows in, clean candles out."""

from pyspark.sql import DataFrame

from tallow.operators.clean import (
    drop_null_timestamp,
    reorder_columns,
    type_candles,
    with_timestamp,
)
from tallow.operators.days import dedup_keep_first, gate_days


def finish(gated: DataFrame) -> DataFrame:
    """What follows the gate: timestamps, duplicates, column order."""
    return (
        gated.transform(with_timestamp)
        .transform(drop_null_timestamp)
        .transform(dedup_keep_first)
        .transform(reorder_columns)
    )


def normalize(raw: DataFrame) -> DataFrame:
    """Clean candles of all days of ``raw``, keyed by day. No job runs before the caller's.

    ``raw`` is read twice, for the verdicts of the days and for their rows; land it before if
    that is dear, as the ingest does.
    """
    return finish(gate_days(type_candles(raw)))
