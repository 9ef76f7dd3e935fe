"""Decisions per day: the all-or-nothing gate, keep-first, skips and the manifest.

A day is the unit of failure, yet its rows must not have to meet in one task: one day may
hold a third of all rows. So a day's verdict is aggregated (one row per day out, combined
before it moves), rows of failed days are dropped by a join with the failed days alone, and
duplicates are cut before and after an exchange on (day, open_time). There is one way for
days of every size.
"""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallow.functions.paths import partition_folder
from tallow.operators.clean import is_data
from tallow.schema import ABSENT, DAY_KEY, DONE, ERROR, NO_TIME, SKIP

# Rows a task of a shuffle of all rows should get, at about 80 bytes each.
ROWS_PER_TASK = 2_000_000


def day_stats(typed: DataFrame) -> DataFrame:
    """One row per day: data rows, those with a time, first problem, absent archive."""
    timed = is_data() & (F.col("open_time") != NO_TIME)
    return typed.groupBy(*DAY_KEY).agg(
        F.count_if(is_data()).alias("n_rows"),
        F.count_if(timed).alias("n_timed"),
        F.min("problem").alias("problem"),
        F.max(F.coalesce(F.col("status") == ABSENT, F.lit(False))).alias("absent"),
    )


def gate_days(typed: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Rows of days in which every row is sound; a day with one bad row goes whole.

    Failed days are few as a rule, and Spark then sends their keys to the rows. It is left to
    choose, as nothing bounds their number. Give ``stats`` where they are stored already:
    the choice is made from their size, and ``typed`` is read once.
    """
    stats = day_stats(typed) if stats is None else stats
    failed = stats.where(F.col("problem").isNotNull()).select(*(F.col(c).alias(f"_{c}") for c in DAY_KEY))
    rows = typed.where(is_data())
    # rows without a date or symbol are a day too, so nulls are equal here
    same_day = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in DAY_KEY))
    return rows.join(failed, same_day, "left_anti").drop("status", "problem")


def shuffle_tasks(stats: DataFrame) -> int | None:
    """Tasks for a shuffle of all rows; None where the session's number is enough."""
    total = stats.agg(F.sum("n_rows")).first()[0] or 0
    wanted = -(-total // ROWS_PER_TASK)
    least = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return wanted if wanted > least else None


def dedup_keep_first(df: DataFrame) -> DataFrame:
    """First row in file order of each open_time of a day; rows without a position come last.

    The rank limit runs before the exchange too, so a heavily repeated key shrinks to one
    row per task before it moves.
    """
    same_time = Window.partitionBy(*DAY_KEY, "open_time").orderBy(F.col("row_pos").asc_nulls_last())
    ranked = df.withColumn("nth", F.row_number().over(same_time))
    return ranked.where(F.col("nth") == 1).drop("nth")


def days_without_rows(grid: DataFrame, stats: DataFrame) -> DataFrame:
    """Grid days to skip: absent, or nothing left after the all-missing rows went."""
    return grid.join(stats.where(F.col("n_rows") > 0), DAY_KEY, "left_anti")


def sound_days(stats: DataFrame) -> DataFrame:
    """Days that succeed; ``empty`` are those without a row to store, as all lack a time."""
    sound = stats.where(F.col("problem").isNull() & (F.col("n_rows") > 0))
    return sound.select(*DAY_KEY, (F.col("n_timed") == 0).alias("empty"))


def run_manifest(
    grid: DataFrame, stats: DataFrame, prefix: str = "", published: DataFrame | None = None
) -> DataFrame:
    """Outcome of every grid day: DONE, SKIP or ERROR, with rows read, reason and folder.

    ``path`` is the folder the sink wrote to; a DONE day without a row to store has none.
    ``published`` are the outcomes of the sink: a day that it could not store is an ERROR.
    """
    if published is None:
        days = grid.join(stats, DAY_KEY, "left")
    else:
        refused = published.where(F.col("error").isNotNull()).select(*DAY_KEY, "error")
        days = grid.join(stats, DAY_KEY, "left").join(refused, DAY_KEY, "left")
        days = days.withColumn("problem", F.coalesce("problem", "error"))
    n_rows = F.coalesce("n_rows", F.lit(0))
    status = (
        F.when(F.col("problem").isNotNull(), ERROR).when(n_rows == 0, SKIP).otherwise(DONE)
    )
    folder = partition_folder(prefix, *(F.col(c) for c in ["source", "symbol", "interval", "date"]))
    return days.select(
        *DAY_KEY,
        status.alias("status"),
        F.col("problem").alias("error"),
        n_rows.alias("n_rows"),
        F.when((status == DONE) & (F.col("n_timed") > 0), folder).alias("path"),
    )
