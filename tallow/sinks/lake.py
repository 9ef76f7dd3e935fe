"""The candle lake: zstd Parquet under ``<prefix>/<source>/symbol=/interval=/date=``.

Any Hadoop file system will do as target; object stores are set up in the session
(``spark.hadoop.fs.*``), not here.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.functions.paths import lake_path
from tallow.operators.clean import with_timestamp
from tallow.schema import DAY_KEY, LAKE_SCHEMA, NO_INTERVAL, OUTPUT_COLUMNS, PARTITION_COLUMNS
from tallow.session import remove
from tallow.sinks.publish import publish_days


def cluster_days(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Bring each day together, in time order, splitting a day only where it is large.

    Ranges are cut from a sample, so a day with a third of all rows becomes many files,
    each covering its own span of time.
    """
    df = df.withColumn("interval", F.coalesce("interval", F.lit(NO_INTERVAL)))
    columns = [*PARTITION_COLUMNS, "open_time"]
    if tasks is None:
        return df.repartitionByRange(*columns)
    return df.repartitionByRange(tasks, *columns)


def stage_days(candles: DataFrame, run: str) -> None:
    """Write days below ``run``, as they will lie in the lake.

    Expects days clustered by task, as by ``cluster_days``. The sort matches the order the
    partitioned writer needs, so no second one is planned. Tasks put their files in place
    themselves (version 2 of Hadoop's committer); the usual way is one rename after another on
    the driver. Files of a task that is run again have the same names, and nobody reads the
    folder before the last task is done.
    """
    order = [*PARTITION_COLUMNS, "source", "open_time"]
    (
        candles.sortWithinPartitions(*order)
        .select(*OUTPUT_COLUMNS, *PARTITION_COLUMNS)
        .write.mode("error")
        .option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        .option("compression", "zstd")
        .partitionBy(*PARTITION_COLUMNS)
        .parquet(f"{run}/new")
    )


def write_days(
    candles: DataFrame,
    prefix: str,
    source: str,
    days: DataFrame | None = None,
    outcomes: str | None = None,
) -> DataFrame:
    """Replace the stored ``days``; leave all others alone. Per day its error, or null.

    ``days`` are (day key, empty): empty ones have no row in ``candles`` and lose what is stored
    of them. They are taken from the candles if not given, which reads these twice. A day that
    cannot be published stays as it was and does not stop the others. ``outcomes`` names the
    place for the result.
    """
    root = lake_path(prefix, source)
    run = f"{root}/_run-{uuid.uuid4().hex}"
    if days is None:
        days = candles.select(*DAY_KEY, F.lit(False).alias("empty")).distinct()
    stage_days(candles, run)
    published = publish_days(days, run, root, outcomes)
    if published.where(F.col("kept").isNotNull()).isEmpty():
        remove(candles.sparkSession, run)
    return published


def read_lake(spark: SparkSession, prefix: str, source: str) -> DataFrame:
    """Stored candles. The schema is explicit, so partition values stay text."""
    return spark.read.schema(LAKE_SCHEMA).parquet(lake_path(prefix, source))


def read_nanosecond_lake(spark: SparkSession, prefix: str, source: str) -> DataFrame:
    """Stored candles of files whose timestamps are in nanoseconds, which Spark rejects.

    They are read past the timestamp, which is a copy of ``open_time`` and rebuilt from it.
    """
    columns = [f for f in LAKE_SCHEMA.fields if f.name != "timestamp"]
    schema = type(LAKE_SCHEMA)(columns)
    stored = spark.read.schema(schema).parquet(lake_path(prefix, source))
    return with_timestamp(stored).select(*LAKE_SCHEMA.fieldNames())
