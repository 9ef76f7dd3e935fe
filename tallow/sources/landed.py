"""Files that have landed on the lake's own file system, in any place Hadoop can read."""

from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallow.functions.coerce import na_to_null
from tallow.operators.clean import positional_project
from tallow.schema import (
    CANDLE_COLUMNS,
    DAY_KEY,
    ERROR,
    NO_INTERVAL,
    NUMBER_PATTERN,
    PARTITION_COLUMNS,
    RAW_SCHEMA,
)
from tallow.sources.archive import read_day
from tallow.sources.fetch import get_file


def _day_from_path(path: Column) -> dict[str, Column]:
    """Key of an archive from its path, whose file name tells the two layouts apart:
    .../source/symbol/interval/symbol-interval-date.zip or .../source/symbol/symbol-source-date.zip
    """
    parts = F.split(path, "/")
    name, inner, middle, outer = (F.try_element_at(parts, F.lit(-i)) for i in (1, 2, 3, 4))
    date = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})\.zip$", 1)
    plain = F.startswith(name, F.concat(inner, F.lit("-"), middle, F.lit("-")))
    return {
        "source": F.when(plain, middle).otherwise(outer),
        "symbol": F.when(plain, inner).otherwise(middle),
        "interval": F.when(plain, F.lit(NO_INTERVAL)).otherwise(inner),
        "date": date,
    }


def scan_landed_zips(spark: SparkSession, root: str, detect_header: bool = False) -> DataFrame:
    """Raw rows and statuses of all archives below ``root``.

    Spark lists the files, and tasks stream them by path, so that no archive is held whole. A
    name without a date makes an ERROR row. With ``detect_header`` a first line that holds a
    number is a row.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.zip")
        .load(root)
    )
    key = _day_from_path(F.col("path"))
    archives = files.select(*(key[c].alias(c) for c in DAY_KEY), "path")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for day in batch.to_pylist():
                path = day.pop("path")
                yield from read_day(day, lambda: _dated(day, path), detect_header)

    return archives.mapInArrow(scan, RAW_SCHEMA)


def _dated(day: dict[str, str], path: str) -> BinaryIO:
    if not day["date"]:
        raise ValueError(f"no date in the name of {path}")
    return get_file(path)


def read_landed_csv(
    spark: SparkSession, path: str, source: str, width: int = 12, detect_header: bool = False
) -> DataFrame:
    """Raw rows of plain CSV files below ``path/symbol=/interval=/date=``, as ``normalize``
    takes them.

    All columns are text, taken by position; the first line of each file is dropped, with
    ``detect_header`` only if none of its fields is a number. One column is declared past the width, so that a row with too many fields shows, as an error
    of its day.

    A row's position is its number in the file, however many tasks read it: its number in the
    block plus the rows of the blocks before.
    """
    names = [f"c{i}" for i in range(width)]
    text = [*names, "overflow", *PARTITION_COLUMNS]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in text])
    block = {"_file": "_metadata.file_path", "_block": "_metadata.file_block_start"}
    rows = spark.read.schema(schema).option("header", not detect_header).csv(path).select(
        *text,
        *(F.col(v).alias(k) for k, v in block.items()),
        F.monotonically_increasing_id().alias("_n"),
    )
    blocks = rows.groupBy(*block).agg(F.min("_n").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    rows = rows.join(blocks, list(block))
    if detect_header:
        is_number = F.exists(F.array(*names), lambda c: c.rlike(f"^{NUMBER_PATTERN}$"))
        first = (F.col("_block") == 0) & (F.col("_n") == F.col("_first"))
        rows = rows.where(~first | F.coalesce(is_number, F.lit(False)))
    too_wide = F.col("overflow").isNotNull()
    keyed = rows.select(
        *PARTITION_COLUMNS,
        F.lit(source).alias("source"),
        (F.col("_start") + F.col("_n") - F.col("_first")).alias("row_pos"),
        F.when(too_wide, ERROR).alias("status"),
        F.when(too_wide, F.lit("more fields than the header")).alias("error"),
        F.lit(width).alias("n_fields"),
        *names,
    )
    return with_candle_columns(keyed, names)


def with_candle_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Raw rows from columns of text by position; fewer than 11 are filled up with nulls."""
    n, nothing = len(CANDLE_COLUMNS), F.lit(None).cast("string")
    filled = df.withColumns({f"_none{i}": nothing for i in range(len(columns), n)})
    columns = columns + [f"_none{i}" for i in range(len(columns), n)]
    extra = F.coalesce(nothing, *(na_to_null(c) for c in columns[n:])).alias("extra")
    keep = [c for c in RAW_SCHEMA.fieldNames() if c not in [*CANDLE_COLUMNS, "extra"]]
    named = positional_project(filled.select(*columns, *keep, extra), [*keep, "extra"])
    return named.select(*RAW_SCHEMA.fieldNames())
