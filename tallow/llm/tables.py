"""What the operators share: tables, checked columns, bounded batches, training samples."""

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Texts are worked on in slices of about so many bytes, so that a Python worker's memory does
# not grow with the length of the documents of a batch.
SLICE_BYTES = 2_000_000


# Rows that go to Python at once. Whole documents are long: the usual 10,000 are tens of
# megabytes in each of several copies, on both sides.
BATCH_ROWS = 1000

# Values whose counts a draw of samples may hold.
COUNTED = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of documents or the like; from now on the session sends short batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, parts: int) -> Column:
    """The remainder that decides what may be learned from: crc32 of the id as text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def runs(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, rows) for runs of rows with at most ``size`` bytes of text, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > size:
            yield start, i - start
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes) - start


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[tuple]:
    """(start, texts) of the same runs.

    Only the texts of a run are made into Python's, so that a batch is not held twice.
    """
    for start, n in runs(batch, column, size):
        yield start, batch.column(column).slice(start, n).to_pylist()


def smallest_by_hash(df: DataFrame, key: str, rows: int, by: str, seed: int) -> DataFrame:
    """A bounded sample: per value of ``by`` the ``rows`` rows with the smallest seeded hash.

    Hashes far too large to be drawn are dropped where they are read (four times ``rows`` and
    1,000 are kept on average), so that what moves does not grow with the table and no value,
    however frequent, gathers its rows in one task. How large is too large follows from the
    counts of the most frequent values, ``COUNTED`` at most, which come as one constant; rows of
    others are not dropped early, and the draw is the same. Null values are left out.
    """
    near = 4 * rows + 1000
    known = df.where(F.col(by).isNotNull())
    counts = known.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_n"))
    frequent = counts.where(F.col("_n") > near).orderBy(F.desc("_n"), "_by").limit(COUNTED)
    counted = frequent.select(F.map_from_entries(F.collect_list(F.struct("_by", "_n")))).scalar()
    drawn = F.xxhash64(F.lit(seed), key)
    place = F.pmod(drawn, F.lit(1 << 32)) / F.lit(float(1 << 32))
    small = F.coalesce(place * F.element_at(counted, F.col(by)) < near, F.lit(True))
    order = Window.partitionBy(by).orderBy(place, key)
    ranked = known.where(small).withColumn("_nth", F.row_number().over(order))
    return ranked.where(F.col("_nth") <= rows).drop("_nth")
