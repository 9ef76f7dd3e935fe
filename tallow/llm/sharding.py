"""A two-pass external shuffle into shards, with DataFrame functions alone.

Pass one scatters the records into buckets that fit in memory: a seeded hash of a record's
place in the input chooses its bucket, so equal ids or texts spread like all others. Each
bucket is gathered, put into a random order by Spark's ``shuffle`` (a seeded Fisher-Yates
shuffle of an array) and written once. Pass two numbers the records through all buckets and
deals them to the shards in runs, which writes whole buckets side by side. The numbers come
from what pass one wrote, so no lost executor can make counts and records disagree.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallow.session import shared_path, stage

BUCKET_BYTES = 16 << 20
FILE_BYTES = 128 << 20  # of records that a task of pass two writes, or more; it writes a file a shard
MOST_TASKS = 100_000  # that gather buckets: beyond, tasks take several, or buckets be made larger
BLOCK = 1000  # buckets whose offsets one task adds up
MAX_BROADCAST_BUCKETS = 500_000  # of 16 bytes each: 8 MB
_RECORD = "record"


def record_bytes():
    """UTF-8 bytes of the text (null: none) plus 1."""
    text = F.col(f"{_RECORD}.text").cast("string")
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def _held_bytes(docs: DataFrame):
    """About the bytes of a whole record, for the number of buckets."""
    sizes = []
    for field in docs.schema:
        value = F.col(f"{_RECORD}.`{field.name}`")
        kind = field.dataType
        if isinstance(kind, T.StringType | T.BinaryType):
            sizes.append(F.octet_length(value))
        elif isinstance(kind, T.ArrayType | T.MapType | T.StructType):
            sizes.append(F.octet_length(F.to_json(F.struct(value.alias("v")))))
        else:
            sizes.append(F.lit(8))
    return sum((F.coalesce(s, F.lit(0)).cast("bigint") for s in sizes), F.lit(1))


def scatter(docs: DataFrame, seed: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """Pass one: (bucket, place, record), each bucket in random order, and their number.

    There are as many tasks as buckets, whatever the session's number of shuffle partitions.
    """
    records = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(_RECORD))
    total = records.agg(F.sum(_held_bytes(docs))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    place = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    placed = records.withColumn("bucket", F.pmod(place, F.lit(buckets)).cast("bigint"))
    gathered = placed.repartition(min(buckets, MOST_TASKS), "bucket").groupBy("bucket").agg(F.collect_list(_RECORD).alias("all"))
    mixed = gathered.select("bucket", F.posexplode(F.shuffle("all", seed)).alias("place", _RECORD))
    return stage(mixed, "buckets"), buckets


def bucket_offsets(scattered: DataFrame) -> DataFrame:
    """(bucket, start): records in all buckets before. Two levels, so no window is long."""
    counts = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("block", F.expr(f"bucket div {BLOCK}"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return counts.join(blocks, "block").select("bucket", (F.col("base") + F.col("inner")).alias("start"))


def shard(
    docs: DataFrame,
    shards: int = 8,
    seed: int = 42,
    path: str | None = None,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Write ``docs`` as folders ``shard=0`` and on under ``path``, and return what was written.

    The result has ``record`` (the row as it came, so names cannot clash), ``slot`` (0 and on
    without a gap in each shard, in the order of the files) and ``shard``. The law is ``rows``:
    counts of shards differ by one at most. Rows are never merged, so equal rows and null ids
    keep their number; an empty table gives empty shards. Without ``path`` a fresh folder
    under the shared one is used.
    """
    spark = docs.sparkSession
    scattered, buckets = scatter(docs, seed, bucket_bytes)
    total = scattered.count()
    starts = bucket_offsets(scattered)
    if buckets <= MAX_BROADCAST_BUCKETS:
        starts = F.broadcast(starts)
    small, longer = divmod(total, shards)  # the first ``longer`` shards have one more
    at, border = F.col("at"), longer * (small + 1)
    past = (at - border) if small else F.lit(0)
    numbered = scattered.join(starts, "bucket").withColumn("at", F.col("start") + F.col("place"))
    dealt = numbered.select(
        _RECORD,
        F.when(at < border, at % (small + 1)).otherwise(past % max(small, 1)).cast("bigint").alias("slot"),
        F.when(at < border, F.floor(at / (small + 1)))
        .otherwise(longer + F.floor(past / max(small, 1)))
        .cast("int")
        .alias("shard"),
    )
    # without a shuffle: tasks that read less are joined, so small files do not multiply
    files = -(-buckets * bucket_bytes // FILE_BYTES)
    dealt = dealt.coalesce(files).sortWithinPartitions("shard", "slot")
    path = path or shared_path(spark, "shards")
    dealt.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """What is known of each record of the shards, which hold whole rows of ``docs``.

    A null text has the checksum of an empty one.
    """
    text = F.coalesce(F.col("record.text").cast("string"), F.lit(""))
    return shard(docs, shards).select(
        F.col("record.doc_id").cast("bigint").alias("doc_id"),
        record_bytes().alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
