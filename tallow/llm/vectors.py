"""Vectors that take part in searches, and blocks of them against blocks of queries."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.session import stage

VECTOR_BLOCK = 4096
QUERY_BLOCK = 512
QUERY_EVERY = 100


def usable(embeddings: DataFrame, zero: bool, keep: list[str] | None = None) -> DataFrame:
    """(rid, vec_id, vector as doubles, what to ``keep``), written once; ``rid`` tells rows apart.

    Left out are rows without an id, vectors that are null, empty or hold null, NaN or an
    infinity, with ``zero`` false also those of zeros alone, and vectors of another length
    than most have (the shortest of the most frequent lengths).
    """
    whole = embeddings.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        *(keep or []),
    ).where(F.col("vec_id").isNotNull() & (F.size("vector") > 0))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = whole.where(~bad)
    if not zero:
        kept = kept.where(F.exists("vector", lambda x: x != 0))
    kept = stage(kept, "vectors")
    sizes = kept.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n")
    most = sizes.first()
    kept = kept.where(F.size("vector") == (most["n"] if most else 0))
    return kept.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "vector", *(keep or []))


def is_query():
    return F.col("vec_id") % QUERY_EVERY == 0


def matrix(column) -> np.ndarray:
    """The vectors of a pandas column as rows."""
    return np.array(column.tolist(), np.float64) if len(column) else np.zeros((0, 0))
