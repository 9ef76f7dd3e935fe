"""Hard negatives for many positives at once, by slots of scores.

An anchor's positives each open a window of scores for its negatives: from ``LOW`` to ``HIGH``
hundredths of the positive's own score. The windows overlap, so they are not searched one by one:

1. Blocks of vectors give each anchor their best rows of its own label; of these its positives
   are the first few.
2. The positives' upper limits cut the scores below them into slots that do not overlap. A block
   puts a row of another label into the one slot of its score and keeps the best ``k`` of each.
3. Slots of all blocks are merged, the best ``k`` of each again. Put in descending order, the
   window of a positive is what follows its upper limit: a suffix of at most five slots, which
   holds the best ``k`` of the whole window, as each slot in it holds its own best ``k``. The
   lower limit cuts the end.

Vectors and anchors meet in blocks of bounded size, so that neither side is sent whole to one
task, and what a block returns is at most ``k`` rows a slot. Within a block only rows of an
anchor's label are multiplied in the first pass.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallow.llm.vectors import is_query, usable
from tallow.session import stage

POSITIVES = 5
SCALE = 256
LOW, HIGH = 30, 90  # hundredths of a positive's score
VECTOR_BLOCK = 4096
LEAST_BLOCK = 256  # fewer vectors are not worth a block of their own
ANCHOR_BLOCK = 2048
_TILE = 256  # anchors whose scores are held at once


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(vectors * scale).astype(np.int64)


def _number_batches(scale: int):
    def convert(batches):
        for batch in batches:
            column = batch.column("vector")
            flat = whole_numbers(column.flatten().to_numpy(zero_copy_only=False), scale)
            rows = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
            numbers = pa.array([r.astype("<i8").tobytes() for r in rows], pa.binary())
            names = ["rid", "vec_id", "label"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), numbers], [*names, "numbers"])

    return convert


def _rows(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i8").reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, rows by rows; in doubles where these are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _best(at: np.ndarray, score: np.ndarray, ids: np.ndarray, rids: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` of the rows ``at``: highest score, then smaller id, then row."""
    if len(at) > k:
        own = score[at]
        at = at[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return at[np.lexsort((rids[at], ids[at], -score[at]))[:k]]


def _frame(found: list[tuple], names: list[str]) -> pd.DataFrame:
    columns = zip(*found, strict=True) if found else [[] for _ in names]
    return pd.DataFrame({n: np.concatenate([np.zeros(0, np.int64), *c]) for n, c in zip(names, columns, strict=True)})


_POSITIVE = ["anchor", "rid", "vec_id", "score"]
_NEGATIVE = ["anchor", "slot", "rid", "vec_id", "score"]


def _own_label(positives: int):
    def best(vectors: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        found = []
        for label, asking in anchors.groupby("label"):
            own = vectors[vectors["label"] == label]
            if not len(own):
                continue
            v, ids, rids = _rows(own["numbers"]), own["vec_id"].to_numpy(), own["rid"].to_numpy()
            for start in range(0, len(asking), _TILE):
                tile = asking.iloc[start : start + _TILE]
                scores = products(_rows(tile["numbers"]), v)
                for anchor, score in zip(tile["rid"].to_numpy(), scores, strict=True):
                    at = _best(np.flatnonzero(rids != anchor), score, ids, rids, positives)
                    found.append((np.full(len(at), anchor), rids[at], ids[at], score[at]))
        return _frame(found, _POSITIVE)

    return best


def slots_of(score: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Number of the slot of each score: the first of the ascending upper limits not below it."""
    return np.searchsorted(limits, score, side="left")


def _slots(k: int):
    def best(vectors: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(vectors) and len(anchors):
            v, labels = _rows(vectors["numbers"]), vectors["label"].to_numpy()
            ids, rids = vectors["vec_id"].to_numpy(), vectors["rid"].to_numpy()
            for start in range(0, len(anchors), _TILE):
                tile = anchors.iloc[start : start + _TILE]
                scores = products(_rows(tile["numbers"]), v)
                asked = (tile[c] for c in ("rid", "label", "uppers", "lowest"))
                for anchor, label, uppers, lowest, score in zip(*asked, scores, strict=True):
                    limits = np.unique(np.asarray(uppers, np.int64))
                    inside = np.flatnonzero((score <= limits[-1]) & (score >= lowest) & (labels != label))
                    slots = slots_of(score[inside], limits)
                    for slot in np.unique(slots):
                        at = _best(inside[slots == slot], score, ids, rids, k)
                        n = len(at)
                        found.append((np.full(n, anchor), np.full(n, limits[slot]), rids[at], ids[at], score[at]))
        return _frame(found, _NEGATIVE)

    return best


def _meet(vectors: DataFrame, anchors: DataFrame, step, names: list[str]) -> DataFrame:
    """Every block of vectors with every block of anchors, once."""
    total, asked = vectors.count(), anchors.count()
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vparts = max(1, -(-total // VECTOR_BLOCK), min(tasks, total // LEAST_BLOCK))
    aparts = max(1, -(-asked // ANCHOR_BLOCK))
    part = lambda n: F.pmod(F.xxhash64("rid"), F.lit(n)).cast("bigint")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = vectors.select("*", part(vparts).alias("vpart"), each(aparts).alias("apart"))
    right = anchors.select("*", part(aparts).alias("apart"), each(vparts).alias("vpart"))
    keys, ddl = ["vpart", "apart"], ", ".join(f"{n} bigint" for n in names)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(step, ddl)


def _first(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "rid")
    return df.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= n).drop("_nth")


def mine(
    embeddings: DataFrame,
    k: int = 10,
    positives: int = POSITIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Of (vec_id, embedding, label) a component x becomes floor(``scale`` * x); scores are inner
    products of whole numbers and must fit 56 bits. Anchors are rows whose vec_id is divisible by
    100. The positives of an anchor are the first ``positives`` other rows of its label, and the
    negatives of a positive the first ``k`` rows of other labels whose score, times 100, lies
    between ``low`` and ``high`` times the positive's, both included (0 <= low <= high). Higher
    scores come first, equal ones by smaller vec_id.

    Rows without a label or an id take no part, nor do the vectors named in ``usable``; zeros do.
    Rows are told apart, also where they are equal or share an id: each is a candidate, and an
    anchor, of its own. An anchor alone in its label, and a positive with a negative score or an
    empty window, give no rows. An empty table gives an empty result.
    """
    kept = usable(embeddings.where(F.col("label").isNotNull()), zero=True, keep=["label"])
    typed = kept.withColumn("label", F.col("label").cast("bigint"))
    numbers = typed.mapInArrow(_number_batches(scale), "rid bigint, vec_id bigint, label bigint, numbers binary")
    vectors = stage(numbers, "numbers")
    anchors = vectors.where(is_query())
    near = _first(_meet(vectors, anchors, _own_label(positives), _POSITIVE), ["anchor"], positives)
    # score * low <= 100 * negative <= score * high; div cuts towards zero, so only from 0 on
    opened = stage(
        near.where("score >= 0").select(
            "anchor", F.col("rid").alias("positive"), F.col("vec_id").alias("positive_id"),
            F.col("score").alias("positive_score"),
            F.expr(f"(score * {int(low)} + 99) div 100").alias("lower"),
            F.expr(f"(score * {int(high)}) div 100").alias("upper"),
        ).where("lower <= upper"),
        "windows",
    )
    limits = opened.groupBy("anchor").agg(
        F.collect_set("upper").alias("uppers"), F.min("lower").alias("lowest")  # as many as positives
    )
    asking = anchors.join(limits.withColumnRenamed("anchor", "rid"), "rid")
    slots = _first(_meet(vectors, stage(asking, "anchors"), _slots(k), _NEGATIVE), ["anchor", "slot"], k)
    # at most k rows of each of the anchor's slots, descending: windows are runs of it
    entry = F.struct((-F.col("score")).alias("order"), "vec_id", "rid", "score")
    merged = slots.groupBy("anchor").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    inside = F.expr("filter(entries, e -> e.score <= upper and e.score >= lower)")
    ids = anchors.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    ranked = opened.join(merged, "anchor").join(ids, "anchor").select(
        "anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(inside, 1, k)).alias("at", "e")
    )
    return ranked.select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("e.vec_id").alias("negative_id"),
        "positive_score", F.col("e.score").alias("negative_score"),
    )
