"""Nearest neighbours with an inverted multi-index.

Vectors are cut into halves and each half is quantised on its own, so that two lists of
``CODES`` centroids make a fine grid of cells. A query walks the pairs of centroids in the
order of their summed squared distance, with a heap, until the cells passed hold enough
entries, which are then ranked by their exact distances. As the walk goes by distance, the
sum at which it stops says which cells it passed, and travels in place of their list.

The centroids are fitted on a bounded sample; every usable vector is in the index. Entries
lie in ``BUCKETS`` runs of first codes, which are cut into blocks of bounded size, as are the
queries that ask them. So a cell with a third of all vectors is many tasks, and what one
task returns is the nearest few of each query.
"""

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallow.llm.tables import smallest_by_hash
from tallow.llm.vectors import QUERY_BLOCK, VECTOR_BLOCK, is_query, matrix, usable
from tallow.session import stage

CODES = 128
BUCKETS = 16
SAMPLE = 8192
# How many of the true nearest the cells passed shall hold; the share of all entries that this
# takes is measured. It is large for vectors without structure, such as points spread over a
# sphere, whose nearest are hardly nearer than others; for clustered ones a few hundredths do.
RECALL = 0.97
PROBES = 512  # vectors of the sample that are searched for to measure it
_SEED = 4


def kmeans(points: np.ndarray, codes: int, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's rounds from a start of spread points; fewer if points are few."""
    rng = np.random.default_rng(_SEED)
    centroids = points[rng.integers(len(points))][None]
    nearest = ((points - centroids[0]) ** 2).sum(axis=1)
    while len(centroids) < codes and nearest.max() > 0:
        new = points[rng.choice(len(points), p=nearest / nearest.sum())]
        centroids = np.vstack([centroids, new])
        nearest = np.minimum(nearest, ((points - new) ** 2).sum(axis=1))
    for _ in range(rounds):
        owner = distances(points, centroids).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, points)
        counts = np.bincount(owner, minlength=len(centroids))[:, None]
        centroids = np.where(counts > 0, sums / np.maximum(counts, 1), centroids)
    return centroids


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, points by centroids."""
    cross = points @ centroids.T
    return (points**2).sum(axis=1)[:, None] - 2 * cross + (centroids**2).sum(axis=1)


class MultiIndex:
    """Centroids of both halves. A cell is first code * number of second codes + second."""

    def __init__(self, points: np.ndarray, codes: int = CODES):
        self.half = (points.shape[1] + 1) // 2
        self.first = kmeans(points[:, : self.half], codes)
        second = points[:, self.half :]
        self.second = kmeans(second, codes) if second.shape[1] else np.zeros((1, 0))

    def cells(self, points: np.ndarray) -> np.ndarray:
        a = distances(points[:, : self.half], self.first).argmin(axis=1)
        b = distances(points[:, self.half :], self.second).argmin(axis=1)
        return a * len(self.second) + b

    def halves(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of a query's halves to the centroids."""
        return (
            distances(query[None, : self.half], self.first)[0],
            distances(query[None, self.half :], self.second)[0],
        )

    def bucket(self, cell: np.ndarray) -> np.ndarray:
        return cell // len(self.second) * BUCKETS // len(self.first)

    def walk(self, query: np.ndarray, counts: np.ndarray, enough: int) -> float:
        """The summed distance within which the cells hold ``enough``, or all if there are
        no more: pairs of centroids are passed in its order."""
        da, db = self.halves(query)
        first, second = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
        held_by = counts.reshape(len(first), len(second))[np.ix_(first, second)].tolist()
        da, db = da[first].tolist(), db[second].tolist()
        # a row of pairs enters when the one before it is passed for the first time
        heap, held, reach = [(da[0] + db[0], 0, 0)], 0, 0.0
        while heap and held < enough:
            reach, i, j = heapq.heappop(heap)
            held += held_by[i][j]
            if j == 0 and i + 1 < len(da):
                heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
            if j + 1 < len(db):
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        return reach if held >= enough else float("inf")

    def passed(self, query: np.ndarray, reach: float, cells: np.ndarray) -> np.ndarray:
        da, db = self.halves(query)
        return da[cells // len(self.second)] + db[cells % len(self.second)] <= reach

    def buckets_passed(self, query: np.ndarray, reach: float) -> list[int]:
        da, db = self.halves(query)
        near = np.flatnonzero(da + db.min() <= reach)
        return np.unique(near * BUCKETS // len(self.first)).tolist()


def needed_share(index: MultiIndex, points: np.ndarray, k: int, recall: float) -> float:
    """The share of entries within whose cells ``recall`` of the ``k`` nearest of a point lie.

    Measured among ``points`` by brute force, for ``PROBES`` of them. In a larger table the
    nearest are nearer, so the share that a sample asks for is enough there.
    """
    if len(points) < 2:
        return 1.0
    cells = index.cells(points)
    first, second = cells // len(index.second), cells % len(index.second)
    shares = []
    for i in range(0, len(points), max(1, len(points) // PROBES)):
        distance = ((points - points[i]) ** 2).sum(axis=1)
        distance[i] = np.inf
        n = min(k, len(points) - 1)
        near = np.argpartition(distance, n - 1)[:n]
        da, db = index.halves(points[i])
        reach = da[first] + db[second]
        shares.append(np.searchsorted(np.sort(reach), reach[near], side="right") / len(points))
    return float(np.quantile(np.concatenate(shares), recall))


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch as rows."""
    column = batch.column("vector")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 2))


def _cell_batches(index: MultiIndex):
    def assign(batches):
        for batch in batches:
            cells = index.cells(_vectors(batch)) if batch.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.int32()), pa.array(index.bucket(cells), pa.int32())],
                [*batch.schema.names, "cell", "bucket"],
            )

    return assign


def _walk_batches(index: MultiIndex, counts: np.ndarray, enough: int):
    def walk(batches):
        for batch in batches:
            vectors = _vectors(batch) if batch.num_rows else []
            reach = [index.walk(v, counts, enough) for v in vectors]
            buckets = [index.buckets_passed(v, r) for v, r in zip(vectors, reach, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(reach, pa.float64()), pa.array(buckets, pa.list_(pa.int32()))],
                ["qid", "query_id", "q", "reach", "buckets"],
            )

    return walk


def _rank_block(index: MultiIndex, k: int):
    def rank(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(vectors) and len(queries):
            v, cells = matrix(vectors["vector"]), vectors["cell"].to_numpy()
            rids, ids = vectors["rid"].to_numpy(), vectors["vec_id"].to_numpy()
            columns = (queries["qid"], queries["query_id"], queries["reach"], matrix(queries["q"]))
            for qid, query_id, reach, q in zip(*columns, strict=True):
                at = np.flatnonzero(index.passed(q, reach, cells) & (rids != qid))
                score = np.sqrt(((v[at] - q) ** 2).sum(axis=1))
                if len(score) > k:
                    close = score <= np.partition(score, k - 1)[k - 1]
                    at, score = at[close], score[close]
                order = np.lexsort((rids[at], ids[at], score))[:k]
                found += [(qid, query_id, rids[at[o]], ids[at[o]], score[o]) for o in order]
        return pd.DataFrame(found, columns=["qid", "query_id", "rid", "vec_id", "score"])

    return rank


def _parts(df: DataFrame, size: int):
    """By bucket, in how many blocks of ``size`` its rows are cut; ``BUCKETS`` numbers."""
    parts = [1] * BUCKETS
    for r in df.groupBy("bucket").count().collect():
        parts[r["bucket"]] = -(-r["count"] // size)
    return F.element_at(F.lit(parts), F.col("bucket") + 1)


def search(
    embeddings: DataFrame, k: int = 10, recall: float = RECALL, share: float | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query.

    A query passes cells until they hold the ``share`` of all entries that is needed for
    ``recall``, as measured on the sample, or the one that is given; k + 1 entries at least, as
    the query itself is one. Tables of all sizes go the same way.

    Queries are rows whose vec_id is divisible by 100; a row is no neighbour of itself, but
    other rows of the same id are. Equal distances go to the smaller vec_id. Vectors that
    take no part are named in ``usable``; a query for which fewer than ``k`` others take part
    gets all of them, as its walk then passes every cell.
    """
    spark = embeddings.sparkSession
    vectors = usable(embeddings, zero=False)
    ids = vectors.select("rid", F.lit(0).alias("all"))
    drawn = smallest_by_hash(ids, "rid", SAMPLE, "all", _SEED).select("rid")
    sample = vectors.join(F.broadcast(drawn), "rid", "left_semi").orderBy("rid").toPandas()
    if not len(sample):
        empty = "query_id bigint, rank int, vec_id bigint, score double"
        return spark.createDataFrame([], empty)
    points = matrix(sample["vector"])
    index = MultiIndex(points)
    if share is None:
        share = needed_share(index, points, k, recall)
    cells = len(index.first) * len(index.second)
    entry = "rid bigint, vec_id bigint, vector array<double>, cell int, bucket int"
    entries = stage(vectors.mapInArrow(_cell_batches(index), entry), "entries")
    counts = np.zeros(cells, np.int64)
    for r in entries.groupBy("cell").count().collect():  # at most CODES squared rows
        counts[r["cell"]] = r["count"]
    enough = max(k + 1, int(np.ceil(share * counts.sum())))
    queries = entries.where(is_query()).select(
        F.col("rid").alias("qid"), F.col("vec_id").alias("query_id"), "vector"
    )
    # a walk is long for its few bytes, so queries are spread by count
    tasks = max(1, min(4 * spark.sparkContext.defaultParallelism, queries.count() // 8))
    walked = queries.repartition(tasks).mapInArrow(
        _walk_batches(index, counts, enough),
        "qid bigint, query_id bigint, q array<double>, reach double, buckets array<int>",
    )
    probes = stage(walked, "probes").withColumn("bucket", F.explode("buckets")).drop("buckets")
    vparts, qparts = _parts(entries, VECTOR_BLOCK), _parts(probes, QUERY_BLOCK)
    # keys have one type on both sides: equal numbers of other types may go to other tasks
    part = lambda row, n: F.pmod(F.xxhash64(row), n).cast("bigint")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1).cast("array<bigint>"))
    blocks = entries.select("*", part("rid", vparts).alias("vpart"), each(qparts).alias("qpart"))
    asks = probes.select("*", part("qid", qparts).alias("qpart"), each(vparts).alias("vpart"))
    keys = ["bucket", "vpart", "qpart"]
    near = blocks.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(
        _rank_block(index, k), "qid bigint, query_id bigint, rid bigint, vec_id bigint, score double"
    )
    order = Window.partitionBy("qid").orderBy("score", "vec_id", "rid")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
