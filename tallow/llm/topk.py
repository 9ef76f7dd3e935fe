"""Exact top-k by inner product with three phases and a uniform threshold.

The components are cut into ``LISTS`` runs; for a query each run is a list that ranks all
vectors by their partial score, and the score sought is the sum over lists.

1. Each block of vectors gives the best ``GATHER`` times k entries of each of its lists, and
   the highest value of each list. Only of these entries the whole scores are added up; the
   k-th largest of them is a safe cutoff for the result.
2. What the cutoff lacks from the sum of the lists' highest values, spread evenly over the
   lists, goes with the query to all blocks. An entry that lacks more in every list cannot
   reach the cutoff, so the entries that lack no more in some list are enough. The lists are
   read one after the other: who cannot reach the cutoff with the highest values of the
   lists to come is not looked up there.
3. Their remaining partial scores are added where their vectors lie, and those that reach the
   cutoff are ranked.

Vectors and queries meet in blocks of bounded size; no task sees a whole list, and what a
block returns is a few entries a query.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallow.llm.vectors import QUERY_BLOCK, VECTOR_BLOCK, is_query, usable
from tallow.session import stage

LISTS = 2
GATHER = 2
SCALE = 1024


def _whole(column) -> np.ndarray:
    rows = column.tolist()
    return np.array(rows, np.int64) if rows else np.zeros((0, 0), np.int64)


def _lists(q: np.ndarray, v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Components of queries and vectors by list; as doubles where their products are exact."""
    width = max(1, -(-q.shape[1] // LISTS))
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(v.astype(float)).max(initial=0))
    kind = np.float64 if most * width < 2**53 else np.int64
    cuts = [slice(part * width, (part + 1) * width) for part in range(LISTS)]
    return [(q[:, c].astype(kind), v[:, c].astype(kind)) for c in cuts]


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Partial scores of one list."""
    return (q @ v.T).astype(np.int64)


def _blocks(vectors: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides keyed by (vpart, qpart), every pair of blocks once."""
    vparts = max(1, -(-vectors.count() // VECTOR_BLOCK))
    qparts = max(1, -(-queries.count() // QUERY_BLOCK))
    whole = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = vectors.select(
        "*", F.pmod(F.xxhash64("rid"), F.lit(vparts)).cast("bigint").alias("vpart"),
        whole(qparts).alias("qpart"),
    )
    right = queries.select(
        "*", F.pmod(F.xxhash64("qid"), F.lit(qparts)).cast("bigint").alias("qpart"),
        whole(vparts).alias("vpart"),
    )
    return left, right


def _meet(vectors: DataFrame, queries: DataFrame, step, ddl: str) -> DataFrame:
    left, right = _blocks(vectors, queries)
    keys = ["vpart", "qpart"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(step, ddl)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    if not rows:
        return pd.DataFrame({n: pd.Series([], dtype="int64") for n in names})
    return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)})


def _local_lists(k: int):
    def local(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(vectors) and len(queries):
            q, v, rid = _whole(queries["q"]), _whole(vectors["vector"]), vectors["rid"].to_numpy()
            lists = [_scores(*part) for part in _lists(q, v)]
            for i, qid in enumerate(queries["qid"].to_numpy()):
                others = np.flatnonzero(rid != qid)
                if not len(others):
                    continue
                own = [scores[i, others] for scores in lists]
                n = min(GATHER * k, len(others))
                best = np.unique(np.concatenate([np.argpartition(-p, n - 1)[:n] for p in own]))
                highs = [np.full(len(best), p.max()) for p in own]
                whole = sum(p[best] for p in own)
                rows.append((np.full(len(best), qid), rid[others[best]], whole, *highs))
        return _frame(rows, ["qid", "rid", "score", *_HIGHS])

    return local


def _sufficient(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    rows = []
    if len(vectors) and len(queries):
        q, v, rid = _whole(queries["q"]), _whole(vectors["vector"]), vectors["rid"].to_numpy()
        vec_id = vectors["vec_id"].to_numpy()
        (first_q, first_v), *others = _lists(q, v)
        first = _scores(first_q, first_v)
        bounds = _whole(queries["shares"]), _whole(queries["highs"])
        asked = zip(queries["qid"], queries["query_id"], queries["cutoff"], *bounds, strict=True)
        for i, (qid, query_id, cutoff, shares, highs) in enumerate(asked):
            at = np.flatnonzero((first[i] >= cutoff - highs[1:].sum()) & (rid != qid))
            total = first[i, at]
            reach = total >= shares[0]
            for part, (own, all_v) in enumerate(others, 1):
                more = _scores(own[i], all_v[at])
                total, reach = total + more, reach | (more >= shares[part])
                open_yet = total >= cutoff - highs[part + 1 :].sum()
                at, total, reach = at[open_yet], total[open_yet], reach[open_yet]
            at, total = at[reach], total[reach]
            if len(at):
                n = len(at)
                rows.append((np.full(n, qid), np.full(n, query_id), rid[at], vec_id[at], total))
    return _frame(rows, ["qid", "query_id", "rid", "vec_id", "score"])


_HIGHS = [f"high{b}" for b in range(LISTS)]
_NO_CUTOFF = -(1 << 62)


def top_k(embeddings: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query.

    Components are floor(1024 * x) as whole numbers; scores must fit 62 bits. Queries are rows
    whose vec_id is divisible by 100; a row is no candidate of itself, but other rows of the
    same id are. Equal scores go to the smaller vec_id. A query with fewer than ``k``
    candidates gets all. Vectors that take no part are named in ``usable``; zeros take part.
    """
    whole = F.transform("vector", lambda x: F.floor(x * SCALE))
    vectors = stage(usable(embeddings, zero=True).withColumn("vector", whole), "numbers")
    queries = vectors.where(is_query()).select(
        F.col("rid").alias("qid"), F.col("vec_id").alias("query_id"), F.col("vector").alias("q")
    )
    ddl = "qid bigint, rid bigint, score bigint, " + ", ".join(f"{h} bigint" for h in _HIGHS)
    local = stage(_meet(vectors, queries.drop("query_id"), _local_lists(k), ddl), "lists")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "rid")
    ranked = local.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    kth = ranked.where(F.col("nth") == k).select("qid", F.col("score").alias("cutoff"))
    highs = local.groupBy("qid").agg(*[F.max(h).alias(h) for h in _HIGHS])
    # whole numbers: scores below these shares in all lists add up to less than the cutoff
    lacking = F.floor((sum(F.col(h) for h in _HIGHS) - F.col("cutoff")) / F.lit(LISTS))
    share = [F.coalesce(F.col(h) - lacking, F.lit(_NO_CUTOFF)) for h in _HIGHS]
    cut = highs.join(kth, "qid", "left").select(
        "qid", F.coalesce("cutoff", F.lit(_NO_CUTOFF)).alias("cutoff"),
        F.array(*share).alias("shares"), F.array(*_HIGHS).alias("highs")
    )
    asked = stage(queries.join(cut, "qid"), "cutoffs")
    ddl = "qid bigint, query_id bigint, rid bigint, vec_id bigint, score bigint"
    entries = _meet(vectors, asked, _sufficient, ddl)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id", "rid")
    found = entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
