import math
import random

import numpy as np
import pandas as pd
import pytest

from tallow.llm import ann, topk
from tests.llm.cases import none

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, cell string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, None, "odd", "odd") for i, v in vectors], SCHEMA)


def odd_vectors():
    random.seed(6)
    rows = [(i, [random.gauss(0, 1) for _ in range(6)]) for i in range(350)]
    rows += [(400 + i, rows[100][1]) for i in range(30)]  # equal to a query
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (600, [0.0] * 6)]
    rows += [(601, [math.inf] + [0.0] * 5), (602, []), (603, [1.0]), (None, rows[0][1]), (200, rows[3][1])]
    return rows


def clean(rows, zero):
    kept = []
    for i, v in rows:
        if i is None or v is None or len(v) != 6 or any(x is None or not math.isfinite(x) for x in v):
            continue
        if zero or any(v):
            kept.append((i, np.array(v, np.float32).astype(float)))
    return kept


def brute(rows, measure, best, k=10):
    out = []
    for n, (q, a) in enumerate(rows):
        if q % 100 == 0:
            found = [(best * measure(a, b), i) for m, (i, b) in enumerate(rows) if m != n]
            out += [(q, r + 1, i, best * s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def test_top_k_is_exact(spark):
    rows = odd_vectors()
    product = lambda a, b: int((np.floor(1024 * a) * np.floor(1024 * b)).sum())
    got = topk.top_k(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute(clean(rows, True), product, -1)


def test_top_k_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rows = odd_vectors()
    product = lambda a, b: int((np.floor(1024 * a) * np.floor(1024 * b)).sum())
    got = topk.top_k(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute(clean(rows, True), product, -1)


def test_scores_that_do_not_fit_doubles_are_exact(spark):
    random.seed(8)
    rows = [(i, [float(random.choice([-1, 1]) * (2**17 + random.randint(0, 9))) for _ in range(6)]) for i in range(120)]
    product = lambda a, b: sum(int(x) * int(y) for x, y in zip(1024 * a, 1024 * b, strict=True))
    got = topk.top_k(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute(clean(rows, True), product, -1)


def test_the_cutoff_saves_scores(monkeypatch):
    """Whole scores of the gathered entries only; lists to come are read for few."""
    whole = np.floor(1024 * spread("clusters", 2000, 64)).astype(np.int64)
    vectors = pd.DataFrame({"rid": range(2000), "vec_id": range(2000), "vector": list(whole)})
    queries = pd.DataFrame({"qid": range(0, 2000, 100), "query_id": range(0, 2000, 100), "q": list(whole[::100])})
    lists = topk._local_lists(10)(vectors, queries)
    assert len(lists) <= len(queries) * topk.LISTS * topk.GATHER * 10 < len(queries) * len(vectors) / 10
    exact = whole[::100] @ whole.T
    assert (lists["score"] == exact[lists["qid"] // 100, lists["rid"]]).all()
    highs = lists.groupby("qid")[topk._HIGHS].max().to_numpy()
    cutoff = lists.groupby("qid")["score"].nlargest(10).groupby("qid").min().to_numpy()
    lacking = (highs.sum(axis=1) - cutoff) // topk.LISTS
    asked = queries.assign(cutoff=cutoff, shares=list(highs - lacking[:, None]), highs=list(highs))
    computed, plain = [], topk._scores
    monkeypatch.setattr(topk, "_scores", lambda q, v: computed.append(q.size // q.shape[-1] * len(v)) or plain(q, v))
    found = topk._sufficient(vectors, asked)
    first, later = computed[0], sum(computed[1:])
    assert first == len(queries) * len(vectors) and later < first / 4
    for n, qid in enumerate(queries["qid"]):
        own = exact[n].copy()
        own[qid] = -(2**62)
        want = {i for i in np.flatnonzero(own >= cutoff[n])}
        assert set(found[found["qid"] == qid]["rid"]) == want and len(want) >= 10


def test_few_candidates(spark):
    rows = [(100, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]
    got = topk.top_k(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == [(100, 1, 1, 1572864), (100, 2, 2, 1572864)]
    near = ann.search(frame(spark, rows)).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(near)] == [(100, 1, 1), (100, 2, 2)]


def test_nearest_with_every_cell_passed_is_exact(spark):
    rows = odd_vectors()
    distance = lambda a, b: float(np.sqrt(((a - b) ** 2).sum()))
    got = ann.search(frame(spark, rows), share=1.0).collect()
    want = brute(clean(rows, False), distance, 1)
    assert [r[:3] for r in sorted(map(tuple, got))] == [w[:3] for w in want]
    assert np.allclose([r.score for r in sorted(got)], [w[3] for w in want], rtol=1e-12, atol=1e-12)


def test_recall_with_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 200)
    random.seed(7)
    centers = [[random.gauss(0, 1) for _ in range(16)] for _ in range(10)]
    rows = []
    for i in range(3000):
        own = centers[0] if i % 3 == 0 else centers[random.randrange(10)]
        spread = 0.01 if i % 3 == 0 else 0.3
        rows.append((i, [x + random.gauss(0, spread) for x in own]))
    got = {(r.query_id, r.vec_id) for r in ann.search(frame(spark, rows)).collect()}
    distance = lambda a, b: float(((a - b) ** 2).sum())
    clean_rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    want = {(q, i) for q, _, i, _ in brute(clean_rows, distance, 1)}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def spread(kind, n, width=16):
    rng = np.random.default_rng(9)
    if kind == "sphere":
        points = rng.normal(size=(n, width))
    else:
        points = rng.normal(size=(50, width))[rng.integers(50, size=n)] + rng.normal(0, 0.1, (n, width))
    return points / np.linalg.norm(points, axis=1)[:, None]


@pytest.mark.parametrize(("kind", "most"), [("sphere", 0.6), ("clusters", 0.1)])
def test_the_share_is_measured_and_holds_for_others(kind, most):
    """Recall of the index alone: learned from some points, searched in more."""
    points = spread(kind, 9000)
    index = ann.MultiIndex(points[:3000], 64)
    share = ann.needed_share(index, points[:3000], 10, 0.95)
    assert 0 < share < most
    cells = index.cells(points)
    counts = np.bincount(cells, minlength=len(index.first) * len(index.second))
    found, read = [], []
    for i in range(4000, 4060):
        passed = index.passed(points[i], index.walk(points[i], counts, int(share * len(points))), cells)
        distance = ((points - points[i]) ** 2).sum(axis=1)
        distance[i] = np.inf
        found.append(passed[np.argsort(distance)[:10]].mean())
        read.append(passed.mean())
    assert np.mean(found) >= 0.9 and np.mean(read) < most + 0.1


@pytest.mark.parametrize("tasks", ["4", "37"])
def test_blocks_meet_whatever_the_number_of_tasks(spark, monkeypatch, tasks):
    """Both sides of a block go to one task, also where tasks are not merged for being small."""
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 20)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 2)
    rows = odd_vectors()
    distance = lambda a, b: float(np.sqrt(((a - b) ** 2).sum()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ann.search(frame(spark, rows), share=1.0).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute(clean(rows, False), distance, 1)
    assert [r[:3] for r in sorted(map(tuple, got))] == [w[:3] for w in want]


def test_small_tables_go_the_same_way(spark):
    """Fewer than all cells are passed, and most of the nearest found all the same."""
    points = spread("sphere", 700, 8)
    index = ann.MultiIndex(points)
    share = ann.needed_share(index, points, 10, ann.RECALL)
    assert 0 < share < 0.9
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    got = {(r.query_id, r.vec_id) for r in ann.search(frame(spark, rows)).collect()}
    distance = lambda a, b: float(((a - b) ** 2).sum())
    clean_rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    want = {(q, i) for q, _, i, _ in brute(clean_rows, distance, 1)}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
    few = ann.search(frame(spark, rows[:8])).collect()
    assert sorted(r.vec_id for r in few) == list(range(1, 8))  # fewer than k others: all


def test_walk_passes_cells_in_order_of_summed_distance():
    points = np.random.default_rng(8).normal(size=(500, 8))
    index = ann.MultiIndex(points, 5)
    cells = index.cells(points)
    counts = np.bincount(cells, minlength=25)
    first = ((points[0, :4] - index.first) ** 2).sum(axis=1)
    second = ((points[0, 4:] - index.second) ** 2).sum(axis=1)
    far = first[cells // 5] + second[cells % 5]
    for enough in (1, 50, 200, 499):
        reach = index.walk(points[0], counts, enough)
        passed = index.passed(points[0], reach, cells)
        assert passed.sum() >= enough and far[passed].max() <= far[~passed].min(initial=np.inf) + 1e-9
        # one cell less would not do
        assert (far < reach - 1e-9).sum() < enough
        buckets = set(index.buckets_passed(points[0], reach))
        assert set(index.bucket(cells[passed]).tolist()) <= buckets
    assert index.walk(points[0], counts, 10**9) == float("inf")


def test_empty_tables(spark):
    empty = none(frame(spark, odd_vectors()))
    assert ann.search(empty).collect() == [] and topk.top_k(empty).collect() == []
