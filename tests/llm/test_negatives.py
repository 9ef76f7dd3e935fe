import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallow.llm import negatives
from tests.llm.cases import none

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, anchor string, slot string, rid string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "odd", "odd", "odd", "odd") for i, v, label in rows], SCHEMA)


def odd_rows():
    rng = random.Random(11)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(500):
        label = rng.randrange(4)
        rows.append((i, [c + rng.gauss(0, 0.7) for c in centres[label]], label))
    rows += [(600 + i, rows[100][1], 3) for i in range(25)]  # equal to an anchor
    rows += [(650 + i, [x * 0.5 for x in rows[200][1]], 1 + i % 2) for i in range(25)]  # ties in a window
    rows += [(700, None, 1), (701, rows[0][1], None), (702, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (800, [0.0] * 6, 2)]
    rows += [(801, [math.inf] + [0.0] * 5, 1), (802, [math.nan] * 6, 1), (803, [], 1), (804, [1.0], 1)]
    rows += [(None, rows[0][1], 1), (200, rows[3][1], 2), (900, rows[5][1], 77), (1000, [-x for x in rows[7][1]], 0)]
    return rows


def brute(rows, k=10, positives=5, low=30, high=90, scale=256):
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or len(v) != 6:
            continue
        if all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, np.floor(np.array(v, np.float32).astype(float) * scale).astype(int), label))
    out = []
    for n, (anchor, a, label) in enumerate(kept):
        if anchor % 100:
            continue
        scored = sorted((-int(a @ b), i, m, other) for m, (i, b, other) in enumerate(kept) if m != n)
        for s, positive, _, _ in [x for x in scored if x[3] == label][:positives]:
            hard = [x for x in scored if x[3] != label and low * -s <= 100 * -x[0] <= high * -s]
            out += [(anchor, positive, r + 1, x[1], -s, -x[0]) for r, x in enumerate(hard[:k])]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.collect()))


def test_windows_of_all_positives(spark):
    rows = odd_rows()
    wanted = brute(rows)
    assert len({(a, p) for a, p, *_ in wanted}) > 15 and len(wanted) > 100
    assert found(negatives.mine(frame(spark, rows))) == wanted


@pytest.mark.parametrize("k, positives, low, high, scale", [(1, 1, 0, 100, 16), (3, 8, 50, 60, 1024), (40, 2, 90, 90, 4)])
def test_other_parameters_over_many_blocks(spark, monkeypatch, k, positives, low, high, scale):
    monkeypatch.setattr(negatives, "VECTOR_BLOCK", 60)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 2)
    monkeypatch.setattr(negatives, "_TILE", 1)
    rows = odd_rows()
    got = negatives.mine(frame(spark, rows), k, positives, low, high, scale)
    assert found(got) == brute(rows, k, positives, low, high, scale)


def test_products_beyond_doubles_are_exact():
    a = np.array([[2**28, 1], [3, -(2**28)]], np.int64)
    b = np.array([[2**27 + 1, 1]], np.int64)
    assert negatives.products(a, b).tolist() == [[2**28 * (2**27 + 1) + 1], [3 * (2**27 + 1) - 2**28]]
    assert negatives.products(a, b).dtype == np.int64


def test_slots_meet_at_their_upper_limits():
    limits = np.array([-3, 5, 9])
    assert negatives.slots_of(np.array([-9, -3, -2, 5, 6, 9]), limits).tolist() == [0, 0, 1, 1, 2, 2]


def test_nothing_to_mine(spark):
    df = frame(spark, odd_rows())
    wanted = "anchor_id positive_id rank negative_id positive_score negative_score".split()
    empty = negatives.mine(none(df))
    assert empty.collect() == [] and empty.columns == wanted
    assert negatives.mine(df.where("vec_id % 100 > 0")).collect() == []  # no anchors
    assert negatives.mine(df.withColumn("label", F.lit(1))).collect() == []  # no negatives
    assert negatives.mine(df.withColumn("label", F.col("vec_id").cast("int")).where("vec_id < 200")).collect() == []
    assert dict(empty.dtypes)["rank"] == "int" and dict(empty.dtypes)["negative_score"] == "bigint"
