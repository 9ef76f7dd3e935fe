"""Bounded samples: what is drawn, and what the draw moves."""

import pytest
from pyspark.sql import functions as F

from tallow.llm import tables
from tests.llm.cases import none


def draw(df, rows):
    """The same by ranking all rows at the driver."""
    place = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 32))
    by = {}
    for r in df.where("kind is not null").select("id", "kind", place.alias("at")).collect():
        by.setdefault(r.kind, []).append((r["at"], r.id))
    return sorted((kind, i) for kind, own in by.items() for _, i in sorted(own)[:rows])


@pytest.mark.parametrize("counted", [10_000, 1, 0])
def test_the_smallest_hashes_are_drawn(spark, monkeypatch, counted):
    monkeypatch.setattr(tables, "COUNTED", counted)
    kind = F.expr(
        "case when id % 3 = 0 then 'hot' when id % 7 = 0 then 'warm' when id % 500 = 1 then 'rare' "
        "when id % 5 = 0 then null else concat('k', id % 4) end"
    )
    df = spark.range(40_000).withColumn("kind", kind)
    got = tables.smallest_by_hash(df, "id", 20, "kind", 5).collect()
    assert sorted((r.kind, r.id) for r in got) == draw(df, 20)
    assert tables.smallest_by_hash(none(df), "id", 20, "kind", 5).collect() == []


def test_rows_are_dropped_where_they_are_read(spark, tmp_path):
    """With broadcasting off nothing is joined: what reaches the exchange on the value is few."""
    spark.range(300_000).withColumn("kind", F.lit("hot")).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        drawn = tables.smallest_by_hash(spark.read.parquet(str(tmp_path / "t")), "id", 50, "kind", 5)
        assert drawn.count() == 50
        plan = drawn._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" not in plan
    ranked = plan[: plan.index("Exchange hashpartitioning(kind")]
    moved = plan[plan.index("Exchange hashpartitioning(kind") :]
    assert "Window [row_number()" in ranked and "ubquery" in moved and "Partial" in moved
