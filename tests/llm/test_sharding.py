"""Joins of the sharding whose sides may be large."""

from sumi.llm import sharding
from sumi.llm.base import join_checked


def test_sides_over_the_limit_are_not_broadcast(spark):
    left, right = spark.range(10), spark.range(10).selectExpr("id", "id * 2 AS b")
    plan = lambda limit: join_checked(left, right, "id", limit=limit)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(9) and "BroadcastHashJoin" in plan(10)


def test_directories_are_joined_by_a_shuffle_alike(spark, docs, odd, monkeypatch):
    for frame in (docs, odd):
        want = sharding.shards(frame, 2_000)
        monkeypatch.setattr(sharding, "DIRECTORY_ROWS", 1)
        got = sharding.shards(frame, 2_000)
        monkeypatch.undo()
        assert got.exceptAll(want).count() == 0 and got.count() == want.count() == frame.count()
