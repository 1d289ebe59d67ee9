"""Numbering the rows of long tracks in ranges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sampleloom.operators import tables


@pytest.mark.parametrize("few", [0, 200_000])
def test_ranges_number_like_one_window(spark, monkeypatch, few):
    """Long and short tracks, ties in the first column, nulls there, a null track, and a column named as one inside."""
    monkeypatch.setattr(tables, "BROADCAST_RANGES", few)
    df = spark.range(20_000).select(
        F.when(F.col("id") % 50 == 7, F.col("id") % 3).when(F.col("id") % 997 == 0, F.lit(None)).otherwise(F.lit(9)).alias("k"), F.when(F.col("id") % 333 != 0, F.pmod(F.xxhash64("id"), F.lit(700))).alias("at"), F.col("id").alias("then"), F.rand(3).alias("v"), F.lit(1).alias("cuts"),
    )
    df = spark.createDataFrame(df.collect(), df.schema)
    key = lambda x: sorted(((r.track_id is None, r.track_id or 0), r.channel, r.frame, r.value) for r in x.collect())
    got = tables.frames_from_long_rows(df, "k", ["at", "then"], "v", range_rows=1000)
    assert key(got) == key(tables.frames_from_rows(df, "k", ["at", "then"], "v"))


def test_one_long_track_is_many_windows(spark):
    df = spark.range(50_000).select(F.lit(1).alias("k"), F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(1 << 30))).alias("at"), "id")
    got = tables.frames_from_long_rows(df, "k", ["at", "id"], F.col("id").cast("double"), range_rows=4000)
    rows = got.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n")).collect()
    assert got.agg(F.count_distinct("frame"), F.max("frame")).head()[:] == (50_000, 49_999)
    assert "__range" in got._jdf.queryExecution().executedPlan().toString() and sum(r.n for r in rows) == 50_000


def test_short_tracks_and_none(spark):
    df = spark.createDataFrame([(1, 2, 0.5), (1, 1, 0.25)], "k long, at long, v double")
    assert [(r.frame, r.value) for r in tables.frames_from_long_rows(df, "k", ["at"], "v").orderBy("frame").collect()] == [(0, 0.25), (1, 0.5)]
    assert tables.frames_from_long_rows(df.filter("false"), "k", ["at"], "v").count() == 0


def test_tasks_grow_with_rows(spark, sf, monkeypatch):
    """Each task orders about so many rows; the frames, and what further passes over a track give, are the same."""
    from sampleloom.jobs import registry, signals
    from tests.oracle import compare, connect

    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = signals.read(spark, sf, "lineitem")
    assert tables.tasks_of(rows) is None and tables.tasks_of(rows, rows.count() // few) in (None, few + 1)
    monkeypatch.setattr(tables, "ROWS_A_TASK", 300)
    assert tables.tasks_of(rows) == -(-rows.count() // 300) > few
    assert registry.QUERIES["w1_param_segments"](spark, sf).rdd.getNumPartitions() == tables.tasks_of(rows)
    compare(registry.QUERIES["w1_param_segments"](spark, sf), connect(sf), registry.ORACLES["w1_param_segments"])
