"""Time stretch and pitch shift along the time of one track, against the streamed vocoder."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleloom.kernels import vocoder
from sampleloom.operators import board, stretch, tables


def signal(n, channels=2, seed=3):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return np.stack([np.sin(t / (9.0 + 4 * c)) * np.abs(np.sin(t / 4000.0)) + 0.05 * rng.normal(size=n) for c in range(channels)])


def chunks_of(spark, tracks, n):
    rows = [(t, c, k, k * n, x[c, k * n : (k + 1) * n].tolist()) for t, x in tracks.items() for c in range(len(x)) for k in range(max(1, -(-x.shape[1] // n)))]
    return spark.createDataFrame(rows, tables.CHUNKS).repartition(3)


def arrays(df):
    """Also that blocks follow each other without a gap."""
    out: dict = {}
    for r in df.orderBy("track_id", "channel", "start_frame").collect():
        own = out.setdefault((r.track_id, r.channel), [])
        assert r.start_frame == len(own)
        own.extend(r.samples)
    return {k: np.array(v) for k, v in out.items()}


@pytest.mark.parametrize("factor,tone,n,block", [(1.5, 0.0, 700, 8), (0.7, 0.0, 5000, 16), (1023 / 1024, 0.0, 3000, 5), (1.25, 3.0, 1000, 8), (1.0, -7.0, 2000, 16), (1.0, 12.0, 777, None), (3.7, 0.0, 900, 4)])
def test_along_time_equals_the_stream(spark, monkeypatch, factor, tone, n, block):
    monkeypatch.setattr(board, "RANGE_FRAMES", 9000)
    tracks = {1: signal(40000), 2: signal(9000, 1, 5), 3: signal(300, 1, 6), 4: np.zeros((1, 2500))}
    got = arrays(stretch.stretch_along_time(chunks_of(spark, tracks, n), factor, tone, block))
    for t, x in tracks.items():
        want = vocoder.time_stretch(x, factor, tone)
        assert want.shape[1] == int(x.shape[1] / factor)
        for c in range(len(x)):
            assert len(got[t, c]) == want.shape[1] and np.abs(got[t, c] - want[c]).max() < 1e-6


def test_short_and_empty_tracks(spark):
    tracks = {1: np.zeros((1, 0)), 2: signal(1, 1), 3: signal(20, 1)}
    got = arrays(stretch.stretch_along_time(chunks_of(spark, tracks, 50), 2.0))
    assert set(got) == {(3, 0)} and len(got[3, 0]) == 10
    low = arrays(stretch.pitch_shift_along_time(chunks_of(spark, tracks, 50), -72.0))
    assert {k: len(v) for k, v in low.items() if len(v)} == {(2, 0): 1, (3, 0): 20}
    assert np.allclose(low[3, 0], vocoder.pitch_shift(tracks[3], -72.0), atol=1e-6)
    assert stretch.stretch_along_time(chunks_of(spark, tracks, 50).filter("false"), 2.0).count() == 0
    same = stretch.stretch_along_time(chunks_of(spark, tracks, 50))
    assert same.columns == ["track_id", "channel", "chunk", "start_frame", "samples"] and np.allclose(arrays(same)[3, 0], tracks[3][0])
    for bad in ((0.0, 0.0, None), (1.0, 73.0, None), (2.0, 0.0, 3)):
        with pytest.raises(ValueError):
            stretch.stretch_along_time(chunks_of(spark, tracks, 50), *bad)


def test_one_track_takes_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(board, "RANGE_FRAMES", 9000)
    df = stretch.stretch_along_time(chunks_of(spark, {1: signal(80000, 1)}, 4000), 1.5, block_grains=8)
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_phases_and_ends_go_by_a_shuffle_where_they_are_many(spark, monkeypatch):
    x = signal(20000, 1)
    want = vocoder.time_stretch(x, 1.25, 2.0)[0]
    monkeypatch.setattr(stretch, "BROADCAST_PHASES", 0)
    monkeypatch.setattr(stretch, "BROADCAST_BLOCKS", 0)
    assert np.allclose(arrays(stretch.stretch_along_time(chunks_of(spark, {1: x}, 3000), 1.25, 2.0, 8))[1, 0], want, atol=1e-6)


def test_curves_and_blocks_are_dealt_together(spark):
    """Shuffles under a union are merged by Spark each for itself, so they don't do for a pass over the union: on sf0.1 blocks came without their curves."""
    frames = tables.frames_from_rows(spark.range(0, 2000, 1, 3).withColumn("track", F.col("id") % 5), "track", ["id"], F.sin("id"))
    n = frames.groupBy("track_id").agg((F.max("frame") + 1).cast("int").alias("n"))
    curves = n.select("track_id", *[F.array_repeat(F.lit(v), F.col("n")).alias(name) for name, v in (("stretch", 0.5), ("semitones", 1.0))])
    made = board.time_stretch(tables.pack(frames, 128), curves=curves)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan[plan.index("MapInArrow") : plan.index("Union")]
    assert sorted(tuple(r) for r in made.groupBy("track_id").agg(F.sum(F.size("samples"))).collect()) == [(t, 800) for t in range(5)]


def test_short_tracks_make_small_blocks(monkeypatch):
    """What a block of grains puts out takes room for the frames that its track has, and for a few rows at a time."""
    import tracemalloc

    import pyarrow as pa

    class Rows:
        def __getattr__(self, name):
            return lambda *a: self

        def count(self):
            return 0

        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(stretch.F, "broadcast", lambda df: df)
    run = stretch._synthesized(Rows(), Rows(), 0.5, 128)
    n, many = 900, 150
    lists = lambda x: pa.array([x] * many, pa.list_(pa.float64()))
    same = lambda v, kind: pa.array([v] * many, kind)
    cols = [same(1, pa.int64()), same(0, pa.int32()), same(0, pa.int64()), same(0, pa.int64()), lists([float(n), *signal(n, 1)[0]]), lists(np.zeros(vocoder.HALF + 1))]
    batch = pa.RecordBatch.from_arrays(cols, names=list("abcdef"))
    tracemalloc.start()
    lengths = [len(x) for made in run(iter([batch])) for x in made.column(4)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lengths == [2 * n] * many and peak < 20e6
