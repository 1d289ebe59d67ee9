"""Bucketed stores: boards over them neither shuffle nor sort."""

from __future__ import annotations

import numpy as np
import pytest

from sampleloom.kernels import effects as fx
from sampleloom.operators import board, tables


def steps(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange" in line for line in plan.splitlines()), sum("Sort " in line or "Sort[" in line for line in plan.splitlines())


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(6)
    return spark.createDataFrame([(t, c, k, 50 * k, rng.normal(size=50).tolist()) for t in range(30) for c in (0, 1) for k in rng.permutation(12).tolist()], tables.CHUNKS)


@pytest.mark.parametrize("by_channel,effect", [(True, lambda: fx.Compressor(-20.0, 4.0)), (False, lambda: fx.Reverb())])
def test_a_board_over_a_store(spark, chunks, tmp_path, by_channel, effect):
    name = f"store_{by_channel}".lower()
    tables.write_store(chunks, name, str(tmp_path / "store"), 5, by_channel)
    assert len(list((tmp_path / "store").glob("*.parquet"))) == 5
    spark.conf.set(tables.KNOWN_ORDER, "true")
    try:
        stored = tables.read_store(spark, name)
        assert stored.count() == chunks.count()
        made = board.apply_board(stored, [fx.Gain(3.0), effect(), fx.Clipping(-1.0)], 8000.0, stored=True)
        assert steps(made) == (0, 0)
        got = {(r.track_id, r.channel, r.chunk): r.samples for r in made.collect()}
    finally:
        spark.conf.unset(tables.KNOWN_ORDER)
    # without the setting each bucket is sorted once more, and still nothing is shuffled
    assert steps(board.apply_board(tables.read_store(spark, name), [effect()], 8000.0, stored=True))[0] == 0
    want = {(r.track_id, r.channel, r.chunk): r.samples for r in board.apply_board(chunks, [fx.Gain(3.0), effect(), fx.Clipping(-1.0)], 8000.0).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)
    spark.sql(f"DROP TABLE {name}")


def test_a_table_that_is_no_store_is_shuffled(spark, chunks):
    made = board.apply_board(chunks, [fx.Compressor(-20.0, 4.0)], 8000.0, stored=True)
    assert steps(made)[0] == 1
    want = {(r.track_id, r.channel, r.chunk): r.samples for r in board.apply_board(chunks, [fx.Compressor(-20.0, 4.0)], 8000.0).collect()}
    # in whatever order its blocks come
    got = {(r.track_id, r.channel, r.chunk): r.samples for r in made.collect()}
    assert all(np.allclose(got[k], want[k], atol=1e-12) for k in want)
