"""Recurrences without a loop over samples, and effects along the time of one track, against the serial recurrences."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleloom.kernels import effects as fx
from sampleloom.kernels import scans
from sampleloom.operators import board, scan, shift, tables

RATE = 8000.0


def serial(v, e, attack, release):
    out = []
    for x in v.tolist():
        e = x + (attack if x > e else release) * (e - x)
        out.append(e)
    return np.array(out)


@pytest.mark.parametrize("n", [1, 5, 63, 64, 100, 1000, 8192])
@pytest.mark.parametrize("attack,release", [(0.977, 0.9998), (0.9, 0.99), (0.0, 0.99), (0.99, 0.9), (0.5, 0.5), (0.2, 0.0), (0.9999, 1.0)])
def test_envelope_is_the_serial_one(n, attack, release):
    rng = np.random.default_rng(n)
    v, e = np.abs(rng.normal(size=(4, n)) * np.sin(np.arange(n) / 300)), np.array([0.0, 0.5, 3.0, 1e-9])
    v[3] *= 1e-6
    out, slope = scans.follow(v, e, attack, release)
    want = np.stack([serial(x, s, attack, release) for x, s in zip(v, e, strict=True)])
    assert np.abs(out - want).max() < 1e-11
    tangent = scans.tangent(v, e, attack, release)
    assert np.abs(tangent[:, 0] * e + tangent[:, 1] - want[:, -1]).max() < 1e-11
    # a tangent of a convex function lies below it, of a concave one above
    sign = 1 if attack <= release else -1
    for other in (0.0, 0.3, 2.0):
        ends = np.array([serial(x, other, attack, release)[-1] for x in v])
        assert (sign * (ends - (tangent[:, 0] * other + tangent[:, 1])) > -1e-11).all()


def test_silent_and_empty_envelopes():
    out, slope = scans.follow(np.zeros((2, 500)), np.zeros(2), 0.9, 0.99)
    assert not out.any()
    out, slope = scans.follow(np.zeros((2, 0)), np.ones(2), 0.9, 0.99)
    assert out.shape == (2, 0) and (slope == 1).all()


@pytest.mark.parametrize("n", [1, 3, 64, 130, 1000, 5000])
def test_swept_all_passes_are_the_serial_ones(n):
    rng = np.random.default_rng(n)
    x, c, state = rng.normal(size=(2, n)), 0.3 * np.sin(np.arange(n) / 100), rng.normal(size=(2, 7))
    want, after = np.empty_like(x), state.copy()
    for ch in range(2):
        v = list(state[ch])
        for i in range(n):
            new = [x[ch, i] + 0.4 * v[6]]
            for k in range(1, 7):
                new.append(c[i] * new[k - 1] + v[k - 1] - c[i] * v[k])
            v, want[ch, i] = new, new[6]
        after[ch] = v
    out, got, whole = scans.swept(x, c, 0.4, state, transition=True)
    assert np.abs(out - want).max() < 1e-10 and np.abs(got - after).max() < 1e-10
    zero = scans.swept(x, c, 0.4, np.zeros((2, 7)))[1]
    assert np.abs(zero + state @ whole.T - after).max() < 1e-10


@pytest.fixture(scope="module")
def signal(spark):
    """Two channels of one long track and a short track, in blocks of several lengths."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2, 30_000)) * np.abs(np.sin(np.arange(30_000) / 2500)) ** 3
    rows = []
    for c in (0, 1):
        at, k = 0, 0
        while at < 30_000:
            n = [1000, 1000, 700, 1, 64][k % 5]
            rows.append((1, c, k, at, x[c, at : at + n].tolist()))
            at, k = at + n, k + 1
    rows.append((2, 0, 0, 0, x[0, :10].tolist()))
    return x, spark.createDataFrame(rows, tables.CHUNKS)


EFFECTS = {
    "compressor": lambda: fx.Compressor(-20.0, 4.0, 1.0, 300.0), "slow_attack": lambda: fx.Compressor(-20.0, 4.0, 80.0, 5.0), "limiter": lambda: fx.Limiter(-12.0, 200.0), "gate": lambda: fx.NoiseGate(-20.0, 5.0),
    "phaser": lambda: fx.Phaser(2.0, 0.5, 900.0, 0.6), "lowpass": lambda: fx.LowpassFilter(300.0), "peak": lambda: fx.PeakFilter(900.0, 12.0, 3.0),
}


@pytest.mark.parametrize("name", EFFECTS)
def test_along_time_equals_the_ordered_pass(signal, name):
    x, chunks = signal
    got = scan.apply_along_time(chunks, [EFFECTS[name]()], RATE)
    assert got.count() == chunks.count()
    out = {c: np.concatenate([r.samples for r in got.filter(f"track_id = 1 and channel = {c}").orderBy("chunk").collect()]) for c in (0, 1)}
    e = EFFECTS[name]()
    want = e.process(x.copy(), e.init_state(RATE, 2), 0)
    assert max(np.abs(out[c] - want[c]).max() for c in (0, 1)) < 1e-9


def test_boards_along_time(signal):
    """Stages that are scanned, that are cut into ranges and that are columns, in turn."""
    x, chunks = signal
    own = lambda: [fx.Gain(3.0), fx.HighpassFilter(100.0), fx.Delay(0.01), [fx.Limiter(-6.0)], fx.Phaser(feedback=0.3), fx.Invert()]
    frames = lambda df: [r.value for r in tables.unpack(df).orderBy("track_id", "channel", "frame").collect()]
    assert np.allclose(frames(scan.apply_along_time(chunks, board.Board(own()), RATE)), frames(board.apply_board(chunks, board.Board(own()), RATE)), atol=1e-9)
    with pytest.raises(TypeError, match="Reverb"):
        scan.scan_effect(chunks, fx.Reverb(), RATE)


def test_no_block_waits_for_another(signal):
    """What runs over samples isn't behind an exchange of them: only the small table of states is dealt by key."""
    plan = scan.scan_effect(signal[1], fx.Compressor(-20.0, 4.0), RATE)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("feedback", [1e-25, 1e-10, 0.01, 0.6, 0.97, 0.9999, 1.0])
@pytest.mark.parametrize("d", [1, 3])
def test_feedback_delay_is_the_recurrence(spark, monkeypatch, feedback, d):
    monkeypatch.setattr(shift, "BLOCK", 16)  # blocks of blocks of blocks
    x = np.random.default_rng(1).normal(size=1500)
    rows = [(1, 0, i, None if i == 40 else float(v)) for i, v in enumerate(x)] + [(2, 1, 0, 1.0)]
    got = shift.delay(spark.createDataFrame(rows, tables.FRAMES), 1000.0, d / 1000, feedback, 0.25).orderBy("track_id", "frame").collect()
    line, want = np.zeros(1500), []
    for i, v in enumerate(x):
        late = line[i - d] if i >= d else 0.0
        line[i] = (0.0 if i == 40 else v) + feedback * late
        want.append(None if i == 40 else 0.75 * v + 0.25 * late)
    have = [r.value for r in got]
    assert have[40] is None and len(have) == 1501
    assert np.allclose([h for h in have[:1500] if h is not None], [w for w in want if w is not None], atol=1e-10, rtol=1e-12)


def test_feedback_delay_stays_in_the_jvm(spark):
    df = spark.range(100).select(F.lit(1).cast("long").alias("track_id"), F.lit(0).alias("channel"), F.col("id").alias("frame"), F.rand(1).alias("value"))
    plan = shift.delay(df, 1000.0, 0.005, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
