"""Effects with state whose parameters follow curves."""

from __future__ import annotations

import numpy as np
import pytest

from sampleloom.kernels import effects as fx
from sampleloom.operators import automation, tables

RATE = 4000.0
PARAMS = "track_id long, frame long, name string, value double"
CASES = {
    "reverb": (lambda: [fx.Reverb(0.6, 0.4)], {(0, "wet_level"): "a", (0, "damping"): "b"}),
    "lowpass_compressor": (lambda: [fx.LowpassFilter(300.0), fx.Compressor(-20.0, 4.0)], {(0, "cutoff_frequency_hz"): "cut", (1, "threshold_db"): "db", (1, "release_ms"): "cut"}),
    "limiter_ladder": (lambda: [fx.Limiter(-12.0), fx.LadderFilter("LPF24", 400.0)], {(0, "threshold_db"): "db", (1, "cutoff_hz"): "cut"}),
    "delay_chorus_phaser": (lambda: [fx.Delay(0.01, 0.3), fx.Chorus(3.0), fx.Phaser(2.0, 0.5, 600.0)], {(0, "mix"): "a", (1, "depth"): "b", (2, "feedback"): "a"}),
    "gain": (lambda: [fx.Gain(0.0)], {(0, "gain_db"): "db"}),
}


def stepped(effects, follow, x, points):
    """One stretch of constant parameters after the other, with state kept: what one would write as a loop."""
    from dataclasses import replace

    effects, states, out = list(effects), None, []
    cuts = sorted({0, x.shape[1], *(max(0, f) for f, _, _ in points if f < x.shape[1])})
    for a, b in zip(cuts, cuts[1:]):  # noqa: B905
        for (i, parameter), curve in follow.items():
            before = [(f, v) for f, n, v in points if n == curve and f <= a]
            if before:
                effects[i] = replace(effects[i], **{parameter: max(v for f, v in before if f == max(before)[0])})
        states = states or [e.init_state(RATE, x.shape[0]) for e in effects]
        block = x[:, a:b]
        for e, s in zip(effects, states, strict=True):
            e.retuned(RATE, s)
            block = e.process(block, s, a)
        out.append(block)
    return np.concatenate(out, axis=1)


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("n", [7, 100, 5000])
def test_curves(spark, name, n):
    make, follow = CASES[name]
    x = np.random.default_rng(1).uniform(-1, 1, (2, 700))
    points = [(-5, "a", 0.9), (0, "b", 0.1), (100, "a", 0.2), (100, "b", 0.7), (100, "b", 0.6), (333, "cut", 150.0), (333, "db", -30.0), (420, "db", -6.0), (699, "cut", 900.0), (5000, "a", 0.0), (1, "other", 9.0)]
    rows = [(1, c, k, i, x[c, i : i + n].tolist()) for c in (0, 1) for k, i in enumerate(range(0, 700, n))] + [(2, c, 0, 0, x[c, :50].tolist()) for c in (0, 1)]
    params = [(1, *p) for p in points] + [(3, 0, "a", 0.5), (1, None, "a", 0.1), (1, 8, "a", None)]
    got = automation.apply_automated(spark.createDataFrame(rows, tables.CHUNKS), make(), RATE, spark.createDataFrame(params, PARAMS), follow)
    assert got.count() == len(rows)
    frames = {(r.track_id, r.channel, r.frame): r.value for r in tables.unpack(got).collect()}
    want = stepped(make(), follow, x, points)
    assert np.allclose([[frames[1, c, i] for i in range(700)] for c in (0, 1)], want, atol=1e-10)
    plain = stepped(make(), follow, x[:, :50], [])
    assert np.allclose([[frames[2, c, i] for i in range(50)] for c in (0, 1)], plain, atol=1e-10)


def test_what_cannot_be_automated(spark):
    chunks = spark.createDataFrame([(1, 0, 0, 0, [0.0, 1.0])], tables.CHUNKS)
    params = spark.createDataFrame([(1, 1, "a", 7.0)], PARAMS)
    for effects, place in (([fx.Delay(0.01)], (0, "delay_seconds")), ([fx.LadderFilter()], (0, "mode")), ([fx.Gain()], (0, "nothing"))):
        with pytest.raises(ValueError, match="can't be automated"):
            automation.apply_automated(chunks, effects, RATE, params, {place: "a"})
    with pytest.raises(Exception, match="mix has to be between 0 and 1"):
        automation.apply_automated(chunks, [fx.Delay(0.01)], RATE, params, {(0, "mix"): "a"}).collect()


def test_one_shuffle_of_samples(spark):
    chunks = spark.createDataFrame([(1, 0, 0, 0, [0.0, 1.0])], tables.CHUNKS)
    params = spark.createDataFrame([(1, 1, "a", 0.5)], PARAMS)
    plan = automation.apply_automated(chunks, [fx.Reverb()], RATE, params, {(0, "wet_level"): "a"})._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in line and "samples" in line for line in plan.splitlines()) <= 1


def test_a_retuned_filter_makes_matrices_for_what_it_runs_over():
    """A few samples between two points of a curve; the results are those of the recursion, over any cuts."""
    from sampleloom.kernels import linear

    rng = np.random.default_rng(4)
    for own in (linear.lowpass(1000.0, 90.0), linear.peak(1000.0, 120.0, 6.0)):
        assert [own.block(n)[0].shape[0] for n in (1, 3, 10)] == [1, 4, 16] and own.block(5)[0].shape[0] == 16
        for cuts in ([10, 6, 1, 64, 65, 0, 130], [130, 3], [1, 2, 200]):
            x = rng.uniform(-1, 1, (2, sum(cuts)))
            made, state = [], None
            for low, n in zip(np.cumsum([0, *cuts]), cuts):
                y, state = own.run(x[:, low : low + n], state)
                made.append(y)
            b, a = np.array([*own.b, 0.0]), np.array([*own.a, 0.0])
            want, s = np.zeros(x.shape), np.zeros((2, len(b)))
            for i in range(x.shape[1]):
                want[:, i] = b[0] * x[:, i] + s[:, 0]
                for k in range(own.order):
                    s[:, k] = b[k + 1] * x[:, i] - a[k] * want[:, i] + s[:, k + 1]
            assert np.allclose(np.concatenate(made, axis=1), want, atol=1e-12)
