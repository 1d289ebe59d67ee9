"""Convolution with tables of responses against the closed form."""

from __future__ import annotations

import numpy as np
import pytest

from sampleloom.operators import board, filters, responses, tables

RESPONSES = "response_id long, channel int, chunk long, start_frame long, samples array<double>, rate double"


@pytest.fixture(scope="module")
def tracks(spark):
    rng = np.random.default_rng(4)
    x = {1: rng.normal(size=(2, 900)), 2: rng.normal(size=(1, 300)), 3: rng.normal(size=(4, 64)), 4: rng.normal(size=(1, 10))}
    return x, spark.createDataFrame([(t, c, k, i, own[c, i : i + 50].tolist()) for t, own in x.items() for c in range(len(own)) for k, i in enumerate(range(0, own.shape[1], 50))], tables.CHUNKS)


@pytest.fixture(scope="module")
def irs(spark):
    rng = np.random.default_rng(5)
    x = {10: (rng.normal(size=(1, 40)), 8000.0), 11: (rng.normal(size=(2, 700)), 8000.0), 12: (rng.normal(size=(3, 30)), 8000.0), 13: (rng.normal(size=(1, 64)), 4000.0), 14: (np.zeros((1, 5)), 8000.0)}
    return x, spark.createDataFrame([(r, c, k, i, own[c, i : i + 16].tolist(), rate) for r, (own, rate) in x.items() for c in range(len(own)) for k, i in enumerate(range(0, own.shape[1], 16))], RESPONSES)


@pytest.mark.parametrize("most", [64, 1 << 18])
def test_convolution_with_chosen_responses(spark, monkeypatch, tracks, irs, most):
    """Responses longer than a range and than a track; several for a track, and none."""
    monkeypatch.setattr(board, "RANGE_FRAMES", most)
    x, chunks = tracks
    h, table = irs
    chosen = [(1, 10, 0.5), (1, 11, 1.0), (1, 12, None), (2, 11, 0.25), (2, 13, 1.0), (3, 11, 1.0), (3, 10, 0.0), (3, 14, 1.0), (2, 99, 1.0), (9, 10, 1.0), (1, 10, 0.5)]
    prepared = responses.prepare_responses(table, "rate", 8000.0)
    got = responses.convolve_with(chunks, prepared, spark.createDataFrame(chosen, "track_id long, response_id long, mix double"), mix=0.8)
    frames = {}
    for r in got.collect():
        for i, v in enumerate(r.samples):
            frames[r.track_id, r.response_id, r.channel, r.start_frame + i] = v
    want = {}
    for t, r, mix in {c for c in chosen if c[0] in x and c[1] in h}:
        ir, mix = filters.prepared_ir(h[r][0], h[r][1], 8000.0), 0.8 if mix is None else mix
        for c, own in enumerate(x[t]):
            source, taps = (x[t][0], ir[0]) if c >= 2 else (own, ir[min(c, len(ir) - 1)])
            wet = np.convolve(source, taps)[: len(own)]
            want |= {(t, r, c, i): mix * w + (1 - mix) * d for i, (w, d) in enumerate(zip(wet, own, strict=True))}
    assert frames.keys() == want.keys()
    assert max(abs(frames[k] - want[k]) for k in want) < 1e-10


def test_refusals_and_nothing(spark, tracks, irs):
    chunks, table = tracks[1], irs[1]
    with pytest.raises(ValueError, match="mix"):
        responses.convolve_with(chunks, table, table, mix=2.0)
    none = spark.createDataFrame([], "track_id long, response_id long")
    prepared = responses.prepare_responses(table, 8000.0, 8000.0)
    assert responses.convolve_with(chunks, prepared, none).count() == 0
    assert responses.prepare_responses(table.filter("false"), 8000.0, 8000.0).count() == 0
    with pytest.raises(Exception, match="needs its sample rate"):
        responses.prepare_responses(table.withColumn("rate", table["rate"] * None), "rate", 8000.0).collect()


def test_no_response_is_in_a_closure(spark, tracks, irs):
    """What the plan's Python holds doesn't grow with the responses."""
    many = spark.range(1000).selectExpr("id AS response_id", "0 AS channel", "0L AS chunk", "0L AS start_frame", "array_repeat(0.5D, 64) AS samples")
    chosen = spark.range(1, 4).selectExpr("id AS track_id", "id * 300 AS response_id")
    made = responses.convolve_with(tracks[1], responses.prepare_responses(many, 8000.0, 8000.0), chosen)
    assert made.select("response_id").distinct().count() == 3
