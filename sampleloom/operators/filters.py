"""Linear filters of the packed form by an exact block scan (operators/scan.py), and convolution.

A block is filtered once, from zero state, and what its true start state puts out by itself is added once that is known.
So one long track is filtered by many tasks. Results equal the serial filter up to rounding, whatever
the block size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from sampleloom.kernels import linear
from sampleloom.kernels.effects import Convolution, Filtered
from sampleloom.kernels.sinc import Resampler
from sampleloom.operators.board import apply_effects
from sampleloom.operators.scan import scan_effect


def filter_chunks(chunks: DataFrame, own: linear.Filter) -> DataFrame:
    return scan_effect(chunks, Filtered(own), 1.0)


def lowpass(chunks: DataFrame, rate: float, cutoff_frequency_hz: float = 50.0) -> DataFrame:
    return filter_chunks(chunks, linear.lowpass(rate, cutoff_frequency_hz))


def highpass(chunks: DataFrame, rate: float, cutoff_frequency_hz: float = 50.0) -> DataFrame:
    return filter_chunks(chunks, linear.highpass(rate, cutoff_frequency_hz))


def high_shelf(chunks: DataFrame, rate: float, **params: float) -> DataFrame:
    return filter_chunks(chunks, linear.high_shelf(rate, **params))


def low_shelf(chunks: DataFrame, rate: float, **params: float) -> DataFrame:
    return filter_chunks(chunks, linear.low_shelf(rate, **params))


def peak_filter(chunks: DataFrame, rate: float, **params: float) -> DataFrame:
    return filter_chunks(chunks, linear.peak(rate, **params))


def prepared_ir(ir: np.ndarray, ir_rate: float | None, rate: float) -> np.ndarray:
    """An impulse response at the track's rate, of at most two channels and of bounded energy."""
    if ir_rate is None:
        raise ValueError("an impulse response given as an array needs its sample rate")
    ir = np.atleast_2d(np.asarray(ir, float))[:2]
    if ir_rate != rate:
        n = max(1, int(np.floor(ir.shape[1] * rate / ir_rate + 0.5)))
        ir = Resampler(ir_rate, rate, "lagrange").outputs(ir, 0, 0, n)
    energy = float((ir * ir).sum(axis=1).max())
    return ir if energy < 1e-8 else ir * 0.125 / np.sqrt(energy)


def convolve(chunks: DataFrame, rate: float, ir: np.ndarray, ir_rate: float | None, mix: float = 1.0) -> DataFrame:
    """Overlap-save over the ordered blocks of a channel; the response is a parameter and ships with the task. Cut to the input's length."""
    own = prepared_ir(ir, ir_rate, rate)
    effect = Convolution(own, mix)
    effect.key = "track" if own.shape[0] > 1 else "channel"
    return apply_effects(chunks, [effect], rate)
