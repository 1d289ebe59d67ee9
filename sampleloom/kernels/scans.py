"""Recurrences in time without a loop over samples: many stretches of a signal advance together, and what a stretch makes of any state composes.

* The branching envelope: with |x| = v, e' = v + attack (e - v) above e and v + release (e - v) below. One step is the greater of two
  increasing lines of e (the lesser, if attack is slower than release), so any stretch is a convex (concave) piecewise-linear function of the state
  before it, the greatest (least) of its tangents. A tangent near the true state is as good as the function.
* The swept all-pass chain: linear with coefficients that depend on the frame, so any stretch is an affine map of the seven values before it.
"""

from __future__ import annotations

import math

import numpy as np

#: So few rows are chained one by one, in plain numbers, and cut into shorter stretches: as many frames as this times the root of a row's.
FEW, TIMES = 4, 0.5
#: States that differ by less than this, as a share of the peak, count as equal.
CLOSE = 1e-13


def _stretch(n: int, times: float = 1.5) -> int:
    """Frames that lanes advance one by one; their number is about n / this."""
    return n if n < 64 else min(512, max(16, int(math.sqrt(n) * times)))


def _sweep(v: np.ndarray, e: np.ndarray, attack: float, release: float) -> np.ndarray:
    """v (steps, ...) from states e (...): the states after each step."""
    out, up, best = np.empty_like(v), v * (1 - attack), np.maximum if attack <= release else np.minimum
    down, e, other = v * (1 - release), e.copy(), np.empty_like(e)
    for t in range(len(v)):
        np.multiply(e, attack, out=other)
        other += up[t]
        e *= release
        e += down[t]
        best(e, other, out=e)
        out[t] = e
    return out


def _slopes(v: np.ndarray, start: np.ndarray, out: np.ndarray, attack: float, release: float) -> np.ndarray:
    """What a small change of the start becomes, given the states after each step."""
    rising = (v > np.concatenate((start[None], out[:-1]))).sum(axis=0)
    return attack**rising * release ** (len(v) - rising)


def _chained(e: float, tangents: list[tuple[list[float], list[float]]], greatest: bool) -> list[float]:
    """One row's states before each stretch."""
    out, best = [], max if greatest else min
    lines = list(zip(*(zip(a, b, strict=True) for a, b in tangents), strict=True))
    for own in lines:
        out.append(e)
        e = best([a * e + b for a, b in own])
    return out


def follow(v: np.ndarray, e: np.ndarray, attack: float, release: float) -> tuple[np.ndarray, np.ndarray]:
    """The envelopes of v (rows, frames) from the states e (rows,), and the slope of each last value in its e.

    A row is cut into stretches that advance side by side from guessed states. Each gives a tangent of its stretch's function; chaining the tangents
    gives better states (Newton's method for increasing convex functions), until the chain gives the states that the stretches began with. At least
    one more stretch is right each time, and mostly all are after three.
    """
    rows, n = v.shape
    if not n:
        return v.copy(), np.ones(rows)
    steps = _stretch(n, TIMES if rows <= FEW else 1.5)
    lanes, best = n // steps, np.maximum if attack <= release else np.minimum
    z = np.ascontiguousarray(v[:, : lanes * steps].reshape(rows, lanes, steps).transpose(2, 0, 1))
    starts = np.zeros((rows, lanes))
    starts[:, 0] = e
    starts[:, 1:] = z.max(axis=0)[:, :-1]
    near = CLOSE * max(1e-300, float(v.max(initial=0)), float(np.abs(e).max(initial=0)))
    tangents: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(lanes + 1):
        out = _sweep(z, starts, attack, release)
        slope = _slopes(z, starts, out, attack, release)
        tangents.append((slope, out[-1] - slope * starts))
        chained = np.empty_like(starts)
        chained[:, 0] = e
        if rows <= FEW:
            for r in range(rows):
                chained[r] = _chained(float(e[r]), [(a[r].tolist(), b[r].tolist()) for a, b in tangents], attack <= release)
        for k in range(lanes - 1 if rows > FEW else 0):
            at = chained[:, k]
            reached = tangents[0][0][:, k] * at + tangents[0][1][:, k]
            for a, b in tangents[1:]:
                best(reached, a[:, k] * at + b[:, k], out=reached)
            chained[:, k + 1] = reached
        if np.abs(chained - starts).max() <= near:
            break
        starts = chained
    result = np.empty_like(v)
    result[:, : lanes * steps] = out.transpose(1, 2, 0).reshape(rows, -1)
    whole = slope.prod(axis=1)
    if lanes * steps < n:
        rest = np.ascontiguousarray(v[:, lanes * steps :].T)
        last = _sweep(rest, result[:, lanes * steps - 1], attack, release)
        whole = whole * _slopes(rest, result[:, lanes * steps - 1], last, attack, release)
        result[:, lanes * steps :] = last.T
    return result, whole


def tangent(v: np.ndarray, e: np.ndarray, attack: float, release: float) -> np.ndarray:
    """For each row of v (rows, frames) the line (slope, value at zero) that touches, at e, what the row makes of the state before it."""
    out, slope = follow(v, e, attack, release)
    ends = out[:, -1] if v.shape[1] else e
    return np.stack([slope, ends - slope * e], axis=1)


#: Values that a swept chain of six all-passes carries: each stage's last output, after the chain's own input.
ALLPASS = 7


def swept(x: np.ndarray, coefficient: np.ndarray, feedback: float, state: np.ndarray, transition: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Six first-order all-passes with a coefficient a frame, y = c in + in' - c y', the first fed with x + feedback * the last output before.

    x (channels, frames), state (channels, 7): the outputs, the state after, and, if asked for, the matrix that a state is multiplied by (what it adds is the
    state after zero). Stretches advance side by side, each for the seven unit states and for x from zero; then their maps are chained.
    """
    channels, n = x.shape
    out, at, whole = np.empty_like(x), state.copy(), np.eye(ALLPASS)
    steps = _stretch(n)
    parts = [(0, n // steps * steps), (n // steps * steps, n)] if n else []
    for low, high in parts:
        if low == high:
            continue
        length = steps if low == 0 else high - low
        lanes = (high - low) // length
        z = np.zeros((length, lanes, ALLPASS + channels))
        z[:, :, ALLPASS:] = x[:, low:high].reshape(channels, lanes, length).transpose(2, 1, 0)
        c = coefficient[low:high].reshape(lanes, length).T[:, :, None]
        v = np.zeros((ALLPASS, lanes, ALLPASS + channels))
        v[np.arange(ALLPASS), :, np.arange(ALLPASS)] = 1.0
        held = list(v)
        for t in range(length):
            new = [z[t] + feedback * held[6]]
            for before, own in zip(held, held[1:]):  # noqa: B905
                y = new[-1] - own
                y *= c[t]
                y += before
                new.append(y)
            z[t], held = new[6], new
        v = np.stack(held)
        starts = np.empty((lanes, channels, ALLPASS))
        for s in range(lanes):
            starts[s] = at
            at = at @ v[:, s, :ALLPASS].T + v[:, s, ALLPASS:].T
            if transition:
                whole = v[:, s, :ALLPASS] @ whole
        ring = np.matmul(z[:, :, :ALLPASS].transpose(1, 0, 2), starts.transpose(0, 2, 1))  # (lanes, length, channels)
        out[:, low:high] = (z[:, :, ALLPASS:].transpose(1, 0, 2) + ring).transpose(2, 0, 1).reshape(channels, -1)
    return out, at, whole
