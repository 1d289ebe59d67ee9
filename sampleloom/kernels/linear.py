"""Linear filters as state-space systems, for the exact block scan.

s' = A s + B x, y = C s + D x. A run over a block from state s0 is the run from state zero plus
what s0 alone puts out, so blocks can be filtered apart and joined afterwards.

Coefficients: first order by the bilinear transform; second order after Bristow-Johnson, Audio EQ Cookbook.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: Samples that one matrix product covers.
BLOCK = 64
_APART = abs(np.arange(BLOCK)[:, None] - np.arange(BLOCK))


@dataclass(frozen=True)
class Filter:
    b: tuple[float, ...]
    a: tuple[float, ...]  # without the leading 1

    @property
    def order(self) -> int:
        return len(self.a)

    @cached_property
    def system(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Transposed direct form II."""
        n = self.order
        a_ = np.zeros((n, n))
        a_[:, 0] = -np.array(self.a)
        a_[:-1, 1:] += np.eye(n - 1)
        b_ = np.array(self.b[1:]) - np.array(self.a) * self.b[0]
        c_ = np.zeros(n)
        c_[0] = 1.0
        return a_, b_, c_, self.b[0]

    @cached_property
    def _blocks(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        return {}

    def block(self, n: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(T, O, G, P) with y = T x + O s and s' = P[m] s + G x over m samples, n at least; over fewer, their first rows and last columns. Filters that are
        retuned every few samples make them for so many."""
        if (made := next((m for size, m in self._blocks.items() if size >= n), None)) is not None:
            return made
        size = min(BLOCK, 1 << max(0, n - 1).bit_length())
        a, b, c, d = self.system
        p = np.empty((size + 1, self.order, self.order))
        p[0] = np.eye(self.order)
        for i in range(size):
            p[i + 1] = a @ p[i]
        o = c @ p[:size]
        impulse = np.concatenate(([d], o[: size - 1] @ b))
        made = self._blocks[size] = np.tril(impulse[_APART[:size, :size]]), o, (p[size - 1 :: -1] @ b).T, p
        return made

    def run(self, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """x (..., n) from state (..., order) -> y, the state after it."""
        lead, n = x.shape[:-1], x.shape[-1]
        s = np.zeros((*lead, self.order)) if state is None else np.array(state, float)
        y = np.empty(x.shape)
        t, o, g, p = self.block(min(n, BLOCK))
        for i in range(0, n, BLOCK):
            part = x[..., i : i + BLOCK]
            m = part.shape[-1]
            y[..., i : i + m] = part @ t[:m, :m].T + s @ o[:m].T
            s = s @ p[m].T + part @ g[:, g.shape[1] - m :].T
        return y, s

    def power(self, n: int) -> np.ndarray:
        """What n samples without input make of a state."""
        return np.linalg.matrix_power(self.system[0], n)

    def ring(self, state: np.ndarray, n: int) -> np.ndarray:
        """What a state alone puts out over n samples."""
        return self.run(np.zeros(n), state)[0]


def _warp(cutoff: float, rate: float) -> float:
    if cutoff <= 0:
        raise ValueError("the cutoff has to be greater than 0")
    return math.tan(math.pi * cutoff / rate)


def lowpass(rate: float, cutoff_frequency_hz: float = 50.0) -> Filter:
    n = _warp(cutoff_frequency_hz, rate)
    return Filter((n / (n + 1), n / (n + 1)), ((n - 1) / (n + 1),))


def highpass(rate: float, cutoff_frequency_hz: float = 50.0) -> Filter:
    n = _warp(cutoff_frequency_hz, rate)
    return Filter((1 / (n + 1), -1 / (n + 1)), ((n - 1) / (n + 1),))


def _cookbook(rate: float, cutoff: float, gain_db: float, q: float) -> tuple[float, float, float]:
    """A, cos w and alpha; the cutoff is kept between 0.01 Hz and 100 Hz under half the rate."""
    if cutoff <= 0 or q <= 0:
        raise ValueError("cutoff and q have to be greater than 0")
    w = 2 * math.pi * min(max(cutoff, 0.01), rate / 2 - 100) / rate
    return 10 ** (gain_db / 40), math.cos(w), math.sin(w) / (2 * q)


def _normal(b: tuple, a: tuple) -> Filter:
    return Filter(tuple(x / a[0] for x in b), tuple(x / a[0] for x in a[1:]))


def high_shelf(rate: float, cutoff_frequency_hz: float = 440.0, gain_db: float = 0.0, q: float = 0.7071067690849304) -> Filter:
    A, c, al = _cookbook(rate, cutoff_frequency_hz, gain_db, q)
    r = 2 * math.sqrt(A) * al
    return _normal((A * ((A + 1) + (A - 1) * c + r), -2 * A * ((A - 1) + (A + 1) * c), A * ((A + 1) + (A - 1) * c - r)), ((A + 1) - (A - 1) * c + r, 2 * ((A - 1) - (A + 1) * c), (A + 1) - (A - 1) * c - r))


def low_shelf(rate: float, cutoff_frequency_hz: float = 440.0, gain_db: float = 0.0, q: float = 0.7071067690849304) -> Filter:
    A, c, al = _cookbook(rate, cutoff_frequency_hz, gain_db, q)
    r = 2 * math.sqrt(A) * al
    return _normal((A * ((A + 1) - (A - 1) * c + r), 2 * A * ((A - 1) - (A + 1) * c), A * ((A + 1) - (A - 1) * c - r)), ((A + 1) + (A - 1) * c + r, -2 * ((A - 1) + (A + 1) * c), (A + 1) + (A - 1) * c - r))


def peak(rate: float, cutoff_frequency_hz: float = 440.0, gain_db: float = 0.0, q: float = 0.7071067690849304) -> Filter:
    A, c, al = _cookbook(rate, cutoff_frequency_hz, gain_db, q)
    return _normal((1 + al * A, -2 * c, 1 - al * A), (1 + al / A, -2 * c, 1 - al / A))
