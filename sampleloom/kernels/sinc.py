"""Resampling kernels: local interpolators and Kaiser-windowed sinc, positions always from the output's number."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

PRECISION = 512
ROLLOFF = 0.99
# Kaiser beta by zero crossings.
BETAS = {8: 19.9989, 16: 8.00113, 32: 8.0001, 64: 8.00264, 128: 8.00013, 256: 8.00009}
#: For each local quality the neighbours it needs, from before to after the floor of the position.
LOCAL = {"zoh": (0, 0), "linear": (0, 1), "catmull_rom": (-1, 2), "lagrange": (-2, 2)}
#: Crossings of the legacy kernel, which has no low-pass when going down.
LEGACY = 100


def crossings(quality: str) -> int:
    """Zero crossings of a sinc quality; 0 for local ones."""
    if quality in LOCAL:
        return 0
    if quality == "windowed_sinc":
        return LEGACY
    n = int(quality.removeprefix("sinc")) if quality.startswith("sinc") and quality[4:].isdigit() else 0
    if n not in BETAS:
        raise ValueError(f"unknown quality {quality!r}")
    return n


@lru_cache(maxsize=8)
def table(n: int) -> np.ndarray:
    """Right half of the windowed sinc, PRECISION points a crossing, with two zeros behind."""
    x = np.arange(n * PRECISION + 1) / PRECISION
    beta = BETAS.get(n, 8.0)
    window = np.i0(beta * np.sqrt(1 - np.minimum(x / n, 1) ** 2)) / np.i0(beta)
    return np.concatenate((ROLLOFF * np.sinc(ROLLOFF * x) * window, [0.0, 0.0]))


def weights(quality: str, f):
    """The weight of each tap at fraction f; f is a Column or an array."""
    if quality == "zoh":
        return [f * 0.0 + 1.0]
    if quality == "linear":
        return [1.0 - f, f]
    if quality == "catmull_rom":
        return [0.5 * (-f + 2 * f * f - f * f * f), 0.5 * (2 - 5 * f * f + 3 * f * f * f), 0.5 * (f + 4 * f * f - 3 * f * f * f), 0.5 * (-f * f + f * f * f)]
    if quality == "lagrange":
        out = []
        for i in range(-2, 3):
            w = None
            for k in range(-2, 3):
                if k != i:
                    term = (f - float(k)) / float(i - k)
                    w = term if w is None else w * term
            out.append(w)
        return out
    raise ValueError(f"unknown quality {quality!r}")


class Resampler:
    """Output j of a signal x is a weighted sum of x around position(j); reach says how far."""

    def __init__(self, src: float, dst: float, quality: str = "sinc32"):
        if src <= 0 or dst <= 0:
            raise ValueError("rates have to be greater than 0")
        self.src, self.dst, self.quality, self.ratio = float(src), float(dst), quality, src / dst
        n = self.crossings = crossings(quality)
        if n:
            self.latency = 2 * n if quality != "windowed_sinc" else n
            self.before = self.after = self.latency
            self.skip = math.floor(self.latency / self.ratio + 0.5) if quality != "windowed_sinc" else 0
            self.stretch = max(self.ratio, 1.0) if quality != "windowed_sinc" else 1.0
        else:
            self.latency = self.skip = 0
            self.before, self.after = -LOCAL[quality][0], LOCAL[quality][1]

    def position(self, j: np.ndarray) -> np.ndarray:
        """Of the kept output j. Latency, skipped outputs and rounding leave a part of a sample."""
        if self.crossings and self.quality != "windowed_sinc":
            return (j + self.skip) * self.src / self.dst - self.latency
        return j * self.src / self.dst

    def length(self, n: int) -> int:
        """Outputs of n input frames once flushed."""
        if self.src == self.dst or n == 0:
            return n
        return max(0, math.floor((n + self.latency) * self.dst / self.src) - self.skip) if self.crossings and self.quality != "windowed_sinc" else math.floor(n * self.dst / self.src)

    def ready(self, n: int) -> int:
        """Outputs that n input frames are enough for."""
        if self.src == self.dst:
            return n
        j = max(0, int((n - self.after) * self.dst / self.src) - self.skip + 2)
        while j > 0 and math.floor(self.position(np.array([j - 1.0]))[0]) + self.after >= n:
            j -= 1
        return max(0, min(j, self.length(n)))

    def outputs(self, x: np.ndarray, start: int, first: int, stop: int) -> np.ndarray:
        """Outputs first .. stop - 1 from x (channels, frames), whose first frame is number start; frames outside are silence."""
        j = np.arange(first, stop, dtype=np.float64)
        if self.src == self.dst:
            return x[:, first - start : stop - start]
        if not len(j):
            return np.zeros((x.shape[0], 0))
        at = self.position(j)
        low = np.floor(at).astype(np.int64)
        f = at - low
        taps = np.arange(-self.before, self.after + 1)
        if self.crossings:
            d = np.abs(f[:, None] - taps[None, :]) / self.stretch
            spot = np.minimum(d * PRECISION, self.crossings * PRECISION + 1.0)
            i = spot.astype(np.int64)
            t = table(self.crossings)
            g = np.minimum(i + 1, len(t) - 1)
            w = (t[i] + (spot - i) * (t[g] - t[i])) / self.stretch
        else:
            w = np.stack(np.broadcast_arrays(*weights(self.quality, f)), axis=1)
        pad = np.pad(x, ((0, 0), (self.before + 1, self.after + 1)))
        index = low[:, None] + taps[None, :] - start + self.before + 1
        inside = (index >= 0) & (index < pad.shape[1])
        return np.einsum("cjt,jt->cj", pad[:, np.where(inside, index, 0)], w * inside)


class StreamResampler:
    """Constant memory: keeps only the input that later outputs need. Chunking changes no output value."""

    def __init__(self, src: float, dst: float, quality: str = "sinc32", channels: int = 1):
        self.kernel = Resampler(src, dst, quality)
        self.reset(channels)

    def reset(self, channels: int = 1) -> None:
        self.held, self.start, self.made, self.seen = np.zeros((channels, 0)), 0, 0, 0

    def process(self, x: np.ndarray | None) -> np.ndarray:
        """The outputs that can be told now; None flushes, and resets."""
        k = self.kernel
        if x is not None:
            self.held = np.concatenate((self.held, x), axis=1)
            self.seen += x.shape[1]
        stop = k.length(self.seen) if x is None else k.ready(self.seen)
        # blocks of outputs bound the weight matrix
        parts = [k.outputs(self.held, self.start, i, min(i + 4096, stop)) for i in range(self.made, stop, 4096)]
        out = np.concatenate(parts, axis=1) if parts else np.zeros((self.held.shape[0], 0))
        self.made = max(self.made, stop)
        if x is None:
            self.reset(self.held.shape[0])
            return out
        need = self.made if k.src == k.dst else int(math.floor(k.position(np.array([float(self.made)]))[0])) - k.before - 1
        drop = min(max(0, need - self.start), self.held.shape[1])
        self.held, self.start = self.held[:, drop:], self.start + drop
        return out
