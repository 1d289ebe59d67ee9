"""Phase vocoder (Laroche, Dolson 1999, with phases locked to spectral peaks) for time stretch and pitch shift, as a stream of constant memory."""

from __future__ import annotations

import math

import numpy as np

from sampleloom.kernels.sinc import Resampler

WINDOW = 2048
HOP = WINDOW // 4
HALF = WINDOW // 2
#: Curves act in steps of at least this many frames.
STEP = 1024
#: Grains that are transformed at once.
GRAINS = 64
SHAPE = np.hanning(WINDOW + 1)[:-1]


def spectra(line: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the grains that stand at `index` (grains, WINDOW) in line (channels, frames), each (channels, grains, bins): angles; sizes; each bin's nearest
    peak `near`, the lower of two, itself without any; and `turn`. A grain's phases are those of the grain before at `near`, plus `turn`."""
    now = np.fft.rfft(line[:, index] * SHAPE)
    angle, size, k = np.angle(now), np.abs(now), np.arange(HALF + 1)
    bins = 2 * np.pi * k * HOP / WINDOW
    advance = angle - np.angle(np.fft.rfft(line[:, index - HOP] * SHAPE)) - bins
    advance -= 2 * np.pi * np.rint(advance / (2 * np.pi))
    around = np.pad(size, ((0, 0), (0, 0), (2, 2)))
    peak = (size >= around[..., :-4]) & (size > around[..., 1:-3]) & (size >= around[..., 3:-1]) & (size >= around[..., 4:])
    below = np.maximum.accumulate(np.where(peak, k, -WINDOW), axis=-1)
    above = np.minimum.accumulate(np.where(peak, k, 2 * WINDOW)[..., ::-1], axis=-1)[..., ::-1]
    near = np.where(peak.any(axis=-1, keepdims=True), np.where(k - below <= above - k, below, above), k)
    return angle, size, near, np.take_along_axis(bins + advance, near, -1) + angle - np.take_along_axis(angle, near, -1)


def places(grains: np.ndarray, speed: float) -> np.ndarray:
    """Where these grains are read at a constant speed: from their numbers, so that any cutting gives the same."""
    return np.rint(grains * (HOP * speed))


class Vocoder:
    """Grains every HOP output frames, each read where the speed's curve says; a grain's phases follow from those of the grain before."""

    def __init__(self, channels: int, speed: float | None = None):
        self.speed = speed  # None: by the curve
        self.line, self.first, self.seen = np.zeros((channels, HALF + HOP)), -HALF - HOP, 0
        self.time, self.next = 0.0, 0  # output time of the input so far, next grain's
        self.waiting: list[tuple[int, int]] = []
        self.sum, self.weight = np.zeros((channels, WINDOW)), np.zeros(WINDOW)
        self.phase, self.made = None, -HALF

    def process(self, x: np.ndarray, speed: np.ndarray) -> np.ndarray:
        times = np.cumsum(np.concatenate(([self.time], 1.0 / speed)))
        grains = np.arange(self.next, times[-1] + 1, HOP)
        grains = grains[grains <= times[-1]]
        if self.speed is None:
            at = np.rint(np.interp(grains, times, np.arange(self.seen, self.seen + x.shape[1] + 1))).astype(np.int64)
        else:
            at = np.minimum(places(grains // HOP, self.speed), self.seen + x.shape[1]).astype(np.int64)
        self.waiting += zip(grains.astype(np.int64).tolist(), at.tolist(), strict=True)
        self.next += HOP * len(grains)
        self.time, self.seen = float(times[-1]), self.seen + x.shape[1]
        self.line = np.concatenate((self.line, x), axis=1)
        ready = next((i for i, (_, s) in enumerate(self.waiting) if s + HALF > self.seen), len(self.waiting))
        return self._grains(ready)

    def finish(self, total: int) -> np.ndarray:
        """What is missing of `total` output frames."""
        self.line = np.pad(self.line, ((0, 0), (0, WINDOW)))
        self.waiting += [(o, self.seen) for o in range(self.next, total + WINDOW, HOP)]
        out = self._grains(len(self.waiting))
        return out[:, : max(0, out.shape[1] - (self.made - total))]

    def _grains(self, count: int) -> np.ndarray:
        out = [np.zeros((len(self.line), 0))]
        for i in range(0, count, GRAINS):
            out += self._some(np.array([s for _, s in self.waiting[i : min(i + GRAINS, count)]]))
        del self.waiting[:count]
        # the next grain reads from here on
        need = (self.waiting[0][1] if self.waiting else self.seen) - HALF - HOP
        drop = min(max(0, need - self.first), self.line.shape[1])
        self.line, self.first = self.line[:, drop:], self.first + drop
        made = np.concatenate(out, axis=1)
        skip = min(max(0, -self.made), made.shape[1])
        self.made += made.shape[1]
        return made[:, skip:]

    def _some(self, at: np.ndarray) -> list[np.ndarray]:
        angle, size, near, turn = spectra(self.line, at[:, None] - HALF - self.first + np.arange(WINDOW)[None, :])
        phases = np.empty_like(size)
        for g in range(len(at)):
            self.phase = phases[:, g] = angle[:, g] if self.phase is None else np.take_along_axis(self.phase, near[:, g], -1) + turn[:, g]
        made, out = np.fft.irfft(size * np.exp(1j * phases), WINDOW) * SHAPE, []
        for g in range(len(at)):
            self.sum += made[:, g]
            self.weight += SHAPE**2
            out.append(self.sum[:, :HOP] / np.maximum(self.weight[:HOP], 1e-6))
            self.sum = np.pad(self.sum[:, HOP:], ((0, 0), (0, HOP)))
            self.weight = np.pad(self.weight[HOP:], (0, HOP))
        return out


class _Pitch:
    """Reads what the vocoder makes at `ratio` times the speed; by sinc at one ratio, between two frames where it has a curve."""

    def __init__(self, channels: int, ratio: float | None):
        self.kernel = Resampler(ratio, 1.0, "sinc32") if ratio is not None else None
        self.line, self.first, self.made = np.zeros((channels, 0)), 0, 0
        self.place, self.time, self.at = 0.0, 0.0, np.zeros(0)

    def follow(self, factors: np.ndarray, ratios: np.ndarray) -> None:
        times = np.cumsum(np.concatenate(([self.time], 1.0 / factors)))
        places = np.cumsum(np.concatenate(([self.place], ratios / factors)))
        done = self.made + len(self.at)
        self.at = np.concatenate((self.at, np.interp(np.arange(done, max(done, math.floor(times[-1]) + 1)), times, places)))
        self.time, self.place = float(times[-1]), float(places[-1])

    def process(self, x: np.ndarray, total: int | None = None) -> np.ndarray:
        """What can be told now, or, at the end, all up to `total` frames."""
        self.line = np.concatenate((self.line, x), axis=1)
        have, k = self.first + self.line.shape[1], self.kernel
        if k is not None:
            stop = max(self.made, k.ready(have)) if total is None else total
            parts = [k.outputs(self.line, self.first, i, min(i + 4096, stop)) for i in range(self.made, stop, 4096)]
            out = np.concatenate(parts, axis=1) if parts else np.zeros((len(self.line), 0))
            self.made += out.shape[1]
            need = math.floor(k.position(np.array([float(self.made)]))[0]) - k.before - 1
        else:
            if total is None:
                at = self.at[: np.searchsorted(self.at, have - 1)]
            else:
                at = np.concatenate((self.at, np.full(max(0, total - self.made - len(self.at)), self.place)))[: total - self.made]
            low = np.floor(at).astype(np.int64)
            f, low, most = at - low, low - self.first, self.line.shape[1] - 1
            out = (1 - f) * self.line[:, np.minimum(low, most)] + f * self.line[:, np.minimum(low + 1, most)] if most >= 0 else np.zeros((len(self.line), len(at)))
            self.made, self.at = self.made + len(at), self.at[len(at) :]
            need = math.floor(self.at[0]) if len(self.at) else math.floor(self.place)
        drop = min(max(0, need - self.first), self.line.shape[1])
        self.line, self.first = self.line[:, drop:], self.first + drop
        return out


class Stretcher:
    """Streams one track. process() takes blocks (channels, frames) and, where a parameter has a curve, its values, one a frame; finish() gives the
    rest. int(n / factor) frames come out in all, with a curve int(the sum of 1 / factor). How the input is cut changes nothing but rounding."""

    def __init__(self, channels: int, stretch_factor: float = 1.0, semitones: float = 0.0, curves: bool = False):
        check(np.array([stretch_factor]), np.array([semitones]))
        self.factor, self.semitones, self.curves = float(stretch_factor), float(semitones), curves
        self.same = not curves and stretch_factor == 1 and semitones == 0
        self.vocoder = Vocoder(channels, None if curves else self.factor / 2.0 ** (self.semitones / 12))
        self.pitch = _Pitch(channels, None if curves else 2.0 ** (semitones / 12)) if curves or semitones else None
        self.seen, self.length, self.age, self.now = 0, 0.0, STEP, None

    def process(self, x: np.ndarray, factors: np.ndarray | None = None, semitones: np.ndarray | None = None) -> np.ndarray:
        n = x.shape[1]
        if self.same:
            return x
        f = np.full(n, self.factor) if factors is None else np.asarray(factors, float)
        s = np.full(n, self.semitones) if semitones is None else np.asarray(semitones, float)
        check(f, s, self.seen)
        self.seen += n
        if self.curves:
            self.length = float(np.cumsum(np.concatenate(([self.length], 1.0 / f)))[-1])
            f, s = self._steps(f, s)
        ratios = 2.0 ** (s / 12)
        long = self.vocoder.process(x, f / ratios)
        if self.pitch is None:
            return long
        if self.curves:
            self.pitch.follow(f, ratios)
        return self.pitch.process(long)

    def finish(self) -> np.ndarray:
        if self.same:
            return np.zeros((len(self.vocoder.line), 0))
        total = int(self.length) if self.curves else int(self.seen / self.factor)
        if self.pitch is None:
            return self.vocoder.finish(total)
        long = math.floor(self.pitch.place) if self.curves else int(self.seen / (self.factor / 2.0 ** (self.semitones / 12)))
        return self.pitch.process(self.vocoder.finish(long), total)

    def _steps(self, f: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A step has its first frame's values and ends where they change, but not before STEP frames."""
        held, i = np.empty((2, len(f))), 0
        while i < len(f):
            if self.age >= STEP and self.now != (f[i], s[i]):
                self.now, self.age = (f[i], s[i]), 0
            if self.age < STEP:
                k = min(len(f), i + STEP - self.age)
            else:
                other = np.flatnonzero((f[i:] != self.now[0]) | (s[i:] != self.now[1]))
                k = i + int(other[0]) if len(other) else len(f)
            held[:, i:k] = np.array(self.now)[:, None]
            self.age, i = self.age + k - i, k
        return held[0], held[1]


def check(factors: np.ndarray, semitones: np.ndarray, first: int | None = None) -> None:
    """`first` is the number of the curves' first element; None for constants."""
    for name, bad, want in (("stretch_factor", ~(factors > 0), "greater than 0"), ("pitch_shift_in_semitones", ~(np.abs(semitones) <= 72), "between -72 and 72")):
        if bad.any():
            raise ValueError(f"{name} has to be {want}" if first is None else f"{name}: element {first + int(np.flatnonzero(bad)[0])} is out of range")


def time_stretch(x: np.ndarray, stretch_factor: np.ndarray | float = 1.0, pitch_shift_in_semitones: np.ndarray | float = 0.0) -> np.ndarray:
    """A whole signal (channels, n) at once; either parameter may be a curve."""
    n, given = x.shape[1], {"stretch_factor": stretch_factor, "pitch_shift_in_semitones": pitch_shift_in_semitones}
    for name, v in given.items():
        if np.ndim(v) and len(v) != n:
            raise ValueError(f"{name} has {len(v)} values for {n} frames")
    constant = [1.0 if np.ndim(stretch_factor) else stretch_factor, 0.0 if np.ndim(pitch_shift_in_semitones) else pitch_shift_in_semitones]
    curves = [v if np.ndim(v) else None for v in given.values()]
    s = Stretcher(x.shape[0], *constant, curves=any(c is not None for c in curves))
    return np.concatenate((s.process(x, *curves), s.finish()), axis=1)


def pitch_shift(x: np.ndarray, semitones: float = 0.0) -> np.ndarray:
    return time_stretch(x, 1.0, semitones)
