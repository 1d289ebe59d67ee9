"""Effects with explicit state. A block is (channels, samples); process() gets the number of its first frame
and returns a block of the same size, so a run in many blocks equals a run in one.

Definitions that are ours are named with their source: Giannoulis, Massberg, Reiss (JAES 2012) for
dynamics; Dattorro (JAES 1997) for the chorus; Smith, Physical Audio Signal Processing, for the phaser and
the comb/all-pass reverb; Huovilainen (DAFx 2004) for the ladder.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields
from typing import Any

import numpy as np

from sampleloom.kernels import linear, scans


def between(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} has to be between {low:g} and {high:g}")


@dataclass(eq=False)
class Effect:
    """Users' effects derive from this: fields are the parameters, `key` says what must be processed in one order:
    "none" (sample-wise), "channel" or "track"; `latency` is in frames."""

    key = "channel"
    latency = 0
    #: Parameters that the state's form depends on.
    steady = ()

    def retuned(self, rate: float, state: Any) -> None:
        """Fits a state to parameters that have changed, so that processing goes on; in place."""

    def init_state(self, rate: float, channels: int) -> Any:
        return None

    def process(self, block: np.ndarray, state: Any, start: int) -> np.ndarray:
        """May change state in place."""
        raise NotImplementedError

    def memory(self, rate: float) -> int | None:
        """How many frames before its own an output depends on; None if on all of them. With a number, a track can be cut."""
        return 0 if self.key == "none" else None

    @property
    def params(self) -> dict[str, Any]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def stages(self) -> list["Effect"]:
        """Effects that give the same one after the other."""
        return [self]


class Scanned:
    """An effect on single channels whose state is a few numbers and whose blocks compose: what a block makes of the state before it is a map that is known
    from one run over the block (`exact`), or the best of the tangents known so far. So blocks of one track can be worked on apart (operators/scan.py).
    """

    exact = True
    #: Whether a block's output depends on its samples and state alone, not on where it is.
    anywhere = True

    def guess(self, rate: float, x: np.ndarray) -> np.ndarray:
        """States (rows, numbers) to begin with, for blocks (rows, frames)."""
        raise NotImplementedError

    def maps(self, rate: float, x: np.ndarray, start: int, states: np.ndarray) -> np.ndarray:
        """(rows, numbers): each block's map, near these states."""
        raise NotImplementedError

    def reached(self, maps: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The state after a block, by its maps (known, numbers)."""
        raise NotImplementedError

    def loaded(self, rate: float, states: np.ndarray) -> Any:
        """What process() takes, with these states of its channels."""
        raise NotImplementedError


def _affine(maps: np.ndarray, state: np.ndarray) -> np.ndarray:
    """A map is a matrix, row by row, and what is added."""
    k = len(state)
    return maps[0, : k * k].reshape(k, k) @ state + maps[0, k * k :]


@dataclass(eq=False)
class Gain(Effect):
    gain_db: float = 1.0
    key = "none"

    def process(self, block, state, start):
        return block * 10 ** (self.gain_db / 20)


@dataclass(eq=False)
class Invert(Effect):
    key = "none"

    def process(self, block, state, start):
        return -block


@dataclass(eq=False)
class Clipping(Effect):
    threshold_db: float = -6.0
    key = "none"

    def process(self, block, state, start):
        top = 10 ** (self.threshold_db / 20)
        return np.clip(block, -top, top)


@dataclass(eq=False)
class Distortion(Effect):
    drive_db: float = 25.0
    key = "none"

    def process(self, block, state, start):
        return np.tanh(block * 10 ** (self.drive_db / 20))


@dataclass(eq=False)
class Bitcrush(Effect):
    bit_depth: float = 8.0
    key = "none"

    def __post_init__(self):
        between("bit_depth", self.bit_depth, 0, 32)

    def process(self, block, state, start):
        return np.rint(block * 2.0**self.bit_depth) / 2.0**self.bit_depth


class _Linear(Scanned, Effect):
    def filter(self, rate: float) -> linear.Filter:
        raise NotImplementedError

    def guess(self, rate, x):
        return np.zeros((len(x), self.filter(rate).order))

    def maps(self, rate, x, start, states):
        own = self.filter(rate)
        return np.concatenate((np.tile(own.power(x.shape[1]).ravel(), (len(x), 1)), own.run(x)[1]), axis=1)

    def reached(self, maps, state):
        return _affine(maps, state)

    def loaded(self, rate, states):
        return [self.filter(rate), states]

    def retuned(self, rate, state):
        state[0] = self.filter(rate)

    def init_state(self, rate, channels):
        own = self.filter(rate)
        return [own, np.zeros((channels, own.order))]

    def process(self, block, state, start):
        out, state[1] = state[0].run(block, state[1])
        return out


class Filtered(_Linear):
    """A filter that is given by its coefficients, for whatever rate."""

    def __init__(self, own: linear.Filter):
        self.own = own

    @property
    def params(self):
        return {"own": self.own}

    def filter(self, rate):
        return self.own


@dataclass(eq=False)
class LowpassFilter(_Linear):
    cutoff_frequency_hz: float = 50.0

    def filter(self, rate):
        return linear.lowpass(rate, self.cutoff_frequency_hz)


@dataclass(eq=False)
class HighpassFilter(_Linear):
    cutoff_frequency_hz: float = 50.0

    def filter(self, rate):
        return linear.highpass(rate, self.cutoff_frequency_hz)


@dataclass(eq=False)
class _Second(_Linear):
    cutoff_frequency_hz: float = 440.0
    gain_db: float = 0.0
    q: float = 0.7071067690849304
    make = staticmethod(linear.peak)

    def filter(self, rate):
        return self.make(rate, self.cutoff_frequency_hz, self.gain_db, self.q)


class HighShelfFilter(_Second):
    make = staticmethod(linear.high_shelf)


class LowShelfFilter(_Second):
    make = staticmethod(linear.low_shelf)


class PeakFilter(_Second):
    make = staticmethod(linear.peak)


@dataclass(eq=False)
class Delay(Effect):
    delay_seconds: float = 0.5
    feedback: float = 0.0
    mix: float = 0.5
    steady = ("delay_seconds",)

    def __post_init__(self):
        between("delay_seconds", self.delay_seconds, 0, 30)
        between("feedback", self.feedback, 0, 1)
        between("mix", self.mix, 0, 1)

    def memory(self, rate):
        return int(self.delay_seconds * rate) if self.feedback == 0 else None

    def init_state(self, rate, channels):
        return [np.zeros((channels, int(self.delay_seconds * rate)))]

    def process(self, block, state, start):
        line = state[0]
        d = line.shape[1]
        if d == 0:
            return block
        out = np.empty_like(block)
        for i in range(0, block.shape[1], d):  # no echo of a part falls into that part
            x = block[:, i : i + d]
            n = x.shape[1]
            late = line[:, :n]
            out[:, i : i + n] = (1 - self.mix) * x + self.mix * late
            line = np.concatenate((line[:, n:], x + self.feedback * late), axis=1)
        state[0] = line
        return out


def smoothing(rate: float, ms: float) -> float:
    return math.exp(-1000.0 / (rate * ms)) if ms > 0 else 0.0


class _Dynamics(Scanned, Effect):
    """A gain that follows the branching peak detector, e = |x| + coefficient (e - |x|)."""

    exact = False

    def init_state(self, rate, channels):
        return self.loaded(rate, np.zeros((channels, 1)))

    def envelope(self, block, state):
        """The detector over a block, which moves the state on."""
        out, _ = scans.follow(np.abs(block), *state)
        if block.shape[1]:
            state[0] = out[:, -1].copy()
        return out

    def guess(self, rate, x):
        return np.abs(x[:, :512]).max(axis=1, initial=0)[:, None]

    def maps(self, rate, x, start, states):
        return scans.tangent(np.abs(x), *self.loaded(rate, states))

    def reached(self, maps, state):
        after = maps[:, 0] * state[0] + maps[:, 1]
        return np.array([after.max() if self.attack_ms <= self.release_ms else after.min()])

    def loaded(self, rate, states):
        return [states[:, 0].copy(), smoothing(rate, self.attack_ms), smoothing(rate, self.release_ms)]

    def retuned(self, rate, state):
        state[1:] = smoothing(rate, self.attack_ms), smoothing(rate, self.release_ms)


@dataclass(eq=False)
class Compressor(_Dynamics):
    threshold_db: float = 0.0
    ratio: float = 1.0
    attack_ms: float = 1.0
    release_ms: float = 100.0

    def __post_init__(self):
        if self.ratio < 1:
            raise ValueError("ratio has to be at least 1")

    def process(self, block, state, start):
        t = 10 ** (self.threshold_db / 20)
        e = self.envelope(block, state) / t
        return block * np.where(e > 1, np.maximum(e, 1) ** (1 / self.ratio - 1), 1.0)


@dataclass(eq=False)
class NoiseGate(_Dynamics):
    threshold_db: float = -100.0
    ratio: float = 10.0
    attack_ms: float = 1.0
    release_ms: float = 100.0

    def __post_init__(self):
        if self.ratio < 1:
            raise ValueError("ratio has to be at least 1")

    def process(self, block, state, start):
        e = self.envelope(block, state) / 10 ** (self.threshold_db / 20)
        return block * np.where(e < 1, np.minimum(e, 1) ** (self.ratio - 1), 1.0)


@dataclass(eq=False)
class Limiter(Effect):
    """A gentle compressor at -10 dB, one of ratio 1000 at the threshold, and a clip at full scale."""

    threshold_db: float = -10.0
    release_ms: float = 100.0

    def stages(self) -> list[Effect]:
        return [Compressor(-10.0, 4.0, 2.0, 200.0), Compressor(self.threshold_db, 1000.0, 0.001, self.release_ms), Clipping(0.0)]

    def init_state(self, rate, channels):
        return [(s, s.init_state(rate, channels)) for s in self.stages()]

    def process(self, block, state, start):
        for s, own in state:
            block = s.process(block, own, start)
        return block

    def retuned(self, rate, state):
        state[:] = [(s, own) for s, (_, own) in zip(self.stages(), state, strict=True)]
        for s, own in state:
            s.retuned(rate, own)


@dataclass(eq=False)
class Chorus(Effect):
    """A delay of centre_delay_ms, swung by depth of itself by a sine LFO, read between two frames; feedback from the delayed signal."""

    rate_hz: float = 1.0
    depth: float = 0.25
    centre_delay_ms: float = 7.0
    feedback: float = 0.0
    mix: float = 0.5
    steady = ("centre_delay_ms",)

    def __post_init__(self):
        between("rate_hz", self.rate_hz, 0, 100)
        between("mix", self.mix, 0, 1)
        between("depth", self.depth, 0, 1)
        between("feedback", self.feedback, -1, 1)

    def _most(self, rate: float) -> int:
        return int(math.ceil(2 * self.centre_delay_ms * rate / 1000)) + 2

    def memory(self, rate):
        return self._most(rate) if self.feedback == 0 else None

    def init_state(self, rate, channels):
        return [rate, np.zeros((channels, self._most(rate)))]

    def process(self, block, state, start):
        rate, past = state
        n, back = block.shape[1], past.shape[1]
        frame = np.arange(start, start + n)
        d = np.maximum(self.centre_delay_ms * rate / 1000 * (1 + self.depth * np.sin(2 * math.pi * self.rate_hz * frame / rate)), 0.0)
        at = np.arange(n) - d
        low = np.floor(at).astype(np.int64)
        f = at - low
        line = np.concatenate((past, block), axis=1)
        if self.feedback == 0:
            wet = (1 - f) * line[:, low + back] + f * line[:, np.minimum(low + 1 + back, line.shape[1] - 1)]
        else:
            # parts shorter than the least delay can be taken at once
            step = max(1, int(d.min()) - 1)
            wet = np.empty_like(block)
            for i in range(0, n, step):
                k = slice(i, min(i + step, n))
                wet[:, k] = (1 - f[k]) * line[:, low[k] + back] + f[k] * line[:, np.minimum(low[k] + 1 + back, line.shape[1] - 1)]
                line[:, k.start + back : k.stop + back] = block[:, k] + self.feedback * wet[:, k]
        state[1] = line[:, -back:].copy()
        return (1 - self.mix) * block + self.mix * wet


@dataclass(eq=False)
class Phaser(Scanned, Effect):
    """Six first-order all-pass stages, swept by a sine LFO around the centre frequency."""

    rate_hz: float = 1.0
    depth: float = 0.5
    centre_frequency_hz: float = 1300.0
    feedback: float = 0.0
    mix: float = 0.5
    anywhere = False

    def __post_init__(self):
        between("mix", self.mix, 0, 1)
        between("depth", self.depth, 0, 1)

    def init_state(self, rate, channels):
        return self.loaded(rate, np.zeros((channels, scans.ALLPASS)))

    def _coefficient(self, rate: float, start: int, n: int) -> np.ndarray:
        sweep = self.centre_frequency_hz * (1 + self.depth * np.sin(2 * math.pi * self.rate_hz * np.arange(start, start + n) / rate))
        t = np.tan(math.pi * np.clip(sweep, 1.0, 0.49 * rate) / rate)
        return (t - 1) / (t + 1)

    def process(self, block, state, start):
        wet, state[1], _ = scans.swept(block, self._coefficient(state[0], start, block.shape[1]), self.feedback, state[1])
        return (1 - self.mix) * block + self.mix * wet

    def guess(self, rate, x):
        return np.zeros((len(x), scans.ALLPASS))

    def maps(self, rate, x, start, states):
        _, after, whole = scans.swept(x, self._coefficient(rate, start, x.shape[1]), self.feedback, np.zeros((len(x), scans.ALLPASS)), transition=True)
        return np.concatenate((np.tile(whole.ravel(), (len(x), 1)), after), axis=1)

    def reached(self, maps, state):
        return _affine(maps, state)

    def loaded(self, rate, states):
        return [rate, states]


@dataclass(eq=False)
class LadderFilter(Effect):
    """Four one-pole stages with a saturated feedback loop; modes LPF12, HPF12, BPF12, LPF24, HPF24, BPF24."""

    mode: str = "LPF12"
    cutoff_hz: float = 200.0
    resonance: float = 0.0
    drive: float = 1.0
    # Weights of the input and the four stages' outputs.
    MIXES = {"LPF12": (0, 0, 1, 0, 0), "HPF12": (1, -2, 1, 0, 0), "BPF12": (0, 0, -1, 1, 0), "LPF24": (0, 0, 0, 0, 1), "HPF24": (1, -4, 6, -4, 1), "BPF24": (0, 0, 1, -2, 1)}

    def __post_init__(self):
        if self.mode not in self.MIXES:
            raise ValueError(f"unknown mode {self.mode!r}")
        between("resonance", self.resonance, 0, 1)
        if self.drive < 1:
            raise ValueError("drive has to be at least 1")

    def init_state(self, rate, channels):
        state = [0.0, np.zeros((channels, 4))]
        self.retuned(rate, state)
        return state

    def retuned(self, rate, state):
        state[0] = 1 - math.exp(-2 * math.pi * min(self.cutoff_hz, 0.49 * rate) / rate)

    def process(self, block, state, start):
        g, held = state
        m, k, out = self.MIXES[self.mode], 4 * self.resonance, np.empty_like(block)
        tanh, drive = math.tanh, self.drive
        for c in range(block.shape[0]):
            a, b, d, e = held[c].tolist()
            for i, x in enumerate(block[c].tolist()):
                u = tanh(drive * x) - k * (tanh(e) - 0.5 * tanh(drive * x))
                a += g * (tanh(u) - tanh(a))
                b += g * (tanh(a) - tanh(b))
                d += g * (tanh(b) - tanh(d))
                e += g * (tanh(d) - tanh(e))
                out[c, i] = m[0] * u + m[1] * a + m[2] * b + m[3] * d + m[4] * e
            held[c] = (a, b, d, e)
        return out


@dataclass(eq=False)
class Reverb(Effect):
    """Eight damped combs side by side, then four all-passes, for each of two sides; the sides are crossed by width. All parameters 0..1."""

    room_size: float = 0.5
    damping: float = 0.5
    wet_level: float = 0.33
    dry_level: float = 0.4
    width: float = 1.0
    freeze_mode: float = 0.0
    key = "track"
    # Fixed values of the published network: delays in frames at 44.1 kHz, the second side's spread, gains.
    COMBS = (1116, 1188, 1277, 1356, 1422, 1491, 1557, 1617)
    ALLPASSES = (556, 441, 341, 225)
    SPREAD = 23

    def __post_init__(self):
        for name, value in self.params.items():
            between(name, value, 0, 1)

    def init_state(self, rate, channels):
        """All combs of both sides are rows of one array of what went into their lines lately, as are each all-pass's two sides."""
        length = lambda n, side: max(1, int((n + side * self.SPREAD) * rate / 44100))
        sides = range(min(2, channels))
        combs = np.array([length(n, s) for s in sides for n in self.COMBS])
        passes = [np.array([length(n, s) for s in sides]) for n in self.ALLPASSES]
        return [combs, np.zeros((len(combs), combs.max())), np.zeros((len(combs), 1)), passes, [np.zeros((len(sides), p.max())) for p in passes]]

    def process(self, block, state, start):
        frozen = self.freeze_mode >= 0.5
        gain = 0.0 if frozen else 0.015
        damp, feedback = (0.0, 1.0) if frozen else (self.damping * 0.4, self.room_size * 0.28 + 0.7)
        combs, line, low, passes, lines = state
        x = block[:2].sum(0) * gain
        n, sides = block.shape[1], len(combs) // len(self.COMBS)
        wets = np.empty((sides, n))
        held, back = _grown(line, n)
        for i in range(0, n, combs.min()):  # no comb's output of a part depends on that part
            part = x[i : i + combs.min()]
            late = _late(held, combs, back + i, len(part))
            wets[:, i : i + len(part)] = late.reshape(sides, -1, len(part)).sum(1)
            if damp:
                late = _smoothed(late, low[:, 0], damp)
                low = late[:, -1:]
            np.multiply(late, feedback, out=held[:, back + i : back + i + len(part)])
            held[:, back + i : back + i + len(part)] += part
        state[1], state[2] = held[:, n:].copy(), low.copy()
        for j, length in enumerate(passes):
            held, back = _grown(lines[j], n)
            for i in range(0, n, length.min()):
                part = wets[:, i : i + length.min()].copy()
                late = _late(held, length, back + i, part.shape[1])
                wets[:, i : i + part.shape[1]] = late - part
                held[:, back + i : back + i + part.shape[1]] = part + 0.5 * late
            lines[j] = held[:, n:].copy()
        wet = 3.0 * self.wet_level
        dry = 0.0 if frozen else 2.0 * self.dry_level
        out = block * dry
        if sides == 1:
            out[0] += wet * wets[0]
        else:
            same, other = 0.5 * wet * (1 + self.width), 0.5 * wet * (1 - self.width)
            out[0] += same * wets[0] + other * wets[1]
            out[1] += same * wets[1] + other * wets[0]
        return out


def _grown(line: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """A line with room for n frames more, and where they begin."""
    held = np.empty((len(line), line.shape[1] + n))
    held[:, : line.shape[1]] = line
    return held, line.shape[1]


def _late(held: np.ndarray, length: np.ndarray, at: int, n: int) -> np.ndarray:
    """What delay lines of these lengths put out from column `at` on, for n frames."""
    out = np.empty((len(held), n))
    for row, k in enumerate(length.tolist()):
        out[row] = held[row, at - k : at - k + n]
    return out


def _smoothed(x: np.ndarray, low: np.ndarray, damp: float) -> np.ndarray:
    """y = x (1 - damp) + damp * (y before, at first low): sums of 1, 2, 4, ... terms, until damp ** terms is lost in rounding."""
    y, factor, k = x * (1 - damp), damp, 1
    y[:, 0] += damp * low
    while factor > 1e-18 and k < x.shape[1]:
        longer = y.copy()
        longer[:, k:] += factor * y[:, :-k]
        y, factor, k = longer, factor * factor, 2 * k
    return y


@dataclass(eq=False)
class Convolution(Effect):
    """Overlap-save with FFTs; ir (channels, taps) is at the track's rate and already normalised. Channels past the IR's get its last one's, past two the wet signal of channel 0."""

    ir: np.ndarray = None
    mix: float = 1.0

    def __post_init__(self):
        between("mix", self.mix, 0, 1)
        self.ir = np.atleast_2d(np.asarray(self.ir, float))[:2]

    def memory(self, rate):
        return self.ir.shape[1] - 1

    def init_state(self, rate, channels):
        return [np.zeros((channels, self.ir.shape[1] - 1))]

    def process(self, block, state, start):
        past, taps, n = state[0], self.ir.shape[1], block.shape[1]
        line = np.concatenate((past, block), axis=1)
        size = 1 << (line.shape[1] + taps - 2).bit_length() if line.shape[1] + taps > 2 else 2
        wet = np.empty_like(block)
        for c in range(block.shape[0]):
            if c >= 2:
                wet[c] = wet[0]
                continue
            h = self.ir[min(c, self.ir.shape[0] - 1)]
            wet[c] = np.fft.irfft(np.fft.rfft(line[c], size) * np.fft.rfft(h, size), size)[taps - 1 : taps - 1 + n]
        state[0] = line[:, line.shape[1] - (taps - 1) :]
        return self.mix * wet + (1 - self.mix) * block


class Mix(Effect):
    """Branches side by side, added; each is an effect or a list of them; None is the dry signal. Less delayed branches wait for the most delayed."""

    def __init__(self, branches):
        self.branches = [_chain(b) for b in branches]
        self.latency = max([sum(e.latency for e in b) for b in self.branches], default=0)
        self.key = worst([e for b in self.branches for e in b])

    @property
    def params(self):
        return {"branches": self.branches}

    def memory(self, rate):
        own = [memory(b, rate) for b in self.branches]
        return None if None in own else max(own, default=0) + self.latency

    def init_state(self, rate, channels):
        return [([(e, e.init_state(rate, channels)) for e in b], np.zeros((channels, self.latency - sum(e.latency for e in b)))) for b in self.branches]

    def process(self, block, state, start):
        out = np.zeros_like(block)
        for i, (chain, waiting) in enumerate(state):
            x = block
            for e, own in chain:
                x = e.process(x, own, start)
            if waiting.shape[1]:
                line = np.concatenate((waiting, x), axis=1)
                x, state[i] = line[:, : block.shape[1]], (chain, line[:, block.shape[1] :])
            out = out + x
        return out


class AddLatency(Effect):
    """Whole frames of delay that the effect reports, so that mixes line up."""

    def __init__(self, samples: int):
        self.latency = int(samples)

    @property
    def params(self):
        return {"samples": self.latency}

    def memory(self, rate):
        return self.latency

    def init_state(self, rate, channels):
        return [np.zeros((channels, self.latency))]

    def process(self, block, state, start):
        line = np.concatenate((state[0], block), axis=1)
        state[0] = line[:, block.shape[1] :]
        return line[:, : block.shape[1]]


def _chain(x) -> list[Effect]:
    if x is None:
        return []
    found = list(x) if isinstance(x, (list, tuple)) else [x]
    for e in found:
        if not isinstance(e, Effect):
            raise TypeError(f"an effect is needed, not {type(e).__name__}")
    return found


def worst(effects: list[Effect]) -> str:
    """The widest key of a list of effects."""
    return max((e.key for e in effects), key=["none", "channel", "track"].index, default="none")


def memory(effects: list[Effect], rate: float) -> int | None:
    """Of a chain: the sum of its parts'."""
    own = [e.memory(rate) for e in effects]
    return None if None in own else sum(own)
