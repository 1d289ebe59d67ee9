"""Time stretch and pitch shift of long tracks, by all tasks at once.

A grain's phases are those of the grain before at each bin's nearest peak, plus what the input says (kernels/vocoder.py). Such a step is a map of bins and an
offset, and two of them make one: so blocks of grains are summed up apart, and only their sums need an order.

1. ranges of frames are cut into the stretches of input that blocks of grains read, written to the shared folder. A block also holds the three grains before
   its own, as their windows reach into it;
2. each block alone: its map of bins and offset, some 12 kB;
3. a table of one such row a block hands the phases on along each track;
4. each block is synthesized from the phases before it.

The result is that of the streamed form (board.time_stretch) up to rounding. Its speed is constant; curves are left to the streamed form.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleloom.kernels.vocoder import HALF, HOP, SHAPE, WINDOW, check, places, spectra
from sampleloom.operators.board import _batch, _tasks, in_ranges, resample_chunks
from sampleloom.operators.scan import AT, BROADCAST_BLOCKS, NUMBERS, ROWS, _kept, typed
from sampleloom.operators.tables import CHUNKS, KEY

#: Input frames that a block of grains reads, about; and the most grains it has.
BLOCK_FRAMES, BLOCK_GRAINS = 1 << 16, 256
#: Blocks whose phases, 8 kB each, may be broadcast.
BROADCAST_PHASES = 4096
#: A window spans this many hops.
SPAN = WINDOW // HOP


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, as what is made of a row may be larger than the row."""
    for whole in batches:
        for i in range(0, whole.num_rows, ROWS):
            yield whole.slice(i, ROWS)


def _grains(block: int, per: int) -> np.ndarray:
    return np.arange(max(0, block * per - SPAN + 1), (block + 1) * per)


def _inputs(chunks: DataFrame, speed: float, per: int) -> DataFrame:
    """One row a block of grains: the track's length if it ends there, else infinity, and the input frames from start_frame on that its grains read."""

    def from_frame(frame: int) -> int:
        """The first block whose first own grain is read at this frame or later."""
        block = max(0, int(frame / (HOP * speed * per)) - 1)
        while places(np.array(block * per), speed) < frame:
            block += 1
        return block

    def work(x, first, blocks, low, high, ended):
        end = first + x.shape[1]
        if ended and end <= low:
            return []
        if ended and end <= high:
            stop = math.ceil((int(end / speed) + HALF) / (per * HOP))
        else:
            stop = from_frame(high)
        out = []
        for block in range(from_frame(low), stop):
            at = np.minimum(places(_grains(block, per), speed), end).astype(np.int64)
            begin = max(0, int(at[0]) - HALF - HOP)
            own = x[:, begin - first : int(at[-1]) + HALF - first]
            out.append((block, begin, np.pad(own, ((0, 0), (1, 0)), constant_values=float(end) if ended else np.inf)))
        return out

    step = HOP * speed
    return in_ranges(chunks, KEY, math.ceil((SPAN - 1) * step) + HALF + HOP + 2, math.ceil(per * step) + HALF + 4, work)


def _analysed(batch: pa.RecordBatch, speed: float, per: int) -> Iterator[tuple]:
    """(row, block, frames of the track, spectra of the block's grains)."""
    for i in range(batch.num_rows):
        block, start, samples = batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), np.asarray(batch.column(4)[i].values, float)
        grains = _grains(block, per)
        grains = grains[grains * HOP < int(samples[0] / speed) + HALF] if samples[0] < np.inf else grains  # those whose windows reach into the result
        at = np.minimum(places(grains, speed), samples[0]).astype(np.int64)
        begin, stop = int(at[0]) - HALF - HOP, int(at[-1]) + HALF
        line = np.pad(samples[1:], (start - begin, max(0, stop - start - len(samples) + 1)))
        yield i, block, float(samples[0]), [s[0] for s in spectra(line[None, :], at[:, None] - HALF - begin + np.arange(WINDOW)[None, :])]


def _maps(inputs: DataFrame, speed: float, per: int) -> DataFrame:
    """track_id, channel, chunk, frames, near, turn: what a block makes of the phases before it, up to where the next one begins."""

    def run(batches):
        for batch in _few(batches):
            out = []
            for _, block, frames, (angle, _, near, turn) in _analysed(batch, speed, per):
                n = len(near) - SPAN + 1
                # the track's first grain has its own phases, whatever is before it
                index, offset = (near[0], turn[0]) if block else (np.arange(HALF + 1), angle[0])
                for g in range(1, n):
                    index, offset = index[near[g]], offset[near[g]] + turn[g]
                out.append((frames, index, offset))
            numbers = lambda x, kind: pa.array([r[x] for r in out], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], numbers(0, pa.float64()), numbers(1, pa.list_(pa.int32())), numbers(2, NUMBERS)], names=["track_id", "channel", "chunk", "frames", "near", "turn"])

    return inputs.mapInArrow(run, f"{AT}, frames double, near array<int>, turn array<double>")


def _phases(maps: DataFrame) -> DataFrame:
    """track_id, channel, chunk, phases before the block's first grain. One small row a block."""

    def run(batches):
        key, phase = None, np.zeros(0)
        for batch in _few(batches):
            t, c = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for i in range(batch.num_rows):
                if (t[i], c[i]) != key:
                    key, phase = (t[i], c[i]), np.zeros(HALF + 1)
                out.append(phase)
                phase = np.remainder(phase[np.asarray(batch.column(3)[i].values)] + np.asarray(batch.column(4)[i].values), 2 * np.pi)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, NUMBERS)], names=["track_id", "channel", "chunk", "phase"])

    own = maps.select(*KEY, "chunk", "near", "turn")
    return own.repartition(_tasks(maps), *KEY).sortWithinPartitions(*KEY, "chunk").mapInArrow(run, f"{AT}, phase array<double>")


def _synthesized(inputs: DataFrame, phases: DataFrame, speed: float, per: int) -> DataFrame:
    few = phases.count() <= BROADCAST_PHASES
    both = inputs.join(F.broadcast(phases) if few else phases, [*KEY, "chunk"]).select(*KEY, "chunk", "start_frame", "samples", "phase")
    shape = (SHAPE**2).reshape(SPAN, HOP)

    def run(batches):
        for batch in _few(batches):
            t, c, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, block, frames, (angle, size, near, turn) in _analysed(batch, speed, per):
                phase, turned = np.asarray(batch.column(5)[i].values), np.empty_like(size)
                for g in range(len(size)):
                    phase = turned[g] = phase[near[g]] + turn[g] if block or g else angle[0]
                made = np.fft.irfft(size * np.exp(1j * turned), WINDOW) * SHAPE
                first = block * per * HOP - HALF
                stop = per * HOP if frames == np.inf else max(0, min(per * HOP, int(frames / speed) - first))
                n = -(-stop // HOP)  # hops of the block that the track has
                # there are no grains before the track's first and after its end
                before = 0 if block else SPAN - 1
                made = made[: max(0, n + SPAN - 1 - before)]
                after = n + SPAN - 1 - before - len(made)
                hops, there = np.pad(made, ((before, after), (0, 0))).reshape(-1, SPAN, HOP), np.pad(np.ones(len(made)), (before, after))
                total, weight = np.zeros((2, n, HOP))
                for j in range(SPAN):
                    own = slice(SPAN - 1 - j, SPAN - 1 - j + n)
                    total += hops[own, j]
                    weight += there[own, None] * shape[j]
                skip = max(0, -first)
                out.append((t[i], c[i], block, first + skip, (total / np.maximum(weight, 1e-6)).ravel()[skip : max(skip, stop)]))
            yield _batch(out)

    return both.mapInArrow(run, CHUNKS)


def stretch_along_time(chunks: DataFrame, stretch_factor: float = 1.0, semitones: float = 0.0, block_grains: int | None = None) -> DataFrame:
    """int(n / stretch_factor) frames of each track, for tracks that are few and long; board.time_stretch reads the input once only and does for many.

    Channels are independent. A track without frames gives none. The result's blocks have `block_grains` hops, or after a change of pitch 8192 frames.
    """
    check(np.array([float(stretch_factor)]), np.array([float(semitones)]))
    ratio = 2.0 ** (semitones / 12)
    speed = stretch_factor / ratio
    if stretch_factor == 1 and semitones == 0:
        return typed(chunks)
    per = block_grains or max(16, min(BLOCK_GRAINS, round(BLOCK_FRAMES / (HOP * speed))))
    if per < SPAN:
        raise ValueError(f"block_grains has to be at least {SPAN}")
    inputs = _kept(_inputs(chunks, speed, per), "grains")
    maps = _kept(_maps(inputs, speed, per), "maps")
    long = _synthesized(inputs, _kept(_phases(maps), "phases"), speed, per)
    if semitones == 0:
        return long.filter("size(samples) > 0")
    # as many frames more as the stretched track may be short of, and then to the length
    turned = resample_chunks(long, ratio, 1.0, "sinc32", more=math.ceil(1 / ratio) + 3)
    ends = maps.filter(F.col("frames") < float("inf")).groupBy(*KEY).agg(F.floor(F.max("frames") / float(stretch_factor)).alias("total"))
    few = ends.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    whole = turned.join(F.broadcast(ends) if few else ends, KEY).filter("start_frame < total")
    return whole.select(*KEY, "chunk", "start_frame", F.slice("samples", 1, F.least(F.size("samples"), F.col("total") - F.col("start_frame")).cast("int")).alias("samples"))


def pitch_shift_along_time(chunks: DataFrame, semitones: float = 0.0) -> DataFrame:
    """The same length at another pitch; -72 to 72 semitones."""
    return stretch_along_time(chunks, 1.0, semitones)
