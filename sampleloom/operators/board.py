"""Chains of effects over the packed form.

A board of any length costs one shuffle at most. Leading and trailing sample-wise effects stay in
the JVM, as one projection each. All others run in one pass, by the widest key of these effects
(channel, or track where channels meet). If the outputs of all of them depend on a bounded stretch of frames, as those of
convolution, chorus, delay without feedback and resampling do, a track is cut into ranges of RANGE_FRAMES frames that also get the blocks they
reach into, and each range is a task's work of its own. Else blocks are dealt by key and sorted by chunk, and one Python
stream per partition carries the state from block to block. Memory does not grow with a track either way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleloom.functions import values
from sampleloom.kernels import effects as fx
from sampleloom.kernels.sinc import Resampler
from sampleloom.kernels.vocoder import Stretcher
from sampleloom.kernels.vocoder import check as check_stretch
from sampleloom.operators.tables import CHUNKS, KEY

#: Frames of a track that one range holds, but for its halo.
RANGE_FRAMES = 1 << 18
#: Frames that are gathered from short blocks before effects run over them at once.
GATHER = 1 << 15

_COLUMNS: dict[type, Callable[[fx.Effect, Column], Column]] = {
    fx.Gain: lambda e, c: values.gain(c, e.gain_db),
    fx.Invert: lambda e, c: values.invert(c),
    fx.Clipping: lambda e, c: values.clipping(c, e.threshold_db),
    fx.Distortion: lambda e, c: values.distortion(c, e.drive_db),
    fx.Bitcrush: lambda e, c: values.bitcrush(c, e.bit_depth),
}


class Board:
    """An ordered list of effects; lists inside it are chains, fx.Mix runs branches side by side."""

    def __init__(self, effects: list | None = None):
        self._own: list = []
        for e in effects or []:
            self.append(e)

    def _checked(self, e):
        e = Board(e) if isinstance(e, (list, tuple)) else e
        if not isinstance(e, (fx.Effect, Board)):
            raise TypeError(f"an effect is needed, not {type(e).__name__}")
        if any(e is x for x in self._own):
            raise ValueError("the same effect is already in this board")
        return e

    def append(self, e) -> None:
        self._own.append(self._checked(e))

    def insert(self, i: int, e) -> None:
        self._own.insert(i, self._checked(e))

    def remove(self, e) -> None:
        self._own.remove(e)

    def __getitem__(self, i):
        return self._own[i]

    def __setitem__(self, i: int, e) -> None:
        self._own[i] = self._checked(e)

    def __delitem__(self, i: int) -> None:
        del self._own[i]

    def __len__(self) -> int:
        return len(self._own)

    def __contains__(self, e) -> bool:
        return any(e is x for x in self._own)

    def flat(self) -> list[fx.Effect]:
        return [y for x in self._own for y in (x.flat() if isinstance(x, Board) else [x])]

    @property
    def latency(self) -> int:
        return sum(e.latency for e in self.flat())


def sample_wise(effects: list[fx.Effect], c: Column) -> Column:
    for e in effects:
        c = _COLUMNS[type(e)](e, c)
    return c


def _is_native(e: fx.Effect) -> bool:
    return type(e) in _COLUMNS


def plan(effects: list[fx.Effect]) -> tuple[list, list, list]:
    """(native head, middle, native tail)."""
    n = len(effects)
    head = next((i for i in range(n) if not _is_native(effects[i])), n)
    tail = next((i for i in range(n, head, -1) if not _is_native(effects[i - 1])), head)
    return effects[:head], effects[head:tail], effects[tail:]


def _rows(batches, by: list[str], ranged: bool = False) -> Iterator[tuple[tuple, int, int, list[int], np.ndarray]]:
    """(key, chunk, start_frame, channels, block) of sorted rows; the channels of one chunk come together if the key is the track. With
    `ranged` a sixth column is part of the key."""
    held: list[tuple] = []

    def block():
        n = max(len(r[4]) for r in held)
        out = np.zeros((len(held), n))
        for i, r in enumerate(held):
            out[i, : len(r[4])] = r[4]
        return held[0][0], held[0][1], held[0][2], [r[3] for r in held], out

    for batch in batches:
        t, c, k, s = (batch.column(i).to_pylist() for i in range(4))
        lists = batch.column(4)
        r = batch.column(5).to_pylist() if ranged else None
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
        for i in range(batch.num_rows):
            key = ((t[i],) if by == ["track_id"] else (t[i], c[i])) + ((r[i],) if ranged else ())
            if held and (key, k[i]) != (held[0][0], held[0][1]):
                yield block()
                held.clear()
            held.append((key, k[i], s[i], c[i], flat[ends[i] : ends[i + 1]].astype(np.float64)))
    if held:
        yield block()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    lengths = [len(r[4]) for r in rows]
    flat = np.concatenate([r[4] for r in rows]) if rows else np.zeros(0)
    samples = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(flat, pa.float64()))
    cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), samples]
    return pa.RecordBatch.from_arrays(cols, names=["track_id", "channel", "chunk", "start_frame", "samples"])


def _tasks(df: DataFrame) -> int:
    """Named, so that Spark doesn't merge what are few bytes but much work."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_order(chunks: DataFrame, by: list[str], make: Callable[[], Callable], stored: bool = False) -> DataFrame:
    """One ordered pass: make() gives, once for each key, f(block or None at the key's end, start_frame, channels) -> blocks of output.

    `stored` says that a table's layout may do for the dealing (tables.read_store): where Spark finds that it does, nothing is shuffled, nor sorted that is known to be.
    """
    rows = chunks.select("track_id", "channel", "chunk", "start_frame", F.col("samples").cast("array<double>").alias("samples"))
    order = dict.fromkeys([*by, "chunk", "channel"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, f, chunk_no, frame, channels = None, None, 0, 0, []

        def emit(block: np.ndarray, at: tuple | None):
            nonlocal chunk_no, frame
            if at is None:
                if not block.shape[1]:
                    return
                at = (chunk_no, frame)
                chunk_no += 1
                frame += block.shape[1]
            out.extend((key[0], c, at[0], at[1], block[i]) for i, c in enumerate(channels))

        for own, chunk, start, chans, block in _rows(batches, by):
            if own != key:
                if f is not None:
                    for b, at in f(None, 0, channels):
                        emit(b, at)
                key, f, chunk_no, frame = own, make(), 0, 0
            channels = [c for c in chans if c >= 0]
            for b, at in f(block, (chunk, start), chans):
                emit(b, at)
            if sum(len(r[4]) for r in out) > 1 << 18:
                yield _batch(out)
                out.clear()
        if f is not None:
            for b, at in f(None, 0, channels):
                emit(b, at)
        if out:
            yield _batch(out)

    if stored:
        made = rows.sortWithinPartitions(*order).groupBy(*by).applyInArrow(run, CHUNKS)
        if _exchanges(made) == _exchanges(rows):  # else Spark would shuffle what is sorted
            return made
    return _dealt(rows, by).sortWithinPartitions(*order).mapInArrow(run, CHUNKS)


def _dealt(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of a key in one partition. By a hash of the key, as Spark leaves out a repartition by columns that the rows (or all parts of a union) are
    dealt by, and may then still read those shuffles otherwise, since nothing that runs on the partitions says that it needs them."""
    return rows.repartition(_tasks(rows), F.xxhash64(*by))


def _exchanges(df: DataFrame) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def in_ranges(chunks: DataFrame, by: list[str], before: int, after: int, work: Callable) -> DataFrame:
    """Tracks cut into ranges of RANGE_FRAMES frames. work(x, first, blocks, low, high, ended) gets the samples (channels, frames) from frame
    `first` on, which hold frames low - before .. high + after - 1 of the track as far as it has them; the blocks (chunk, start_frame, frames) in
    them; and whether the track ends with them. It gives (chunk, start_frame, block) of what belongs to frames low .. high - 1.
    """
    most, after = RANGE_FRAMES, max(1, after)
    typed = chunks.select("track_id", "channel", "chunk", "start_frame", F.col("samples").cast("array<double>").alias("samples"))
    first = F.greatest(F.floor((F.col("start_frame") - after) / most), F.lit(0)).cast("long")
    last = F.greatest(first, F.floor((F.col("start_frame") + F.size("samples") - 1 + before) / most).cast("long"))
    dealt = typed.withColumn("range", F.explode(F.sequence(first, last))).repartition(_tasks(chunks), *by, "range").sortWithinPartitions(*by, "range", "chunk", "channel")

    def run(batches):
        held: list[tuple] = []
        key, channels = None, []

        def done():
            low = key[-1] * most
            high = low + most
            x, blocks = np.concatenate([h[2] for h in held], axis=1), [(h[0], h[1], h[2].shape[1]) for h in held]
            end = held[-1][1] + held[-1][2].shape[1]
            if end <= low and (low or not any(low <= s < high for _, s, _ in blocks)):
                return None  # what is before the range reaches into it, but the track doesn't
            return _batch([(key[0], c, k, s, block[i]) for k, s, block in work(x, held[0][1], blocks, low, high, end < high + after) for i, c in enumerate(channels)])

        for own, chunk, start, chans, block in _rows(batches, by, ranged=True):
            if held and own != key:
                if (out := done()) is not None:
                    yield out
                held.clear()
            key, channels = own, chans
            held.append((chunk, start, block))
        if held and (out := done()) is not None:
            yield out

    return dealt.mapInArrow(run, CHUNKS)


def apply_effects(chunks: DataFrame, effects: list[fx.Effect], rate: float, stored: bool = False) -> DataFrame:
    """`stored`: chunks come from tables.read_store(), so an ordered pass needs no shuffle."""
    head, middle, tail = plan(effects)
    df = chunks if not head else values.on_chunks(chunks, lambda c: sample_wise(head, c))
    if middle:
        by = ["track_id"] if fx.worst(middle) == "track" else KEY
        memory = fx.memory(middle, rate)

        def through(block, states, start):
            if not states:
                states.extend(e.init_state(rate, block.shape[0]) for e in middle)
            for e, s in zip(middle, states, strict=True):
                block = e.process(block, s, start)
            return block

        def cut(whole, blocks):
            ends = np.cumsum([n for _, _, n in blocks]).tolist()
            return [(k, s, whole[:, e - n : e]) for (k, s, n), e in zip(blocks, ends, strict=True)]

        def make():
            states: list = []
            waiting: list[tuple] = []

            def f(block, at, channels):
                if block is not None:
                    waiting.append((*at, block))
                if not waiting or block is not None and sum(w[2].shape[1] for w in waiting) < GATHER:
                    return []
                whole = through(np.concatenate([w[2] for w in waiting], axis=1), states, waiting[0][1])
                out = [(b, (k, s)) for k, s, b in cut(whole, [(k, s, b.shape[1]) for k, s, b in waiting])]
                waiting.clear()
                return out

            return f

        def work(x, first, blocks, low, high, ended):
            own = [b for b in blocks if low <= b[1] < high]
            if not own:
                return []
            stop = own[-1][1] + own[-1][2] - first
            whole = through(x[:, :stop], [], first)
            return cut(whole[:, own[0][1] - first :], own)

        df = in_order(df, by, make, stored) if memory is None else in_ranges(df, by, memory, 0, work)
    return df if not tail else values.on_chunks(df, lambda c: sample_wise(tail, c))


def apply_board(chunks: DataFrame, board: Board | list, rate: float, stored: bool = False) -> DataFrame:
    """The board's output, of the same length; an empty board returns the input."""
    return apply_effects(chunks, (board if isinstance(board, Board) else Board(board)).flat(), rate, stored)


def resample_chunks(chunks: DataFrame, src: float, dst: float, quality: str = "sinc32", chunk_frames: int = 8192, more: int = 0) -> DataFrame:
    """Any quality; outputs do not depend on how the input is cut, as positions come from their numbers. A block of outputs
    belongs to the range of frames in which its first one lies. `more` outputs are made past a track's usual end."""
    if src == dst:
        return chunks
    kernel = Resampler(src, dst, quality)
    reach = int(np.ceil(chunk_frames * kernel.ratio)) + kernel.after + 2

    def place(block: int) -> int:
        return max(0, int(np.floor(kernel.position(np.array([float(block * chunk_frames)]))[0])))

    def first_from(frame: int) -> int:
        """The first block of outputs that begins at this frame or later."""
        block = max(0, int(frame / kernel.ratio / chunk_frames) - 2)
        while block and place(block - 1) >= frame:
            block -= 1
        while place(block) < frame:
            block += 1
        return block

    def work(x, first, blocks, low, high, ended):
        length = kernel.length(first + x.shape[1]) + more if ended else None
        block = 0 if low == 0 else first_from(low)
        out = []
        while (place(block) < high) and (length is None or block * chunk_frames < length):
            begin, stop = block * chunk_frames, (block + 1) * chunk_frames
            made = [kernel.outputs(x, first, i, min(i + 4096, stop if length is None else min(stop, length))) for i in range(begin, stop if length is None else min(stop, length), 4096)]
            out.append((block, begin, np.concatenate(made, axis=1)))
            block += 1
        # the end of a track may put out more than its frames' places say
        while ended and high >= first + x.shape[1] > low and block * chunk_frames < length:
            begin, stop = block * chunk_frames, min((block + 1) * chunk_frames, length)
            out.append((block, begin, np.concatenate([kernel.outputs(x, first, i, min(i + 4096, stop)) for i in range(begin, stop, 4096)], axis=1)))
            block += 1
        return out

    return in_ranges(chunks, KEY, kernel.before + 2, reach, work)


def resample_effect_chunks(chunks: DataFrame, rate: float, target_rate: float = 8000.0, quality: str = "sinc32") -> DataFrame:
    """Down and back, cut or padded to the input's blocks."""
    if target_rate <= 0:
        raise ValueError("target_rate has to be greater than 0")
    down, up = Resampler(rate, target_rate, quality), Resampler(target_rate, rate, quality)
    # frames on each side that outputs reach: those of the way back, at the lower rate, and those of the way down
    reach = lambda side: int(np.ceil((getattr(up, side) + 3) * max(1.0, down.ratio) + getattr(down, side) + abs(down.latency) + abs(up.latency) * down.ratio)) + 4

    def work(x, first, blocks, low, high, ended):
        own = [b for b in blocks if low <= b[1] < high]
        if not own:
            return []
        begin, stop = own[0][1], own[-1][1] + own[-1][2]
        if not ended and stop + reach("after") > first + x.shape[1]:
            raise ValueError("blocks are too long to be resampled in ranges; rechunk() them first")
        between_ = down.length(first + x.shape[1]) if ended else None
        at = up.position(np.array([float(begin), float(stop - 1)]))
        j, k = max(0, int(np.floor(at[0])) - up.before - 1), int(np.floor(at[1])) + up.after + 2
        if between_ is not None:
            k = min(k, between_)
        middle = down.outputs(x, first, j, max(j, k))
        made = stop if between_ is None else min(stop, up.length(between_))
        whole = up.outputs(middle, j, begin, max(begin, made))
        whole = np.pad(whole, ((0, 0), (0, stop - begin - whole.shape[1])))
        out, ends = [], 0
        for chunk, start, n in own:
            out.append((chunk, start, whole[:, ends : ends + n]))
            ends += n
        return out

    # blocks that begin in a range end after it, so the reach counts from their ends
    return in_ranges(chunks, KEY, reach("before"), reach("after") + RANGE_FRAMES // 4, work)


def time_stretch(chunks: DataFrame, stretch_factor: float = 1.0, semitones: float = 0.0, chunk_frames: int = 8192, curves: DataFrame | None = None) -> DataFrame:
    """int(n / stretch_factor) frames. The phases of a track depend on all before, so a track is one stream; a few windows of it are held.

    curves(track_id, stretch array<double>, semitones array<double>), one value a frame, replaces the constants; they act in steps of
    at least 1024 frames, and a null array or a track without a row has the constants. A wrong length or a bad element is an error.
    """
    check_stretch(np.array([float(stretch_factor)]), np.array([float(semitones)]))  # on the driver

    def make():
        own: list[Stretcher] = []
        made: list[np.ndarray] = []

        def f(block, at, channels):
            if block is not None:
                lead = sum(c < 0 for c in channels)  # the curves' rows
                if not own:
                    own.append(Stretcher(len(channels) - lead, stretch_factor, semitones, curves=lead > 0))
                made.append(own[0].process(block[lead:], *block[:lead]))
            else:
                made.append(own[0].finish())
            have = sum(m.shape[1] for m in made)
            if have < chunk_frames and block is not None:
                return []
            whole = np.concatenate(made, axis=1)
            stop = have if block is None else have - have % chunk_frames
            made[:] = [whole[:, stop:]]
            return [(whole[:, i : min(i + chunk_frames, stop)], None) for i in range(0, stop, chunk_frames)]

        return f

    if curves is not None:
        # curves travel beside a track's blocks, as channels -2 and -1
        blocks = chunks.select("track_id", F.col("channel").cast("int").alias("channel"), F.col("chunk").cast("long").alias("chunk"), "start_frame", F.col("samples").cast("array<double>").alias("samples"))
        chunks = blocks.unionByName(_curve_rows(chunks, curves, stretch_factor, semitones))
    return in_order(chunks, ["track_id"], make)


def _curve_rows(chunks: DataFrame, curves: DataFrame, stretch_factor: float, semitones: float) -> DataFrame:
    """Each track's curves, cut as its blocks are: one small row a block is gathered by track, the arrays are cut where they are."""
    blocks = chunks.groupBy("track_id", "chunk", "start_frame").agg(F.max(F.size("samples")).alias("n"))
    cuts = blocks.groupBy("track_id").agg(F.collect_list(F.struct("chunk", "start_frame", "n")).alias("cuts"), F.max(F.col("start_frame") + F.col("n")).cast("int").alias("total"))

    def checked(name: str, constant: float) -> Column:
        wrong = F.raise_error(F.concat(F.lit(f"{name} has "), F.size(name).cast("string"), F.lit(" values for "), F.col("total").cast("string"), F.lit(" frames"))).cast("array<double>")
        return F.when(F.col(name).isNull(), F.array_repeat(F.lit(float(constant)), F.col("total"))).when(F.size(name) == F.col("total"), F.col(name).cast("array<double>")).otherwise(wrong).alias(name)

    both = cuts.join(curves.select("track_id", "stretch", "semitones"), "track_id").select("track_id", "cuts", checked("stretch", stretch_factor), checked("semitones", semitones))
    rows = both.select("track_id", F.explode(F.transform("cuts", lambda c: F.struct(c["chunk"].alias("chunk"), c["start_frame"].alias("start_frame"), *[F.slice(name, (c["start_frame"] + 1).cast("int"), c["n"]).alias(name) for name in ("stretch", "semitones")]))).alias("c"))
    pair = rows.select("track_id", "c.chunk", "c.start_frame", F.explode(F.array(F.struct(F.lit(-2).alias("channel"), F.col("c.stretch").alias("samples")), F.struct(F.lit(-1).alias("channel"), F.col("c.semitones").alias("samples")))).alias("r"))
    return pair.select("track_id", F.col("r.channel").alias("channel"), F.col("chunk").cast("long").alias("chunk"), "start_frame", F.col("r.samples").alias("samples"))


def pitch_shift(chunks: DataFrame, semitones: float = 0.0) -> DataFrame:
    """The same length at another pitch; -72 to 72 semitones."""
    return time_stretch(chunks, 1.0, semitones)


def board_udf(board: Board | list, rate: float):
    """A pandas UDF array<double> -> array<double> of the same length, for whole short signals in one row each."""
    effects = (board if isinstance(board, Board) else Board(board)).flat()

    @F.pandas_udf("array<double>")
    def run(samples):
        import pandas as pd

        def one(x):
            if x is None:
                return None
            block = np.asarray(x, float)[None, :]
            for e in effects:
                block = e.process(block, e.init_state(rate, 1), 0)
            return block[0]

        return pd.Series([one(x) for x in samples])

    return run
