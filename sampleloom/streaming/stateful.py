"""Effects, resampling and loss counts over streams of blocks, with state per key.

Blocks may come late or out of order: a block waits in the state until all before it are there. What never comes is given up, and what waits is released,

* with `patience`, when nothing has come for its key for so many seconds;
* with `ahead`, when more than so many blocks wait (this bounds the state);
* with `event_time`, a column of the stream that has a watermark, when the watermark has passed the first block that waits.

Frames that were lost are counted in the column `dropped`: of the next row that the key puts out or, if none comes before its end mark, of a row without
samples in the mark's place. Blocks that come after they were given up are dropped too. The kernels are those of the batch
operators, so a stream's output equals the batch's. `forget` is a time after which the state of a key that gets no more blocks goes, but for two numbers:
a key that goes on after it starts with fresh effects at the first block that comes, and counts what is missing before that as lost.
Streams with `patience` or `forget` run batches without rows for their timers; for a trigger that should end (availableNow), set
spark.sql.streaming.noDataMicroBatches.enabled to false.
The session needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sampleloom.kernels import effects as fx
from sampleloom.kernels.sinc import StreamResampler
from sampleloom.operators.automation import Automated, Automation
from sampleloom.operators.tables import CHUNKS, KEY

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups that a stream's signals are dealt to by a hash. One call, and one table of output, serves all signals of a group that a batch has, each with a state of
#: its own: per signal there is little but reading its state and writing it. A stream that goes on from a checkpoint has to keep the number.
GROUPS = 1024
#: Samples of waiting blocks that may go with their signal's own state; of more, each block is a row of the map state.
HELD_SAMPLES = 4096
#: From so many signals of a group in a batch on, their states are read by one pass over the group's, unless it holds more than SPARSE times as many signals or
#: more than PASS_BYTES.
AT_ONCE, SPARSE, PASS_BYTES = 8, 8, 32 << 20
#: Samples put out at once, about.
OUT_SAMPLES = 1 << 18
#: In place of a channel where a signal is all channels of a track.
ALL = -1


def _group(*by: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(GROUPS)).cast("int")


class _Early:
    """The blocks of a signal that wait, by block and channel: those that came with its own state and in this batch, and those of the map state, where blocks get
    only if they still wait after their batch."""

    def __init__(self, state, signal: tuple, few: dict, stored: set):
        self.state, self.signal, self.own, self.stored = state, signal, few, stored

    def containsKey(self, k: tuple) -> bool:
        return k in self.own or k in self.stored

    def getValue(self, k: tuple) -> tuple:
        return self.own[k] if k in self.own else pickle.loads(self.state.getValue((*self.signal, *k))[0])

    def updateValue(self, k: tuple, v: tuple) -> None:
        self.own[k] = v

    def removeKey(self, k: tuple) -> None:
        self.own.pop(k, None)
        if k in self.stored:
            self.stored.remove(k)
            self.state.removeKey((*self.signal, *k))

    def keys(self) -> set[tuple]:
        return self.stored | set(self.own)

    def keep(self) -> tuple[dict, set]:
        """What goes with the signal's own state: few blocks, and the names of those of the map state."""
        if sum(len(samples) + len(marks) for _, samples, marks, _ in self.own.values()) > HELD_SAMPLES:
            for k, v in self.own.items():
                self.state.updateValue((*self.signal, *k), (pickle.dumps(v),))
            self.stored, self.own = self.stored | set(self.own), {}
        return self.own, self.stored


class _Ordered(StatefulProcessor):
    """Calls step(state, block, chunk, start, lost, marks) for the blocks of a key in the order of their numbers; a block of no samples ends the key.

    A block is (channels, samples): one channel, or all `channels` of a track once each has come; `lost` is how many frames are missing before it. The state of a
    signal holds (next block, next frame, kernel state, losses that no row has told, losses before the next block) and what came early. Spark's key is a group of
    signals; where timers are set, which are a key's, it is one signal.
    """

    def __init__(self, fresh: Callable, step: Callable, place: Callable, channels: int | None, patience: float | None, ahead: int | None, event_time: bool, forget: float | None):
        self.fresh, self.step, self.place, self.channels = fresh, step, place, channels
        self.patience, self.ahead, self.event_time, self.forget = patience, ahead, event_time, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.forget is None else int(self.forget * 1000)
        self.handle = handle
        self.kept = handle.getMapState("kept", "track_id long, channel int", "state binary", ttl)
        self.waiting = handle.getMapState("early", "track_id long, channel int, chunk long, part int", "block binary", ttl)
        self.reached = handle.getMapState("reached", "track_id long, channel int", "block long, frame long")
        self.sizes = handle.getMapState("sizes", "part int", "signals long, largest long")  # of a group, about; only how it is read hangs on it
        self.read: dict[tuple, bytes] | None = None
        self.news = self.largest = 0

    def _read(self, signals: dict) -> int:
        """The states of many signals at once, where that pays; else self.read is None and each is read on its own. How many signals the group is known to hold."""
        self.read, self.news, self.largest = None, 0, 0
        if len(signals) < AT_ONCE:
            return 0
        if not self.sizes.containsKey((0,)):
            if next(iter(self.kept.keys()), None) is None:
                self.read = {}
            return 0
        held, largest = self.sizes.getValue((0,))
        if held <= SPARSE * len(signals) and held * largest <= PASS_BYTES:
            held, self.read = 0, {}
            for k, v in self.kept.iterator():
                held += 1
                if tuple(k) in signals:
                    self.read[tuple(k)] = v[0]
        self.largest = largest
        return held

    def _begin(self, signal: tuple) -> tuple[bool, list]:
        """Whether the signal's state is there, and the state; what waits is in `early`."""
        if self.read is None:
            state = self.kept.getValue(signal)[0] if self.kept.containsKey(signal) else None
        else:
            state = self.read.pop(signal, None)
        known = state is not None
        held, few, stored = pickle.loads(state) if known else ([0, 0, self.fresh(), 0, 0], {}, set())
        self.news += not known
        if self.forget is not None:  # blocks may have gone before
            stored = {k for k in stored if self.waiting.containsKey((*signal, *k))}
        self.channel, self.early = signal[1], _Early(self.waiting, signal, few, stored)
        return known, held

    def _end(self, signal: tuple, held: list) -> None:
        state = pickle.dumps((held, *self.early.keep()))
        self.kept.updateValue(signal, (state,))
        self.largest = max(self.largest, len(state))
        if self.forget is not None:
            self.reached.updateValue(signal, (held[0], held[1]))

    def _names(self) -> list[int]:
        return [self.channel] if self.channels is None else list(range(self.channels))

    def _block(self, chunk: int) -> tuple[int, np.ndarray | None, list] | None:
        """(start_frame, block or None at the end, marks) if all of it is there; it leaves the state."""
        names = self._names()
        if not all(self.early.containsKey((chunk, c)) for c in names):
            return None
        got = [self.early.getValue((chunk, c)) for c in names]
        for c in names:
            self.early.removeKey((chunk, c))
        n = max(len(x[1]) for x in got)
        block = np.zeros((len(names), n))
        for i, x in enumerate(got):
            block[i, : len(x[1])] = x[1]
        return int(got[0][0]), block if n else None, list(got[0][2])

    def _through(self, track: int, held: list) -> list[tuple]:
        """What the blocks from the next one on give, as far as they are there; held moves on."""
        out: list[tuple] = []
        names = self._names()
        while (found := self._block(held[0])) is not None:
            start, block, marks = found
            for chunk, at, made in self.step(held[2], block, held[0], start, held[4], marks):
                out += [(track, c, chunk, at, made[i].tolist(), held[3] if i == 0 else 0) for i, c in enumerate(names)]
                held[3] = 0
            held[4] = 0
            if block is None:  # the end of the signal: the next block is a new one's first
                if held[3]:
                    out.append((track, names[0], *self.place(held[2], held[0], start), [], held[3]))
                held[:] = [0, 0, self.fresh(), 0, 0]
            else:
                held[0], held[1] = held[0] + 1, start + block.shape[1]
        return out

    @staticmethod
    def _skip(held: list, block: int, start: int) -> None:
        """Goes on at this block; what is missing before it is lost."""
        lost = max(0, start - held[1])
        held[0], held[1], held[3], held[4] = block, start, held[3] + lost, held[4] + lost

    def _release(self, track: int, held: list, most: int = 0) -> list[tuple]:
        """While more than `most` blocks wait: what is incomplete before the first whole block is given up."""
        out: list[tuple] = []
        need = len(self._names())
        while True:
            waiting = sorted(tuple(k) for k in self.early.keys())
            if len({k for k, _ in waiting}) <= most:
                return out
            chunks = [k for k, _ in waiting]
            whole = next((k for k in chunks if chunks.count(k) == need), None)
            for k, c in waiting:
                if whole is None or k < whole:
                    self.early.removeKey((k, c))
            if whole is None:
                return out
            self._skip(held, whole, int(self.early.getValue((whole, waiting[chunks.index(whole)][1]))[0]))
            out += self._through(track, held)

    def _table(self, out: list[tuple]):
        import pandas as pd

        made = pd.DataFrame(out, columns=["track_id", "channel", "chunk", "start_frame", "samples", "dropped"])
        return made if _counts(self.patience, self.ahead, self.event_time, self.forget) else made.drop(columns="dropped")

    def _time(self, timerValues) -> None:
        """One timer, as long as blocks wait."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        waiting = [k for k in self.early.keys()]
        if waiting and self.event_time:
            self.handle.registerTimer(min(int(self.early.getValue(tuple(k))[3]) for k in waiting) + 1)
        elif waiting:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.patience * 1000))

    def _signal(self, signal: tuple, came: list[tuple], timerValues) -> list[tuple]:
        """What the blocks (block and channel, value) that came for a signal give."""
        known, held = self._begin(signal)
        first: tuple[int, int] | None = None
        for k, v in came:
            if k[0] >= held[0]:
                self.early.updateValue(k, v)
                first = min(first or (k[0], v[0]), (k[0], v[0]))
        if not known and self.forget is not None and first and self.reached.containsKey(signal):
            block, frame = self.reached.getValue(signal)
            if first[0] >= block > 0:  # forgotten in the middle of its signal; a number before that begins a new one
                held[1] = int(frame)
                self._skip(held, *first)
        out = self._through(signal[0], held)
        if self.ahead is not None:
            out += self._release(signal[0], held, self.ahead)
        if self.patience is not None or self.event_time:
            self._time(timerValues)
        self._end(signal, held)
        return out

    def handleInputRows(self, key, rows, timerValues):
        came: dict[tuple, list] = {}
        for pdf in rows:
            for track, c, chunk, start, samples, marks, ts in zip(*[pdf[x].tolist() for x in ("track_id", "channel", "chunk", "start_frame", "samples", "marks", "ts")], strict=True):
                came.setdefault((track, c if self.channels is None else ALL), []).append(((chunk, c), (start, samples, marks, ts)))
        stored = self._read(came)
        out: list[tuple] = []
        samples = 0
        for signal, blocks in came.items():
            made = self._signal(signal, blocks, timerValues)
            out += made
            samples += sum(len(r[4]) for r in made)
            if samples > OUT_SAMPLES:
                yield self._table(out)
                out, samples = [], 0
        if len(came) >= AT_ONCE:
            self.sizes.updateValue((0,), (max(stored + self.news, len(came)), self.largest))
        yield self._table(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Nothing came for so long, or what waits is of the past."""
        signal = (int(key[0]), int(key[1]) if self.channels is None else ALL)
        _, held = self._begin(signal)
        out = self._release(signal[0], held)
        self._end(signal, held)
        yield self._table(out)

    def close(self) -> None:
        pass


def _counts(patience: float | None, ahead: int | None, event_time: str | bool | None, forget: float | None) -> bool:
    return patience is not None or ahead is not None or bool(event_time) or forget is not None


def _stateful(chunks_stream: DataFrame, fresh: Callable, step: Callable, place: Callable, channels: int | None, patience: float | None, ahead: int | None, event_time: str | None, forget: float | None, marks: str | None = None) -> DataFrame:
    if event_time and (patience is not None or forget is not None):
        raise ValueError("event_time can't be used together with patience or forget, which go by the clock")
    told = F.coalesce(F.col(marks).cast("array<double>"), F.array().cast("array<double>")) if marks else F.array().cast("array<double>")
    ts = F.unix_millis(F.col(event_time).cast("timestamp")) if event_time else F.lit(0).cast("long")
    extra = [F.col(event_time)] if event_time else []  # the column with the watermark has to stay
    rows = chunks_stream.select("track_id", "channel", "chunk", "start_frame", F.col("samples").cast("array<double>").alias("samples"), told.alias("marks"), ts.alias("ts"), *[c.alias("__watermarked") for c in extra])
    by = KEY if channels is None else ["track_id"]
    if patience is None and not event_time:
        rows, by = rows.withColumn("__group", _group(*by)), ["__group"]
    timed = "EventTime" if event_time else ("None" if patience is None and forget is None else "ProcessingTime")
    schema = f"{CHUNKS}, dropped long" if _counts(patience, ahead, event_time, forget) else CHUNKS
    return rows.groupBy(*by).transformWithStateInPandas(_Ordered(fresh, step, place, channels, patience, ahead, bool(event_time), forget), outputStructType=schema, outputMode="Append", timeMode=timed)


def stream_effects(
    chunks_stream: DataFrame, effects: list[fx.Effect], rate: float, channels: int | None = None, patience: float | None = None, forget: float | None = None, ahead: int | None = None, event_time: str | None = None, automation: Automation | None = None, marks: str = "marks"
) -> DataFrame:
    """A chain of effects, block by block. A block without samples resets the state and keeps the parameters.

    Effects that join channels, as Reverb does, need `channels`, how many a track has; a block then waits for all of its channels. `patience` and
    `forget` are in seconds. After a loss the kernels go on with the state that they had before it. With `automation` each block brings the
    points of its curves in the column `marks` (frame, which, value, frame, ...), as operators.automation has them.
    """
    joined = fx.worst(effects) == "track"
    if joined and channels is None:
        raise ValueError("effects that join channels need the number of a track's channels")
    Automated(effects, automation or {}, rate)

    def fresh():
        return Automated(effects, automation or {}, rate)

    def step(state, block, chunk, start, lost, points):
        if block is None:
            return []
        state.tell(points)
        return [(chunk, start, state.process(block, start))]

    def place(state, chunk, start):
        return chunk, start

    return _stateful(chunks_stream, fresh, step, place, channels if joined else None, patience, ahead, event_time, forget, marks if automation else None)


def stream_resample(chunks_stream: DataFrame, src: float, dst: float, quality: str = "sinc32", patience: float | None = None, forget: float | None = None, ahead: int | None = None, event_time: str | None = None) -> DataFrame:
    """Resampling in constant memory: unused input and totals are kept; a block without samples flushes and resets. Lost frames move the numbers of
    the frames after them on by as many frames as they would have given."""

    def fresh():
        return {"resampler": StreamResampler(src, dst, quality), "chunk": 0, "frame": 0, "lost": 0}

    def step(state, block, chunk, start, lost, points):
        made = state["resampler"].process(block)
        state["lost"] += lost
        if not made.shape[1]:
            return []
        row = (state["chunk"], place(state, 0, 0)[1], made)
        state["chunk"] += 1
        state["frame"] += made.shape[1]
        return [row]

    def place(state, chunk, start):
        return state["chunk"], state["frame"] + int(state["lost"] * dst // src)

    return _stateful(chunks_stream, fresh, step, place, None, patience, ahead, event_time, forget)


class _Gaps(StatefulProcessor):
    def __init__(self, forget: float | None):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("kept", "track_id long", "next_frame long, dropped long", None if self.forget is None else int(self.forget * 1000))

    def handleInputRows(self, key, rows, timerValues):
        """The tracks of a group."""
        import pandas as pd

        came: dict[int, list[tuple[int, int]]] = {}
        for pdf in rows:
            for track, start, n in zip(pdf.track_id.tolist(), pdf.start_frame.tolist(), pdf.n.tolist(), strict=True):
                came.setdefault(track, []).append((start, n))
        out = []
        for track, blocks in came.items():
            expected, dropped = self.kept.getValue((track,)) if self.kept.containsKey((track,)) else (0, 0)
            for start, n in sorted(blocks):
                if start < expected:
                    continue  # late: its frames were counted as lost when the later block came
                dropped += start - expected
                expected = start + n
            self.kept.updateValue((track,), (expected, dropped))
            out.append((track, expected, dropped))
        yield pd.DataFrame(out, columns=["track_id", "next_frame", "dropped"])

    def close(self) -> None:
        pass


def dropped_frames(chunks_stream: DataFrame, delay: str = "10 seconds", forget: float | None = None) -> DataFrame:
    """track_id, next_frame, dropped: frames lost so far, an update for each batch. chunks_stream has ts; repeated blocks count once, blocks that come after a later one count as lost.
    After `forget` seconds without a block a track's counts go; what comes then is counted from frame 0 of a new signal."""
    blocks = chunks_stream.select("track_id", "ts", "start_frame", F.size("samples").alias("n")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["track_id", "start_frame"])
    return blocks.withColumn("__group", _group("track_id")).groupBy("__group").transformWithStateInPandas(_Gaps(forget), outputStructType="track_id long, next_frame long, dropped long", outputMode="Append", timeMode="None" if forget is None else "ProcessingTime")


def check_dropped(counts: DataFrame) -> None:
    """Strict mode: raises if any track has lost frames."""
    worst = counts.groupBy("track_id").agg(F.max("dropped").alias("dropped")).filter("dropped > 0").orderBy(F.desc("dropped")).head()
    if worst:
        raise RuntimeError(f"track {worst.track_id} has lost {worst.dropped} frames")
