"""Effects with state along the time of one track, by all tasks at once.

An effect whose blocks compose (fx.Scanned: linear filters, the phaser, dynamics) needs no pass in order:

1. each block alone: its map, which says what it makes of the state before it. The blocks are written to the shared folder with it, so that
   what they come from is computed once. Linear filters write what they put out from zero state in place of the samples;
2. a small table of one row a block hands the states on along each track;
3. maps that are tangents hold near the state they were taken at. Blocks whose state turns out to be another one are run from it again, and
   states are handed on by the best of their tangents; this ends when no state moves, after two or three rounds mostly, and exactly;
4. each block is run from its state. The states are broadcast if they are few, so that no samples are shuffled.

The result is that of one ordered pass, up to rounding, whatever the block size; with many tracks board.apply_board reads the input once only and is cheaper.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleloom.kernels import effects as fx
from sampleloom.operators.board import Board, _batch, apply_effects
from sampleloom.operators.tables import CHUNKS, KEY
from sampleloom.sources.store import scratch

#: Blocks whose start states, some 50 bytes each, may be broadcast.
BROADCAST_BLOCKS = 200_000
#: Blocks that are worked on at once.
ROWS = 64
#: Two states count as equal within this share of them.
SAME = 1e-12

NUMBERS = pa.list_(pa.float64())
AT = "track_id long, channel int, chunk long"


def typed(chunks: DataFrame) -> DataFrame:
    return chunks.select("track_id", "channel", "chunk", "start_frame", F.col("samples").cast("array<double>").alias("samples"))


def _alike(batches, anywhere: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of equal length, their numbers in the batch and their samples (rows, frames); a single row where its place matters."""
    for whole in batches:
        for i in range(0, whole.num_rows, ROWS):
            batch = whole.slice(i, ROWS)
            lists = batch.column(4)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            for n in np.unique(lengths).tolist():
                same = np.flatnonzero(lengths == n)
                for rows in [same] if anywhere else np.split(same, len(same)):
                    yield batch, rows, np.stack([flat[ends[r] - n : ends[r]] for r in rows])


def _listed(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float64()))


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _first(chunks: DataFrame, effect: fx.Effect, rate: float) -> DataFrame:
    """The blocks, and beside each the state that was guessed before it (`at`) and the maps known of it."""

    def run(batches):
        for batch, rows, x in _alike(batches, effect.anywhere):
            start = batch.column(3)[int(rows[0])].as_py()
            states = effect.guess(rate, x)
            maps = effect.maps(rate, x, start, states)
            if isinstance(effect, fx._Linear):
                x = effect.filter(rate).run(x)[0]
            known = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1), pa.int32()), _listed(maps))
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(rows)) for c in batch.columns[:4]], _listed(x), _listed(states), known], names=["track_id", "channel", "chunk", "start_frame", "samples", "at", "maps"])

    return typed(chunks).mapInArrow(run, f"{CHUNKS}, at array<double>, maps array<array<double>>")


def _chain(known: DataFrame, effect: fx.Effect) -> DataFrame:
    """track_id, channel, chunk, state before each block, and whether that isn't the state its last map was taken at. One small row a block."""
    dealt = known.select(*KEY, "chunk", "at", "maps").repartition(*KEY).sortWithinPartitions(*KEY, "chunk")

    def run(batches):
        key, state = None, np.zeros(0)
        for batch in batches:
            t, c, at, maps = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            states, moved = [], []
            for i in range(batch.num_rows):
                if (t[i], c[i]) != key:
                    key, state = (t[i], c[i]), np.zeros(len(at[i]))
                states.append(state.tolist())
                moved.append(bool((np.abs(state - at[i]) > SAME * np.maximum(np.abs(state), np.abs(at[i]))).any()))
                state = effect.reached(np.array(maps[i]), state)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(states, NUMBERS), pa.array(moved, pa.bool_())], names=["track_id", "channel", "chunk", "state", "moved"])

    return dealt.mapInArrow(run, f"{AT}, state array<double>, moved boolean")


def _with(blocks: DataFrame, states: DataFrame) -> DataFrame:
    few = states.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    return blocks.select(*KEY, "chunk", "start_frame", "samples").join(F.broadcast(states) if few else states, [*KEY, "chunk"]).select(*KEY, "chunk", "start_frame", "samples", "state")


def _again(blocks: DataFrame, states: DataFrame, effect: fx.Effect, rate: float) -> DataFrame:
    """track_id, channel, chunk, state, map: the blocks of `states` from these."""

    def run(batches):
        for batch, rows, x in _alike(batches, effect.anywhere):
            own = pa.array(rows)
            states = np.array(batch.column(5).take(own).to_pylist(), float)
            maps = effect.maps(rate, x, batch.column(3)[int(rows[0])].as_py(), states)
            yield pa.RecordBatch.from_arrays([*[c.take(own) for c in batch.columns[:3]], _listed(states), _listed(maps)], names=["track_id", "channel", "chunk", "state", "map"])

    return _with(blocks, states).mapInArrow(run, f"{AT}, state array<double>, map array<double>")


def scan_effect(chunks: DataFrame, effect: fx.Effect, rate: float) -> DataFrame:
    """One scanned effect; blocks keep their numbers and lengths."""
    if not isinstance(effect, fx.Scanned):
        raise TypeError(f"{type(effect).__name__} isn't an effect whose blocks compose")
    blocks = _kept(_first(chunks, effect, rate), "blocks")
    known = blocks.select(*KEY, "chunk", "at", "maps")
    states = _kept(_chain(known, effect), "states")
    while not effect.exact and not states.filter("moved").isEmpty():
        more = _again(blocks, states.filter("moved").select(*KEY, "chunk", "state"), effect, rate)
        both = known.join(more, [*KEY, "chunk"], "left").select(*KEY, "chunk", F.coalesce("state", "at").alias("at"), F.when(F.col("map").isNull(), F.col("maps")).otherwise(F.concat("maps", F.array("map"))).alias("maps"))
        known = _kept(both, "maps")
        states = _kept(_chain(known, effect), "states")

    def run(batches):
        rings: dict[int, np.ndarray] = {}
        for batch, rows, x in _alike(batches, effect.anywhere):
            own = np.array(batch.column(5).take(pa.array(rows)).to_pylist(), float).reshape(len(rows), -1)
            if isinstance(effect, fx._Linear):
                n = x.shape[1]
                if n not in rings:  # what each unit state puts out by itself
                    rings[n] = effect.filter(rate).run(np.zeros((own.shape[1], n)), np.eye(own.shape[1]))[0]
                y = x + own @ rings[n]
            else:
                y = effect.process(x, effect.loaded(rate, own), batch.column(3)[int(rows[0])].as_py())
            t, c, k, f = (batch.column(i).take(pa.array(rows)).to_pylist() for i in range(4))
            yield _batch([(t[i], c[i], k[i], f[i], y[i]) for i in range(len(rows))])

    return _with(blocks, states.select(*KEY, "chunk", "state")).mapInArrow(run, CHUNKS)


def apply_along_time(chunks: DataFrame, effects: Board | list, rate: float) -> DataFrame:
    """A board for tracks that are few and long: scanned effects one after the other, each by all tasks, and between them what can be cut into ranges or
    needs no state. What remains (ladder, reverb, chorus with feedback) is an ordered pass a track, as in apply_board."""
    flat = (effects if isinstance(effects, Board) else Board(effects)).flat()
    waiting: list[fx.Effect] = []
    for e in [s for e in flat for s in e.stages()]:
        if isinstance(e, fx.Scanned):
            chunks = scan_effect(apply_effects(chunks, waiting, rate) if waiting else chunks, e, rate)
            waiting = []
        else:
            waiting.append(e)
    return apply_effects(chunks, waiting, rate) if waiting else chunks
