"""Convolution with a table of impulse responses: any number of them, long ones too, each track with those that are chosen for it.

Nothing of a response is in a closure or broadcast. Responses are prepared once each (resampled, normalised), then travel to the ranges
of frames of the tracks that use them, in front of the range's blocks and in the same shuffle; a range also gets the blocks that the response reaches back to. So a task holds
one range, its reach and one response, and a long track is worked on by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleloom.kernels.effects import Convolution
from sampleloom.operators import board
from sampleloom.operators.filters import prepared_ir
from sampleloom.operators.scan import BROADCAST_BLOCKS, typed
from sampleloom.operators.tables import CHUNKS

PREPARED = "response_id long, channel int, taps array<double>"


def prepare_responses(responses: DataFrame, response_rate: float | str, rate: float) -> DataFrame:
    """response_id, channel (0, 1), taps: each response at `rate`, of at most two channels, and of bounded energy.

    `responses` are blocks (response_id, channel, chunk, start_frame, samples); `response_rate` is a number or the column that has it. A response is one group:
    it has to fit into a task, as it does when it is used.
    """
    own = responses[response_rate] if isinstance(response_rate, str) else F.lit(float(response_rate))
    rows = responses.select(F.col("response_id").cast("long").alias("response_id"), F.col("channel").cast("int").alias("channel"), F.col("start_frame").cast("long").alias("start_frame"), F.col("samples").cast("array<double>").alias("samples"), own.cast("double").alias("rate"))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        name = from_rate = None
        for b in batches:
            for i, c, s, x, r in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                name, from_rate = i, r
                parts.setdefault(c, []).append((s, x))
        n = max((s + len(x) for own in parts.values() for s, x in own), default=0)
        if not n:
            return
        if from_rate is None:
            raise ValueError(f"response {name} needs its sample rate")
        ir = np.zeros((len(parts), n))
        for k, c in enumerate(sorted(parts)):
            for s, x in parts[c]:
                ir[k, s : s + len(x)] = x
        ready = prepared_ir(ir, from_rate, rate)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(ready), pa.int64()), pa.array(range(len(ready)), pa.int32()), pa.array([x for x in ready], pa.list_(pa.float64()))], names=["response_id", "channel", "taps"])

    return rows.groupBy("response_id").applyInArrow(one, PREPARED)


def convolve_with(chunks: DataFrame, prepared: DataFrame, chosen: DataFrame, mix: float = 1.0) -> DataFrame:
    """track_id, response_id, channel, chunk, start_frame, samples: each track with each of its responses, cut to its length and blended.

    chosen(track_id, response_id) says which responses a track gets (with the column `mix`, how much of each); repeated rows count once. Tracks without a response, and
    responses that aren't there, give no rows. Channels past the response's get its last one's, past two the wet signal of channel 0.
    """
    if not 0 <= mix <= 1:
        raise ValueError("mix has to be between 0 and 1")
    own_mix = F.col("mix").cast("double") if "mix" in chosen.columns else F.lit(float(mix))
    lengths = prepared.groupBy("response_id").agg(F.max(F.size("taps")).cast("long").alias("n"))
    use = chosen.select(F.col("track_id").cast("long").alias("track_id"), F.col("response_id").cast("long").alias("response_id"), F.coalesce(own_mix, F.lit(float(mix))).alias("mix")).groupBy("track_id", "response_id").agg(F.max("mix").alias("mix")).join(lengths, "response_id")
    few = use.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    blocks = typed(chunks)
    most, end = board.RANGE_FRAMES, F.col("start_frame") + F.size("samples")
    pairs = blocks.join(F.broadcast(use) if few else use, "track_id")
    first = F.floor(F.col("start_frame") / most)
    ranged = pairs.withColumn("range", F.explode(F.sequence(first, F.greatest(first, F.floor((end - 1 + F.col("n") - 1) / most)))))
    frames = blocks.groupBy("track_id").agg(F.max(end).alias("frames"))
    ranges = use.join(frames, "track_id").select("track_id", "response_id", "mix", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest(F.col("frames"), F.lit(1)) - 1) / most))).alias("range"))
    sent = ranges.join(prepared, "response_id").select("track_id", "response_id", "range", (F.col("channel") - 2).alias("channel"), F.lit(-1).cast("long").alias("chunk"), F.lit(0).cast("long").alias("start_frame"), F.concat(F.array("mix"), "taps").alias("samples"))
    by = ["track_id", "response_id", "range"]
    rows = ranged.select(*by, "channel", "chunk", "start_frame", "samples").unionByName(sent)
    place = F.struct("response_id", "range").alias("place")
    dealt = board._dealt(rows, by).sortWithinPartitions(*by, "chunk", "channel").select("track_id", "channel", "chunk", "start_frame", "samples", place)

    def run(batches):
        key, response, held, channels = None, None, [], []

        def done():
            if response is None or not held:
                return None
            low = key[-1]["range"] * most
            own = [(k, s, x.shape[1]) for k, s, x in held if low <= s < low + most]
            if not own:
                return None
            x = np.concatenate([h[2] for h in held], axis=1)
            effect = Convolution(response[:, 1:], float(response[0, 0]))
            y, at = effect.process(x, effect.init_state(0.0, x.shape[0]), 0), held[0][1]
            made = board._batch([(key[0], c, k, s, y[i, s - at : s - at + n]) for k, s, n in own for i, c in enumerate(channels)])
            return pa.RecordBatch.from_arrays([*made.columns, pa.array([key[-1]["response_id"]] * made.num_rows, pa.int64())], names=[*made.schema.names, "response_id"])

        for own, chunk, start, chans, block in board._rows(batches, ["track_id"], ranged=True):
            if own != key:
                if (out := done()) is not None:
                    yield out
                key, response, held = own, None, []
            if chunk < 0:
                response = block
            else:
                held.append((chunk, start, block))
                channels = chans
        if (out := done()) is not None:
            yield out

    return dealt.mapInArrow(run, f"{CHUNKS}, response_id long").select("track_id", "response_id", "channel", "chunk", "start_frame", "samples")
