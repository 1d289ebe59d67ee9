"""Aggregates over channels, frames and tracks. All sums are built up partially before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.functions.values import gain_to_db
from sampleloom.operators.tables import KEY


def to_mono(frames: DataFrame, keep_channels: bool = False) -> DataFrame:
    """The mean of the channels; kept channels all get it."""
    if keep_channels:
        return frames.withColumn("value", F.avg("value").over(Window.partitionBy("track_id", "frame")))
    mean = frames.groupBy("track_id", "frame").agg(F.avg("value").alias("value"))
    return mean.select("track_id", F.lit(0).alias("channel"), "frame", "value")


def mix(branches: list[DataFrame | None], dry: DataFrame) -> DataFrame:
    """The sum of all branches where all have a frame; a None branch is the dry input, no branch is silence."""
    if not branches:
        return dry.withColumn("value", F.lit(0.0))
    all_ = reduce(DataFrame.unionByName, [dry if b is None else b for b in branches])
    summed = all_.groupBy(*KEY, "frame").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return summed.filter(F.col("n") == len(branches)).drop("n")


def _summed(blocks: Column) -> Column:
    """The sum of arrays, place by place; a missing place adds nothing."""
    none = F.lit(0.0)
    return F.aggregate(blocks, F.array().cast("array<double>"), lambda acc, x: F.zip_with(acc, x, lambda a, b: F.coalesce(a, none) + F.coalesce(b, none)))


def to_mono_chunks(chunks: DataFrame, keep_channels: bool = False) -> DataFrame:
    """to_mono() on blocks: a row a block is shuffled, not one a sample. Channels of a track have to be cut alike."""
    held = chunks.groupBy("track_id", "chunk", "start_frame").agg(F.array_sort(F.collect_list(F.struct("channel", F.col("samples").cast("array<double>").alias("samples")))).alias("x"))
    mean = F.transform(_summed(F.col("x.samples")), lambda v: v / F.size("x"))
    channel = F.explode("x.channel") if keep_channels else F.lit(0)
    return held.select("track_id", channel.alias("channel"), "chunk", "start_frame", mean.alias("samples")).select(*KEY, "chunk", "start_frame", "samples")


def mix_chunks(branches: list[DataFrame | None], dry: DataFrame) -> DataFrame:
    """mix() on blocks that are cut alike in all branches."""
    if not branches:
        return dry.withColumn("samples", F.transform(F.col("samples").cast("array<double>"), lambda v: v * 0.0))
    all_ = reduce(DataFrame.unionByName, [(dry if b is None else b).select(*KEY, "chunk", "start_frame", F.col("samples").cast("array<double>").alias("samples")) for b in branches])
    held = all_.groupBy(*KEY, "chunk", "start_frame").agg(F.collect_list("samples").alias("x"))
    return held.filter(F.size("x") == len(branches)).select(*KEY, "chunk", "start_frame", _summed(F.col("x")).alias("samples"))


def levels(frames: DataFrame, by: list[str] | tuple = tuple(KEY)) -> DataFrame:
    """Peak and RMS, also in dB (null for silence)."""
    peak, rms = F.max(F.abs("value")).alias("peak"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms")
    return frames.groupBy(*by).agg(peak, rms).withColumns({"peak_db": gain_to_db("peak"), "rms_db": gain_to_db("rms")})


def track_info(frames: DataFrame, rate: float) -> DataFrame:
    """Channels by a set of a few numbers a track, so one shuffle of partial results."""
    agg = frames.groupBy("track_id").agg(F.size(F.collect_set("channel")).alias("num_channels"), (F.max("frame") + 1).alias("num_frames"))
    return agg.select("track_id", F.lit(float(rate)).alias("sample_rate"), "num_channels", "num_frames", (F.col("num_frames") / float(rate)).alias("duration_s"))


def trim_silence(frames: DataFrame, threshold_db: float = -80.0) -> DataFrame:
    """Without the frames at both ends that are under the threshold in every channel; of an all-silent track one zero frame is left."""
    loud = F.when(F.abs("value") >= 10.0 ** (threshold_db / 20.0), F.col("frame"))
    bounds = frames.groupBy("track_id").agg(F.min(loud).alias("first"), F.max(loud).alias("last"))
    joined = frames.join(bounds, "track_id")
    kept = joined.filter((F.col("frame").between(F.col("first"), F.col("last"))) | (F.col("first").isNull() & (F.col("frame") == 0)))
    value = F.when(F.col("first").isNull(), 0.0).otherwise(F.col("value"))
    return kept.select(*KEY, (F.col("frame") - F.coalesce("first", F.lit(0))).alias("frame"), value.alias("value"))


def pad(frames: DataFrame, n: int) -> DataFrame:
    """n silent frames behind every track and channel."""
    ends = frames.groupBy(*KEY).agg((F.max("frame") + 1).alias("end"))
    tail = ends.select(*KEY, F.explode(F.sequence(F.col("end"), F.col("end") + n - 1)).alias("frame"), F.lit(0.0).alias("value")) if n > 0 else None
    return frames if tail is None else frames.unionByName(tail)


def trim_tail(frames: DataFrame, original_frames: DataFrame, block: int, floor: float = 1e-4) -> DataFrame:
    """Of what was padded after original_frames(track_id, num_frames), without the first block of `block` frames whose peak is under `floor`, and all after it."""
    joined = frames.join(original_frames, "track_id")
    b = F.when(F.col("frame") >= F.col("num_frames"), F.floor((F.col("frame") - F.col("num_frames")) / block))
    tail = joined.withColumn("__b", b)
    peaks = tail.filter("__b is not null").groupBy("track_id", "__b").agg(F.max(F.abs("value")).alias("peak"))
    cut = peaks.filter(F.col("peak") < floor).groupBy("track_id").agg(F.min("__b").alias("cut"))
    kept = tail.join(cut, "track_id", "left").filter("__b is null or cut is null or __b < cut")
    return kept.select(*KEY, "frame", "value")


def normalise_energy(ir: DataFrame) -> DataFrame:
    """x * 0.125 / sqrt(the greatest energy of a channel); unchanged under 1e-8."""
    energy = ir.groupBy(*KEY).agg(F.sum(F.col("value") * F.col("value")).alias("e")).groupBy("track_id").agg(F.max("e").alias("e"))
    factor = F.when(F.col("e") < 1e-8, 1.0).otherwise(0.125 / F.sqrt("e"))
    return ir.join(energy, "track_id").select(*KEY, "frame", (F.col("value") * factor).alias("value"))
