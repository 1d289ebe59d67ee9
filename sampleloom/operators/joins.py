"""Joins of signals with parameters, presets and each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.operators.tables import CHUNK, KEY

#: Preset rows that may be broadcast; more are joined by a shuffle of the tracks' ids.
BROADCAST_PRESETS = 100_000


def automate(frames: DataFrame, params: DataFrame, default: float, name: str | None = None, out: str = "param") -> DataFrame:
    """Backward as-of join: each sample gets the last parameter value at or before its frame, else `default`.

    Values become intervals up to the next one. A dense curve goes through one window over the
    union of both tables; both carry the same key, so that is one shuffle.
    """
    curve = params if name is None else params.filter(F.col("name") == name)
    keys = [F.col(k) for k in KEY]
    channels = frames.select(*KEY).distinct()
    marks = curve.join(channels, "track_id").select(*keys, F.col("frame").cast("long"), F.col("value").cast("double").alias("__p"), F.lit(0).alias("__kind"), F.lit(None).cast("double").alias("value"))
    rows = frames.select(*keys, "frame", F.lit(None).cast("double").alias("__p"), F.lit(1).alias("__kind"), "value").unionByName(marks)
    w = Window.partitionBy(*KEY).orderBy("frame", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = rows.withColumn(out, F.coalesce(F.last("__p", ignorenulls=True).over(w), F.lit(float(default))))
    return held.filter("__kind = 1").select(*KEY, "frame", "value", out)


def automate_chunks(chunks: DataFrame, params: DataFrame, default: float, n: int = CHUNK, name: str | None = None, out: str = "param") -> DataFrame:
    """automate() on blocks of n frames: each gets an array of the parameter's values, one a frame. Only points and block numbers are ordered, not samples."""
    curve = params if name is None else params.filter(F.col("name") == name)
    points = curve.groupBy("track_id", F.floor(F.col("frame") / n).cast("long").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(F.col("frame").cast("long").alias("frame"), F.col("value").cast("double").alias("value")))).alias("__points"))
    blocks = chunks.select("track_id", "chunk").distinct().join(points, ["track_id", "chunk"], "full")
    earlier = Window.partitionBy("track_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    held = blocks.select("track_id", "chunk", "__points", F.coalesce(F.last(F.element_at("__points", -1)["value"], ignorenulls=True).over(earlier), F.lit(float(default))).alias("__held"))
    joined = chunks.join(held, ["track_id", "chunk"])
    start, end = F.col("start_frame"), F.col("start_frame") + F.size("samples")
    marks = F.concat(F.array(F.struct(start.cast("long").alias("frame"), F.col("__held").alias("value"))), F.coalesce(F.filter("__points", lambda p: p["frame"] < end), F.array().cast("array<struct<frame:bigint,value:double>>")))
    runs = joined.withColumn("__marks", marks)
    until = lambda i: F.coalesce(F.get("__marks", i + 1)["frame"], end)
    values = F.flatten(F.transform("__marks", lambda p, i: F.array_repeat(p["value"], (until(i) - p["frame"]).cast("int"))))
    return runs.select(*KEY, "chunk", "start_frame", "samples", values.alias(out))


def blend_chunks(dry: DataFrame, wet: DataFrame, mix: float) -> DataFrame:
    """blend_tables() on blocks that are cut alike."""
    both = dry.withColumnRenamed("samples", "__dry").join(wet.select(*KEY, "chunk", F.col("samples").alias("__wet")), [*KEY, "chunk"])
    return both.select(*KEY, "chunk", "start_frame", F.zip_with("__dry", "__wet", lambda d, w: (1.0 - mix) * d + mix * w).alias("samples"))


def apply_presets(tracks: DataFrame, presets: DataFrame) -> DataFrame:
    """One row for each track and preset step. The presets are a stated set; only a counted small one is broadcast; beyond that the tracks' ids
    meet the presets' ids, and the rows of both are joined to that by their keys."""
    if presets.limit(BROADCAST_PRESETS + 1).count() <= BROADCAST_PRESETS:
        return tracks.join(F.broadcast(presets), how="cross")
    pairs = tracks.select("track_id").distinct().join(presets.select("preset_id").distinct(), how="cross")
    return tracks.join(pairs, "track_id").join(presets, "preset_id")


def augment_gain(frames: DataFrame, presets: DataFrame) -> DataFrame:
    """Every track with every preset of gain steps: the steps' decibels add up."""
    total = presets.groupBy("preset_id").agg(F.sum(F.element_at("args", "gain_db")).alias("gain_db"))
    out = apply_presets(frames, total)
    return out.select("track_id", "preset_id", "channel", "frame", (F.col("value") * F.pow(F.lit(10.0), F.col("gain_db") / 20)).alias("value"))


def blend_tables(dry: DataFrame, wet: DataFrame, mix: float) -> DataFrame:
    """(1 - mix) dry + mix wet, frame by frame."""
    both = dry.withColumnRenamed("value", "__dry").join(wet.withColumnRenamed("value", "__wet"), [*KEY, "frame"])
    return both.select(*KEY, "frame", ((1.0 - mix) * F.col("__dry") + mix * F.col("__wet")).alias("value"))


def concat_tracks(frames: DataFrame, order: DataFrame, info: DataFrame) -> DataFrame:
    """Pieces one after the other: order(track_id, target_id, position); info is track_info of the pieces.

    Pieces of one target have to agree in rate and channels.
    """
    at = order.join(info, "track_id")
    odd = at.groupBy("target_id").agg(F.count_distinct("sample_rate").alias("r"), F.count_distinct("num_channels").alias("c")).filter("r > 1 or c > 1").head()
    if odd:
        raise ValueError(f"the pieces of {odd[0]} differ in sample rate or number of channels")
    before = Window.partitionBy("target_id").orderBy("position", "track_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = at.select("track_id", "target_id", F.coalesce(F.sum("num_frames").over(before), F.lit(0)).alias("offset"))
    return frames.join(offsets, "track_id").select(F.col("target_id").cast("long").alias("track_id"), "channel", (F.col("frame") + F.col("offset")).alias("frame"), "value")


def supported(tracks: DataFrame, formats: DataFrame) -> DataFrame:
    """Tracks whose extension (and rate, where a format is bound to one) can be read."""
    return tracks.join(_few(formats), _readable(tracks, formats), "left_semi")


def unsupported(tracks: DataFrame, formats: DataFrame) -> DataFrame:
    return tracks.join(_few(formats), _readable(tracks, formats), "left_anti")


def _few(formats: DataFrame) -> DataFrame:
    """To be broadcast, if counted few."""
    return F.broadcast(formats) if formats.limit(BROADCAST_PRESETS + 1).count() <= BROADCAST_PRESETS else formats


def _readable(tracks: DataFrame, formats: DataFrame) -> Column:
    extension = F.lower(F.concat(F.lit("."), F.substring_index(tracks["path"], ".", -1)))
    return (extension == formats["extension"]) & (formats["only_rate"].isNull() | (formats["only_rate"] == tracks["sample_rate"]))
