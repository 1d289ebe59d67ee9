"""The table forms of a signal and the ways between them.

frames: track_id BIGINT, channel INT, frame BIGINT, value DOUBLE
chunks: track_id BIGINT, channel INT, chunk BIGINT, start_frame BIGINT, samples ARRAY<DOUBLE>
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sampleloom.functions.values import col
from sampleloom.sources.store import scratch

CHUNK = 8192
KEY = ["track_id", "channel"]
FRAMES = "track_id long, channel int, frame long, value double"
CHUNKS = "track_id long, channel int, chunk long, start_frame long, samples array<double>"


#: Rows that one task orders, about, where tasks are counted by rows.
ROWS_A_TASK = 1 << 19


def tasks_of(df: DataFrame, rows_a_task: int | None = None) -> int | None:
    """How many tasks the rows need, or None if Spark's own number does. The rows are counted, which for a table takes its footers alone."""
    tasks = -(-df.count() // (rows_a_task or ROWS_A_TASK))
    return tasks if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def frames_from_rows(df: DataFrame, track: Column | str, order_by: list[Column | str], value: Column | str, channel: Column | int = 0, tasks: int | None = None) -> DataFrame:
    """Any ordered numeric column as a signal: the frame is the place within the track, from 0. What a task holds for the order, and for further passes over
    a track's frames, which need no other dealing, grows with the rows over Spark's number of tasks, or over `tasks` (tasks_of)."""
    channel = channel if isinstance(channel, Column) else F.lit(channel)
    rows = df.select(col(track).cast("long").alias("track_id"), channel.cast("int").alias("channel"), col(value).cast("double").alias("value"), *[col(c).alias(f"__o{i}") for i, c in enumerate(order_by)])
    if tasks:
        rows = rows.repartition(tasks, "track_id")
    w = Window.partitionBy(*KEY).orderBy(*[f"__o{i}" for i in range(len(order_by))])
    return rows.select(*KEY, (F.row_number().over(w) - 1).cast("long").alias("frame"), "value")


#: Cuts, and offsets of ranges, that may be broadcast; there are as many as long tracks have RANGE_ROWS rows.
BROADCAST_RANGES = 200_000
RANGE_ROWS = 1 << 20


def frames_from_long_rows(df: DataFrame, track: Column | str, order_by: list[Column | str], value: Column | str, channel: Column | int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """frames_from_rows() for tracks that are longer than one task should order: they are cut into ranges of about `range_rows` rows by
    sketched quantiles of the first order column (a number, date or time), rows are counted in each range, and numbered within it from the sum of the counts before.

    Rows that are equal in that column stay together, so a track with one value there is one range. The rows are read three times; what is joined to them is one
    small row a range.
    """
    spark = df.sparkSession
    channel = channel if isinstance(channel, Column) else F.lit(channel)
    order = [f"__o{i}" for i in range(len(order_by))]
    rows = df.select(col(track).cast("long").alias("track_id"), channel.cast("int").alias("channel"), col(value).cast("double").alias("value"), *[col(c).alias(o) for c, o in zip(order_by, order, strict=True)])
    lengths = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.agg(F.max("n")).head()[0] or 0
    ranges = -(-most // range_rows)
    if ranges < 2:
        w = Window.partitionBy(*KEY).orderBy(*order)
        return rows.select(*KEY, (F.row_number().over(w) - 1).cast("long").alias("frame"), "value")
    same = lambda a: (F.col("track_id").eqNullSafe(F.col(f"{a}_t"))) & (F.col("channel") == F.col(f"{a}_c"))
    named = lambda d, a: d.withColumnsRenamed({"track_id": f"{a}_t", "channel": f"{a}_c"})
    few = lambda d: F.broadcast(d) if d.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES else d
    at = [i / ranges for i in range(1, ranges)]
    cuts = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("__o0", at, max(10_000, 20 * ranges)).alias("cuts")).filter(F.col("n") > range_rows).drop("n")
    cuts = _written(named(cuts, "a"), "cuts")  # a sketch may come out otherwise when it is made again
    cut = rows.join(few(cuts), same("a"), "left").withColumn("__range", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("__o0"))), F.lit(0))).withColumn("__range", F.when(F.col("cuts").isNull(), 0).otherwise(F.col("__range"))).drop("a_t", "a_c", "cuts")
    counts = cut.groupBy(*KEY, "__range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*KEY).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = _written(named(counts.withColumn("offset", F.coalesce(before, F.lit(0))).filter("__range > 0").withColumnRenamed("__range", "b_r").drop("n"), "b"), "offsets")
    numbered = cut.join(few(offsets), same("b") & (F.col("__range") == F.col("b_r")), "left")
    w = Window.partitionBy(*KEY, "__range").orderBy(*order)
    return numbered.select(*KEY, (F.row_number().over(w) - 1 + F.coalesce("offset", F.lit(0))).cast("long").alias("frame"), "value")


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def frames_from_arrays(df: DataFrame, track: Column | str, samples: Column | str, channel: Column | int = 0) -> DataFrame:
    channel = channel if isinstance(channel, Column) else F.lit(channel)
    return df.select(col(track).cast("long").alias("track_id"), channel.cast("int").alias("channel"), F.posexplode(col(samples)).alias("frame", "value")).select(*KEY, F.col("frame").cast("long"), F.col("value").cast("double"))


def pack(frames: DataFrame, n: int = CHUNK) -> DataFrame:
    """Blocks of n frames; the last may be short. Frames have to be whole from 0."""
    rows = frames.groupBy(*KEY, F.floor(F.col("frame") / n).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("frame", "value"))).alias("x"))
    return rows.select(*KEY, F.col("chunk").cast("long"), (F.col("chunk") * n).cast("long").alias("start_frame"), F.col("x.value").alias("samples"))


def unpack(chunks: DataFrame) -> DataFrame:
    at = chunks.select(*KEY, "start_frame", F.posexplode("samples").alias("i", "value"))
    return at.select(*KEY, (F.col("start_frame") + F.col("i")).cast("long").alias("frame"), F.col("value").cast("double").alias("value"))


def rechunk(chunks: DataFrame, n: int = CHUNK) -> DataFrame:
    """Other block sizes by pieces of blocks, not by single frames: each block is cut at the new borders and the cuts are joined."""
    length, first = F.size("samples"), F.floor(F.col("start_frame") / n)
    last = F.floor((F.col("start_frame") + length - 1) / n)
    cut = chunks.filter(length > 0).select(*KEY, "start_frame", "samples", F.explode(F.sequence(first, last)).alias("chunk"))
    start = F.greatest(F.col("chunk") * n, F.col("start_frame"))
    stop = F.least((F.col("chunk") + 1) * n, F.col("start_frame") + F.size("samples"))
    piece = F.expr("slice(samples, int(__start - start_frame) + 1, int(__stop - __start))")
    pieces = cut.withColumn("__start", start).withColumn("__stop", stop).select(*KEY, "chunk", F.col("__start").alias("start"), piece.alias("part"))
    joined = pieces.groupBy(*KEY, "chunk").agg(F.array_sort(F.collect_list(F.struct("start", "part"))).alias("x"))
    return joined.select(*KEY, F.col("chunk").cast("long"), (F.col("chunk") * n).cast("long").alias("start_frame"), F.flatten("x.part").alias("samples"))


def deinterleave(df: DataFrame, num_channels: int, samples: str = "samples") -> DataFrame:
    """(track_id, samples) with channels in turn -> frames."""
    if num_channels < 1:
        raise ValueError("num_channels has to be at least 1")
    at = df.select(F.col("track_id").cast("long"), F.posexplode(samples).alias("i", "value"))
    return at.select("track_id", (F.col("i") % num_channels).cast("int").alias("channel"), F.floor(F.col("i") / num_channels).cast("long").alias("frame"), F.col("value").cast("double").alias("value"))


def interleave(frames: DataFrame) -> DataFrame:
    """frames -> (track_id, samples) with channels in turn; for tracks that fit a row."""
    rows = frames.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("frame", "channel", "value"))).alias("x"))
    return rows.select("track_id", F.col("x.value").alias("samples"))


def read_window(df: DataFrame, start: int, n: int, longest: int | None = None) -> DataFrame:
    """n frames from `start` of every track; shorter at a track's end. Works on both forms: on chunks whole blocks are skipped first.

    If no block has more than `longest` frames, the bound below on start_frame is a plain one, which sources can use to read no block before.
    """
    for name, x in (("start", start), ("n", n)):
        if not isinstance(x, int) or isinstance(x, bool):
            raise TypeError(f"{name} has to be a whole number of frames")
    if start < 0 or n <= 0:
        raise ValueError("start has to be at least 0 and n at least 1")
    if "frame" in df.columns:
        return df.filter((F.col("frame") >= start) & (F.col("frame") < start + n))
    near = df.filter((F.col("start_frame") < start + n) & (F.col("start_frame") + F.size("samples") > start))
    if longest is not None:
        near = near.filter(F.col("start_frame") > start - longest)
    skip = F.greatest(F.lit(0), F.lit(start) - F.col("start_frame"))
    stop = F.least(F.size("samples"), F.lit(start + n) - F.col("start_frame"))
    cut = F.slice(F.col("samples"), (skip + 1).cast("int"), (stop - skip).cast("int"))
    return near.select(*KEY, "chunk", (F.col("start_frame") + skip).cast("long").alias("start_frame"), cut.alias("samples"))


def read_segments(frames: DataFrame, segments: DataFrame, bucket: int = CHUNK) -> DataFrame:
    """segments(track_id, seg_id, start, n) -> track_id, seg_id, channel, frame (from 0 in the segment), value.

    A segment meets only the buckets of `bucket` frames that it touches: an equi-join, then a trim.
    """
    s = segments.filter("n > 0 and start >= 0").select("track_id", "seg_id", "start", "n")
    s = s.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("start") + F.col("n") - 1) / bucket))))
    f = frames.withColumn("__b", F.floor(F.col("frame") / bucket))
    hit = f.join(s, ["track_id", "__b"]).filter((F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("start") + F.col("n")))
    return hit.select("track_id", "seg_id", "channel", (F.col("frame") - F.col("start")).alias("frame"), "value")


def ordered(df: DataFrame) -> DataFrame:
    """Rows of a track together and in order, for a writer; no global sort."""
    place = "frame" if "frame" in df.columns else "chunk"
    return df.repartition("track_id").sortWithinPartitions("track_id", *(["frame", "channel"] if place == "frame" else ["chunk", "channel"]))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Lossless store; each file holds whole runs of tracks in order, so readers skip by track."""
    chunks.repartitionByRange("track_id", "chunk").sortWithinPartitions("track_id", "channel", "chunk").write.mode("overwrite").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: Spark says how a bucketed scan is sorted only with this setting; without it an ordered pass over a store sorts each bucket once more, but doesn't shuffle.
KNOWN_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def write_store(chunks: DataFrame, table: str, path: str, buckets: int, by_channel: bool = True) -> None:
    """A store whose layout Spark knows: `buckets` buckets by track, one sorted file each (by channel and block, or by block and channel for
    boards that join channels). Boards over read_store(), joins and groups by track don't shuffle. `path` is a shared folder; the table replaces one of that name."""
    order = ["track_id", "channel", "chunk"] if by_channel else ["track_id", "chunk", "channel"]
    rows = chunks.select(*KEY, "chunk", "start_frame", F.col("samples").cast("array<double>").alias("samples"))
    # dealt by the hash that buckets go by, so each task writes one file
    dealt = rows.repartition(buckets, "track_id").sortWithinPartitions(*order)
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, "track_id").sortBy(*order).format("parquet").saveAsTable(table)


def read_store(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def synth(spark: SparkSession, specs: DataFrame, kind: str = "sine") -> DataFrame:
    """Test signals from specs(track_id, sample_rate, seconds, fundamental_hz): sine (faded in and out), noise, ramp or impulse."""
    n = F.floor(F.col("seconds") * F.col("sample_rate"))
    at = specs.withColumn("n", n).filter("n > 0").withColumn("frame", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    i, rate = F.col("frame").cast("double"), F.col("sample_rate")
    fade = F.least(F.floor(F.col("n") / 2), F.floor(0.1 * rate))
    # a fade of m frames goes from 0 to 1 in m even steps, both ends included
    step = F.when(fade > 1, 1.0 / (fade - 1)).otherwise(0.0)
    into = F.when(F.col("frame") < fade, i * step).otherwise(1.0)
    out = F.when(F.col("frame") >= F.col("n") - fade, 1.0 - (i - (F.col("n") - fade)) * step).otherwise(1.0)
    value = {
        "sine": F.sin(2.0 * F.lit(3.141592653589793) * F.col("fundamental_hz") * i / rate) * into * out,
        "noise": F.pmod(F.xxhash64("track_id", "frame"), F.lit(1 << 53)) / float(1 << 53),
        "ramp": F.when(F.col("n") > 1, 3.0 * i / (F.col("n") - 1)).otherwise(0.0),
        "impulse": F.when(F.col("frame") == 0, 1.0).otherwise(0.0),
    }[kind]
    return at.select(F.col("track_id").cast("long"), F.lit(0).alias("channel"), F.col("frame").cast("long"), value.cast("double").alias("value"))
