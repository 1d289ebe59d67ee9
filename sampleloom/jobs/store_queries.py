"""Queries through WAV files and streams. Their files are made from the given tables, in the shared folder."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleloom.jobs.effect_queries import _LINEAR, ev_chunks, local_sql
from sampleloom.jobs.signals import EMB, EMB2, EV, LI, RATE, emb2, emb_chunks, frames_out, li_chunks, value_sql
from sampleloom.kernels import effects as fx
from sampleloom.operators import channels, tables
from sampleloom.sources import wav
from sampleloom.sources.store import scratch
from sampleloom.streaming import stateful

ALL: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def keep(f):
        ALL[name] = (f, sql)
        return f

    return keep


def _files(spark: SparkSession, sf_dir: str) -> str:
    """Two-channel 16-bit files <track_id>.wav, from pairs of vectors."""
    folder = scratch(spark, "wav")
    frames = emb2(spark, sf_dir)
    wav.write_wav(tables.pack(frames, 16), channels.track_info(frames, RATE), folder, 16)
    return folder


def _named(df: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Track ids of a read are hashes of paths; the file's name has the id that was written."""
    names = wav.read_wav_catalog(spark, folder).select("track_id", F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("name"))
    return df.join(names, "track_id").drop("track_id").withColumnRenamed("name", "track_id")


_TRACKS = f"WITH {EMB2} SELECT track_id, 1000.0::DOUBLE AS sample_rate, CAST(count(DISTINCT channel) AS INTEGER) AS num_channels, max(frame) + 1 AS num_frames, (max(frame) + 1) / 1000.0 AS duration_s, 'int16' AS file_dtype FROM emb2 GROUP BY track_id"
_PCM = "CAST(round_even(greatest(-1.0, least(1.0, value)) * 32767, 0) AS INTEGER)"


@query("s1_wav_catalog", _TRACKS)
def s1_wav_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = wav.read_wav_catalog(spark, _files(spark, sf_dir))
    return catalog.select(F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("track_id"), "sample_rate", "num_channels", "num_frames", "duration_s", "file_dtype")


@query("s2_s5_wav_round_trip", value_sql(EMB2, f"SELECT track_id, channel, frame, {_PCM} / 32767.0::DOUBLE AS v FROM emb2"))
def s2_s5_wav_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _files(spark, sf_dir)
    return frames_out(_named(tables.unpack(wav.read_wav(spark, folder, 24)), spark, folder))


@query("s2_wav_files", ALL["s2_s5_wav_round_trip"][1])
def s2_wav_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files by a table of their names, which Spark lists."""
    folder = _files(spark, sf_dir)
    return frames_out(_named(tables.unpack(wav.read_wav_files(wav.listed(spark, folder), 24)), spark, folder))


@query("t1_stream_wav", value_sql(EMB2, f"SELECT track_id, channel, frame, {_PCM} / 32767.0::DOUBLE * pow(10, -3.3 / 20) AS v FROM emb2"))
def t1_stream_wav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as a stream, through an effect, to files, which are read back."""
    folder, out, state = _files(spark, sf_dir), scratch(spark, "wav-out"), scratch(spark, "wav-state")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, stateful.ROCKSDB)
    try:
        made = stateful.stream_effects(_named(wav.stream_wav(spark, folder, 24), spark, folder), [fx.Gain(-3.3)], RATE)
        wav.stream_to_wav(made, out, state, RATE, 64, floating=True).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    names = wav.read_wav_catalog(spark, out).select("track_id", F.regexp_extract("path", r"(\d+)/(\d+)\.wav$", 1).cast("long").alias("name"), F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("first"))
    back = tables.unpack(wav.read_wav_files(wav.listed(spark, out), 24)).join(names, "track_id")
    return frames_out(back.select(F.col("name").alias("track_id"), "channel", (F.col("frame") + F.col("first")).alias("frame"), "value"))


@query("s3_wav_raw", f"WITH {EMB2} SELECT track_id, channel, frame, {_PCM} AS pcm FROM emb2")
def s3_wav_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _files(spark, sf_dir)
    raw = wav.read_wav_raw(spark, folder, 24)
    frames = raw.select("track_id", "channel", "start_frame", F.posexplode("samples").alias("i", "pcm")).select("track_id", "channel", (F.col("start_frame") + F.col("i")).alias("frame"), "pcm")
    return _named(frames, spark, folder).select("track_id", "channel", "frame", "pcm")


@query("s4_encode_wav", f"WITH {LI} SELECT track_id, frame, CAST(round_even(greatest(-1.0, least(1.0, value)) * 8388607, 0) AS INTEGER) AS pcm, 44 + 3 * count(*) OVER (PARTITION BY track_id) AS bytes, hex('RIFF'::BLOB) AS mark FROM li")
def s4_encode_wav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of each coded file, read from its bytes."""
    chunks = li_chunks(spark, sf_dir)
    coded = wav.encode_wav(chunks, channels.track_info(tables.unpack(chunks), RATE), 24)
    size = F.length("content").cast("long")
    each = coded.select("track_id", "content", size.alias("bytes"), F.hex(F.substring("content", 1, 4)).alias("mark"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((size - 44) / 3) - 1)).alias("frame"))
    byte = lambda k: F.hex(F.substring(F.col("content"), (45 + 3 * F.col("frame") + k).cast("int"), F.lit(1)))
    unsigned = F.conv(F.concat(byte(2), byte(1), byte(0)), 16, 10).cast("int")
    return each.select("track_id", "frame", F.when(unsigned >= 1 << 23, unsigned - (1 << 24)).otherwise(unsigned).alias("pcm"), "bytes", "mark")


#: Blocks that one file of a stream holds, about.
BLOCKS_A_FILE = 20_000


def _files_of(rows: int, least: int) -> int:
    return max(least, math.ceil(rows / BLOCKS_A_FILE))


def _streamed(spark: SparkSession, df: DataFrame, transform, steps: int = 0) -> DataFrame:
    """df as a stream of files through `transform` to a table; the number of files grows with the rows. Settings are put back.

    Without steps, blocks come in any order, half of the files a trigger. With steps, the chunks are cut into so many ranges;
    each range is one trigger of several files, many tracks in each, and a track's blocks come in order from range to range.
    """
    provider, idle = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"
    before = {k: spark.conf.get(k) for k in (provider, idle)}
    source, out, state, held = (scratch(spark, f"stream-{x}") for x in ("in", "out", "state", "held"))

    def run(a_trigger: int | None) -> DataFrame:
        reader = spark.readStream.schema(df.schema)
        done = transform((reader.option("maxFilesPerTrigger", a_trigger) if a_trigger else reader).parquet(source))
        done.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start().awaitTermination()
        return done

    try:
        spark.conf.set(provider, stateful.ROCKSDB)
        if not steps:
            df.write.parquet(held)
            rows = spark.read.schema(df.schema).parquet(held)
            files = _files_of(rows.count(), 4)
            rows.repartition(files).write.parquet(source)
            done = run(math.ceil(files / 2))  # an odd number would take a third trigger, which goes through most states once more
        else:
            spark.conf.set(idle, "false")  # a batch without rows writes all state once more and puts nothing out
            n = (df.agg(F.max("chunk")).head()[0] or 0) + 1
            df.withColumn("__step__", F.floor(F.col("chunk") * steps / n).cast("int")).write.partitionBy("__step__").parquet(held)
            rows = spark.read.schema(df.withColumn("__step__", F.lit(0)).schema).parquet(held)
            for step in range(steps):
                part = rows.filter(F.col("__step__") == step).drop("__step__")
                part.repartition(_files_of(part.count(), 2), "track_id").write.mode("append").parquet(source)
                done = run(None)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(done.schema).parquet(out)


@query("t1_stream_effects", value_sql(EV, "SELECT track_id, channel, frame, tanh(0.5 * value * pow(10, 6.0 / 20) + 0.5 * coalesce(lag(value * pow(10, 6.0 / 20), 5) OVER (PARTITION BY track_id ORDER BY frame), 0)) AS v FROM ev"))
def t1_stream_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [fx.Gain(6.0), fx.Delay(0.005), fx.Distortion(0.0)]
    return frames_out(tables.unpack(_streamed(spark, ev_chunks(spark, sf_dir), lambda s: stateful.stream_effects(s, own, RATE))))


@query("t2_stream_resample", value_sql(EMB, local_sql(1000.0, 1600.0, _LINEAR, 0, 1, "emb")))
def t2_stream_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = emb_chunks(spark, sf_dir)
    ends = chunks.groupBy("track_id", "channel").agg((F.max("chunk") + 1).alias("chunk")).select("track_id", "channel", "chunk", F.lit(0).cast("long").alias("start_frame"), F.array().cast("array<double>").alias("samples"))
    return frames_out(tables.unpack(_streamed(spark, chunks.unionByName(ends), lambda s: stateful.stream_resample(s, 1000.0, 1600.0, "linear"))))


@query("t3_dropped_frames", f"WITH {EMB} SELECT track_id, max(frame) + 1 AS next_frame, CAST(sum(CASE WHEN (frame // 16 + track_id) % 4 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS dropped FROM emb GROUP BY track_id")
def t3_dropped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 16 frames, one in four of which is lost; each track ends with a mark, a block without samples, so a lost last block counts too."""
    whole = emb_chunks(spark, sf_dir)
    ends = whole.groupBy("track_id", "channel").agg(F.max(F.col("chunk") + 1).alias("chunk"), F.max(F.col("start_frame") + F.size("samples")).alias("start_frame")).withColumn("samples", F.array().cast("array<double>"))
    return lost_frames(spark, whole.filter("(chunk + track_id) % 4 <> 1").unionByName(ends))


def lost_frames(spark: SparkSession, sent: DataFrame) -> DataFrame:
    """track_id, next_frame, dropped of every track: next_frame is the end of the last block received. What is lost after that isn't
    counted, unless a mark follows: a block without samples at the track's end."""
    timed = sent.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("chunk")))
    got = _streamed(spark, timed, lambda s: stateful.dropped_frames(s, "1 hour"), steps=2)  # in order: a late block counts as lost
    return got.groupBy("track_id").agg(F.max("next_frame").alias("next_frame"), F.max("dropped").alias("dropped"))
