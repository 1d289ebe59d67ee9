"""The driver's tables as signals, in Spark and in SQL; the nominal sample rate is 1000 Hz."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleloom.operators.tables import FRAMES, frames_from_arrays, frames_from_rows, pack, tasks_of

RATE = 1000.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_from_rows(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], (F.col("value") - 50) / 500)


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_from_arrays(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def emb2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_from_arrays(read(spark, sf_dir, "embeddings"), F.floor(F.col("vec_id") / 2), "embedding", (F.col("vec_id") % 2).cast("int"))


def li(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    return frames_from_rows(rows, "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber"], F.col("l_discount") - 0.05, tasks=tasks_of(rows))


def emb_chunks(spark: SparkSession, sf_dir: str, n: int = 16) -> DataFrame:
    """Already packed arrays, cut into blocks without going through single frames."""
    from sampleloom.operators.tables import rechunk

    whole = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("track_id"), F.lit(0).alias("channel"), F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("start_frame"), F.col("embedding").cast("array<double>").alias("samples"))
    return rechunk(whole, n)


def li_chunks(spark: SparkSession, sf_dir: str, n: int = 128) -> DataFrame:
    return pack(li(spark, sf_dir), n)


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """params: at every 10th frame of ev a gain in dB of 0 to -4."""
    rows = frames_from_rows(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_id") % 5)
    return rows.filter("frame % 10 = 0").select("track_id", "frame", F.lit("gain_db").alias("name"), (-F.col("value")).alias("value"))


def midi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "event_id")
    first = e.groupBy("user_id").agg(F.min("ts").alias("first"))
    seconds = F.unix_micros("ts") / 1e6 - F.unix_micros("first") / 1e6
    message = F.encode(F.concat_ws(":", "event_type", F.floor("value").cast("string"), F.col("event_id").cast("string")), "utf-8")
    return e.join(first, "user_id").select(F.col("user_id").cast("long").alias("track_id"), seconds.alias("time_s"), message.alias("message"))


def rounded(df: DataFrame, *values: str, keys: list[str] | None = None) -> DataFrame:
    """Values to six places, without negative zero."""
    return df.select(*[F.col(c) if c not in values else (F.round(F.col(c), 6) + F.lit(0.0)).alias(c) for c in (keys or []) + [x for x in df.columns if x not in (keys or [])]])


def frames_out(df: DataFrame) -> DataFrame:
    return rounded(df.select(*[F.col(c.split()[0]) for c in FRAMES.split(", ")]), "value")


EV = "ev AS (SELECT CAST(user_id AS BIGINT) AS track_id, CAST(0 AS INTEGER) AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, (value - 50) / 500 AS value FROM events)"
EMB = "emb AS (SELECT CAST(vec_id AS BIGINT) AS track_id, CAST(0 AS INTEGER) AS channel, CAST(i - 1 AS BIGINT) AS frame, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"
EMB2 = f"{EMB}, emb2 AS (SELECT track_id // 2 AS track_id, CAST(track_id % 2 AS INTEGER) AS channel, frame, value FROM emb)"
LI = "li AS (SELECT CAST(l_suppkey AS BIGINT) AS track_id, CAST(0 AS INTEGER) AS channel, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS frame, l_discount - 0.05 AS value FROM lineitem)"
CURVE = "curve AS (SELECT CAST(user_id AS BIGINT) AS track_id, frame, -CAST(event_id % 5 AS DOUBLE) AS value FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events) WHERE frame % 10 = 0)"
MIDI = "midi AS (SELECT CAST(user_id AS BIGINT) AS track_id, epoch_us(ts) / 1e6 - epoch_us(min(ts) OVER (PARTITION BY user_id)) / 1e6 AS time_s, event_type || ':' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ':' || CAST(event_id AS VARCHAR) AS message FROM events)"


def value_sql(ctes: str, select: str, recursive: bool = False) -> str:
    """`select` gives track_id, channel, frame and v."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} SELECT track_id, channel, frame, round(v, 6) + 0.0 AS value FROM ({select})"
