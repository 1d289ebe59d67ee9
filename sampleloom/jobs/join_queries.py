"""Queries on automation, presets, MIDI, parameter curves, pieces, and the batch form of stream levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleloom.functions import values
from sampleloom.jobs.signals import CURVE, EMB, EV, LI, MIDI, RATE, curve, emb, ev, frames_out, li, midi, read, rounded, value_sql
from sampleloom.operators import channels, joins, params, shift, tables
from sampleloom.operators import midi as midi_ops

ALL: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def keep(f):
        ALL[name] = (f, sql)
        return f

    return keep


@query("j1_automate", value_sql(f"{EV}, {CURVE}", "SELECT ev.track_id, ev.channel, ev.frame, ev.value * pow(10, coalesce(curve.value, 0) / 20) AS v FROM ev ASOF LEFT JOIN curve ON ev.track_id = curve.track_id AND ev.frame >= curve.frame"))
def j1_automate(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = joins.automate(ev(spark, sf_dir), curve(spark, sf_dir), 0.0, name="gain_db")
    return frames_out(held.withColumn("value", values.gain("value", F.col("param"))))


@query("j1_automate_chunks", ALL["j1_automate"][1])
def j1_automate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = joins.automate_chunks(tables.pack(ev(spark, sf_dir), 16), curve(spark, sf_dir), 0.0, 16, name="gain_db")
    return frames_out(tables.unpack(held.withColumn("samples", F.zip_with("samples", "param", values.gain)).drop("param")))


@query(
    "j1_automate_effects",
    value_sql(
        f"{EV}, {CURVE}, a AS (SELECT ev.*, coalesce(curve.value, 0) AS p FROM ev ASOF LEFT JOIN curve ON ev.track_id = curve.track_id AND ev.frame >= curve.frame)",
        "SELECT track_id, channel, frame, (1 + p / 4.7) * greatest(-pow(10, (p - 6) / 20), least(pow(10, (p - 6) / 20), value)) - p / 4.7 * round_even(tanh(value * pow(10, (10.3 + p) / 20)) * pow(2, 8 + p), 0) / pow(2, 8 + p) AS v FROM a",
    ),
)
def j1_automate_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipping threshold, drive, bit depth and mix from one curve."""
    held, p = joins.automate(ev(spark, sf_dir), curve(spark, sf_dir), 0.0, name="gain_db"), F.col("param")
    wet = values.bitcrush(values.distortion("value", p + 10.3), p + 8.0)
    return frames_out(held.withColumn("value", values.blend(values.clipping("value", p - 6.0), wet, -p / 4.7)))


def _presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = read(spark, sf_dir, "region")
    return region.select(F.col("r_regionkey").cast("int").alias("preset_id"), F.lit(0).alias("step"), F.lit("gain").alias("effect"), F.create_map(F.lit("gain_db"), (F.col("r_regionkey") * -3.0).cast("double")).alias("args"))


@query("j2_apply_presets", f"WITH {EMB} SELECT track_id, CAST(r_regionkey AS INTEGER) AS preset_id, channel, frame, round(value * pow(10, r_regionkey * -3.0 / 20), 6) + 0.0 AS value FROM emb CROSS JOIN region")
def j2_apply_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(joins.augment_gain(emb(spark, sf_dir), _presets(spark, sf_dir)), "value")


@query(
    "j3_midi_to_blocks",
    f"""WITH {MIDI}, f AS (SELECT track_id, CAST(floor(time_s / 1e4 * 1000) AS BIGINT) AS frame, message FROM midi)
    SELECT track_id, frame // 64 AS block, CAST(count(*) AS INTEGER) AS n, string_agg(frame % 64 || '=' || message, ' ' ORDER BY frame % 64, message) AS events FROM f WHERE frame < 200 * 1000 GROUP BY track_id, frame // 64""",
)
def j3_midi_to_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    faster = midi(spark, sf_dir).withColumn("time_s", F.col("time_s") / 1e4)
    blocks = midi_ops.midi_to_blocks(faster, 200.0, RATE, 64)
    said = F.array_join(F.transform("events", lambda e: F.concat(e["offset"].cast("string"), F.lit("="), F.decode(e["message"], "utf-8"))), " ")
    return blocks.select("track_id", "block", F.size("events").alias("n"), said.alias("events"))


@query(
    "j4_midi_delta_suspects",
    """WITH m AS (SELECT ascii(event_type) AS track_id, floor(value / 10) AS time_s FROM events), t AS (SELECT track_id, time_s, count(*) AS n FROM m GROUP BY ALL)
    SELECT CAST(track_id AS BIGINT) AS track_id, CAST(sum(n) AS BIGINT) AS num_events, count(*) AS num_times, max(n) AS most_at_once FROM t GROUP BY track_id HAVING sum(n) > 100 AND count(*) > 1 AND max(n) > 100""",
)
def j4_midi_delta_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "events").select(F.ascii("event_type").cast("long").alias("track_id"), F.floor(F.col("value") / 10).alias("time_s"))
    return midi_ops.midi_delta_suspects(m)


@query("j5_midi_normalise", "SELECT CAST(event_id AS BIGINT) AS id, upper(printf('%02x%02x%02x', 144 + user_id % 16, event_id % 128, CAST(floor(value) AS BIGINT) % 128)) AS message FROM events")
def j5_midi_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("id"), (144 + F.col("user_id") % 16).alias("status"), (F.col("event_id") % 128).alias("data1"), (F.floor("value") % 128).alias("data2"))
    return midi_ops.midi_normalise(rows).select("id", F.hex("message").alias("message"))


_SAMPLES = "SELECT 'user' || user_id % 20 AS param, event_id / 1e6 AS raw_value, CASE WHEN user_id % 2 = 0 THEN CAST((event_id // 700) % 4 * 5 AS VARCHAR) || ' dB' ELSE event_type END AS txt FROM events"


def _param_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    txt = F.when(F.col("user_id") % 2 == 0, F.concat((F.floor(F.col("event_id") / 700) % 4 * 5).cast("string"), F.lit(" dB"))).otherwise(F.col("event_type"))
    return read(spark, sf_dir, "events").select(F.concat(F.lit("user"), (F.col("user_id") % 20).cast("string")).alias("param"), (F.col("event_id") / 1e6).alias("raw_value"), txt.alias("text"))


_RANGES = f"""s AS ({_SAMPLES}), c AS (SELECT *, CASE WHEN txt = lag(txt) OVER (PARTITION BY param ORDER BY raw_value) THEN 0 ELSE 1 END AS new FROM s), r AS (SELECT *, sum(new) OVER (PARTITION BY param ORDER BY raw_value) AS run FROM c),
    g AS (SELECT param, run, min(raw_value) AS lo, min(txt) AS txt FROM r GROUP BY param, run), ranges AS (SELECT param, CASE WHEN run = 1 THEN 0 ELSE lo END AS lo, coalesce(lead(lo) OVER (PARTITION BY param ORDER BY run), 1) AS hi, txt FROM g)"""


@query("l12_param_ranges", f"WITH {_RANGES} SELECT param, round(lo, 6) AS lo, round(hi, 6) AS hi, txt AS text FROM ranges")
def l12_param_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(params.param_ranges(_param_samples(spark, sf_dir)), "lo", "hi")


@query(
    "l12_param_steps",
    f"""WITH {_RANGES}, n AS (SELECT param, TRY_CAST(replace(txt, ' dB', '') AS DOUBLE) AS v FROM ranges), d AS (SELECT param, v, round(abs(lead(v) OVER (PARTITION BY param ORDER BY v) - v), 8) AS gap FROM n)
    SELECT param, min(v) AS min_value, max(v) AS max_value, round(avg(DISTINCT gap), 6) AS step_size FROM d GROUP BY param HAVING count(*) = count(v)""",
)
def l12_param_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(params.param_steps(params.param_ranges(_param_samples(spark, sf_dir))), "step_size")


_STEPS = LI + ", p AS (SELECT track_id, frame, floor(value * 20) AS value FROM li)"


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return li(spark, sf_dir).select("track_id", "frame", F.floor(F.col("value") * 20).cast("double").alias("value"))


@query(
    "w1_param_runs",
    f"""WITH {_STEPS}, c AS (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY track_id ORDER BY frame) THEN 0 ELSE 1 END AS new FROM p), r AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY frame) AS run FROM c)
    SELECT track_id, min(frame) AS start, count(*) AS n, min(value) AS value FROM r GROUP BY track_id, run""",
)
def w1_param_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return params.param_runs(_steps(spark, sf_dir))


@query(
    "w1_param_segments",
    f"""WITH RECURSIVE {_STEPS}, m AS (SELECT a.track_id, a.frame, a.value, (SELECT min(b.frame) FROM p b WHERE b.track_id = a.track_id AND b.frame > a.frame AND b.value <> a.value) AS change, max(a.frame) OVER (PARTITION BY a.track_id) + 1 AS total FROM p a),
    k AS (SELECT track_id, frame, value, total, least(greatest(32, least(100, coalesce(change, total) - frame)), total - frame) AS n FROM m),
    w AS (SELECT track_id, 0 AS seg_id, frame AS start, n, value FROM k WHERE frame = 0 UNION ALL SELECT k.track_id, w.seg_id + 1, k.frame, k.n, k.value FROM w JOIN k ON k.track_id = w.track_id AND k.frame = w.start + w.n)
    SELECT track_id, CAST(seg_id AS INTEGER) AS seg_id, start, CAST(n AS BIGINT) AS n, value FROM w""",
)
def w1_param_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return params.param_segments(_steps(spark, sf_dir), 32, 100)


@query("w2_blend", value_sql(EV, "SELECT track_id, channel, frame, 0.65 * value + 0.35 * tanh(value * pow(10, 15.0 / 20)) AS v FROM ev"))
def w2_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    dry = ev(spark, sf_dir)
    return frames_out(joins.blend_tables(dry, values.on_frames(dry, lambda c: values.distortion(c, 15.0)), 0.35))


@query("w2_blend_chunks", ALL["w2_blend"][1])
def w2_blend_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    dry = tables.pack(ev(spark, sf_dir), 16)
    return frames_out(tables.unpack(joins.blend_chunks(dry, values.on_chunks(dry, lambda c: values.distortion(c, 15.0)), 0.35)))


@query(
    "u1_concat_tracks",
    value_sql(
        EV + ", n AS (SELECT track_id, max(frame) + 1 AS n FROM ev GROUP BY track_id), o AS (SELECT track_id, track_id % 10 AS target, coalesce(sum(n) OVER (PARTITION BY track_id % 10 ORDER BY track_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM n)",
        "SELECT target AS track_id, channel, CAST(frame + off AS BIGINT) AS frame, value AS v FROM ev JOIN o USING (track_id)",
    ),
)
def u1_concat_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = ev(spark, sf_dir)
    order = pieces.select("track_id").distinct().select("track_id", (F.col("track_id") % 10).alias("target_id"), F.col("track_id").alias("position"))
    return frames_out(joins.concat_tracks(pieces, order, channels.track_info(pieces, RATE)))


@query(
    "t4_block_levels",
    """SELECT CAST(user_id AS BIGINT) AS track_id, time_bucket(INTERVAL 1 DAY, ts) AS block_start, round(max(abs((value - 50) / 500)), 6) AS peak, round(sqrt(avg(pow((value - 50) / 500, 2))), 6) AS rms FROM events GROUP BY ALL""",
)
def t4_block_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sampleloom.streaming.levels import block_levels

    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("track_id"), "ts", ((F.col("value") - 50) / 500).alias("value"))
    return rounded(block_levels(rows, "1 day"), "peak", "rms")
