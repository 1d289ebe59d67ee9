"""Queries on sources, layout, sample-wise effects and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sampleloom.functions import text, values
from sampleloom.jobs.signals import EMB, EMB2, EV, LI, RATE, emb, emb2, emb_chunks, ev, frames_out, li, read, rounded, value_sql
from sampleloom.operators import board, channels, joins, shift, tables
from sampleloom.kernels import effects as fx

ALL: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def keep(f):
        ALL[name] = (f, sql)
        return f

    return keep


# the flagship: rows -> signal -> gain -> delay -> levels
@query(
    "flagship_levels",
    f"""WITH {EV}, g AS (SELECT track_id, channel, frame, value * pow(10, -3.0 / 20) AS value FROM ev),
    d AS (SELECT track_id, channel, 0.5 * value + 0.5 * coalesce(lag(value, 5) OVER (PARTITION BY track_id, channel ORDER BY frame), 0) AS value FROM g)
    SELECT track_id, channel, round(max(abs(value)), 6) AS peak, round(sqrt(avg(value * value)), 6) AS rms, round(20 * log10(max(abs(value))), 6) + 0.0 AS peak_db, round(20 * log10(sqrt(avg(value * value))), 6) + 0.0 AS rms_db
    FROM d GROUP BY track_id, channel""",
)
def flagship_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    quieter = values.on_frames(ev(spark, sf_dir), lambda c: values.gain(c, -3.0))
    return rounded(channels.levels(shift.delay(quieter, RATE, 0.005)), "peak", "rms", "peak_db", "rms_db")


# sources
@query("s6_chunk_store", value_sql(EMB, "SELECT track_id, channel, frame, value AS v FROM emb"))
def s6_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sampleloom.sources.store import scratch

    path = scratch(spark, "chunks")
    tables.write_chunks(emb_chunks(spark, sf_dir), path)
    return frames_out(tables.unpack(tables.read_chunks(spark, path)))


@query("s7_frames_from_rows", value_sql(LI, "SELECT track_id, channel, frame, value AS v FROM li"))
def s7_frames_from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_out(li(spark, sf_dir))


@query("s7_frames_from_long_rows", value_sql(LI, "SELECT track_id, channel, frame, value AS v FROM li"))
def s7_frames_from_long_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every track in ranges of about 100 rows, so that one long track would be the work of many tasks."""
    rows = read(spark, sf_dir, "lineitem")
    return frames_out(tables.frames_from_long_rows(rows, "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber"], F.col("l_discount") - 0.05, range_rows=100))


@query(
    "s8_synth",
    """WITH s AS (SELECT CAST(s_suppkey AS BIGINT) AS track_id, 1000.0::DOUBLE AS rate, 0.05 + (s_suppkey % 4) * 0.05 AS seconds, 20.0 + s_suppkey % 7 AS hz FROM supplier),
    n AS (SELECT *, CAST(floor(seconds * rate) AS BIGINT) AS n FROM s), f AS (SELECT *, least(n // 2, CAST(floor(0.1 * rate) AS BIGINT)) AS m, unnest(range(0, n)) AS frame FROM n)
    SELECT track_id, CAST(0 AS INTEGER) AS channel, frame, round(sin(2 * pi() * hz * frame / rate) * CASE WHEN frame < m THEN frame / (m - 1) ELSE 1 END * CASE WHEN frame >= n - m THEN 1 - (frame - (n - m)) / (m - 1) ELSE 1 END, 6) + 0.0 AS value FROM f""",
)
def s8_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("track_id"), F.lit(1000.0).alias("sample_rate"), (0.05 + (F.col("s_suppkey") % 4) * 0.05).alias("seconds"), (20.0 + F.col("s_suppkey") % 7).alias("fundamental_hz")
    )
    return frames_out(tables.synth(spark, specs, "sine"))


_PATHS = "SELECT CAST(p_partkey AS BIGINT) AS track_id, 'take/' || p_partkey || ['.wav', '.WAV', '.gsm', '.xyz'][p_partkey % 4 + 1] AS path, CASE WHEN p_size % 2 = 0 THEN 8000.0 ELSE 44100.0 END::DOUBLE AS sample_rate FROM part"


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = read(spark, sf_dir, "part")
    extension = F.element_at(F.array(*map(F.lit, [".wav", ".WAV", ".gsm", ".xyz"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    tracks = part.select(F.col("p_partkey").cast("long").alias("track_id"), F.concat(F.lit("take/"), F.col("p_partkey").cast("string"), extension).alias("path"), F.when(F.col("p_size") % 2 == 0, 8000.0).otherwise(44100.0).alias("sample_rate"))
    formats = spark.createDataFrame([(".wav", None), (".gsm", 8000.0)], "extension string, only_rate double")
    return tracks, formats


_READABLE = "lower(path) LIKE '%.wav' OR (lower(path) LIKE '%.gsm' AND sample_rate = 8000)"


@query("s9_supported", f"SELECT * FROM ({_PATHS}) WHERE {_READABLE}")
def s9_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.supported(*_catalog(spark, sf_dir))


@query("s9_unsupported", f"SELECT * FROM ({_PATHS}) WHERE NOT ({_READABLE})")
def s9_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.unsupported(*_catalog(spark, sf_dir))


# layout
_PACKED = "SELECT track_id, channel, frame // {n} AS chunk, (frame // {n}) * {n} AS start_frame, count(*) AS n, round(sum(value * (frame % {n} + 1)), 6) + 0.0 AS checksum FROM {t} GROUP BY ALL"


def _checksums(chunks: DataFrame) -> DataFrame:
    """A block's length and the sum of its samples, weighted by place."""
    weighted = F.aggregate(F.transform("samples", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return chunks.select("track_id", "channel", "chunk", "start_frame", F.size("samples").cast("long").alias("n"), (F.round(weighted, 6) + 0.0).alias("checksum"))


@query("l1_pack", f"WITH {LI} {_PACKED.format(n=128, t='li')}")
def l1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checksums(tables.pack(li(spark, sf_dir), 128))


@query("l1_rechunk", f"WITH {LI} {_PACKED.format(n=50, t='li')}")
def l1_rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checksums(tables.rechunk(tables.pack(li(spark, sf_dir), 128), 50))


@query("l1_unpack", value_sql(LI, "SELECT track_id, channel, frame, value AS v FROM li"))
def l1_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_out(tables.unpack(tables.pack(li(spark, sf_dir), 100)))


@query("l2_deinterleave", value_sql(EMB, "SELECT track_id, CAST(frame % 4 AS INTEGER) AS channel, frame // 4 AS frame, value AS v FROM emb"))
def l2_deinterleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_out(tables.deinterleave(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track_id"), F.col("embedding").alias("samples")), 4))


@query("l2_interleave", f"WITH {EMB2} SELECT track_id, frame * 2 + channel AS place, round(value, 6) + 0.0 AS value FROM emb2")
def l2_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = tables.interleave(emb2(spark, sf_dir))
    return rounded(turned.select("track_id", F.posexplode("samples").alias("place", "value")).select("track_id", F.col("place").cast("long"), "value"), "value")


@query(
    "l3_detect_layout",
    """WITH s AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_size % 4 AS r, p_partkey % 5 AS c FROM part)
    SELECT id, CASE WHEN r = 0 AND c > 0 THEN 'interleaved' WHEN r > 0 AND c = 0 THEN 'planar' WHEN r = c AND r > 1 THEN NULL WHEN r <= c THEN 'planar' ELSE 'interleaved' END AS layout,
    CASE WHEN r = 2 AND c <> 2 THEN 'planar' WHEN c = 2 AND r <> 2 THEN 'interleaved' WHEN r = 0 AND c > 0 THEN 'interleaved' WHEN r > 0 AND c = 0 THEN 'planar' WHEN r = c AND r > 1 THEN NULL WHEN r <= c THEN 'planar' ELSE 'interleaved' END AS layout_of_two FROM s""",
)
def l3_detect_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, c = F.col("p_size") % 4, F.col("p_partkey") % 5
    return read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), values.detect_layout(r, c).alias("layout"), values.detect_layout(r, c, F.lit(2)).alias("layout_of_two"))


@query(
    "l4_l6_number_formats",
    f"""WITH {EV}, p AS (SELECT track_id, frame, CAST(round_even(greatest(-1.0, least(1.0, value * 3)) * 32767, 0) AS INTEGER) AS pcm16, CAST(round_even(greatest(-1.0, least(1.0, value * 3)) * 127, 0) AS INTEGER) AS pcm8 FROM ev)
    SELECT track_id, frame, pcm16, pcm8, round(pcm16 / 32767.0::DOUBLE, 6) + 0.0 AS from16, round(pcm8 / 127.0::DOUBLE, 6) + 0.0 AS from8, CAST(pcm16::BIGINT * 65536 AS INTEGER) AS wide16, pcm16 AS narrow16 FROM p""",
)
def l4_l6_number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    louder = F.col("value") * 3
    p = ev(spark, sf_dir).select("track_id", "frame", values.float_to_pcm(louder, 16).alias("pcm16"), values.float_to_pcm(louder, 8).alias("pcm8"))
    wide = p.withColumns({"from16": values.int_to_float("pcm16", 16), "from8": values.int_to_float("pcm8", 8), "wide16": values.widen_int("pcm16", 16)})
    return rounded(wide.withColumn("narrow16", values.narrow_int("wide16", 16)), "from16", "from8")


@query("l7_check_samples", value_sql(EV, "SELECT track_id, channel, frame, CAST(CAST(value AS FLOAT) AS DOUBLE) AS v FROM ev"))
def l7_check_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_out(values.check_samples(ev(spark, sf_dir)).withColumn("value", F.col("value").cast("double")))


@query("l8_read_window", value_sql(LI, "SELECT track_id, channel, frame, value AS v FROM li WHERE frame >= 100 AND frame < 420"))
def l8_read_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_out(tables.unpack(tables.read_window(tables.pack(li(spark, sf_dir), 128), 100, 320)))


@query(
    "l8_read_segments",
    f"""WITH {LI}, s AS (SELECT CAST(s_suppkey AS BIGINT) AS track_id, k AS seg_id, CAST((s_suppkey * 13) % 200 + k * 150 AS BIGINT) AS start, CAST(60 + k * 40 AS BIGINT) AS n FROM supplier, (SELECT unnest(range(0, 3)) AS k))
    SELECT track_id, CAST(seg_id AS INTEGER) AS seg_id, channel, frame - start AS frame, round(value, 6) + 0.0 AS value FROM li JOIN s USING (track_id) WHERE frame >= start AND frame < start + n""",
)
def l8_read_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("track_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seg_id"))
    s = s.select("track_id", "seg_id", ((F.col("track_id") * 13) % 200 + F.col("seg_id") * 150).alias("start"), (60 + F.col("seg_id") * 40).cast("long").alias("n"))
    return rounded(tables.read_segments(li(spark, sf_dir), s, 128), "value")


@query("l9_levels", f"WITH {EV} SELECT track_id, frame, round(pow(10, value * 40 / 20), 6) AS from_db, CASE WHEN abs(value) > 0 THEN round(20 * log10(abs(value)), 6) + 0.0 END AS to_db, round(pow(2, value * 24 / 12), 6) AS ratio FROM ev")
def l9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev(spark, sf_dir).select("track_id", "frame", values.db_to_gain(F.col("value") * 40).alias("from_db"), values.gain_to_db(F.abs("value")).alias("to_db"), values.semitones_to_ratio(F.col("value") * 24).alias("ratio")), "from_db", "to_db", "ratio")


@query(
    "l10_unit_numbers",
    r"""WITH t AS (SELECT CAST(event_id AS BIGINT) AS id, CASE event_id % 5 WHEN 0 THEN CAST(value AS VARCHAR) || ' Hz' WHEN 1 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ' kHz' WHEN 2 THEN CAST(value AS VARCHAR) || ' %' WHEN 3 THEN event_type ELSE ' ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ' dB x' END AS txt FROM events),
    p AS (SELECT id, txt, CASE WHEN lower(txt) LIKE '%khz' THEN CAST(CAST(trim(regexp_replace(txt, '(?i)khz$', '')) AS DOUBLE) * 1000 AS VARCHAR) ELSE regexp_replace(trim(txt), '(?i)(\s*(seconds|dbtp|sec|hz|ms|db|x|%|\*|,|\.))+$', '') END AS number_text FROM t)
    SELECT id, number_text, regexp_full_match(number_text, '[+-]?[0-9]+\.?[0-9]*') AS is_number, TRY_CAST(number_text AS DOUBLE) AS number FROM p""",
)
def l10_unit_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, whole, kind = F.col("value").cast("string"), F.floor("value").cast("string"), F.col("event_id") % 5
    txt = F.when(kind == 0, F.concat(v, F.lit(" Hz"))).when(kind == 1, F.concat(whole, F.lit(" kHz"))).when(kind == 2, F.concat(v, F.lit(" %"))).when(kind == 3, F.col("event_type")).otherwise(F.concat(F.lit(" "), whole, F.lit(" dB x")))
    t = read(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("id"), txt.alias("txt"))
    return t.select("id", text.parse_unit_number("txt").alias("number_text"), text.looks_like_number("txt").alias("is_number"), text.number_of("txt").alias("number"))


@query(
    "l11_normalize_name",
    r"""SELECT CAST(p_partkey AS BIGINT) AS id, trim(regexp_replace(replace(lower(trim(p_name)), '#', '_sharp'), '[^a-z0-9]+', '_', 'g'), '_') AS name,
    trim(regexp_replace(replace(lower(trim(p_name || ' #' || p_size)), '#', '_sharp'), '[^a-z0-9]+', '_', 'g'), '_') AS sized FROM part""",
)
def l11_normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), text.normalize_name("p_name").alias("name"), text.normalize_name(F.concat(F.col("p_name"), F.lit(" #"), F.col("p_size").cast("string"))).alias("sized"))


# sample-wise effects
_WISE = {
    "e1_gain": (fx.Gain(-4.5), "value * pow(10, -4.5 / 20)"),
    "e2_invert": (fx.Invert(), "-value"),
    "e3_clipping": (fx.Clipping(-14.0), "greatest(-pow(10, -14.0 / 20), least(pow(10, -14.0 / 20), value))"),
    "e4_distortion": (fx.Distortion(25.0), "tanh(value * pow(10, 25.0 / 20))"),
    "e5_bitcrush": (fx.Bitcrush(6.5), "round_even(value * pow(2, 6.5), 0) / pow(2, 6.5)"),
}
for _name, (_effect, _sql) in _WISE.items():
    ALL[_name] = (lambda spark, sf_dir, e=_effect: frames_out(values.on_frames(li(spark, sf_dir), lambda c: board.sample_wise([e], c))), value_sql(LI, f"SELECT track_id, channel, frame, {_sql} AS v FROM li"))


# aggregates
@query("a1_to_mono", value_sql(EMB2, "SELECT track_id, CAST(0 AS INTEGER) AS channel, frame, avg(value) AS v FROM emb2 GROUP BY track_id, frame"))
def a1_to_mono(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_out(channels.to_mono(emb2(spark, sf_dir)))


@query("a1_mono_kept", value_sql(EMB2, "SELECT track_id, channel, frame, avg(value) OVER (PARTITION BY track_id, frame) AS v FROM emb2"))
def a1_mono_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_out(channels.to_mono(emb2(spark, sf_dir), keep_channels=True))


@query("a2_mix", value_sql(EV, "SELECT track_id, channel, frame, value + value * pow(10, -6.0 / 20) + tanh(value * pow(10, 10.0 / 20)) AS v FROM ev WHERE frame < 40"))
def a2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    dry = ev(spark, sf_dir)
    quiet = values.on_frames(dry, lambda c: values.gain(c, -6.0))
    short = values.on_frames(dry.filter("frame < 40"), lambda c: values.distortion(c, 10.0))
    return frames_out(channels.mix([None, quiet, short], dry))


@query("a1_mono_chunks", ALL["a1_to_mono"][1])
def a1_mono_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_out(tables.unpack(channels.to_mono_chunks(tables.pack(emb2(spark, sf_dir), 16))))


@query("a1_mono_kept_chunks", ALL["a1_mono_kept"][1])
def a1_mono_kept_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_out(tables.unpack(channels.to_mono_chunks(tables.pack(emb2(spark, sf_dir), 16), keep_channels=True)))


@query("a2_mix_chunks", ALL["a2_mix"][1])
def a2_mix_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    dry = tables.pack(ev(spark, sf_dir), 8)
    quiet = values.on_chunks(dry, lambda c: values.gain(c, -6.0))
    short = values.on_chunks(dry.filter("start_frame < 40"), lambda c: values.distortion(c, 10.0))
    return frames_out(tables.unpack(channels.mix_chunks([None, quiet, short], dry)))


@query("a3_levels", f"WITH {LI} SELECT track_id, channel, round(max(abs(value)), 6) AS peak, round(sqrt(avg(value * value)), 6) AS rms, round(20 * log10(max(abs(value))), 6) + 0.0 AS peak_db, round(20 * log10(sqrt(avg(value * value))), 6) + 0.0 AS rms_db FROM li GROUP BY track_id, channel")
def a3_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(channels.levels(li(spark, sf_dir)), "peak", "rms", "peak_db", "rms_db")


@query("a4_track_info", f"WITH {EMB2} SELECT track_id, 1000.0::DOUBLE AS sample_rate, CAST(count(DISTINCT channel) AS INTEGER) AS num_channels, max(frame) + 1 AS num_frames, (max(frame) + 1) / 1000.0 AS duration_s FROM emb2 GROUP BY track_id")
def a4_track_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.track_info(emb2(spark, sf_dir), RATE)


@query(
    "a5_trim_silence",
    value_sql(
        EV + ", b AS (SELECT track_id, min(frame) FILTER (abs(value) >= pow(10, -1.0)) AS f, max(frame) FILTER (abs(value) >= pow(10, -1.0)) AS l FROM ev GROUP BY track_id)",
        "SELECT track_id, channel, frame - coalesce(f, 0) AS frame, CASE WHEN f IS NULL THEN 0 ELSE value END AS v FROM ev JOIN b USING (track_id) WHERE frame BETWEEN f AND l OR (f IS NULL AND frame = 0)",
    ),
)
def a5_trim_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_out(channels.trim_silence(ev(spark, sf_dir), -20.0))


@query(
    "a6_pad_trim_tail",
    value_sql(
        EV + ", n AS (SELECT track_id, max(frame) + 1 AS n FROM ev GROUP BY track_id)",
        """SELECT track_id, channel, frame, 0.5 * value + 0.5 * coalesce(lag(value, 5) OVER (PARTITION BY track_id ORDER BY frame), 0) AS v FROM (SELECT * FROM ev UNION ALL SELECT track_id, 0, n + k, 0.0 FROM n, (SELECT unnest(range(0, 32)) AS k))
        JOIN n USING (track_id) QUALIFY frame < n + 8""",
    ),
)
def a6_pad_trim_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    dry = ev(spark, sf_dir)
    lengths = dry.groupBy("track_id").agg((F.max("frame") + 1).alias("num_frames"))
    return frames_out(channels.trim_tail(shift.delay(channels.pad(dry, 32), RATE, 0.005), lengths, 8))


@query(
    "a7_normalise_energy",
    value_sql(EMB2 + ", e AS (SELECT track_id, max(e) AS e FROM (SELECT track_id, channel, sum(value * value) AS e FROM emb2 GROUP BY track_id, channel) GROUP BY track_id)", "SELECT track_id, channel, frame, value * CASE WHEN e < 1e-8 THEN 1 ELSE 0.125 / sqrt(e) END AS v FROM emb2 JOIN e USING (track_id)"),
)
def a7_normalise_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_out(channels.normalise_energy(emb2(spark, sf_dir)))


@query("o1_ordered", f"WITH {EMB2} SELECT track_id, channel, frame, round(value, 6) + 0.0 AS value, row_number() OVER (PARTITION BY track_id ORDER BY frame, channel) - 1 AS place FROM emb2")
def o1_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """place: where a row stands among its track's rows, as a writer would get them."""
    came = tables.ordered(emb2(spark, sf_dir)).withColumn("__at__", F.monotonically_increasing_id())
    placed = came.withColumn("place", F.row_number().over(Window.partitionBy("track_id").orderBy("__at__")).cast("long") - 1)
    return rounded(placed.select("track_id", "channel", "frame", "value", "place"), "value")


_KINDS = "s AS (SELECT CAST(s_suppkey AS BIGINT) AS track_id, 50 + (s_suppkey % 4) * 50 AS n FROM supplier), f AS (SELECT track_id, n, unnest(range(0, n)) AS frame FROM s)"


@query("s8_synth_ramp_impulse", value_sql(_KINDS, "SELECT track_id * 2 AS track_id, CAST(0 AS INTEGER) AS channel, frame, 3.0 * frame / (n - 1) AS v FROM f UNION ALL SELECT track_id * 2 + 1, 0, frame, CASE WHEN frame = 0 THEN 1.0 ELSE 0.0 END FROM f"))
def s8_synth_ramp_impulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("track_id"), F.lit(1000.0).alias("sample_rate"), ((50 + (F.col("s_suppkey") % 4) * 50) / 1000.0 + 1e-9).alias("seconds"), F.lit(1.0).alias("fundamental_hz"))
    each = lambda kind, k: tables.synth(spark, specs, kind).withColumn("track_id", F.col("track_id") * 2 + k)
    return frames_out(each("ramp", 0).unionByName(each("impulse", 1)))
