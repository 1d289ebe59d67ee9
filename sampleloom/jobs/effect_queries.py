"""Queries on delays, filters, dynamics, modulation, space, resampling and boards."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleloom.functions import values
from sampleloom.jobs.signals import CURVE, EMB, EMB2, EV, LI, RATE, curve, emb, emb2, emb_chunks, ev, frames_out, li, li_chunks, read, rounded, value_sql
from sampleloom.kernels import effects as fx
from sampleloom.kernels import linear, sinc
from sampleloom.operators import automation, board, channels, filters, resample, responses, scan, shift, stretch, tables
from sampleloom.sources.store import scratch

ALL: dict[str, tuple] = {}
BLOCK = 16


def query(name: str, sql: str | None):
    def keep(f):
        ALL[name] = (f, sql)
        return f

    return keep


def ev_chunks(spark: SparkSession, sf_dir: str, n: int = BLOCK) -> DataFrame:
    return tables.pack(ev(spark, sf_dir), n)


def out(chunks: DataFrame) -> DataFrame:
    return frames_out(tables.unpack(chunks))


# delays and shifts
@query("d1_delay", value_sql(LI, "SELECT track_id, channel, frame, 0.7 * value + 0.3 * coalesce(lag(value, 12) OVER (PARTITION BY track_id ORDER BY frame), 0) AS v FROM li"))
def d1_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_out(shift.delay(li(spark, sf_dir), RATE, 0.012, mix=0.3))


_ECHO = f"""{EV}, line AS (SELECT track_id, channel, frame, value, value AS held, 0.0::DOUBLE AS late FROM ev WHERE frame < 5
    UNION ALL SELECT e.track_id, e.channel, e.frame, e.value, e.value + 0.6 * l.held, l.held FROM line l JOIN ev e ON e.track_id = l.track_id AND e.frame = l.frame + 5)"""


@query("d2_feedback_delay", value_sql(_ECHO, "SELECT track_id, channel, frame, 0.5 * value + 0.5 * late AS v FROM line", recursive=True))
def d2_feedback_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_out(shift.delay(ev(spark, sf_dir), RATE, 0.005, feedback=0.6))


_FULL = _ECHO.replace("0.6 *", "1.0 *")


@query("d2_full_feedback", value_sql(_FULL, "SELECT track_id, channel, frame, 0.5 * value + 0.5 * late AS v FROM line", recursive=True))
def d2_full_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Echoes that never fade."""
    return frames_out(shift.delay(ev(spark, sf_dir), RATE, 0.005, feedback=1.0))


@query("d2_delay_kernel", value_sql(_ECHO, "SELECT track_id, channel, frame, 0.5 * value + 0.5 * late AS v FROM line", recursive=True))
def d2_delay_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(board.apply_effects(ev_chunks(spark, sf_dir), [fx.Delay(0.005, 0.6, 0.5)], RATE))


@query("d3_shift", value_sql(LI, "SELECT track_id, channel, frame, coalesce(lag(value, 7) OVER (PARTITION BY track_id ORDER BY frame), 0) AS v FROM li"))
def d3_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_out(shift.shift(li(spark, sf_dir), 7))


@query("d3_align", value_sql(EV, "SELECT track_id, channel, frame, 2 * coalesce(lag(value, 7) OVER (PARTITION BY track_id ORDER BY frame), 0) AS v FROM ev"))
def d3_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    dry = ev(spark, sf_dir)
    return frames_out(channels.mix(shift.align([(dry, 0), (shift.shift(dry, 7), 7)]), dry))


# linear filters, against the recurrence


def recurrence(own: linear.Filter) -> str:
    b, a = (*own.b, 0.0)[:3], (*own.a, 0.0)[:2]
    y = f"{b[0]!r} * {{x}}"
    return f"""{EV}, r AS (SELECT track_id, channel, frame, value AS x1, 0.0::DOUBLE AS x2, {y.format(x='value')} AS y1, 0.0::DOUBLE AS y2 FROM ev WHERE frame = 0
    UNION ALL SELECT e.track_id, e.channel, e.frame, e.value, r.x1, {y.format(x='e.value')} + {b[1]!r} * r.x1 + {b[2]!r} * r.x2 - {a[0]!r} * r.y1 - {a[1]!r} * r.y2, r.y1
    FROM r JOIN ev e ON e.track_id = r.track_id AND e.frame = r.frame + 1)"""


_FILTERS = {
    "f1_lowpass": (linear.lowpass(RATE, 80.0), lambda c: filters.lowpass(c, RATE, 80.0)),
    "f2_highpass": (linear.highpass(RATE, 80.0), lambda c: filters.highpass(c, RATE, 80.0)),
    "f3_high_shelf": (linear.high_shelf(RATE, 150.0, 6.0), lambda c: filters.high_shelf(c, RATE, cutoff_frequency_hz=150.0, gain_db=6.0)),
    "f4_low_shelf": (linear.low_shelf(RATE, 150.0, -6.0), lambda c: filters.low_shelf(c, RATE, cutoff_frequency_hz=150.0, gain_db=-6.0)),
    "f5_peak_filter": (linear.peak(RATE, 120.0, 9.0, 1.5), lambda c: filters.peak_filter(c, RATE, cutoff_frequency_hz=120.0, gain_db=9.0, q=1.5)),
}
for _name, (_filter, _apply) in _FILTERS.items():
    ALL[_name] = (lambda spark, sf_dir, f=_apply: out(f(ev_chunks(spark, sf_dir))), value_sql(recurrence(_filter), "SELECT track_id, channel, frame, y1 AS v FROM r", recursive=True))


def steps(base: str, *columns: tuple[str, str]) -> str:
    """base with columns that build on each other, one after the other."""
    for name, value in columns:
        base = f"SELECT *, {value} AS {name} FROM ({base})"
    return base


def recursion(source: str, state: str, fresh: str, columns: list[tuple[str, str]], keep: str) -> str:
    """r(track_id, frame, <state>): a recurrence over the frames of source(track_id, frame, ...); frame -1 is the fresh state."""
    own = ", ".join(f"r.{c}" for c in state.split(", "))
    base = f"SELECT r.track_id AS track_id, x.frame AS frame, {own}, x.* EXCLUDE (track_id, frame) FROM r JOIN {source} x ON x.track_id = r.track_id AND x.frame = r.frame + 1"
    return f"r({'track_id, frame, ' + state}) AS (SELECT DISTINCT track_id, CAST(-1 AS BIGINT), {fresh} FROM {source} UNION ALL SELECT track_id, frame, {keep} FROM ({steps(base, *columns)}))"


_G = 1 - math.exp(-2 * math.pi * 120.0 / RATE)
_LADDER = [
    ("u", "tanh(1.5 * value) - 1.6 * (tanh(e) - 0.5 * tanh(1.5 * value))"), ("a2", f"a + {_G!r} * (tanh(u) - tanh(a))"), ("b2", f"b + {_G!r} * (tanh(a2) - tanh(b))"),
    ("d2", f"d + {_G!r} * (tanh(b2) - tanh(d))"), ("e2", f"e + {_G!r} * (tanh(d2) - tanh(e))"),
]


@query("f6_ladder", value_sql(f"{LI}, {recursion('li', 'a, b, d, e', '0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE', _LADDER, 'a2, b2, d2, e2')}", "SELECT track_id, CAST(0 AS INTEGER) AS channel, frame, e AS v FROM r WHERE frame >= 0", recursive=True))
def f6_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(board.apply_effects(li_chunks(spark, sf_dir), [fx.LadderFilter("LPF24", 120.0, 0.4, 1.5)], RATE))


def impulse(spark: SparkSession, sf_dir: str, n: int = 16) -> np.ndarray:
    """The first n values of one vector, a parameter of fixed size."""
    return np.array(read(spark, sf_dir, "embeddings").filter("vec_id = 0").select(F.slice("embedding", 1, n)).head()[0], float)


@query(
    "f7_convolve",
    value_sql(
        LI + ", ir AS (SELECT i - 1 AS k, CAST(embedding[i] AS DOUBLE) AS h FROM (SELECT embedding, unnest(range(1, 17)) AS i FROM embeddings WHERE vec_id = 0)), g AS (SELECT 0.125 / sqrt(sum(h * h)) AS g FROM ir)",
        "SELECT x.track_id, x.channel, x.frame, 0.25 * x.value + 0.75 * sum(g * h * y.value) AS v FROM li x CROSS JOIN g CROSS JOIN ir JOIN li y ON y.track_id = x.track_id AND y.frame = x.frame - k GROUP BY x.track_id, x.channel, x.frame, x.value",
    ),
)
def f7_convolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(filters.convolve(li_chunks(spark, sf_dir), RATE, impulse(spark, sf_dir), RATE, mix=0.75))


_MANY = f"""{LI}, r AS (SELECT CAST(vec_id AS BIGINT) AS response_id, i - 1 AS k, CAST(embedding[i] AS DOUBLE) AS h FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)),
    g AS (SELECT response_id, 0.125 / sqrt(sum(h * h)) AS g FROM r GROUP BY response_id), t AS (SELECT DISTINCT track_id FROM li),
    c AS (SELECT track_id, track_id * 7 % (SELECT count(*) FROM embeddings) AS response_id, 0.75 AS mix FROM t UNION SELECT track_id, track_id * 3 % (SELECT count(*) FROM embeddings), 0.4 FROM t), u AS (SELECT track_id, response_id, max(mix) AS mix FROM c GROUP BY ALL)"""


@query(
    "f7_convolve_responses",
    f"""WITH {_MANY}, v AS (SELECT x.track_id, u.response_id, x.channel, x.frame, (1 - u.mix) * x.value + u.mix * sum(g * h * y.value) AS v FROM u JOIN li x USING (track_id) JOIN g ON g.response_id = u.response_id JOIN r ON r.response_id = u.response_id
    JOIN li y ON y.track_id = x.track_id AND y.frame = x.frame - r.k GROUP BY x.track_id, u.response_id, u.mix, x.channel, x.frame, x.value)
    SELECT track_id, response_id, channel, frame, round(v, 6) + 0.0 AS value FROM v""",
)
def f7_convolve_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two responses a track, of as many as there are vectors."""
    vectors = read(spark, sf_dir, "embeddings")
    blocks = vectors.select(F.col("vec_id").alias("response_id"), F.lit(0).alias("channel"), F.lit(0).alias("chunk"), F.lit(0).alias("start_frame"), F.col("embedding").alias("samples"))
    tracks, n = li(spark, sf_dir).select("track_id").distinct(), vectors.count()
    chosen = tracks.select("track_id", (F.col("track_id") * 7 % n).alias("response_id"), F.lit(0.75).alias("mix")).unionByName(tracks.select("track_id", (F.col("track_id") * 3 % n).alias("response_id"), F.lit(0.4).alias("mix")))
    made = responses.convolve_with(li_chunks(spark, sf_dir), responses.prepare_responses(blocks, RATE, RATE), chosen)
    frames = made.select("track_id", "response_id", "channel", "start_frame", F.posexplode("samples").alias("i", "value"))
    return rounded(frames.select("track_id", "response_id", "channel", (F.col("start_frame") + F.col("i")).cast("long").alias("frame"), "value"), "value")


# dynamics, against the recurrence of the envelope


def follower(attack: float, release: float, source: str, name: str, value: str = "value") -> str:
    a, r = fx.smoothing(RATE, attack), fx.smoothing(RATE, release)
    step = f"abs(s.{value}) + CASE WHEN abs(s.{value}) > p.e THEN {a!r} ELSE {r!r} END * (p.e - abs(s.{value}))"
    return f"""{name} AS (SELECT s.track_id, s.channel, s.frame, s.{value} AS x, abs(s.{value}) + CASE WHEN abs(s.{value}) > 0 THEN {a!r} ELSE {r!r} END * (0 - abs(s.{value})) AS e FROM {source} s WHERE s.frame = 0
    UNION ALL SELECT s.track_id, s.channel, s.frame, s.{value}, {step} FROM {name} p JOIN {source} s ON s.track_id = p.track_id AND s.frame = p.frame + 1)"""


def compressed(threshold_db: float, ratio: float, source: str) -> str:
    t = 10 ** (threshold_db / 20)
    return f"SELECT track_id, channel, frame, x * CASE WHEN e > {t!r} THEN pow(e / {t!r}, {1 / ratio - 1!r}) ELSE 1 END AS v FROM {source}"


@query("y1_compressor", value_sql(f"{EV}, {follower(2.0, 50.0, 'ev', 'c')}", compressed(-20.0, 4.0, "c"), recursive=True))
def y1_compressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(board.apply_effects(ev_chunks(spark, sf_dir), [fx.Compressor(-20.0, 4.0, 2.0, 50.0)], RATE))


@query(
    "y2_limiter",
    value_sql(
        f"{EV}, {follower(2.0, 200.0, 'ev', 'c')}, first AS ({compressed(-10.0, 4.0, 'c')}), {follower(0.001, 60.0, 'first', 'd', 'v')}, second AS ({compressed(-14.0, 1000.0, 'd')})",
        "SELECT track_id, channel, frame, greatest(-1.0, least(1.0, v)) AS v FROM second",
        recursive=True,
    ),
)
def y2_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(board.apply_effects(ev_chunks(spark, sf_dir), [fx.Limiter(-14.0, 60.0)], RATE))


@query(
    "y3_noise_gate",
    value_sql(f"{EV}, {follower(2.0, 30.0, 'ev', 'c')}", f"SELECT track_id, channel, frame, x * CASE WHEN e < {10 ** (-12 / 20)!r} THEN pow(e / {10 ** (-12 / 20)!r}, 3.0) ELSE 1 END AS v FROM c", recursive=True),
)
def y3_noise_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(board.apply_effects(ev_chunks(spark, sf_dir), [fx.NoiseGate(-12.0, 4.0, 2.0, 30.0)], RATE))


# the same along time: the blocks of a track by all tasks
@query("y1_compressor_scan", ALL["y1_compressor"][1])
def y1_compressor_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(scan.apply_along_time(ev_chunks(spark, sf_dir), [fx.Compressor(-20.0, 4.0, 2.0, 50.0)], RATE))


@query("y2_limiter_scan", ALL["y2_limiter"][1])
def y2_limiter_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(scan.apply_along_time(ev_chunks(spark, sf_dir), [fx.Limiter(-14.0, 60.0)], RATE))


@query("y3_noise_gate_scan", ALL["y3_noise_gate"][1])
def y3_noise_gate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(scan.apply_along_time(ev_chunks(spark, sf_dir), [fx.NoiseGate(-12.0, 4.0, 2.0, 30.0)], RATE))


@query("s6_bucketed_board", ALL["y1_compressor"][1])
def s6_bucketed_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compressor over a bucketed store, which is shuffled once, when it is written."""
    folder = scratch(spark, "store")
    name = "store_" + folder.rsplit("-", 1)[-1]
    tables.write_store(ev_chunks(spark, sf_dir), name, folder, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return out(board.apply_effects(tables.read_store(spark, name), [fx.Compressor(-20.0, 4.0, 2.0, 50.0)], RATE, stored=True))


# modulation and space
@query(
    "m1_chorus",
    value_sql(
        LI + f", l AS (SELECT track_id, list(value ORDER BY frame) AS xs FROM li GROUP BY track_id), q AS (SELECT *, frame - greatest(7.0 * (1 + 0.4 * sin(2 * {math.pi!r} * 3.0 * frame / 1000)), 0) AS pos FROM li)",
        "SELECT track_id, channel, frame, 0.6 * value + 0.4 * ((1 - (pos - floor(pos))) * CASE WHEN pos >= 0 THEN xs[CAST(floor(pos) AS BIGINT) + 1] ELSE 0 END + (pos - floor(pos)) * CASE WHEN pos >= -1 THEN xs[CAST(floor(pos) AS BIGINT) + 2] ELSE 0 END) AS v FROM q JOIN l USING (track_id)",
    ),
)
def m1_chorus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(board.apply_effects(li_chunks(spark, sf_dir), [fx.Chorus(3.0, 0.4, 7.0, 0.0, 0.4)], RATE))


_SWUNG = [
    ("pos", f"frame - greatest(7.0 * (1 + 0.4 * sin(2 * {math.pi!r} * 3.0 * frame / 1000)), 0)"), ("low", "CAST(floor(pos) AS BIGINT)"),
    ("wet", "(1 - (pos - low)) * hist[16 - (frame - 1 - low)] + (pos - low) * hist[16 - (frame - 2 - low)]"), ("line", "hist[2:] || [value + 0.5 * wet]"),
]


@query("m1_chorus_feedback", value_sql(f"{LI}, {recursion('li', 'hist, v', 'list_transform(range(16), lambda i: 0.0::DOUBLE), 0.0::DOUBLE', _SWUNG, 'line, 0.6 * value + 0.4 * wet')}", "SELECT track_id, CAST(0 AS INTEGER) AS channel, frame, v FROM r WHERE frame >= 0", recursive=True))
def m1_chorus_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(board.apply_effects(li_chunks(spark, sf_dir), [fx.Chorus(3.0, 0.4, 7.0, 0.5, 0.4)], RATE))


_SWEPT = [("t", f"tan({math.pi!r} * greatest(1.0, least(490.0, 150.0 * (1 + 0.5 * sin(2 * {math.pi!r} * 2.0 * frame / 1000)))) / 1000)"), ("c", "(t - 1) / (t + 1)"), ("y0", "value + 0.3 * s6")]
_SWEPT += [(f"y{k}", f"c * y{k - 1} + s{k - 1} - c * s{k}") for k in range(1, 7)]


@query(
    "m2_phaser",
    value_sql(
        f"{LI}, {recursion('li', ', '.join(f's{k}' for k in range(7)) + ', v', ', '.join(['0.0::DOUBLE'] * 8), _SWEPT, ', '.join(f'y{k}' for k in range(7)) + ', 0.5 * value + 0.5 * y6')}",
        "SELECT track_id, CAST(0 AS INTEGER) AS channel, frame, v FROM r WHERE frame >= 0",
        recursive=True,
    ),
)
def m2_phaser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(board.apply_effects(li_chunks(spark, sf_dir), [fx.Phaser(2.0, 0.5, 150.0, 0.3, 0.5)], RATE))


@query("m2_phaser_scan", ALL["m2_phaser"][1])
def m2_phaser_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its blocks by all tasks, as maps of its seven values."""
    return out(scan.apply_along_time(li_chunks(spark, sf_dir), [fx.Phaser(2.0, 0.5, 150.0, 0.3, 0.5)], RATE))


def reverb_sql(own: fx.Reverb, curve_: str = "", wet_level: str = "") -> str:
    """The network on two-channel tracks: lines as lists, the next output first. `curve_` gives curve(track_id, frame, level), and `wet_level` an expression on it."""
    length = lambda n, side: max(1, int((n + side * own.SPREAD) * RATE / 44100))
    zeros = lambda lengths: "[" + ", ".join(f"list_transform(range({n}), lambda i: 0.0::DOUBLE)" for n in lengths) + "]"
    damp, feedback = own.damping * 0.4, own.room_size * 0.28 + 0.7
    fresh = [zeros([length(n, s) for s in (0, 1) for n in own.COMBS]), "list_transform(range(16), lambda i: 0.0::DOUBLE)", *[zeros([length(n, s) for s in (0, 1)]) for n in own.ALLPASSES], "[0.0::DOUBLE, 0.0]"]
    columns = [
        ("x", "(v0 + v1) * 0.015"), ("late", "list_transform(combs, lambda l: l[1])"), ("low2", f"list_transform(range(1, 17), lambda i: late[i] * {1 - damp!r} + low[i] * {damp!r})"),
        ("combs2", f"list_transform(range(1, 17), lambda i: combs[i][2:] || [x + {feedback!r} * low2[i]])"), ("w0", "[list_sum(late[1:8]), list_sum(late[9:16])]"),
    ]
    for k in range(1, 5):
        columns += [
            (f"l{k}", f"list_transform(p{k}, lambda l: l[1])"), (f"q{k}", f"list_transform([1, 2], lambda i: p{k}[i][2:] || [w{k - 1}[i] + 0.5 * l{k}[i]])"), (f"w{k}", f"list_transform([1, 2], lambda i: l{k}[i] - w{k - 1}[i])"),
        ]
    level, dry = wet_level or repr(own.wet_level), 2.0 * own.dry_level
    same, other = (f"(1.5 * {level} * {w!r})" for w in (1 + own.width, 1 - own.width))
    out = f"[{dry!r} * v0 + {same} * w4[1] + {other} * w4[2], {dry!r} * v1 + {same} * w4[2] + {other} * w4[1]]"
    pairs = "pairs AS (SELECT track_id, frame, max(CASE WHEN channel = 0 THEN value END) AS v0, max(CASE WHEN channel = 1 THEN value END) AS v1 FROM emb2 GROUP BY track_id, frame)"
    if curve_:
        pairs = pairs.replace("pairs AS", "own AS", 1) + f", curve AS ({curve_}), pairs AS (SELECT own.*, curve.level FROM own ASOF LEFT JOIN curve ON curve.track_id = own.track_id AND own.frame >= curve.frame)"
    ctes = f"{EMB2}, {pairs}, {recursion('pairs', 'combs, low, p1, p2, p3, p4, both_', ', '.join(fresh), columns, f'combs2, low2, q1, q2, q3, q4, {out}')}"
    return value_sql(ctes, "SELECT track_id, CAST(c AS INTEGER) AS channel, frame, both_[c + 1] AS v FROM r CROSS JOIN (VALUES (0), (1)) AS u(c) WHERE frame >= 0", recursive=True)


@query("m3_reverb", reverb_sql(fx.Reverb(0.6, 0.4)))
def m3_reverb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(board.apply_effects(tables.pack(emb2(spark, sf_dir), BLOCK), [fx.Reverb(0.6, 0.4)], RATE))


# effects with state whose parameters follow curves
_CURVED = f"{EV}, {CURVE}, a AS (SELECT ev.*, curve.value AS p FROM ev ASOF LEFT JOIN curve ON ev.track_id = curve.track_id AND ev.frame >= curve.frame)"


def _scaled(spark: SparkSession, sf_dir: str, times: float, plus: float) -> DataFrame:
    """The curve as another parameter's."""
    return curve(spark, sf_dir).withColumn("value", F.col("value") * times + plus)


_MOVING = [("t", f"tan({math.pi!r} * coalesce(p * -55.0 + 40.0, 90.0) / 1000)"), ("y", "t / (t + 1) * value + s"), ("s2", "t / (t + 1) * value - (t - 1) / (t + 1) * y")]


@query("j1_automate_lowpass", value_sql(f"{_CURVED}, {recursion('a', 's, v', '0.0::DOUBLE, 0.0::DOUBLE', _MOVING, 's2, y')}", "SELECT track_id, CAST(0 AS INTEGER) AS channel, frame, v FROM r WHERE frame >= 0", recursive=True))
def j1_automate_lowpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running filter's cutoff from 40 to 260 Hz."""
    return out(automation.apply_automated(ev_chunks(spark, sf_dir), [fx.LowpassFilter(90.0)], RATE, _scaled(spark, sf_dir, -55.0, 40.0), {(0, "cutoff_frequency_hz"): "gain_db"}))


@query(
    "j1_automate_compressor",
    value_sql(
        f"{_CURVED}, {follower(2.0, 50.0, 'ev', 'c')}, t AS (SELECT c.*, pow(10, coalesce(a.p * 5.3 - 3.1, -20.0) / 20) AS t FROM c JOIN a USING (track_id, frame))",
        f"SELECT track_id, channel, frame, x * CASE WHEN e > t THEN pow(e / t, {1 / 4.0 - 1!r}) ELSE 1 END AS v FROM t",
        recursive=True,
    ),
)
def j1_automate_compressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compressor's threshold, whose envelope goes on."""
    return out(automation.apply_automated(ev_chunks(spark, sf_dir), [fx.Compressor(-20.0, 4.0, 2.0, 50.0)], RATE, _scaled(spark, sf_dir, 5.3, -3.1), {(0, "threshold_db"): "gain_db"}))


_WET = "SELECT track_id, frame, least(1.0, abs(value) * 3.0) AS level FROM emb2 WHERE channel = 0 AND frame % 12 = 5"


@query("j1_automate_reverb", reverb_sql(fx.Reverb(0.6, 0.4), _WET, "coalesce(level, 0.33)"))
def j1_automate_reverb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reverb's wet level, which doesn't cut its tail."""
    frames = emb2(spark, sf_dir)
    wet = frames.filter("channel = 0 AND frame % 12 = 5").select("track_id", "frame", F.lit("wet").alias("name"), F.least(F.lit(1.0), F.abs("value") * 3.0).alias("value"))
    return out(automation.apply_automated(tables.pack(frames, BLOCK), [fx.Reverb(0.6, 0.4)], RATE, wet, {(0, "wet_level"): "wet"}))


# resampling


def local_sql(src: float, dst: float, terms: str, first: int, last: int, t: str = "li") -> str:
    joins = " ".join(f"LEFT JOIN {t} t{k - first} ON t{k - first}.track_id = q.track_id AND t{k - first}.frame = q.low + {k}" for k in range(first, last + 1))
    return f"""SELECT q.track_id, q.channel, q.j AS frame, {terms} AS v FROM (SELECT *, CAST(floor(p) AS BIGINT) AS low, p - floor(p) AS f FROM (SELECT *, j * {src!r}::DOUBLE / {dst!r}::DOUBLE AS p FROM
    (SELECT track_id, channel, unnest(range(0, CAST(floor(n * {dst!r}::DOUBLE / {src!r}::DOUBLE) AS BIGINT))) AS j FROM (SELECT track_id, channel, max(frame) + 1 AS n FROM {t} GROUP BY ALL)))) q {joins}"""


def _v(i: int) -> str:
    return f"coalesce(t{i}.value, 0)"


_LINEAR = f"(1 - f) * {_v(0)} + f * {_v(1)}"
_CUBIC = f"0.5 * (-f + 2 * f * f - f * f * f) * {_v(0)} + 0.5 * (2 - 5 * f * f + 3 * f * f * f) * {_v(1)} + 0.5 * (f + 4 * f * f - 3 * f * f * f) * {_v(2)} + 0.5 * (-f * f + f * f * f) * {_v(3)}"
_FIVE = " + ".join(_v(i) + "".join(f" * (f - ({k})) / {float(i - 2 - k)!r}" for k in range(-2, 3) if k != i - 2) for i in range(5))
_LOCAL = {"r1_zoh": ("zoh", 1000.0, 441.0, _v(0), 0, 0), "r2_linear": ("linear", 1000.0, 1600.0, _LINEAR, 0, 1), "r3_catmull_rom": ("catmull_rom", 1000.0, 735.0, _CUBIC, -1, 2), "r4_lagrange": ("lagrange", 1000.0, 1234.5, _FIVE, -2, 2)}
for _name, (_quality, _src, _dst, _terms, _first, _last) in _LOCAL.items():
    ALL[_name] = (lambda spark, sf_dir, q=_quality, s=_src, d=_dst: frames_out(resample.resample_to(li(spark, sf_dir), s, d, q)), value_sql(LI, local_sql(_src, _dst, _terms, _first, _last)))


@query("r2_linear_chunks", value_sql(LI, local_sql(1000.0, 1600.0, _LINEAR, 0, 1)))
def r2_linear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(board.resample_chunks(li_chunks(spark, sf_dir), 1000.0, 1600.0, "linear", 100))


def sinc_sql(src: float, dst: float, quality: str, t: str = "li", length: str | None = None) -> str:
    """`length` is that of n input frames, where it isn't the usual one. The windowed sinc from its definition: a table of PRECISION points a crossing (the Bessel function by its series), read between two points."""
    k, n = sinc.Resampler(src, dst, quality), sinc.crossings(quality)
    last, beta = n * sinc.PRECISION, sinc.BETAS.get(n, 8.0)
    bessel = lambda z: f"list_sum(list_transform(range(33), lambda k: pow(({z}) * ({z}) / 4, k) / pow(CAST(factorial(CAST(k AS INTEGER)) AS DOUBLE), 2)))"
    x = f"(i / {sinc.PRECISION}.0::DOUBLE)"
    window = f"{bessel(f'{beta!r} * sqrt(1 - pow({x} / {n}, 2))')} / {bessel(repr(beta))}"
    table = f"SELECT i, CASE WHEN i > {last} THEN 0.0 ELSE {sinc.ROLLOFF!r} * CASE WHEN i = 0 THEN 1.0 ELSE sin(pi() * {sinc.ROLLOFF!r} * {x}) / (pi() * {sinc.ROLLOFF!r} * {x}) END * {window} END AS w FROM range({last + 3}) u(i)"
    usual, position = (f"CAST(floor(n * {dst!r}::DOUBLE / {src!r}::DOUBLE) AS BIGINT)", f"j * {src!r}::DOUBLE / {dst!r}::DOUBLE")
    if quality != "windowed_sinc":
        usual, position = f"greatest(0, CAST(floor((n + {k.latency}) * {dst!r}::DOUBLE / {src!r}::DOUBLE) AS BIGINT) - {k.skip})", f"(j + {k.skip}) * {src!r}::DOUBLE / {dst!r}::DOUBLE - {k.latency}"
    outputs = f"SELECT track_id, channel, unnest(range(0, {length or usual})) AS j FROM (SELECT track_id, channel, max(frame) + 1 AS n FROM {t} GROUP BY ALL)"
    placed = f"SELECT *, CAST(floor(p) AS BIGINT) AS low, p - floor(p) AS f FROM (SELECT *, {position} AS p FROM ({outputs}))"
    taps = f"SELECT *, abs(f - tap) / {k.stretch!r} * {sinc.PRECISION} AS spot FROM ({placed}) CROSS JOIN range({-k.before}, {k.after + 1}) u(tap) WHERE abs(f - tap) / {k.stretch!r} * {sinc.PRECISION} < {last + 1}"
    return f"""SELECT q.track_id, q.channel, q.j AS frame, coalesce(sum((a.w + (q.spot - floor(q.spot)) * (b.w - a.w)) / {k.stretch!r} * x.value), 0) AS v FROM ({taps}) q
    JOIN ({table}) a ON a.i = CAST(floor(q.spot) AS BIGINT) JOIN ({table}) b ON b.i = CAST(floor(q.spot) AS BIGINT) + 1 LEFT JOIN {t} x ON x.track_id = q.track_id AND x.channel = q.channel AND x.frame = q.low + q.tap GROUP BY q.track_id, q.channel, q.j"""


@query("r5_sinc", value_sql(LI, sinc_sql(1000.0, 1600.0, "sinc32")))
def r5_sinc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(board.resample_chunks(li_chunks(spark, sf_dir), 1000.0, 1600.0, "sinc32", 256))


@query("r6_windowed_sinc", value_sql(LI, sinc_sql(1000.0, 600.0, "windowed_sinc")))
def r6_windowed_sinc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(board.resample_chunks(li_chunks(spark, sf_dir), 1000.0, 600.0, "windowed_sinc", 256))


_DOWN = f"{LI}, down AS ({local_sql(1000.0, 250.0, _v(0), 0, 0)}), low AS (SELECT track_id, channel, frame, v AS value FROM down), back AS ({local_sql(250.0, 1000.0, _v(0), 0, 0, 'low')})"


@query("r7_resample_effect_zoh", value_sql(_DOWN, "SELECT li.track_id, li.channel, li.frame, coalesce(back.v, 0) AS v FROM li LEFT JOIN back ON back.track_id = li.track_id AND back.frame = li.frame"))
def r7_resample_effect_zoh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_out(resample.resample_effect(li(spark, sf_dir), 1000.0, 250.0, "zoh"))


_DOWN2 = f"{LI}, down AS ({local_sql(1000.0, 400.0, _LINEAR, 0, 1)}), low AS (SELECT track_id, channel, frame, v AS value FROM down), back AS ({local_sql(400.0, 1000.0, _LINEAR, 0, 1, 'low')})"


@query("r7_resample_effect_linear", value_sql(_DOWN2, "SELECT li.track_id, li.channel, li.frame, coalesce(back.v, 0) AS v FROM li LEFT JOIN back ON back.track_id = li.track_id AND back.frame = li.frame"))
def r7_resample_effect_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_out(resample.resample_effect(li(spark, sf_dir), 1000.0, 400.0, "linear"))


_DOWN3 = f"{LI}, down AS ({sinc_sql(1000.0, 400.0, 'sinc16')}), low AS (SELECT track_id, channel, frame, v AS value FROM down), back AS ({sinc_sql(400.0, 1000.0, 'sinc16', 'low')})"


@query("r7_resample_effect_sinc", value_sql(_DOWN3, "SELECT li.track_id, li.channel, li.frame, coalesce(back.v, 0) AS v FROM li LEFT JOIN back ON back.track_id = li.track_id AND back.frame = li.frame"))
def r7_resample_effect_sinc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(board.resample_effect_chunks(li_chunks(spark, sf_dir), 1000.0, 400.0, "sinc16"))


@query(
    "r8_lengths",
    f"""WITH {LI}, n AS (SELECT track_id, max(frame) + 1 AS n FROM li GROUP BY track_id), s AS (SELECT track_id, n, 800.0 + track_id % 900 AS dst FROM n), r AS (SELECT *, dst / 1000 AS r, 64 * dst / 1000 AS l FROM s)
    SELECT track_id, CAST(floor(n * r) AS BIGINT) AS local_frames, CAST(floor(n * r - (floor(l + 0.5) - l)) AS BIGINT) AS sinc_frames, CAST(floor(n / 1.5) AS BIGINT) AS stretched FROM r""",
)
def r8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = li(spark, sf_dir).groupBy("track_id").agg((F.max("frame") + 1).alias("n")).withColumn("dst", 800.0 + F.col("track_id") % 900)
    return n.select("track_id", values.resampled_length("n", 1000.0, F.col("dst")).alias("local_frames"), values.resampled_length("n", 1000.0, F.col("dst"), 64).alias("sinc_frames"), values.stretched_length("n", 1.5).alias("stretched"))


@query("p1_time_stretch", None)
def p1_time_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(board.time_stretch(li_chunks(spark, sf_dir), 1.5))


@query("p1_stretch_lengths", f"WITH {LI} SELECT track_id, CAST(floor((max(frame) + 1) / 1.25) AS BIGINT) AS frames FROM li GROUP BY track_id")
def p1_stretch_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    stretched = board.time_stretch(li_chunks(spark, sf_dir), 1.25, 2.0)
    return stretched.groupBy("track_id").agg(F.sum(F.size("samples")).cast("long").alias("frames"))


@query("p1_stretch_curves", f"WITH {LI} SELECT track_id, CAST(floor(sum(CASE frame // 64 % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 2.0 END)) AS BIGINT) AS frames FROM li GROUP BY track_id")
def p1_stretch_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each track at speeds 1, 2 and 0.5 in turn, a semitone up every 64 frames; its length."""
    last = li(spark, sf_dir).groupBy("track_id").agg((F.max("frame") + 1).cast("int").alias("n")).withColumn("at", F.sequence(F.lit(0), F.col("n") - 1))
    curves = last.select("track_id", F.expr("transform(at, i -> CASE floor(i / 64) % 3 WHEN 0 THEN 1.0D WHEN 1 THEN 2.0D ELSE 0.5D END)").alias("stretch"), F.expr("transform(at, i -> CAST(floor(i / 64) % 12 AS DOUBLE))").alias("semitones"))
    return board.time_stretch(li_chunks(spark, sf_dir), curves=curves).groupBy("track_id").agg(F.sum(F.size("samples")).cast("long").alias("frames"))


@query("p2_pitch_shift", None)
def p2_pitch_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(board.pitch_shift(li_chunks(spark, sf_dir), 5.0))


@query("p1_stretch_along_time", "WITH n AS (SELECT CAST(floor(count(*) / 1.5::DOUBLE) AS BIGINT) AS total FROM lineitem), b AS (SELECT CAST(unnest(range(0, (total + 1024 + 8191) // 8192)) AS BIGINT) AS chunk, total FROM n) SELECT CAST(1 AS BIGINT) AS track_id, chunk, greatest(0, chunk * 8192 - 1024) AS start_frame, least(total, (chunk + 1) * 8192 - 1024) - greatest(0, chunk * 8192 - 1024) AS frames FROM b")
def p1_stretch_along_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of lineitem as one track, numbered, stretched and cut into blocks by many tasks; the blocks' lengths."""
    rows = read(spark, sf_dir, "lineitem").withColumn("track", F.lit(1).cast("long"))
    frames = tables.frames_from_long_rows(rows, "track", ["l_shipdate", "l_orderkey", "l_linenumber"], F.col("l_discount") - 0.05)
    made = stretch.stretch_along_time(tables.pack(frames, 1024), 1.5, block_grains=16)
    return made.select("track_id", "chunk", "start_frame", F.size("samples").cast("long").alias("frames"))


_FOURTH = 2.0 ** (-5.0 / 12)


@query("p2_varispeed", value_sql(LI, sinc_sql(_FOURTH, 1.0, "sinc32", length=f"CAST(floor((n + 2048) / {_FOURTH!r}::DOUBLE) AS BIGINT)")))
def p2_varispeed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks with a silent tail, a fourth down and slower by as much, as a tape would be: the vocoder gives back what it gets, and all is the resampling's."""
    return out(stretch.stretch_along_time(tables.pack(channels.pad(li(spark, sf_dir), 2048), 512), _FOURTH, -5.0))


# boards
_X2 = "tanh(greatest(-pow(10, -12.0 / 20), least(pow(10, -12.0 / 20), value * pow(10, 6.0 / 20))) * pow(10, 12.0 / 20))"


@query("x2_sample_wise_board", value_sql(EMB, f"SELECT track_id, channel, frame, {_X2} AS v FROM emb"))
def x2_sample_wise_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(board.apply_board(emb_chunks(spark, sf_dir), board.Board([fx.Gain(6.0), [fx.Clipping(-12.0), fx.Distortion(12.0)]]), RATE))


@query("x3_board_udf", value_sql(EMB, "SELECT track_id, channel, frame, 0.5 * tanh(value * pow(10, 9.0 / 20)) + 0.5 * coalesce(lag(tanh(value * pow(10, 9.0 / 20)), 4) OVER (PARTITION BY track_id ORDER BY frame), 0) AS v FROM emb"))
def x3_board_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = board.board_udf([fx.Distortion(9.0), fx.Delay(0.004)], RATE)
    done = read(spark, sf_dir, "embeddings").select(F.col("vec_id"), run(F.col("embedding").cast("array<double>")).alias("samples"))
    return frames_out(tables.frames_from_arrays(done, "vec_id", "samples"))


@query(
    "x4_mixed_board",
    value_sql(
        recurrence(linear.lowpass(RATE, 120.0)).replace("(value - 50) / 500 AS value", "(value - 50) / 500 * pow(10, 3.0 / 20) AS value"),
        "SELECT track_id, channel, frame, -(0.5 * y1 + 0.5 * coalesce(lag(y1, 5) OVER (PARTITION BY track_id ORDER BY frame), 0) + y1) AS v FROM r",
        recursive=True,
    ),
)
def x4_mixed_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = board.Board([fx.Gain(3.0), fx.LowpassFilter(120.0), fx.Mix([fx.Delay(0.005), None]), fx.Invert()])
    return out(board.apply_board(ev_chunks(spark, sf_dir), own, RATE))
