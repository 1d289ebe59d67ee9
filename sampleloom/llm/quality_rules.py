"""Quality rules with adaptive thresholds.

Two fixed base rules reject what no threshold should be learned from. For the rest, thresholds are
learned from the corpus itself: every metric of every document goes into a mergeable quantile
sketch for its (lang, source), a DDSketch (logarithmic buckets with a bounded relative error), here
plain rows (lang, source, metric, bucket, n). Sketches merge by adding their buckets, so a hot
source costs a few hundred rows from each task, sketches of a language are sums of its sources',
and results do not depend on the order of rows. What a group's sketches say is pooled with what is wider, by counts: a quantile of a source is the geometric
mean of its own and its language's, weighed with the source's number of values and PRIOR, and a language's is pooled with the corpus' in the same way; so is the share of
documents with a value above zero. A source with many values goes by its own, one with few by its language, and nothing changes at once between.
A document is kept if each metric is within its fences; these are joined to the documents and filter them. Everything is DataFrame functions.

Fences come from the pooled quantiles alone. Let low and high be the first and last decile of a metric's values
above zero, and spread = (high / low) ** SPREAD of the metric; for shares of at most one (repeated lines, repeated words) these are odds, so no fence reaches one.

* the mean word length has to lie within low / spread and high * spread;
* of the ratios (symbols, repeated lines, repeated words), which most documents have at zero, the values above zero are
  either the tail of the clean documents, and then the fence is high * spread, or a population of their own, and then it is right below low / spread. How much
  they are their own goes from 0 to 1 with two things, which are multiplied: how rare they are (from COMMON of the documents down to RARE), and how far low / spread is over what one
  occurrence makes in a document of median size (up to GAP times). The fence lies between the two in that proportion, on a logarithmic scale.

Defined results: a null text has no words and fails the base rules, as any text under MIN_WORDS
words does; null lang and source are groups of their own; an empty table gives no rows; repeated
rows stay; columns of df with the metrics' names are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sampleloom.llm.common import saved, table

MIN_WORDS = 50
#: Relative error of the sketches.
ALPHA = 0.01
#: Values above zero with which a group's own quantiles weigh as much as the wider ones.
PRIOR = 10
#: Shares of documents with a value above zero at which those are quite, and not at all, a population of their own.
RARE, COMMON = 0.05, 0.3
#: Occurrences that even the least of them are worth, to be quite their own.
GAP = 10.0
#: The metrics, and how far their fences lie beyond the deciles (as a power of their quotient); those that are shares; the size that a ratio is of.
SPREAD = {"symbols": 1.0, "dup_lines": 0.5, "repeats": 0.5, "word_len": 3.0}
SHARES = ("dup_lines", "repeats")
SIZE = {"symbols": "words", "dup_lines": "lines", "repeats": "words"}
METRICS = list(SPREAD)
SIZES = ["words", "lines"]
#: Threshold rows that may be broadcast.
BROADCAST_ROWS = 50_000

SPACE = " \t\n\x0b\x0c\r"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it many times."""
    return F.transform(F.array(value), body)[0]


def _repeats(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more. Windows are hashed, and only those whose hash occurs twice are
    compared as strings: sort them with their places, keep those that equal a neighbour, sort their places, and add up
    what each adds to the stretch before it."""
    known = lambda c: F.coalesce(c, F.lit(False))

    def equal_neighbours(rows: Column) -> Column:
        """The places of those rows(w, at), sorted, whose w equals that of the row before or after."""
        return F.transform(F.filter(F.transform(rows, lambda x, i: F.struct((known(F.get(rows, i - 1)["w"] == x["w"]) | known(F.get(rows, i + 1)["w"] == x["w"])).alias("twice"), x["at"].alias("at"))), lambda x: x["twice"]), lambda x: x["at"])

    def covered(places: Column) -> Column:
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"],
        )

    def placed(values: Column) -> Column:
        return F.array_sort(F.transform(values, lambda x, i: F.struct(x.alias("w"), i.alias("at"))))

    def verified(places: Column) -> Column:
        named = F.array_sort(F.transform(places, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, 3)).alias("w"), i.alias("at"))))
        return let(named, lambda n: let(F.array_sort(equal_neighbours(n)), covered))

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed(hashes), lambda p: let(equal_neighbours(p), verified)))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, counted))


def with_base(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and base_failed."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    without = lambda chars: F.char_length(F.translate(text, chars, ""))
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    got = df.withColumn(
        "__q__",
        F.struct(
            let(words, lambda w: F.struct(F.size(w).alias("n"), _repeats(w).alias("r"))).alias("w"),
            let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("x"),
            without(SPACE).alias("c"),
            (F.char_length(text) - without("#*$%&|<>")).alias("s"),
        ),
    )
    q = F.col("__q__")
    got = got.withColumns(
        {
            "n_words": q["w"]["n"].cast("long"),
            "word_chars": q["c"].cast("long"),
            "n_symbols": q["s"].cast("long"),
            "n_dup_lines": q["x"]["d"].cast("long"),
            "n_repeat_words": q["w"]["r"].cast("long"),
            "n_lines": q["x"]["n"].cast("long"),
        }
    ).drop("__q__")
    return got.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _values() -> dict[str, Column]:
    """Each metric as a whole number: parts per million, or thousandths of a character."""
    part = lambda a, b, unit: F.when(F.col(b) > 0, F.floor(F.col(a) * unit / F.col(b))).otherwise(F.lit(0)).cast("long")
    return {
        "symbols": part("n_symbols", "n_words", 1_000_000),
        "dup_lines": part("n_dup_lines", "n_lines", 1_000_000),
        "repeats": part("n_repeat_words", "n_words", 1_000_000),
        "word_len": part("word_chars", "n_words", 1_000),
    }


_GAMMA = (1 + ALPHA) / (1 - ALPHA)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): one sketch for each group and metric, and for the sizes, of the documents that pass the base rules.

    Bucket -1 holds zeros; bucket k holds (gamma^(k-1), gamma^k].
    """
    held = _values() | {"words": F.col("n_words"), "lines": F.col("n_lines")}
    long = measured.filter(~F.col("base_failed")).select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("v")) for m, v in held.items()])).alias("x"))
    bucket = F.when(F.col("x.v") <= 0, F.lit(-1)).otherwise(F.ceil(F.log(F.col("x.v").cast("double")) / F.lit(math.log(_GAMMA)))).cast("int")
    return long.groupBy("lang", "source", F.col("x.metric").alias("metric"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """keys, metric, n (documents), hits (values above zero), and of those low, mid and high, the first, fifth and ninth decile as the middle of their bucket."""
    w = Window.partitionBy(*keys, "metric")
    above = F.when(F.col("bucket") >= 0, F.col("n")).otherwise(F.lit(0))
    run = sketch.withColumn("upto", F.sum(above).over(w.orderBy("bucket"))).withColumn("hits", F.sum(above).over(w)).withColumn("total", F.sum("n").over(w))
    value = F.when(F.col("bucket") >= 0, F.lit(2.0) * F.pow(F.lit(_GAMMA), F.col("bucket")) / F.lit(_GAMMA + 1))
    at = lambda q: F.min(F.when(F.col("upto") * 10 >= F.col("hits") * q, value))
    return run.groupBy(*keys, "metric").agg(F.max("total").alias("n"), F.max("hits").alias("hits"), at(1).alias("low"), at(5).alias("mid"), at(9).alias("high"))


def pooled(sketch: DataFrame) -> DataFrame:
    """lang, source, metric, share, low, mid, high of every group and metric or size: its own, pooled with its language's, pooled with the corpus'. Null
    where the corpus has no value above zero."""
    wider = lambda df, name: df.select(*[F.col(c).alias(f"{name}_{c}") for c in df.columns])
    own, by_lang, every = quantiles(sketch, "lang", "source"), wider(quantiles(merged(sketch, "lang"), "lang"), "l"), wider(quantiles(merged(sketch)), "c")
    joined = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric"))).join(every, F.col("metric") == F.col("c_metric"))

    def both(x: Column, hits: Column, up: Column) -> Column:
        return F.when(hits > 0, F.exp((hits * F.log(x) + PRIOR * F.log(up)) / (hits + PRIOR))).otherwise(up)

    part = lambda hits, n, up: (hits + PRIOR * up) / (n + PRIOR)
    share = part(F.col("hits"), F.col("n"), part(F.col("l_hits"), F.col("l_n"), F.col("c_hits") / F.col("c_n")))
    values = [both(F.col(q), F.col("hits"), both(F.col(f"l_{q}"), F.col("l_hits"), F.col(f"c_{q}"))).alias(q) for q in ("low", "mid", "high")]
    return joined.select("lang", "source", "metric", share.alias("share"), *values)


def _within(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, metric, own, low, high): the fences of each group and metric, and how much its values above zero are a population of their own."""
    found = pooled(sketch)
    sizes = found.filter(F.col("metric").isin(SIZES)).groupBy(F.col("lang").alias("z_lang"), F.col("source").alias("z_source")).agg(*[F.max(F.when(F.col("metric") == z, F.col("mid"))).alias(f"z_{z}") for z in SIZES])
    joined = found.filter(F.col("metric").isin(METRICS)).join(sizes, F.col("lang").eqNullSafe(F.col("z_lang")) & F.col("source").eqNullSafe(F.col("z_source")))
    power, size = F.lit(None).cast("double"), F.lit(None).cast("double")
    for m in METRICS:
        power = F.when(F.col("metric") == m, F.lit(SPREAD[m])).otherwise(power)
        size = F.when(F.col("metric") == m, F.col(f"z_{SIZE.get(m, 'words')}")).otherwise(size)
    a_share, gamma = F.col("metric").isin(list(SHARES)), F.lit(_GAMMA)
    odds = lambda v: F.when(a_share, v / F.greatest(F.lit(1e6) - v, F.lit(1.0))).otherwise(v)
    back = lambda v: F.when(a_share, F.lit(1e6) * v / (F.lit(1.0) + v)).otherwise(v)
    spread = F.pow(odds(F.col("high")) / odds(F.col("low")), power)
    step = joined.withColumn("under", odds(F.col("low")) / spread).withColumn("over", odds(F.col("high")) * spread)
    gap = back(F.col("under")) * size / F.lit(1e6)
    own = _within(F.log(gap) / F.lit(math.log(GAP))) * _within((F.lit(COMMON) - F.col("share")) / F.lit(COMMON - RARE))
    step = step.withColumn("own", F.when(F.col("metric") == "word_len", F.lit(0.0)).otherwise(own))
    most = back(F.exp(F.col("own") * F.log("under") + (F.lit(1.0) - F.col("own")) * F.log("over")) * F.pow(gamma, F.lit(1.0) - F.lit(2.0) * F.col("own")))
    least = F.when(F.col("metric") == "word_len", F.col("under") / gamma).otherwise(F.lit(-1.0))
    return step.select("lang", "source", "metric", "own", least.alias("low"), most.alias("high"))


def wide(found: DataFrame) -> DataFrame:
    """One row for each group: t_lang, t_source and low_/high_ of each metric."""
    pick = lambda m, side: F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{side}_{m}")
    return found.groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).agg(*[pick(m, s) for m in METRICS for s in ("low", "high")])


def judged(measured: DataFrame, found: DataFrame) -> DataFrame:
    """measured with kept. The thresholds, one row a group, are broadcast if they are few; else documents are joined by group and salt."""
    rows = saved(wide(found), "fences")
    ok = ~F.col("base_failed")
    for m, v in _values().items():
        ok = ok & (v.cast("double") >= F.coalesce(F.col(f"low_{m}"), F.lit(-1.0))) & (v.cast("double") <= F.coalesce(F.col(f"high_{m}"), F.lit(1e18)))
    match = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = measured.join(F.broadcast(rows), match, "left")
    else:
        salts = 64
        salted = rows.withColumn("__t_salt__", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in BASE], F.col("doc_id")), F.lit(salts)).cast("int")
        joined = measured.withColumn("__salt__", salt).join(salted, match & (F.col("__salt__") == F.col("__t_salt__")), "left").drop("__salt__", "__t_salt__")
    return joined.withColumn("kept", F.coalesce(ok, F.lit(False))).drop("t_lang", "t_source", *[f"{s}_{m}" for m in METRICS for s in ("low", "high")])


def quality(df: DataFrame) -> DataFrame:
    """doc_id, the base metrics, base_failed and kept of every row of documents. Texts are read once; the metrics are saved between."""
    measured = saved(with_base(df.select("doc_id", "text", "lang", "source")).drop("text"), "metrics")
    return judged(measured, thresholds(saved(sketches(measured), "sketches"))).select("doc_id", *BASE, "base_failed", "kept")


def keep_good(df: DataFrame) -> DataFrame:
    """The rows of documents that the rules keep, with df's columns. Rows are saved with their metrics, so texts are measured once and never shuffled."""
    names = df.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row__")
    measured = saved(with_base(df.select(row, "doc_id", "text", "lang", "source")).drop("text"), "measured")
    return judged(measured, thresholds(saved(sketches(measured), "sketches"))).filter("kept").select("__row__.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


_RATIO = "CASE WHEN {b} > 0 THEN CAST(floor({a} * {u} / {b}) AS BIGINT) ELSE 0 END"
_METRIC_SQL = {
    "symbols": _RATIO.format(a="n_symbols", b="n_words", u="1000000::DOUBLE"),
    "dup_lines": _RATIO.format(a="n_dup_lines", b="n_lines", u="1000000::DOUBLE"),
    "repeats": _RATIO.format(a="n_repeat_words", b="n_words", u="1000000::DOUBLE"),
    "word_len": _RATIO.format(a="word_chars", b="n_words", u="1000::DOUBLE"),
}


def _quantiles(keys: list[str]) -> str:
    """The quantiles of one level in SQL."""
    part = ", ".join([*keys, "metric"])
    at = lambda q: f"min(CASE WHEN bucket >= 0 AND upto * 10 >= hits * {q} THEN 2.0 * pow({_GAMMA!r}, bucket) / {_GAMMA + 1!r} END)"
    return f"""SELECT {part}, max(total) AS n, max(hits) AS hits, {at(1)} AS low, {at(5)} AS mid, {at(9)} AS high FROM (
        SELECT *, sum(CASE WHEN bucket >= 0 THEN n ELSE 0 END) OVER (PARTITION BY {part} ORDER BY bucket) AS upto, sum(CASE WHEN bucket >= 0 THEN n ELSE 0 END) OVER (PARTITION BY {part}) AS hits, sum(n) OVER (PARTITION BY {part}) AS total
        FROM (SELECT {part}, bucket, sum(n) AS n FROM s GROUP BY {part}, bucket)) GROUP BY {part}"""


def _both(x: str, hits: str, up: str) -> str:
    return f"CASE WHEN {hits} > 0 THEN exp(({hits} * ln({x}) + {PRIOR} * ln({up})) / ({hits} + {PRIOR})) ELSE {up} END"


_POOLED = ", ".join(_both(f"o.{q}", "o.hits", _both(f"l.{q}", "l.hits", f"c.{q}")) + f" AS {q}" for q in ("low", "mid", "high"))
_CASE = lambda d: f"CASE p.metric {' '.join(f'WHEN {m!r} THEN {x}' for m, x in d.items())} END"
_ODDS = lambda v: f"CASE WHEN p.metric IN {SHARES} THEN {v} / greatest(1e6::DOUBLE - {v}, 1.0::DOUBLE) ELSE {v} END"
_BACK = lambda v: f"CASE WHEN metric IN {SHARES} THEN 1e6::DOUBLE * {v} / (1.0::DOUBLE + {v}) ELSE {v} END"
_SPREAD_SQL = f"pow(({_ODDS('p.high')}) / ({_ODDS('p.low')}), {_CASE(SPREAD)})"
_FENCES = f"""q_own AS ({_quantiles(['lang', 'source'])}), q_lang AS ({_quantiles(['lang'])}), q_all AS ({_quantiles([])}),
p AS (SELECT o.lang, o.source, o.metric, (o.hits + {PRIOR} * ((l.hits + {PRIOR} * (c.hits / c.n)) / (l.n + {PRIOR}))) / (o.n + {PRIOR}) AS share, {_POOLED}
  FROM q_own o JOIN q_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric JOIN q_all c ON o.metric = c.metric),
z AS (SELECT lang, source, {', '.join(f"max(CASE WHEN metric = '{z}' THEN mid END) AS z_{z}" for z in SIZES)} FROM p GROUP BY lang, source),
e AS (SELECT p.*, {_CASE({m: 'z_' + SIZE.get(m, 'words') for m in METRICS})} AS size, ({_ODDS('p.low')}) / {_SPREAD_SQL} AS under, ({_ODDS('p.high')}) * {_SPREAD_SQL} AS over_
  FROM p JOIN z ON p.lang IS NOT DISTINCT FROM z.lang AND p.source IS NOT DISTINCT FROM z.source WHERE p.metric IN {tuple(METRICS)}),
g AS (SELECT *, CASE WHEN metric = 'word_len' THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ln(({_BACK('under')}) * size / 1e6::DOUBLE) / {math.log(GAP)!r})) * greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({COMMON!r} - share) / {COMMON - RARE!r})) END AS own FROM e),
f AS (SELECT lang, source, metric, CASE WHEN metric = 'word_len' THEN under / {_GAMMA!r} ELSE -1.0 END AS low,
  {_BACK(f'(exp(own * ln(under) + (1.0 - own) * ln(over_)) * pow({_GAMMA!r}, 1.0 - 2.0 * own))')} AS high FROM g)"""
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(string_split_regex(t, '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM d),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
hit AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM hit, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS x FROM d),
m AS (
  SELECT d.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[ \\t-\\r]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(x) - len(list_distinct(x)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(x) AS BIGINT) AS n_lines
  FROM d JOIN w USING (r) JOIN lines USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {', '.join(f'{s} AS v_{m}' for m, s in _METRIC_SQL.items())} FROM m),
v AS (SELECT lang, source, metric, v FROM b, LATERAL (VALUES {', '.join(f"('{m}', v_{m})" for m in METRICS)}, ('words', n_words), ('lines', n_lines)) AS u(metric, v) WHERE NOT base_failed),
s AS (SELECT lang, source, metric, CASE WHEN v <= 0 THEN -1 ELSE CAST(ceil(ln(v) / {math.log(_GAMMA)!r}) AS INT) END AS bucket, count(*) AS n FROM v GROUP BY ALL),
{_FENCES},
bad AS (SELECT DISTINCT b.r FROM b JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
  JOIN LATERAL (SELECT CASE f.metric {' '.join(f"WHEN '{m}' THEN v_{m}" for m in METRICS)} END AS v) ON true WHERE v < low OR v > high)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.r IS NULL AS kept FROM b LEFT JOIN bad USING (r)
"""
