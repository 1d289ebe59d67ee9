"""URL filters with dated lists.

A list entry is (pattern, category, action, dated): from that day on the host `pattern` and all its
subdomains are listed in (`add`) or taken off (`remove`) that category. Entries become validity
intervals: an `add` holds from its date to the next entry of the same pattern and category. A capture
is judged by the intervals that hold at its fetch time, the latest listing first (an as-of join), so
later changes of a list never alter what was right when a page was fetched.

A capture's host is listed if one of its suffixes (`a.b.com`, `b.com`, `com`) is a pattern, so a list of a million
subdomains of one domain costs a capture no more than its own suffixes. A capture meets each category of a listed
suffix once; captures and listings of a pattern and category are then sorted by time together, and each capture takes the last
listing before it, so a pattern's history may be of any length. Suffixes that over one in HOT of
all suffix rows have, fewer than HOT, are counted first; those that the list has are spread over SALTS tasks, where their
listings are repeated, and those it hasn't are dropped before the shuffle, as `com` mostly is. Captures
that are alike in every column are counted before the shuffle and repeated after it, in pieces of PIECE that are dealt out.

Defined results: a null URL, or one without a host, is never blocked; a null fetch time matches no
interval; entries with a null pattern, category, action or date are left out, and a pattern's leading and trailing dots are; of several
entries of one pattern and category on one day, `remove` comes last; a listing that is dated at the fetch time holds; a
pattern of one label covers all hosts under it; columns of the captures with clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sampleloom.llm.common import saved, table

SALTS = 32
#: A suffix is hot if more than one in HOT suffix rows has it, so there are fewer than HOT.
HOT = 1024
#: Copies of one capture that one row makes.
PIECE = 4096


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a trailing dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def suffixes_of(host: Column) -> Column:
    """The host and all that is left of it without its first labels: a.b.com, b.com, com."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, valid_from, valid_to): valid_to is exclusive and null while the listing holds."""
    pattern = F.regexp_replace(F.lower("pattern"), r"^\.+|\.+$", "")
    whole = entries.select(pattern.alias("pattern"), "category", "action", "dated").dropna().filter("pattern <> ''").distinct()
    w = Window.partitionBy("pattern", "category").orderBy("dated", "action")
    return whole.withColumn("valid_to", F.lead("dated").over(w)).filter("action = 'add'").filter("valid_to is null or valid_to > dated").select("pattern", "category", F.col("dated").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures(page_id, url, fetched_at) with host, blocked, and category and listed_at of the latest listing that holds at the fetch."""
    held = saved(intervals(entries), "intervals")
    alike = captures.groupBy("page_id", "url", "fetched_at").agg(F.count(F.lit(1)).alias("n")).withColumn("host", host_of(F.col("url")))
    alike = saved(alike, "captures")
    under = alike.filter("host is not null and fetched_at is not null").select("page_id", "url", "fetched_at", F.explode(suffixes_of(F.col("host"))).alias("pattern"))
    counts = saved(under.groupBy("pattern").agg(F.count(F.lit(1)).alias("rows")), "suffixes")
    total = counts.agg(F.sum("rows")).head()[0] or 0
    hot = counts.filter(F.col("rows") * HOT > total).select("pattern").join(held.select("pattern").distinct().withColumn("listed", F.lit(True)), "pattern", "left")
    hot = F.broadcast(saved(hot.select(F.col("pattern").alias("hot"), F.coalesce("listed", F.lit(False)).alias("listed")), "hot"))
    spread = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    own = under.join(hot, F.col("pattern") == F.col("hot"), "left").filter("hot is null or listed").withColumn("salt", F.when(F.col("hot").isNotNull(), spread).otherwise(F.lit(0))).drop("hot", "listed")
    salts = F.when(F.col("hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    lists = held.join(hot, F.col("pattern") == F.col("hot"), "left").withColumn("salt", F.explode(salts)).drop("hot", "listed")
    asked = own.join(lists.select("pattern", "salt", "category").distinct(), ["pattern", "salt"])
    key = ["pattern", "category", "salt"]
    rows = asked.select(*key, F.col("fetched_at").alias("at"), F.lit(1).alias("asks"), "page_id", "url", "fetched_at").unionByName(
        lists.select(*key, F.col("valid_from").alias("at"), F.lit(0).alias("asks"), F.struct("valid_from", "valid_to").alias("listing")), allowMissingColumns=True
    )
    so_far = Window.partitionBy(*key).orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    asof = rows.withColumn("listing", F.last("listing", ignorenulls=True).over(so_far)).filter("asks = 1").select("page_id", "url", "fetched_at", "pattern", "category", "listing.*")
    found = asof.filter(F.col("valid_from").isNotNull() & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))))
    latest = found.groupBy("page_id", "url", "fetched_at").agg(F.max(F.struct("valid_from", F.length("pattern").alias("l"), "category")).alias("x"))
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("page_id", "url", "fetched_at")]
    best = alike.alias("c").join(latest.alias("f"), same[0] & same[1] & same[2], "left")
    judged = saved(best.select("c.page_id", "c.url", "host", "c.fetched_at", F.col("x").isNotNull().alias("blocked"), F.col("x.category").alias("category"), F.col("x.valid_from").alias("listed_at"), "n"), "judged")
    pieces = judged.filter(F.col("n") > PIECE).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE))))
    # a number, so that Spark doesn't merge what are few bytes but many rows
    dealt = pieces.repartition(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page_id", "url", "fetched_at", "piece").withColumn("n", F.least(F.lit(PIECE), F.col("n") - F.col("piece") * PIECE)).drop("piece")
    whole = judged.filter(F.col("n") <= PIECE).unionByName(dealt)
    return whole.withColumn("__copy__", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("__copy__", "n")


def _digits(text: Column, start: int) -> Column:
    return F.conv(F.substring(F.md5(text), start, 6), 16, 10).cast("long")


def demo_captures(pages: DataFrame) -> DataFrame:
    """pages as captures: every page has a fetch time in 2024 that follows from its id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.coalesce(F.col("page_id"), F.lit(0)) * 37, F.lit(365)).cast("int"))
    return pages.select("page_id", "url", day.cast("timestamp_ntz").alias("fetched_at"))


def demo_entries(pages: DataFrame) -> DataFrame:
    """A dated list from the hosts of pages: about a third of them is listed, half of these are taken off later, some listed again;
    a quarter of those with four labels or more are listed as all hosts under their parent."""
    host = host_of(F.col("url"))
    parent = F.regexp_replace(host, r"^[^.]*\.", "")
    names = pages.select(F.when((F.size(F.split(host, r"\.")) >= 4) & (_digits(host, 19) % 4 == 0), parent).otherwise(host).alias("pattern")).dropna().distinct()
    h = names.select("pattern", _digits(F.col("pattern"), 1).alias("a"), _digits(F.col("pattern"), 7).alias("b"), _digits(F.col("pattern"), 13).alias("c")).filter("a % 3 = 0")
    start = F.lit("2024-01-01").cast("date")
    category = F.element_at(F.array(*map(F.lit, ["adult", "malware", "spam"])), (F.col("b") % 3 + 1).cast("int"))
    added, off = (F.col("b") % 300).cast("int"), (F.col("c") % 120 + 10).cast("int")
    row = lambda action, days: F.struct(F.lit(action).alias("action"), F.date_add(start, days).cast("timestamp_ntz").alias("dated"))
    rows = F.array_compact(F.array(row("add", added), F.when(F.col("c") % 2 == 0, row("remove", added + off)), F.when(F.col("c") % 4 == 0, row("add", added + off + 30))))
    return h.select("pattern", category.alias("category"), F.explode(rows).alias("x")).select("pattern", "category", "x.action", "x.dated")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(demo_captures(pages), demo_entries(pages))


ORACLE = r"""
WITH p AS (SELECT page_id, url, nullif(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.$', ''), '') AS host,
    CAST(DATE '2024-01-01' + CAST((coalesce(page_id, 0) * 37) % 365 AS INT) AS TIMESTAMP) AS fetched_at FROM pages),
h AS (SELECT host AS pattern, ('0x' || substr(md5(host), 1, 6))::BIGINT AS a, ('0x' || substr(md5(host), 7, 6))::BIGINT AS b, ('0x' || substr(md5(host), 13, 6))::BIGINT AS c
    FROM (SELECT DISTINCT CASE WHEN len(string_split(host, '.')) >= 4 AND ('0x' || substr(md5(host), 19, 6))::BIGINT % 4 = 0 THEN regexp_replace(host, '^[^.]*\.', '') ELSE host END AS host FROM p WHERE host IS NOT NULL)),
l AS (SELECT * FROM h WHERE a % 3 = 0),
e AS (SELECT pattern, b, 'add' AS action, b % 300 AS d FROM l UNION ALL SELECT pattern, b, 'remove', b % 300 + c % 120 + 10 FROM l WHERE c % 2 = 0
    UNION ALL SELECT pattern, b, 'add', b % 300 + c % 120 + 40 FROM l WHERE c % 4 = 0),
d AS (SELECT pattern, ['adult', 'malware', 'spam'][b % 3 + 1] AS category, action, CAST(DATE '2024-01-01' + CAST(d AS INT) AS TIMESTAMP) AS dated FROM e),
i AS (SELECT * FROM (SELECT *, lead(dated) OVER (PARTITION BY pattern, category ORDER BY dated, action) AS valid_to FROM d) WHERE action = 'add'),
r AS (SELECT row_number() OVER () AS r, * FROM p),
m AS (SELECT r.r, i.category, i.dated, row_number() OVER (PARTITION BY r.r ORDER BY i.dated DESC, length(pattern) DESC, category DESC) AS k FROM r JOIN i
    ON (r.host = i.pattern OR ends_with(r.host, '.' || i.pattern)) AND r.fetched_at >= i.dated AND (i.valid_to IS NULL OR r.fetched_at < i.valid_to))
SELECT page_id, url, host, fetched_at, m.r IS NOT NULL AS blocked, m.category, m.dated AS listed_at FROM r LEFT JOIN m ON r.r = m.r AND m.k = 1
"""
