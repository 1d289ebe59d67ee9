"""Near-duplicate groups by SimHash and meet-in-the-middle ball hashing.

Every distinct fingerprint emits all fingerprints within half the radius of itself (65 for radius
2). Two fingerprints within the radius have one of those in common, and two that meet in one are
within the radius, so one shuffle on the variants finds all links. A variant has at most as many
distinct fingerprints around it as the ball has members, so no group grows with the data, whatever
the number of copies: documents with equal fingerprints are counted before anything is emitted.

Groups are connected components over fingerprints: each round takes the least label in each
variant's bucket, then follows labels of labels, so rounds grow with the logarithm of a chain's
length. Rounds are written to the shared folder. Fingerprints that many documents share are joined
apart by a broadcast of at most HOT rows.

Defined results: null and empty texts, and texts of white space only, have fingerprint zero and
link like others; texts of one or two words are one shingle; a missing doc_id never becomes a
component_id unless the whole component has none (then it is null); repeated rows stay. Rows are known by
doc_id and fingerprint, so rows of one doc_id with different texts have components of their own.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleloom.llm.common import drop_folder, map_text, saved, saved_in, table

SHINGLE = 3
RADIUS = 2
#: A key is hot if more than one in HOT rows has it, so there are fewer than HOT such keys.
HOT = 1024


def fingerprints_of(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """A bit is set if over half of the shingle hashes have it."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = text.encode("utf-8").lower().split() if text else []
        if len(words) <= shingle:
            got = [digest(b" ".join(words), 42)] if words else []
        else:
            got = [digest(s, 42) for s in map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))]
        hashes += got
        counts.append(len(got))
    n, out = np.array(counts, np.int64), np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ends = np.cumsum(n[full])
        sums = np.add.reduceat(bits, ends - n[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(sums * 2 > n[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def with_fingerprint(df: DataFrame, text_col: str = "text", shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """Adds fingerprint (long; its 64 bits are the SimHash)."""
    return map_text(df, text_col, "fingerprint long", lambda: lambda texts: [fingerprints_of(texts, shingle).view(np.int64)], keep)


def ball(radius: int) -> list[int]:
    """All masks of at most radius // 2 bits, as signed longs."""
    if radius % 2 or radius < 2:
        raise ValueError("the radius has to be even and at least 2")
    masks = [sum(1 << b for b in bits) for n in range(radius // 2 + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def buckets(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(variant, fp) for variants with two or more of the distinct fingerprints of fps(fp) in their ball."""
    masks = F.array(*[F.lit(m) for m in ball(radius)]) if radius == 2 else F.transform(F.sequence(F.lit(0), F.lit(len(ball(radius)) - 1)), lambda i: F.element_at(F.array(*[F.lit(m) for m in ball(radius)]), i + 1))
    near = fps.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    w = Window.partitionBy("variant")
    met = near.select("variant", "fp", F.count(F.lit(1)).over(w).alias("n"), F.min("fp").over(w).alias("first"))
    # the colliding pairs, verified as a star around the least fingerprint
    return met.filter("n > 1").filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("first"))) <= radius).select("variant", "fp")


def labels(members: DataFrame) -> DataFrame:
    """(fp, label): the least fingerprint of each component of the bipartite graph members(variant, fp)."""
    w, spark = Window.partitionBy("variant"), members.sparkSession
    known, before = None, None
    while True:
        had = members.withColumn("label", F.col("fp")) if known is None else members.join(known, "fp")
        least = had.select("fp", F.col("label").alias("before"), F.min("label").over(w).alias("label"))
        step, folder = saved_in(least.groupBy("fp").agg(F.min("label").alias("label"), F.min("before").alias("before")), "labels")
        if before:
            drop_folder(spark, before)
        if not step.filter("label < before").head(1):
            return step.select("fp", "label")
        jump = step.select(F.col("fp").alias("label"), F.col("label").alias("beyond"))
        known, before = saved_in(step.join(jump, "label", "left").select("fp", F.least("label", "beyond").alias("label")), "jumped")
        drop_folder(spark, folder)


def join_hot(rows: DataFrame, lookup: DataFrame, keys: list[str], counts: DataFrame, how: str = "left") -> DataFrame:
    """rows joined ("left" or "inner") with lookup (unique by keys), where counts(keys, n) says how many rows each key has.

    Keys with over one in HOT of all rows, which are fewer than HOT, go by broadcast; the others by a shuffle.
    """
    total = counts.agg(F.sum("n")).head()[0] or 0
    hot = F.broadcast(counts.filter(F.col("n") * HOT > total).filter(F.col("n") > 1).select(*keys).join(lookup, keys, how).withColumn("__hot__", F.lit(True)))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(lookup, keys, how)
    return cold.unionByName(rows.join(hot, keys).drop("__hot__"))


def components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, least, n, root, component_id) of each distinct fingerprint of docs(doc_id, fp): its least doc_id, its rows, the fingerprint
    that names its component, and the least doc_id reachable over links of at most `radius` differing bits."""
    by_fp = saved(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "fps")
    met, folder = saved_in(buckets(by_fp.select("fp"), radius), "buckets")
    label = labels(met)
    drop_folder(docs.sparkSession, folder)
    linked = saved(by_fp.join(label, "fp", "left").withColumn("root", F.coalesce("label", "fp")), "roots")
    multi = linked.filter("label is not null").select("fp", "least", "n", "root")
    by_root = saved(multi.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "components")
    far = join_hot(multi.withColumnRenamed("n", "rows"), by_root.select("root", "component_id"), ["root"], by_root.select("root", "n")).withColumnRenamed("rows", "n")
    alone = linked.filter("label is null").select("fp", "least", "n", "root", F.col("least").alias("component_id"))
    return saved(alone.unionByName(far), "by-fp")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of df."""
    source = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    docs = saved(with_fingerprint(source, keep=["doc_id"]).select("doc_id", F.col("fingerprint").alias("fp")), "fingerprints")
    found = components(docs, radius)
    whole = join_hot(docs, found.select("fp", "component_id"), ["fp"], found.select("fp", "n"))
    return whole.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component: of the rows with its least doc_id those with the least fingerprint, and of these, which are
    alike or nearly so, the one whose columns have the least hash. Components without a doc_id can't be named; their rows stay."""
    names = df.columns
    hashable = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row__"), "doc_id", F.col("text"), F.xxhash64(*hashable).alias("__hash__"))
    held = saved(with_fingerprint(row, keep=["__row__", "doc_id", "__hash__"]).withColumnRenamed("fingerprint", "fp"), "with-fp")
    found = components(held.select("doc_id", "fp"), radius)
    first = found.filter("component_id is not null").groupBy("root").agg(F.min(F.when(F.col("least") == F.col("component_id"), F.struct("least", "fp"))).alias("x")).select(F.col("x.least").alias("doc_id"), F.col("x.fp").alias("fp"))
    # most of the rows that stay are alone with their doc_id and fingerprint; of the others one is chosen, before any shuffle where a task has several
    counts = saved(held.groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("n")), "counts")
    once = saved(first.join(counts, ["doc_id", "fp"]), "first")
    out = held.join(once.filter("n = 1").select("doc_id", "fp"), ["doc_id", "fp"]).select("__row__")
    repeated = once.filter("n > 1")
    if repeated.head(1):
        alike = join_hot(held, repeated.select("doc_id", "fp"), ["doc_id", "fp"], counts, "inner")
        out = out.unionByName(alike.groupBy("doc_id", "fp").agg(F.min_by("__row__", "__hash__").alias("__row__")).select("__row__"))
    if df.schema["doc_id"].nullable:
        nameless = found.filter("component_id is null").select("fp")
        out = out.unionByName(held.filter("doc_id is null").join(nameless, "fp", "left_semi").select("__row__"))
    return out.select("__row__.*")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
