"""Hard negatives by exact integer scores, computed with subset-sum tables and bit planes (the Four Russians' method).

Components become integers, floor(scale * x). For each group of eight dimensions an anchor has a table of
the 256 sums of subsets of its eight components. A candidate's integers are cut into bit planes, and each
plane into bytes of eight dimensions; a byte looks up the sum over the dimensions whose bit is set, and
planes are put together by shifts, the sign's plane with a minus. So scores are full and exact.

1. anchors are taken in blocks of ANCHORS rows, which is what the driver and a task hold of them;
2. each task goes through its candidates and keeps the best `positives` rows of the same label for each anchor;
3. with their scores known, each task keeps for each anchor and positive the best `negatives` rows of other labels in the window.

Both times a task puts out a bounded list for each anchor, and those lists meet in a ranked window. Only the anchors of one
block meet all rows; no vectors are shuffled unless the table comes in fewer splits than there are tasks.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part. Shorter vectors have
zeros behind them, an empty one scores zero. Components that are so large that scores could leave 64 bits (over 2**28
after scaling for 64 dimensions) are held at that bound. Equal scores go by smaller id; repeated rows count once; rows that share an id but
differ stay rows of their own, and none is the other's positive. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sampleloom.llm.common import saved, table

#: Anchors of one pass over the rows; their vectors and positives are held by the driver and by each task.
ANCHORS = 8192
#: Anchors and candidates that meet at once; a table for so many anchors has 2 KB a dimension.
ANCHOR_STEP, CANDIDATE_STEP = 128, 1024
LEAST = np.iinfo(np.int64).min


def quantised(lists: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and those rows' components as integers, zeros behind shorter vectors."""
    lists = lists.cast(pa.list_(pa.float64()))
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    good = np.asarray(lists.is_valid().to_numpy(zero_copy_only=False), bool) & (np.bincount(row[~np.isfinite(flat)], minlength=len(lengths)) == 0)
    bounds = np.array([math.isqrt((2**63 - 1) // max(1, n)) - 1 for n in np.unique(lengths).tolist()], np.float64)[np.unique(lengths, return_inverse=True)[1]]
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.clip(np.nan_to_num(np.floor(scale * flat)), -bounds[row], bounds[row]).astype(np.int64)
    out = np.zeros((len(lengths), max(1, int(lengths.max(initial=0)))), np.int64)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = whole
    return good, out[good]


def wide(x: np.ndarray, dims: int) -> np.ndarray:
    return x if x.shape[1] == dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): bit i of the index says whether dimension 8 g + i is in the sum."""
    groups = -(-anchors.shape[1] // 8)
    columns = wide(anchors, groups * 8).T.reshape(groups, 8, -1)
    out = np.zeros((groups, 256, anchors.shape[0]), anchors.dtype)
    for bit in range(8):
        out[:, 1 << bit : 2 << bit] = out[:, : 1 << bit] + columns[:, bit, None]
    return out


def bit_planes(x: np.ndarray) -> np.ndarray:
    """(planes, groups, rows) bytes of two's complement; the last plane is the sign's."""
    count = max(int(x.max(initial=0)).bit_length(), int(-x.min(initial=0) - 1).bit_length() if x.min(initial=0) < 0 else 0) + 1
    return np.stack([np.packbits(((x >> k) & 1).astype(np.uint8), axis=1, bitorder="little").T for k in range(count)])


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors): one look-up a byte, one shift a plane."""
    at = planes.astype(np.intp)
    out, got = np.zeros((planes.shape[2], sums.shape[2]), sums.dtype), np.empty((planes.shape[2], sums.shape[2]), sums.dtype)
    for k in range(len(planes) - 1, -1, -1):
        out <<= 1
        for g in range(sums.shape[0]):
            np.take(sums[g], at[k, g], axis=0, out=got, mode="clip")
            if k == len(planes) - 1:
                out -= got
            else:
                out += got
    return out


def fitting(anchors: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The anchors in 32 bits if no sum can leave them."""
    most = int(np.abs(anchors).sum(axis=1).max(initial=0)) << (max(int(x.max(initial=0)), int(-x.min(initial=0))).bit_length() + 1)
    return anchors.astype(np.int32) if most < 2**31 else anchors


class Best:
    """For each key the `most` greatest (score, id), ids ascending among equal scores, each pair once."""

    def __init__(self, keys: int, most: int):
        self.most, self.key, self.score, self.id = most, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: A lesser score can't come in any more.
        self.least = np.full(keys, LEAST)

    def add(self, key: np.ndarray, score: np.ndarray, own: np.ndarray) -> None:
        if not len(key):
            return
        k, s, i = np.concatenate((self.key, key)), np.concatenate((self.score, score)), np.concatenate((self.id, own))
        order = np.lexsort((i, -s, k))
        k, s, i = k[order], s[order], i[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1])))
        k, s, i = k[new], s[new], i[new]
        first = np.searchsorted(k, k)
        keep = np.arange(len(k)) - first < self.most
        self.key, self.score, self.id = k[keep], s[keep], i[keep]
        last = np.arange(len(k)) - first == self.most - 1
        self.least[k[last]] = s[last]


def _hits(x: np.ndarray, low: np.ndarray, most: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of x that are at least low[column]; where these are many, only those that can be among the column's `most` greatest (unless rows repeat)."""
    hit = x >= low
    if np.count_nonzero(hit) > 4 * most * x.shape[1] and x.shape[0] > most and len(np.unique(own)) == len(own):
        hit &= x >= np.partition(x, x.shape[0] - most, axis=0)[x.shape[0] - most]
    return np.nonzero(hit)


def _candidates(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, integers) of rows that take part, CANDIDATE_STEP at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, CANDIDATE_STEP):
            part = batch.slice(start, CANDIDATE_STEP)
            good, x = quantised(part.column(2), scale)
            if len(x):
                yield part.column(0).to_numpy(zero_copy_only=False)[good], part.column(1).to_numpy(zero_copy_only=False)[good], x


def _typed(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    named = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    return named.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")


def _anchor_blocks(typed: DataFrame, anchors: Column, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct anchors in blocks of at most ANCHORS rows, in a fixed order, one block at a time on the driver."""

    def packed(batches):
        for batch in batches:
            good, x = quantised(batch.column(2), scale)
            rows = pa.array(np.flatnonzero(good))
            vectors = pa.array([np.trim_zeros(v, "b").tobytes() for v in x], pa.binary())  # as batches pad differently
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), vectors], names=["id", "label", "vector"])

    own = typed.filter(anchors).mapInArrow(packed, "id long, label long, vector binary").distinct()
    own = saved(own, "anchors")
    held: list = []

    def block():
        vectors = [np.frombuffer(r[2], np.int64) for r in held]
        dims = max([1, *map(len, vectors)])
        out = np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int64), np.stack([np.pad(v, (0, dims - len(v))) for v in vectors])
        held.clear()
        return out

    for row in own.toLocalIterator():
        held.append(row)
        if len(held) == ANCHORS:
            yield block()
    if held:
        yield block()


def _positives(spark: SparkSession, rows: DataFrame, block: tuple, scale: float, most: int) -> list[list[tuple[int, int]]]:
    """For each anchor of the block its positives, (score, id), best first."""
    ids, labels, vectors = block
    of_label = {int(v): np.flatnonzero(labels == v) for v in np.unique(labels)}

    def run(batches):
        best = Best(len(ids), most)
        for own, label, x in _candidates(batches, scale):
            dims = max(x.shape[1], vectors.shape[1])
            for value in np.unique(label).tolist():
                at = np.flatnonzero(label == value)
                for start in range(0, len(of_label.get(value, ())), ANCHOR_STEP):
                    cols = of_label[value][start : start + ANCHOR_STEP]
                    part = wide(x[at], dims)
                    got = scores(subset_sums(fitting(wide(vectors[cols], dims), part)), bit_planes(part)).astype(np.int64)
                    got[own[at][:, None] == ids[cols][None, :]] = LEAST
                    r, c = _hits(got, np.maximum(best.least[cols], LEAST + 1), most, own[at])
                    best.add(cols[c], got[r, c], own[at][r])
        yield pa.RecordBatch.from_arrays([pa.array(best.key), pa.array(best.score), pa.array(best.id)], names=["anchor", "score", "id"])

    found = rows.mapInArrow(run, "anchor long, score long, id long")
    rank = F.dense_rank().over(Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id"))
    out: list[list[tuple[int, int]]] = [[] for _ in ids]
    for r in found.withColumn("rank", rank).filter(F.col("rank") <= most).select("anchor", "score", "id").distinct().orderBy("anchor", F.col("score").desc(), "id").collect():
        out[r[0]].append((r[1], r[2]))
    return out


def _negatives(rows: DataFrame, block: tuple, positives: list, scale: float, most: int, low: int, high: int) -> DataFrame:
    ids, labels, vectors = block
    width = max((len(p) for p in positives), default=0)
    floor, ceiling = np.ones((len(ids), width), np.int64), np.zeros((len(ids), width), np.int64)  # an empty window
    for a, own in enumerate(positives):
        for j, (score, _) in enumerate(own):
            if score >= 0:  # below, low * score <= high * score fails
                floor[a, j], ceiling[a, j] = -(-low * score // 100), high * score // 100
    names = ["anchor", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def run(batches):
        best = Best(len(ids) * width, most)
        for own, label, x in _candidates(batches, scale):
            dims = max(x.shape[1], vectors.shape[1])
            x = wide(x, dims)
            planes, found = bit_planes(x), []
            for start in range(0, len(ids), ANCHOR_STEP):
                cols = np.arange(start, min(start + ANCHOR_STEP, len(ids)))
                got = scores(subset_sums(fitting(wide(vectors[cols], dims), x)), planes).astype(np.int64)
                got[label[:, None] == labels[cols][None, :]] = LEAST
                for j in range(width):
                    key = cols * width + j
                    r, c = _hits(np.where(got <= ceiling[cols, j], got, LEAST), np.maximum(floor[cols, j], best.least[key]), most, own)
                    if len(r):
                        found.append((key[c], got[r, c], own[r]))
            if found:
                best.add(*(np.concatenate(f) for f in zip(*found, strict=True)))
        a, j = best.key // max(1, width), best.key % max(1, width)
        pairs = [positives[p][q] for p, q in zip(a.tolist(), j.tolist(), strict=True)]
        cols = [a, j, ids[a], np.array([p[1] for p in pairs], np.int64), np.array([p[0] for p in pairs], np.int64), best.id, best.score]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    found = rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))
    rank = F.dense_rank().over(Window.partitionBy("anchor", "place").orderBy(F.col("negative_score").desc(), "negative_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most).distinct().select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def mine(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `anchors` is a condition on `id` and `label` that says which rows are anchors. An anchor's positives are its best `positives` other rows of the same
    label; for each the best `negatives` rows of other labels are returned whose score is `low` to `high` percent of the positive's.
    """
    spark = rows.sparkSession
    typed = _typed(rows, id_col, label_col, vector_col)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # few bytes can be much work
    spread = typed if typed.rdd.getNumPartitions() >= tasks else typed.repartition(tasks)
    done: list[DataFrame] = []
    blocks = _anchor_blocks(typed, anchors, scale)
    block = next(blocks, None)
    while block is not None:
        found = _negatives(spread, block, _positives(spark, spread, block, scale, positives), scale, negatives, low, high)
        block = next(blocks, None)
        done.append(found if block is None and not done else saved(found, "negatives"))
    if not done:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 50, against all rows; labels of ids divisible by 7 are moved on first."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mine(rows, F.col("id") % 50 == 0)


ORACLE = """WITH v AS (SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, a.label AS anchor_label, b.id AS id, b.label AS label, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label AND id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> anchor_label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""
