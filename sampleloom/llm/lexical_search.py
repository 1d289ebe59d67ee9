"""Ranked lexical search with geometric blocks inside each posting list.

Terms are runs of digits, ASCII letters (lower-cased) and characters beyond ASCII. A document's score for an item is the sum, over
the item's terms, of w * ((10**9 tf) div (1000 tf + 8 m)), in 64-bit integers, where w weighs rare terms and m long documents.

1. One pass over the texts writes each document as a vector: its length and the item terms it has, with their
   counts. From these come the number and length of documents and, summed by task first, each term's document count.
2. A search over the vectors for the items' rarest terms alone gives each item a score that ten documents reach.
3. Each task takes its documents a slice at a time and makes posting lists of them. A list is clustered by the similarity of its documents
   (nearest of some of its own members, in a random projection of their vectors); each block keeps the maximum of each coordinate that an item with the term asks for.
   A list whose items are out of reach by its terms' maxima alone isn't opened; of an opened list, blocks are skipped if their
   summary bound (an exact integer) is below the item's tenth score so far; the rest are scored exactly. Bounds never round, so nothing is lost.
4. Tasks' first tens meet in a ranked window.

Items are a stated query set; they are taken in blocks of ITEMS rows or TERMS different terms, each with a pass of its own over the documents.
No posting is shuffled: the index is cut by documents, and a frequent term is spread over all tasks.

Defined results: null and empty texts have no terms, count nowhere and are found by no item; documents without doc_id count and come after others of
equal score; repeated documents are documents of their own; repeated items (id and text) give their rows once, different texts of one item_id
each their own ranking; items without a known term give no rows. Clashing and further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sampleloom.llm.common import saved, slices, small_batches, table

#: Items, and different terms of them, that one pass over the documents serves; the driver and each task hold them.
ITEMS, TERMS = 4096, 1 << 18
#: Documents of a posting list's block, about.
BLOCK = 64
#: Documents that are indexed together at most, and entries of their matrix (documents by terms).
SLICE_DOCS, SLICE_ENTRIES = 4096, 1 << 24
#: Dimensions of the projection in which posting lists are clustered.
SKETCH = 32
#: Seeds come from the rarest terms of an item, until so many documents have one.
SEED_DOCS = 1000

#: One byte each: separators become spaces, A-Z become a-z.
_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
VECTOR = "doc_id long, n long, terms array<int>, counts array<int>"


def terms_of(text: bytes | None) -> list[bytes]:
    """bytes.translate keeps what UTF-8 has beyond ASCII."""
    return text.translate(_BYTES).split() if text else []


class Items:
    """A block of items: ids, and each one's different terms as numbers of a common vocabulary."""

    def __init__(self, rows: list[tuple[int | None, bytes | None]]):
        self.ids = [i for i, _ in rows]
        found = [list(dict.fromkeys(terms_of(t))) for _, t in rows]
        self.vocabulary = {t: k for k, t in enumerate(dict.fromkeys(t for own in found for t in own))}
        self.terms = [np.array([self.vocabulary[t] for t in own], np.int64) for own in found]


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """One block at a time on the driver."""
    held, words = [], 0
    for row in items.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string").cast("binary")).distinct().toLocalIterator():
        if held and (len(held) == ITEMS or words > TERMS):
            yield Items(held)
            held, words = [], 0
        text = bytes(row[1]) if row[1] is not None else None
        held.append((row[0], text))
        words += len(set(terms_of(text)))
    if held:
        yield Items(held)


def vectors(docs: DataFrame, block: Items, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n and, of the block's terms, those that the document has."""
    small_batches(docs.sparkSession)
    known = block.vocabulary
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))

    def run(batches):
        for whole in batches:
            for part in slices(whole, "text"):
                n, terms, counts = [], [], []
                for text in part.column(1).to_pylist():
                    words = terms_of(text)
                    n.append(len(words))
                    own = [(known[t], c) for t, c in Counter(words).items() if t in known]
                    terms.append([t for t, _ in own])
                    counts.append([c for _, c in own])
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "terms", "counts"])

    return source.mapInArrow(run, VECTOR)


def statistics(found: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """N, L, and the document count of each term. A task sums its own first."""

    def run(batches):
        some, length, df = 0, 0, np.zeros(terms, np.int64)
        for b in batches:
            n = b.column(1).to_numpy(zero_copy_only=False)
            some, length = some + int((n > 0).sum()), length + int(n.sum())
            df += np.bincount(b.column(2).flatten().to_numpy(zero_copy_only=False), minlength=terms)
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-2, -1], has)), pa.int64()), pa.array(np.concatenate(([some, length], df[has])), pa.int64())], names=["term", "n"])

    out, sums = np.zeros(terms, np.int64), {-2: 0, -1: 0}
    for term, n in found.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if term < 0:
            sums[term] = n
        else:
            out[term] = n
    return sums[-2], sums[-1], out


class Slice:
    """Some documents, indexed: a matrix of documents by terms, and posting lists cut into geometric blocks as they are asked for."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, indptr: np.ndarray, terms: np.ndarray, counts: np.ndarray, totals: tuple[int, int], weights: np.ndarray):
        self.ids, self.weights = ids, weights
        row = np.repeat(np.arange(len(ids)), np.diff(indptr))
        m = 100 - 90 + (90 * n * totals[0]) // totals[1]
        share = (1_000_000_000 * counts) // (1000 * counts + 8 * m[row])
        self.columns, local = np.unique(terms, return_inverse=True)
        self.place = np.full(len(weights), -1)
        self.place[self.columns] = np.arange(len(self.columns))
        self.matrix = np.zeros((len(ids), len(self.columns)), np.int32)  # shares are 10**6 at most
        self.matrix[row, local] = share
        order = np.argsort(local, kind="stable")
        self.docs, self.ends = row[order], np.searchsorted(local[order], np.arange(len(self.columns) + 1))
        self.top = self.matrix.max(axis=0, initial=0).astype(np.int64) * weights[self.columns]
        self._sketch: np.ndarray | None = None
        self._blocks: dict[int, tuple] = {}

    def list(self, column: int) -> np.ndarray:
        return self.docs[self.ends[column] : self.ends[column + 1]]

    def sketch(self) -> np.ndarray:
        if self._sketch is None:
            signs = np.random.default_rng(1).choice(np.array([-1.0, 1.0], np.float32), (len(self.columns), SKETCH))
            flat = (self.matrix.astype(np.float32) * self.weights[self.columns].astype(np.float32)) @ signs
            self._sketch = flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-9)
        return self._sketch

    def blocks(self, column: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of one posting list: documents in the order of blocks, where blocks begin, the summaries (blocks, asked columns), and each column's place in them."""
        if column not in self._blocks:
            own = self.list(column)
            if len(own) > BLOCK:
                z = self.sketch()
                heads = np.random.default_rng(column).choice(own, -(-len(own) // BLOCK), replace=False)
                near = np.argmax(z[own] @ z[heads].T, axis=1)
                order = np.argsort(near, kind="stable")
                own, starts = own[order], np.flatnonzero(np.diff(near[order], prepend=-1))
            else:
                starts = np.zeros(1, np.int64)
            at = np.full(len(self.columns), -1)
            at[asked] = np.arange(len(asked))
            self._blocks[column] = own, starts, np.maximum.reduceat(self.matrix[np.ix_(own, asked)], starts, axis=0), at
        return self._blocks[column]

    def scores(self, docs: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return self.matrix[np.ix_(docs, columns)].astype(np.int64) @ self.weights[self.columns[columns]]


class Top:
    """An item's greatest scores so far, with their documents; `least` is what a score has to reach."""

    def __init__(self, most: int, least: int):
        self.most, self.least, self.rows = most, least, []

    def add(self, scores: np.ndarray, ids: list) -> None:
        good = np.flatnonzero(scores >= self.least)
        if len(good):
            self.rows += [(-int(scores[i]), ids[i] is None, ids[i] or 0) for i in good]
            self.rows = sorted(self.rows)[: self.most]
            if len(self.rows) == self.most:
                self.least = max(self.least, -self.rows[-1][0])


def _slices(batches, entries: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, lengths, offsets, terms, counts) of documents that have a term, a bounded number at a time."""
    held, size = [], 0

    def out():
        ids = [i for h in held for i in h[0]]
        lengths = np.concatenate([h[2] for h in held])
        return ids, np.concatenate([h[1] for h in held]), np.concatenate(([0], np.cumsum(lengths))), np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])

    for batch in batches:
        for start in range(0, batch.num_rows, entries):
            b = batch.slice(start, entries)
            lengths = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            keep = pa.array(lengths > 0)
            b = b.filter(keep)
            if not b.num_rows:
                continue
            if held and size + b.num_rows > entries:
                yield out()
                held.clear()
                size = 0
            held.append((b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).value_lengths().to_numpy(zero_copy_only=False), b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64), b.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
            size += b.num_rows
    if held:
        yield out()


def _indexed(batches, totals: tuple[int, int], weights: np.ndarray) -> Iterator[tuple[list, Slice]]:
    entries = int(min(SLICE_DOCS, max(64, SLICE_ENTRIES // max(1, len(weights)))))
    for ids, n, indptr, terms, counts in _slices(batches, entries):
        yield ids, Slice(np.arange(len(ids)), n, indptr, terms, counts, totals, weights)


def _emit(tops: list[Top]) -> pa.RecordBatch:
    rows = [(k, -s, None if none else d) for k, top in enumerate(tops) for s, none, d in top.rows]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["item", "score", "doc_id"])


def seeds(found: DataFrame, block: Items, totals: tuple[int, int], weights: np.ndarray, df: np.ndarray, most: int) -> list[int]:
    """For each item a score that `most` documents with one of its rarest terms reach; 1 if they are fewer."""
    rare = []
    for terms in block.terms:
        own = terms[(df[terms] > 0) & (weights[terms] > 0)]
        own = own[np.argsort(df[own], kind="stable")]
        rare.append(own[: int(np.searchsorted(np.cumsum(df[own]), SEED_DOCS)) + 1])
    wanted = block.terms

    def run(batches):
        tops = [Top(most, 1) for _ in rare]
        for ids, index in _indexed(batches, totals, weights):
            for top, own, terms in zip(tops, rare, wanted, strict=True):
                lists = [index.list(c) for c in index.place[own] if c >= 0]
                if lists:
                    docs, columns = np.unique(np.concatenate(lists)), index.place[terms]
                    top.add(index.scores(docs, columns[columns >= 0]), [ids[d] for d in docs.tolist()])
        yield _emit(tops)

    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc()))
    reached = {r[0]: r[1] for r in found.mapInArrow(run, "item long, score long, doc_id long").withColumn("rank", rank).filter(F.col("rank") == most).select("item", "score").collect()}
    return [reached.get(k, 1) for k in range(len(rare))]


def _search(index: Slice, ids: list, wanted: list[np.ndarray], tops: list[Top]) -> None:
    opened: dict[int, list[int]] = {}
    plans = []
    for k, (terms, top) in enumerate(zip(wanted, tops, strict=True)):
        columns = index.place[terms]
        columns = columns[columns >= 0]
        columns = columns[np.argsort(-index.top[columns], kind="stable")]
        # what the lists from each one on can give together
        rest = np.cumsum(index.top[columns][::-1])[::-1]
        essential = columns[rest >= top.least]
        plans.append((columns, essential))
        for c in essential.tolist():
            opened.setdefault(c, []).append(k)
    asked = {}
    for c, items in opened.items():
        mark = np.zeros(len(index.columns), bool)
        for k in items:
            mark[plans[k][0]] = True
        asked[c] = np.flatnonzero(mark)
    seen = np.zeros(len(ids), bool)
    for (columns, essential), top in zip(plans, tops, strict=True):
        seen[:] = False
        for c in essential.tolist():
            own, starts, summary, at = index.blocks(c, asked[c])
            bound = summary[:, at[columns]].astype(np.int64) @ index.weights[index.columns[columns]]
            open_ = bound >= top.least
            if not open_.any():
                continue
            docs = own if open_.all() else own[np.repeat(open_, np.diff(starts, append=len(own)))]
            docs = docs[~seen[docs]]
            if len(docs):
                seen[docs] = True
                top.add(index.scores(docs, columns), [ids[d] for d in docs.tolist()])


def search(docs: DataFrame, items: DataFrame, most: int = 10, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's `most` best documents with a score above zero; equal scores by ascending doc_id."""
    spark, done = docs.sparkSession, []
    for block in item_blocks(items, item_col, item_text_col):
        found = saved(vectors(docs, block, doc_col, text_col), "vectors")
        number, length, df = statistics(found, len(block.vocabulary))
        if not number:
            continue
        weights = np.array([int(math.floor(1000 * math.log((2 * number + 2) / (2 * d + 1)))) for d in df.tolist()], np.int64)
        totals, wanted = (number, length), block.terms
        least = seeds(found, block, totals, weights, df, most)

        def run(batches, totals=totals, weights=weights, wanted=wanted, least=least):
            tops = [Top(most, s) for s in least]
            for ids, index in _indexed(batches, totals, weights):
                _search(index, ids, wanted, tops)
            yield _emit(tops)

        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        ranked = found.mapInArrow(run, "item long, score long, doc_id long").withColumn("rank", rank).filter(F.col("rank") <= most)
        names = spark.createDataFrame([(k, i) for k, i in enumerate(block.ids)], "item long, item_id long")
        done.append(ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not done:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
t AS (SELECT k, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d),
p AS (SELECT k, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM f CROSS JOIN s),
r AS (SELECT item_id, k, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) CROSS JOIN s GROUP BY ALL)
SELECT CAST(item_id AS BIGINT) AS item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, CAST(doc_id AS BIGINT) AS doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 10"""
