"""Benchmark decontamination.

Texts and items are lower-cased words (runs of word characters) and their 5-word shingles. Over
each document slide windows of as many words as an item has; a window's SimHash weighs each shingle
by how often it occurs. Fingerprints are cut into BLOCKS blocks; if two differ in at most RADIUS bits,
some block differs in at most RADIUS // BLOCKS bits. Pairs that no block brings together are dropped, then those
beyond RADIUS, and what is left is verified by the exact weighted similarity of the two shingle
multisets, the sum of lesser over the sum of greater counts.

At similarity 0.8 fingerprints differ in 10 bits in the mean (deviation 3), so RADIUS = 23 loses about one in a
million; but at that radius blocks alone let three of four unrelated pairs through. So a window meets an item only if
they share one of the item's rarest shingles: a window without any of the rarest ones that together count for over
1 - SIMILARITY of the item can't reach the threshold, so nothing is lost, and the work follows what texts share, not
windows times items.

A document of fewer words than an item is itself the one window. It is verified without fingerprints: at few shingles
a missing one changes more bits than RADIUS allows for.

The benchmark is a stated query set: it is read in blocks of about BLOCK_ITEMS items and BLOCK_BYTES of text, indexed on the
driver and broadcast, and every block meets all documents; of several blocks each one's results are saved before the next
is broadcast, so one block is held at a time whatever the benchmark's size.

Defined results: null and empty texts match nothing, items without words are left out, items of under
five words are one shingle of all their words and match equal words only; repeated rows give
repeated results; columns of the documents with clashing names do no harm.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleloom.llm.common import map_text, saved, slices, small_batches, table

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS = 8
BLOCK_ITEMS = 1 << 16
BLOCK_BYTES = 32 << 20
#: Windows, and pairs of windows and items, that one step holds.
STEP = 1 << 16
_WORD = re.compile(r"\w+")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_SIEVE = 1 << 20


class WordHash(dict):
    """word -> 64-bit hash; empties itself when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return got


_hash = WordHash()


def word_hashes(text: str | None) -> np.ndarray:
    return np.array([_hash[w] for w in _WORD.findall(text.lower())] if text else [], np.uint64)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """One mixed hash for each run of `size` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:n] * _FACTORS[0]
        for j in range(1, size):
            out = out + words[j : j + n] * _FACTORS[j]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return out ^ (out >> np.uint64(29))


def window_simhash(hashes: np.ndarray, width: int) -> np.ndarray:
    """The SimHash of each run of `width` shingles."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    run = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
    return np.packbits((run[width:] - run[:-width]) * 2 > width, axis=1, bitorder="little").view("<u8").ravel()


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Index:
    """Items of one shingle size: their shingle multisets one after the other, and the items of each rare shingle."""

    size: int  # of a shingle
    items: list  # ids
    words: np.ndarray  # of each item
    prints: np.ndarray
    hashes: np.ndarray  # the different shingles of item i, sorted, at start[i]:start[i + 1]
    counts: np.ndarray
    start: np.ndarray
    keys: np.ndarray  # the rare shingles, sorted
    key_start: np.ndarray
    holders: np.ndarray  # items of key k at key_start[k]:key_start[k + 1]
    sieve: np.ndarray

    @property
    def width(self) -> np.ndarray:
        """Shingles of each item, repeats included."""
        return self.words - self.size + 1

    def anchors(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, item): the places where a document has a rare shingle of an item, in pieces of about STEP pairs."""
        at = np.flatnonzero(self.sieve[hashes % np.uint64(_SIEVE)])
        spot = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        hit = self.keys[spot] == hashes[at]
        at, spot = at[hit], spot[hit]
        n = self.key_start[spot + 1] - self.key_start[spot]
        for a, b in _runs(np.cumsum(n) // STEP):
            yield np.repeat(at[a:b], n[a:b]), self.holders[ranges(self.key_start[spot[a:b]], n[a:b])]

    def similarity(self, item: int, hashes: np.ndarray) -> float:
        """Exact weighted similarity of an item and a document's shingles, repeats included."""
        own = slice(self.start[item], self.start[item + 1])
        found, n = np.unique(hashes, return_counts=True)
        spot = np.minimum(np.searchsorted(self.hashes[own], found), own.stop - own.start - 1)
        same = self.hashes[own][spot] == found
        common = int(np.minimum(self.counts[own][spot], n)[same].sum())
        return common / (len(hashes) + int(self.counts[own].sum()) - common)


def close(windows: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Which of these pairs of fingerprints some block brings together and are within RADIUS."""
    differ = windows ^ items
    bits = 64 // BLOCKS
    near = np.zeros(len(differ), bool)
    for b in range(BLOCKS):
        near |= np.bitwise_count((differ >> np.uint64(b * bits)) & np.uint64((1 << bits) - 1)) <= RADIUS // BLOCKS
    return near & (np.bitwise_count(differ) <= RADIUS)


def prepare(items: list[tuple], least: float = SIMILARITY) -> list[Index]:
    """One index for each shingle size."""
    by: dict[int, list] = {}
    for item_id, text in items:
        words = word_hashes(text)
        if len(words):
            size = min(SHINGLE, len(words))
            own = shingles(words, size)
            by.setdefault(size, []).append((item_id, len(words), int(window_simhash(own, len(own))[0]), *np.unique(own, return_counts=True)))
    out = []
    for size, rows in sorted(by.items()):
        hashes, counts = np.concatenate([r[3] for r in rows]), np.concatenate([r[4] for r in rows])
        start = np.concatenate(([0], np.cumsum([len(r[3]) for r in rows])))
        known, times = np.unique(hashes, return_counts=True)
        rarity = times[np.searchsorted(known, hashes)]
        pairs = []
        for i in range(len(rows)):
            own = slice(start[i], start[i + 1])
            order = np.argsort(rarity[own], kind="stable")
            # without all of these more is missing than the threshold allows, also for a shorter document
            held = np.cumsum(counts[own][order])
            n = int(np.searchsorted(held, math.floor((1 - least) * held[-1] + 1e-9) + 1)) + 1
            pairs += [(h, i) for h in hashes[own][order[:n]].tolist()]
        key = np.array([p[0] for p in pairs], np.uint64)
        holder = np.array([p[1] for p in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        keys, first = np.unique(key[order], return_index=True)
        sieve = np.zeros(_SIEVE, bool)
        sieve[keys % np.uint64(_SIEVE)] = True
        out.append(Index(size, [r[0] for r in rows], np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.uint64), hashes, counts, start, keys, np.append(first, len(key)), holder[order], sieve))
    return out


def candidates(index: Index, hashes: np.ndarray, at: np.ndarray, item: np.ndarray) -> Iterator[tuple[int, int]]:
    """(item, start) of the windows around anchors whose fingerprint is within RADIUS of the item's, each once."""
    width = index.width[item]
    first, last = np.maximum(at - width + 1, 0), np.minimum(at, len(hashes) - width)
    full = first <= last
    order = np.lexsort((first[full], item[full], width[full]))
    width, item, first, last = width[full][order], item[full][order], first[full][order], last[full][order]
    # anchors of an item overlap: a range starts after what the ones before it cover
    for a, b in _runs(item):
        upto = np.maximum.accumulate(last[a:b])
        first[a + 1 : b] = np.maximum(first[a + 1 : b], upto[:-1] + 1)
    some = first <= last
    width, item, first, last = width[some], item[some], first[some], last[some]
    for a, b in _runs(width):
        count = last[a:b] - first[a:b] + 1
        step = np.cumsum(count) // STEP
        for c, d in _runs(step):
            which, starts = np.repeat(item[a:b][c:d], count[c:d]), ranges(first[a:b][c:d], count[c:d])
            for k in range(0, len(starts), STEP):  # one range may be longer than a step
                own, place = which[k : k + STEP], starts[k : k + STEP]
                wanted, back = np.unique(place, return_inverse=True)
                prints = np.zeros(len(wanted), np.uint64)
                for i, j in _runs(wanted - np.arange(len(wanted))):  # windows next to each other share their sums
                    prints[i:j] = window_simhash(hashes[wanted[i] : wanted[j - 1] + width[a]], width[a])
                for p in np.flatnonzero(close(prints[back], index.prints[own])):
                    yield int(own[p]), int(place[p])


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of the runs of equal neighbours."""
    if len(values):
        cut = np.flatnonzero(np.diff(values)) + 1
        yield from zip([0, *cut.tolist()], [*cut.tolist(), len(values)], strict=True)


def leaks(bench: list[Index], text: str | None, least: float = SIMILARITY) -> list[tuple]:
    """(item_id, start_word, n_words, similarity): the best window of each item that reaches `least`, the first of equals."""
    words = word_hashes(text)
    best: dict = {}

    def offer(index: Index, item: int, start: int, n: int, own: np.ndarray) -> None:
        score = index.similarity(item, own)
        key = (-score, start, n)
        if score >= least and key < best.get(index.items[item], (0.0,)):
            best[index.items[item]] = key

    for index in bench:
        hashes = shingles(words, index.size)
        if not len(hashes):
            continue
        for at, item in index.anchors(hashes):
            short = index.width[item] > len(hashes)
            for i in np.unique(item[short & (len(hashes) >= least * index.width[item])]).tolist():
                offer(index, i, 0, len(words), hashes)
            for i, start in candidates(index, hashes, at[~short], item[~short]):
                offer(index, i, start, int(index.words[i]), hashes[start : start + index.width[i]])
    return sorted(((i, start, n, -score) for i, (score, start, n) in best.items()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def blocks(benchmark: DataFrame, least: float) -> Iterator[tuple[int, list[Index]]]:
    """(number of blocks, index) of each block of the benchmark's (item_id, text), one at a time through the driver."""
    rows = benchmark.select("item_id", "text").filter("text is not null")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).head()
    n = max(1, math.ceil(size.n / BLOCK_ITEMS), math.ceil(size.b / BLOCK_BYTES))
    for b in range(n):
        yield n, prepare([tuple(r) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()], least)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: for each document and item the best window that reaches `least`."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([source.schema["doc_id"], *T.StructType.fromDDL("item_id long, start_word int, n_words int, similarity double").fields])
    arrow_id = source.schema["doc_id"].dataType

    out = None
    for n, index in blocks(benchmark, least):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            from pyspark.sql.pandas.types import to_arrow_type

            for batch in batches:
                for part in slices(batch, "text"):
                    rows = [(d, *x) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for x in leaks(held.value, t, least)]
                    if rows:
                        kinds = [to_arrow_type(arrow_id), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

        got = source.mapInArrow(run, schema)
        if n > 1:
            got = saved(got, "leaks")
            held.unpersist()
        out = got if out is None else out.unionByName(got)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of documents in which no item is found."""
    names = docs.columns
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row__"), F.col("text"))
    for n, index in blocks(benchmark, least):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def make(held=held):
            return lambda texts: [np.array([len(leaks(held.value, t, least)) for t in texts], np.int32)]

        out = map_text(out, "text", "n_leaks int", make, ["__row__"]).filter("n_leaks = 0").select("__row__", F.col("__row__.text").alias("text"))
        if n > 1:
            out = saved(out, "clean-of-block")
            held.unpersist()
    return out.select("__row__.*")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
