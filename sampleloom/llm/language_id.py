"""Language identification of mixed-language text.

A word is scored against each language by its character trigrams and as a whole (naive Bayes over
hashed features). Script ranges come first: a language is a candidate for a word only if the
training texts of that language use the word's script. A Viterbi pass over the words of a text,
with a penalty for each switch, then labels spans; the language with the most letters is the
prediction and its share of the letters, times the posterior of its spans, the score.

The model is fitted on different labelled texts, at most about FIT_DOCS; each language has an equal share of that bound, so that
rare ones are learned on large tables too. Of more texts those with the least hash are taken, the same ones on every run.
The model's size is BUCKETS x languages.

Defined results: null texts, texts without letters, and any text if there are no labelled
documents get `und` with score 0. Equal scores go to the language that comes first by name.
Repeated rows stay; columns of df with an added column's name are replaced. All of a text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleloom.llm.common import map_text, small_batches, table

#: Hashed features of a language.
BUCKETS = 1 << 16
#: Documents that the fit reads at most, up to the spread of a hash sample.
FIT_DOCS = 20_000
#: Cost of a change of language between two words, in units of log-likelihood.
SWITCH = 8.0
#: A script belongs to a language if it has this share of the letters of its training texts.
SCRIPT_SHARE = 0.01
#: Characters that one step takes: its arrays hold about a hundred bytes for each of them.
STEP_BYTES = 256 << 10
#: Words that one Viterbi step holds for all texts of a block together.
CELLS = 1 << 18

# First and last code points of Unicode script ranges (letters not in one of them are script 0).
SCRIPTS = [
    ("Latin", 0x0041, 0x024F), ("Greek", 0x0370, 0x03FF), ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F), ("Hebrew", 0x0590, 0x05FF),
    ("Arabic", 0x0600, 0x077F), ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF), ("Tamil", 0x0B80, 0x0BFF), ("Telugu", 0x0C00, 0x0C7F),
    ("Thai", 0x0E00, 0x0E7F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x1F00, 0x1FFF),
    ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF), ("Arabic", 0xFB50, 0xFDFF), ("Arabic", 0xFE70, 0xFEFF), ("Han", 0x20000, 0x323AF),
]
SCRIPT_NAMES = sorted({s[0] for s in SCRIPTS})

_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point 0 if it isn't a letter, else 1 + its script's number (1: none of SCRIPTS)."""
    if not _tables:
        kind = np.zeros(0x110001, np.uint8)
        points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
        kind[points] = np.fromiter((chr(p).isalpha() for p in points), np.uint8, len(points))
        for name, first, last in SCRIPTS:
            kind[first : last + 1] *= 2 + SCRIPT_NAMES.index(name)
        _tables.append(kind)
    return _tables[0]


@dataclass
class Words:
    """All words of a block of texts: the hashed features, and for each word its text, script and letters."""

    feature: np.ndarray  # of each letter: its trigram with its neighbours in the word
    whole: np.ndarray  # of each word
    start: np.ndarray  # of each word, its first letter's place in feature
    script: np.ndarray
    letters: np.ndarray
    text: np.ndarray


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def words_of(texts: list[str | None]) -> Words:
    lowered = [t.lower() if t else "" for t in texts]
    joined = "\n".join(lowered) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    kind = _letters()[points]
    is_letter = kind > 0
    before = np.concatenate(([False], is_letter[:-1]))
    at = np.flatnonzero(is_letter)
    first = np.flatnonzero(~before[at])  # in at
    count = np.diff(np.concatenate((first, [len(at)])))
    own = np.where(is_letter, points, 0).astype(np.uint64)
    left, right = np.concatenate(([0], own[:-1])).astype(np.uint64), np.concatenate((own[1:], [0])).astype(np.uint64)
    tri = _mix((left << np.uint64(42)) ^ (own << np.uint64(21)) ^ right)[at]
    with np.errstate(over="ignore"):
        rank = (np.arange(len(at)) - np.repeat(first, count)).astype(np.uint64)
        parts = _mix(own[at] + (rank + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
        whole = np.add.reduceat(parts, first) if len(first) else np.zeros(0, np.uint64)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    return Words(
        (tri % np.uint64(BUCKETS)).astype(np.int64), (_mix(whole + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64), first,
        kind[at[first]].astype(np.int64), count, np.searchsorted(ends, at[first], side="right") if len(first) else np.zeros(0, np.int64),
    )


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # (BUCKETS, languages) float32: log-likelihood of a feature
    candidate: np.ndarray  # (scripts, languages) bool


def training_sample(docs: DataFrame, text_col: str, lang_col: str, most: int) -> DataFrame:
    """(text, lang): the different texts of each language; of a language that has more than its share of `most`, those whose hash is under a bound.

    Counts are by sketch (one row a language comes to the driver), copies are joined before the shuffle, so a group of copies counts once.
    """
    held = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null").withColumn("h", F.xxhash64("text"))
    sizes = held.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    share = most / max(1, len(sizes))
    bounds = {r.lang: int(share / r.n * (1 << 30)) for r in sizes if r.n > share}
    if bounds:
        of = F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])
        held = held.filter(F.pmod(F.col("h"), F.lit(1 << 30)) < F.coalesce(of[F.col("lang")], F.lit(1 << 30)))
    return held.groupBy("lang", "h").agg(F.first("text").alias("text")).select("text", "lang")


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = FIT_DOCS) -> Model:
    """Feature counts are summed by the executors for each language; their sums, at most BUCKETS rows a language, make the model."""
    small_batches(docs.sparkSession)
    sample = training_sample(docs, text_col, lang_col, most)

    def count(batches):
        held: dict[str, np.ndarray] = {}
        import pyarrow as pa

        for batch in batches:
            own = batch.column(1).to_pylist()
            for at, pieces in steps_of(batch.column(0).to_pylist()):
                words = words_of(pieces)
                of = np.array(own, dtype=object)[np.array(at)[words.text]]
                per_letter = np.repeat(of, words.letters)
                for lang in set(of.tolist()):
                    sums = held.setdefault(lang, np.zeros(BUCKETS + 64, np.int64))
                    sums[:BUCKETS] += np.bincount(words.feature[per_letter == lang], minlength=BUCKETS) + np.bincount(words.whole[of == lang], minlength=BUCKETS)
                    sums[BUCKETS:] += np.bincount(words.script[of == lang], words.letters[of == lang], minlength=64).astype(np.int64)
        for lang, sums in held.items():
            full = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full), pa.string()), pa.array(full, pa.int64()), pa.array(sums[full], pa.int64())], names=["lang", "bucket", "n"])

    rows = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows.lang.unique())
    counts = np.zeros((BUCKETS + 64, len(langs)))
    if langs:
        counts[rows.bucket.to_numpy(), np.searchsorted(langs, rows.lang.to_numpy())] = rows.n.to_numpy()
    features, scripts = counts[:BUCKETS], counts[BUCKETS:]
    weight = np.log((features + 0.5) / (features.sum(0) + 0.5 * BUCKETS)).astype(np.float32)
    return Model(langs, weight, scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(0)))


def word_scores(model: Model, words: Words) -> np.ndarray:
    """(words, languages): mean log-likelihood by the word's letters, times their square root's growth; far below all others where the script isn't a candidate."""
    if not len(words.start):
        return np.zeros((0, len(model.langs)), np.float32)
    sums = np.add.reduceat(model.weight[words.feature], words.start, axis=0) + model.weight[words.whole]
    sums -= sums.max(axis=1, keepdims=True)
    fits = model.candidate[words.script]
    fits |= ~fits.any(axis=1, keepdims=True)  # a script that no language uses says nothing
    return np.where(fits, np.maximum(sums, -12), -30).astype(np.float32)


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; scores are in text order, counts[i] words for text i. All texts of a block step together."""
    labels = np.zeros(len(scores), np.int64)
    starts = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    at = 0
    while at < len(order):
        steps = int(counts[order[at]])
        block = order[at : at + max(1, CELLS // steps)]
        at += len(block)
        n = counts[block]
        active = np.searchsorted(-n, -np.arange(steps), side="left")  # texts with more than t words come first
        value, back = scores[starts[block]].copy(), np.zeros((steps, len(block), scores.shape[1]), np.min_scalar_type(scores.shape[1]))
        for t in range(1, steps):
            k = active[t]
            v = value[:k]
            best = v.argmax(axis=1)
            top = v[np.arange(k), best][:, None] - switch
            stay = v >= top
            back[t, :k] = np.where(stay, np.arange(v.shape[1]), best[:, None])
            value[:k] = np.where(stay, v, top) + scores[starts[block[:k]] + t]
        label = value.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            k = active[t]
            labels[starts[block[:k]] + t] = label[:k]
            label[:k] = back[t, np.arange(k), label[:k]]
    return labels


def steps_of(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """(numbers of texts, pieces) of about STEP_BYTES characters; longer texts are cut where no letter is, so at the edge of a word."""
    at, pieces, held = [], [], 0
    for i, text in enumerate(texts):
        start = 0
        while text and start < len(text):
            end = min(len(text), start + STEP_BYTES)
            back = end
            while back > start and back < len(text) and text[back].isalpha():
                back -= 1
            if back == start:  # one word fills the step: it stays whole
                back = end
                while back < len(text) and text[back].isalpha():
                    back += 1
            at.append(i)
            pieces.append(text[start:back])
            held += back - start
            start = back
            if held >= STEP_BYTES:
                yield at, pieces
                at, pieces, held = [], [], 0
    if pieces:
        yield at, pieces


@dataclass
class Labelled:
    """Of each word: its text, letters, scores and label."""

    text: np.ndarray
    letters: np.ndarray
    scores: np.ndarray
    label: np.ndarray


def label_texts(model: Model, texts: list[str | None]) -> Labelled:
    """Words are scored in small steps; Viterbi then takes all texts at once, as its cost is by the longest one."""
    text, letters, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, len(model.langs)), np.float32)]
    for at, pieces in steps_of(texts):
        words = words_of(pieces)
        text.append(np.array(at)[words.text])
        letters.append(words.letters)
        scores.append(word_scores(model, words))
    of, s = np.concatenate(text), np.concatenate(scores)
    return Labelled(of, np.concatenate(letters), s, viterbi(s, np.bincount(of, minlength=len(texts))))


def predictions(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of each text: the language, the score, and the mean posterior of all words' labels, which many languages in one text don't lower."""
    if not model.langs:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    words = label_texts(model, texts)
    labels, s, n = words.label, words.scores, len(model.langs)
    letters = np.bincount(words.text * n + labels, words.letters, minlength=len(texts) * n).reshape(-1, n)
    total = letters.sum(1)
    best = letters.argmax(1)
    share = letters.max(1) / np.maximum(total, 1)
    sure = np.exp(s[np.arange(len(s)), labels]) / np.maximum(np.exp(s).sum(1), 1e-30) * words.letters
    # how sure the words in spans of the predicted language are of it, in the mean
    own = labels == best[words.text]
    mean = np.bincount(words.text[own], sure[own], minlength=len(texts)) / np.maximum(1, letters.max(1))
    certain = np.bincount(words.text, sure, minlength=len(texts)) / np.maximum(1, total)
    return [model.langs[b] if t else "und" for b, t in zip(best, total, strict=True)], np.where(total > 0, np.clip(share * mean, 0, 1), 0.0), np.where(total > 0, np.clip(certain, 0, 1), 0.0)


def spans_of(model: Model, texts: list[str | None]) -> list[list[dict]]:
    """For each text its runs of words of one language: lang, words, letters."""
    out: list[list[dict]] = [[] for _ in texts]
    if not model.langs:
        return out
    words = label_texts(model, texts)
    labels = words.label
    if not len(labels):
        return out
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(words.text) != 0) | (np.diff(labels) != 0))))
    for a, b in zip(cut, [*cut[1:], len(labels)], strict=True):
        out[words.text[a]].append({"lang": model.langs[labels[a]], "words": int(b - a), "letters": int(words.letters[a:b].sum())})
    return out


def identify(df: DataFrame, model: Model, text_col: str = "text", spans: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score and certainty; with spans also the labelled spans array<struct<lang, words, letters>>."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        own = held.value
        return lambda texts: [*predictions(own, texts), *([spans_of(own, texts)] if spans else [])]

    return map_text(df, text_col, "lang_pred string, score double, certainty double" + (", spans array<struct<lang: string, words: int, letters: long>>" if spans else ""), make, keep)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def keep_known(df: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of documents with a predicted language whose words are certain of their labels by `least` in the mean, whether
    they are in one language or several. The model is learned from those not held out."""
    names = df.columns
    model = fit(df.filter(~held_out()))
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row__"), F.col("text"))
    return identify(row, model, keep=["__row__"]).filter((F.col("lang_pred") != "und") & (F.col("certainty") >= least)).select("__row__.*")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    got = identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
