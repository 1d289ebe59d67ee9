"""Hard negatives and ranked search: brute force on made rows, SQL on the smallest tables."""

from __future__ import annotations

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleloom.llm import hard_negatives, lexical_search
from tests.oracle import compare, connect

VECTORS = "vec_id long, embedding array<float>, label int, score string, rank string"


def mined(rows, scale=256.0, every=5, positives=5, negatives=3):
    """The definition, with Python's integers, on distinct rows that take part."""
    own = sorted({(i, lab, tuple(math.floor(scale * x) for x in v)) for i, v, lab, *_ in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905  the shorter one ends it
    out = []
    for a in own:
        if a[0] % every:
            continue
        best = sorted({(-dot(a[2], b[2]), b[0]) for b in own if b[1] == a[1] and b[0] != a[0]})[:positives]
        others = sorted({(-dot(a[2], b[2]), b[0]) for b in own if b[1] != a[1]})
        for s, p in best:
            fit = [(n, i) for n, i in others if 50 * -s <= 100 * -n <= 95 * -s][:negatives]
            out += [(a[0], p, rank + 1, i, -s, -n) for rank, (n, i) in enumerate(fit)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(6, 11))
    out = [(i, [float(np.float32(x)) for x in base[i % 6] + 0.8 * rng.normal(size=11)], int(i % 3 if i % 4 else (i + 1) % 3), "a", "b") for i in range(150)]
    out += [(200 + i, out[5][1], 1, "a", "b") for i in range(40)]  # equal vectors: ties
    out += out[:30] * 3  # repeated rows
    out += [(300, None, 1, "", ""), (305, [1.0, None, 2.0], 1, "", ""), (310, [float("nan")] * 11, 1, "", ""), (315, [float("inf")] * 11, 2, "", ""), (320, [1.0] * 11, None, None, None), (None, [1.0] * 11, 1, None, None)]
    out += [(330, [], 1, "", ""), (335, [1.0, 2.0], 1, "", ""), (340, [0.5] * 14, 2, "", ""), (345, [900.0, -700.0] + [0.0] * 9, 0, "", ""), (10, [0.25] * 11, 2, "", "")]
    return out


@pytest.mark.parametrize("block", [8192, 3])
def test_hard_negatives_equal_brute_force(spark, rows, block, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", block)
    df = spark.createDataFrame(rows, VECTORS)
    got = hard_negatives.mine(df, F.col("id") % 5 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = sorted(tuple(r) for r in got.collect())
    want = mined(rows)
    # two rows share the id 10: each is an anchor, ranked apart
    assert found == want and len(want) > 100


def test_no_vectors(spark, rows):
    df = spark.createDataFrame(rows, VECTORS)
    assert hard_negatives.mine(df.filter("false"), F.col("id") % 5 == 0).count() == 0
    assert hard_negatives.mine(df, F.lit(False)).count() == 0
    one = hard_negatives.mine(df.filter("label = 1"), F.col("id") % 5 == 0)
    assert one.count() == 0  # no row of another label


def test_scores_are_exact():
    rng = np.random.default_rng(3)
    for most in (1, 100, 2**20, 2**28):
        a, x = rng.integers(-most, most + 1, (9, 21)), rng.integers(-most, most + 1, (50, 21))
        a = hard_negatives.fitting(a, x)
        got = hard_negatives.scores(hard_negatives.subset_sums(a), hard_negatives.bit_planes(x))
        assert np.array_equal(got.astype(np.int64), x @ a.astype(np.int64).T)


def test_hard_negatives_equal_sql(spark, sf):
    compare(hard_negatives.op11_hard_negatives(spark, sf), connect(sf), hard_negatives.ORACLE)


# ranked search


def ranked(docs, items, most=10):
    """The definition over all documents, by regular expression."""
    words = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    own = [(i, words(t)) for i, t in docs]
    own = [(i, w) for i, w in own if w]
    number, length = len(own), sum(len(w) for _, w in own)
    df = collections.Counter(t for _, w in own for t in set(w))
    out = []
    for item, text in set(items):
        asked, found = set(words(text)), []
        for i, w in own:
            tf, m = collections.Counter(w), 100 - 90 + (90 * len(w) * number) // length
            score = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in asked if t in tf)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, f[3], -f[0]) for rank, f in enumerate(sorted(found, key=lambda f: f[:3])[:most])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def library():
    rng = np.random.default_rng(11)
    common, topics = [f"w{i}" for i in range(12)], [[f"t{t}x{i}" for i in range(40)] for t in range(5)]

    def text(topic, n):
        return " ".join(str(x) for x in np.where(rng.random(n) < 0.5, rng.choice(common, n), rng.choice(topics[topic], n)))

    docs = [(i, text(i % 5, int(rng.integers(3, 60)))) for i in range(700)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + docs[:20] * 2  # copies: ties
    docs += [(2000, None), (2001, ""), (2002, " .;- "), (None, docs[3][1]), (None, docs[9][1]), (2003, "É é Éa NAÏVE naïve x\u00a0y 漢字 42"), (2004, "w1 " * 30_000)]
    items = [(i, text(i % 5, 12)) for i in range(20)] + [(30, None), (31, ""), (32, "unknown words"), (33, "É NAÏVE 42"), (33, "w1"), (None, "t1x1 t1x2"), (34, docs[7][1]), (34, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("block", [4096, 5])
def test_search_equals_brute_force(spark, library, block, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEMS", block)
    docs, items = library
    df = spark.createDataFrame([(*d, 1, 1) for d in docs], "doc_id long, text string, score int, n int").repartition(3)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int")
    got = lexical_search.search(df, asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(docs, items)


def test_search_over_nothing(spark, library):
    docs, items = library
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical_search.search(df.filter("false"), asked).count() == 0
    assert lexical_search.search(df, asked.filter("false")).count() == 0
    assert lexical_search.search(df.filter("doc_id = 2000"), asked).count() == 0


def test_blocks_are_skipped_and_bounds_hold():
    """Summaries bound every document of their block; with a good threshold few documents are scored."""
    rng = np.random.default_rng(5)
    rows = [np.unique(np.concatenate(([0], 1 + 30 * (i % 8) + rng.integers(0, 30, 12)))) for i in range(1600)]
    terms, indptr = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    index = lexical_search.Slice(np.arange(1600), np.full(1600, 20), indptr, terms, rng.integers(1, 4, len(terms)), (1600, 32000), np.full(241, 3000, np.int64))
    own, starts, summary, at = index.blocks(0, np.arange(len(index.columns)))
    assert sorted(own) == list(range(1600)) and len(starts) > 10
    block = np.repeat(np.arange(len(starts)), np.diff(starts, append=1600))
    assert (index.matrix[own] <= summary[block]).all()
    asked, scored = [np.concatenate(([0], 1 + np.arange(10)))], []
    full = index.scores(np.arange(1600), index.place[asked[0]])
    real = index.scores
    index.scores = lambda docs, columns: scored.append(len(docs)) or real(docs, columns)
    top = lexical_search.Top(10, int(np.sort(full)[-10]))
    lexical_search._search(index, list(range(1600)), asked, [top])
    assert [-r[0] for r in top.rows] == np.sort(full)[::-1][:10].tolist()
    assert sum(scored) < 800


def test_search_equals_sql(spark, sf):
    compare(lexical_search.op13_lexical_search(spark, sf), connect(sf), lexical_search.ORACLE)
