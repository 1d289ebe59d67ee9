"""Quality rules, language ID, near-duplicates, decontamination and licences against brute force."""

from __future__ import annotations

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sampleloom.llm import decontaminate, language_id, license_scan, quality_rules, simhash_dedup
from tests.oracle import compare, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# quality


def base_of(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = Counter(zip(w, w[1:], w[2:]))
    hit = {p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    n = len(w)
    return n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_base_metrics(messy, small, spark):
    odd = spark.createDataFrame([(1, t) for t in ["a b c a b c", "a a a a", "a b", "x\n\nx\n x\n", "a b c d a b c", "a\x0bb\x0cc d", "é# ü$ |\n|\n|"]], "doc_id long, text string")
    for df in (messy, small, odd):
        rows = quality_rules.with_base(df).select("text", *quality_rules.BASE, "base_failed").collect()
        for r in rows:
            assert tuple(r)[1:] == base_of(r.text)


def test_rules_on_messy_and_empty(messy, empty):
    rows = quality_rules.quality(messy).collect()
    assert len(rows) == messy.count() and all(not r.kept for r in rows if r.base_failed)
    assert quality_rules.quality(empty).count() == 0
    kept = quality_rules.keep_good(messy)
    assert kept.columns == messy.columns
    assert quality_rules.keep_good(empty).count() == 0


def test_rules_equal_sql(spark, sf):
    compare(quality_rules.op1_quality_rules(spark, sf), connect(sf), quality_rules.ORACLE)


def test_many_groups_are_joined_by_salt(small, monkeypatch):
    want = quality_rules.quality(small).collect()
    monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", 0)
    assert sorted(quality_rules.quality(small).collect()) == sorted(want)


def test_sketch_quantiles_are_within_the_error(spark):
    df = spark.range(1, 5001).selectExpr("'l' as lang", "'s' as source", "id * 7 as word_chars", "1000L as n_words", "0L as n_symbols", "0L as n_dup_lines", "0L as n_repeat_words", "1L as n_lines", "false as base_failed")
    q = quality_rules.quantiles(quality_rules.sketches(df), "lang", "source").filter("metric = 'word_len'").head()
    for got, want in ((q.low, 500 * 7), (q.mid, 2500 * 7), (q.high, 4500 * 7)):
        assert abs(got - want) <= 0.011 * want
    halves = quality_rules.sketches(df.filter("word_chars < 9000")).unionByName(quality_rules.sketches(df.filter("word_chars >= 9000")))
    assert quality_rules.quantiles(quality_rules.merged(halves, "lang"), "lang").filter("metric = 'word_len'").head().mid == q.mid


def measured_rows(spark, groups):
    """Documents of 200 words; groups are (lang, source, the symbols of each document)."""
    rows = [(i, lang, source, 200, 1000 + (i % 40), symbols, 0, 0, 10, False) for lang, source, all_ in groups for i, symbols in enumerate(all_)]
    return spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, base_failed boolean")


def symbol_fences(spark, groups):
    df = measured_rows(spark, groups)
    found = quality_rules.thresholds(quality_rules.sketches(df))
    kept = {(r.source, r.n_symbols) for r in quality_rules.judged(df, found).filter("kept").collect()}
    return {r.source: (r.own, r.high) for r in found.filter("metric = 'symbols'").collect()}, kept


def test_fences_are_learned_for_each_source(spark):
    web = [0] * 460 + [60 + i % 500 for i in range(40)]  # a rare population of its own, far from one symbol a document
    code = [40 + i % 100 for i in range(400)] + [0] * 100  # symbols are the rule
    shifted = [4 * (40 + i % 100) for i in range(400)] + [0] * 100
    prose = [0] * 400 + [1 + i % 3 for i in range(100)]  # rare, but a symbol or two: the tail of the clean ones
    fences, kept = symbol_fences(spark, [("en", "web", web), ("en", "code", code), ("en", "shifted", shifted), ("en", "prose", prose)])
    assert fences["web"][0] > 0.6 and fences["code"][0] == fences["shifted"][0] == 0
    assert {n for s, n in kept if s == "web"} == {0}
    assert {n for s, n in kept if s == "code"} == set(code) and {n for s, n in kept if s == "shifted"} == set(shifted) and {n for s, n in kept if s == "prose"} == set(prose)
    assert 3.2 < fences["shifted"][1] / fences["code"][1] < 4.1  # four times, but for what both have of their language
    # the same document goes in one source and stays in the other
    assert ("code", 100) in kept and ("web", 100) not in kept


def test_sources_with_few_values_go_by_wider_sketches(spark):
    """More of its own values move a source's fence from its language's to its own, without a jump."""
    high = []
    for n in (1, 10, 40, 400):
        fences, _ = symbol_fences(spark, [("en", "big", [0] * 2500 + [20 + i % 20 for i in range(2500)]), ("en", "small", [0] * n + [80 + 4 * (i % 20) for i in range(n)]), ("fr", "none", [0] * 9)])
        high.append(fences["small"][1])
        assert 0.2 < fences["none"][1] / fences["big"][1] < 1.2  # the corpus' deciles where there is no value
    assert high == sorted(high) and high[0] < 1.3 * fences["big"][1] and 2.5 < high[-1] / fences["big"][1] < 4.5
    assert all(b < 3 * a for a, b in zip(high, high[1:]))  # noqa: B905
    nothing, kept = symbol_fences(spark, [("en", "few", [0] * 20)])
    assert nothing == {"few": (0.0, None)} or nothing["few"][1] is None
    assert kept == {("few", 0)}


def test_verdicts_do_not_jump_with_the_corpus(spark):
    """The same shares give the same verdicts at any size, and from rare to common values ever fewer documents go."""
    gone = {}
    for n in (200, 600):
        for share in (0.05, 0.15, 0.3):
            k = int(n * share)
            values = [0] * (n - k) + [30 + int(170 * i / k) for i in range(k)]
            fences, kept = symbol_fences(spark, [("en", "made", values)])
            gone[n, share] = sum(v > 0 and ("made", v) not in kept for v in values) / k
    assert all(abs(gone[200, x] - gone[600, x]) <= 0.35 for x in (0.05, 0.15, 0.3)), gone
    assert gone[600, 0.05] == 1 and gone[600, 0.05] >= gone[600, 0.15] >= gone[600, 0.3] == 0


def test_every_ratio_can_reject(spark):
    """Junk that is within the base rules: most of its lines repeated, or nearly half of its words."""
    rows = [(i, "en", "s", 400, 2000 + i % 50, 0, (1 + i % 3) * (i % 5 == 0), (3 + i % 20) * (i % 5 == 1), 40, False) for i in range(400)]
    rows += [(-1, "en", "s", 400, 2000, 0, 36, 0, 40, False), (-2, "en", "s", 400, 2000, 0, 0, 196, 40, False), (-3, "en", "s", 400, 2000, 0, 0, 0, 40, False)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, base_failed boolean")
    found = quality_rules.thresholds(quality_rules.sketches(df))
    assert all(r.high < 1e6 for r in found.filter("metric IN ('dup_lines', 'repeats')").collect())
    kept = {r.doc_id for r in quality_rules.judged(df, found).filter("kept").select("doc_id").collect()}
    assert kept == {r[0] for r in rows} - {-1, -2}


def test_windows_whose_hashes_collide_are_compared(spark, monkeypatch):
    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *c: F.size(F.array(*c)))  # all windows collide
    df = spark.createDataFrame([(t,) for t in ["a b c d e f g", "a b c a b c", "x a b c y a b c z"]], "text string")
    assert [r.n_repeat_words for r in quality_rules.with_base(df).collect()] == [0, 6, 6]


# language


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.op3_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for n in (1, 2, 6):
        scores = rng.normal(scale=5, size=(n + 3, 3)).astype(np.float32)
        labels = language_id.viterbi(scores, np.array([n, 0, 3]), 4.0)
        for a, k in ((0, n), (n, 3)):
            value = lambda path: sum(scores[a + i, p] for i, p in enumerate(path)) - 4.0 * sum(x != y for x, y in zip(path, path[1:]))  # noqa: B023, E731
            paths = np.stack(np.meshgrid(*[range(3)] * k, indexing="ij"), -1).reshape(-1, k)
            assert abs(value(labels[a : a + k]) - max(map(value, paths))) < 1e-4


def test_mixed_text_and_scripts(spark, small):
    rows = small.select("text", "lang").union(spark.createDataFrame([("привет мир это русский текст и слова " * 5, "ru")] * 5, "text string, lang string"))
    model = language_id.fit(rows)
    en, de = (small.filter(F.col("lang") == x).filter("n_chars between 300 and 3000").head().text.split(".")[0][:200] for x in ("en", "de"))
    spans = language_id.spans_of(model, [f"{en} {de}", "мир и слова", None, "123"])
    assert [s["lang"] for s in spans[0]] == ["en", "de"] and {s["lang"] for s in spans[1]} == {"ru"} and spans[2:] == [[], []]
    pred, score, _ = language_id.predictions(model, [None, "", "12 !", "мир", "漢字"])
    assert pred[:4] == ["und", "und", "und", "ru"] and score[0] == 0 and pred[4] in model.langs


@pytest.mark.parametrize("step", [1, 7, 500])
def test_texts_are_cut_between_words_only(small, monkeypatch, step):
    texts = [r.text for r in small.limit(20).collect()] + [None, "", "x" * 3000, "мир " * 50]
    model = language_id.fit(small.limit(60))
    want = language_id.predictions(model, texts)
    monkeypatch.setattr(language_id, "STEP_BYTES", step)
    got = language_id.predictions(model, texts)
    assert got[0] == want[0] and np.allclose(got[1], want[1])
    joined: dict = {}
    for at, pieces in language_id.steps_of(texts):
        for i, piece in zip(at, pieces, strict=True):
            joined[i] = joined.get(i, "") + piece
    assert joined == {i: t for i, t in enumerate(texts) if t}


def test_language_on_messy_and_empty(messy, empty):
    model = language_id.fit(messy)
    rows = language_id.identify(messy, model, spans=True).collect()
    assert len(rows) == messy.count() and all(r.lang_pred == "und" for r in rows if not any(c.isalpha() for c in r.text or ""))
    none = language_id.fit(empty)
    assert none.langs == [] and {r.lang_pred for r in language_id.identify(messy, none).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0
    assert language_id.keep_known(messy).columns == messy.columns and language_id.keep_known(empty).count() == 0


@pytest.mark.parametrize("n", [128, 300])
def test_many_languages(n):
    scores = np.full((600, n), -9, np.float32)
    want = np.repeat(np.arange(300) * (n - 1) // 299, 2)
    scores[np.arange(600), want] = 0
    assert (language_id.viterbi(scores, np.array([600]), 4.0) == want).all()


def brute_language(model, text):
    """Prediction, score and certainty by their definitions, word by word."""
    words, run = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            run += c
        elif run:
            words.append(run)
            run = ""
    kind, scored = language_id._letters(), []
    for w in words:
        own = language_id.words_of([w])
        s = sum(model.weight[own.feature[i]].astype(float) for i in range(len(w))) + model.weight[own.whole[0]]
        fits = model.candidate[kind[ord(w[0])]]
        scored.append(np.where(fits if fits.any() else ~fits, np.maximum(s - s.max(), -12), -30))
    paths = [(scored[0][k], [k]) for k in range(len(model.langs))]
    for s in scored[1:]:
        paths = [max(((v - (language_id.SWITCH if p[-1] != k else 0) + s[k], [*p, k]) for v, p in paths), key=lambda x: x[0]) for k in range(len(s))]
    label = max(paths, key=lambda x: x[0])[1]
    letters, sure = Counter(), Counter()
    for w, s, k in zip(words, scored, label, strict=True):
        letters[k] += len(w)
        sure[k] += len(w) * np.exp(s[k]) / np.exp(s).sum()
    best = max(sorted(letters), key=lambda k: letters[k])
    return model.langs[best], sure[best] / letters.total(), sure.total() / letters.total()


def test_predictions_equal_their_definition(small):
    model = language_id.fit(small.limit(80))
    texts = [r.text[:400] for r in small.limit(40).collect()]
    texts += [a[:150] + ". " + b[-150:] for a, b in zip(texts[:20], texts[20:], strict=True)]
    texts = [t for t in texts if any(map(str.isalpha, t))]
    got = language_id.predictions(model, texts)
    for t, pred, score, certain in zip(texts, *got, strict=True):
        want = brute_language(model, t)
        assert pred == want[0] and abs(score - want[1]) < 1e-3 and abs(certain - want[2]) < 1e-3


def test_rare_languages_and_copies_in_the_sample(spark):
    rows = [(f"text number {i} of the common language", "aa") for i in range(900)] + [("one text that is there many times", "aa")] * 500 + [("selten und kurz", "zz"), (None, "zz"), ("x", None)]
    sample = language_id.training_sample(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", 200).collect()
    n = Counter(r.lang for r in sample)
    assert n["zz"] == 1 and 60 < n["aa"] < 150 and len(set(sample)) == len(sample)


def test_a_text_in_many_languages_is_known(spark):
    rng = random.Random(3)
    words = {lang: ["".join(rng.choice(letters) for _ in range(6)) for _ in range(60)] for lang, letters in zip("pqrst", ["abcde", "fghij", "klmno", "uvwxy", "éèàùç"], strict=True)}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(40)), lang) for i, lang in enumerate(list(words) * 12)]
    rows.append((1000, " ".join(" ".join(words[lang][:20]) for lang in words), "p"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(df, language_id.fit(df), keep=["doc_id"]).filter("doc_id = 1000").head()
    assert got.score < 0.3 and got.certainty > 0.8
    assert language_id.keep_known(df).filter("doc_id = 1000").count() == 1


def test_fit_is_bounded_and_repeatable(small):
    few = language_id.training_sample(small, "text", "lang", 50)
    assert few.count() < 100 and sorted(few.collect()) == sorted(language_id.training_sample(small.repartition(3), "text", "lang", 50).collect())


# near-duplicates


def fingerprint_of(text):
    w = [x.encode() for x in WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))]
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(fps, ids, radius):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                label[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(fps))]


def test_near_duplicates_on_tables(spark, sf, messy, empty):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), messy):
        rows, texts = simhash_dedup.near_duplicates(df).collect(), Counter((r.doc_id, f"{fingerprint_of(r.text):016x}") for r in df.collect())
        assert Counter((r.doc_id, r.fingerprint) for r in rows) == texts
        want = groups_of([int(r.fingerprint, 16) for r in rows], [r.doc_id for r in rows], 2)
        assert [r.component_id for r in rows] == want
    assert simhash_dedup.near_duplicates(empty).count() == 0
    assert "xxhash64" and spark.sql("select hex(xxhash64('a b c')) as h").head().h == f"{xxhash.xxh64_intdigest(b'a b c', 42):016X}"


@pytest.mark.parametrize("radius", [2, 4])
def test_components_of_chains_and_hot_fingerprints(spark, radius):
    rng = random.Random(radius)
    fps, base = [], rng.getrandbits(64)
    for _ in range(30):  # a chain: each within the radius of the one before
        fps.append(base)
        for b in rng.sample(range(64), rng.randint(1, radius)):
            base ^= 1 << b
    centre = rng.getrandbits(64)
    fps += [centre ^ 1 << b for b in range(0, 64, 3)] + [centre] * 300 + [rng.getrandbits(64) for _ in range(50)]
    ids = list(range(len(fps)))
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in zip(ids, fps, strict=True)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in df.join(simhash_dedup.components(df, radius), "fp").collect()}
    assert [got[i] for i in ids] == groups_of(fps, ids, radius)


def test_one_of_each_group_stays(messy, empty, small):
    kept = simhash_dedup.keep_one(messy)
    assert kept.columns == messy.columns
    rows = simhash_dedup.near_duplicates(messy).collect()
    named = {r.component_id for r in rows} - {None}
    nameless = sum(r.component_id is None for r in rows)
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and set(ids) - {None} == named and ids.count(None) == nameless
    assert simhash_dedup.keep_one(empty).count() == 0
    groups = simhash_dedup.near_duplicates(small)
    assert sorted(r.doc_id for r in simhash_dedup.keep_one(small).collect()) == sorted(r[0] for r in groups.select("component_id").distinct().collect())
    with pytest.raises(ValueError):
        simhash_dedup.ball(3)


@pytest.mark.parametrize("hot", [1, 1024])
def test_rows_of_one_doc_id_are_known_by_their_text(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash_dedup, "HOT", hot)
    a, b, c = ("the first text of all, about rivers", "quite another one that is of stones", "a third text for those without an id")
    rows = [(1, a, "x"), (2, b, "x"), (2, a, "x"), (3, c, "y"), (3, c, "x"), (3, c, "x"), (None, a, "z"), (None, "nothing like the others here at all", "z")] + [(7, "many rows that are the same in all", "w")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, `odd.name` string").withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    got = [(r.doc_id, r.text) for r in simhash_dedup.keep_one(df).collect()]
    assert Counter(got) == Counter([(1, a), (2, b), (3, c), (None, "nothing like the others here at all"), (7, "many rows that are the same in all")])


# decontamination


def brute(text, items):
    words = re.findall(r"\w+", (text or "").lower())
    out = {}
    for item, other in items:
        want = re.findall(r"\w+", (other or "").lower())
        if not want:
            continue
        k = min(5, len(want))
        grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))  # noqa: B023, E731
        b = grams(want)
        best = 0.0
        for p in range(len(words) - len(want) + 1):
            a = grams(words[p : p + len(want)])
            common = sum((a & b).values())
            best = max(best, common / (a.total() + b.total() - common))
        if best >= 0.8:
            out[item] = round(best, 9)
    return out


def test_leaks_equal_brute_force(spark, sf):
    rng = random.Random(5)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for _, t in items:
        w = t.split()
        for _ in range(2):
            v = w[:]
            k = rng.randrange(len(v))
            v[k : k + rng.randint(0, 1)] = ["zzz"] * rng.randint(0, 2)
            texts.append("before it " + " ".join(v).upper() + " after, it")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([*items, (900, "two words"), (901, None), (902, "!?")], "item_id long, text string")
    texts_items = [*items, (900, "two words")]
    got: dict = {}
    for r in decontaminate.find_leaks(docs, bench).collect():
        got.setdefault(r.doc_id, {})[r.item_id] = round(r.similarity, 9)
    assert got == {i: x for i, t in enumerate(texts) if (x := brute(t, texts_items))}


def test_documents_shorter_than_an_item(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items += [(903, "one two three four five six seven eight nine"), (904, "one two three four five"), (905, "two words")]
    texts = ["one two three four five six seven eight", "two three four five six seven eight nine", "one two three four five six seven", "one two three four", "two", "", None]
    for _, t in items:
        w = t.split()
        texts += [" ".join(w[:-k]) for k in range(1, 15)] + [" ".join(w[k:]) for k in (1, 4, 9)] + [" ".join([*w[:20], *w[22:]])]
    grams = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    def whole(text):
        words, out = re.findall(r"\w+", (text or "").lower()), {}
        for item, other in items:
            want = re.findall(r"\w+", other.lower())
            if len(words) < len(want):
                a, b = grams(words, min(5, len(want))), grams(want, min(5, len(want)))
                score = (a & b).total() / (a | b).total()
                if score >= 0.8:
                    out[item] = (0, len(words), round(score, 9))
        return out

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    length = {i: len(re.findall(r"\w+", t)) for i, t in items}
    got: dict = {}
    for r in decontaminate.find_leaks(docs, bench).collect():
        if len(re.findall(r"\w+", texts[r.doc_id])) < length[r.item_id]:
            got.setdefault(r.doc_id, {})[r.item_id] = (r.start_word, r.n_words, round(r.similarity, 9))
    want = {i: x for i, t in enumerate(texts) if (x := whole(t))}
    assert got == want and {0, 1} <= set(want) and len(want) > len(items)
    kept = {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()}
    assert not kept & set(want)


def test_decontamination_in_blocks_and_edges(spark, sf, messy, empty, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = sorted(decontaminate.op5_decontaminate(spark, sf).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    assert sorted(decontaminate.op5_decontaminate(spark, sf).collect()) == want and want
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({r.doc_id for r in want})
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(messy, bench.filter("false")).count() == 0
    assert decontaminate.keep_clean(messy, bench).count() == messy.count() and decontaminate.keep_clean(messy, bench).columns == messy.columns


def test_blocks_find_all_within_the_radius():
    rng = random.Random(1)
    prints = [rng.getrandbits(64) for _ in range(50)]
    near, far = [], []
    for f in prints:
        flips = rng.sample(range(64), decontaminate.RADIUS + 1)
        far.append(f ^ sum(1 << b for b in flips))
        near.append(f ^ sum(1 << b for b in flips[1:]))
    as_array = lambda x: np.array(x, np.uint64)
    assert decontaminate.close(as_array(near), as_array(prints)).all() and not decontaminate.close(as_array(far), as_array(prints)).any()


@pytest.mark.parametrize("step", [3, 1 << 16])
def test_items_that_are_alike(monkeypatch, step):
    """Templates: all items share most shingles; documents hold edited copies, runs of them, and repeated words."""
    monkeypatch.setattr(decontaminate, "STEP", step)
    rng = random.Random(9)
    frame = "in the year the town of had about people and the river near it was called by all who lived there for long".split()
    items = []
    for i in range(40):
        w = frame[:]
        for p in rng.sample(range(len(w)), 3):
            w[p] = f"x{rng.randrange(6)}"
        items.append((i, " ".join(w)))
    items += [(50, "so it goes " * 8), (51, "a b c d e f"), (52, "well then")]
    texts = ["start " + rng.choice(items)[1] + " middle " + rng.choice(items)[1] + " end" for _ in range(12)] + ["so it goes " * 20, "a b c d e f " * 3, "nothing at all", "well then " * 2] + [" ".join(frame)]
    bench = decontaminate.prepare(items)
    for t in texts:
        assert {i: round(s, 9) for i, start, n, s in decontaminate.leaks(bench, t) if n <= len(t.split())} == brute(t, items)
    for t in texts:  # the best window is the first of equals
        for i, start, n, s in decontaminate.leaks(bench, t):
            at = [p for p in range(len(t.split()) - n + 1) if round(brute(" ".join(t.split()[p : p + n]), [(i, dict(items)[i])]).get(i, 0), 9) == round(s, 9)]
            assert not at or start == at[0]


def test_work_does_not_grow_with_unlike_items():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = " ".join(word() for _ in range(20_000))
    took = []
    for n in (500, 10_000):
        items = [(i, " ".join(word() for _ in range(40))) for i in range(n)]
        bench = decontaminate.prepare([*items, (n, " ".join(text.split()[5000:5040]))])
        began = time.time()
        assert [x[:3] for x in decontaminate.leaks(bench, text)] == [(n, 5000, 40)]
        took.append(time.time() - began)
    assert took[1] < 4 * max(took[0], 0.05), took


# licences


@pytest.fixture(scope="module")
def scanner(small):
    return license_scan.fit(license_scan.plain_sample(small))


def test_licence_families(scanner):
    for family, notices in license_scan.NOTICES.items():
        assert [scanner.classify(n)[0] for n in notices] == [family] * len(notices)
    for strange in ("Distributed under the Eclipse Public License", "Licensed under the Foo Bar License."):
        assert scanner.classify(strange)[0] == "unknown"
    for plain in ("the cat sat on the mat", "", "2.0 and 3", "a version of the file"):
        assert scanner.classify(plain) is None or scanner.classify(plain)[0] == "unknown"
    for text, family in [
        ("This page is licensed under CC BY-SA 4.0, see below", "cc-by-sa"), ("Images: Creative Commons Attribution-NoDerivatives 4.0 International License", "cc-by-nd"), ("released under the GNU Lesser General Public License, version 2.1", "lgpl"),
        ("the Apache Software License, Version 1.1, applies", "apache-1.1"), ("BSD 2-Clause License", "bsd"), ("GNU Affero General Public License version 3", "agpl"), ("Mozilla Public License Version 2.0", "mpl"),
    ]:
        assert scanner.classify(text)[0] == family, text


def test_unseen_licences_stay_unknown(scanner, small):
    """The threshold is what the held-out licences give, and it decides: the likeliest family of some is over a half."""
    rng = random.Random(99)
    unseen = [n for notices in license_scan.HELD_OUT.values() for n in notices] + license_scan.made_notices(rng, 1, 60)
    wrong = [n for n in unseen if (got := scanner.classify(n)) and got[0] != "unknown"]
    assert len(wrong) <= 0.03 * len(unseen), wrong
    assert 0 < scanner.threshold < 1 and scanner.threshold != 0.5
    # a whole family that is not trained on is not taken for another one, but for its nearest relatives by name
    plain = license_scan.plain_sample(small)
    for left_out in ("mpl", "isc", "public-domain"):
        fewer = license_scan.fit(plain, {f: n for f, n in license_scan.NOTICES.items() if f != left_out})
        got = [fewer.classify(n) for n in license_scan.NOTICES[left_out]]
        assert all(g is None or g[0] == "unknown" for g in got), (left_out, got)
        assert fewer.threshold != scanner.threshold


def test_wordings_that_are_not_trained_on(scanner):
    """None of these is among the notices or follows a saying; the strange ones set no threshold."""
    wordings = [
        ("You can use this library under the MIT license", "mit"), ("We license our code with Apache 2.0", "apache-2.0"), ("Code covered by the BSD license, docs by nobody", "bsd"), ("Everything here is GPLv3", "gpl"), ("Free software under the GNU GPL version 3", "gpl"),
        ("available as CC BY 4.0", "cc-by"), ("All photos CC BY-NC 4.0 unless noted", "cc-by-nc"), ("This repository uses the ISC license", "isc"), ("Subject to the Mozilla Public License, version 2.0", "mpl"), ("The tool comes with the GNU Affero General Public License v3", "agpl"),
        ("you may copy it under the LGPL 2.1", "lgpl"), ("the author dedicates this to the public domain (CC0)", "public-domain"), ("docs may be shared under CC-BY-ND 4.0", "cc-by-nd"), ("License MIT", "mit"), ("Open source, Apache-2.0", "apache-2.0"),
        ("MIT licence applies to all files", "mit"), ("All texts fall under CC BY-SA 3.0", "cc-by-sa"), ("dual use under BSD terms", "bsd"),
    ]
    right = [t for t, family in wordings if (got := scanner.classify(t)) and got[0] == family]
    assert len(right) >= 0.8 * len(wordings), {t for t, _ in wordings} - set(right)
    for text, family in (("MIT licensed", "mit"), ("BSD licensed", "bsd"), ("Licensed under the Apache License v2.0", "apache-2.0"), ("Licensed under MPL 2.0", "mpl"), ("Released under the AGPL-3.0 license", "agpl"), ("LGPL v3", "lgpl"), ("Images are CC-BY-SA 4.0", "cc-by-sa")):
        assert scanner.classify(text)[0] == family, text
    for strange in ("Licensed under the NASA Open Source Agreement version 1.3", "Academic Free License version 3.0", "Released under the Reciprocal Public License", "Licensed under the Vovida Software License 1.0", "Use is subject to the Sleepycat License"):
        assert scanner.classify(strange)[0] == "unknown", strange
    for plain in ("A liquor license was denied.", "The nurse held a license in two states.", "Public transport is free in this city.", "General opinion was against the new version."):
        assert scanner.classify(plain) is None, plain


def test_wrapped_notices(scanner):
    gpl = "This program is free software: you can redistribute it and/or\nmodify it under the terms of the GNU General\nPublic License as published by the Free Software\nFoundation, either version 3 of the License"
    mit = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and\nassociated documentation files"
    text = f"A story begins here.\n{gpl}\n\nmore words that go on\n\n{mit}\nthe end of it.\n\nReleased under the MIT License.\nAll rights reserved."
    assert [(i, f) for i, f, *_ in scanner.paragraphs(text) if f != "unknown"] == [(1, "gpl"), (8, "mit"), (13, "mit"), (14, "all-rights-reserved")]


def test_scan_with_clashing_columns(spark, scanner):
    df = spark.createDataFrame([("x", "Released under the MIT License.", 5, "f")] * 2 + [("y", None, None, None)], "doc_id string, text string, paragraph int, FAMILY string")
    assert [(r.doc_id, r.paragraph, r.family) for r in license_scan.scan(df, scanner).collect()] == [("x", 0, "mit")] * 2


def test_scan_finds_the_planted_lines(spark, sf, messy, empty, scanner, small):
    marks = {"GNU General Public License": "gpl", "CC BY-NC": "cc-by-nc", "MIT License": "mit", "Apache License": "apache-2.0", "All rights reserved": "all-rights-reserved"}
    want = Counter((r.doc_id, i, f) for r in small.collect() for i, p in enumerate(r.text.split("\n")) for m, f in marks.items() if m in p)
    got = Counter((r.doc_id, r.paragraph, r.family) for r in license_scan.op8_license_scan(spark, sf).collect())
    assert got == want
    assert license_scan.scan(messy, scanner).count() == 0 and license_scan.scan(empty, scanner).count() == 0
    assert license_scan.fit(license_scan.plain_sample(empty)).classify("Released under the MIT License.")[0] == "mit"
