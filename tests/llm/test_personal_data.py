"""Base spans against the plain patterns, EM against simulated labelers, added spans against planted data."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from sampleloom.llm import personal_data as pii

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(re.sub("[^0-9]", "", s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def plain(text):
    return [(kind, m.start(), m.end()) for kind, pattern, good in PLAIN for m in re.finditer(pattern, text or "") if good(m[0])]


def card(rng):
    own = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(own + d for d in "0123456789" if pii.luhn(own + d))


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


@pytest.mark.parametrize("alphabet", ["ab.@-%1", "0123456789.", "01 -", "+01 ().-9", "a@b.c+1234 5-6().é\n"])
def test_base_spans_equal_the_plain_patterns(alphabet):
    rng = random.Random(alphabet)
    pieces = ["user@host.example.com", "10.0.0.255", "4111 1111 1111 1111", "+1 (366) 555-9807", "@", "..", card(rng)]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.5:
            text += rng.choice(pieces) + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9)))
        assert [(pii.KINDS[s.kind], s.start, s.end) for s in pii.base_spans(text)[0]] == plain(text), text


def test_long_texts_take_linear_time():
    for text in ("x" * 300_000 + "@", "1" * 300_000, "1 " * 150_000, "1." * 150_000, "+1" + "(" * 300_000, "a@" * 150_000, "1:" * 150_000, "(at)dot " * 40_000, "4111-" * 60_000):
        pii.voted([text])


def test_em_finds_what_labelers_are_worth():
    rng = np.random.default_rng(4)
    n, real = 60_000, 0.3
    truth = rng.random(n) < real
    right, speaks = np.array([0.95, 0.9, 0.8, 0.7, 0.55]), np.array([0.9, 0.6, 0.8, 0.5, 0.9])
    codes = np.where(rng.random((n, 5)) < speaks, np.where((rng.random((n, 5)) < right) == truth[:, None], 2, 0), 1)
    patterns, counts = np.unique(codes, axis=0, return_counts=True)
    got = pii.estimate(patterns, counts.astype(float))
    assert abs(got.real - real) < 0.02
    for j in range(5):
        assert abs(got.says[j, 1, 2] - speaks[j] * right[j]) < 0.03 and abs(got.says[j, 0, 0] - speaks[j] * right[j]) < 0.03
    assert ((got.verdict(codes) > 0.5) == truth).mean() > 0.95


def corpus(seed, n=600):
    """Texts with planted data beyond the base patterns, and with numbers that are none; what is planted as text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    out = []
    for i in range(n):
        c = card(rng)
        phone = f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{digits(4)}"
        spelled = f"{word()} (at) {word()} (dot) com"
        dotted = ".".join((c[:4], c[4:8], c[8:12], c[12:]))
        bad = next(c[:-1] + d for d in "0123456789" if not pii.luhn(c[:-1] + d))
        kinds = [
            ("email", f"{word()}@{word()}.com", True), ("card", c, True), ("phone", f"+1 ({rng.randint(200, 999)}) 555-{digits(4)}", True), ("ip", ".".join(str(rng.randint(1, 254)) for _ in range(4)), True),
            ("email", "contact " + spelled, spelled), ("phone", "call " + phone, phone), ("card", "card " + dotted, dotted),
            ("", f"version {rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", False), ("", f"order {digits(9)}", False), ("", bad, False), ("", f"isbn 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", False), ("", f"{digits(5)} {word()} {digits(3)}", False),
        ]
        kind, said, want = kinds[i % len(kinds)]
        text = " ".join([*(word() for _ in range(12)), said, *(word() for _ in range(12))])
        out.append((i, text, kind, want))
    return out


def test_added_spans(spark):
    rows = corpus(1)
    got = pii.find(spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")).collect()
    added = {r["doc_id"]: [(s["kind"], r["text"][s["start"] : s["end"]]) for s in r["spans"] if not s["base"]] for r in got}
    wanted = [(i, kind, want) for i, _, kind, want in rows if isinstance(want, str)]
    found = sum((kind, want) in added[i] for i, kind, want in wanted)
    assert found >= 0.9 * len(wanted), (found, len(wanted))
    assert sum(bool(added[i]) for i, _, _, want in rows if want is False) <= 0.02 * len(rows)
    for r in got:
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        assert all(a[1] <= b[0] or b[1] <= a[0] for k, a in enumerate(spans) for b in spans[k + 1 :])


def test_whole_rows(spark, messy, small, sf):
    """Base counts and digests against the plain patterns; every row once, whatever it holds."""
    got = pii.find(messy)
    assert got.columns[: len(messy.columns)] == messy.columns and got.count() == messy.count()
    from sampleloom.llm.registry import QUERIES

    rows = QUERIES["op12_personal_data"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    assert len(rows) == small.count() > 0
    for r in rows:
        want = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS]
        said = r["spans"].split(",") if r["spans"] else []
        assert set(f"{k}:{s}:{e}" for k, s, e in want) <= set(said) and len(said) == len(want) + r["n_added"]


def test_nothing_to_find(spark, empty):
    assert pii.find(empty).count() == 0
    plain_ = spark.createDataFrame([(1, "no data here"), (2, None)], "doc_id long, text string")
    assert [r["spans"] for r in pii.find(plain_).collect()] == [[], []]
