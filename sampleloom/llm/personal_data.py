"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

1. One pass over the texts finds base spans (fixed patterns with their checks) and looser candidates: spelled-out addresses, IPv6,
   numbers grouped or glued in other ways, national phone numbers, heads of numbers that run into the next one, dotted numbers.
   Labelers (patterns, checks, gazetteers of registries, words around, neighbouring data) vote yes, no or nothing on each. The rows, without their texts, are saved.
2. Candidates with equal votes are counted on Spark. From these counts alone EM estimates, for each kind, how often it is
   real and what each labeler says of real and of other spans: all candidates count, however many.
3. A logistic regression on shapes, edges and words around the spans is trained on the labelers' joint verdicts, for SAMPLE different candidates of a kind at most.
4. The saved candidates are scored. Base spans stay; of the others those with a score of at least `threshold` are added, the best
   first, where they overlap none that is there already.

No text is shuffled or written; what meets in groups are vote patterns and hashed features, summed in each task first.

Defined results: null and empty texts have no spans; positions are code points, ends exclusive; texts are read whole, in linear time; repeated rows and equal ids
are rows of their own; a table without candidates has no classifier and so just base spans. Clashing and further columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sampleloom.llm.common import map_text, saved, table

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Different candidates of a kind that the classifier is trained on at most.
SAMPLE = 10_000
#: Hashed features.
DIMS = 1 << 14
#: How sure the classifier has to be of a span that isn't a base span.
THRESHOLD = 0.8
#: Characters before and after a span in which words are looked at, and in which other data is a neighbour.
BEFORE, AFTER, NEAR = 40, 20, 80

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63}){1,5}", re.I)
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![0-9A-Za-z:])")
_GROUPED = re.compile(r"(?<![0-9A-Za-z])[0-9]{3,6}(?:[./_][0-9]{3,6}){2,4}(?![0-9A-Za-z])")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ ./-]{1,2}[0-9]{2,5}){2,4}(?![0-9A-Za-z])")
_THREES = re.compile(r"[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}")
_DOTTED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){2,4}(?![0-9])")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+")

# Words that announce or deny a kind of data (four languages), and public registries' prefixes.
_FOR = {
    EMAIL: {"email", "mail", "mailto", "contact", "write", "correo", "courriel", "adresse", "schreiben", "contacto"},
    IP: {"ip", "host", "server", "address", "client", "from", "servidor", "serveur", "adresse", "login", "connexion"},
    CARD: {"card", "visa", "mastercard", "amex", "credit", "debit", "tarjeta", "carte", "karte", "kreditkarte", "payment", "pago"},
    PHONE: {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefono", "móvil", "llamar", "téléphone", "portable", "telefon", "handy", "anrufen"},
}
_AGAINST = {"version", "v", "isbn", "issn", "order", "invoice", "section", "chapter", "figure", "fig", "table", "part", "serial", "model", "pages", "page", "pedido", "factura", "commande", "facture", "bestellung", "rechnung", "kapitel", "eur", "usd", "doi"}
_TLDS = {"com", "org", "net", "edu", "gov", "info", "io", "biz", "de", "fr", "es", "it", "uk", "us", "eu", "nl", "ch", "at", "be", "pl", "ru", "jp", "cn", "in", "br", "mx", "ar", "ca", "au", "se", "no", "dk", "fi", "pt"}
_CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "351", "352", "353", "354", "358", "359", "380", "420", "421", "972")
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[4-7]|30|38|6011|62|65")


class Span(NamedTuple):
    kind: int
    start: int
    end: int
    base: bool


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _byte(part: str) -> bool:
    own = part.lstrip("0")
    return len(own) < 4 and int(own or "0") <= 255


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int, int]]]:
    """The base spans by kind and start, and the matches (kind, start, end) that fail their kind's check."""
    out, failed, end = [], [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            out.append(Span(EMAIL, start, end, True))
    for m in _IP.finditer(text):
        if all(map(_byte, m[0].split("."))):
            out.append(Span(IP, m.start(), m.end(), True))
        else:
            failed.append((IP, m.start(), m.end()))
    for m in _DIGITS.finditer(text):
        n = m.end() - m.start()
        if n < 7:
            continue
        digits = only_digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(Span(CARD, m.start(), m.end(), True))
        elif len(digits) >= 7:
            failed.append((CARD, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(only_digits(m[0])) <= 15:
            out.append(Span(PHONE, m.start(), m.end(), True))
        else:
            failed.append((PHONE, m.start(), m.end()))
    return out, failed


def _heads(text: str, kind: int, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Of a match that runs into further numbers: the parts between its spaces that could stand alone."""
    parts = [m.span() for m in re.finditer(r"[^ ]+", text[start:end])]
    low, high = (13, 19) if kind == CARD else (8, 15)
    for i in range(len(parts) if kind == CARD else 1):
        digits = 0
        for a, b in parts[i : i + 8]:
            digits += sum("0" <= c <= "9" for c in text[start + a : start + b]) if b - a <= high + 8 else high + 1
            if digits > high:
                break
            if digits >= low:
                yield kind, start + parts[i][0], start + b


def candidates(text: str) -> list[Span]:
    """Base spans and looser ones that overlap none of them, each place and kind once, by kind and start."""
    base, failed = base_spans(text)
    loose: set[tuple[int, int, int]] = set()
    for kind, start, end in failed:
        if kind == IP or end - start <= 40:
            loose.add((kind, start, end))
        if kind != IP and end - start > 12:
            loose.update(_heads(text, kind, start, end))
    if "dot" in text or "DOT" in text:
        loose.update((EMAIL, *m.span()) for m in _SPELLED.finditer(text))
    if text.count(":") > 1:
        loose.update((IP, *m.span()) for m in _IPV6.finditer(text))
    if _DIGIT.search(text):
        loose.update((CARD, *m.span()) for m in _GROUPED.finditer(text) if 13 <= len(only_digits(m[0])) <= 19)
        loose.update((PHONE, *m.span()) for m in _NATIONAL.finditer(text) if 7 <= len(only_digits(m[0])) <= 13 and (m[0][0] in "(0" or _THREES.fullmatch(m[0]) or set(_around(text, m.start(), m.end())[0]) & _FOR[PHONE]))
        loose.update((IP, *m.span()) for m in _DOTTED.finditer(text))
    merged: list[list[int]] = []
    for start, end in sorted((s.start, s.end) for s in base):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    free = lambda start, end: (at := bisect.bisect_left(merged, [end])) == 0 or merged[at - 1][1] <= start
    return sorted([*base, *(Span(*x, False) for x in loose if free(x[1], x[2]))])


def _around(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    before = [w.lower() for w in _WORD.findall(text[max(0, start - BEFORE) : start])][-4:]
    return before, [w.lower() for w in _WORD.findall(text[end : end + AFTER])][:2]


def votes(text: str, span: Span, before: list[str], near: bool) -> tuple[int, ...]:
    """1 yes, 0 nothing, -1 no, of each labeler in LABELERS."""
    own, digits = text[span.start : span.end], only_digits(text[span.start : span.end])
    edge = text[max(0, span.start - 1) : span.start] + text[span.end : span.end + 1]
    if span.kind == EMAIL:
        domain = re.split(r"@|\(at\)|\[at\]| at ", own, flags=re.I)[-1]
        end = re.split(r"\.|\(dot\)|\[dot\]| dot ", domain, flags=re.I)[-1].strip().lower()
        shape, check, registry = (1 if span.base or re.search(r"[(\[]", own) else 0), (-1 if ".." in own or own[0] in ".-" else 0), (1 if end in _TLDS else -1)
    elif span.kind == IP:
        parts = own.split(".")
        four = len(parts) == 4
        shape = 1 if (four or own.count(":") >= 4) else -1
        check = (1 if all(map(_byte, parts)) else -1) if four else (-1 if len(parts) > 1 else 0)
        registry = (-1 if parts[0].lstrip("0") in ("", "127", "255") or any(len(p) > 1 and p[0] == "0" for p in parts) else 0) if four else 0
    elif span.kind == CARD:
        groups = [len(g) for g in re.findall("[0-9]+", own)]
        shape = 1 if groups == [len(digits)] or groups[:-1] == [4] * (len(groups) - 1) and groups[-1] <= 4 or groups == [4, 6, 5] else -1
        check = 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
        registry = 1 if _ISSUERS.match(digits) else -1
    else:
        groups = [len(g) for g in re.findall("[0-9]+", own)]
        shape = 1 if own[0] in "+(" or groups[-2:] == [3, 4] else (-1 if len(groups) == 1 else 0)
        check = 1 if 9 <= len(digits) <= 15 else -1
        registry = (1 if digits.startswith(_CALLING) else -1) if own[0] == "+" else (1 if digits[0] == "0" else 0)
    words = set(before)
    said, denied = (1 if words & _FOR[span.kind] else 0), (-1 if words & _AGAINST else 0)
    glued = -1 if any(c.isalnum() or c in "_/=$€#-" for c in edge) else 0
    dull = -1 if digits and (len(set(digits)) <= 2 or digits in "01234567890123456789") else 0
    return shape, check, registry, said, denied, (1 if near else 0), glued, dull


#: What is known isn't estimated: a card's check digit is right but for a slip of the pen, and one other number in ten passes it by chance. Votes -1, 0, 1 on others and on real ones.
#: An address with a part over 255 is none.
KNOWN = {IP: {1: ((0.5, 0.25, 0.25), (0.001, 0.2, 0.799))}, CARD: {1: ((0.88, 0.02, 0.1), (0.01, 0.01, 0.98))}}
LABELERS = ("shape", "check", "registry", "words_for", "words_against", "neighbour", "edges", "dull")


def _hash(kind: int, name: str, value: object) -> int:
    return zlib.crc32(f"{kind}|{name}|{value}".encode()) % DIMS


def features(text: str, span: Span, before: list[str], after: list[str], near: bool, said: bool) -> list[int]:
    own = text[span.start : span.end][:80]
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 17)}", own))
    k, digits = span.kind, only_digits(own)
    named = [("bias", ""), ("shape", shape[:40]), ("first", own[0] if not own[0].isalnum() else "w"), ("digits", len(digits)), ("head", digits[:1]), ("left", _class(text[span.start - 1 : span.start])), ("right", _class(text[span.end : span.end + 1])), ("near", near), ("said", said)]
    named += [("sum", luhn(digits) if k == CARD else None), ("signs", "".join(sorted({c for c in own if not c.isalnum()}))), ("end", own.rsplit(".", 1)[-1].lower() if k == EMAIL else None), ("denied", bool(set(before) & _AGAINST))]
    named += [("before", w) for w in before[-2:]] + [("after", w) for w in after[:1]]
    return sorted({_hash(k, n, v) for n, v in named})


def _class(c: str) -> str:
    return "" if not c else "s" if c.isspace() else "a" if c.isalpha() else "9" if c.isdigit() else c


def voted(texts: list[str | None]) -> list[list]:
    """For each text: counts of base spans by kind, and its candidates (kind, start, end, base, votes, features)."""
    counts, found = [[], [], [], []], []
    for text in texts:
        own = candidates(text) if text else []
        sure = [s for s in own if s.base]
        for k in range(4):
            counts[k].append(sum(s.kind == k for s in sure))
        places = sorted((s.start, s.end) for s in sure)
        rows = []
        for s in own:
            near = any(a - NEAR < s.end and s.start < b + NEAR and (a, b) != (s.start, s.end) for a, b in _close(places, s))
            before, after = _around(text, s.start, s.end)
            v = votes(text, s, before, near)
            rows.append({"kind": s.kind, "start": s.start, "end": s.end, "base": s.base, "votes": sum((x + 1) * 3**i for i, x in enumerate(v)), "features": features(text, s, before, after, near, v[3] > 0)})
        found.append(rows)
    return [*counts, found]


def _close(places: list[tuple[int, int]], span: Span) -> list[tuple[int, int]]:
    """The base spans that begin nearest to it."""
    at = bisect.bisect_left(places, (span.start,))
    return places[max(0, at - 2) : at + 2]


def _decoded(code: int) -> list[int]:
    return [code // 3**i % 3 for i in range(len(LABELERS))]


class Reliability(NamedTuple):
    """Of one kind: how often its candidates are real, and P(vote | real or not) as (labelers, not or real, votes -1 0 1)."""

    real: float
    says: np.ndarray

    def verdict(self, codes: np.ndarray) -> np.ndarray:
        """The probability that a candidate with these votes is real."""
        log = np.log(self.says)
        both = np.stack([math.log(1 - self.real) + sum(log[j, 0, codes[:, j]] for j in range(codes.shape[1])), math.log(self.real) + sum(log[j, 1, codes[:, j]] for j in range(codes.shape[1]))])
        return 1 / (1 + np.exp(np.clip(both[0] - both[1], -700, 700)))


def estimate(codes: np.ndarray, counts: np.ndarray, known: dict[int, tuple] | None = None, rounds: int = 100, prior: float = 4.0) -> Reliability:
    """EM over counted vote patterns (patterns, labelers), from the majority's verdict. The prior says, with the weight of `prior`
    candidates, that a labeler speaks rather right than wrong, so that the two classes keep their meaning. `known` fixes labelers by number."""
    lean = np.array([[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]]) / 6 * prior
    total = (codes - 1).sum(axis=1)
    real = 1 / (1 + np.exp(-total.astype(float)))
    out = Reliability(0.5, np.full((codes.shape[1], 2, 3), 1 / 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - real), counts * real])
        says = np.stack([np.stack([np.bincount(codes[:, j], weight[y], minlength=3) for y in (0, 1)]) + lean for j in range(codes.shape[1])])
        says = says / says.sum(axis=2, keepdims=True)
        for j, fixed in (known or {}).items():
            says[j] = fixed
        share = (weight[1].sum() + prior) / (counts.sum() + 2 * prior)
        out = Reliability(float(share), says)
        new = out.verdict(codes)
        if np.abs(new - real).max(initial=0) < 1e-9:
            break
        real = new
    return out


def train(rows: list[list[int]], target: np.ndarray, weight: np.ndarray, rounds: int = 300, decay: float = 1e-3) -> np.ndarray:
    """Logistic regression on hashed features with soft targets, by adaptive gradient steps."""
    at, of = np.array([f for r in rows for f in r], np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, squares, weight = np.zeros(DIMS), np.full(DIMS, 1e-8), weight / weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[at], len(rows)), -30, 30)))
        g = np.bincount(at, ((p - target) * weight)[of], DIMS) + decay * w / DIMS
        squares += g * g
        w -= 0.5 * g / np.sqrt(squares)
    return w


def chance(w: np.ndarray, feature_ids: list[int]) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[feature_ids].sum())))))


CANDIDATE = "array<struct<kind:int,start:int,end:int,base:boolean,votes:int,features:array<int>>>"


def supervise(found: DataFrame) -> tuple[dict[int, Reliability], np.ndarray | None]:
    """Reliabilities of the labelers by kind, and the classifier's weights (None without candidates)."""
    each = found.select(F.explode("candidates").alias("c")).select("c.*")
    patterns: dict[int, list] = {}
    for kind, code, n in each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect():
        patterns.setdefault(kind, []).append((code, n))
    model = {k: estimate(np.array([_decoded(c) for c, _ in rows]), np.array([float(n) for _, n in rows]), KNOWN.get(k)) for k, rows in ((k, sorted(v)) for k, v in sorted(patterns.items()))}
    if not model:
        return {}, None
    different = each.groupBy("kind", "votes", "features").agg(F.count("*").alias("n"))
    order = Window.partitionBy("kind").orderBy(F.xxhash64("features", "votes"), "votes")
    sample = different.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SAMPLE).select("kind", "votes", "features", "n").collect()
    sample.sort(key=lambda r: (r[0], r[1], r[2]))
    target = np.array([float(model[r[0]].verdict(np.array([_decoded(r[1])]))[0]) for r in sample])
    # each kind weighs the same; frequent candidates by the logarithm of their number
    own = np.array([1 + math.log(r[3]) for r in sample])
    share = np.bincount([r[0] for r in sample], own, 4)
    return model, train([r[2] for r in sample], target, own / share[[r[0] for r in sample]])


def chosen(rows: list[dict] | None, w: np.ndarray | None, threshold: float) -> list[dict]:
    """Base spans, and the best of the others that overlap nothing chosen before, by kind and start."""
    out = [{"kind": r["kind"], "start": r["start"], "end": r["end"], "base": True, "score": 1.0} for r in rows or () if r["base"]]
    cells: dict[int, list[tuple[int, int]]] = {}

    def put(start: int, end: int) -> None:
        for c in range(start // 64, (end - 1) // 64 + 1):
            cells.setdefault(c, []).append((start, end))

    for r in out:
        put(r["start"], r["end"])
    others = [] if w is None else sorted((-chance(w, r["features"]), r["start"], -r["end"], r["kind"]) for r in rows or () if not r["base"])
    for score, start, end, kind in others:
        if -score < threshold:
            break
        if not any(a < -end and start < b for c in range(start // 64, (-end - 1) // 64 + 1) for a, b in cells.get(c, ())):
            put(start, -end)
            out.append({"kind": kind, "start": start, "end": -end, "base": False, "score": -score})
    return sorted(out, key=lambda r: (r["kind"], r["start"], r["end"]))


def find(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (or only `keep`, which need not have the text; what is kept is saved between the passes) and n_email, n_ip, n_card, n_phone (base spans), spans array<struct<kind, start, end, base, score>>."""
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {"n_email", "n_ip", "n_card", "n_phone", "spans", "candidates"}]
    found = saved(map_text(docs, text_col, f"n_email long, n_ip long, n_card long, n_phone long, candidates {CANDIDATE}", lambda: voted, keep=kept), "candidates")
    _, w = supervise(found)
    names = [*kept, "n_email", "n_ip", "n_card", "n_phone"]

    def run(batches):
        for b in batches:
            spans = [[s | {"kind": KINDS[s["kind"]]} for s in chosen(rows, w, threshold)] for rows in b.column(len(names)).to_pylist()]
            made = pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], made], names=[*names, "spans"])

    schema = found.select(*[F.col(f"`{c}`") for c in names], F.expr("cast(null as array<struct<kind:string,start:int,end:int,base:boolean,score:double>>)").alias("spans")).schema
    return found.select(*[F.col(f"`{c}`") for c in [*names, "candidates"]]).mapInArrow(run, schema)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of base spans, the digest of their places, and all spans."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", F.sha2(said(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    )

