"""Token counts with a whole-token shortcut.

Most pre-tokens are entries of the vocabulary. Before the job, the driver runs the merges on every
entry and so proves which of them encode alone as one token; the few that do not are shipped with
the job. On the executors a pre-token that is a proven entry counts one without any merge; only the
rest is merged, and its count memoised.

Defined results: null and empty texts have 0 bytes (null: 0 as well) and 0 tokens; special strings
inside a text are one token each, as the library has it by default; repeated rows stay; an input
column with the name of an output column is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleloom.llm.bpe import pieces
from sampleloom.llm.common import map_text, table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
MEMO = 3 << 17


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Entries, merge ranks and special strings of a byte-level BPE .json file, as bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        letters = byte_letters()
        plain = lambda s: bytes(letters[c] for c in s)
        self.special = [t["content"] for t in held["added_tokens"]]
        self.entries = {plain(s) for s in held["model"]["vocab"] if s not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
        self.rank = {(plain(a), plain(b)): i for i, (a, b) in enumerate(pairs)}

    def merge(self, word: bytes) -> list[bytes]:
        """Lowest rank first, of equal ranks the leftmost; n log n by a heap of pairs over a linked list."""
        part: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if part[i] is None or (j := after[i]) >= n or rank.get((part[i], part[j])) != r:
                continue
            part[i], part[j] = part[i] + part[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((part[i], part[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank.get((part[h], part[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [p for p in part if p is not None]

    def not_alone(self) -> list[bytes]:
        """The entries that the merges do not make into one token."""
        return sorted(e for e in self.entries if len(e) > 1 and len(self.merge(e)) != 1)


class Counter(dict):
    """piece -> tokens, of a piece with one space before it; the full memo becomes the old one."""

    def __init__(self, path: str, pattern: str, not_alone: list[bytes]):
        super().__init__()
        self.merges = Merges(path)
        self.alone = self.merges.entries - set(not_alone)
        self.find = regex.compile(pattern).findall
        self.marks = {c: self.pretoken(c) for c in ".,;:!?)"}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True)))) if self.merges.special else None
        self.old: dict[str, int] = {}

    def pretoken(self, word: str) -> int:
        b = word.encode("utf-8")
        return 1 if b in self.alone else len(self.merges.merge(b))

    def whole(self, text: str) -> int:
        return sum([self[w[1:]] if w[0] == " " and w[1:].isalpha() else self.pretoken(w) for w in self.find(text)])

    def __missing__(self, piece: str) -> int:
        got = self.old.get(piece)
        if got is None:
            if piece.isalpha():
                got = self.pretoken(" " + piece)
            elif piece[-1] in self.marks and piece[:-1].isalpha():
                return self[piece[:-1]] + self.marks[piece[-1]]
            else:
                got = self.whole(" " + piece)
        if len(piece) <= 40:
            self[piece] = got
        return got

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self) > MEMO:
            self.old = dict(self)
            self.clear()
        if self.cut and (n := len(self.cut.findall(text))):
            return n + sum(self.plain(t) for t in self.cut.split(text) if t)
        return self.plain(text)

    def plain(self, text: str) -> int:
        head, *tail = pieces(text)
        return self.whole(head) + sum(map(self.__getitem__, tail))


_counters: dict[tuple[str, str], Counter] = {}
_proofs: dict[str, list[bytes]] = {}


def counter(path: str, pattern: str, not_alone: list[bytes]) -> Counter:
    """One for each worker process and file."""
    if (path, pattern) not in _counters:
        _counters[path, pattern] = Counter(path, pattern, not_alone)
    return _counters[path, pattern]


def token_counts(df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text_col: str = "text", limit: int = LIMIT, keep: list[str] | None = None) -> DataFrame:
    """Adds n_bytes, n_tokens (long) and over_limit (more than `limit` tokens)."""
    if path not in _proofs:
        _proofs[path] = Merges(path).not_alone()
    proven_not = _proofs[path]

    def make() -> Callable[[list], list]:
        count = counter(path, pattern, proven_not).count
        return lambda texts: [np.array([len(t.encode("utf-8")) if t else 0 for t in texts], np.int64), np.array([count(t) for t in texts], np.int64)]

    return map_text(df.drop("over_limit"), text_col, "n_bytes long, n_tokens long", make, keep).withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), keep=["doc_id"])
