"""Byte-level BPE encoding and decoding.

A text is cut by the tokenizer's pattern; each pre-token is encoded on its own. The bytes of a
pre-token become Latin-1 characters for an Aho-Corasick automaton over the vocabulary, which in
one pass gives the longest vocabulary entry that starts at each byte. From left to right the
longest entry is taken; if it is not compatible with the entry before it, the next shorter prefix
is tried; if none is left, the step before is undone and its end is never tried again. Each byte
position is given up at most once, so the work is linear in the length of the text.

Two adjacent entries are compatible if the merges would keep the border between them: going back
through the merge history of both, no pair at the border may have a lower rank than the merge that
removes one of its sides. Only such sequences are what the merges produce, so results are exact
(tests compare them with the library). Compatibility is memoised.

Defined results: a null or empty text has no ids and decodes to no bytes; unknown ids raise
KeyError in decode; an input column with the name of an output column is replaced; rows are kept
as they are, repeated ones too.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleloom.llm.common import map_text, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Entries of the memo tables of one Python worker; they are emptied when full, which changes no result.
MEMO = 1 << 18
PIECES = 1 << 18

_odd_space = re.compile(r" \s|\s |\A\s|\s\Z")
_lone_space = re.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pieces(text: str) -> list[str]:
    """Cuts at each single space between two non-spaces, and drops it. There the pattern always starts a match.

    So each piece but the first can be encoded on its own, with one space before it.
    """
    return text.split(" ") if not _odd_space.search(text) else _lone_space.split(text)


class Codec:
    """Encodes and decodes by the ranks of one vocabulary file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.rank = ranks
        self.find = regex.compile(pattern).findall
        self.entry = {i: b for b, i in ranks.items()}
        if max(self.entry) >= 1 << 17:
            raise ValueError("ids have to be under 131072")
        self.dtype = np.dtype("<u2" if max(self.entry) < 1 << 16 else "<u4")
        self.trie = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.trie.add_word(b.decode("latin-1"), (i, len(b) - 1))
        self.trie.make_automaton()
        self.memo: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        size = max(self.entry) + 1
        self.shorter = [self._prefix(self.entry.get(i, b"")) for i in range(size)]
        self.lengths = [len(self.entry.get(i, b"")) for i in range(size)]
        self.length = np.array(self.lengths, np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)))
        self.bytes = np.frombuffer(b"".join(self.entry.get(i, b"") for i in range(size)), np.uint8)

    def split(self, token: int) -> tuple[int, int] | None:
        """The last merge that makes this entry out of its bytes; None for a single byte."""
        if token not in self.parts:
            b = self.entry[token]
            parts = [b[i : i + 1] for i in range(len(b))]
            while len(parts) > 2:
                best = min((r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None and r < token)
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            self.parts[token] = (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None
        return self.parts[token]

    def _prefix(self, b: bytes) -> int:
        """The longest shorter entry that this one starts with; -1 if there is none."""
        return next((r for n in range(len(b) - 1, 0, -1) if (r := self.rank.get(b[:n])) is not None), -1)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave these two entries side by side."""
        limit = 1 << 40
        while True:
            joined = self.rank.get(self.entry[left] + self.entry[right])
            if joined is not None and joined < limit:
                return False
            a, b = self.split(left), self.split(right)
            if a is None and b is None:
                return True
            # undo the later of the two merges; of equal ones the left is done first, so the right is undone first
            if b is None or (a is not None and left > right):
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]

    def fits(self, left: int, right: int) -> bool:
        known = self.memo.get(key := left << 17 | right)
        if known is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            known = self.memo[key] = self.compatible(left, right)
        return known

    def encode_pretoken(self, word: bytes) -> list[int]:
        whole = self.rank.get(word)
        if whole is not None:
            return [whole]
        latin = word.decode("latin-1")
        out = [token for _, (token, _) in self.trie.iter_long(latin)]
        memo, length, shorter = self.memo, self.lengths, self.shorter
        last, done = out[0], 1
        for token in out[1:]:  # the longest entries in a row, as far as they fit
            if not self.fits(last, token):
                break
            last = token
            done += 1
        if done == len(out):
            return out
        n = len(word)
        longest = {end - before: token for end, (token, before) in self.trie.iter(latin)}  # of one start, the last is the longest
        longest[n] = -1
        closed: set[int] = set()
        token = shorter[out[done]]
        del out[done:]
        at = sum([length[i] for i in out])
        while at < n:
            while token >= 0:
                end = at + length[token]
                if end not in closed:
                    if last < 0:
                        break
                    known = memo.get(last << 17 | token)
                    if known or known is None and self.fits(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                last, at, token = token, end, longest[end]
            else:
                closed.add(at)
                out.pop()
                at -= length[last]
                token, last = shorter[last], out[-1] if out else -1
        return out

    def pack_pretoken(self, word: str) -> bytes:
        return np.array(self.encode_pretoken(word.encode("utf-8")), self.dtype).tobytes()

    def check(self, ids: np.ndarray) -> None:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.length) or not self.length[ids].all()):
            raise KeyError("an id is not in the vocabulary")

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        self.check(ids)
        n = self.length[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.start[ids] - ends + n, n) + np.arange(total)]


class Packer(dict):
    """piece -> packed ids, of a piece with one space before it.

    Most pieces are one word, or a word and one mark; the pattern makes those one or two
    pre-tokens, so they need no regular expression. When this memo is full it becomes the old
    one, whose hits come back.
    """

    def __init__(self, find: Callable[[str], list[str]], pack_pretoken: Callable[[str], bytes]):
        super().__init__()
        self.find, self.pack_pretoken = find, pack_pretoken
        self.old: dict[str, bytes] = {}
        self.marks = {c: pack_pretoken(c) for c in ".,;:!?)"}

    def whole(self, text: str) -> bytes:
        return b"".join([self[w[1:]] if w[0] == " " and w[1:].isalpha() else self.pack_pretoken(w) for w in self.find(text)])

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            if piece.isalpha():
                got = self.pack_pretoken(" " + piece)
            elif piece[-1] in self.marks and piece[:-1].isalpha():
                return self[piece[:-1]] + self.marks[piece[-1]]
            else:
                got = self.whole(" " + piece)
        if len(piece) <= 40:
            self[piece] = got
        return got

    def pack(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self) > PIECES:
            self.old = dict(self)
            self.clear()
        head, *tail = pieces(text)
        return self.whole(head) + b"".join(map(self.__getitem__, tail))


_held: dict[tuple, tuple[Codec, Packer]] = {}


def codec(path: str, pattern: str) -> tuple[Codec, Packer]:
    """One for each worker process and file."""
    key = (path, pattern)
    if key not in _held:
        own = Codec(read_ranks(path), pattern)
        _held[key] = own, Packer(own.find, own.pack_pretoken)
    return _held[key]


def _lists(lengths: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), values)


def _binaries(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _decoded(own: Codec, counts: np.ndarray, ids: np.ndarray) -> pa.Array:
    own.check(ids)
    ends = np.concatenate(([0], np.cumsum(own.length[ids])))
    at = np.concatenate(([0], np.cumsum(counts)))
    return _binaries(np.diff(ends[at]), own.decode(ids))


def encode(df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds ids_col array<int>; with decoded_col also the bytes that these ids decode to (the same pass through Python)."""

    def make():
        own, packer = codec(path, pattern)

        def run(texts):
            packed = [packer.pack(t) for t in texts]
            counts = np.array([len(p) for p in packed], np.int64) // own.dtype.itemsize
            ids = np.frombuffer(b"".join(packed), own.dtype).astype(np.int32)
            return [_lists(counts, pa.array(ids)), *([_decoded(own, counts, ids)] if decoded_col else [])]

        return run

    return map_text(df, text_col, f"`{ids_col}` array<int>" + (f", `{decoded_col}` binary" if decoded_col else ""), make, keep)


def decode(df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Adds bytes_col, what the ids of ids_col stand for; null ids give no bytes."""
    kept = [c for c in df.columns if c.lower() != bytes_col.lower()]
    df = df.select(*kept)

    def run(batches):
        own, _ = codec(path, pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            lists = column.to_pylist()
            counts = np.array([len(x or ()) for x in lists], np.int64)
            ids = np.array([i for x in lists for i in x or ()], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(own, counts, ids)], names=[*batch.schema.names, bytes_col])

    return df.mapInArrow(run, df.withColumn(bytes_col, F.lit(b"")).schema)


def digests(df: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 beside `keep`."""
    coded = encode(df, path, ids_col="__ids__", decoded_col="__decoded__", keep=keep)
    return coded.select(
        *[F.col(f"`{c}`") for c in keep],
        F.size("__ids__").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("__ids__").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("__decoded__"), 256).alias("decoded_sha256"),
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), ["doc_id"])
