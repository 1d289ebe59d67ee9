"""BPE, token counts and training order against the libraries."""

from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sampleloom.llm import bpe, token_counts, training_order

RANKS = public_tokenizers.path(bpe.VOCABULARY)
COUNTS = public_tokenizers.path(token_counts.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(COUNTS, public_tokenizers.PATTERN, token_counts.Merges(COUNTS).not_alone())


PIECES = ["a", "b", "aa", " ", "  ", "\n", "\t", "é", "ß", "1", "23", "'s", "'ll", "the", "ing", "ation", "漢", "字", " ", "　", "\x1c", "\x85", "!", "...", "####", "<|endoftext|>", "😀", "́", "Ab", "____", "\r\n", "\x0b"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join) | st.text(max_size=60))
def test_same_ids_and_counts(text):
    own, packer = bpe.codec(RANKS, public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.rank, special_tokens={})
    text = text.encode("utf-8", "ignore").decode()
    ids = np.frombuffer(packer.pack(text), own.dtype)
    assert ids.tolist() == lib.encode_ordinary(text)
    assert own.decode(ids.astype(np.int64)).tobytes() == text.encode()


def test_every_code_point_counts_alike(counter):
    tokenizer = Tokenizer.from_file(COUNTS)
    texts = [" a" + chr(c) + " " + chr(c) + "b1 " + chr(c) * 2 + "." for c in range(1, 0x3000, 3)]
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_compatibility_is_what_the_merges_keep(library):
    own, _ = bpe.codec(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(3)
    ids = [i for i, b in own.entry.items() if b.isalpha() and b.islower()]
    for _ in range(3000):
        a, b = rng.choice(ids), rng.choice(ids)
        joined = own.entry[a] + own.entry[b]
        if joined not in own.rank:
            assert own.compatible(a, b) == (library.encode_ordinary(joined.decode()) == [a, b])


def test_codec_on_messy_rows(messy, empty, library):
    rows = bpe.digests(messy, RANKS, ["doc_id", "n_chars"]).collect()
    texts = [r.text or "" for r in messy.collect()]
    for r, t in zip(rows, texts, strict=True):
        ids = library.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.digests(empty, RANKS, ["doc_id"]).count() == 0
    coded = bpe.encode(messy, RANKS)
    assert dict(coded.dtypes)["ids"] == "array<int>" and len(coded.columns) == len(messy.columns)
    assert [bytes(r.decoded).decode() for r in bpe.decode(coded, RANKS).collect()] == texts


def test_unknown_ids_are_an_error(spark):
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([([60000],)], "ids array<int>"), RANKS).collect()


def test_counts_on_messy_rows(messy, empty):
    tokenizer = Tokenizer.from_file(COUNTS)
    rows = token_counts.token_counts(messy, COUNTS).collect()
    for r, t in zip(rows, [r.text or "" for r in messy.collect()], strict=True):
        n = len(tokenizer.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)
    assert token_counts.token_counts(empty, COUNTS).count() == 0


def test_queries_on_the_small_table(spark, sf, small, library):
    texts = {r.doc_id: r.text for r in small.collect()}
    for r in bpe.op2_byte_bpe(spark, sf).collect():
        assert r.n_tokens == len(library.encode_ordinary(texts[r.doc_id]))
    tokenizer = Tokenizer.from_file(COUNTS)
    for r in token_counts.op10_token_counts(spark, sf).collect():
        assert r.n_tokens == len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 1 << 60))
def test_feistel_is_a_permutation(n, key):
    slots = training_order.feistel(np.arange(n), n, key)
    assert sorted(slots) == list(range(n))
    assert (training_order.feistel(slots, n, key, inverse=True) == np.arange(n)).all()


def shards(docs, tmp_path, **args):
    path, folder = public_tokenizers.path(training_order.VOCABULARY), str(tmp_path / "shards")
    rows = training_order.materialise(docs, path, folder, **args).orderBy("slot").collect()
    return rows, folder


def test_shards_hold_every_token_in_training_order(small, messy, tmp_path):
    path = public_tokenizers.path(training_order.VOCABULARY)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for i, docs in enumerate((small, messy.coalesce(1))):
        rows, folder = shards(docs, tmp_path / str(i), seq_len=128, per_shard=32)
        assert [r.slot for r in rows] == list(range(len(rows)))
        seqs = list(training_order.read_sequences(folder, 0, len(rows), 128, 32))
        by_number = {r.number: seqs[r.slot] for r in rows}
        got = np.concatenate([by_number[n] for n in range(len(rows))])
        want = np.concatenate([np.array(lib.encode_ordinary(r.text or "") + [50256]) for r in docs.collect()])
        assert (got[: len(want)] == want).all() and (got[len(want) :] == 50256).all() and len(got) - len(want) < 128
        resumed = list(training_order.read_sequences(folder, 5, 3, 128, 32))
        assert all((a == b).all() for a, b in zip(resumed, seqs[5:8], strict=True))
        files = [f for f in os.listdir(folder) if f.endswith(".bin")]
        assert len(files) == -(-len(rows) // 32) and sum(os.path.getsize(f"{folder}/{f}") for f in files) == 256 * len(rows)


def test_no_documents_no_shards(empty, tmp_path):
    rows, folder = shards(empty, tmp_path)
    assert rows == [] and not [f for f in (os.listdir(folder) if os.path.isdir(folder) else []) if f.endswith(".bin")]


def test_order_query_covers_all_documents(spark, sf, small):
    got = training_order.op7_training_order(spark, sf).collect()
    assert {d for r in got for d in r.doc_ids} == {r.doc_id for r in small.collect()}
    assert sorted(r.slot for r in got) == list(range(len(got)))
