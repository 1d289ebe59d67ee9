"""Token-ID shards in training order.

Documents are encoded and packed, one after the other with an end mark, into sequences of SEQ_LEN
token ids; each input split is packed on its own, so packing needs no shuffle and only the last
sequence of a split is padded. All N sequences are numbered, and a keyed Feistel network permutes
0..N-1: it permutes the next power of four, and a number that lands at N or above is sent through
again (cycle-walking) until it is below. So every sequence has a global slot that needs no sort of
random keys and can be computed, and inverted, for any slot alone. Range partitions by shard then write files of
SHARD_SEQUENCES records of fixed stride: the sequence in slot s is at byte (s mod SHARD_SEQUENCES) *
stride of shard s div SHARD_SEQUENCES, so a reader streams from any slot and resumes where it stopped.

A shard is written under a temporary name and renamed. Its content depends on the input and on how Spark
splits it, so a repeated or lost task writes the same bytes again, and so does another run over the same
files with the same spark.sql.files.maxPartitionBytes and default parallelism; other splits pack other sequences.

Defined results: null and empty texts add their end mark only; no documents give no sequences and no
files; repeated rows are packed as often as they occur; padding is the end mark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleloom.llm.bpe import read_ranks
from sampleloom.llm.common import drop_folder, new_folder, saved, saved_in, small_batches, table

VOCABULARY = "byte_bpe_50k.tiktoken"
SEQ_LEN = 1024
SHARD_SEQUENCES = 2048
KEY = 20_240_229
ROUNDS = 6
#: Splits whose numbering may be broadcast: one row of two numbers each.
BROADCAST_SPLITS = 1_000_000
BATCH = 256
#: How packed sequences are stored until they are dealt out; wide pages give the codec more context.
PACKED = {"parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20)}

_encodings: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """One for each worker process and file."""
    if (path, pattern) not in _encodings:
        _encodings[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return _encodings[path, pattern]


def pack(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, seq_len: int = SEQ_LEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """split, seq, n_tokens, doc_ids (of the documents with a token in it) and tokens (seq_len 16-bit ids) of every sequence."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    stride = 2 * seq_len
    small_batches(docs.sparkSession)

    def rows(batches) -> Iterator[tuple]:
        own = encoding(path, pattern)
        end = np.array([own.n_vocab], "<u2").tobytes()
        held, owners, seq = bytearray(), [], 0  # owners: (doc_id, bytes of it that are still held)
        for batch in batches:
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                new = np.array(own.encode_ordinary(t.as_py() or ""), "<u2").tobytes() + end
                held += new
                owners.append([d.as_py(), len(new)])
                at = 0
                while len(held) - at >= stride:
                    ids, left = [], stride
                    while left:
                        take = min(left, owners[0][1])
                        ids.append(owners[0][0])
                        owners[0][1] -= take
                        left -= take
                        if not owners[0][1]:
                            owners.pop(0)
                    yield seq, seq_len, ids, bytes(held[at : at + stride])
                    at += stride
                    seq += 1
                del held[:at]
        if held:
            yield seq, len(held) // 2, [o[0] for o in owners], bytes(held) + end * ((stride - len(held)) // 2)

    def run(batches):
        split, got = TaskContext.get().partitionId(), []

        def flush():
            cols = list(zip(*got, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array([split] * len(got), pa.int32()), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.binary())],
                names=["split", "seq", "n_tokens", "doc_ids", "tokens"],
            )

        for row in rows(batches):
            got.append(row)
            if len(got) == BATCH:
                yield flush()
                got.clear()
        if got:
            yield flush()

    return source.mapInArrow(run, "split int, seq int, n_tokens int, doc_ids array<long>, tokens binary")


def _round(x: np.ndarray, key: int, i: int) -> np.ndarray:
    mixed = (key * 0x9E3779B97F4A7C15 + (i + 1) * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
    with np.errstate(over="ignore"):
        x = (x + np.uint64(mixed)) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def feistel(numbers: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of 0..n-1, or its inverse, at these numbers."""
    half = np.uint64(max(1, (max(2, n) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << int(half)) - 1)
    out = np.array(numbers, np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ (_round(left, key, i) & mask), left
            else:
                left, right = right, left ^ (_round(right, key, i) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def with_slot(packed: DataFrame, key: int = KEY) -> tuple[DataFrame, int]:
    """Adds number (0..N-1 by split and place) and slot, its place in training order; and N. packed has to be saved: it is read twice."""
    spark = packed.sparkSession
    per_split = packed.groupBy("split").agg(F.count(F.lit(1)).alias("n")).orderBy("split").collect()  # one row a split
    starts = np.concatenate(([0], np.cumsum([r.n for r in per_split]))).astype(np.int64)
    total = int(starts[-1])
    first = spark.createDataFrame([(r.split, int(s)) for r, s in zip(per_split, starts, strict=False)], "split int, first long")
    if len(per_split) <= BROADCAST_SPLITS:
        first = F.broadcast(first)

    @F.pandas_udf("long")
    def slot_of(number):
        import pandas as pd

        return pd.Series(feistel(number.to_numpy(), total, key))

    numbered = packed.join(first, "split").withColumn("number", F.col("first") + F.col("seq")).drop("first")
    return numbered.withColumn("slot", slot_of("number")), total


def squeezed(tokens: Column) -> Column:
    """Sequences are shuffled compressed."""

    @F.pandas_udf("binary")
    def squeeze(values):
        import pandas as pd
        import zstandard

        z = zstandard.ZstdCompressor(level=9)
        return pd.Series([z.compress(t) for t in values])

    return squeeze(tokens)


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


def write_shards(slotted: DataFrame, total: int, folder: str, seq_len: int = SEQ_LEN, per_shard: int = SHARD_SEQUENCES) -> DataFrame:
    """Writes the shard files. As all slots below `total` are taken, the ranges of shards are known without a sample: partition p
    gets the p-th run of consecutive shards. The result, one row a sequence, is where each one is: slot, shard, byte_offset, number, n_tokens, doc_ids, crc."""
    stride, spark = 2 * seq_len, slotted.sparkSession
    shards = slotted.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int"))
    n_shards = max(1, -(-total // per_shard))
    parts = min(n_shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = shards.select("shard", "slot", "number", "n_tokens", "doc_ids", squeezed(F.col("tokens")).alias("tokens"))
    dealt = ranged.repartitionById(parts, F.floor(F.col("shard") * parts / n_shards).cast("int")).sortWithinPartitions("slot")

    def run(batches):
        import zlib

        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        out, open_shard, temporary = None, None, None

        def close():
            if out is not None:
                out.close()
                store.move(temporary, shard_path(root, open_shard))

        for batch in batches:
            shard, slot, tokens = (batch.column(i).to_pylist() for i in (0, 1, 5))
            tokens = [unpack(t) for t in tokens]
            for s, t in zip(shard, tokens, strict=True):
                if s != open_shard:
                    close()
                    open_shard, temporary = s, f"{root}/.shard-{s:08d}-{attempt}"
                    out = store.open_output_stream(temporary)
                out.write(t)
            at = pa.array([(x % per_shard) * stride for x in slot], pa.int64())
            crc = pa.array([zlib.crc32(t) for t in tokens], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), at, batch.column(2), batch.column(3), batch.column(4), crc], names=["slot", "shard", "byte_offset", "number", "n_tokens", "doc_ids", "crc"])
        close()

    return saved(dealt.mapInArrow(run, "slot long, shard int, byte_offset long, number long, n_tokens int, doc_ids array<long>, crc long"), "manifest")


def read_sequences(folder: str, first: int, count: int, seq_len: int = SEQ_LEN, per_shard: int = SHARD_SEQUENCES, opened: Callable | None = None) -> Iterator[np.ndarray]:
    """The sequences in slots first .. first + count - 1, by sequential reads; a run resumes by its next slot."""
    store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    stride, slot = 2 * seq_len, first
    while slot < first + count:
        with store.open_input_file(shard_path(root, slot // per_shard)) as f:
            f.seek(slot % per_shard * stride)
            for _ in range(min(per_shard - slot % per_shard, first + count - slot)):
                yield np.frombuffer(f.read(stride), "<u2")
                slot += 1


def materialise(docs: DataFrame, path: str, folder: str, seq_len: int = SEQ_LEN, per_shard: int = SHARD_SEQUENCES, key: int = KEY) -> DataFrame:
    """All of it; the result is the manifest."""
    packed, store = saved_in(pack(docs, path, seq_len=seq_len), "packed", "zstd", PACKED)
    manifest = write_shards(*with_slot(packed, key), folder, seq_len, per_shard)
    drop_folder(docs.sparkSession, store)  # shards and manifest are written
    return manifest


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), new_folder(spark, "shards"))
