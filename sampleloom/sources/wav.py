"""WAV files as tables, and tables as WAV files.

Files are opened through Arrow's file systems, so a path may name any store that they reach. A read is planned from the
listing alone: long recordings are cut into pieces for many tasks, short ones share a task, and headers are read by the tasks. Filters
on track_id and start_frame reach the source: other files are not opened, other blocks not read. read_wav_files() takes the listing as a table, for
more files than one machine should walk.

Writes go through a data source with a commit: tasks write under a staging folder of the job, and only when all of them are done do files get
their names; a job that fails leaves none. Streams read recordings that still grow (each frame once, whatever stops and starts between), and
write one file a track and epoch, which a repeated epoch replaces.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from sampleloom.kernels import wav
from sampleloom.operators.board import _rows
from sampleloom.operators.tables import CHUNK

TRACKS = "track_id long, path string, sample_rate double, num_channels int, num_frames long, duration_s double, file_dtype string"
#: Bytes of files, and files, that one task reads, about.
TASK_BYTES = 64 << 20
TASK_FILES = 4096
#: Recordings that one task of a stream reads at most.
STREAM_FILES = 256
#: And frames, but for a longer one alone.
STREAM_FRAMES = 1 << 22
#: Frames that a batch of rows holds, about.
BATCH_FRAMES = 1 << 16


def located(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def track_id(path: str) -> int:
    """As xxhash64(path) in SQL, of the path without a file scheme."""
    got = xxhash.xxh64_intdigest(re.sub(r"^file:/*", "/", path).encode(), 42)
    return got - (1 << 64) if got >> 63 else got


def _header(path: str) -> wav.Header:
    store, name = located(path)
    with store.open_input_file(name) as f:
        return wav.read_header(f, f.size())


def read_wav_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row a file; only headers are read. The listing is Spark's, without the files' content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[wW][aA][vV]").load(path).select("path")

    def run(batches):
        for batch in batches:
            rows = []
            for p in batch.column(0).to_pylist():
                h = _header(p)
                rows.append((track_id(p), re.sub(r"^file:/*", "/", p), h.rate, h.channels, h.frames, h.frames / h.rate, h.dtype))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in TRACKS.split(", ")])

    return files.mapInArrow(run, TRACKS)


@dataclass
class Pieces(InputPartition):
    """(path, number of the piece, pieces of that file)."""

    files: list[tuple[str, int, int]]


class WavReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.chunk = options["path"], int(options.get("chunk_frames", CHUNK))
        self.raw = options.get("raw", "false") == "true"
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))
        self.tracks: set[int] | None = None
        self.low, self.high = 0, None  # start_frame of the blocks that are read: low <= start_frame < high

    def pushFilters(self, filters):
        """What files and blocks can be left out; Spark applies the filters once more."""
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            if name == "track_id" and isinstance(f, (EqualTo, In)):
                found = {int(v) for v in (f.value if isinstance(f, In) else [f.value]) if v is not None}
                self.tracks = found if self.tracks is None else self.tracks & found
            elif name == "start_frame" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.value is not None:
                v = int(f.value)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, v + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    stop = v + (not isinstance(f, LessThan))
                    self.high = stop if self.high is None else min(self.high, stop)
            yield f

    def partitions(self):
        """From the listing's names and sizes alone."""
        store, root = located(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else sorted((x for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File and posixpath.splitext(x.path)[1].lower() == ".wav"), key=lambda x: x.path)
        scheme = self.path[: self.path.index("://") + 3] if "://" in self.path and not self.path.startswith("file:") else ""
        out, held, size = [], [], 0
        for x in found:
            path = scheme + x.path
            if self.tracks is not None and track_id(path) not in self.tracks:
                continue
            pieces = max(1, -(-x.size // self.task_bytes))
            if pieces > 1:
                out += [Pieces([(path, i, pieces)]) for i in range(pieces)]
                continue
            if held and (size + x.size > self.task_bytes or len(held) == TASK_FILES):
                out.append(Pieces(held))
                held, size = [], 0
            held.append((path, 0, 1))
            size += x.size
        return [*out, *([Pieces(held)] if held else [])] or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0  # track, channel, chunk, start, samples
        for path, piece, pieces in partition.files:
            for row in self._blocks(path, piece, pieces):
                rows.append(row)
                held += len(row[4])
                if held >= BATCH_FRAMES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _blocks(self, path: str, piece: int, pieces: int) -> Iterator[tuple]:
        store, name = located(path)
        with store.open_input_file(name) as f:
            h = wav.read_header(f, f.size())
            blocks = -(-h.frames // self.chunk)
            first, stop = blocks * piece // pieces, blocks * (piece + 1) // pieces
            first = max(first, -(-self.low // self.chunk))
            if self.high is not None:
                stop = min(stop, -(-self.high // self.chunk))
            yield from self._decoded(f, h, track_id(path), first * self.chunk, min(stop * self.chunk, h.frames))

    def _decoded(self, f, h: wav.Header, own: int, low: int, high: int) -> Iterator[tuple]:
        for s in range(low, high, self.chunk):
            f.seek(h.offset + s * h.frame_bytes)
            raw = f.read(min(self.chunk, high - s) * h.frame_bytes)
            for c, samples in enumerate((wav.decode_raw if self.raw else wav.decode)(raw, h)):
                yield own, c, s // self.chunk, s, samples

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        t, c, k, s, x = zip(*rows, strict=True)
        ends = np.concatenate(([0], np.cumsum([len(v) for v in x]))).astype(np.int32)
        samples = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x), pa.int32() if self.raw else pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(c, pa.int32()), pa.array(k, pa.int64()), pa.array(s, pa.int64()), samples], names=["track_id", "channel", "chunk", "start_frame", "samples"])


@dataclass
class Grown:
    """Frames low to high of a recording, and whether it ends there."""

    path: str
    low: int
    high: int
    ended: bool


@dataclass
class GrownFiles(InputPartition):
    files: list[Grown]


class WavStreamReader(DataSourceStreamReader):
    """Recordings as they grow. An offset has, for each file, the frames that were read and whether its end was. While a file's header has no length yet,
    whole blocks are read; once it has, the rest, and a block without samples, which ends the track. Files that aren't WAV yet (no header) are left for later.
    """

    def __init__(self, options):
        self.path, self.chunk = options["path"], int(options.get("chunk_frames", CHUNK))
        self.closed: dict[str, int] = {}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        store, root = located(self.path)
        scheme = self.path[: self.path.index("://") + 3] if "://" in self.path and not self.path.startswith("file:") else ""
        found = [x for x in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if x.type == fs.FileType.File and posixpath.splitext(x.path)[1].lower() == ".wav"]

        def header(x) -> wav.Header | None:
            try:
                with store.open_input_file(x.path) as f:
                    return wav.read_header(f, x.size)
            except wav.UnsupportedWav:
                if x.size > 4096:
                    raise
                return None

        out, new = {}, [x for x in found if scheme + x.path not in self.closed]
        with ThreadPoolExecutor(16) as pool:
            for x, h in zip(new, pool.map(header, new), strict=True):
                if h is not None and h.whole:
                    self.closed[scheme + x.path] = h.frames
                elif h is not None:
                    out[scheme + x.path] = {"frames": (x.size - h.offset) // h.frame_bytes // self.chunk * self.chunk, "ended": False}
        for x in found:
            if scheme + x.path in self.closed:
                out[scheme + x.path] = {"frames": self.closed[scheme + x.path], "ended": True}
        return out

    def partitions(self, start, end):
        """Short recordings share a task, by the frames that they have got."""
        out, held, frames = [], [], 0
        for path, to in sorted(end.items()):
            at = start.get(path, {"frames": 0, "ended": False})
            if to == at:
                continue
            grown = Grown(path, at["frames"], to["frames"], to["ended"] and not at["ended"])
            if held and (len(held) == STREAM_FILES or frames + grown.high - grown.low > STREAM_FRAMES):
                out.append(GrownFiles(held))
                held, frames = [], 0
            held.append(grown)
            frames += grown.high - grown.low
        return [*out, *([GrownFiles(held)] if held else [])]

    def read(self, partition: GrownFiles):
        reader = WavReader({"path": self.path, "chunk_frames": self.chunk})
        rows, held = [], 0
        for grown in partition.files:
            for row in self._rows(reader, grown):
                rows.append(row)
                held += len(row[4])
                if held >= BATCH_FRAMES:
                    yield reader._batch(rows)
                    rows, held = [], 0
        if rows:
            yield reader._batch(rows)

    def _rows(self, reader: WavReader, grown: Grown) -> Iterator[tuple]:
        store, name = located(grown.path)
        with store.open_input_file(name) as f:
            h = wav.read_header(f, f.size())
            yield from reader._decoded(f, h, track_id(grown.path), grown.low, grown.high)
        if grown.ended:
            yield from ((track_id(grown.path), c, -(-grown.high // self.chunk), grown.high, np.zeros(0)) for c in range(h.channels))


@dataclass
class Written(WriterCommitMessage):
    """(where a file was written, its name)."""

    files: list[tuple[str, str]] = field(default_factory=list)


class _Staged:
    """Files under a staging folder of the job, moved to their names by a commit."""

    def __init__(self, options, staging: str):
        self.folder, self.bits, self.floating = options["path"], int(options.get("bit_depth", 16)), options.get("floating", "false") == "true"
        self.staging = staging

    def _write(self, batches, name) -> Written:
        """name(track, first frame) says what a file is called within the folder."""
        store, root = located(self.folder)
        attempt, done, out, staged = TaskContext.get().taskAttemptId(), Written(), None, ""
        try:
            for own, header, samples, first in _encoded(batches, self.bits, self.floating):
                if header is not None:
                    final = name(own, first)
                    staged = f"{root}/{self.staging}/{final.replace('/', '-')}.{attempt}"
                    store.create_dir(posixpath.dirname(staged), recursive=True)
                    out = store.open_output_stream(staged)
                    done.files.append((staged, f"{root}/{final}"))
                if header is None and samples is None:
                    out.close()
                    out = None
                else:
                    out.write(header if header is not None else samples)
        except BaseException:
            if out is not None:
                out.close()
            for path, _ in done.files:
                if store.get_file_info(path).type == fs.FileType.File:
                    store.delete_file(path)
            raise
        return done

    def _finish(self, messages, keep: bool) -> None:
        store, root = located(self.folder)
        files = [f for m in messages if m is not None for f in m.files]
        if keep:
            for folder in {posixpath.dirname(final) for _, final in files}:
                store.create_dir(folder, recursive=True)
            with ThreadPoolExecutor(16) as pool:
                list(pool.map(lambda f: store.move(*f), files))
        # also what attempts have left that were killed; the writer of a stream's tasks may be another object than the one that commits
        for folder in {f"{root}/{self.staging}", *(posixpath.dirname(staged) for staged, _ in files)}:
            if store.get_file_info(folder).type == fs.FileType.Directory:
                store.delete_dir(folder)


class WavWriter(DataSourceArrowWriter, _Staged):
    def __init__(self, options):
        _Staged.__init__(self, options, f"_staging-{uuid.uuid4().hex}")

    def write(self, iterator):
        return self._write(iterator, lambda own, first: f"{own}.wav")

    def commit(self, messages):
        self._finish(messages, True)

    def abort(self, messages):
        self._finish(messages, False)


class WavStreamWriter(DataSourceStreamArrowWriter, _Staged):
    """An epoch's blocks of a track are one file, <track_id>/<first frame>.wav, so an epoch that is run again replaces its own files."""

    def __init__(self, options):
        _Staged.__init__(self, options, f"_staging-{uuid.uuid4().hex}")
        self.rate = float(options["sample_rate"])

    def write(self, iterator):
        return self._write(self._sorted(iterator), lambda own, first: f"{own}/{first:016d}.wav")

    def _sorted(self, batches):
        """A stream's rows come in any order: those of a task and epoch are put in order, with the description that files need."""
        table = pa.Table.from_batches(list(batches)) if not isinstance(batches, pa.Table) else batches
        if not table.num_rows:
            return
        table = table.select(["track_id", "channel", "chunk", "start_frame", "samples"]).sort_by([("track_id", "ascending"), ("chunk", "ascending"), ("channel", "ascending")])
        table = table.filter(pa.compute.greater(pa.compute.list_value_length(table["samples"]), 0))
        frames: dict[int, dict[int, int]] = {}
        for own, channel, n in zip(table["track_id"].to_pylist(), table["channel"].to_pylist(), pa.compute.list_value_length(table["samples"]).to_pylist(), strict=True):
            frames.setdefault(own, {}).setdefault(channel, 0)
            frames[own][channel] += n
        own = table["track_id"].to_pylist()
        for name, kind, value in (("sample_rate", pa.float64(), lambda t: self.rate), ("num_channels", pa.int32(), lambda t: len(frames[t])), ("num_frames", pa.int64(), lambda t: max(frames[t].values()))):
            table = table.append_column(name, pa.array([value(t) for t in own], kind))
        yield from table.combine_chunks().to_batches()

    def commit(self, messages, batchId):
        self._finish(messages, True)

    def abort(self, messages, batchId):
        self._finish(messages, False)


class WavSource(DataSource):
    @classmethod
    def name(cls):
        return "wav"

    def schema(self):
        return f"track_id long, channel int, chunk long, start_frame long, samples array<{'int' if self.options.get('raw', 'false') == 'true' else 'double'}>"

    def reader(self, schema):
        return WavReader(dict(self.options))

    def streamReader(self, schema):
        return WavStreamReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WavWriter(dict(self.options))

    def streamWriter(self, schema, overwrite):
        return WavStreamWriter(dict(self.options))


def read_wav(spark: SparkSession, path: str, chunk_frames: int = CHUNK, raw: bool = False, task_bytes: int = TASK_BYTES) -> DataFrame:
    """chunks of all WAV files under a path (or of one file)."""
    spark.dataSource.register(WavSource)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # read when a plan is made, which is later
    return spark.read.format("wav").option("chunk_frames", chunk_frames).option("task_bytes", task_bytes).option("raw", str(raw).lower()).load(path)


def read_wav_files(files: DataFrame, chunk_frames: int = CHUNK, raw: bool = False, task_bytes: int = TASK_BYTES) -> DataFrame:
    """chunks of the files of a table (path, length), as a listing by Spark, a catalog or a manifest gives it: no machine walks a tree or holds the paths.

    Long files are cut, pieces are dealt out evenly. To read some tracks only, filter `files` (track_id is xxhash64(path)).
    """
    options = {"path": "", "chunk_frames": chunk_frames, "raw": str(raw).lower()}
    sized = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.greatest(F.ceil(F.col("length") / task_bytes), F.lit(1)).cast("int").alias("pieces"), "length")
    total = sized.agg(F.sum("length")).head()[0] or 0
    tasks = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // task_bytes))
    dealt = sized.select("path", "pieces", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")).repartition(tasks)

    def run(batches):
        reader = WavReader(options)
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (0, 2, 1)), strict=True)
            yield from reader.read(Pieces(list(rows)))

    return dealt.mapInArrow(run, WavSource({"raw": str(raw).lower()}).schema())


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the WAV files under a path: Spark's own listing, which many tasks do where there are many folders."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[wW][aA][vV]").load(path).select("path", "length")


def stream_wav(spark: SparkSession, path: str, chunk_frames: int = CHUNK) -> DataFrame:
    """chunks of the recordings under a path as a stream, while they grow; a recording's end is a block without samples."""
    spark.dataSource.register(WavSource)
    return spark.readStream.format("wav").option("chunk_frames", chunk_frames).load(path)


def stream_to_wav(chunks_stream: DataFrame, folder: str, checkpoint: str, sample_rate: float, bit_depth: int = 16, floating: bool = False):
    """A DataStreamWriter, yet to be started, that puts each epoch's blocks of a track into one file of the folder; it holds a task's part of an epoch."""
    chunks_stream.sparkSession.dataSource.register(WavSource)
    rows = chunks_stream.select("track_id", "channel", "chunk", "start_frame", F.col("samples").cast("array<double>").alias("samples")).repartition("track_id")
    return rows.writeStream.format("wav").option("path", folder).option("sample_rate", sample_rate).option("bit_depth", bit_depth).option("floating", str(floating).lower()).option("checkpointLocation", checkpoint)


def read_wav_raw(spark: SparkSession, path: str, chunk_frames: int = CHUNK) -> DataFrame:
    """Integers as stored; 24-bit and float files are refused."""
    return read_wav(spark, path, chunk_frames, raw=True)


def _with_tracks(chunks: DataFrame, tracks: DataFrame) -> DataFrame:
    """Blocks in order, with rate, channels and frames of their track; dealt as by board._dealt."""
    meta = tracks.select("track_id", "sample_rate", "num_channels", "num_frames")
    joined = chunks.select("track_id", "channel", "chunk", "start_frame", F.col("samples").cast("array<double>").alias("samples")).join(meta, "track_id")
    cols = ["track_id", "channel", "chunk", "start_frame", "samples", "sample_rate", "num_channels", "num_frames"]
    return joined.select(*cols).repartition(F.xxhash64("track_id")).sortWithinPartitions("track_id", "chunk", "channel")


def _encoded(batches, bit_depth: int, floating: bool):
    """(track, header or None, samples or None, first frame of the block) in order; a None header and None samples end a track."""
    meta: dict[int, tuple] = {}

    def seen():
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in (0, 5, 6, 7)), strict=True):
                meta[row[0]] = row[1:]
            yield batch

    current, channels, frames, written = None, 0, 0, 0

    def whole() -> None:
        if written != frames:
            raise ValueError(f"track {current} has {written} frames and {frames} in its description")

    for (own,), _, start, chans, block in _rows(seen(), ["track_id"]):
        if own != current:
            if current is not None:
                whole()
                yield current, None, None, 0
                meta.pop(current, None)
            rate, channels, frames = meta[own]
            current, written = own, 0
            yield own, wav.make_header(rate, channels, frames, bit_depth, floating), None, start
        if len(chans) != channels:
            raise ValueError(f"track {own} has {len(chans)} channels in a block and {channels} in its description")
        written += block.shape[1]
        yield own, None, wav.encode(block, bit_depth, floating), start
    if current is not None:
        whole()
        yield current, None, None, 0


def encode_wav(chunks: DataFrame, tracks: DataFrame, bit_depth: int = 16, floating: bool = False) -> DataFrame:
    """(track_id, content): whole files in a column, for tracks under 2 GB; write_wav has no such bound."""

    def run(batches):
        parts: list[bytes] = []
        for own, header, samples, _ in _encoded(batches, bit_depth, floating):
            if header is None and samples is None:
                yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([b"".join(parts)], pa.binary())], names=["track_id", "content"])
                parts = []
            else:
                parts.append(header if header is not None else samples)

    return _with_tracks(chunks, tracks).mapInArrow(run, "track_id long, content binary")


def write_wav(chunks: DataFrame, tracks: DataFrame, folder: str, bit_depth: int = 16, floating: bool = False) -> DataFrame:
    """Writes <track_id>.wav for each track, block by block, and gives (track_id, path, bytes), read from the folder. All files appear, or none
    if any fails; older ones are replaced."""
    spark = chunks.sparkSession
    spark.dataSource.register(WavSource)
    writer = _with_tracks(chunks, tracks).write.format("wav").mode("append").option("bit_depth", bit_depth).option("floating", str(floating).lower())
    writer.save(folder)
    found = listed(spark, folder).select(F.regexp_extract("path", r"(-?\d+)\.wav$", 1).cast("long").alias("track_id"), F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("bytes"))
    return found.join(tracks.select("track_id").distinct(), "track_id", "left_semi")
