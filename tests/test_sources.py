from __future__ import annotations

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleloom.kernels import wav
from sampleloom.operators import channels, tables
from sampleloom.sources import wav as source


def chunks_of(spark, x, n=100, track=1):
    rows = [(track, c, i // n, i, [float(v) for v in x[c, i : i + n]]) for c in range(x.shape[0]) for i in range(0, x.shape[1], n)]
    return spark.createDataFrame(rows, tables.CHUNKS)


@pytest.mark.parametrize("bits,floating", [(8, False), (16, False), (24, False), (32, False), (32, True), (64, True)])
def test_round_trip(spark, tmp_path, bits, floating):
    x = np.sin(np.arange(1050) / 7.0)[None, :] * np.array([[0.9], [-0.4]])
    chunks = chunks_of(spark, x)
    tracks = channels.track_info(tables.unpack(chunks), 8000.0)
    done = source.write_wav(chunks, tracks, str(tmp_path), bits, floating).collect()
    assert len(done) == 1
    catalog = source.read_wav_catalog(spark, str(tmp_path)).collect()[0]
    assert (catalog.sample_rate, catalog.num_channels, catalog.num_frames) == (8000.0, 2, 1050)
    back = source.read_wav(spark, str(tmp_path), 128, task_bytes=2048)
    assert {r.track_id for r in back.select("track_id").collect()} == {catalog.track_id}
    rows = tables.unpack(back).orderBy("channel", "frame").collect()
    got = np.array([r.value for r in rows]).reshape(2, -1)
    assert got.shape == x.shape and np.abs(got - x).max() <= (4 / 2**bits if not floating else 1e-6)


def test_exact_integers_and_raw(spark, tmp_path):
    x = np.array([[1, 2, 3, -1, -2, -3]]) / 32767
    chunks = chunks_of(spark, x)
    tracks = channels.track_info(tables.unpack(chunks), 44100.0)
    content = source.encode_wav(chunks, tracks, 16).collect()[0].content
    (tmp_path / "a.wav").write_bytes(bytes(content))
    assert source.read_wav_raw(spark, str(tmp_path / "a.wav")).collect()[0].samples == [1, 2, 3, -1, -2, -3]


def test_unknown_codec_is_named():
    raw = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36, b"WAVE", b"fmt ", 16, 0x0055, 1, 8000, 8000, 1, 16, b"data", 0)
    with pytest.raises(wav.UnsupportedWav, match="MPEG Layer 3"):
        wav.read_header(io.BytesIO(raw), len(raw))


def test_logarithmic_codes():
    codes = np.arange(256, dtype=np.uint8)
    for decode in (wav.alaw, wav.mulaw):
        got = decode(codes)
        assert got.min() == -got.max() and 30000 < got.max() <= 32767
    assert wav.mulaw(np.array([0xFF, 0x7F, 0x80, 0x00], np.uint8)).tolist() == [0, 0, 32124, -32124]
    assert wav.alaw(np.array([0xD5, 0x55, 0xAA, 0x2A], np.uint8)).tolist() == [8, -8, 32256, -32256]


def test_refusals():
    for args in ((0, 1, 1, 16), (44100.5, 1, 1, 16), (44100, 0, 1, 16), (44100, 1, 1, 12), (2, 44100, 1, 16)):
        with pytest.raises(ValueError):
            wav.make_header(*args)
    h = wav.Header(wav.PCM, 1, 8000.0, 24, 44, 1)
    with pytest.raises(wav.UnsupportedWav):
        wav.decode_raw(b"\0\0\0", h)


def test_reads_are_planned_from_the_listing(spark, tmp_path):
    """Short files share a task, long ones are cut, and nothing is opened to plan that."""
    rows = [(t, 0, 0, 0, [0.1] * 20) for t in range(300)] + [(1000, 0, k, 500 * k, [0.2] * 500) for k in range(40)]
    chunks = spark.createDataFrame(rows, tables.CHUNKS)
    source.write_wav(chunks, channels.track_info(tables.unpack(chunks), 1000.0), str(tmp_path), 16)
    reader = source.WavReader({"path": str(tmp_path), "chunk_frames": "500", "task_bytes": "8192"})
    parts = reader.partitions()
    assert len(parts) <= 300 * 84 // 8192 + 1 + 40_044 // 8192 + 2 and sum(len(p.files) for p in parts) == 300 + 5
    back = source.read_wav(spark, str(tmp_path), 500, task_bytes=8192)
    assert back.count() == 340 and back.selectExpr("sum(size(samples))").head()[0] == 300 * 20 + 20_000


def test_filters_reach_the_source(spark, tmp_path, monkeypatch):
    rows = [(t, c, k, 100 * k, [0.01 * k] * 100) for t in (1, 2, 3) for c in (0, 1) for k in range(50)]
    chunks = spark.createDataFrame(rows, tables.CHUNKS)
    source.write_wav(chunks, channels.track_info(tables.unpack(chunks), 1000.0), str(tmp_path), 16)
    wanted = source.track_id(f"{tmp_path}/2.wav")
    reader = source.WavReader({"path": str(tmp_path), "chunk_frames": "100"})
    pushed = [source.EqualTo(("track_id",), wanted), source.LessThan(("start_frame",), 1250), source.GreaterThan(("start_frame",), 950)]
    assert list(reader.pushFilters(pushed)) == pushed
    opened, read = [], []
    own = source.located

    class Counted:
        def __init__(self, store):
            self.store = store

        def __getattr__(self, name):
            return getattr(self.store, name)

        def open_input_file(self, name):
            opened.append(name)
            f = self.store.open_input_file(name)

            class File:
                def __enter__(self):
                    return self

                def __exit__(self, *_):
                    f.close()

                def read(self, n):
                    read.append(n)
                    return f.read(n)

                seek, size = staticmethod(f.seek), staticmethod(f.size)

            return File()

    monkeypatch.setattr(source, "located", lambda path: (Counted(own(path)[0]), own(path)[1]))
    got = [(r["chunk"], r["channel"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert got == [(k, c) for k in (10, 11, 12) for c in (0, 1)]
    assert opened == [f"{tmp_path}/2.wav"] and sum(read) < 3 * 400 + 100  # three blocks of two 16-bit channels, and the header
    monkeypatch.undo()
    window = tables.read_window(source.read_wav(spark, str(tmp_path), 100).filter(f"track_id = {wanted}"), 1010, 40, longest=100)
    assert {(r.channel, r.start_frame, len(r.samples)) for r in window.collect()} == {(0, 1010, 40), (1, 1010, 40)}


def test_descriptions_have_to_fit(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 0, 0, 0, [0.5] * 1400)], tables.CHUNKS)
    tracks = spark.createDataFrame([(1, 1000.0, 1, 999_999)], "track_id long, sample_rate double, num_channels int, num_frames long")
    with pytest.raises(Exception, match="1400 frames and 999999"):
        source.write_wav(chunks, tracks, str(tmp_path))
    with pytest.raises(Exception, match="1400 frames and 999999"):
        source.encode_wav(chunks, tracks).collect()
    assert not list(tmp_path.glob("*.wav"))


def test_a_table_of_files(spark, tmp_path):
    """The listing may be any table; long files are cut; a subset is a filter on it."""
    rows = [(t, c, k, 100 * k, [0.01 * ((t + k) % 90)] * 100) for t in (1, 2, 3) for c in (0, 1) for k in range(50 if t == 1 else 2)]
    chunks = spark.createDataFrame(rows, tables.CHUNKS)
    source.write_wav(chunks, channels.track_info(tables.unpack(chunks), 1000.0), str(tmp_path), 16)
    key = lambda df: sorted((r.track_id, r.channel, r.chunk, r.start_frame, tuple(r.samples)) for r in df.collect())
    files = source.listed(spark, str(tmp_path))
    want = key(source.read_wav(spark, str(tmp_path), 64))
    assert key(source.read_wav_files(files, 64)) == want == key(source.read_wav_files(files, 64, task_bytes=1000))
    two = source.read_wav_files(files.filter(f"xxhash64(regexp_replace(path, '^file:/*', '/')) = {source.track_id(f'{tmp_path}/2.wav')}"), 64)
    assert two.select("track_id").distinct().count() == 1 and two.count() == 2 * 4
    assert source.read_wav_files(files.filter("false")).count() == 0
    with pytest.raises(Exception, match="float|24|refused|raw"):
        source.write_wav(chunks, channels.track_info(tables.unpack(chunks), 1000.0), str(tmp_path / "f"), 24)
        source.read_wav_files(source.listed(spark, str(tmp_path / "f")), raw=True).collect()


def test_a_failing_job_leaves_nothing(spark, tmp_path):
    """One track doesn't fit its description: other tasks' files don't appear either, older ones stay."""
    rows = [(t, 0, k, 100 * k, [0.1] * 100) for t in range(40) for k in range(3)]
    chunks = spark.createDataFrame(rows, tables.CHUNKS)
    tracks = channels.track_info(tables.unpack(chunks), 1000.0)
    (tmp_path / "7.wav").write_bytes(b"older")
    bad = tracks.withColumn("num_frames", F.when(F.col("track_id") == 33, F.lit(5).cast("long")).otherwise(F.col("num_frames")))
    with pytest.raises(Exception, match="300 frames and 5"):
        source.write_wav(chunks, bad, str(tmp_path))
    assert [p.name for p in tmp_path.rglob("*") if not p.name.endswith(".crc")] == ["7.wav"] and (tmp_path / "7.wav").read_bytes() == b"older"
    done = source.write_wav(chunks, tracks, str(tmp_path))
    assert done.count() == 40 and sorted(p.name for p in tmp_path.glob("*")) == sorted(f"{t}.wav" for t in range(40))
    assert {r.bytes for r in done.collect()} == {44 + 600}


def recorded(path, x, rate, closed):
    """A 16-bit recording that is still written, or whole."""
    data = np.rint(x.T * 32767).astype("<i2").tobytes()
    head = bytearray(wav.make_header(rate, x.shape[0], x.shape[1], 16, False))
    if not closed:
        head[40:44] = b"\0\0\0\0"
    path.write_bytes(bytes(head) + data)


def test_growing_recordings_as_a_stream(spark, tmp_path):
    """Stopped and started again while files grow: each frame comes once, and so does each end; what comes out are files, one a track and epoch."""
    rng = np.random.default_rng(9)
    x, y = rng.uniform(-0.5, 0.5, (2, 1000)), rng.uniform(-0.5, 0.5, (1, 130))
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    own = source.track_id(f"{src}/a.wav")
    steps = [lambda: recorded(src / "a.wav", x[:, :333], 8000.0, False), lambda: recorded(src / "a.wav", x[:, :750], 8000.0, False), lambda: None, lambda: (recorded(src / "a.wav", x, 8000.0, True), recorded(src / "b.wav", y, 8000.0, True)), lambda: (src / "c.wav").write_bytes(b"RIFF")]
    seen = tmp_path / "seen"
    for step in steps:
        step()
        blocks = source.stream_wav(spark, str(src), 100)
        blocks.writeStream.format("parquet").option("path", str(seen)).option("checkpointLocation", str(tmp_path / "cp1")).trigger(availableNow=True).start().awaitTermination(120)
        source.stream_to_wav(source.stream_wav(spark, str(src), 100), str(out), str(tmp_path / "cp2"), 8000.0).trigger(availableNow=True).start().awaitTermination(120)
    rows = spark.read.parquet(str(seen)).collect()
    ends = [(r.track_id == own, r.channel, r.chunk) for r in rows if not r.samples]
    assert sorted(ends) == [(False, 0, 2), (True, 0, 10), (True, 1, 10)]
    for c in (0, 1):
        mine = sorted((r.start_frame, r.samples) for r in rows if r.track_id == own and r.channel == c and r.samples)
        assert [s for s, _ in mine] == list(range(0, 1000, 100))
        assert np.abs(np.concatenate([v for _, v in mine]) - x[c]).max() < 1 / 32767
    files = sorted(out.glob(f"{own}/*.wav"))
    assert [int(p.stem) for p in files] == [0, 300, 700]
    whole = [wav.decode(p.read_bytes()[44:], wav.read_header(io.BytesIO(p.read_bytes()), p.stat().st_size)) for p in files]
    assert np.abs(np.concatenate(whole, axis=1) - x).max() < 2 / 32767
    assert not list(out.glob("_staging*"))


def test_an_epoch_that_is_run_again_replaces_its_files(tmp_path):
    import pyarrow as pa

    writer = source.WavStreamWriter({"path": str(tmp_path), "sample_rate": "1000"})
    batch = pa.RecordBatch.from_pydict({"track_id": [1, 1, 2], "channel": pa.array([0, 0, 0], pa.int32()), "chunk": [4, 3, 0], "start_frame": [40, 30, 0], "samples": [[0.5] * 10, [0.25] * 10, []]})
    (tmp_path / "s").mkdir()
    for _ in range(2):
        made = list(writer._sorted([batch]))
        assert sum(b.num_rows for b in made) == 2 and made[0].column(3).to_pylist()[0] == 30
        assert made[0].column(7).to_pylist()[0] == 20


def test_short_recordings_share_a_task_of_a_stream(tmp_path):
    from sampleloom.kernels import wav as kernel
    from sampleloom.sources import wav as source

    for i in range(600):
        x = np.full((2, 40), i / 1000)
        (tmp_path / f"{i}.wav").write_bytes(kernel.make_header(1000.0, 2, 40, 16, False) + kernel.encode(x, 16, False))
    reader = source.WavStreamReader({"path": str(tmp_path), "chunk_frames": "24"})
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    assert len(end) == 600 and len(parts) == 3 and not reader.partitions(end, end)
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted((r["track_id"], r["chunk"], r["channel"], len(r["samples"])) for r in rows) == sorted((source.track_id(p), k, c, n) for p in end for k, n in enumerate((24, 16, 0)) for c in range(2))
