from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleloom.jobs import store_queries
from sampleloom.kernels import effects as fx
from sampleloom.kernels.sinc import Resampler
from sampleloom.operators import automation, board, tables
from sampleloom.streaming import levels, stateful

SCHEMA = "track_id long, channel int, chunk long, start_frame long, samples array<double>, ts timestamp_ntz"


def streamed(spark, tmp_path, batches, transform, name):
    """Each batch of rows is one file, read one file a trigger."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        (tmp_path / f"mark{i}").touch()
    files = sorted(src.glob("*.parquet"), key=lambda p: p.stat().st_mtime)
    assert len(files) == len(batches)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = transform(stream.withColumn("ts", F.col("ts").cast("timestamp"))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.read.parquet(out)


def rows_of(x, n, track=1, order=None):
    import datetime

    own = [(track, 0, i // n, i, [float(v) for v in x[i : i + n]], datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i // n)) for i in range(0, len(x), n)]
    return [own[i] for i in order] if order else own


def test_effects_stream_equals_batch(spark, tmp_path):
    x = np.sin(np.arange(500) / 9.0) * 0.7
    rows = rows_of(x, 50)
    effects = lambda: [fx.LowpassFilter(100.0), fx.Delay(0.02, 0.4, 0.5), fx.Compressor(-12.0, 3.0)]
    # the second and third batch come in the wrong order
    got = streamed(spark, tmp_path, [rows[:3], rows[6:], rows[3:6]], lambda s: stateful.stream_effects(s, effects(), 1000.0), "fx")
    have = [r.value for r in tables.unpack(got).orderBy("frame").collect()]
    want = board.apply_effects(spark.createDataFrame([r[:5] for r in rows], tables.CHUNKS), effects(), 1000.0)
    want = [r.value for r in tables.unpack(want).orderBy("frame").collect()]
    assert np.allclose(have, want, atol=1e-12)


def test_resample_stream_equals_batch(spark, tmp_path):
    x = np.random.default_rng(1).uniform(-1, 1, 700)
    rows = rows_of(x, 70)
    end = (1, 0, len(rows), 700, [], rows[-1][5])
    got = streamed(spark, tmp_path, [rows[:4], rows[4:] + [end]], lambda s: stateful.stream_resample(s, 1000.0, 1600.0, "sinc16"), "rs")
    have = np.array([r.value for r in tables.unpack(got).orderBy("frame").collect()])
    k = Resampler(1000.0, 1600.0, "sinc16")
    assert np.array_equal(have, k.outputs(x[None, :], 0, 0, k.length(700))[0])


def test_a_lost_block_is_given_up(spark, tmp_path):
    """Block 3 never comes: what waits behind it is released after `patience`, with the frames that were lost; the stream goes on."""
    x = np.sin(np.arange(500) / 9.0)
    rows = rows_of(x, 50)
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(idle, "false")  # else a stream with timers waits for them and doesn't end
    try:
        got = streamed(spark, tmp_path, [rows[:3], rows[4:6], rows_of(x, 50, track=2)[:2], rows[6:]], lambda s: stateful.stream_effects(s, [fx.Gain(6.0)], 1000.0, patience=0.0), "lost")
    finally:
        spark.conf.set(idle, "true")
    out = {(r.track_id, r.chunk): (r.start_frame, r.dropped, r.samples) for r in got.collect()}
    assert set(out) == {(1, k) for k in range(10) if k != 3} | {(2, 0), (2, 1)}
    assert {k: d for (_, k), (_, d, _) in out.items() if d} == {4: 50}
    for (_, k), (start, _, samples) in out.items():
        assert start == 50 * k and np.allclose(samples, x[start : start + 50] * 10 ** (6 / 20))


def ended(spark, run):
    """Streams with timers wait for them; so that they end, batches without rows are off."""
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(idle, "false")
    try:
        return run()
    finally:
        spark.conf.set(idle, "true")


def lost(got):
    return sum(r.dropped for r in got.collect())


@pytest.mark.parametrize("how", [{"patience": 0.0}, {"ahead": 1}, {"event_time": "ts"}])
def test_every_lost_frame_is_counted(spark, tmp_path, how):
    """Also where the released block puts nothing out, as short blocks before a sinc's latency, and in front of the end mark."""
    x = np.random.default_rng(3).uniform(-1, 1, 640)
    rows = rows_of(x, 16)
    end = (1, 0, len(rows), 640, [], rows[-1][5])
    late = lambda s: s.withWatermark("ts", "0 seconds") if "event_time" in how else s
    batches = [rows[:3], rows[4:6], rows_of(x, 16, track=2)[:1], rows[6:20], rows[20:39], [end, (3, 0, 0, 0, [0.0], rows[-1][5])]]
    batches += [[(4, 0, 0, 0, [0.0], rows[-1][5].replace(year=2025))], [(4, 0, 1, 1, [0.0], rows[-1][5].replace(year=2026))]]
    got = ended(spark, lambda: streamed(spark, tmp_path, batches, lambda s: stateful.stream_resample(late(s), 1000.0, 1600.0, "sinc32", **how), "count"))
    one = got.filter("track_id = 1").orderBy("chunk").collect()
    if "ahead" in how:  # what waits behind one gap only is not more than allowed, so the last block stays until more come
        assert sum(r.dropped for r in one) == 16
    else:
        assert sum(r.dropped for r in one) == 32
    made = [r for r in one if len(r.samples)]
    # the frames that are missing move the others on
    assert made[-1].start_frame + len(made[-1].samples) <= 1024 and made[-1].start_frame - sum(len(r.samples) for r in made[:-1]) == (25 if "ahead" in how or made[-1].dropped == 0 else 51)


def test_a_loss_before_the_end_of_a_silent_effect(spark, tmp_path):
    """The end mark itself has to tell what was lost."""
    rows = rows_of(np.ones(200), 50)
    end = (1, 0, 4, 200, [], rows[-1][5])
    got = ended(spark, lambda: streamed(spark, tmp_path, [rows[:3], [end], rows_of(np.ones(50), 50, track=2)], lambda s: stateful.stream_effects(s, [fx.Gain(0.0)], 1000.0, patience=0.0), "end"))
    out = [(r.chunk, r.start_frame, len(r.samples), r.dropped) for r in got.filter("track_id = 1").orderBy("chunk").collect()]
    assert out == [(0, 0, 50, 0), (1, 50, 50, 0), (2, 100, 50, 0), (4, 200, 0, 50)]


def test_a_forgotten_key_goes_on(spark, tmp_path):
    rows = rows_of(np.ones(500), 50)
    batches = [rows[:3], rows_of(np.ones(50), 50, track=2), rows[5:7], rows_of(np.ones(50), 50, track=3), rows[7:]]
    got = ended(spark, lambda: streamed(spark, tmp_path, batches, lambda s: stateful.stream_effects(s, [fx.Gain(0.0)], 1000.0, forget=0.001), "forget"))
    out = {r.chunk: r.dropped for r in got.filter("track_id = 1").collect()}
    assert out == {0: 0, 1: 0, 2: 0, 5: 100, 6: 0, 7: 0, 8: 0, 9: 0}


def test_too_many_waiting_blocks_end_the_wait(spark, tmp_path):
    rows = rows_of(np.ones(500), 50)
    got = streamed(spark, tmp_path, [rows[:1], rows[2:4], rows[4:6], rows[6:]], lambda s: stateful.stream_effects(s, [fx.Gain(0.0)], 1000.0, ahead=3), "ahead")
    assert {r.chunk: r.dropped for r in got.collect()} == {0: 0, 2: 50} | {k: 0 for k in range(3, 10)}
    with pytest.raises(ValueError, match="event_time"):
        stateful.stream_effects(got, [fx.Gain()], 1000.0, patience=1.0, event_time="ts")


def test_automated_stream_equals_batch(spark, tmp_path):
    x = np.random.default_rng(8).uniform(-1, 1, 500)
    rows = rows_of(x, 50)
    params = [(1, 7, "cut", 900.0), (1, 50, "cut", 100.0), (1, 50, "wet", 0.9), (1, 223, "cut", 300.0), (1, 499, "wet", 0.0)]
    own, follow = lambda: [fx.LowpassFilter(50.0), fx.Reverb(0.6)], {(0, "cutoff_frequency_hz"): "cut", (1, "wet_level"): "wet"}
    chunks = spark.createDataFrame([r[:5] for r in rows], tables.CHUNKS)
    table = spark.createDataFrame(params, "track_id long, frame long, name string, value double")
    want = [r.value for r in tables.unpack(automation.apply_automated(chunks, own(), 4000.0, table, follow)).orderBy("frame").collect()]
    told = {r.chunk: r.marks for r in automation.marks(chunks, table, follow, ["track_id"]).collect()}
    stream = lambda s: s.withColumn("marks", F.expr("CASE chunk " + " ".join(f"WHEN {k} THEN array({', '.join(f'{v}D' for v in m)})" for k, m in told.items()) + " END"))
    got = streamed(spark, tmp_path, [rows[:3], rows[6:], rows[3:6]], lambda s: stateful.stream_effects(stream(s), own(), 4000.0, channels=1, automation=follow), "auto")
    assert np.allclose([r.value for r in tables.unpack(got).orderBy("frame").collect()], want, atol=1e-12)


def test_reverb_streams_like_the_batch(spark, tmp_path):
    """Channels of a block may come apart, and the blocks in another order."""
    x = np.random.default_rng(5).uniform(-1, 1, (2, 400))
    rows = [rows_of(x[c], 50)[k][:1] + (c,) + rows_of(x[c], 50)[k][2:] for k in range(8) for c in (0, 1)]
    effects = lambda: [fx.Delay(0.01, 0.3), fx.Reverb(0.6, 0.4)]
    got = streamed(spark, tmp_path, [rows[:3], rows[7:], rows[3:7]], lambda s: stateful.stream_effects(s, effects(), 1000.0, channels=2), "reverb")
    want = board.apply_effects(spark.createDataFrame([r[:5] for r in rows], tables.CHUNKS), effects(), 1000.0)
    values = lambda df: [r.value for r in tables.unpack(df).orderBy("channel", "frame").collect()]
    assert np.allclose(values(got), values(want), atol=1e-12)
    with pytest.raises(ValueError, match="number of a track's channels"):
        stateful.stream_effects(got, [fx.Reverb()], 1000.0)


def test_dropped_frames(spark, tmp_path):
    rows = rows_of(np.zeros(500), 50)
    got = streamed(spark, tmp_path, [rows[:2] + rows[:1], rows[4:5], rows[6:]], lambda s: stateful.dropped_frames(s), "gaps")
    assert got.agg(F.max("dropped")).head()[0] == 150
    with pytest.raises(RuntimeError, match="150"):
        stateful.check_dropped(got)


def test_stream_levels(spark, tmp_path):
    rows = rows_of(np.ones(300) * 0.5, 50)
    got = streamed(
        spark, tmp_path, [rows[:3], rows[3:]], lambda s: levels.stream_levels(s.select("track_id", "ts", F.explode("samples").alias("value")), "2 seconds"), "lv"
    )
    out = got.orderBy("block_start").collect()
    assert len(out) >= 2 and all(abs(r.peak - 0.5) < 1e-12 and abs(r.rms - 0.5) < 1e-12 for r in out)


def test_lost_frames_of_all_tracks(spark, monkeypatch):
    """Also of tracks whose last block is lost; blocks come in several files a step, whose number grows with the rows."""
    monkeypatch.setattr(store_queries, "BLOCKS_A_FILE", 20)
    folders = {}
    own = store_queries.scratch
    monkeypatch.setattr(store_queries, "scratch", lambda s, name: folders.setdefault(name, own(s, name)))
    length = {t: 3 + t % 9 for t in range(60)}
    sent = {t: [c for c in range(n) if (c + t) % 4 != 1] for t, n in length.items()}
    rows = [(t, 0, c, 16 * c, [0.0] * 16) for t, cs in sent.items() for c in cs]
    got = {r.track_id: (r.next_frame, r.dropped) for r in store_queries.lost_frames(spark, spark.createDataFrame(rows, tables.CHUNKS)).collect()}
    assert got == {t: (16 * (cs[-1] + 1), 16 * (cs[-1] + 1 - len(cs))) for t, cs in sent.items()}
    assert any(cs[-1] < length[t] - 1 for t, cs in sent.items())
    files = spark.read.parquet(folders["stream-in"]).groupBy(F.input_file_name()).agg(F.countDistinct("track_id").alias("tracks")).collect()
    assert len(files) >= 8 and max(r.tracks for r in files) > 1


def test_blocks_that_go_on_within_a_batch_do_not_reach_the_state():
    import pandas as pd

    calls = []

    class State:
        def __init__(self):
            self.held = {}

        def __getattr__(self, name):
            calls.append(name)
            own = {
                "exists": lambda: bool(self.held), "get": lambda: self.held[0], "update": lambda v: self.held.update({0: v}), "keys": lambda: iter(list(self.held)), "containsKey": lambda k: k in self.held,
                "getValue": lambda k: self.held[k], "updateValue": lambda k, v: self.held.update({k: v}), "removeKey": lambda k: self.held.pop(k),
            }
            return own[name]

    class Handle:
        getValueState = getMapState = lambda self, *a: State()

    took = stateful._Ordered(lambda: [], lambda s, block, chunk, start, lost, marks: [] if block is None else [(chunk, start, block)], lambda *a: a[1:], None, None, None, False, None)
    took.init(Handle())
    order = [3, 0, 2, 1, 4, 5, 7]
    rows = lambda ks: iter([pd.DataFrame([(1, 0, k, k * 2, np.array([k, k + 0.5]), np.zeros(0), 0) for k in ks], columns=["track_id", "channel", "chunk", "start_frame", "samples", "marks", "ts"])])
    made = pd.concat(list(took.handleInputRows((1, 0), rows(order), None)))
    assert made.chunk.tolist() == list(range(6)) and len(calls) <= 4
    made = pd.concat(list(took.handleInputRows((1, 0), rows([6]), None)))
    assert made.chunk.tolist() == [6, 7] and made.samples.tolist() == [[6, 6.5], [7, 7.5]]


class _Map(dict):
    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__


class _Handle:
    def __init__(self):
        self.states = {}

    def getMapState(self, name, *schema):
        return self.states.setdefault(name, _Map())


def test_signals_of_a_group_share_a_call():
    """And a table of output; each has its own state, with the blocks that wait if they are few."""
    import pandas as pd

    took, handle = stateful._Ordered(lambda: [], lambda s, block, chunk, start, lost, marks: [] if block is None else [(chunk, start, block)], lambda *a: a[1:], None, None, None, False, None), _Handle()
    took.init(handle)
    rows = lambda ks, n: iter([pd.DataFrame([(t, 0, k, k * n, np.full(n, t + k / 10), np.zeros(0), 0) for t, k in ks], columns=["track_id", "channel", "chunk", "start_frame", "samples", "marks", "ts"])])
    made = list(took.handleInputRows((5,), rows([(1, 0), (2, 1), (1, 1), (3, 0), (2, 2)], 2), None))
    assert len(made) == 1 and list(zip(made[0].track_id, made[0].chunk)) == [(1, 0), (1, 1), (3, 0)]
    assert set(handle.states["kept"]) == {(1, 0), (2, 0), (3, 0)} and not handle.states["early"]
    made = pd.concat(list(took.handleInputRows((5,), rows([(2, 0)], 2), None)))
    assert list(zip(made.track_id, made.chunk)) == [(2, 0), (2, 1), (2, 2)] and made.samples.tolist()[2] == [2.2, 2.2]
    big = stateful.HELD_SAMPLES + 1
    assert not len(pd.concat(list(took.handleInputRows((5,), rows([(4, 1)], big), None))))
    assert set(handle.states["early"]) == {(4, 0, 1, 0)}
    made = pd.concat(list(took.handleInputRows((5,), rows([(4, 0)], big), None)))
    assert made.chunk.tolist() == [0, 1] and made.samples.tolist()[1] == [4.1] * big and not handle.states["early"]


def test_output_is_measured_once(monkeypatch):
    """However many signals a group has, rows that are put out are looked at once; tables of output stay small."""
    looks = []

    class Samples(list):
        def __len__(self):
            looks.append(1)
            return super().__len__()

    class Silent(stateful._Ordered):
        def _signal(self, signal, came, timerValues):
            return [(signal[0], 0, k[0], v[0], Samples(v[1]), 0) for k, v in came]

        def _table(self, out):
            return [(r[0], r[2]) for r in out]

    import pandas as pd

    monkeypatch.setattr(stateful, "OUT_SAMPLES", 1000)
    took = Silent(lambda: [], None, None, None, None, None, False, None)
    took.init(_Handle())
    rows = pd.DataFrame([(t, 0, 0, 0, [0.5] * 2, [], 0) for t in range(1200)], columns=["track_id", "channel", "chunk", "start_frame", "samples", "marks", "ts"])
    made = list(took.handleInputRows((5,), iter([rows]), None))
    assert [len(m) for m in made] == [501, 501, 198] and [t for m in made for t, _ in m] == list(range(1200))
    assert len(looks) == 1200


def test_states_of_many_signals_are_read_by_one_pass(monkeypatch):
    """Unless the batch has few of the group's signals, or its states are large; the results are the same."""
    import pandas as pd

    calls = []

    class Map(_Map):
        def __getattribute__(self, name):
            calls.append(name)
            return super().__getattribute__(name)

        def iterator(self):
            return iter(list(dict.items(self)))

    def blocks(keys):
        return iter([pd.DataFrame([(t, 0, k, k * 2, np.full(2, t + k / 10), np.zeros(0), 0) for t, k in keys], columns=["track_id", "channel", "chunk", "start_frame", "samples", "marks", "ts"])])

    def run(batches):
        took, handle = stateful._Ordered(lambda: [], lambda s, block, chunk, start, lost, marks: [] if block is None else [(chunk, start, block)], lambda *a: a[1:], None, None, None, False, None), _Handle()
        handle.getMapState = lambda name, *schema: handle.states.setdefault(name, Map())
        took.init(handle)
        out, counts = [], []
        for b in batches:
            calls.clear()
            made = pd.concat(list(took.handleInputRows((5,), blocks(b), None)))
            counts.append({c: calls.count(c) for c in set(calls)})
            out.append(sorted(zip(made.track_id, made.chunk, [tuple(x) for x in made.samples])))
        return out, counts

    first = [(t, 0 if t % 3 else 1) for t in range(100)]
    batches = [first, [(t, 1 if t % 3 else 0) for t in range(120)], [(t, 2) for t in range(9)], [(t, 2) for t in range(9, 100)]]
    out, counts = run(batches)
    assert [len(o) for o in out] == [66, 66 + 2 * 34 + 6, 9, 91]
    assert [c.get("iterator", 0) for c in counts] == [0, 1, 0, 1]
    assert [c.get("containsKey", 0) <= 1 for c in counts] == [True, True, False, True]
    assert all(c.get("getValue", 0) <= 1 for i, c in enumerate(counts) if i != 2) and all(c["updateValue"] == len({t for t, _ in b}) + 1 for b, c in zip(batches, counts))
    monkeypatch.setattr(stateful, "PASS_BYTES", 10)
    each, counts = run(batches)
    assert each == out and not any("iterator" in c for c in counts)


@pytest.mark.parametrize("files", [4, 5])
def test_a_stream_of_any_number_of_files_takes_two_triggers(spark, monkeypatch, files):
    monkeypatch.setattr(store_queries, "BLOCKS_A_FILE", 10)
    folders, own = {}, store_queries.scratch
    monkeypatch.setattr(store_queries, "scratch", lambda s, name: folders.setdefault(name, own(s, name)))
    rows = [(t, 0, c, 16 * c, [t + c / 8.0] * 16) for t in range(5) for c in range(2 * files)]
    got = store_queries._streamed(spark, spark.createDataFrame(rows, tables.CHUNKS), lambda s: stateful.stream_effects(s, [fx.Gain(0.0)], 1000.0))
    assert sorted((r.track_id, r.channel, r.chunk, r.start_frame, r.samples) for r in got.collect()) == sorted(rows)
    triggers = spark.read.text(folders["stream-state"] + "/commits").select(F.input_file_name().alias("f")).distinct().count()
    assert triggers == 2


def test_many_waiting_samples(spark, tmp_path):
    """More than go with their signal's state."""
    x = np.sin(np.arange(15000) / 9.0)
    rows = rows_of(x, 3000)
    got = streamed(spark, tmp_path, [rows[3:], rows[1:3], rows[:1]], lambda s: stateful.stream_effects(s, [fx.Gain(0.0)], 1000.0), "many")
    assert [r.value for r in tables.unpack(got).orderBy("frame").collect()] == list(x)


def test_loss_counts_of_a_group_share_a_call():
    import pandas as pd

    gaps = stateful._Gaps(None)
    gaps.init(_Handle())
    rows = lambda *r: iter([pd.DataFrame(r, columns=["track_id", "start_frame", "n"])])
    made = list(gaps.handleInputRows((5,), rows((1, 16, 16), (2, 0, 16), (1, 0, 16), (2, 32, 16)), None))
    assert [m.values.tolist() for m in made] == [[[1, 32, 0], [2, 48, 16]]]
    made = list(gaps.handleInputRows((5,), rows((2, 16, 16), (1, 48, 16), (3, 16, 16)), None))
    assert [m.values.tolist() for m in made] == [[[2, 48, 16], [1, 64, 16], [3, 32, 16]]]
