"""Kernels and boards: closed forms, block sizes, composition, refusals."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sampleloom.kernels import effects as fx
from sampleloom.kernels import linear, sinc, vocoder
from sampleloom.operators import board, filters, params, resample, scan, shift, tables

RATE = 8000.0
ALL = {
    "lowpass": lambda: fx.LowpassFilter(500.0), "highpass": lambda: fx.HighpassFilter(300.0), "high_shelf": lambda: fx.HighShelfFilter(1000.0, 6.0), "low_shelf": lambda: fx.LowShelfFilter(1000.0, -6.0),
    "peak": lambda: fx.PeakFilter(900.0, 5.0), "delay": lambda: fx.Delay(0.01), "echo": lambda: fx.Delay(0.01, 0.5, 0.5), "compressor": lambda: fx.Compressor(-20.0, 4.0), "gate": lambda: fx.NoiseGate(-10.0, 3.0),
    "limiter": lambda: fx.Limiter(-12.0), "chorus": lambda: fx.Chorus(), "chorus_feedback": lambda: fx.Chorus(feedback=0.5), "phaser": lambda: fx.Phaser(feedback=0.3), "ladder": lambda: fx.LadderFilter(), "reverb": lambda: fx.Reverb(),
    "convolution": lambda: fx.Convolution(np.linspace(1, -1, 60).reshape(2, 30)), "mix": lambda: fx.Mix([fx.Gain(3.0), [fx.Delay(0.005), fx.AddLatency(7)], None]),
}


def noise(n=3000, channels=2, seed=0):
    return np.random.default_rng(seed).uniform(-1, 1, (channels, n))


def run(effect, x, cuts):
    state, out = effect.init_state(RATE, x.shape[0]), []
    for a, b in zip([0, *cuts], [*cuts, x.shape[1]], strict=True):
        out.append(effect.process(x[:, a:b].copy(), state, a))
    return np.concatenate(out, axis=1)


@pytest.mark.parametrize("name", ALL)
@pytest.mark.parametrize("n", [1, 7, 64, 1000])
def test_block_size_does_not_matter(name, n):
    x = noise(600 if n == 1 else 3000)
    assert np.allclose(run(ALL[name](), x, list(range(n, x.shape[1], n))), run(ALL[name](), x, []), atol=1e-10)


@pytest.mark.parametrize("name", ALL)
def test_silence_stays_silent_and_small_blocks_work(name):
    assert not run(ALL[name](), np.zeros((2, 500)), [100]).any()
    for n in (1, 2, 3):
        assert run(ALL[name](), noise(n), []).shape == (2, n)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-1, 1), min_size=1, max_size=200), st.integers(1, 60))
def test_filters_are_the_recurrence(x, cut):
    own, y1, x1 = linear.lowpass(RATE, 700.0), 0.0, 0.0
    want = []
    for v in x:
        y1 = own.b[0] * v + own.b[1] * x1 - own.a[0] * y1
        x1 = v
        want.append(y1)
    a = np.array(x)
    first, s = own.run(a[:cut])
    rest, _ = own.run(a[cut:], s)
    assert np.allclose(np.concatenate((first, rest)), want, atol=1e-12)


def level(x):
    return 20 * math.log10(math.sqrt(float(np.mean(x[0, 8000:] ** 2))))


@pytest.mark.parametrize("make,hz,gain", [(lambda: fx.LowpassFilter(1000.0), 1000, -3.01), (lambda: fx.HighpassFilter(1000.0), 1000, -3.01), (lambda: fx.HighShelfFilter(1000.0, 6.0), 1000, 3.0), (lambda: fx.LowShelfFilter(1000.0, -6.0), 1000, -3.0), (lambda: fx.PeakFilter(1000.0, 9.0), 1000, 9.0)])
def test_gain_at_the_cutoff(make, hz, gain):
    x = np.sin(2 * np.pi * hz * np.arange(48000) / 48000)[None, :]
    e = make()
    y = e.process(x, e.init_state(48000.0, 1), 0)
    assert abs(level(y) - level(x) - gain) < 0.05


def test_compressor_ratio():
    x = np.full((1, 48000), 10 ** (-10 / 20))
    y = run(fx.Compressor(-30.0, 5.0), x, [])
    assert abs(20 * math.log10(y[0, -1]) - (-30 + 20 / 5)) < 0.01


def test_reverb_keeps_its_tail_only_with_state():
    e, x = fx.Reverb(), noise(8000)
    state = e.init_state(RATE, 2)
    e.process(x, state, 0)
    assert np.abs(e.process(np.zeros((2, 8000)), state, 8000)).max() > 0.01
    assert not e.process(np.zeros((2, 8000)), e.init_state(RATE, 2), 0).any()


@pytest.mark.parametrize("quality", ["zoh", "linear", "catmull_rom", "lagrange", "sinc8", "sinc16", "sinc32", "windowed_sinc"])
@pytest.mark.parametrize("src,dst", [(8000, 44100), (44100, 8000), (22050, 12345.67)])
def test_resampling_is_the_same_in_pieces(quality, src, dst):
    x = np.sin(2 * np.pi * 220 * np.arange(4000) / src)[None, :]
    k = sinc.Resampler(src, dst, quality)
    whole = k.outputs(x, 0, 0, k.length(4000))
    for n in (1, 100, 999):
        r = sinc.StreamResampler(src, dst, quality)
        got = np.concatenate([r.process(x[:, i : i + n]) for i in range(0, 500 if n == 1 else 4000, n)] + ([r.process(None)] if n > 1 else []), axis=1)
        assert np.array_equal(got, whole[:, : got.shape[1]]) and (n == 1 or got.shape == whole.shape)
    want = np.sin(2 * np.pi * 220 * np.arange(whole.shape[1]) / dst)
    inner = slice(whole.shape[1] // 4, whole.shape[1] // 2)
    assert np.abs(whole[0, inner] - want[inner]).max() < {"zoh": 0.65, "linear": 0.35}.get(quality, 0.17)


def test_stretch_and_pitch():
    x = np.sin(2 * np.pi * 440 * np.arange(22050) / 22050)[None, :]
    assert vocoder.time_stretch(x, 1.5).shape[1] == int(22050 / 1.5)
    assert np.allclose(vocoder.pitch_shift(x, 0.0), x, atol=1e-6)
    up = vocoder.pitch_shift(x, 12.0)
    assert up.shape == x.shape and abs(int(np.abs(np.fft.rfft(up[0])).argmax()) - 880) <= 2
    with pytest.raises(ValueError, match="element 5"):
        vocoder.time_stretch(x[:, :10], np.array([1.0] * 5 + [0.0] + [1.0] * 4))
    for bad in ((0.0, 0.0), (1.0, 73.0)):
        with pytest.raises(ValueError):
            vocoder.time_stretch(x, *bad)
    with pytest.raises(ValueError, match="3 values"):
        vocoder.time_stretch(x, np.ones(3))
    assert np.isfinite(vocoder.time_stretch(x, np.linspace(0.75, 1.25, 22050), np.linspace(-1, 1, 22050))).all()


def brute_stretch(x, speed, total):
    """Grain by grain over the whole signal."""
    w, hop, n = vocoder.WINDOW, vocoder.HOP, x.shape[1]
    times, window = np.concatenate(([0.0], np.cumsum(1.0 / speed))), np.hanning(w + 1)[:-1]
    pad, out, weight, phase = np.pad(x, ((0, 0), (w, 2 * w))), np.zeros((x.shape[0], total + 3 * w)), np.zeros(total + 3 * w), None
    turn = 2 * np.pi * np.arange(w // 2 + 1) * hop / w
    for o in range(0, total + w, hop):
        a = int(np.rint(np.interp(o, times, np.arange(n + 1)))) + w // 2
        now, before = (np.fft.rfft(pad[:, i : i + w] * window) for i in (a, a - hop))
        new = np.angle(now)
        if phase is not None:
            step = new - np.angle(before) - turn
            free = phase + turn + step - 2 * np.pi * np.rint(step / (2 * np.pi))
            for c, size in enumerate(np.abs(now)):
                get = lambda i, s=size: s[i] if 0 <= i < len(s) else 0.0
                peaks = [i for i in range(len(size)) if get(i) >= get(i - 2) and get(i) > get(i - 1) and get(i) >= get(i + 1) and get(i) >= get(i + 2)]
                near = [min(peaks, key=lambda p, i=i: (abs(p - i), p)) if peaks else i for i in range(len(size))]
                new[c] = free[c, near] + np.angle(now[c]) - np.angle(now[c, near])
        phase = new
        out[:, o : o + w] += np.fft.irfft(np.abs(now) * np.exp(1j * phase), w) * window
        weight[o : o + w] += window**2
    return out[:, w // 2 : w // 2 + total] / np.maximum(weight[w // 2 : w // 2 + total], 1e-6)


def streamed(x, n, curves=(None, None), **how):
    s = vocoder.Stretcher(x.shape[0], curves=curves[0] is not None, **how)
    parts = [s.process(x[:, i : i + n], *[c if c is None else c[i : i + n] for c in curves]) for i in range(0, x.shape[1], n)]
    return np.concatenate([*parts, s.finish()], axis=1), s


@pytest.mark.parametrize("n", [300, 1111, 9000])
def test_streamed_stretch_equals_brute_force(n):
    x = np.sin(np.arange(9000) / 11.0) + 0.1 * noise(9000)
    got, _ = streamed(x, n, stretch_factor=1.5)
    assert got.shape == (2, 6000) and np.allclose(got, brute_stretch(x, np.full(9000, 1.5), 6000), atol=1e-6)
    speed = np.repeat([1.0, 2.0, 0.5], 3000)
    got, _ = streamed(x, n, (speed, np.zeros(9000)))
    held = speed  # it changes less often than every 1024 frames
    assert got.shape == (2, 10500) and np.allclose(got, brute_stretch(x, held, 10500), atol=1e-6)


def test_stretch_holds_a_few_windows_and_any_cut_is_alike():
    x, speed, tone = noise(40000, 1), np.linspace(0.6, 1.7, 40000), np.linspace(-3, 5, 40000)
    for curves, how in (((None, None), {"stretch_factor": 0.8, "semitones": 4.0}), ((speed, tone), {})):
        whole, _ = streamed(x, 40000, curves, **how)
        got, s = streamed(x, 500, curves, **how)
        assert got.shape == whole.shape and np.allclose(got, whole, atol=1e-6) and np.isfinite(got).all()
        assert s.vocoder.line.shape[1] < 4 * vocoder.WINDOW and s.pitch.line.shape[1] < 8 * vocoder.WINDOW
    assert whole.shape[1] == int(np.sum(1 / speed))


def test_curves_act_in_steps():
    s = vocoder.Stretcher(1, curves=True)
    f = np.where(np.arange(3000) < 100, 1.0, 2.0)
    held = np.concatenate([s._steps(f[i : i + 70], np.zeros(len(f[i : i + 70])))[0] for i in range(0, 3000, 70)])
    assert np.array_equal(held, np.where(np.arange(3000) < 1024, 1.0, 2.0))


def chunks_of(spark, x, n, track=1):
    rows = [(track, c, i // n, i, [float(v) for v in x[c, i : i + n]]) for c in range(x.shape[0]) for i in range(0, x.shape[1], n)]
    return spark.createDataFrame(rows, tables.CHUNKS)


def values_of(chunks):
    rows = tables.unpack(chunks).orderBy("channel", "frame").collect()
    return np.array([r.value for r in rows])


def test_boards(spark):
    x = noise(400)
    nested = board.Board([fx.Gain(3.0), [fx.LowpassFilter(900.0), fx.Clipping(-3.0)], fx.Reverb(), fx.Invert()])
    flat = [fx.Gain(3.0), fx.LowpassFilter(900.0), fx.Clipping(-3.0), fx.Reverb(), fx.Invert()]
    want = x
    for e in flat:
        want = run(e, want, [])
    for n in (7, 64, 400):
        assert np.allclose(values_of(board.apply_board(chunks_of(spark, x, n), nested, RATE)), want.ravel(), atol=1e-10)
    plan = board.apply_board(chunks_of(spark, x, 64), nested, RATE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert values_of(board.apply_board(chunks_of(spark, x, 64), [], RATE)).shape == (800,)


def test_board_lists():
    g, d = fx.Gain(1.0), fx.Delay()
    b = board.Board([g])
    b.append(d)
    b.insert(0, fx.Invert())
    assert len(b) == 3 and g in b and b[1] is g
    b.remove(g)
    assert g not in b
    with pytest.raises(ValueError):
        b.append(d)
    with pytest.raises(TypeError):
        b.append("gain")


@pytest.mark.parametrize("few", [0, 200_000])
def test_scan_equals_serial(spark, monkeypatch, few):
    monkeypatch.setattr(scan, "BROADCAST_BLOCKS", few)
    x = noise(1000, 1)
    own = linear.peak(RATE, 900.0, 6.0)
    want = own.run(x[0])[0]
    for n in (1, 50, 333):
        assert np.allclose(values_of(filters.filter_chunks(chunks_of(spark, x, n), own)), want, atol=1e-10)


def test_refusals(spark):
    frames = tables.unpack(chunks_of(spark, noise(10), 5))
    for f in (lambda: shift.delay(frames, RATE, 31.0), lambda: resample.resample_to(frames, 0, 1), lambda: resample.resample_effect(frames, 1.0, 0.0), lambda: tables.read_window(frames, -1, 5), lambda: tables.read_window(frames, 0, 0), lambda: fx.Compressor(ratio=0.5), lambda: fx.Reverb(2.0), lambda: fx.Bitcrush(33), lambda: fx.LadderFilter(drive=0.5), lambda: linear.lowpass(RATE, 0.0), lambda: filters.prepared_ir(np.ones(3), None, RATE)):
        with pytest.raises(ValueError):
            f()
    with pytest.raises(TypeError):
        tables.read_window(frames, 0, 1.5)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3000), st.floats(0, 5)), min_size=1, max_size=20), st.integers(1024, 9000))
def test_segments_cover_the_curve(runs, most):
    starts = np.concatenate(([0], np.cumsum([n for n, _ in runs])))[:-1].tolist()
    total = sum(n for n, _ in runs)
    got = list(params.walk(starts, [v for _, v in runs], total, 1024, most))
    assert got[0][0] == 0 and sum(n for _, n, _ in got) == total and all(n >= 1024 for _, n, _ in got[:-1]) and all(n <= most for _, n, _ in got)


def test_silence_and_single_frames(spark):
    from sampleloom.operators import channels

    quiet = tables.unpack(chunks_of(spark, np.zeros((2, 5)), 5))
    assert channels.trim_silence(quiet, -60.0).count() == 2
    assert channels.levels(quiet).head().peak_db is None
    assert channels.mix([], quiet).filter("value <> 0").count() == 0


class Half(fx.Effect):
    """A user's effect: half of each sample and half of the one before."""

    def init_state(self, rate, channels):
        return [np.zeros((channels, 1))]

    def process(self, block, state, start):
        line = np.concatenate((state[0], block), axis=1)
        state[0] = line[:, -1:]
        return 0.5 * (line[:, 1:] + line[:, :-1])


def test_users_add_effects(spark):
    x = noise(100)
    want = 0.5 * (x + np.pad(x, ((0, 0), (1, 0)))[:, :-1])
    for n in (1, 9, 100):
        assert np.allclose(values_of(board.apply_board(chunks_of(spark, x, n), [Half()], RATE)), want.ravel())


def test_stretch_by_curves(spark):
    x = noise(3000, 1)
    curves = spark.createDataFrame([(1, [1.0] * 1500 + [2.0] * 1500, [0.0] * 3000)], "track_id long, stretch array<double>, semitones array<double>")
    got = values_of(board.time_stretch(chunks_of(spark, x, 500), curves=curves))
    assert len(got) == 1500 + 750 and np.allclose(got, vocoder.time_stretch(x, np.repeat([1.0, 2.0], 1500), np.zeros(3000)).ravel(), atol=1e-6)
    for bad, match in (([1.0] * 7, "7 values for 3000"), ([1.0] * 2999 + [0.0], "element 2999")):
        curves = spark.createDataFrame([(1, bad, [0.0] * 3000)], "track_id long, stretch array<double>, semitones array<double>")
        with pytest.raises(Exception, match=match):
            board.time_stretch(chunks_of(spark, x, 500), curves=curves).collect()


def test_same_chunks_through_sinc_in_spark(spark):
    x = noise(900, 1)
    k = sinc.Resampler(1000.0, 1600.0, "sinc8")
    want = k.outputs(x, 0, 0, k.length(900))[0]
    for n in (33, 900):
        got = board.resample_chunks(chunks_of(spark, x, n), 1000.0, 1600.0, "sinc8", 128)
        assert np.array_equal(values_of(got), want) and {r.n for r in got.selectExpr("size(samples) n").collect()} <= {128, len(want) % 128}
    assert values_of(board.resample_effect_chunks(chunks_of(spark, x, 90), 1000.0, 400.0, "sinc8")).shape == (900,)


@pytest.mark.parametrize("feedback", [0.999, 1.0])
def test_feedback_delay_has_no_end(spark, feedback):
    d, xs = 2, {(1, 0): np.random.default_rng(3).uniform(-1, 1, 6001), (1, 1): np.eye(1, 5000)[0], (2, 0): np.ones(3)}
    rows = [(t, c, i, float(v), f"n{i}") for (t, c), x in xs.items() for i, v in enumerate(x)]
    frames = spark.createDataFrame(rows, "track_id long, channel int, frame long, value double, note string").repartition(5)
    done = shift.delay(frames, 1000.0, d / 1000, feedback, 0.25)
    assert done.columns == frames.columns
    got = {(r.track_id, r.channel, r.frame): r for r in done.collect()}
    assert len(got) == len(rows) and all(r.note == f"n{r.frame}" for r in got.values())
    for (t, c), x in xs.items():
        line = np.zeros(len(x))
        for i in range(len(x)):
            line[i] = x[i] + (feedback * line[i - d] if i >= d else 0.0)
        want = 0.75 * x + 0.25 * np.concatenate((np.zeros(d), line[:-d]))
        assert np.allclose([got[t, c, i].value for i in range(len(x))], want, atol=1e-9)


@pytest.mark.parametrize("most", [64, 250, 1 << 18])
def test_ranges_equal_one_pass(spark, monkeypatch, most):
    """Tracks cut into ranges give what one pass over the whole track gives."""
    monkeypatch.setattr(board, "RANGE_FRAMES", most)
    x = noise(930, 2)
    ir = np.random.default_rng(4).uniform(-1, 1, (1, 37))
    chains = [
        lambda: [fx.Convolution(ir, 0.7)],
        lambda: [fx.Delay(0.02), fx.Chorus(3.0, 0.4, 7.0, 0.0, 0.4)],
        lambda: [fx.Mix([[fx.Delay(0.011), fx.Convolution(ir)], fx.AddLatency(13), None]), fx.Gain(2.0), fx.AddLatency(5)],
    ]
    for make in chains:
        assert fx.memory(make(), RATE) is not None
        want = x
        for e in make():
            want = e.process(want, e.init_state(RATE, 2), 0)
        got = board.apply_effects(chunks_of(spark, x, 33), make(), RATE)
        assert np.allclose(values_of(got), want.ravel(), atol=1e-10)
        assert {(r.chunk, r.start_frame, r.n) for r in got.selectExpr("chunk", "start_frame", "size(samples) n").collect()} == {(k, 33 * k, min(33, 930 - 33 * k)) for k in range(29)}
    assert fx.memory([fx.Delay(0.02, 0.5)], RATE) is None and fx.memory([fx.Delay(0.02), fx.Reverb()], RATE) is None


@pytest.mark.parametrize("quality", ["zoh", "lagrange", "sinc16", "windowed_sinc"])
def test_resampling_in_ranges(spark, monkeypatch, quality):
    x = noise(930, 2)
    for most, src, dst, n, block in ((64, 1000.0, 1600.0, 33, 50), (256, 1000.0, 437.5, 930, 40), (100, 1000.0, 3000.0, 7, 1000), (930, 1000.0, 1600.0, 31, 64), (1 << 18, 1000.0, 600.0, 100, 64)):
        monkeypatch.setattr(board, "RANGE_FRAMES", most)
        k = sinc.Resampler(src, dst, quality)
        want = np.concatenate([k.outputs(x[c : c + 1], 0, 0, k.length(930)) for c in (0, 1)])
        got = board.resample_chunks(chunks_of(spark, x, n), src, dst, quality, block)
        assert np.array_equal(values_of(got), want.ravel()), (most, src, dst)
        there, back = sinc.Resampler(1000.0, 400.0, quality), sinc.Resampler(400.0, 1000.0, quality)
        low = there.outputs(x, 0, 0, there.length(930))
        high = back.outputs(low, 0, 0, min(930, back.length(low.shape[1])))
        if n <= most // 4:
            got = board.resample_effect_chunks(chunks_of(spark, x, n), 1000.0, 400.0, quality)
            assert np.allclose(values_of(got), np.pad(high, ((0, 0), (0, 930 - high.shape[1]))).ravel(), atol=1e-12)
    monkeypatch.setattr(board, "RANGE_FRAMES", 64)
    if quality == "sinc16":
        with pytest.raises(Exception, match="rechunk"):
            board.resample_effect_chunks(chunks_of(spark, x, 500), 1000.0, 400.0, quality).collect()


def test_a_long_track_has_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(board, "RANGE_FRAMES", 4096)
    frames = spark.range(200).selectExpr("1L as track_id", "0 as channel", "id as chunk", "id * 1000 as start_frame", "transform(sequence(0, 999), i -> sin((id * 1000 + i) / 9.0D)) as samples")
    done = board.resample_chunks(frames, 1000.0, 1600.0, "sinc16").selectExpr("spark_partition_id() as task")
    assert done.distinct().count() == 4


def test_tracks_without_a_curve_have_the_constants(spark):
    x = noise(3000, 1)
    curves = spark.createDataFrame([(9, [1.0] * 10, [0.0] * 10)], "track_id long, stretch array<double>, semitones array<double>")
    got = values_of(board.time_stretch(chunks_of(spark, x, 500), 1.5, curves=curves))
    assert len(got) == 2000
