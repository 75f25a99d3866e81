import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewave.functions import kernels, levels
from brinewave.operators import spectral, waveform, wavelet
from brinewave.operators.features import FEATURES, register_feature


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "id int, samples array<double>")


def plain_spectrum(x, fs, n, hop):
    w = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / n)
    out = []
    for s in range(0, len(x) - n + 1, hop):
        y = (x[s : s + n] - np.mean(x[s : s + n])) * w
        power = []
        for b in range(n // 2 + 1):
            e = np.exp(-2j * np.pi * b * np.arange(n) / n)
            scale = 1 if b in (0, n // 2) else 2
            power.append(scale * abs(np.sum(y * e)) ** 2 / (fs * np.sum(w**2)))
        out.append(power)
    return np.array(out)


def test_spectrogram_equals_direct_sums(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=700)
    r = spectral.spectrogram(frame(spark, [x, x[:300]]), 240.0, 64).orderBy("id").collect()
    for row, n in zip(r, (700, 300)):
        want = 10 * np.log10(plain_spectrum(x[:n], 240.0, 64, 32) + 1e-20)
        assert np.allclose(np.array(row.spectro), want.T[::-1])


def test_frame_count_of_a_segment():
    assert kernels.power_frames(np.zeros((1, 23998)), 240.0, 256, 128).shape == (1, 186, 129)


def test_power_of_a_sine_adds_up():
    t = np.arange(4096) / 240
    p = kernels.power_frames(np.sin(2 * np.pi * 30 * t)[None], 240.0, 256, 128)[0]
    assert np.argmax(p[3]) == 32
    assert p.sum(axis=1).mean() * 240 / 256 == pytest.approx(0.5, rel=1e-3)


def test_constant_has_no_power(spark):
    r = spectral.spectrogram(frame(spark, [[7.0] * 64]), 8.0, 16).first()
    assert np.allclose(np.array(r.spectro), -200.0)


def test_band_is_open_above():
    assert spectral.band(240.0, 256) == (0, 129)
    assert spectral.band(240.0, 256, 0.0, 120.0) == (0, 128)
    assert spectral.band(240.0, 256, 30.0, 60.0) == (32, 64)
    assert spectral.nearest_bin(0.5, 16.0, 16) == 0


def test_clamp_and_pixels(spark):
    x = np.sin(np.arange(64)) * 100
    s = spectral.spectrogram(frame(spark, [x]), 8.0, 16, vmin=-5.0, vmax=20.0)
    v = np.array(s.first().spectro)
    assert v.min() == -5.0 and v.max() == 20.0
    px = np.array(spectral.pixels(s, -5.0, 20.0).first().pixels)
    assert px.min() == 0 and px.max() == 255
    assert np.array_equal(px, np.trunc(255 * (v + 5) / 25))


def test_long_form_axes(spark):
    s = spectral.spectrogram(frame(spark, [np.arange(40.0)]), 8.0, 16, f_max=3.0)
    rows = spectral.long_form(s, ["id"], 8.0, 16, f_max=3.0)
    assert rows.count() == 4 * 6
    grid = np.array(s.first().spectro)
    for r in rows.collect():
        assert r.f == r.f_bin * 0.5 and r.t == 1.0 + r.t_bin
        assert r.v == grid[5 - r.f_bin][r.t_bin]


def test_wavelet_sizes():
    sizes = [len(a[0]) for a in kernels.wavelet_levels(np.zeros((1, 23998)), 8)]
    assert sizes == [102, 102, 196, 383, 758, 1508, 3007, 6006, 12003]


def rebuild(low, high, n):
    """Inverse of one level with the dual taps."""
    rec_low = [0, 0, 0, 0.3535533905932738, 0.7071067811865476, 0.3535533905932738, 0, 0, 0, 0]
    rec_high = [0, -0.03314563036811942, -0.06629126073623884, 0.17677669529663689, 0.4198446513295126,
                -0.9943689110435825, 0.4198446513295126, 0.17677669529663689, -0.06629126073623884, -0.03314563036811942]
    up = lambda a: np.ravel(np.column_stack([a, np.zeros(len(a))]))
    full = np.convolve(up(low), rec_low) + np.convolve(up(high), rec_high)
    return full[8 : 8 + n]


@pytest.mark.parametrize("n", [64, 65, 200])
def test_wavelet_perfect_reconstruction(n):
    x = np.random.default_rng(n).normal(size=n)
    low, high = kernels.wavelet_step(x[None])
    assert len(low[0]) == (n + 9) // 2
    assert np.allclose(rebuild(low[0], high[0], n), x)


def test_wavelet_clamp_and_log(spark):
    x = np.random.default_rng(1).normal(size=100)
    plain = wavelet.wavelet_transform(frame(spark, [x]), 2).first().levels
    fixed = wavelet.wavelet_transform(frame(spark, [x]), 2, vmin=-0.5, vmax=0.5).first().levels
    same = wavelet.wavelet_transform(frame(spark, [x]), 2, vmin=-0.5, vmax=0.5, compat=True).first().levels
    logs = wavelet.wavelet_transform(frame(spark, [x]), 2, apply_log=True).first().levels
    for a, f, c, g in zip(plain, fixed, same, logs):
        assert np.allclose(f, np.clip(a, -0.5, 0.5))
        assert np.allclose(c, [0.5 if abs(v) > 0.5 else v for v in a])
        assert np.allclose(g, 10 * np.log10(np.abs(a) + 1e-3))


def test_energy_share(spark):
    x = np.random.default_rng(2).normal(size=300)
    rows = wavelet.energy_share(frame(spark, [x, np.zeros(300)]), 3).orderBy("id").collect()
    parts = kernels.wavelet_levels(x[None], 3)[:3]
    means = np.array([np.abs(a).mean() for a in parts])
    assert np.allclose(rows[0].share, means / means.sum())
    assert rows[1].share is None
    long = spark.createDataFrame(
        [(1, k, float(c)) for k, a in enumerate(parts) for c in a[0]], "id int, level int, coef double"
    )
    got = {r.level: r.share for r in wavelet.level_energy(long, ["id"]).collect()}
    assert np.allclose([got[k] for k in range(3)], rows[0].share)


def test_scalogram_alignment(spark):
    x = np.random.default_rng(3).normal(size=120)
    rows = wavelet.wavelet_transform(frame(spark, [x]), 3)
    r = rows.withColumn("a", wavelet.aligned_scalogram("levels", 3)).first()
    for level, times in enumerate([4, 4, 2, 1]):
        want = np.repeat(np.abs(r.levels[level]), times)[: len(r.levels[-1])]
        assert np.allclose(r.a[level], want)


def recursive_lowpass(x, q):
    """Order 8 Chebyshev run as a recursion, settled at its first sample, forward and back."""
    eps = np.sqrt(10 ** (0.05 / 10) - 1)
    theta = np.pi * (2 * np.arange(1, 9) - 1) / 16
    mu = np.arcsinh(1 / eps) / 8
    wo = 4 * np.tan(np.pi * 0.8 / q / 2)
    p = wo * (-np.sinh(mu) * np.sin(theta) + 1j * np.cosh(mu) * np.cos(theta))
    pz = (4 + p) / (4 - p)

    def once(y):
        y = y.astype(complex)
        for pole in pz:
            gain = (1 - pole) / 2
            before_in, before_out = y[0], y[0]  # steady state of the section
            out = np.empty_like(y)
            for i, v in enumerate(y):
                before_out = gain * (v + before_in) + pole * before_out
                before_in = v
                out[i] = before_out
            y = out
        return y.real / np.sqrt(1 + eps**2)

    ext = np.concatenate([2 * x[0] - x[27:0:-1], x, 2 * x[-1] - x[-2:-29:-1]])
    return once(once(ext)[::-1])[::-1][27:-27]


@pytest.mark.parametrize("q", [1, 2, 5])
def test_decimation_equals_the_recursion(q):
    x = np.cumsum(np.random.default_rng(q).normal(size=700)) * 100
    want = recursive_lowpass(x, q)[::q]
    assert np.allclose(kernels.decimate_rows(x[None], q)[0], want, atol=1e-6 * np.abs(want).max())


def test_decimation_keeps_slow_and_drops_fast(spark):
    t = np.arange(2000)
    slow, fast = 1e5 * np.sin(2 * np.pi * t / 200), 1e5 * np.sin(2 * np.pi * t / 2.5)
    for method in ("iir", "fir"):
        rows = waveform.decimated(frame(spark, [slow, fast]), 4, method).orderBy("id").collect()
        assert np.allclose(rows[0].waveform[50:-50], slow[::4][50:-50], atol=2e3)
        assert max(abs(v) for v in rows[1].waveform[50:-50]) < 2e3
    same = waveform.decimated(frame(spark, [[1.9, -1.9]]), 1).first().waveform
    assert same == [1, -1]


def test_resize_by_hand():
    w = kernels.bilinear_weights(4, 2)
    assert np.allclose(w, [[0.5, 0.5, 0, 0], [0, 0, 0.5, 0.5]])
    assert np.allclose(kernels.bilinear_weights(2, 4), [[1, 0], [0.75, 0.25], [0.25, 0.75], [0, 1]])
    assert np.allclose(kernels.bilinear_weights(129, 128).sum(axis=1), 1)


def test_resize_of_equal_size_is_identity(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],), ([],)], "m array<array<double>>")
    got = [r.m for r in spectral.resize(df, "m", 2, 2).collect()]
    assert got == [[[1.0, 2.0], [3.0, 4.0]], None]


def test_normalise_and_resample(spark):
    lo, hi = levels.AMPLITUDE_MIN, levels.AMPLITUDE_MAX
    x = [0.0, 1.0, -1.0, 2 * hi, -2 * hi, lo / 2, -lo / 2]
    fixed = frame(spark, [x]).select(levels.resample_and_normalise("samples", 7)).first()[0]
    assert np.allclose(fixed, [0, (1 - lo) / hi, (-1 + lo) / hi, (hi - lo) / hi, (-hi + lo) / hi, 0, 0])
    compat = frame(spark, [x]).select(levels.resample_and_normalise("samples", 7, compat=True)).first()[0]
    assert np.allclose(compat, [0, (1 - lo) / hi, (-1 + lo) / hi, (hi - lo) / hi, (hi - lo) / hi, 0, 0])
    y = np.random.default_rng(5).normal(size=50)
    wide = np.interp(np.linspace(0, 49, 77), np.arange(50), y)
    assert np.allclose(kernels.resample_rows(y[None], 77)[0], wide)
    assert frame(spark, [[1.0]]).select(levels.resample_and_normalise("samples", 4)).first()[0] is None


def test_small_expressions(spark):
    assert waveform.waveform_size(100, 240) == 32768
    r = spark.range(1).select(
        levels.next_power_of_two(24001).alias("p"),
        levels.contrast(F.lit(95 / 175)).alias("zero"),
        levels.contrast(F.lit(1.0)).alias("one"),
        levels.peak_normalise(F.array(F.lit(-2.0), F.lit(1.0))).alias("n"),
        levels.peak_normalise(F.array(F.lit(0.0))).alias("silent"),
        levels.hamming(F.lit(0), 16).alias("h"),
    ).first()
    assert (r.p, round(r.zero, 9), round(r.one, 9)) == (32768, 0.0, 1.0)
    assert r.n == [-32767, 16383] and r.silent == [None] and r.h == pytest.approx(0.08)


def test_half_precision(spark):
    from brinewave.functions.curves import objective_curve

    df = spark.createDataFrame([([0.3],)], "o array<double>")
    r = df.select(
        objective_curve("o", 50, 100.0, 10.0).alias("full"),
        objective_curve("o", 50, 100.0, 10.0, compat_half=True).alias("half"),
    ).first()
    assert r.half == np.array(r.full).astype(np.float16).astype(float).tolist() and r.half != r.full


def test_registered_feature(spark):
    register_feature("mean", lambda s, fs, **kw: s.withColumn("m", F.array_max("samples")))
    try:
        assert FEATURES["mean"](frame(spark, [[1.0, 4.0]]), 240).first().m == 4.0
    finally:
        FEATURES.pop("mean")
