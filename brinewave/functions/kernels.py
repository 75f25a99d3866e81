"""Numeric kernels that run inside Arrow batches.

Spark cuts, joins and distributes the arrays; a kernel only sees the arrays of
one batch and returns one array per row. Rows of equal length are stacked so
that numpy works on whole matrices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

# Analysis taps of the biorthogonal 2.4 wavelet
BIOR24_LOW = [
    0.0, 0.03314563036811942, -0.06629126073623884, -0.17677669529663689, 0.4198446513295126,
    0.9943689110435825, 0.4198446513295126, -0.17677669529663689, -0.06629126073623884,
    0.03314563036811942,
]
BIOR24_HIGH = [
    0.0, 0.0, 0.0, 0.3535533905932738, -0.7071067811865476, 0.3535533905932738,
    0.0, 0.0, 0.0, 0.0,
]


def _rows(column: pa.Array) -> list[np.ndarray | None]:
    """One float array per row, null rows as None."""
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    offsets = column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [flat[a:b] if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], valid)]


def _lists(rows: list, value_type: pa.DataType) -> pa.ListArray:
    """Rows of 1-D arrays (or None) -> list<value_type>."""
    sizes = np.array([0 if r is None else len(r) for r in rows], dtype=np.int64)
    full = [r for r in rows if r is not None]
    values = np.concatenate(full) if full else np.empty(0)
    values = values.astype(value_type.to_pandas_dtype(), copy=False)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    mask = pa.array([r is None for r in rows]) if any(r is None for r in rows) else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=value_type), mask=mask)


def _nested(rows: list) -> pa.ListArray:
    """Rows of lists of 1-D arrays (or None) -> list<list<double>>."""
    inner = [a for r in rows if r is not None for a in r]
    sizes = np.array([0 if r is None else len(r) for r in rows], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    mask = pa.array([r is None for r in rows]) if any(r is None for r in rows) else None
    return pa.ListArray.from_arrays(pa.array(offsets), _lists(inner, pa.float64()), mask=mask)


# Values a kernel holds at once, so that a batch of any size stays small in memory
BLOCK_VALUES = 1_000_000


def _by_length(rows: list, work, width: int = 1) -> list:
    """Apply ``work(matrix) -> sequence of row results`` to blocks of rows of equal length.

    ``width`` is the length of a result where it can exceed the length of a row.
    """
    out: list = [None] * len(rows)
    groups: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        if r is not None:
            groups.setdefault(len(r), []).append(i)
    for size, members in groups.items():
        block = max(1, BLOCK_VALUES // max(size, width))
        for k in range(0, len(members), block):
            part = members[k : k + block]
            for i, result in zip(part, work(np.stack([rows[i] for i in part]))):
                out[i] = result
    return out


def power_frames(x: np.ndarray, fs: float, nperseg: int, hop: int) -> np.ndarray:
    """One-sided power density of every full frame: (rows, frames, bins)."""
    if x.shape[1] < nperseg:
        return np.empty((x.shape[0], 0, nperseg // 2 + 1))
    frames = np.lib.stride_tricks.sliding_window_view(x, nperseg, axis=1)[:, ::hop]
    frames = frames - frames.mean(axis=2, keepdims=True)
    weight = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    power = np.abs(np.fft.rfft(frames * weight, axis=2)) ** 2 / (fs * np.sum(weight**2))
    power[:, :, 1 : (nperseg + 1) // 2] *= 2
    return power


def wavelet_step(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Approximation and detail of one level with half-point symmetric borders."""
    taps = len(BIOR24_LOW)
    ext = np.pad(x, ((0, 0), (taps - 1, taps - 1)), mode="symmetric")
    windows = np.lib.stride_tricks.sliding_window_view(ext, taps, axis=1)[:, 1::2]
    return windows @ np.array(BIOR24_LOW[::-1]), windows @ np.array(BIOR24_HIGH[::-1])


def wavelet_levels(x: np.ndarray, n_levels: int) -> list[np.ndarray]:
    """[coarsest approximation, coarsest detail, ..., finest detail]."""
    details = []
    for _ in range(n_levels):
        x, detail = wavelet_step(x)
        details.append(detail)
    return [x] + details[::-1]


def lowpass_taps(q: int) -> np.ndarray:
    """Hamming-windowed sinc of 20 q + 1 taps, cut off at 1/q of Nyquist, unit gain at 0."""
    n = 20 * q
    at = np.arange(n + 1) - n / 2
    taps = np.sinc(at / q) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n + 1) / n))
    return taps / taps.sum()


def chebyshev_response(cutoff: float, order: int = 8, ripple_db: float = 0.05) -> np.ndarray:
    """Impulse response of a type I Chebyshev low-pass, cut off at a fraction of Nyquist."""
    eps = np.sqrt(10 ** (ripple_db / 10) - 1)
    mu = np.arcsinh(1 / eps) / order
    angle = np.pi * (2 * np.arange(1, order + 1) - 1) / (2 * order)
    poles = -np.sinh(mu) * np.sin(angle) + 1j * np.cosh(mu) * np.cos(angle)
    gain = np.prod(-poles).real / (np.sqrt(1 + eps**2) if order % 2 == 0 else 1.0)
    warp = 4 * np.tan(np.pi * cutoff / 2)
    poles, gain = poles * warp, gain * warp**order
    gain = gain * np.real(1 / np.prod(4 - poles))
    poles = (4 + poles) / (4 - poles)
    # sampled densely enough that the response has died out within half the grid
    size = 1 << int(np.ceil(np.log2(8000 / cutoff)))
    z = np.exp(-1j * np.pi * np.arange(size // 2 + 1) / (size // 2))
    response = gain * (1 + z) ** order / np.prod(1 - poles[:, None] * z, axis=0)
    h = np.fft.irfft(response, size)[: size // 2]
    alive = np.nonzero(np.abs(h) > 1e-14 * np.abs(h).max())[0]
    return h[: alive[-1] + 1]


def _settled(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Causal filter of each row, in steady state for its first value at the start."""
    lead = np.repeat(x[:, :1], len(h), axis=1)
    padded = np.concatenate([lead, x], axis=1)
    size = 1 << int(np.ceil(np.log2(padded.shape[1] + len(h))))
    full = np.fft.irfft(np.fft.rfft(padded, size) * np.fft.rfft(h, size), size)
    return full[:, len(h) : padded.shape[1]]


def zero_phase(x: np.ndarray, h: np.ndarray, pad: int) -> np.ndarray:
    """Forward and backward filter with odd extension at both ends."""
    pad = min(pad, x.shape[1] - 1)
    ext = np.pad(x, ((0, 0), (pad, pad)), mode="reflect", reflect_type="odd")
    there = _settled(ext, h)
    back = _settled(there[:, ::-1], h)[:, ::-1]
    return back[:, pad : pad + x.shape[1]]


def decimate_rows(x: np.ndarray, q: int, method: str = "iir") -> np.ndarray:
    """Zero-phase low-pass and every q-th sample.

    ``iir``: Chebyshev of order 8 cut off at 0.8/q, both directions. ``fir``:
    symmetric taps, evaluated at the kept samples only.
    """
    if x.shape[1] == 0:
        return x
    if method == "iir":
        return zero_phase(x, chebyshev_response(0.8 / q), 27)[:, ::q]
    taps = lowpass_taps(q)
    half = len(taps) // 2
    ext = np.pad(x, ((0, 0), (half, half)), mode="symmetric")
    return np.lib.stride_tricks.sliding_window_view(ext, len(taps), axis=1)[:, ::q] @ taps


def bilinear_weights(n_in: int, n_out: int) -> np.ndarray:
    """(n_out, n_in) interpolation matrix with half-pixel centers, clamped at the border."""
    at = (np.arange(n_out) + 0.5) * n_in / n_out - 0.5
    low = np.floor(at).astype(int)
    part = at - low
    weights = np.zeros((n_out, n_in))
    rows = np.arange(n_out)
    np.add.at(weights, (rows, np.clip(low, 0, n_in - 1)), 1 - part)
    np.add.at(weights, (rows, np.clip(low + 1, 0, n_in - 1)), part)
    return weights


def decibel_rows(
    power: np.ndarray, lo: int, hi: int, apply_log: bool, vmin: float | None, vmax: float | None
) -> np.ndarray:
    """(rows, frames, bins) power -> (rows, band bins from high to low, frames) values."""
    v = power[:, :, lo:hi].transpose(0, 2, 1)[:, ::-1]
    if apply_log:
        v = 10 * np.log10(v + 1e-20)
    if v.size and not (vmin is None and vmax is None):
        v = np.clip(v, vmin, vmax)
    return v


def spectrogram_column(samples: Column, fs: float, nperseg: int, hop: int) -> Column:
    """ARRAY<ARRAY<DOUBLE>>: power per frame, then per frequency bin."""

    @arrow_udf("array<array<double>>")
    def run(s: pa.Array) -> pa.Array:
        return _nested(_by_length(_rows(s), lambda x: power_frames(x, fs, nperseg, hop)))

    return run(samples)


def image_column(
    samples: Column, fs: float, nperseg: int, hop: int, band: tuple[int, int],
    apply_log: bool = True, vmin: float | None = None, vmax: float | None = None,
) -> Column:
    """ARRAY<ARRAY<DOUBLE>>: one row per frequency of the band (descending), over time.

    A bound that is missing is the segment's own extreme, which clips nothing.
    """

    @arrow_udf("array<array<double>>")
    def run(s: pa.Array) -> pa.Array:
        def work(x: np.ndarray) -> np.ndarray:
            return decibel_rows(power_frames(x, fs, nperseg, hop), *band, apply_log, vmin, vmax)

        return _nested(_by_length(_rows(s), work))

    return run(samples)


def limited_levels(
    levels: list[np.ndarray], apply_log: bool, vmin: float | None, vmax: float | None, compat: bool
) -> list[np.ndarray]:
    """Coefficients in dB if asked, and clamped; a missing bound is the row's own extreme.

    ``compat`` sends low values to vmax.
    """
    if apply_log:
        levels = [10 * np.log10(np.abs(a) + 1e-3) for a in levels]
    if vmin is None and vmax is None:
        return levels
    out = []
    for a in levels:
        low = a.min(axis=1, keepdims=True) if vmin is None else vmin
        high = a.max(axis=1, keepdims=True) if vmax is None else vmax
        out.append(np.where(a > high, high, np.where(a < low, high if compat else low, a)))
    return out


def wavelet_column(
    samples: Column, n_levels: int, apply_log: bool = False, vmin: float | None = None, vmax: float | None = None, compat: bool = False
) -> Column:
    """ARRAY<ARRAY<DOUBLE>> of n_levels + 1 arrays, coarsest first."""

    def work(x: np.ndarray):
        return zip(*limited_levels(wavelet_levels(x, n_levels), apply_log, vmin, vmax, compat))

    @arrow_udf("array<array<double>>")
    def run(s: pa.Array) -> pa.Array:
        return _nested(_by_length(_rows(s), work))

    return run(samples)


def peak_column(samples: Column) -> Column:
    """ARRAY<SMALLINT>: values relative to the largest magnitude of the row, cut to integers."""

    @arrow_udf("array<smallint>")
    def run(s: pa.Array) -> pa.Array:
        out = []
        for x in _rows(s):
            peak = np.abs(x).max() if x is not None and len(x) else 0
            out.append(None if x is None else [None] * len(x) if not peak > 0 else np.trunc(32767.0 * x / peak).astype(np.int16))
        return pa.array(out, pa.list_(pa.int16()))

    return run(samples)


def level_means_column(samples: Column, n_levels: int) -> Column:
    """ARRAY<DOUBLE>: mean magnitude of the first n_levels arrays, coarsest first.

    Only the means go back to the JVM, not the coefficients.
    """

    @arrow_udf("array<double>")
    def run(s: pa.Array) -> pa.Array:
        def work(x: np.ndarray) -> np.ndarray:
            parts = wavelet_levels(x, n_levels)[:n_levels]
            return np.column_stack([np.abs(p).mean(axis=1) for p in parts])

        return _lists(_by_length(_rows(s), work), pa.float64())

    return run(samples)


def decimate_column(samples: Column, q: int, method: str = "iir") -> Column:
    """ARRAY<INT>: low-passed, decimated, truncated toward zero."""

    @arrow_udf("array<int>")
    def run(s: pa.Array) -> pa.Array:
        rows = _by_length(_rows(s), lambda x: np.trunc(decimate_rows(x, q, method)).astype(np.int32))
        return _lists(rows, pa.int32())

    return run(samples)


def resize_images(m: pa.ListArray, height: int, width: int) -> pa.ListArray:
    """Bilinear resampling of list<list<double>> images to height x width."""
    inner = m.values
    flat = inner.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    at = inner.offsets.to_numpy()
    outer = m.offsets.to_numpy()
    out: list = []
    for a, b in zip(outer[:-1], outer[1:]):
        if a == b or at[a] == at[b]:
            out.append(None)
            continue
        x = flat[at[a] : at[b]].reshape(b - a, -1)
        out.append(bilinear_weights(len(x), height) @ x @ bilinear_weights(x.shape[1], width).T)
    return _nested(out)


def resample_rows(x: np.ndarray, n: int) -> np.ndarray:
    """Linear interpolation of each row onto n points from its first to its last sample."""
    at = np.linspace(0, x.shape[1] - 1, n)
    left = np.minimum(at.astype(int), x.shape[1] - 2)
    return x[:, left] + (at - left) * (x[:, left + 1] - x[:, left])


def normalise_rows(x: np.ndarray, vmin: float, vmax: float, compat: bool = False) -> np.ndarray:
    """Amplitudes brought into [-1, 1]; ``compat`` drops the sign of clipped values."""
    sign = 1.0 if compat else np.where(x < 0, -1.0, 1.0)
    size = np.abs(x)
    x = np.where(size < vmin, sign * vmin, np.where(size > vmax, sign * vmax, x))
    return (x - np.sign(x) * vmin) / vmax


def waveform_column(
    samples: Column, n: int, vmin: float, vmax: float, compat: bool = False
) -> Column:
    """ARRAY<DOUBLE>: resampled to n points and normalised; null below two samples."""

    @arrow_udf("array<double>")
    def run(s: pa.Array) -> pa.Array:
        rows = [r if r is not None and len(r) > 1 else None for r in _rows(s)]
        work = lambda x: normalise_rows(resample_rows(x, n), vmin, vmax, compat)
        return _lists(_by_length(rows, work, n), pa.float64())

    return run(samples)


def tenths_half_even(us: np.ndarray) -> np.ndarray:
    """Microseconds in tenths of a second, half to even."""
    q, rest = np.divmod(us, 100_000)
    return q + ((rest > 50_000) | ((rest == 50_000) & (q % 2 != 0)))


def ordered_picks(times: np.ndarray, copies: np.ndarray, at: int, center: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets in tenths, copies): the own time first, then earlier and later ones by their distance.

    Times of one side with the same offset are one pick.
    """
    gap = times - at
    side, distance = np.where(gap == 0, 0, np.where(gap < 0, 1, 2)), np.abs(gap)
    offset = tenths_half_even(times - center)
    order = np.lexsort((distance, offset, side))
    side, offset, distance = side[order], offset[order], distance[order]
    first = np.flatnonzero(np.append(True, (side[1:] != side[:-1]) | (offset[1:] != offset[:-1])))
    total = np.add.reduceat(copies[order], first)
    place = np.lexsort((offset[first], distance[first], side[first]))
    return offset[first][place], total[place]


def neighbour_picks(near: Column | str, at_us: Column | str, center_us: Column | str) -> Column:
    """ARRAY<STRUCT<offset_s, n_annotators, copies>> from lists of STRUCT<event_us, copies>; empty for null."""

    @arrow_udf("array<struct<offset_s:double,n_annotators:int,copies:bigint>>")
    def run(lists: pa.Array, at: pa.Array, center: pa.Array) -> pa.Array:
        sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
        flat = lists.flatten()
        times, copies = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        offsets, counts, n = [], [], []
        end = np.cumsum(sizes)
        for first, last, a, c in zip((end - sizes).tolist(), end.tolist(), at.to_pylist(), center.to_pylist()):
            o, k = ordered_picks(times[first:last], copies[first:last], a, c) if last > first else (times[:0], copies[:0])
            offsets.append(o)
            counts.append(k)
            n.append(len(o))
        tenths = np.concatenate([times[:0], *offsets])
        picks = pa.StructArray.from_arrays(
            [pa.array(tenths / 10.0), pa.nulls(len(tenths), pa.int32()), pa.array(np.concatenate([copies[:0], *counts]), pa.int64())],
            ["offset_s", "n_annotators", "copies"],
        )
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), picks)

    return run(near, at_us, center_us)


def triangles(at: np.ndarray, n: int, width: float) -> np.ndarray:
    """Triangles of half width ``width`` steps around the positions of each row, over n steps."""
    steps = np.arange(n, dtype=float)
    nearest = np.full((len(at), n), np.inf)
    for place in at.T:
        np.minimum(nearest, np.abs(steps - place[:, None]), out=nearest)
    return np.maximum(0.0, (width - nearest) / width)


def triangle_column(positions: Column, n: int, width: float, half: bool = False) -> Column:
    """ARRAY<DOUBLE> of n steps; ``half`` rounds the values to 16-bit floats."""

    @arrow_udf("array<double>")
    def run(p: pa.Array) -> pa.Array:
        rows = _by_length(_rows(p), lambda at: triangles(at, n, width), n)
        if half:
            rows = [None if r is None else r.astype(np.float16) for r in rows]
        return _lists(rows, pa.float64())

    return run(positions)


def peak_indices(v: np.ndarray, height: float, gap: int | None) -> np.ndarray:
    """Local maxima of at least ``height``, at least ``gap`` steps apart, highest kept."""
    if len(v) < 3:
        return np.empty(0, dtype=int)
    start = np.flatnonzero(np.diff(v, prepend=np.nan) != 0)
    stop = np.append(start[1:], len(v)) - 1
    run = v[start]
    inner = np.arange(1, len(run) - 1)
    top = inner[(run[inner] > run[inner - 1]) & (run[inner] > run[inner + 1]) & (run[inner] >= height)]
    at = (start[top] + stop[top]) // 2
    if gap is None or not len(at):
        return at
    keep = np.zeros(len(at), dtype=bool)
    open_ = np.ones(len(at), dtype=bool)
    low, high = np.searchsorted(at, at - gap, side="right"), np.searchsorted(at, at + gap)
    for j in np.lexsort((at, v[at]))[::-1]:
        if open_[j]:
            keep[j] = True
            open_[low[j] : high[j]] = False
    return at[keep]


def peaks_column(curve: Column, height: float, gap: int | None) -> Column:
    """ARRAY<STRUCT<i, h>> of the peaks of a curve of any length."""

    @arrow_udf("array<struct<i:int,h:double>>")
    def run(c: pa.Array) -> pa.Array:
        rows = _rows(c)
        found = [np.empty(0, dtype=int) if r is None else peak_indices(r, height, gap) for r in rows]
        heights = [r[f] for r, f in zip(rows, found) if len(f)]
        at = np.concatenate(found) if found else np.empty(0)
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        items = pa.StructArray.from_arrays(
            [
                pa.array(at.astype(np.int32)),
                pa.array(np.concatenate(heights) if heights else np.empty(0)),
            ],
            names=["i", "h"],
        )
        mask = pa.array([r is None for r in rows]) if any(r is None for r in rows) else None
        return pa.ListArray.from_arrays(pa.array(offsets), items, mask=mask)

    return run(curve)
