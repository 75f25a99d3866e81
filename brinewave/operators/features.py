"""Feature plug-ins: named functions from segments with samples to feature columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewave.functions.levels import PIXEL_VMAX, PIXEL_VMIN
from brinewave.operators import spectral, waveform, wavelet
from brinewave.operators.segments import segment_samples, tile_samples

# name -> fn(segments, fs, **options); input columns ``samples`` (ARRAY<DOUBLE>) and the keys
FEATURES: dict[str, Callable[..., DataFrame]] = {}


def register_feature(name: str, fn: Callable[..., DataFrame]) -> None:
    FEATURES[name] = fn


def _image(segments: DataFrame, fs: int, vmin: float = PIXEL_VMIN, vmax: float = PIXEL_VMAX, **kw) -> DataFrame:
    spectra = spectral.spectrogram(segments, float(fs), vmin=vmin, vmax=vmax, **kw)
    return spectral.pixels(spectra, vmin, vmax).drop("spectro")


register_feature("spectrogram", lambda s, fs, **kw: spectral.spectrogram(s, float(fs), **kw))
register_feature("image", _image)
register_feature("wavelet", lambda s, fs, **kw: wavelet.wavelet_transform(s, **kw))
register_feature("energy", lambda s, fs, **kw: wavelet.energy_share(s, **kw))
register_feature("waveform", lambda s, fs, **kw: waveform.decimated(s, **kw))


def segment_features(
    segments: DataFrame,
    chunks: DataFrame,
    feature: str,
    fs: int,
    width_us: int,
    tiling: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Cut the samples of each segment and run a feature on them.

    ``fs`` is the sampling frequency of the archive; stations recorded at
    another one are built with their own call. Where the segments are the tiles
    of ``tiling(station, start_us, end_us)``, give it: samples then move once.
    """
    recorded = chunks.where(F.col("fs") == fs)
    if tiling is None:
        cut = segment_samples(segments, recorded, width_us)
    else:
        # same keys as the assembly, so the samples are not shuffled for the join
        cut = tile_samples(tiling, recorded, width_us).drop("k")
        keys = ["station", "seg_start_us", "seg_end_us"]
        cut = cut.join(segments, keys)
    ready = cut.drop("fs").withColumn("samples", F.col("samples").cast("array<double>"))
    return FEATURES[feature](ready, fs, **options).drop("samples")
