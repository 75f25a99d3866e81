"""Queries on spectrograms, wavelets, waveforms and WAV archives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewave.functions.curves import unnest
from brinewave.functions.levels import contrast, peak_normalise, resample_and_normalise
from brinewave.operators import segments as seg
from brinewave.operators import spectral, waveform, wavelet
from brinewave.operators.archive import archive_frames
from brinewave.plans import sql, views
from brinewave.plans.storage import new_folder
from brinewave.plans.registry import Tables, query
from brinewave.sources import sinks, wav

with_ = sql.with_
FS, NPERSEG = 8.0, 16
F_MAX = 3.5
BAND_SQL = "select * from db where f_bin < 7"


def spectra(t: Tables, **kw) -> DataFrame:
    return spectral.spectrogram(views.waves(t.embeddings), FS, NPERSEG, f_max=F_MAX, **kw).drop("samples")


@query(
    "q25_stft_db",
    with_(sql.FRAMES)
    + f""", band as ({BAND_SQL}), lim as (select id, max(v) as top from band group by id)
select id as vec_id, f_bin::int as f_bin, t_bin::int as t_bin, f_bin * 0.5 ::double as f, 1.0::double + t_bin as t,
       round(least(greatest(v, -30), top), 4) as v
from band join lim using (id)""",
)
def stft_db(t: Tables) -> DataFrame:
    """Decibel spectrogram below 3.5 Hz; floor at -30, ceiling at the segment's maximum."""
    rows = spectral.long_form(spectra(t, vmin=-30.0), ["vec_id"], FS, NPERSEG, f_max=F_MAX)
    return rows.withColumn("v", F.round("v", 4))


@query(
    "q26_dwt",
    with_(sql.WAVE, sql.wavelet_level("wave", "one"), sql.wavelet_level("one", "two"))
    + """select id as vec_id, 0 as level, i::int as k, round(v, 6) as coef from two
union all select id, 1, i::int, round(v, 6) from two_d
union all select id, 2, i::int, round(v, 6) from one_d""",
)
def dwt(t: Tables) -> DataFrame:
    levels = wavelet.wavelet_transform(views.waves(t.embeddings), 2)
    each = unnest(levels, ["vec_id"], "levels", "level", "a")
    return unnest(each, ["vec_id", "level"], "a", "k", "c").select(
        "vec_id", "level", "k", F.round("c", 6).alias("coef")
    )


@query(
    "q26_scalogram",
    with_(sql.WAVE, sql.wavelet_level("wave", "one"), sql.wavelet_level("one", "two"))
    + """, a as (
  select id, 0 as level, i // 2 as k, i from (select distinct id, unnest(range(36)) as i from one_n)
  union all select id, 1, i // 2, i from (select distinct id, unnest(range(36)) as i from one_n)
  union all select id, 2, i, i from (select distinct id, unnest(range(36)) as i from one_n)),
c as (select id, 0 as level, i as k, v from two union all select id, 1, i, v from two_d union all select id, 2, i, v from one_d)
select a.id as vec_id, a.level, round(sum(abs(c.v) * (a.i + 1)), 5) as weighted, count(*) as n
from a join c on c.id = a.id and c.level = a.level and c.k = a.k group by all""",
)
def scalogram(t: Tables) -> DataFrame:
    """Levels stretched to the finest length, reduced to a position-weighted sum."""
    levels = wavelet.wavelet_transform(views.waves(t.embeddings), 2)
    aligned = levels.withColumn("rows", wavelet.aligned_scalogram("levels", 2))
    rows = unnest(aligned, ["vec_id"], "rows", "level", "a")
    weighted = F.aggregate(F.transform("a", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select(
        "vec_id", "level", F.round(weighted, 5).alias("weighted"), F.size("a").cast("bigint").alias("n")
    )


@query(
    "q27_energy_share",
    with_(sql.WAVE, sql.wavelet_level("wave", "one"), sql.wavelet_level("one", "two"))
    + """, m as (
  select id, 0 as level, avg(abs(v)) as s from two group by id
  union all select id, 1, avg(abs(v)) from two_d group by id)
select id as vec_id, level, round(s / sum(s) over (partition by id), 6) as share from m""",
)
def energy_share(t: Tables) -> DataFrame:
    shares = wavelet.energy_share(views.waves(t.embeddings), 2)
    rows = unnest(shares, ["vec_id"], "share", "level", "s")
    return rows.select("vec_id", "level", F.round("s", 6).alias("share"))


@query(
    "q28_decimate",
    with_(sql.WAVE)
    + """, raw as (
  select j, case when j = 20 then 1.0 else sin(pi() * (j - 20) / 2.0) / (pi() * (j - 20) / 2.0) end
            * (0.54 - 0.46 * cos(2 * pi() * j / 40)) as h from range(41) r(j)),
taps as (select j, h / sum(h) over () as h from raw),
y as (
  select o.id, o.k, sum(h * v * 10000) as y
  from (select id, unnest(range(32)) as k from (select distinct id from wave)) o, taps
  join wave w on w.id = o.id and w.i = case when 2 * k + j - 20 < 0 then -(2 * k + j - 20) - 1
    when 2 * k + j - 20 > 63 then 127 - (2 * k + j - 20) else 2 * k + j - 20 end
  group by all)
select id as vec_id, k::int as i, trunc(y)::int as x from y""",
)
def decimate(t: Tables) -> DataFrame:
    scaled = views.waves(t.embeddings).withColumn("samples", F.transform("samples", lambda x: x * 10000.0))
    rows = waveform.decimated(scaled, 2, method="fir")
    return unnest(rows, ["vec_id"], "waveform", "i", "x")


@query("q28_decimate_iir")
def decimate_iir(t: Tables) -> DataFrame:
    """Recursive low-pass in both directions; a recursion over samples has no SQL form here."""
    scaled = views.waves(t.embeddings).withColumn("samples", F.transform("samples", lambda x: x * 10000.0))
    return unnest(waveform.decimated(scaled, 2), ["vec_id"], "waveform", "i", "x")


def resize_sql(source: str, n_in: tuple[int, int], n_out: tuple[int, int]) -> str:
    """Bilinear weights and resampling of ``source(id, r, c, v)`` as ``resized(id, r, c, v)``."""

    def weights(name: str, a: int, b: int) -> str:
        at = f"((o + 0.5::double) * {a} / {b}.0::double - 0.5)"
        return f"""{name} as (
  select o, least(greatest(floor({at})::int, 0), {a - 1}) as i, 1 - ({at} - floor({at})) as w from range({b}) r(o)
  union all select o, least(greatest(floor({at})::int + 1, 0), {a - 1}), {at} - floor({at}) from range({b}) r(o))"""

    return f"""{weights("wr", n_in[0], n_out[0])},
{weights("wc", n_in[1], n_out[1])},
resized as (
  select s.id, wr.o as r, wc.o as c, sum(s.v * wr.w * wc.w) as v
  from {source} s join wr on wr.i = s.r join wc on wc.i = s.c group by all)"""


@query(
    "q29_resize",
    with_(sql.FRAMES)
    + ", img as (select id, 6 - f_bin as r, t_bin as c, v from db where f_bin < 7),\n"
    + resize_sql("img", (7, 7), (5, 9))
    + " select id as vec_id, r::int as r, c::int as c, round(v, 4) as v from resized",
)
def resize(t: Tables) -> DataFrame:
    images = spectral.resize(spectra(t), "spectro", 5, 9)
    rows = unnest(images, ["vec_id"], "spectro", "r", "a")
    return unnest(rows, ["vec_id", "r"], "a", "c", "v").withColumn("v", F.round("v", 4))


@query(
    "q30_normalise_resample",
    with_(sql.WAVE)
    + """, pts as (
  select id, j, j * 63 / 99.0::double as u from (select distinct id from wave), range(100) r(j)),
re as (
  select p.id, j, a.v + (u - least(floor(u), 62)) * (b.v - a.v) as v
  from pts p join wave a on a.id = p.id and a.i = least(floor(u), 62)::int
  join wave b on b.id = p.id and b.i = a.i + 1),
lim as (select pow(10, -35 / 20.0::double) as lo, pow(10, 140 / 20.0::double) as hi),
cl as (
  select id, j, case when abs(v) < lo then (case when v < 0 then -lo else lo end)
    when abs(v) > hi then (case when v < 0 then -hi else hi end) else v end as v, lo, hi from re, lim),
nrm as (select id, j, case when v > 0 then (v - lo) / hi when v < 0 then (v + lo) / hi else v end as v from cl),
pk as (select id, max(abs(v)) as m from wave group by id)
select n.id as vec_id, round(sum(n.v * (j + 1)) * 1e6, 6) as normalised, max(q.s)::bigint as pcm
from nrm n join (select id, sum(trunc(32767 * v / m)::int * (i + 1)) as s from wave join pk using (id) group by id) q using (id)
group by n.id""",
)
def normalise_resample(t: Tables) -> DataFrame:
    """Resampled and normalised waveform, and 16-bit values, as position-weighted sums."""
    weighted = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    pcm = F.transform(peak_normalise("samples"), lambda v, i: v.cast("bigint") * (i + 1))
    return views.waves(t.embeddings).withColumn("x", resample_and_normalise("samples", 100)).select(
        "vec_id",
        F.round(weighted * 1e6, 6).alias("normalised"),
        F.aggregate(pcm, F.lit(0).cast("bigint"), lambda s, v: s + v).alias("pcm"),
    )


@query(
    "q31_quantise",
    with_(sql.FRAMES)
    + """select id as vec_id, (6 - f_bin)::int as r, t_bin::int as c, px::int as pixel,
       round(greatest(px / 255.0::double * 255.0 - 95 * 255 / 175.0::double, 0) / (255.0 - 95 * 255 / 175.0::double), 6) as shown
from (select *, trunc(255 * (least(greatest(v, -35), 140) + 35) / 175.0::double) as px from db where f_bin < 7)""",
)
def quantise(t: Tables) -> DataFrame:
    images = spectral.pixels(spectra(t, vmin=-35.0, vmax=140.0), -35.0, 140.0)
    rows = unnest(images, ["vec_id"], "pixels", "r", "a")
    cells = unnest(rows, ["vec_id", "r"], "a", "c", "p")
    return cells.select(
        "vec_id",
        "r",
        "c",
        F.col("p").cast("int").alias("pixel"),
        F.round(contrast(F.col("p") / F.lit(255.0)), 6).alias("shown"),
    )


VIEWPORT_SQL = (
    with_(sql.FRAMES)
    + """, fr as (
  select id % 5 as station, 1704067200000000 + (id // 5) * 8000000 + ((1 + t_bin) * 1000000)::bigint as frame_us, f_bin, v
  from db where f_bin * 0.5 between 0.5 and 2.5),
req as (
  select n_name as request, n_regionkey as station, 1704067200000000 + n_nationkey * 31000000 + 9000000 as center_us from nation)
select request, fr.station::bigint as station, (frame_us - center_us) / 1e6 as t_rel, f_bin::int as f_bin, round(v, 4) as v
from fr join req on fr.station = req.station and frame_us between center_us - 10000000 and center_us + 10000000"""
)


@query("q35_viewport", VIEWPORT_SQL)
def viewport(t: Tables) -> DataFrame:
    """Spectrogram between 0.5 and 2.5 Hz in 20-second windows around requested centers."""
    asked = view_requests(t)
    waves = placed_waves(t).withColumn("end_us", F.col("start_us") + 8_000_000)
    wanted = spectral.requested_only(waves, asked, "start_us", "end_us", 20_000_000)
    seen = spectral.viewport(wave_frames(wanted), asked, 0.5, 2.5, 20_000_000)
    return seen.select("request", "station", "t_rel", "f_bin", F.round("v", 4).alias("v"))


def placed_waves(t: Tables) -> DataFrame:
    """The vectors as recordings of five stations, eight seconds each."""
    start = F.lit(views.WAVE_BASE_US) + F.floor(F.col("vec_id") / 5) * F.lit(8_000_000)
    return views.waves(t.embeddings).withColumn("station", F.col("vec_id") % 5).withColumn("start_us", start)


def wave_frames(waves: DataFrame) -> DataFrame:
    """``(station, frame_us, f_bin, f, v)`` of placed waves."""
    rows = spectral.spectrogram(waves, FS, NPERSEG).drop("samples")
    each = spectral.long_form(rows, ["station", "start_us"], FS, NPERSEG)
    return each.select("station", (F.col("start_us") + (F.col("t") * F.lit(1e6)).cast("bigint")).alias("frame_us"), "f_bin", "f", "v")


def view_requests(t: Tables) -> DataFrame:
    return t.nation.select(
        F.col("n_name").alias("request"),
        F.col("n_regionkey").cast("bigint").alias("station"),
        (F.lit(views.WAVE_BASE_US) + F.col("n_nationkey") * F.lit(31_000_000) + 9_000_000).alias("center_us"),
        F.lit(20_000_000).cast("bigint").alias("length_us"),
    )


@query("q35_stored_viewport", VIEWPORT_SQL)
def stored_viewport(t: Tables) -> DataFrame:
    """The same windows out of frames stored by station and hour."""
    folder = new_folder(t.spark, "frames")
    sinks.write_frames(wave_frames(placed_waves(t)), folder)
    # the requests inside the archive's time
    asked = view_requests(t).where(F.col("center_us") >= views.WAVE_BASE_US)
    seen = spectral.stored_viewport(t.spark.read.parquet(folder), asked, 0.5, 2.5)
    return seen.select("request", F.col("station").cast("bigint").alias("station"), "t_rel", "f_bin", F.round("v", 4).alias("v"))


def offsets_of(quality: str, key: str):
    at = (F.col(key) % 100 - 50).cast("double")
    return F.when(F.col(quality) == 1, F.array(at)).otherwise(F.array().cast("array<double>"))


@query(
    "q40_waveform_samples",
    with_(sql.WAVE)
    + """, s as (
  select p.doc_id as id, quality, j, a.v * 100 + (u - least(floor(u), 62)) * (b.v - a.v) * 100 as v
  from (select doc_id, quality, j, j * 63 / 127.0::double as u from labels, range(128) r(j)) p
  join wave a on a.id = p.doc_id and a.i = least(floor(u), 62)::int join wave b on b.id = p.doc_id and b.i = a.i + 1),
lim as (select pow(10, -35 / 20.0::double) as lo, pow(10, 140 / 20.0::double) as hi),
cl as (select *, case when abs(v) < lo then (case when v < 0 then -lo else lo end) else v end as w from s, lim),
n as (
  select id, j, case when w > 0 then (w - lo) / hi when w < 0 then (w + lo) / hi else w end as x,
         case when quality = 1 then greatest(0, (12.8::double - abs(j - (id % 100) * 1.28::double)) / 12.8::double) else 0 end as y
  from cl)
select id as vec_id, round(sum(x * (j + 1)) * 1e4, 6) as x, round(sum(y), 6) as y from n group by id""",
)
def waveform_samples(t: Tables) -> DataFrame:
    labels = t.labels.select(F.col("doc_id").alias("vec_id"), "quality")
    rows = views.waves(t.embeddings).join(labels, "vec_id")
    rows = rows.select(
        "vec_id",
        F.transform("samples", lambda x: x * 100.0).alias("waveform"),
        offsets_of("quality", "vec_id").alias("offsets"),
    )
    built = waveform.waveform_samples(rows, 128, 100.0)
    weighted = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return built.select(
        "vec_id",
        F.round(weighted * 1e4, 6).alias("x"),
        F.round(F.aggregate("y", F.lit(0.0), lambda s, v: s + v), 6).alias("y"),
    )


PIXELS_SQL = """img as (
  select id, 6 - f_bin as r, t_bin as c, trunc(255 * (least(greatest(v, -35), 140) + 35) / 175.0::double) as v from db where f_bin < 7)"""


@query(
    "q40_spectrogram_samples",
    with_(sql.FRAMES, PIXELS_SQL, resize_sql("img", (7, 7), (8, 12)))
    + """, y as (
  select doc_id as id, sum(case when quality = 1 then greatest(0, (1.2::double - abs(i - (doc_id % 100) / (100 / 12.0::double))) / 1.2::double) else 0 end) as y
  from labels, range(12) r(i) group by doc_id)
select r.id as vec_id, round(sum(r.v), 8) as image, round(max(y.y), 6) as y from resized r join y using (id) group by r.id""",
)
def spectrogram_samples(t: Tables) -> DataFrame:
    labels = t.labels.select(F.col("doc_id").alias("vec_id"), "quality")
    images = spectral.pixels(spectra(t, vmin=-35.0, vmax=140.0), -35.0, 140.0).join(labels, "vec_id")
    rows = images.withColumn("offsets", offsets_of("quality", "vec_id"))
    built = waveform.spectrogram_samples(rows, 8, 12, 100.0)
    total = F.aggregate(F.flatten("pixels"), F.lit(0.0), lambda s, v: s + v)
    return built.select(
        "vec_id",
        F.round(total, 8).alias("image"),
        F.round(F.aggregate("y", F.lit(0.0), lambda s, v: s + v), 6).alias("y"),
    )


@query(
    "q40_classifier_samples",
    with_(sql.FRAMES, PIXELS_SQL, resize_sql("img", (7, 7), (6, 6)))
    + """ select r.id as vec_id, round(sum(r.v), 8) as image, max(l.quality) as y
from resized r join labels l on l.doc_id = r.id group by r.id""",
)
def classifier_samples(t: Tables) -> DataFrame:
    label = F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label")
    labels = t.labels.select(F.col("doc_id").alias("vec_id"), label)
    images = spectral.pixels(spectra(t, vmin=-35.0, vmax=140.0), -35.0, 140.0).join(labels, "vec_id")
    built = waveform.classifier_samples(images, 6)
    total = F.aggregate(F.flatten("pixels"), F.lit(0.0), lambda s, v: s + v)
    return built.select("vec_id", F.round(total, 8).alias("image"), "y")


PCM_SQL = """pcm as (
  select vec_id, 'S' || (vec_id // 100) as station, 1704067200000000 + vec_id * 8000000 as start_us,
         unnest(range(64)) as i, unnest(list_transform(embedding, lambda x: round(x::double * 10000)::bigint)) as x
  from embeddings)"""


@query(
    "q41_wav_chunks",
    with_(PCM_SQL)
    + """select station, start_us as file_start_us, start_us + (i // 24) * 3000000 as chunk_us, 8 as fs, count(*) as n,
       sum(x * (i % 24 + 1))::bigint as weighted from pcm group by all""",
)
def wav_chunks(t: Tables) -> DataFrame:
    """Embeddings written as WAV files, decoded again into chunks of three seconds."""
    chunks = wav.decode_chunks(views.wave_files(t.embeddings), chunk_s=3)
    weighted = F.transform("samples", lambda x, i: x.cast("bigint") * (i + 1))
    return chunks.select(
        "station",
        "file_start_us",
        "chunk_us",
        "fs",
        F.size("samples").cast("bigint").alias("n"),
        F.aggregate(weighted, F.lit(0).cast("bigint"), lambda s, v: s + v).alias("weighted"),
    )


@query(
    "q41_wav_catalog",
    """select 'S' || (vec_id // 100) as station, 1704067200000000 + min(vec_id) * 8000000 as dataset_start_us,
       1704067200000000 + max(vec_id) * 8000000 + 8000000 as dataset_end_us, 8 as sampling_f,
       8000000::bigint as files_duration_us, 8000000::bigint as longest_us, count(*) as n_files, 0::bigint as n_other_fs
from embeddings group by 1""",
)
def wav_catalog(t: Tables) -> DataFrame:
    return seg.station_summary(wav.file_catalog(views.wave_files(t.embeddings)))


def wave_period(files: DataFrame) -> DataFrame:
    return seg.station_summary(wav.file_catalog(files)).select(
        "station", F.col("dataset_start_us").alias("start_us"), F.col("dataset_end_us").alias("end_us")
    )


def wave_segments(t: Tables) -> DataFrame:
    """20-second tiles of the WAV archive with their samples."""
    files = views.wave_files(t.embeddings)
    tiles = seg.tiles(wave_period(files), 20_000_000)
    return seg.segment_samples(tiles, wav.decode_chunks(files, chunk_s=3), 20_000_000)


SEGMENT_SQL = (
    PCM_SQL
    + """,
st as (select station, min(start_us) as s, max(start_us) + 8000000 as e from pcm group by station),
tl as (select station, s + k * 20000000 as b, k from (select station, s, unnest(range((e - s) // 20000000)) as k from st)),
cut as (
  select tl.station, tl.k, p.start_us, p.i, p.x,
         greatest(floor((tl.b - p.start_us) / 1e6 * 8)::bigint, 0) as head,
         greatest(floor((p.start_us + 8000000 - (tl.b + 20000000 - 10000)) / 1e6 * 8)::bigint, 0) as tail
  from tl join pcm p on p.station = tl.station and p.start_us < tl.b + 20000000 - 10000 and tl.b < p.start_us + 8000000),
taken as (
  select station, k, row_number() over (partition by station, k order by start_us, i) - 1 as i, x
  from cut where i >= head and i < 64 - tail)"""
)


@query(
    "q42_segment_samples",
    with_(SEGMENT_SQL)
    + "select station, k, count(*) as n, sum(x * (i + 1))::bigint as weighted from taken group by all",
)
def segment_samples(t: Tables) -> DataFrame:
    weighted = F.transform("samples", lambda x, i: x.cast("bigint") * (i + 1))
    return wave_segments(t).select(
        "station",
        "k",
        F.size("samples").cast("bigint").alias("n"),
        F.aggregate(weighted, F.lit(0).cast("bigint"), lambda s, v: s + v).alias("weighted"),
    )


@query(
    "q42_tile_samples",
    with_(SEGMENT_SQL)
    + "select station, k, count(*) as n, sum(x * (i + 1))::bigint as weighted from taken group by all",
)
def tile_samples(t: Tables) -> DataFrame:
    """The same tiles cut where the chunks are read, with one shuffle of the samples."""
    files = views.wave_files(t.embeddings)
    chunks = wav.decode_chunks(files, chunk_s=3)
    weighted = F.transform("samples", lambda x, i: x.cast("bigint") * (i + 1))
    return seg.tile_samples(wave_period(files), chunks, 20_000_000).select(
        "station",
        "k",
        F.size("samples").cast("bigint").alias("n"),
        F.aggregate(weighted, F.lit(0).cast("bigint"), lambda s, v: s + v).alias("weighted"),
    )


@query(
    "q43_segment_features",
    with_(
        SEGMENT_SQL,
        "sig as (select station || ':' || k as id, i, x::double as v from taken)",
        sql.wavelet_level("sig", "one"),
        sql.wavelet_level("one", "two"),
    )
    + """, m as (
  select id, avg(abs(v)) as s, 0 as level from two group by id union all select id, avg(abs(v)), 1 from two_d group by id)
select split_part(id, ':', 1) as station, split_part(id, ':', 2)::bigint as k, level, round(s / sum(s) over (partition by id), 6) as share from m""",
)
def segment_features(t: Tables) -> DataFrame:
    """Energy share of archive segments: catalog, cut across files, transform."""
    shares = wavelet.energy_share(wave_segments(t), 2)
    rows = unnest(shares, ["station", "k"], "share", "level", "s")
    return rows.select("station", "k", "level", F.round("s", 6).alias("share"))


@query(
    "q44_archive_frames",
    with_(PCM_SQL, "wave as (select vec_id as id, i, x::double as v from pcm)", sql.SPECTRUM)
    + """select 'S' || (id // 100) as station, 1704067200000000 + id * 8000000 + (1 + t_bin) * 1000000 as frame_us, f_bin::int as f_bin,
       f_bin * 0.5::double as f, round(v, 4) as v
from db""",
)
def archive_spectrogram(t: Tables) -> DataFrame:
    """Archive-wide spectrogram over chunks that begin off the grid of the frames."""
    chunks = wav.decode_chunks(views.wave_files(t.embeddings), chunk_s=2.5)
    frames = archive_frames(chunks, views.WAVE_FS, NPERSEG, 8)
    return frames.withColumn("v", F.round("v", 4))
