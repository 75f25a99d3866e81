"""Queries on stations, tiles, labels and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewave.functions.curves import objective_curve
from brinewave.functions.picks import all_counts_equal, label_number, quorum, relabel
from brinewave.functions.timing import (
    DAY_US,
    HOUR_US,
    around,
    format_stamp,
    nearest_second,
    parent_name,
    parse_stamp,
    seconds,
    stem,
    to_us,
)
from brinewave.operators import segments as seg
from brinewave.operators.compare import union_datasets
from brinewave.operators.folds import seeded_sample
from brinewave.operators.rangejoin import points_in_intervals
from brinewave.plans import dataset_build, sql, views
from brinewave.plans.registry import Tables, query
from brinewave.sources.tables import choose_events, manifest_line, parse_manifest

with_ = sql.with_


def placed_annotations(t: Tables) -> DataFrame:
    marks = views.annotations(t.events).where(F.col("class").isin(views.ANNOTATION_CLASSES))
    return seg.assign_tiles(marks, views.stations(t.events), views.TILE_US)


def labelled_tiles(t: Tables) -> DataFrame:
    tiles = seg.tiles(views.stations(t.events), views.TILE_US)
    return seg.label_tiles(tiles, placed_annotations(t))


@query(
    "q01_station_catalog",
    with_(sql.EV, sql.FILES, sql.SUMMARY)
    + """select s.*, (select count(*) from files f where f.station = s.station and f.fs <> s.sampling_f) as n_other_fs,
       round((dataset_end_us - dataset_start_us) / 1e6, 3) as period_s from summary s""",
)
def station_catalog(t: Tables) -> DataFrame:
    period = F.round(seconds(F.col("dataset_end_us") - F.col("dataset_start_us")), 3)
    return seg.station_summary(views.files(t.events)).withColumn("period_s", period)


@query(
    "q02_tiles",
    with_(sql.STATIONS, sql.TILES)
    + f"select station, k, seg_start_us, seg_end_us, {sql.stamp('center_us')} as center from tiles",
)
def tile_list(t: Tables) -> DataFrame:
    tiles = seg.tiles(views.stations(t.events), views.TILE_US)
    return tiles.select(
        "station", "k", "seg_start_us", "seg_end_us", format_stamp("center_us").alias("center")
    )


@query(
    "q03_tile_labels",
    with_(sql.EV, sql.STATIONS, sql.TILES, sql.PLACED)
    + """select t.station, t.k, coalesce(n, 0) as n_picks,
       case when n > 0 then 'positive' else 'negative' end as label, first_offset, last_offset
from tiles t left join (
  select station, tile as k, count(*) as n, min(tenths) / 10.0::double as first_offset,
         max(tenths) / 10.0::double as last_offset from placed group by 1, 2) p using (station, k)""",
)
def tile_labels(t: Tables) -> DataFrame:
    return labelled_tiles(t).select(
        "station",
        "k",
        "n_picks",
        "label",
        F.get("picks", F.lit(0))["offset_s"].alias("first_offset"),
        F.try_element_at("picks", F.lit(-1))["offset_s"].alias("last_offset"),
    )


@query(
    "q03_class_counts",
    with_(sql.EV, sql.STATIONS, sql.TILES, sql.PLACED)
    + """select case when p.k is null then 'negative' else 'positive' end as label, count(*) as n
from tiles t left join (select distinct station, tile as k from placed) p using (station, k) group by 1""",
)
def class_counts(t: Tables) -> DataFrame:
    return labelled_tiles(t).groupBy("label").agg(F.count("*").alias("n"))


@query(
    "q04_anchor_context",
    with_(sql.EV)
    + """, a as (
  select *, at_us + trunc(((('0x' || substr(md5('0:' || event_id), 1, 8))::bigint / 4294967296.0::double) - 0.5::double)
                          * (1.9::double * 21600000000))::bigint as center_us
  from ev where class = 'purchase'),
p as (select station, at_us as event_us, count(*) as copies from ev where class = 'purchase' group by all),
c as (
  select a.station, a.event_id, a.center_us, p.event_us - a.at_us as gap, copies,
         p.event_us - a.center_us as o, floor((p.event_us - a.center_us) / 1e5)::bigint as q
  from a join p on a.station = p.station and abs(p.event_us - a.center_us) <= 21600000000)
select station, event_id, center_us, case when gap = 0 then 0 when gap < 0 then 1 else 2 end as side,
       abs(gap) as gap_us,
       (case when o - q * 100000 > 50000 or (o - q * 100000 = 50000 and q % 2 <> 0) then q + 1 else q end) / 10.0::double as offset_s,
       copies
from c""",
)
def anchor_context(t: Tables) -> DataFrame:
    positives = views.annotations(t.events).where("class = 'purchase'")
    anchors = seg.anchored_segments(positives, 6 * HOUR_US)
    return seg.anchor_context(anchors, positives, 6 * HOUR_US)


@query(
    "q05_segment_file_overlap",
    with_(sql.EV, sql.FILES, sql.STATIONS, sql.TILES)
    + """, pairs as (
  select t.station, t.k, f.n_samples,
         greatest(floor((t.seg_start_us - f.start_us) / 3.6e9 * f.fs)::bigint, 0) as head,
         greatest(floor((f.end_us - (t.seg_end_us - 10000)) / 3.6e9 * f.fs)::bigint, 0) as tail
  from tiles t join files f on t.station = f.station
    and t.seg_start_us < f.end_us and f.start_us < t.seg_end_us - 10000),
got as (
  select station, k, count(*) as n_pieces, sum(n_samples - head - tail) as n_samples
  from pairs where n_samples - head - tail > 0 group by all)
select t.station, t.k, coalesce(n_pieces, 0)::bigint as n_pieces, coalesce(n_samples, 0)::bigint as n_samples,
       round(coalesce(n_samples, 0) / 360.0::double, 6) as coverage, coalesce(n_samples, 0) = 0 as is_empty
from tiles t left join got g using (station, k)""",
)
def segment_file_overlap(t: Tables) -> DataFrame:
    tiles = seg.tiles(views.stations(t.events), views.TILE_US)
    pieces = seg.file_pieces(views.files(t.events))
    counted = seg.count_samples(tiles, pieces, views.TILE_US, HOUR_US)
    return counted.select(
        "station",
        "k",
        "n_pieces",
        "n_samples",
        F.round(F.col("n_samples") / F.lit(360.0), 6).alias("coverage"),
        (F.col("n_samples") == 0).alias("is_empty"),
    )


@query(
    "q06_file_lookup",
    with_(sql.EV, sql.FILES)
    + """, p as (select event_id, station, at_us from ev where class = 'error'),
x as (
  select p.*, f.ordinal, f.start_us, f.end_us, f.next_us
  from p asof left join files f on p.station = f.station and p.at_us >= f.start_us)
select event_id, station,
       case when at_us <= end_us and at_us < next_us
            then round(ordinal + (at_us - start_us)::double / (end_us - start_us), 6) end as position,
       not coalesce(at_us <= end_us and at_us < next_us, false) as in_gap
from x""",
)
def file_lookup(t: Tables) -> DataFrame:
    points = views.annotations(t.events).where("class = 'error'").select("event_id", "station", "at_us")
    found = seg.locate(points, views.files(t.events), DAY_US)
    return found.select(
        "event_id", "station", F.round("position", 6).alias("position"), "in_gap"
    )


@query(
    "q07_coverage_reject",
    with_(sql.EV, sql.FILES, sql.SUMMARY)
    + """, r as (
  select event_id, station, (at_us // 1000000 + (at_us % 1000000 > 500000)::int) * 1000000 as center_us
  from ev where class = 'signup'),
c as (
  select r.*, case when s.station is null then 'unknown station'
    when center_us - 10800000000 < dataset_start_us - 10000 then 'before the first file'
    when center_us + 10800000000 - 10000 > dataset_end_us + 10000 then 'after the last file' end as reason
  from r left join summary s using (station))
select event_id, station, center_us, reason from c where reason is not null""",
)
def coverage_reject(t: Tables) -> DataFrame:
    asked = views.annotations(t.events).where("class = 'signup'").select(
        "event_id", "station", nearest_second("at_us").alias("center_us")
    )
    start, end = around("center_us", 6 * HOUR_US)
    asked = asked.withColumn("seg_start_us", start).withColumn("seg_end_us", end)
    checked = seg.check_coverage(asked, seg.station_summary(views.files(t.events)))
    return checked.where("reason IS NOT NULL").select("event_id", "station", "center_us", "reason")


@query(
    "q08_quorum",
    with_(sql.EV, sql.STATIONS, sql.TILES, sql.PLACED, sql.PICKS)
    + """, g as (
  select station, k, count(*) filter (n_annotators >= 2) as n_kept,
         string_agg(offset_s::varchar, ',' order by offset_s, n_annotators) filter (n_annotators >= 2) as kept,
         bool_and(n_annotators = 1) as all_single
  from picks group by all)
select t.station, t.k, coalesce(n_kept, 0)::bigint as n_kept, coalesce(kept, '') as kept,
       case when coalesce(n_kept, 0) = 0 then 'negative' else 'positive' end as label,
       coalesce(all_single, true) as all_single
from tiles t left join g using (station, k)""",
)
def annotator_quorum(t: Tables) -> DataFrame:
    rows = labelled_tiles(t)
    offsets = quorum(F.col("label"), F.col("picks"), 2)
    return rows.withColumn("offsets", offsets).select(
        "station",
        "k",
        F.size("offsets").cast("bigint").alias("n_kept"),
        F.array_join(F.col("offsets").cast("array<string>"), ",").alias("kept"),
        relabel(F.col("label"), F.col("offsets")).alias("label"),
        all_counts_equal(F.col("picks"), 1).alias("all_single"),
    )


@query(
    "q09_manifest_parse",
    with_(sql.EV, sql.STATIONS, sql.TILES, sql.PLACED)
    + f"""select 'out/' || case when p.n > 0 then 'positives/' else 'negatives/' end || t.station || '/' || {sql.stamp('t.center_us')} || '.png' as path,
       t.station::varchar as station, t.center_us // 1000000 as center_s, (coalesce(p.n, 0) > 0)::int as label,
       coalesce(p.n, 0)::bigint as n_picks, coalesce(p.tenths, 0)::bigint as sum_tenths, coalesce(p.counts, 0)::bigint as sum_counts
from tiles t left join (
  select station, tile as k, count(*) as n, sum(tenths) as tenths, sum(n_annotators) as counts
  from placed group by all) p using (station, k)""",
)
def manifest_parse(t: Tables) -> DataFrame:
    rows = labelled_tiles(t)
    path = seg.manifest_path("out", "label", "station", "center_us", "png")
    lines = rows.select(manifest_line(path, F.col("label"), F.col("picks")).alias("value"))
    parsed = parse_manifest(lines, "test")
    zero = F.lit(0).cast("bigint")
    return parsed.select(
        "path",
        parent_name("path").alias("station"),
        F.floor(to_us(parse_stamp(stem("path"))) / 1e6).alias("center_s"),
        label_number("label").alias("label"),
        F.size("picks").cast("bigint").alias("n_picks"),
        F.aggregate("picks", zero, lambda a, p: a + F.round(p["offset_s"] * 10).cast("bigint")).alias("sum_tenths"),
        F.aggregate("picks", zero, lambda a, p: a + p["n_annotators"]).alias("sum_counts"),
    )


@query(
    "q10_objective_curve",
    with_(sql.EV, sql.STATIONS, sql.PLACED, sql.PICKS)
    + """, c as (
  select station, k, i, greatest(0, (3.0::double - min(abs(i - (10800 + offset_s) / 600.0::double))) / 3.0::double) as y
  from picks, (select unnest(range(36)) as i) group by all)
select station, k, round(sum(y), 6) as total, round(max(y), 6) as top, count(*) filter (y > 0) as n_active from c group by all""",
)
def objective_curves(t: Tables) -> DataFrame:
    positives = labelled_tiles(t).where("label = 'positive'")
    offsets = F.transform("picks", lambda p: p["offset_s"])
    curved = positives.withColumn("y", objective_curve(offsets, 36, 21600.0, 1800.0))
    return curved.select(
        "station",
        "k",
        F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v), 6).alias("total"),
        F.round(F.array_max("y"), 6).alias("top"),
        F.size(F.filter("y", lambda v: v > 0)).cast("bigint").alias("n_active"),
    )


@query(
    "q24_union_examples",
    with_(sql.EV, sql.STATIONS, sql.TILES, sql.PLACED, sql.PICKS)
    + f"""select case when station % 2 = 0 then 'even' else 'odd' end as dataset, station, k, {sql.stamp('max(center_us)')} as center, count(*) as n_offsets
from tiles join picks using (station, k) group by station, k having bool_and(n_annotators = 1)
order by md5('5:' || station || '/' || k), station || '/' || k limit 9""",
)
def union_examples(t: Tables) -> DataFrame:
    """Nine positive tiles of two data sets whose picks were all made by one annotator."""
    rows = labelled_tiles(t).where("label = 'positive'")
    both = union_datasets({"even": rows.where("station % 2 = 0"), "odd": rows.where("station % 2 = 1")})
    single = both.where(all_counts_equal(F.col("picks"), 1)).select(
        "dataset",
        "station",
        "k",
        format_stamp("center_us").alias("center"),
        F.size("picks").cast("bigint").alias("n_offsets"),
        F.concat_ws("/", F.col("station").cast("string"), F.col("k").cast("string")).alias("id"),
    )
    return seeded_sample(single, "id", 9, seed=5).drop("id")


@query(
    "q46_training_manifest",
    with_(sql.EV)
    + f""", a as (
  select *, at_us + trunc(((('0x' || substr(md5('0:' || event_id), 1, 8))::bigint / 4294967296.0::double) - 0.5::double)
                          * (1.9::double * 21600000000))::bigint as center_us
  from ev where class = 'purchase'),
c as (
  select a.event_id, p.at_us - a.at_us as gap, p.at_us - a.center_us as o, floor((p.at_us - a.center_us) / 1e5)::bigint as q
  from a join ev p on p.class = 'purchase' and a.station = p.station and abs(p.at_us - a.center_us) <= 21600000000),
l as (
  select event_id, case when gap = 0 then 0 when gap < 0 then 1 else 2 end as side, min(abs(gap)) as gap,
         (case when o - q * 100000 > 50000 or (o - q * 100000 = 50000 and q % 2 <> 0) then q + 1 else q end) / 10.0::double as offset_s
  from c group by all),
g as (select event_id, string_agg(offset_s::varchar, ',' order by side, gap, offset_s) as picks from l group by event_id)
select a.event_id, 'out/positives/' || a.station || '/' || {sql.stamp('a.at_us')} || '.png,positive,' || g.picks as line,
       a.center_us - 21600000000 as seg_start_us
from a join g using (event_id)
union all
select event_id, 'out/negatives/' || station || '/' || {sql.stamp('at_us')} || '.png,negative', at_us - 21600000000
from ev where class = 'signup'""",
)
def training_manifest(t: Tables) -> DataFrame:
    """Manifest lines of shifted windows around purchases and of plain windows around signups."""
    label = F.when(F.col("class") == "purchase", "positive").otherwise("negative")
    marks = views.annotations(t.events).where("class in ('purchase', 'signup')").withColumn("label", label)
    segments = dataset_build.training_segments(marks, 6 * HOUR_US)
    rows = dataset_build.training_manifest(segments, "out", "png")
    line = manifest_line(F.col("path"), F.col("label"), F.col("picks"), counted=False)
    return rows.select("event_id", line.alias("line"), "seg_start_us")


@query(
    "q37_incremental_build",
    with_(sql.EV, sql.STATIONS, sql.TILES)
    + f""", done as (
  select distinct e.station, greatest(ceil((e.at_us - s.start_us) / 2.16e10)::bigint - 1, 0) as k
  from ev e join stations s using (station) where e.class = 'view')
select t.station, t.k, 'out/tiles/' || t.station || '/' || {sql.stamp('t.center_us')} || '.parquet' as path
from tiles t anti join done d using (station, k)""",
)
def incremental_build(t: Tables) -> DataFrame:
    """Tiles whose features are not stored yet; those with a ``view`` count as stored."""
    known = views.stations(t.events)
    tiles = seg.tiles(known, views.TILE_US)
    stored = seg.assign_tiles(
        views.annotations(t.events.where("event_type = 'view'")), known, views.TILE_US
    )
    todo = seg.missing_only(tiles, stored, ["station", "k"])
    path = F.concat(
        F.lit("out/tiles/"), F.col("station").cast("string"), F.lit("/"), format_stamp("center_us"), F.lit(".parquet")
    )
    return todo.select("station", "k", path.alias("path"))


CHOSEN = ["NATION_4", "NATION_1", "NATION_12", "NATION_7", "NATION_3", "NATION_14"]


@query(
    "q39_event_config",
    with_(sql.EV)
    + """, picked as (
  select list_position(['NATION_4', 'NATION_1', 'NATION_12', 'NATION_7', 'NATION_3', 'NATION_14'], n_name) as pos,
         n_name as name, r_name as dataset, n_nationkey as station,
         1704067200000000 + (n_nationkey + 5) * 86400000000 as center_us
  from nation join region on n_regionkey = r_regionkey
  where n_name in ('NATION_4', 'NATION_1', 'NATION_12', 'NATION_7', 'NATION_3', 'NATION_14'))
select pos::bigint as pos, name, dataset, p.station::bigint as station, center_us, count(e.event_id) as n_events,
       min(e.at_us) as first_us
from picked p left join ev e on e.station = p.station
  and e.at_us >= center_us - 432000000000 and e.at_us <= center_us + 432000000000
group by all""",
)
def event_config(t: Tables) -> DataFrame:
    """Chosen named events, their data set and station, and what falls into their window."""
    region = t.region.select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("dataset"))
    named = t.nation.join(region, "n_regionkey").select(
        F.col("n_name").alias("name"),
        "dataset",
        F.col("n_nationkey").cast("bigint").alias("station"),
        (F.lit(views.WAVE_BASE_US) + (F.col("n_nationkey") + 5) * F.lit(DAY_US)).alias("center_us"),
    )
    chosen = choose_events(named, CHOSEN)
    start, end = around("center_us", 10 * DAY_US)
    windows = chosen.withColumn("lo", start).withColumn("hi", end)
    marks = views.annotations(t.events).select("event_id", "station", "at_us")
    inside = points_in_intervals(
        marks, windows, ["station"], "at_us", "lo", "hi", 10 * DAY_US, closed_right=True
    )
    found = inside.groupBy("name").agg(
        F.count("event_id").alias("n_events"), F.min("at_us").alias("first_us")
    )
    return (
        chosen.join(found, "name", "left")
        .na.fill(0, ["n_events"])
        .select("pos", "name", "dataset", "station", "center_us", "n_events", "first_us")
    )
