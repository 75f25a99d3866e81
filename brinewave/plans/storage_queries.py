"""Queries that write the given tables in a format, read them back and report what came back.

They write to new folders below ``spark.checkpoint.dir`` (or the session's own temporary
folder where none is set).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewave.functions.timing import SECOND_US, floor_div, format_stamp, parent_name
from brinewave.operators import training, wavelet
from brinewave.plans import evaluation, sql, views
from brinewave.plans.registry import Tables, query
from brinewave.plans.storage import new_folder
from brinewave.sources import ranges, sinks, tables, wav

with_ = sql.with_


#: kinds of files of the mixed archive; the last kind is an empty file
KINDS = [{}, {"bits": 8}, {"bits": 24}, {"bits": 32}, {"bits": 32, "tag": wav.FLOAT}, {"before": b"x" * 6001}]


def mixed_files(embeddings: DataFrame) -> DataFrame:
    """``(path, length, content)``: embeddings as files of all readable formats, some with long headers."""
    kind = F.pmod("vec_id", F.lit(len(KINDS) + 1)).cast("int")
    scaled = F.transform("embedding", lambda x: F.round(x.cast("double") * F.lit(10000.0)))
    stored = F.when(kind == 1, F.transform(scaled, lambda x: F.pmod(x, F.lit(256.0)))).when(
        kind == 4, F.transform(scaled, lambda x: x / F.lit(32768.0))
    ).otherwise(scaled)
    start = F.lit(views.WAVE_BASE_US) + F.col("vec_id") * F.lit(8 * SECOND_US)
    path = F.concat(F.lit("archive/S"), F.floor(F.col("vec_id") / 100).cast("string"), F.lit("/"), format_stamp(start), F.lit(".wav"))
    content = F.when(F.col("kind") < len(KINDS), wav.encoded("x", views.WAVE_FS, KINDS, F.least("kind", F.lit(len(KINDS) - 1)))).otherwise(F.lit(b""))
    rows = embeddings.select(path.alias("path"), stored.alias("x"), kind.alias("kind")).withColumn("content", content)
    return rows.select("path", F.octet_length("content").cast("bigint").alias("length"), "content")


MIXED_SQL = """raw as (
  select vec_id, vec_id % 7 as kind, 'S' || (vec_id // 100) as station, 1704067200000000 + vec_id * 8000000 as start_us,
         unnest(range(64)) as i, unnest(list_transform(embedding, lambda x: round(x::double * 10000)::bigint)) as x
  from embeddings),
mixed as (
  select station, start_us, kind, i, case kind when 1 then ((x % 256) + 256) % 256 when 2 then x * 256 when 4 then x / 32768.0::double else x end::double as x
  from raw where kind <> 6)"""


@query(
    "q47_wav_formats",
    with_(MIXED_SQL)
    + """select station, start_us as file_start_us, start_us + (i // 20) * 2500000 as chunk_us, 8 as fs,
       case kind when 1 then 8 when 2 then 24 when 3 then 32 when 4 then 32 else 16 end as bits, count(*) as n,
       sum(x * (i % 20 + 1)) as weighted from mixed group by all""",
)
def wav_formats(t: Tables) -> DataFrame:
    """Integer and float recordings of all widths, decoded into chunks."""
    chunks = wav.decode_chunks(mixed_files(t.embeddings), chunk_s=2.5)
    weighted = F.aggregate(F.transform("samples", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return chunks.select(
        "station", "file_start_us", "chunk_us", "fs", "bits", F.size("samples").cast("bigint").alias("n"), weighted.alias("weighted")
    )


@query(
    "q47_wav_headers",
    with_(MIXED_SQL)
    + """select station, count(distinct start_us) as n_files, count(*) as n_samples, min(start_us) as first_us,
       max(start_us) + 8000000 as end_us from mixed group by station""",
)
def wav_headers(t: Tables) -> DataFrame:
    """Catalog of the mixed archive: empty files left out, samples behind a long chunk found."""
    files = wav.file_catalog(mixed_files(t.embeddings))
    return files.groupBy("station").agg(
        F.count("*").alias("n_files"), F.sum("n_samples").alias("n_samples"), F.min("start_us").alias("first_us"), F.max("end_us").alias("end_us")
    )


#: names of station folders: blanks and characters that mean something in a URI
PLACES = ["A", "B c", "D%20e", "F#g"]
#: every so many vectors are one recording of a station; one recording in three is cut after its 1,000th sample
TOGETHER, CUT_AT = 50, 1000


def long_files(embeddings: DataFrame) -> DataFrame:
    """``(path, content)``: recordings of many vectors each, 16 bits at 8 Hz, below folders with odd names."""
    pcm = F.transform("embedding", lambda x: F.round(x.cast("double") * F.lit(10000.0)).cast("int"))
    number = F.floor(F.col("vec_id") / TOGETHER)
    joined = embeddings.groupBy(number.alias("f")).agg(F.array_sort(F.collect_list(F.struct("vec_id", pcm.alias("x")))).alias("l"))
    samples = F.flatten(F.transform("l", lambda p: p["x"]))
    start = F.lit(views.WAVE_BASE_US) + F.col("f") * F.lit(TOGETHER * 8 * SECOND_US)
    place = F.element_at(F.array(*map(F.lit, PLACES)), (F.col("f") % len(PLACES) + 1).cast("int"))
    path = F.concat(F.lit("net/"), place, F.lit("/"), format_stamp(start), F.lit(".wav"))
    content = wav.encoded("x", views.WAVE_FS)
    whole = joined.select(path.alias("path"), F.col("f"), samples.alias("x")).withColumn("content", content)
    kept = F.when(F.col("f") % 3 == 0, F.substring("content", 1, 44 + 2 * CUT_AT)).otherwise(F.col("content"))
    return whole.select("path", kept.alias("content"))


def long_archive(t: Tables) -> str:
    folder = new_folder(t.spark, "archive")
    sinks.write_files(long_files(t.embeddings), folder)
    return folder


LONG_SQL = f"""places as (select unnest([0, 1, 2, 3]) as k, unnest({PLACES}) as place),
samples as (
  select vec_id // {TOGETHER} as f, (row_number() over (partition by vec_id // {TOGETHER} order by vec_id, i)) - 1 as pos, x
  from (select vec_id, unnest(range(64)) as i, unnest(list_transform(embedding, lambda x: round(x::double * 10000)::bigint)) as x from embeddings)),
files as (
  select f, place, 1704067200000000 + f * {TOGETHER * 8 * SECOND_US} as start_us, count(*) as declared,
         case when f % 3 = 0 then least(count(*), {CUT_AT}) else count(*) end as held
  from samples join places on k = f % 4 group by f, place),
held as (select s.*, place, start_us from samples s join files using (f) where pos < held)"""


@query(
    "q52_wav_ranges",
    with_(LONG_SQL)
    + """select place as station, start_us as file_start_us, start_us + (pos // 160) * 20000000 as chunk_us, count(*) as n,
       sum(x * (pos % 160 + 1))::double as weighted from held group by all""",
)
def wav_ranges(t: Tables) -> DataFrame:
    """Recordings on disk, several byte ranges each, some of them cut, through the data source."""
    chunks = ranges.read_recordings(t.spark, long_archive(t), rangeBytes=1500, chunkSeconds=20)
    weighted = F.aggregate(F.transform("samples", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return chunks.select("station", "file_start_us", "chunk_us", F.size("samples").cast("bigint").alias("n"), weighted.alias("weighted"))


@query(
    "q52_wav_ranges_filtered",
    with_(LONG_SQL)
    + """, c as (select place, start_us + (pos // 160) * 20000000 as chunk_us, x from held)
select place as station, count(*) as n, sum(x)::double as total from c
where place in ('B c', 'F#g') and chunk_us >= 1704067260000000 and chunk_us < 1704071000000000 group by place""",
)
def wav_ranges_filtered(t: Tables) -> DataFrame:
    """Two stations and a stretch of time: other files and chunks are not read."""
    chunks = ranges.read_recordings(t.spark, long_archive(t), rangeBytes=1500, chunkSeconds=20)
    some = chunks.where(F.col("station").isin("B c", "F#g") & (F.col("chunk_us") >= 1704067260000000) & (F.col("chunk_us") < 1704071000000000))
    return some.groupBy("station").agg(
        F.sum(F.size("samples")).cast("bigint").alias("n"), F.sum(F.aggregate("samples", F.lit(0.0), lambda s, v: s + v)).alias("total")
    )


@query(
    "q52_wav_headers_by_path",
    with_(LONG_SQL)
    + """select place as station, count(*) as n_files, sum(held)::bigint as n_samples, max(start_us + held * 125000)::bigint as end_us,
       count(*) filter (held < declared) as n_cut, sum(declared - held)::bigint as n_missing from files group by place""",
)
def wav_headers_by_path(t: Tables) -> DataFrame:
    """Catalog of files opened by path, their payload unread; cut files count with what they hold."""
    files = wav.list_files(t.spark, long_archive(t)).select("path", "length")
    held = wav.file_catalog(files).groupBy("station").agg(
        F.count("*").alias("n_files"), F.sum("n_samples").alias("n_samples"), F.max("end_us").alias("end_us")
    )
    cut = wav.cut_files(files).groupBy(parent_name("path").alias("station")).agg(
        F.count("*").alias("n_cut"), F.sum(F.col("n_declared") - F.col("n_samples")).alias("n_missing")
    )
    return held.join(cut, "station", "left").na.fill(0)


@query("q52_stations", with_(LONG_SQL) + "select distinct place as station from files")
def stations(t: Tables) -> DataFrame:
    """Folders of an archive that hold recordings."""
    folder = long_archive(t)
    files = wav.list_files(t.spark, folder).select("path", "length")
    return wav.discover_stations(files, folder).select("station")


@query(
    "q48_annotation_lines",
    with_(sql.EV)
    + """select station::varchar as station, class, count(*) as n, sum(n_annotators)::bigint as votes, sum(at_us // 1000000)::bigint as seconds
from (select *, case event_type when 'view' then 'T' when 'click' then 'H' when 'error' then 'uncertain' else 'other' end as class
      from (select station, at_us, n_annotators, class as event_type from ev))
where class <> 'other' group by all""",
)
def annotation_lines(t: Tables) -> DataFrame:
    """Annotations written as lines of different widths, with blank lines between, and read back."""
    rows = views.annotations(t.events)
    kind = F.when(F.col("class") == "view", "T").when(F.col("class") == "click", "H").when(F.col("class") == "error", "uncertain").otherwise("other")
    votes = F.concat_ws(",", F.when(F.col("k") % 2 == 0, F.lit('"a, b"')), F.col("n_annotators").cast("string"))
    line = F.concat_ws(",", F.col("station").cast("string"), kind, format_stamp("at_us"), votes)
    lines = rows.select(F.explode(F.when(F.col("k") % 10 == 0, F.array(line, F.lit(""), F.lit("  "))).otherwise(F.array(line))).alias("value"))
    folder = new_folder(t.spark, "lines")
    lines.write.text(folder)
    return tables.read_test_annotations(t.spark, folder).groupBy("station", "class").agg(
        F.count("*").alias("n"), F.sum("n_annotators").alias("votes"), F.sum(floor_div("at_us", SECOND_US)).alias("seconds")
    )


@query(
    "q48_train_annotations",
    with_(sql.EV)
    + """select station::varchar as station, case when class = 'error' then 'negative' else 'positive' end as label, count(*) as n,
       sum(case when class = 'error' then (at_us // 1000000) * 1000000 + (event_id % 100) * 500000 else (at_us // 1000000) * 1000000 end)::bigint as total_us
from (select *, event_id from ev) where class in ('error', 'purchase') group by all""",
)
def train_annotations(t: Tables) -> DataFrame:
    """Annotations of the training layout, intervals included, written as lines and read back."""
    rows = views.annotations(t.events).where("class in ('error', 'purchase')")
    label = F.when(F.col("class") == "error", tables.TRAIN_NEGATIVE).otherwise(tables.TRAIN_POSITIVE)
    end = F.when(F.col("class") == "error", format_stamp(F.col("at_us") + F.col("event_id") % 100 * SECOND_US))
    folder = new_folder(t.spark, "train-lines")
    rows.select("station", label.alias("class"), format_stamp("at_us").alias("start"), end.alias("end")).write.csv(folder, header=True)
    found = tables.read_train_annotations(t.spark, folder)
    return found.groupBy("station", "label").agg(F.count("*").alias("n"), F.sum("at_us").alias("total_us"))


def config_lines(t: Tables, yaml: bool) -> DataFrame:
    """One file of named events, as JSON or as YAML, from the nations."""
    stamp = format_stamp(F.lit(views.WAVE_BASE_US) + F.col("n_nationkey") * F.lit(3600 * SECOND_US))
    fields = {
        "dataset": F.concat(F.lit("set "), F.col("n_regionkey").cast("string")),
        "station": F.col("n_regionkey").cast("string"),
        "segment_duration_s": (F.col("n_nationkey") * 10 + 10).cast("string"),
        "segment_center": stamp,
        "arrow_offset": F.col("n_nationkey").cast("string"),
    }
    if yaml:
        lines = (F.concat(F.lit(f'  {k}: "'), v, F.lit('"')) for k, v in fields.items())
        entry = F.concat_ws("\n", F.concat("n_name", F.lit(":  # an event")), *lines)
    else:
        entry = F.concat(F.lit('"'), "n_name", F.lit('": '), F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))))
    # nations are a fixed, short list
    listed = t.nation.agg(F.array_sort(F.collect_list(entry)).alias("l"))
    return listed.select((F.array_join("l", "\n") if yaml else F.concat(F.lit("{"), F.array_join("l", ", "), F.lit("}"))).alias("value"))


CONFIG_SQL = """select n_name as name, 'set ' || n_regionkey as dataset, n_regionkey::varchar as station, (n_nationkey * 10 + 10)::int as duration_s,
       (1704067200000000 + n_nationkey * 3600000000)::bigint as center_us, n_nationkey::int as arrow_offset from nation"""


def event_config(t: Tables, extension: str) -> DataFrame:
    name = f"events.{extension}"
    folder = new_folder(t.spark, "config")
    sinks.write_files(config_lines(t, extension == "yaml").select(F.lit(name).alias("path"), F.encode("value", "utf-8").alias("content")), folder)
    return tables.read_event_config(t.spark, f"{folder}/{name}")


@query("q48_event_config_json", CONFIG_SQL)
def event_config_json(t: Tables) -> DataFrame:
    """Named events of a JSON configuration file."""
    return event_config(t, "json")


@query("q48_event_config_yaml", CONFIG_SQL)
def event_config_yaml(t: Tables) -> DataFrame:
    """The same events of a YAML file with comments and quotes."""
    return event_config(t, "yaml")


@query(
    "q49_run_length_manifest",
    with_(sql.EV)
    + """select 'out/' || station || '/' || (at_us // 86400000000) as path, count(distinct at_us // 1000000 * 10 + n_annotators)::int as n_entries, count(*) as n_picks,
       sum((at_us // 1000000) % 86400)::double as offsets from ev group by station, at_us // 86400000000""",
)
def run_length_manifest(t: Tables) -> DataFrame:
    """Pick lists of whole days whose lines carry the number of copies, written and parsed."""
    rows = views.annotations(t.events)
    day, second = floor_div("at_us", 86_400 * SECOND_US), floor_div("at_us", SECOND_US) % 86_400
    picks = rows.groupBy("station", day.alias("day"), second.cast("double").alias("offset_s"), "n_annotators").agg(F.count("*").alias("copies"))
    listed = picks.groupBy("station", "day").agg(F.array_sort(F.collect_list(F.struct("offset_s", "n_annotators", "copies"))).alias("picks"))
    path = F.concat_ws("/", F.lit("out"), F.col("station").cast("string"), F.col("day").cast("string"))
    folder = new_folder(t.spark, "manifest")
    sinks.write_manifest_csv(listed.select(path.alias("path"), F.lit("positive").alias("label"), "picks"), folder, runs=True)
    back = tables.read_manifest(t.spark, folder, "test")
    copies = F.aggregate("picks", F.lit(0).cast("bigint"), lambda s, p: s + p["copies"])
    offsets = F.aggregate("picks", F.lit(0.0), lambda s, p: s + p["offset_s"] * p["copies"])
    return back.select("path", F.size("picks").alias("n_entries"), copies.alias("n_picks"), offsets.alias("offsets"))


@query(
    "q49_indexed_manifest",
    """select 'out/' || (case when label < 5 then 'positive' else 'negative' end) || 's/' || vec_id as path, vec_id as idx,
       case when label < 5 then 'positive' else 'negative' end as label, 2 as n_picks, (vec_id % 50 + vec_id % 30)::double as offsets
from embeddings""",
)
def indexed_manifest(t: Tables) -> DataFrame:
    """The indexed layout of a manifest, written and parsed."""
    label = F.when(F.col("label") < 5, "positive").otherwise("negative")
    pick = lambda m: F.struct((F.col("vec_id") % m).cast("double").alias("offset_s"), F.lit(1).alias("n_annotators"), F.lit(1).cast("bigint").alias("copies"))
    rows = t.embeddings.select("vec_id", label.alias("label"), F.array(pick(50), pick(30)).alias("picks"))
    path = F.concat(F.lit("out/"), F.col("label"), F.lit("s/"), F.col("vec_id").cast("string"))
    folder = new_folder(t.spark, "manifest")
    sinks.write_manifest_csv(rows.select(path.alias("path"), F.col("vec_id").alias("idx"), "label", "picks"), folder, indexed=True)
    offsets = F.aggregate("picks", F.lit(0.0), lambda s, p: s + p["offset_s"])
    back = tables.read_manifest(t.spark, folder, "indexed_test")
    return back.select("path", "idx", "label", F.size("picks").alias("n_picks"), offsets.alias("offsets"))


@query(
    "q49_feature_store",
    with_("wave as (select vec_id as id, unnest(range(64)) as i, unnest(embedding)::double as v from embeddings)", sql.wavelet_level("wave", "one"), sql.wavelet_level("one", "two"))
    + """, m as (select id, avg(abs(v)) as s, 0 as level from two group by id union all select id, avg(abs(v)), 1 from two_d group by id)
select id || '.wav' as file, 'S' || (id // 100) as folder, round(max(case when level = 0 then s end) / sum(s), 6) as share from m group by id""",
)
def feature_store(t: Tables) -> DataFrame:
    """Features stored in two runs, the second of which finds half of them done."""
    name = F.concat(F.lit("x/S"), F.floor(F.col("vec_id") / 100).cast("string"), F.lit("/"), F.col("vec_id").cast("string"), F.lit(".wav"))
    wanted = views.waves(t.embeddings).select(name.alias("path"), F.floor(F.col("vec_id") / 100).alias("station"), "samples")
    folder = new_folder(t.spark, "features")

    def compute(todo: DataFrame) -> DataFrame:
        return wavelet.energy_share(todo, 2).select("path", "station", "share")

    sinks.write_new_features(compute, wanted.where(F.crc32("path") % 2 == 0), folder, ["path"], ["station"])
    sinks.write_new_features(compute, wanted, folder, ["path"], ["station"])
    back = tables.feature_key(t.spark.read.parquet(folder))
    return back.select("file", "folder", F.round(F.get("share", 0), 6).alias("share"))


@query(
    "q49_results",
    """select 'm' || (label % 3) as model, count(*) as n, sum(vec_id)::bigint as total from embeddings where label % 2 = 0 group by all""",
)
def results(t: Tables) -> DataFrame:
    """Results stored twice under the same keys, and one data set of them read."""
    rows = t.embeddings.select(
        F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("model"),
        F.concat(F.lit("d"), (F.col("label") % 2).cast("string")).alias("dataset"),
        F.lit(1).alias("min_annot"),
        "vec_id",
    )
    folder = new_folder(t.spark, "results")
    for _ in range(2):
        sinks.write_results(rows, folder)
    found = tables.read_results(t.spark, folder, dataset="d0")
    return found.groupBy("model").agg(F.count("*").alias("n"), F.sum("vec_id").alias("total"))


@query(
    "q49_history",
    """select (vec_id % 5)::int as fold, vec_id // 5 as epoch, 'auc' as metric, round(embedding[1]::double, 6) as value from embeddings""",
)
def stored_history(t: Tables) -> DataFrame:
    rows = t.embeddings.select(
        (F.col("vec_id") % 5).cast("int").alias("fold"), floor_div("vec_id", 5).alias("epoch"), F.lit("auc").alias("metric"),
        F.round(F.get("embedding", 0).cast("double"), 6).alias("value"), "label",
    )
    folder = new_folder(t.spark, "history")
    rows.write.parquet(folder)
    return tables.read_history(t.spark, folder)


@query("q50_segmenter_eval")
def segmenter_eval(t: Tables) -> DataFrame:
    """Quorum, curves, peaks, matches and outcomes of a predictor in one job: the outcome totals."""
    label = F.when(F.col("label") < 5, "positive").otherwise("negative")
    pick = F.struct((F.lit(10.0) + F.col("vec_id") % 80).alias("offset_s"), (F.col("vec_id") % 3 + 1).cast("int").alias("n_annotators"), F.lit(1).cast("bigint").alias("copies"))
    none = F.array().cast("array<struct<offset_s:double,n_annotators:int,copies:bigint>>")
    rows = t.embeddings.select(
        F.col("vec_id").alias("seg_id"), label.alias("label"), F.when(F.col("label") < 5, F.array(pick)).otherwise(none).alias("picks"), "embedding"
    )
    found = evaluation.evaluate_segmenter(rows, F.col("embedding"), 64, min_annotators=2)
    return found["totals"]


def labelled_vectors(embeddings: DataFrame, features: Column) -> DataFrame:
    """``(seg_id, label, picks, share)`` of the vectors: positives carry one pick."""
    label = F.when(F.col("label") < 5, "positive").otherwise("negative")
    pick = F.struct(F.lit(1.0).alias("offset_s"), F.lit(1).alias("n_annotators"), F.lit(1).cast("bigint").alias("copies"))
    none = F.array().cast("array<struct<offset_s:double,n_annotators:int,copies:bigint>>")
    picks = F.when(F.col("label") < 5, F.array(pick)).otherwise(none)
    return embeddings.select(F.col("vec_id").alias("seg_id"), label.alias("label"), picks.alias("picks"), features.alias("share"))


def held_out_results(rows: DataFrame, trees: int, rate: float, depth: int) -> DataFrame:
    """Fit on four fifths of the segments, evaluate on the others: area and outcome counts in one row."""
    seen = rows.where(F.col("seg_id") % 5 != 0).withColumn("y", F.when(F.col("label") == "positive", 1).otherwise(0))
    model = training.fit_trees(seen, "share", "y", "seg_id", trees, rate, depth)
    found = evaluation.evaluate_classifier(rows.where(F.col("seg_id") % 5 == 0), model)
    count = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    outcomes = found["confusion"].agg(*(count(o).alias(f"n_{o.lower()}") for o in ("TP", "FP", "FN")))
    # one row each, put side by side by an aggregation
    both = found["auc"].withColumn("auc", F.round("auc", 6)).unionByName(outcomes, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


@query(
    "q51_classifier_eval",
    """with f as (
  select vec_id, (label < 5)::int as y, unnest([0, 1]) as feature,
         unnest([round(embedding[1]::double * 8), round((embedding[2]::double - embedding[1]::double) * 6)]) as x from embeddings),
train as (select * from f where vec_id % 5 <> 0),
prior as (select avg(y)::double as p, count(*) as n from train where feature = 0),
bins as (select feature, x, count(*) as n, sum(y) as pos from train group by feature, x),
cuts as (
  select feature, x, sum(n) over w as n_left, sum(pos) over w as pos_left, sum(n) over (partition by feature) as n_all, sum(pos) over (partition by feature) as pos_all
  from bins window w as (partition by feature order by x)),
gains as (
  select feature, x, n_left, pos_left, n_all, pos_all,
         pow(n_left * p - pos_left, 2) / (n_left * p * (1 - p)) + pow((n_all - n_left) * p - (pos_all - pos_left), 2) / ((n_all - n_left) * p * (1 - p)) as gain, p
  from cuts, prior where n_left >= 20 and n_all - n_left >= 20),
best as (select * from gains order by gain desc, feature, x limit 1),
scored as (
  select f.y, 1 / (1 + exp(-(ln(p / (1 - p)) + 0.5 * case when f.x <= best.x then (pos_left - n_left * p) / (n_left * p * (1 - p))
         else (pos_all - pos_left - (n_all - n_left) * p) / ((n_all - n_left) * p * (1 - p)) end))) as score
  from f join best on best.feature = f.feature where f.vec_id % 5 = 0)
select round((select sum(case when a.score > b.score then 1 when a.score = b.score then 0.5 else 0 end) from scored a, scored b where a.y = 1 and b.y = 0)
         / (sum(y) * sum(1 - y))::double, 6) as auc,
       sum(y)::bigint as n_pos, sum(1 - y)::bigint as n_neg,
       count(*) filter (y = 1 and score > 0.5) as n_tp, count(*) filter (y = 0 and score > 0.5) as n_fp, count(*) filter (y = 1 and score <= 0.5) as n_fn
from scored""",
)
def classifier_eval(t: Tables) -> DataFrame:
    """The smallest model, one split, fitted on four fifths of the vectors and evaluated on the others."""
    first, second = F.get("embedding", 0).cast("double"), F.get("embedding", 1).cast("double")
    features = F.array(F.round(first * 8), F.round((second - first) * 6))
    return held_out_results(labelled_vectors(t.embeddings, features), 1, 0.5, 1)


@query("q51_tuned_eval")
def tuned_eval(t: Tables) -> DataFrame:
    """The tuned model on whole vectors, fitted on four fifths of them and evaluated on the others."""
    rows = labelled_vectors(t.embeddings, F.col("embedding"))
    return held_out_results(rows, training.TUNED_TREES, training.TUNED_RATE, training.DEPTH)
