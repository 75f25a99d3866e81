"""Queries on peaks, matches, scores, folds and model comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewave.functions.curves import find_peaks, peak_seconds, unnest
from brinewave.functions.timing import HOUR_US, seconds
from brinewave.operators import compare, folds, history, matching, scoring
from brinewave.plans import sql, views
from brinewave.plans.registry import Tables, query
from brinewave.plans.storage import new_folder
from brinewave.sources import sinks
from brinewave.sources.tables import join_features

with_ = sql.with_
SEGMENT = ["station", "day"]
TOLERANCE_US = 3 * HOUR_US

PEAKS_SQL = (
    sql.WAVE
    + """,
runs as (
  select *, sum(case when v is distinct from pv then 1 else 0 end) over (partition by id order by i) as g
  from (select *, lag(v) over (partition by id order by i) as pv from wave)),
tops as (select id, g, min(i) as a, max(i) as b, any_value(v) as v from runs group by id, g),
peaks as (
  select id, (a + b) // 2 as i, v as h
  from (select *, lag(v) over w as pv, lead(v) over w as nv from tops window w as (partition by id order by g))
  where v > pv and v > nv and v >= 0.05)"""
)


@query(
    "q11_peaks",
    with_(PEAKS_SQL)
    + "select id as vec_id, i::int as i, round(h, 6) as height, round(i * (100 / 64.0::double), 6) as pos_s from peaks",
)
def peaks(t: Tables) -> DataFrame:
    waves = views.waves(t.embeddings)
    found = unnest(waves.withColumn("l", find_peaks("samples", 0.05)), ["vec_id"], "l", "_n", "p")
    return found.select(
        "vec_id",
        F.col("p.i").alias("i"),
        F.round("p.h", 6).alias("height"),
        F.round(F.col("p.i") * F.lit(100 / 64), 6).alias("pos_s"),
    )


@query(
    "q12_peaks_nms",
    with_(PEAKS_SQL)
    + """, kept as (
  select id, list_reduce(list([{'i': i, 'h': h}] order by h desc, i desc),
    lambda acc, x: case when len(list_filter(acc, lambda k: abs(k.i - x[1].i) < 6)) > 0 then acc else list_concat(acc, x) end,
    []::struct(i bigint, h double)[]) as l
  from peaks group by id)
select id as vec_id, u.i::int as i, round(u.h, 6) as height from (select id, unnest(l) as u from kept)""",
)
def peaks_apart(t: Tables) -> DataFrame:
    waves = views.waves(t.embeddings)
    kept = peak_seconds(find_peaks("samples", 0.05, 6), 1.0)
    found = unnest(waves.withColumn("l", kept), ["vec_id"], "l", "_n", "p")
    return found.select("vec_id", F.col("p.pos_s").cast("int").alias("i"), F.round("p.h", 6).alias("height"))


def daily(t: Tables, name: str) -> DataFrame:
    marks = views.by_day(views.annotations(t.events).where(F.col("class") == name))
    return marks.select("station", "day", F.col("at_us").alias("pos"), "height", "n_annotators")


def matched_peaks(t: Tables) -> DataFrame:
    return matching.nearest_truth(daily(t, "error"), daily(t, "purchase"), SEGMENT, TOLERANCE_US)


@query(
    "q13_peak_match",
    with_(sql.EV, sql.MATCHED)
    + "select station, day, truth, pos, round(height, 6) as height, pos - truth as residual, n_hits from tp",
)
def peak_match(t: Tables) -> DataFrame:
    tp = matching.true_peaks(matched_peaks(t), SEGMENT)
    return tp.withColumn("height", F.round("height", 6))


@query(
    "q13_peak_scores",
    with_(sql.EV, sql.MATCHED)
    + """select d.station, d.day, count(*) as n_detections, coalesce(max(h.n), 0)::bigint as n_true,
       count(*) - coalesce(max(h.n), 0)::bigint as n_false
from d left join (select station, day, count(*) as n from tp group by all) h using (station, day) group by all""",
)
def peak_scores(t: Tables) -> DataFrame:
    return matching.peak_scores(matched_peaks(t), SEGMENT)


@query(
    "q13_detection_counts",
    with_(sql.EV)
    + "select count(*) filter (class = 'error') as n_detections, count(*) filter (class = 'purchase') as n_truths from ev",
)
def detection_counts(t: Tables) -> DataFrame:
    return scoring.detection_counts(daily(t, "error"), daily(t, "purchase"))


def outcomes(t: Tables) -> DataFrame:
    days = views.by_day(views.annotations(t.events))
    return matching.segment_outcomes(days, daily(t, "purchase"), daily(t, "error"), SEGMENT)


@query(
    "q14_segment_outcomes",
    with_(sql.EV, sql.OUTCOMES)
    + """select station, day, truth, round(score, 6) as score,
       case when truth = 1 then case when score is null then 'FN' else 'TP' end
            else case when score is null then 'TN' else 'FP' end end as outcome
from outcomes""",
)
def segment_outcomes(t: Tables) -> DataFrame:
    return outcomes(t).withColumn("score", F.round("score", 6))


@query(
    "q14_outcome_totals",
    with_(sql.EV, sql.OUTCOMES)
    + """select sum(truth)::bigint as p, sum(1 - truth)::bigint as n,
       count(*) filter (truth = 1 and score is not null) as tp, count(*) filter (truth = 1 and score is null) as fn,
       count(*) filter (truth = 0 and score is not null) as fp, count(*) filter (truth = 0 and score is null) as tn
from outcomes""",
)
def outcome_totals(t: Tables) -> DataFrame:
    return matching.outcome_totals(outcomes(t))


ROC_SQL = """select thr::int as thr, tp, fp, round(tp / p::double, 9) as tpr, round(fp / n::double, 9) as fpr from (
  select thr, count(*) filter (truth = 1 and score > thr * 0.001::double) as tp,
         count(*) filter (truth = 0 and score > thr * 0.001::double) as fp, sum(truth) as p, sum(1 - truth) as n
  from outcomes, (select unnest(range(1001)) as thr) group by thr)"""


@query("q15_roc", with_(sql.EV, sql.OUTCOMES) + ROC_SQL)
def roc(t: Tables) -> DataFrame:
    points = scoring.roc_points(outcomes(t))
    return points.withColumn("tpr", F.round("tpr", 9)).withColumn("fpr", F.round("fpr", 9))


def scored_documents(t: Tables, full: float) -> DataFrame:
    docs = t.documents.select("doc_id", "lang", "source", "n_chars")
    p = F.least(F.col("n_chars") / F.lit(full), F.lit(1.0))
    return t.labels.join(docs, "doc_id").withColumn("score", p)


@query(
    "q16_auc_exact",
    """with s as (
  select least(n_chars / 20000.0::double, 1.0::double) as s, quality as y from labels join documents using (doc_id)),
g as (select s, sum(y) as p, sum(1 - y) as n from s group by s),
b as (select *, coalesce(sum(n) over (order by s rows between unbounded preceding and 1 preceding), 0) as below from g)
select round(sum(p * (below + n / 2.0::double)) / (sum(p) * sum(n)), 9) as auc, sum(p)::bigint as n_pos, sum(n)::bigint as n_neg from b""",
)
def auc_exact(t: Tables) -> DataFrame:
    scored = scored_documents(t, 20000.0)
    return scoring.auc_exact(scored, "score", "quality").withColumn("auc", F.round("auc", 9))


@query(
    "q17_auc_bucketed",
    """with s as (
  select least(n_chars / 20000.0::double, 1.0::double) as s, quality as y, 1 + toxic as w from labels join documents using (doc_id)),
thr as (select i, case when i = 0 then -1e-7 when i = 199 then 1 + 1e-7 else i / 199.0::double end as x from range(200) r(i)),
c as (
  select i, sum(w) filter (y = 1 and s > x) / (select sum(w) from s where y = 1) as tpr,
         sum(w) filter (y = 0 and s > x) / (select sum(w) from s where y = 0) as fpr
  from s, thr group by i),
z as (select i, coalesce(tpr, 0) as tpr, coalesce(fpr, 0) as fpr from c)
select round(sum((a.fpr - b.fpr) * (a.tpr + b.tpr) / 2), 9) as auc from z a join z b on b.i = a.i + 1""",
)
def auc_bucketed(t: Tables) -> DataFrame:
    weighted = scored_documents(t, 20000.0).withColumn("w", (1 + F.col("toxic")).cast("double"))
    counts = scoring.auc_counts(weighted, "score", "quality", "w")
    return scoring.auc_from_counts(counts).withColumn("auc", F.round("auc", 9))


@query(
    "q18_residual_hist",
    with_(sql.EV, sql.MATCHED)
    + """, bins as (select i as bin, i * 1200.0::double - 10800 as center from range(19) r(i)),
near_bin as (
  select t.pos, t.truth, t.station, b.bin, abs((t.pos - t.truth) / 1e6 - center) as dist,
         row_number() over (partition by t.station, t.day, t.truth order by abs((t.pos - t.truth) / 1e6 - center), bin) as r
  from tp t, bins b),
c as (select bin, count(*) as n from near_bin where r = 1 and dist <= 1200 group by bin)
select b.bin::int as bin, b.center as residual, coalesce(n, 0)::bigint as n,
       round(coalesce(n, 0) / (select count(*) from tp)::double, 9) as share
from bins b left join c using (bin)""",
)
def residual_hist(t: Tables) -> DataFrame:
    tp = matching.true_peaks(matched_peaks(t), SEGMENT).withColumn("residual", seconds("residual"))
    return scoring.residual_histogram(tp, 10800.0, 1200.0).withColumn("share", F.round("share", 9))


@query(
    "q19_accuracy_bce",
    with_(sql.WAVE)
    + """, c as (
  select id, i, case when i % 2 = 0 then quality else 0 end as y, least(greatest(v + 0.5, 0), 1) as raw
  from wave join labels on doc_id = id),
l as (
  select id, -sum(y * ln(p) + (1 - y) * ln(1 - p)) as loss, count(*) as n, max(y) as my, max(raw) as mp
  from (select *, least(greatest(raw, 1e-7), 1 - 1e-7) as p from c) group by id)
select round(sum(loss) / sum(n), 9) as loss, round(avg((round_even(my, 0) = round_even(mp, 0))::int), 9) as accuracy,
       count(*) as n_segments
from l""",
)
def accuracy_and_loss(t: Tables) -> DataFrame:
    labels = t.labels.select(F.col("doc_id").alias("vec_id"), "quality")
    y = F.transform("samples", lambda _, i: F.when(i % 2 == 0, F.col("quality")).otherwise(0).cast("double"))
    p = F.transform("samples", lambda x: F.least(F.greatest(x + 0.5, F.lit(0.0)), F.lit(1.0)))
    both = views.waves(t.embeddings).join(labels, "vec_id").withColumn("y", y).withColumn("p", p)
    scores = scoring.curve_scores(both, "y", "p")
    return scores.withColumn("loss", F.round("loss", 9)).withColumn("accuracy", F.round("accuracy", 9))


@query(
    "q20_confusion_ids",
    """with s as (select doc_id, quality as y, least(n_chars / 4000.0::double, 1.0::double) as p from labels join documents using (doc_id))
select doc_id, case when p > 0.5 then case when y = 1 then 'TP' else 'FP' end else 'FN' end as outcome
from s where p > 0.5 or y = 1""",
)
def confusion_ids(t: Tables) -> DataFrame:
    named = scoring.confusion(scored_documents(t, 4000.0), "score", "quality")
    return named.where("outcome <> 'TN'").select("doc_id", "outcome")


@query(
    "q21_missed_by_all",
    """with s as (select doc_id, lang, source, n_chars, quality, toxic, ('0x' || substr(md5('7:' || doc_id), 1, 8))::bigint / 4294967296.0::double as h
  from labels join documents using (doc_id)),
r as (
  select doc_id, lang, quality, 'segmenter' as kind, 'wide' as model, least(n_chars / 4000.0::double, 1) as score from s where n_chars % 7 <> 0
  union all select doc_id, lang, quality, 'segmenter', 'narrow', least(n_chars / 3000.0::double, 1) from s
  union all select doc_id, lang, quality, 'classifier', 'trees20', h from s
  union all select doc_id, lang, quality, 'classifier', 'trees100', h * 0.9::double + toxic * 0.05::double from s
  union all select doc_id, lang, quality, 'classifier', 'image', h * h from s),
m as (select distinct lang, doc_id, model from r where quality = 1 and case when kind = 'segmenter' then score < 0.5 else score <= 0.5 end)
select d.lang as dataset, d.doc_id, d.source, d.n_chars
from (select lang, doc_id from m group by all having count(*) = 5) k join documents d using (doc_id)""",
)
def missed_by_all(t: Tables) -> DataFrame:
    """Good documents that five scoring rules all miss, with their manifest row."""
    from brinewave.functions.hashing import hash01

    h = hash01(7, "doc_id")
    rules = [
        ("wide", "segmenter", F.when(F.col("n_chars") % 7 != 0, F.least(F.col("n_chars") / F.lit(4000.0), F.lit(1.0)))),
        ("narrow", "segmenter", F.least(F.col("n_chars") / F.lit(3000.0), F.lit(1.0))),
        ("trees20", "classifier", h),
        ("trees100", "classifier", h * F.lit(0.9) + F.col("toxic") * F.lit(0.05)),
        ("image", "classifier", h * h),
    ]
    each = F.array(
        *[F.struct(F.lit(m).alias("model"), F.lit(k).alias("kind"), s.alias("score")) for m, k, s in rules]
    )
    docs = t.documents.select("doc_id", "lang", "source", "n_chars")
    results = (
        t.labels.join(docs, "doc_id")
        .select("doc_id", "lang", "quality", F.explode(each).alias("r"))
        .select(
            "r.*",
            F.col("lang").alias("dataset"),
            F.col("doc_id").alias("seg_id"),
            F.col("quality").alias("truth"),
        )
    )
    lost = compare.missed_by_all(results, len(rules)).withColumnRenamed("seg_id", "doc_id")
    return lost.join(docs.drop("lang"), "doc_id").select("dataset", "doc_id", "source", "n_chars")


FOLDS_SQL = """ranked as (
  select doc_id, quality, row_number() over (partition by quality order by md5('0:' || doc_id), doc_id) - 1 as rank,
         (select sum(quality) from labels) as n_pos from labels),
f as (select *, case when rank < n_pos then (select max(i) from range(5) r(i) where floor(n_pos * i / 5) <= rank)::int end as fold from ranked)"""


@query("q22_folds", f"with {FOLDS_SQL} select doc_id, quality, rank::bigint as rank, fold from f")
def fold_table(t: Tables) -> DataFrame:
    return folds.assign_folds(t.labels.select("doc_id", "quality"), "doc_id", "quality").select(
        "doc_id", "quality", "rank", "fold"
    )


@query(
    "q22_fold_sizes",
    f"""with {FOLDS_SQL}
select i::int as part, quality, count(*) filter (fold = i) as n_valid, count(*) filter (fold is null or fold <> i) as n_train
from f, range(5) r(i) group by all""",
)
def fold_sizes(t: Tables) -> DataFrame:
    rows = folds.assign_folds(t.labels.select("doc_id", "quality"), "doc_id", "quality")
    return folds.fold_sizes(rows, "quality")


@query(
    "q22_pooled_folds",
    f"""with {FOLDS_SQL},
pool as (select doc_id, quality, (rank < n_pos)::int as pooled from f),
again as (
  select *, row_number() over (partition by pooled order by md5('1:' || doc_id), doc_id) - 1 as pool_rank,
         (select count(*) from pool where pooled = 1) as n from pool)
select doc_id, quality, pooled, case when pooled = 1 then (select max(i) from range(5) r(i) where floor(n * i / 5) <= pool_rank)::int end as fold from again""",
)
def pooled_folds(t: Tables) -> DataFrame:
    rows = folds.assign_pooled_folds(t.labels.select("doc_id", "quality"), "doc_id", "quality")
    return rows.select("doc_id", "quality", "pooled", "fold")


def training_history(t: Tables) -> DataFrame:
    """Mean value per user group (fold), day (epoch) and event type (metric)."""
    name = (
        F.when(F.col("class") == "error", "val_auc")
        .when(F.col("class") == "click", "val_auc_2")
        .otherwise(F.concat(F.lit("loss_"), F.col("class")))
    )
    days = views.by_day(views.annotations(t.events))
    return days.groupBy(
        (F.col("station") % 5).alias("fold"), F.col("day").alias("epoch"), name.alias("metric")
    ).agg(F.avg("height").alias("value"))


HISTORY_SQL = """hist as (
  select station % 5 as fold, at_us // 86400000000 as epoch, class, avg(height) as value from ev
  where class in ('error', 'click') group by all),
chosen as (select fold, epoch, arg_max(value, case class when 'click' then 2 else 1 end) as value from hist group by all),
curve as (select epoch, avg(value) as v from chosen group by epoch)"""


@query("q23_epoch_curve", with_(sql.EV, HISTORY_SQL) + "select epoch, round(v, 9) as mean_value from curve")
def epoch_curve(t: Tables) -> DataFrame:
    curve = history.epoch_curve(training_history(t), "val_auc")
    return curve.withColumn("mean_value", F.round("mean_value", 9))


@query(
    "q23_best_epoch",
    with_(sql.EV, HISTORY_SQL) + "select epoch, round(v, 9) as mean_value from curve order by v desc, epoch limit 1",
)
def best_epoch(t: Tables) -> DataFrame:
    best = history.best_epoch(history.epoch_curve(training_history(t), "val_auc"))
    return best.withColumn("mean_value", F.round("mean_value", 9))


@query(
    "q24_sample",
    "select doc_id, lang, n_chars from documents order by md5('5:' || doc_id), doc_id limit 9",
)
def sample_nine(t: Tables) -> DataFrame:
    return folds.seeded_sample(t.documents.select("doc_id", "lang", "n_chars"), "doc_id", 9, seed=5)


COMPARED = ["errors", "clicks"]


def compared_outcomes(t: Tables) -> DataFrame:
    """Outcomes of two detectors on two data sets under two quorums, in one table."""
    days = views.by_day(views.annotations(t.events)).withColumn(
        "dataset", (F.col("station") % 2).cast("int")
    )
    models = F.explode(F.array(*[F.lit(m) for m in COMPARED]))
    quorums = F.explode(F.array(F.lit(1), F.lit(3)))
    every = days.withColumn("model", models).withColumn("min_annot", quorums)
    keys = ["model", "dataset", "min_annot", *SEGMENT]
    truths = every.where((F.col("class") == "purchase") & (F.col("n_annotators") >= F.col("min_annot")))
    found = every.where(
        ((F.col("model") == "errors") & (F.col("class") == "error"))
        | ((F.col("model") == "clicks") & (F.col("class") == "click"))
    )
    return matching.segment_outcomes(every, truths, found, keys)


@query(
    "q36_model_compare",
    with_(sql.EV)
    + """, runs as (select * from (values ('errors', 'error'), ('clicks', 'click')) m(model, cls), (values (1), (3)) q(min_annot)),
o as (
  select model, station % 2 as dataset, min_annot, station, at_us // 86400000000 as day,
         max((class = 'purchase' and n_annotators >= min_annot)::int) as truth,
         max(case when class = cls then height end) as score
  from ev, runs group by all),
c as (
  select dataset, min_annot, thr, model,
         count(*) filter (truth = 1 and score > thr * 0.01::double) / nullif(sum(truth), 0)::double as tpr
  from o, (select unnest(range(101)) as thr) group by all)
select dataset::int as dataset, min_annot, thr::int as thr, round(max(tpr) filter (model = 'errors'), 9) as errors,
       round(max(tpr) filter (model = 'clicks'), 9) as clicks
from c group by dataset, min_annot, thr""",
)
def model_compare(t: Tables) -> DataFrame:
    points = scoring.roc_points(
        compared_outcomes(t), by=["model", "dataset", "min_annot"], delta=0.01, steps=100
    )
    report = compare.roc_report(points, COMPARED)
    return report.withColumn("errors", F.round("errors", 9)).withColumn("clicks", F.round("clicks", 9))


#: buckets of the stored features, about 128 MB each on the tables at hand
FEATURE_BUCKETS = 8


@query(
    "q38_feature_store_join",
    """select e.vec_id, l.quality as y, 's' || (e.vec_id % 7) || '.npy' as file, round(list_sum(list_transform(e.embedding, lambda x: x::double)), 6) as total
from embeddings e join labels l on l.doc_id = e.vec_id""",
)
def feature_store_join(t: Tables) -> DataFrame:
    """Vectors stored in buckets of (label, file, index), joined to a manifest without moving them."""
    named = F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label")
    file = lambda c: F.concat(F.lit("s"), (F.col(c) % 7).cast("string"), F.lit(".npy")).alias("file")
    manifest = t.labels.select(named, file("doc_id"), F.col("doc_id").alias("idx"), F.col("quality").alias("y"))
    known = t.labels.select(F.col("doc_id").alias("vec_id"), named)
    vectors = views.waves(t.embeddings).join(known, "vec_id", "left").select("label", file("vec_id"), F.col("vec_id").alias("idx"), "samples")
    folder = new_folder(t.spark, "features")
    features = sinks.write_buckets(vectors, f"features_{folder[-32:]}", folder, ["label", "file", "idx"], FEATURE_BUCKETS)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return join_features(manifest, features).select(F.col("idx").alias("vec_id"), "y", "file", F.round(total, 6).alias("total"))
