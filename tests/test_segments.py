import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from brinewave.functions import timing
from brinewave.operators import ordered, rangejoin, segments as seg

S = 1_000_000


def us(text):
    return int(datetime.strptime(text, "%Y%m%d_%H%M%S").replace(tzinfo=timezone.utc).timestamp()) * S


def test_stamps_round_trip(spark):
    df = spark.createDataFrame([("20200607_034350",), ("nonsense",)], "s string")
    got = df.select(timing.to_us(timing.parse_stamp("s")).alias("u")).collect()
    assert [r.u for r in got] == [us("20200607_034350"), None]
    back = spark.createDataFrame([(us("20200607_034350"),)], "u bigint").select(timing.format_stamp("u"))
    assert back.first()[0] == "20200607_034350"


def test_offsets_half_to_even(spark):
    values = [250_000, 350_000, -250_000, -350_000, 149_999, 150_001, 0, -1]
    df = spark.createDataFrame([(v,) for v in values], "u bigint")
    got = [r[0] for r in df.select(timing.offset_tenths("u")).collect()]
    assert got == [2, 4, -2, -4, 1, 2, 0, 0]


def test_nearest_second(spark):
    df = spark.createDataFrame([(1_500_000,), (1_500_001,), (1_499_999,)], "u bigint")
    assert [r[0] for r in df.select(timing.nearest_second("u")).collect()] == [S, 2 * S, S]


def test_tiles_have_no_partial_tail(spark):
    st = spark.createDataFrame([("A", 0, 350 * S), ("B", 10, 10 + 99 * S)], "station string, start_us bigint, end_us bigint")
    rows = seg.tiles(st, 100 * S).orderBy("k").collect()
    assert [(r.station, r.k, r.seg_start_us) for r in rows] == [("A", k, k * 100 * S) for k in range(3)]


def test_more_tiles_than_a_block(spark):
    n = seg.TILE_BLOCK * 2 + 5
    st = spark.createDataFrame([("A", 0, n * 10)], "station string, start_us bigint, end_us bigint")
    got = seg.tiles(st, 10)
    assert got.count() == n and got.select("k").distinct().count() == n


def test_tile_of_an_event_is_right_closed(spark):
    st = spark.createDataFrame([("A", 1000 * S, 1300 * S)], "station string, start_us bigint, end_us bigint")
    times = {900: 0, 1000: 0, 1001: 0, 1100: 0, 1101: 1, 1200: 1, 1300: 2, 1301: None}
    ev = spark.createDataFrame([("A", t * S, 2) for t in times], "station string, at_us bigint, n_annotators int")
    got = {r.at_us // S: r.k for r in seg.assign_tiles(ev, st, 100 * S).collect()}
    assert got == {t: k for t, k in times.items() if k is not None}


def test_positive_tiles_are_never_broadcast(spark):
    """Tiles are exploded: their estimated size is that of the stations, so a broadcast would hold all of them."""
    st = spark.createDataFrame([(i, 0, 4000 * S) for i in range(3)], "station bigint, start_us bigint, end_us bigint")
    ev = spark.createDataFrame([(1, 150 * S, 2), (2, 3999 * S, 1)], "station bigint, at_us bigint, n_annotators int")
    positive = seg.label_tiles(seg.tiles(st, 100 * S), seg.assign_tiles(ev, st, 100 * S)).where("label = 'positive'")
    assert [(r.station, r.k) for r in positive.orderBy("station").collect()] == [(1, 1), (2, 39)]
    positive.collect()
    whole = positive._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [station" in whole
    top = whole[: whole.index("Generate explode")]
    assert "BroadcastHashJoin" not in top and "BroadcastExchange" not in top


def test_labels_collapse_equal_picks(spark):
    st = spark.createDataFrame([("A", 0, 200 * S)], "station string, start_us bigint, end_us bigint")
    ev = spark.createDataFrame(
        [("A", 60 * S, 2), ("A", 60 * S, 2), ("A", 60 * S, 1), ("A", 10 * S, 3)],
        "station string, at_us bigint, n_annotators int",
    )
    rows = seg.label_tiles(seg.tiles(st, 100 * S), seg.assign_tiles(ev, st, 100 * S)).orderBy("k").collect()
    assert [(r.label, r.n_picks) for r in rows] == [("positive", 4), ("negative", 0)]
    assert [(p.offset_s, p.n_annotators, p.copies) for p in rows[0].picks] == [(-40.0, 3, 1), (10.0, 1, 1), (10.0, 2, 2)]
    assert rows[1].picks == []


def test_number_and_next_equals_a_plain_window(spark):
    rng = random.Random(1)
    rows = sorted({(rng.choice("AAAB"), rng.randrange(-500, 5000)) for _ in range(400)})
    df = spark.createDataFrame(rows, "station string, at bigint").repartition(3)
    numbered = ordered.number_and_next(df, ["station"], "at", span_us=37).collect()
    got = {(r.station, r["at"]): (r.ordinal, r.next_us) for r in numbered}
    for st in "AB":
        mine = [a for s, a in rows if s == st]
        for pos, a in enumerate(mine):
            assert got[(st, a)] == (pos, mine[pos + 1] if pos + 1 < len(mine) else None)


def test_shuffled_rank_is_a_permutation_and_repeatable(spark):
    df = spark.range(500).withColumn("g", (F.col("id") % 7 == 0).cast("int"))
    a = {r.id: r["rank"] for r in ordered.shuffled_rank(df, ["g"], "id", 4, hex_digits=1).collect()}
    b = {r.id: r["rank"] for r in ordered.shuffled_rank(df.repartition(7), ["g"], "id", 4, hex_digits=2).collect()}
    assert a == b
    assert sorted(a[i] for i in range(500) if i % 7 == 0) == list(range(72))


@pytest.mark.parametrize("width", [3, 10, 1000])
def test_overlaps_once_whatever_the_cell(spark, width):
    rng = random.Random(2)
    left = [(rng.choice("AB"), a, a + rng.randrange(1, 60), i) for i in range(60) for a in [rng.randrange(300)]]
    right = [(rng.choice("AB"), a, a + rng.randrange(1, 60), i) for i in range(60) for a in [rng.randrange(300)]]
    dl = spark.createDataFrame(left, "station string, a bigint, b bigint, l int")
    dr = spark.createDataFrame(right, "station string, c bigint, d bigint, r int")
    got = sorted((r.l, r.r) for r in rangejoin.overlaps(dl, dr, ["station"], ("a", "b"), ("c", "d"), width).collect())
    want = sorted((x[3], y[3]) for x in left for y in right if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    assert got == want


def test_locate_in_file_on_border_and_in_gap(spark):
    files = spark.createDataFrame(
        [("A", 0, 100, 100, 0), ("A", 100, 200, 300, 1), ("A", 300, 400, None, 2)],
        "station string, start_us bigint, end_us bigint, next_us bigint, ordinal int",
    )
    times = [-1, 0, 50, 100, 200, 250, 300, 400, 401]
    pts = spark.createDataFrame([("A", t) for t in times], "station string, at_us bigint")
    got = {r.at_us: r.position for r in seg.locate(pts, files, 64).collect()}
    assert got == {-1: None, 0: 0.0, 50: 0.5, 100: 1.0, 200: 2.0, 250: None, 300: 2.0, 400: 3.0, 401: None}


def test_anchor_context_is_within_the_window(spark):
    rng = random.Random(9)
    rows = [("A", i, rng.randrange(0, 2000) * S) for i in range(120)]
    ev = spark.createDataFrame(rows, "station string, event_id int, at_us bigint")
    anchors = seg.anchored_segments(ev, 50 * S)
    got = seg.anchor_context(anchors, ev, 50 * S).collect()
    centers = {r.event_id: r.center_us for r in anchors.collect()}
    for _, i, at in rows:
        assert abs(centers[i] - at) <= 0.95 * 50 * S
        want = sum(1 for _, _, o in rows if abs(o - centers[i]) <= 50 * S)
        mine = [r for r in got if r.event_id == i]
        assert sum(r.copies for r in mine) == want
        assert any(r.side == 0 for r in mine)


def test_picks_equal_those_of_the_long_form(spark):
    """The list of a training segment against its rows, with ties, copies and offsets on the half."""
    from brinewave.plans.dataset_build import training_segments

    rng = random.Random(10)
    rows = [("A" if i % 3 else "B", i, rng.randrange(0, 4000) * 50_000, "positive") for i in range(300)]
    ev = spark.createDataFrame(rows + [("A", 900, 5, "negative")], "station string, event_id int, at_us bigint, label string")
    positives = ev.where("label = 'positive'")
    segments = training_segments(ev, 20 * S)
    got = {r.event_id: [(p.offset_s, p.copies) for p in r.picks] for r in segments.collect()}
    long = {}
    for r in seg.anchor_context(seg.anchored_segments(positives, 20 * S), positives, 20 * S).collect():
        merged = long.setdefault(r.event_id, {})
        gap, n = merged.get((r.side, r.offset_s), (r.gap_us, 0))
        merged[r.side, r.offset_s] = (min(gap, r.gap_us), n + r.copies)
    assert got.pop(900) == []
    assert got == {e: [(o, n) for _, _, o, n in sorted((s, g, o, n) for (s, o), (g, n) in m.items())] for e, m in long.items()}


def test_neighbours_form_no_pairs(spark):
    ev = spark.createDataFrame([("A", i, i * S) for i in range(50)], "station string, event_id int, at_us bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = seg.neighbour_lists(seg.anchored_segments(ev, 5 * S), ev, 5 * S)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") <= 2 and "NestedLoop" not in plan
    assert found.count() == 50  # a row for each anchor


def test_no_shift_with_multiplier_zero(spark):
    ev = spark.createDataFrame([("A", 1, 77 * S)], "station string, event_id int, at_us bigint")
    assert seg.anchored_segments(ev, 50 * S, multiplier=0.0).first().center_us == 77 * S


def test_coverage_tolerates_epsilon(spark):
    summary = spark.createDataFrame([("A", 1000 * S, 2000 * S)], "station string, dataset_start_us bigint, dataset_end_us bigint")
    asked = spark.createDataFrame(
        [("A", 1000 * S - 10_000, 1100 * S), ("A", 1000 * S - 10_001, 1100 * S), ("A", 1900 * S, 2000 * S + 20_000),
         ("A", 1900 * S, 2000 * S + 20_001), ("B", 0, S)],
        "station string, seg_start_us bigint, seg_end_us bigint",
    )
    got = [r.reason for r in seg.check_coverage(asked, summary).orderBy("station", "seg_start_us", "seg_end_us").collect()]
    assert got == ["before the first file", None, None, "after the last file", "unknown station"]


def test_station_summary_counts_other_rates(spark):
    files = spark.createDataFrame(
        [("A", 0, 50, 240), ("A", 50, 150, 240), ("A", 150, 180, 250), ("B", 5, 6, 100)],
        "station string, start_us bigint, end_us bigint, fs int",
    )
    r = seg.station_summary(files).where("station = 'A'").first()
    assert (r.dataset_start_us, r.dataset_end_us, r.sampling_f, r.files_duration_us) == (0, 180, 240, 50)
    assert (r.longest_us, r.n_files, r.n_other_fs) == (100, 3, 1)
