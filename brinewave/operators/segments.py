"""Stations, tiles, labels, coverage and sample lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewave.functions.hashing import center_shift_us
from brinewave.functions.timing import (
    DAY_US,
    EPSILON_US,
    SECOND_US,
    around,
    ceil_div,
    floor_div,
    format_stamp,
    one_decimal,
)
from brinewave.operators.rangejoin import overlaps, points_in_intervals

TILE_BLOCK = 4096


def station_summary(files: DataFrame) -> DataFrame:
    """One row per station from ``files(station, start_us, end_us, fs)``.

    The sampling frequency and the duration of a station are taken from its
    first (and last) file; files that disagree are counted.
    """
    length = F.col("end_us") - F.col("start_us")
    # (station, fs) first: one station's files are reduced before they meet
    by_fs = files.groupBy("station", "fs").agg(
        F.min(F.struct("start_us", length.alias("d"))).alias("first"),
        F.max(F.struct("start_us", length.alias("d"), "end_us")).alias("last"),
        F.max(length).alias("longest_us"),
        F.count("*").alias("n"),
    )
    # a handful of rows per station from here on
    order = Window.partitionBy("station").orderBy("first")
    marked = by_fs.withColumn("sampling_f", F.first_value("fs").over(order))
    return marked.groupBy("station").agg(
        F.min("first.start_us").alias("dataset_start_us"),
        F.max("last").getField("end_us").alias("dataset_end_us"),
        F.first("sampling_f").alias("sampling_f"),
        F.greatest(F.min("first").getField("d"), F.max("last").getField("d")).alias("files_duration_us"),
        F.max("longest_us").alias("longest_us"),
        F.sum("n").alias("n_files"),
        F.sum(F.when(F.col("fs") != F.col("sampling_f"), F.col("n")).otherwise(0)).alias("n_other_fs"),
    )


def tiles(stations: DataFrame, width_us: int) -> DataFrame:
    """All whole tiles of a station's period, counted from its start; no partial tail."""
    n = F.floor((F.col("end_us") - F.col("start_us")) / F.lit(float(width_us))).cast("bigint")
    # blocks first, so that one row never carries a year of tiles as an array
    blocks = stations.withColumn("_n", n).where("_n > 0").withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(TILE_BLOCK).cast("bigint")))
    )
    last = F.least(F.col("_block") + TILE_BLOCK, F.col("_n")) - 1
    begin = F.col("start_us") + F.col("k") * width_us
    return blocks.withColumn("k", F.explode(F.sequence(F.col("_block"), last))).select(
        "station",
        "k",
        begin.alias("seg_start_us"),
        (begin + width_us).alias("seg_end_us"),
        (begin + width_us // 2).alias("center_us"),
    )


def assign_tiles(events: DataFrame, stations: DataFrame, width_us: int) -> DataFrame:
    """Tile of each event. Tiles are closed on the right; earlier events go to tile 0."""
    n = F.floor((F.col("end_us") - F.col("start_us")) / F.lit(float(width_us))).cast("bigint")
    place = F.greatest(ceil_div(F.col("at_us") - F.col("start_us"), width_us) - 1, F.lit(0))
    return (
        events.join(stations.select("station", "start_us", "end_us"), "station")
        .withColumn("k", place)
        .where(F.col("k") < n)
        .withColumn("offset_us", F.col("at_us") - (F.col("start_us") + F.col("k") * width_us + width_us // 2))
        .drop("start_us", "end_us")
    )


def pick_counts(placed: DataFrame) -> DataFrame:
    """Equal picks of a tile collapsed: (station, k, offset_s, n_annotators, copies)."""
    return placed.groupBy(
        "station", "k", one_decimal("offset_us").alias("offset_s"), "n_annotators"
    ).agg(F.count("*").alias("copies"))


def label_tiles(tile_rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Tiles with their pick list and label.

    Picks are collapsed before they are listed, which bounds a list by the
    tenths of a second in a tile however many annotations fall into it.
    """
    lists = pick_counts(placed).groupBy("station", "k").agg(
        F.array_sort(F.collect_list(F.struct("offset_s", "n_annotators", "copies"))).alias("picks"),
        F.sum("copies").alias("n_picks"),
    )
    # tiles come out of an explode, whose size Spark takes for that of the stations: where the join
    # becomes an inner one (positive tiles only), it would broadcast all of them
    joined = tile_rows.hint("merge").join(lists, ["station", "k"], "left")
    empty = F.array().cast("array<struct<offset_s:double,n_annotators:int,copies:bigint>>")
    return (
        joined.withColumn("picks", F.coalesce("picks", empty))
        .withColumn("n_picks", F.coalesce("n_picks", F.lit(0)))
        .withColumn("label", F.when(F.col("n_picks") > 0, "positive").otherwise("negative"))
    )


def anchored_segments(
    events: DataFrame, half_us: int, multiplier: float = 1.0, seed: int = 0
) -> DataFrame:
    """One randomly shifted window per event (``station, event_id, at_us``)."""
    shift = center_shift_us(seed, half_us, multiplier, "event_id")
    return events.withColumn("center_us", F.col("at_us") + shift).select(
        "station",
        "event_id",
        "at_us",
        "center_us",
        (F.col("center_us") - half_us).alias("seg_start_us"),
        (F.col("center_us") + half_us).alias("seg_end_us"),
    )


def neighbour_lists(anchors: DataFrame, events: DataFrame, half_us: int) -> DataFrame:
    """``anchors`` with ``near``: the event times of the station within the half width of the center.

    ``near`` is ordered ARRAY<STRUCT<event_us, copies>>, null where there is none; events at
    one time are one entry. Time is cut into cells of one window. A cell is one row that
    lists its events and those up to half a window beyond its borders, so an anchor meets
    one row and no pairs are formed; a cell with many anchors is a skewed join, which Spark
    splits. A list is as long as its window has distinct times.
    """
    width = 2 * half_us
    times = events.groupBy("station", F.col("at_us").alias("event_us")).agg(F.count("*").alias("copies"))
    touched = F.sequence(floor_div(F.col("event_us") - half_us, width), floor_div(F.col("event_us") + half_us, width))
    cells = times.withColumn("_cell", F.explode(touched)).groupBy("station", "_cell").agg(
        F.array_sort(F.collect_list(F.struct("event_us", "copies"))).alias("_times")
    )
    met = anchors.withColumn("_cell", floor_div("center_us", width)).join(cells, ["station", "_cell"], "left")
    inside = F.filter("_times", lambda t: F.abs(t["event_us"] - F.col("center_us")) <= half_us)
    return met.withColumn("near", inside).drop("_cell", "_times")


def anchor_context(anchors: DataFrame, events: DataFrame, half_us: int) -> DataFrame:
    """``neighbour_lists`` in long form, a row for each event time.

    ``side`` is 0 for the anchor's own time, 1 for earlier and 2 for later events, which
    with ``gap_us`` gives the order of the pick list.
    """
    near = neighbour_lists(anchors, events, half_us).select("station", "event_id", "at_us", "center_us", F.explode("near").alias("n"))
    gap = F.col("n.event_us") - F.col("at_us")
    return near.select(
        "station",
        "event_id",
        "center_us",
        F.when(gap == 0, 0).when(gap < 0, 1).otherwise(2).alias("side"),
        F.abs(gap).alias("gap_us"),
        one_decimal(F.col("n.event_us") - F.col("center_us")).alias("offset_s"),
        F.col("n.copies").alias("copies"),
    )


def requested_segments(events: DataFrame) -> DataFrame:
    """Windows of named events: ``duration_s`` around their center."""
    start, end = around("center_us", F.col("duration_s") * SECOND_US)
    return events.withColumn("seg_start_us", start).withColumn("seg_end_us", end)


def check_coverage(segments: DataFrame, summary: DataFrame) -> DataFrame:
    """Segments with the reason for which they cannot be served (null when they can)."""
    bounds = summary.select("station", "dataset_start_us", "dataset_end_us")
    early = F.col("seg_start_us") < F.col("dataset_start_us") - EPSILON_US
    # a request ends EPSILON before its nominal end, and may overrun by EPSILON
    late = F.col("seg_end_us") - EPSILON_US > F.col("dataset_end_us") + EPSILON_US
    reason = (
        F.when(F.col("dataset_start_us").isNull(), "unknown station")
        .when(early, "before the first file")
        .when(late, "after the last file")
    )
    return segments.join(bounds, "station", "left").withColumn("reason", reason).drop(
        "dataset_start_us", "dataset_end_us"
    )


def locate(points: DataFrame, numbered_files: DataFrame, width_us: int) -> DataFrame:
    """File number plus elapsed fraction of each point; null inside a gap.

    ``numbered_files(station, start_us, end_us, next_us, ordinal)``. A file is
    responsible up to the start of the next one, so a point has one candidate.
    """
    reach = numbered_files.select(
        "station",
        F.col("start_us").alias("f_start"),
        F.col("end_us").alias("f_end"),
        F.col("ordinal").alias("f_no"),
        F.coalesce("next_us", F.col("end_us") + 1).alias("f_reach"),
    )
    found = points_in_intervals(
        points, reach, ["station"], "at_us", "f_start", "f_reach", width_us, how="left"
    )
    inside = F.col("at_us") <= F.col("f_end")
    fraction = F.coalesce(
        F.try_divide(F.col("at_us") - F.col("f_start"), F.col("f_end") - F.col("f_start")), F.lit(0.0)
    )
    return (
        found.withColumn("position", F.when(inside, F.col("f_no") + fraction))
        .withColumn("in_gap", F.col("position").isNull())
        .drop("f_start", "f_end", "f_no", "f_reach")
    )


def _whole_samples(span_us: Column, fs: Column, unit_us: int) -> Column:
    """Samples in a span, truncated, never negative."""
    return F.greatest(F.floor(span_us / F.lit(float(unit_us)) * fs).cast("bigint"), F.lit(0))


def sample_pieces(
    segments: DataFrame, pieces: DataFrame, width_us: int, unit_us: int = SECOND_US
) -> DataFrame:
    """Segment x piece rows with the range of samples each piece delivers.

    ``pieces`` are files or chunks of files (see ``file_pieces``); ``fs`` counts
    samples per ``unit_us``. Head and tail are cut per *file*, then intersected
    with the piece, so the chunk length never changes a result. The request ends
    EPSILON early, which keeps the sample on the right border out.
    """
    asked = segments.withColumn("_hi", F.col("seg_end_us") - EPSILON_US)
    pairs = overlaps(
        asked, pieces, ["station"], ("seg_start_us", "_hi"), ("start_us", "end_us"), width_us
    )
    return _cut(pairs, unit_us)


def _cut(pairs: DataFrame, unit_us: int) -> DataFrame:
    """Samples a piece delivers between ``seg_start_us`` and ``_hi``; pairs without any are dropped."""
    head = _whole_samples(F.col("seg_start_us") - F.col("file_start_us"), F.col("fs"), unit_us)
    tail = _whole_samples(F.col("file_end_us") - F.col("_hi"), F.col("fs"), unit_us)
    begin = F.greatest(head, F.col("first_sample"))
    stop = F.least(F.col("file_samples") - tail, F.col("first_sample") + F.col("n_samples"))
    return (
        pairs.withColumn("skip", begin - F.col("first_sample"))
        .withColumn("n_taken", stop - begin)
        .where("n_taken > 0")
        .drop("_hi")
    )


def file_pieces(files: DataFrame) -> DataFrame:
    """Each file of ``files(station, start_us, end_us, fs, n_samples)`` as one piece."""
    return files.select(
        "station",
        "start_us",
        "end_us",
        "fs",
        "n_samples",
        F.col("start_us").alias("file_start_us"),
        F.col("end_us").alias("file_end_us"),
        F.col("n_samples").alias("file_samples"),
        F.lit(0).cast("bigint").alias("first_sample"),
    )


def count_samples(
    segments: DataFrame, pieces: DataFrame, width_us: int, unit_us: int = SECOND_US, rates: bool = False
) -> DataFrame:
    """Per requested segment: pieces touched and samples delivered (0 when none).

    ``rates`` adds the lowest and the highest sampling rate met, ``fs_low`` and ``fs_high``.
    """
    keys = ["station", "seg_start_us", "seg_end_us"]
    met = [F.min("fs").alias("fs_low"), F.max("fs").alias("fs_high")] if rates else []
    got = sample_pieces(segments.select(*keys).distinct(), pieces, width_us, unit_us).groupBy(*keys).agg(
        F.count("*").alias("n_pieces"), F.sum("n_taken").alias("n_samples"), *met
    )
    return segments.join(got, keys, "left").na.fill(0, ["n_pieces", "n_samples"])


def segment_samples(segments: DataFrame, chunks: DataFrame, width_us: int) -> DataFrame:
    """Samples of each segment in one array, across chunk and file borders.

    ``chunks`` is the waveform table. A segment's array is bounded by its
    duration times the sampling frequency.
    """
    cut = sample_pieces(segments, chunk_pieces(chunks), width_us)
    return _assemble(cut, segments.columns)


def _assemble(cut: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    part = F.slice("samples", (F.col("skip") + 1).cast("int"), F.col("n_taken").cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("start_us", part.alias("part"))))
    return cut.groupBy(*keys).agg(
        F.flatten(F.transform(ordered, lambda p: p["part"])).alias("samples"),
        F.min("fs").alias("fs"),
        *extra,
    )


def tile_samples(stations: DataFrame, chunks: DataFrame, width_us: int) -> DataFrame:
    """Samples of every tile of ``tiles(stations, width_us)`` that has any.

    Which tiles a chunk reaches follows from the station's start alone, so each
    chunk is cut where it is read and the samples are shuffled once, to be put
    together by tile; ``segment_samples`` has to move them to the segments first.
    Where the stations are too many to broadcast, the chunks meet them by station and
    day (a chunk is at most a day long), so no station is in one task.
    """
    day0, day1 = floor_div("start_us", DAY_US) - 1, floor_div("end_us", DAY_US)
    known = stations.select(
        "station", F.col("start_us").alias("_t0"), F.col("end_us").alias("_t1"), F.explode(F.sequence(day0, day1)).alias("_day")
    )
    pieces = chunk_pieces(chunks).withColumn("_day", floor_div("start_us", DAY_US))
    reached = pieces.join(known, ["station", "_day"])
    n = F.floor((F.col("_t1") - F.col("_t0")) / F.lit(float(width_us))).cast("bigint")
    first = F.greatest(floor_div(F.col("start_us") - F.col("_t0"), width_us), F.lit(0))
    last = F.least(floor_div(F.col("end_us") - F.col("_t0"), width_us), n - 1)
    each = (
        reached.withColumn("_first", first)
        .withColumn("_last", last)
        .where("_first <= _last")
        .withColumn("k", F.explode(F.sequence("_first", "_last")))
        .withColumn("seg_start_us", F.col("_t0") + F.col("k") * width_us)
        .withColumn("seg_end_us", F.col("seg_start_us") + width_us)
        .withColumn("_hi", F.col("seg_end_us") - EPSILON_US)
    )
    keys = ["station", "seg_start_us", "seg_end_us"]
    return _assemble(_cut(each, SECOND_US), keys, F.first("k").alias("k"))


def manifest_path(root: str, label: str, station: str, center_us: str, extension: str) -> Column:
    name = F.concat(format_stamp(center_us), F.lit("." + extension))
    folder = F.concat(F.col(label), F.lit("s"))
    return F.concat_ws("/", F.lit(root), folder, F.col(station).cast("string"), name)


def missing_only(wanted: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose output does not exist yet (keys are reduced before they are shuffled)."""
    return wanted.join(existing.select(*keys).distinct(), keys, "left_anti")


def chunk_pieces(chunks: DataFrame) -> DataFrame:
    """Waveform table -> pieces. Bounds are widened by a sample to absorb rounding."""
    n = F.size("samples").cast("bigint")
    period = F.ceil(F.lit(1e6) / F.col("fs"))
    length = F.round((F.col("first_sample") + n) * F.lit(1e6) / F.col("fs")).cast("bigint")
    return chunks.select(
        "station",
        "fs",
        "samples",
        n.alias("n_samples"),
        "file_start_us",
        "file_samples",
        "first_sample",
        (F.col("chunk_us") - period).alias("start_us"),
        (F.col("file_start_us") + length + period).alias("end_us"),
        samples_end(F.col("file_start_us"), F.col("file_samples"), F.col("fs")).alias("file_end_us"),
    )


def samples_end(start_us: Column, n: Column, fs: Column) -> Column:
    return start_us + F.round(n * F.lit(1e6) / fs).cast("bigint")
