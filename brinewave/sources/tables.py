"""Annotation, manifest, configuration and result tables."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from brinewave.functions.timing import basename, midpoint, parent_name, parse_stamp, to_us
from brinewave.schemas import (
    ANNOTATION_CSV_TEST,
    ANNOTATION_CSV_TRAIN,
    DATASET_CONFIG,
    EVENT_CONFIG,
    PICK,
)

# Annotation classes
TEST_CLASSES = ["uncertain", "T", "H"]
TRAIN_POSITIVE = "geophony"
TRAIN_NEGATIVE = "negative"


def read_test_annotations(spark: SparkSession, path: str) -> DataFrame:
    """``(station, class, at_us, n_annotators)`` of the accepted classes.

    The annotator count is the last field of a line whatever lies between, so
    the lines are read as text and split. Blank lines, and short ones without a class,
    are dropped.
    """
    lines = spark.read.option("wholetext", False).text(path).where(F.trim("value") != "")
    parts = fields("value")
    rows = lines.select(
        F.get(parts, 0).alias("station"),
        F.get(parts, 1).alias("class"),
        F.get(parts, 2).alias("stamp"),
        F.element_at(parts, -1).try_cast("int").alias("n_annotators"),
    )
    assert [f.name for f in ANNOTATION_CSV_TEST] == rows.columns
    return (
        rows.where(F.col("class").isin(TEST_CLASSES))
        .withColumn("at_us", to_us(parse_stamp("stamp")))
        .select("station", "class", "at_us", "n_annotators")
    )


def read_train_annotations(spark: SparkSession, path: str) -> DataFrame:
    """``(station, label, at_us)``; a negative counts at the middle of its interval."""
    rows = spark.read.schema(ANNOTATION_CSV_TRAIN).option("header", True).csv(path)
    start, end = to_us(parse_stamp("stamp")), to_us(parse_stamp("stamp_end"))
    is_negative = F.col("class") == TRAIN_NEGATIVE
    return rows.where(F.col("class").isin(TRAIN_POSITIVE, TRAIN_NEGATIVE)).select(
        "station",
        F.when(is_negative, "negative").otherwise("positive").alias("label"),
        F.when(is_negative, midpoint(start, F.coalesce(end, start))).otherwise(start).alias("at_us"),
    )


def fields(line: str) -> Column:
    """Fields of a CSV line of any width, with quoted fields where a quote occurs."""
    quoted = F.split(F.col(line), r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    unquoted = F.transform(
        quoted,
        lambda f: F.regexp_replace(F.regexp_replace(f, r'^"(.*)"$', "$1"), '""', '"'),
    )
    return F.when(F.contains(F.col(line), F.lit('"')), unquoted).otherwise(F.split(F.col(line), ","))


def parse_manifest(lines: DataFrame, layout: str, line: str = "value") -> DataFrame:
    """Ragged manifest lines -> ``(path, idx, label, picks)``.

    Layouts: ``test`` path,class,offset,n,...  ``train`` path,class,offset,...
    and either with ``indexed_`` in front for path,idx,class,...  Blank lines are dropped;
    what a short line lacks is null. An offset may carry its copies, as in ``1.5x20``.
    """
    indexed = layout.startswith("indexed_")
    counted = layout.endswith("test")
    skip = 3 if indexed else 2
    parts = lines.where(F.trim(line) != "").withColumn("_f", fields(line)).withColumn(
        "_rest", F.expr(f"slice(_f, {skip + 1}, greatest(size(_f) - {skip}, 0))")
    )
    if counted:
        starts = F.expr("if(size(_rest) > 1, sequence(0, size(_rest) - 2, 2), array())")
        count = lambda i: F.get("_rest", i + 1).cast("int")
    else:
        starts = F.expr("if(size(_rest) > 0, sequence(0, size(_rest) - 1), array())")
        count = lambda i: F.lit(None).cast("int")
    run = lambda i, part: F.get(F.split(F.get("_rest", i.cast("int")), "x"), F.lit(part))
    picks = F.transform(
        starts,
        lambda i: F.struct(
            run(i, 0).cast("double").alias("offset_s"),
            count(i.cast("int")).alias("n_annotators"),
            F.coalesce(run(i, 1).cast("bigint"), F.lit(1).cast("bigint")).alias("copies"),
        ),
    ).cast(f"array<{PICK}>")
    return parts.select(
        F.get("_f", 0).alias("path"),
        (F.get("_f", 1).try_cast("bigint") if indexed else F.lit(None).cast("bigint")).alias("idx"),
        F.get("_f", 2 if indexed else 1).alias("label"),
        picks.alias("picks"),
    )


def read_manifest(spark: SparkSession, path: str, layout: str) -> DataFrame:
    return parse_manifest(spark.read.text(path), layout)


def manifest_line(
    path: Column, label: Column, picks: Column, counted: bool = True, idx: Column | None = None, runs: bool = False
) -> Column:
    """Inverse of ``parse_manifest``: one text line.

    Copies of a pick are written out, or with ``runs`` as one entry that carries their number, so a
    moment with a million annotations is a short line too.
    """

    def one(p: Column) -> Column:
        offset = p["offset_s"].cast("string")
        if runs:
            offset = F.concat(offset, F.when(p["copies"] > 1, F.concat(F.lit("x"), p["copies"].cast("string"))).otherwise(""))
        written = F.concat_ws(",", offset, *([p["n_annotators"].cast("string")] if counted else []))
        return F.array(written) if runs else F.array_repeat(written, p["copies"].cast("int"))

    head = [path] + ([idx.cast("string")] if idx is not None else []) + [label]
    return F.concat_ws(",", *head, F.array_join(F.nullif(F.flatten(F.transform(picks, one)), F.array().cast("array<string>")), ","))


def path_and_offsets(manifest: DataFrame) -> DataFrame:
    """Class dropped, path and offsets kept: what a sample loader needs."""
    return manifest.select("path", F.transform("picks", lambda p: p["offset_s"]).alias("offsets"))


def mapping_of(text: str) -> dict:
    """Nested mappings of scalars, indented as in YAML; comments and quotes are understood."""
    root: dict = {}
    open_: list[tuple[int, dict]] = [(-1, root)]
    for line in text.splitlines():
        found = re.match(r"""(\s*)("[^"]*"|'[^']*'|[^\s#:][^:]*?)\s*:(?:\s+(.*))?$""", line.rstrip())
        if not found:
            if line.strip() and not line.strip().startswith(("#", "---")):
                raise ValueError(f"not a mapping: {line!r}")
            continue
        depth, name, value = len(found[1]), found[2].strip("\"'"), (found[3] or "").strip()
        while open_[-1][0] >= depth:
            open_.pop()
        quoted = re.match(r"""(["'])(.*?)\1\s*(?:#.*)?$""", value)
        value = quoted[2] if quoted else re.sub(r"(^|\s)#.*$", "", value).strip()
        if value or quoted:
            open_[-1][1][name] = value
        else:
            open_[-1][1][name] = inner = {}
            open_.append((depth, inner))
    return root


def _as_json(text: Column) -> Column:
    @arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([json.dumps(mapping_of(t)) for t in column.to_pylist()], pa.string())

    return run(text)


def _config_map(spark: SparkSession, path: str, schema: T.MapType) -> DataFrame:
    """Configuration files, each as one MAP; JSON, or YAML by its extension."""
    source = spark.read.text(path, wholetext=True)
    document = _as_json(F.col("value")) if path.endswith((".yaml", ".yml")) else F.col("value")
    return source.select(F.from_json(document, schema).alias("m"))


def read_dataset_config(spark: SparkSession, path: str) -> DataFrame:
    """``(dataset, root_dir, station, start_us, end_us)``."""
    sets = _config_map(spark, path, DATASET_CONFIG).select(F.explode("m").alias("dataset", "d"))
    stations = sets.select("dataset", "d.root_dir", F.explode("d.stations").alias("station", "p"))
    return stations.select(
        "dataset",
        "root_dir",
        "station",
        to_us(parse_stamp("p.date_start")).alias("start_us"),
        to_us(parse_stamp("p.date_end")).alias("end_us"),
    )


def read_event_config(spark: SparkSession, path: str) -> DataFrame:
    """``(name, dataset, station, duration_s, center_us, arrow_offset)``."""
    events = _config_map(spark, path, EVENT_CONFIG).select(F.explode("m").alias("name", "e"))
    return events.select(
        "name",
        "e.dataset",
        "e.station",
        F.col("e.segment_duration_s").cast("int").alias("duration_s"),
        to_us(parse_stamp("e.segment_center")).alias("center_us"),
        F.col("e.arrow_offset").cast("int").alias("arrow_offset"),
    )


def choose_events(events: DataFrame, names: list[str]) -> DataFrame:
    """Named events in the order of the list (a short list of literals, no join)."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name"))
    return events.where(F.col("name").isin(names)).withColumn("pos", place)


def feature_key(features: DataFrame, path: str = "path") -> DataFrame:
    """Feature rows keyed by file base name and label folder."""
    return features.withColumn("file", basename(path)).withColumn("folder", parent_name(path))


def join_features(manifest: DataFrame, features: DataFrame) -> DataFrame:
    """Manifest rows with their feature vector, by (label, file, idx)."""
    return manifest.join(features, ["label", "file", "idx"])


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """``(fold, epoch, metric, value)`` of all folds of a model."""
    return spark.read.parquet(path).select("fold", "epoch", "metric", "value")


def read_results(spark: SparkSession, path: str, model: str | None = None, dataset: str | None = None, min_annot: int | None = None) -> DataFrame:
    """Stored results; the keys are partition columns, so a filter prunes folders."""
    out = spark.read.parquet(path)
    for name, value in (("model", model), ("dataset", dataset), ("min_annot", min_annot)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out
