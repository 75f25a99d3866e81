"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

1. Every document gives its set of five-word shingles (64-bit hashes), a digest of the
   set and a min-max signature: ``HASHES`` hash functions, each keeping its smallest and
   its largest value, so half as many evaluations as values. ``ROWS`` minima or maxima
   make a band.
2. Documents with the same set are one class from here on, stood for by the smallest id.
3. Classes that share a band meet in a bucket. Each is compared with the bucket's smallest
   class on full sets (a star, not all pairs); the links give first components.
4. Buckets that still hold several components are resolved exactly: classes with so many
   shingles found nowhere else in such buckets that no link is possible leave; the others
   are compared across components, block against block, inside tasks of bounded size that
   return only links. The full sets lie in buckets of their class, so these joins move the
   keys only.
5. The components of all links.

A pair at the threshold of 0.85 shares no band with probability (1 - 0.85**4)**20 = 4e-7;
nothing else is approximate. No step collects a group or sends data to the driver.

Defined cases: null or blank texts have no shingles and link with nothing; fewer than five
words are one shingle; equal texts and repeated rows share a component; a row with a null
id joins the component of its copies, if any; other columns pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewave.llm.common import llm_query, materialise, new_folder, slices, table
from brinewave.llm.components import components
from brinewave.llm.ngramjoin import PROBES, bit_filter, passing
from brinewave.llm.shingles import MinMax, band_keys, digest, shingle_sets

HASHES = 40
ROWS = 4
#: a block of a bucket holds about so many shingles
BLOCK_SHINGLES = 150_000


def _linked(shared, a, b, percent: int):
    """100 * intersection >= percent * union, in whole numbers."""
    return 100 * shared >= percent * (a + b - shared)


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, d1, d2, bands)`` of every row of ``docs``."""
    signer = MinMax(HASHES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches, "text", 1 << 20):
                counts, digests, bands = [], [], []
                for items in shingle_sets(batch.column(1)):
                    counts.append(len(items))
                    digests.append(digest(items))
                    bands.append(band_keys(signer(items), ROWS).view(np.int64) if len(items) else [])
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "d1", "d2", "bands"],
                )

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def full_sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """``(rep, d1, d2, items)`` from ``(rep, text)``, of the rows whose id is in ``reps(rep)`` and a few more.

    Texts stay where they are read: a bit filter of bounded size tells the tasks which ones to take.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(bit_filter(reps, "rep"))
    places = [F.shiftrightunsigned(F.xxhash64("rep", F.lit(k)), 8).alias(f"p{k}") for k in range(PROBES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches, "text", 1 << 20):
                chosen = pa.array(passing(batch, wanted.value))
                sets = list(shingle_sets(batch.column(1).filter(chosen)))
                halves = np.frombuffer(b"".join(map(digest, sets)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).filter(chosen), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    ["rep", "d1", "d2", "items"],
                )

    return docs.select("rep", "text", *places).mapInArrow(run, "rep long, d1 long, d2 long, items array<long>")


def write_sets(texts: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets ``(rep, items)`` of ``wanted(rep, d1, d2)``, as a table in buckets of ``rep`` and as its plain files.

    Joins by ``rep`` on the first do not move the sets; a join whose other key may be hot takes
    the second, which Spark can split.
    """
    spark = texts.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = wanted.select(F.col("rep").alias("r"), F.col("d1").alias("w1"), F.col("d2").alias("w2"))
    # the digests are compared beside the key, so that the sets are dealt out once, by rep
    same = F.expr("((d1 ^ w1) | (d2 ^ w2)) = 0")
    found = full_sets(texts, wanted.select("rep")).repartition(buckets, "rep")
    found = found.join(known, (F.col("rep") == F.col("r")) & same).select("rep", "items").dropDuplicates(["rep"])
    path = new_folder(spark, "sets")
    name = f"brinewave_sets_{uuid.uuid4().hex}"
    found.write.format("parquet").bucketBy(buckets, "rep").sortBy("rep").option("path", path).saveAsTable(name)
    return spark.table(name), spark.read.schema(found.schema).parquet(path)


def links_between(sets: list[np.ndarray], group: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect different groups: positions of a pair for each merger, not all pairs."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(where, kind="stable")
    posting = owner[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(values)))])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    group = group.copy()
    found = []
    for i in range(len(sets)):
        mine = where[begin[i] : begin[i + 1]]
        lo, n = first[mine], first[mine + 1] - first[mine]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(posting[at], minlength=len(sets))
        for j in np.flatnonzero(_linked(shared, sizes[i], sizes, percent) & (group != group[i])):
            if group[j] != group[i]:
                found.append((i, int(j)))
                group[group == group[j]] = group[i]
    return found


def classes(sig: DataFrame) -> DataFrame:
    """One row per distinct shingle set: its smallest document id."""
    return (
        sig.where("n_shingles > 0 and doc_id is not null")
        .groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    )


def link_components(docs: DataFrame, sig: DataFrame, percent: int, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(classes, components (v, c))`` of the classes of ``sig``, a table in the shared folder."""
    reps = materialise(classes(sig), "classes")
    member = reps.select("rep", "n", F.explode("bands").alias("key"))
    keys = member.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("m")).where("m > 1")
    member = materialise(member.join(keys.select("key", "leader"), "key"), "buckets")

    wanted = materialise(member.select("rep").distinct().join(reps.select("rep", "d1", "d2"), "rep"), "wanted")
    texts = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text"))
    sets, plain_sets = write_sets(texts, wanted)

    # the star of each bucket
    pairs = member.where("rep <> leader").select("leader", "rep").distinct()
    star = pairs.join(plain_sets.select(F.col("rep").alias("leader"), F.col("items").alias("x")), "leader").join(
        sets.select("rep", F.col("items").alias("y")), "rep"
    )
    shared, a, b = F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y")
    size_fits = 100 * F.least(a, b) >= percent * F.greatest(a, b)
    edges = materialise(
        star.where(size_fits & _linked(shared, a, b, percent)).select(F.col("leader").alias("a"), F.col("rep").alias("b")), "star"
    )
    first = components(edges)

    # buckets with several components left
    label = F.coalesce("c", "rep")
    open_ = member.select("key", "rep", "n").join(first.withColumnRenamed("v", "rep"), "rep", "left").select("key", "rep", "n", label.alias("c"))
    open_ = materialise(_several(open_), "open")
    # a class with too many shingles of its own cannot be linked to any other class here
    inside = sets.join(open_.select("rep").distinct(), "rep")
    lone = inside.select("rep", F.explode("items").alias("item")).groupBy("item").agg(F.min("rep").alias("rep"), F.count("*").alias("k")).where("k = 1")
    shut = lone.groupBy("rep").agg(F.count("*").alias("own")).join(reps.select("rep", "n"), "rep").where(f"100 * own > {100 - percent} * n")
    open_ = _several(open_.join(shut.select("rep"), "rep", "left_anti"))
    # equal buckets are looked at once
    shape = open_.groupBy("key").agg(
        F.count("*").alias("m"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("rep")).alias("h1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("h2")
    )
    once = shape.groupBy("m", "total", "h1", "h2").agg(F.min("key").alias("key")).select("key", "total")
    blocks = F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int")
    placed = materialise(open_.join(once, "key").select("key", "rep", "c", blocks.alias("blocks")), "placed")
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = placed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = placed.select("key", "rep", "c", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        if group["c"].nunique() < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sets_here = [np.asarray(s, np.int64) for s in group["items"]]
        rep = group["rep"].to_numpy()
        _, comp = np.unique(group["c"].to_numpy(), return_inverse=True)
        found = links_between(sets_here, comp, percent)
        return pd.DataFrame({"a": [rep[i] for i, _ in found], "b": [rep[j] for _, j in found]}, dtype="int64")

    more = tasks.join(sets, "rep").groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")
    return reps, components(edges.unionByName(materialise(more, "links")))


def _several(open_: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one component."""
    span = open_.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    return open_.join(span.select("key"), "key")


def near_duplicates(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``."""
    sig = materialise(signatures(docs, doc_id, text), "signatures")
    reps, linked = link_components(docs, sig, percent, doc_id, text)
    found = reps.select("d1", "d2", "rep").join(linked.withColumnRenamed("v", "rep"), "rep", "left")
    found = found.select("d1", "d2", F.coalesce("c", "rep").alias("component_id"))
    whole = sig.select("doc_id", "n_shingles", "d1", "d2").join(found, ["d1", "d2"], "left")
    own = F.coalesce("component_id", "doc_id")
    return whole.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


@llm_query("op9_minmax_neardup")
def op9(spark, sf_dir):
    """Component of every document under five-word shingles at 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"))
