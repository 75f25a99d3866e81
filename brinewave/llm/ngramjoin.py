"""Jaccard join of word n-gram sets by prefixes of token combinations.

Tokens are 64-bit hashes of five-word shingles. Documents with the same set are one class
named by half of its digest (``rep``). For a set of n tokens, any set it may link with shares at
least need = ceil(percent * n / 100) of them. Under one order of all tokens, the j-th common
token of two linked sets therefore stands among the first n - need + j of each.

1. **Sets that cannot link leave.** Only n - need tokens of a set may occur nowhere else.
   This is asked twice: of the head of each set under the order of the hashes, extended so
   far that a tenth of the tokens must recur, and then of the whole sets of those left.
   The tokens that occur once name their set themselves, so the first is an aggregation
   without a join. The texts of the sets left are not moved: a bit filter of bounded size
   tells the tasks that read them again which rows to look at; what it lets through beyond
   them is one more set that links with nothing.
2. **Frequencies** of the tokens of the sets that are left give the order: rare first.
   Tokens of one set alone use up places of its prefix and need no entry.
3. **Keys.** If the first common token of a pair is rare (at most ``RARE`` sets), it is a key
   by itself. If it belongs to a frequent class, so do all later ones: the prefix is
   extended by k - 1 tokens, and combinations of k tokens are keys, k = 2 above ``RARE`` and
   3 above ``COMMON``, so that a passage which many sets share does not bring them together by
   one token. How many combinations a set has grows with its length to the power k, so longer
   sets take fewer tokens (``LONGEST``): which k holds for a pair is told by its larger set, and
   a set that may be the smaller or the larger one has the keys of both cases. Linked sets
   that differ share at least percent / (100 - percent) tokens, which bounds k.
4. **Verification** on whole sets. Sets that share a key, directly or over others, are a
   cluster, so each set is sent to one place and a pair is looked at once, however many keys
   it shares. Inside a task, sets linked to the cluster's first one are done with each other;
   the others are compared with all by an index of their tokens. A cluster of more tokens
   than ``BLOCK_TOKENS`` is compared block against block, or, where that moves fewer tokens,
   bucket by bucket: keys with the same smallest set form a bucket, and so does every pair.
5. The components of all links (``components``).

Nothing is approximate (but for equal 64-bit hashes of different shingles), dropped or capped;
no group is collected and nothing reaches the driver. Tasks return links that join
components, not pairs. A group of many sets that are similar but not linked costs the square
of its size inside tasks of bounded size, not in rows.

Defined cases: null and blank texts have no tokens and link with nothing; fewer than five
words are one token; every row is a document, so equal texts and repeated rows share a
component, and rows of one id with different texts are linked by their texts only; a row with
a null id links like any other, and a component without any id is null; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewave.llm.common import llm_query, materialise, slices, table
from brinewave.llm.components import components
from brinewave.llm.shingles import digest, mix, shingle_sets

PERCENT = 80
#: a head is so much longer that this share (1 in HEAD) of the tokens must recur in it
HEAD = 10
#: a token of more sets is frequent, and above COMMON it asks for three tokens
RARE, COMMON = 32, 1024
#: combinations of k tokens are made for pairs whose larger set has at most so many tokens
LONGEST = {2: 500, 3: 60}
#: tokens of the sets that a task compares
BLOCK_TOKENS = 300_000
#: the filter of rows to read again: 16 MB at most, places of a row
FILTER_BITS, PROBES = 1 << 27, 4


def need(n, percent: int):
    """Tokens that a set of ``n`` shares with any set it links with."""
    return -(-percent * n // 100)


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, row, text)``: rows with a hash of id and text."""
    key = F.col(doc_id).cast("long")
    return docs.select(key.alias("doc_id"), F.xxhash64(key, F.col(text)).alias("row"), F.col(text).alias("text"))


def classes(sig: DataFrame) -> DataFrame:
    """``(rep, d2, doc_id, n, extra, row)``: the distinct sets; ``row`` is the hash of their smallest row."""
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("least")
    first = (F.first(c).alias(c) for c in ("n_shingles", "extra"))
    found = sig.where("n_shingles > 0").groupBy("d1", "d2").agg(smallest, *first)
    return materialise(found.select(F.col("d1").alias("rep"), "d2", "least.doc_id", F.col("n_shingles").alias("n"), "extra", "least.row"), "classes")


def heads(docs: DataFrame, percent: int, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, row, n_shingles, d1, d2, extra, head)``: digest of each set and its first tokens by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches, "text", 1 << 20):
                counts, digests, extra, found = [], [], [], []
                for items in shingle_sets(batch.column(2)):
                    n = len(items)
                    more = -(-n // HEAD)
                    counts.append(n)
                    digests.append(digest(items))
                    extra.append(more)
                    found.append(items[: n - need(n, percent) + more].view(np.int64))
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:2], pa.array(counts, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(extra, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                    ["doc_id", "row", "n_shingles", "d1", "d2", "extra", "head"],
                )

    return keyed(docs, doc_id, text).mapInArrow(run, "doc_id long, row long, n_shingles long, d1 long, d2 long, extra long, head array<long>")


def bit_filter(hashes: DataFrame, name: str) -> np.ndarray:
    """Words of a filter of at most ``FILTER_BITS`` bits that has every hash of the table at ``PROBES`` places."""
    bits = min(FILTER_BITS, 1 << max(10, (16 * hashes.count()).bit_length()))
    place = F.explode(F.array(*(F.shiftrightunsigned(F.xxhash64(name, F.lit(k)), 8).bitwiseAND(F.lit(bits - 1)) for k in range(PROBES))))
    words = hashes.select(place.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("b"))
    found = words.toArrow()  # at most FILTER_BITS / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out


def passing(batch: pa.RecordBatch, words: np.ndarray) -> np.ndarray:
    """Rows whose ``PROBES`` places are set; the columns after the second are the places."""
    good = np.ones(batch.num_rows, bool)
    for k in range(PROBES):
        p = batch.column(2 + k).to_numpy() & (len(words) * 64 - 1)
        good &= (words[p >> 6] >> (p & 63)) & 1 == 1
    return good


def class_sets(docs: DataFrame, heads_of: DataFrame, reps: DataFrame, percent: int, doc_id: str, text: str) -> DataFrame:
    """``(rep, n, items)`` of the classes that may link by their heads, a table in the shared folder."""
    # copies have one digest, so equal texts count once
    held = heads_of.where("n_shingles > 0").select(F.col("d1").alias("rep"), F.explode("head").alias("item"))
    own = held.groupBy("item").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")).where("rep = other")
    own = materialise(own.groupBy("rep").agg(F.count("*").alias("own")), "head-own")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + F.col("extra")
    alive = reps.join(own, "rep", "left").where(length - F.coalesce("own", F.lit(0)) >= F.col("extra"))
    wanted = docs.sparkSession.sparkContext.broadcast(bit_filter(materialise(alive.select("row"), "alive"), "row"))
    places = [F.shiftrightunsigned(F.xxhash64("row", F.lit(k)), 8).alias(f"p{k}") for k in range(PROBES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches, "text", 1 << 20):
                chosen = batch.column(1).filter(pa.array(passing(batch, wanted.value)))
                sets = [s for s in shingle_sets(chosen) if len(s)]
                reps = [int.from_bytes(digest(s)[:8], "little", signed=True) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reps, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    ["rep", "n", "items"],
                )

    found = keyed(docs, doc_id, text).select("row", "text", *places).mapInArrow(run, "rep long, n long, items array<long>")
    return materialise(found.dropDuplicates(["rep"]), "sets")


def shared_tokens(sets: DataFrame, percent: int) -> DataFrame:
    """``(rep, n, item, df)`` of the sets that may link: the tokens that other sets have too, rare ones first."""
    tokens = sets.select("rep", "n", F.explode("items").alias("item"))
    df = tokens.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    ordered = tokens.join(df, "item").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("shared"))
    enough = F.size("shared") >= F.ceil(F.col("n") * percent / 100)
    return materialise(ordered.where(enough).select("rep", "n", "shared.item", "shared.df"), "shared")


def combination_size(df: int, n: int, longest_k: int) -> int:
    """Tokens of a key whose first one occurs in ``df`` sets, in a pair whose larger set has ``n`` tokens."""
    k = 1 if df <= RARE else 2 if df <= COMMON else 3
    k = min(k, longest_k)
    while k > 1 and n > LONGEST[k]:
        k -= 1
    return k


def prefix_keys(items: np.ndarray, dfs: np.ndarray, n: int, percent: int) -> set[int]:
    """Keys of one set from its tokens that occur elsewhere too, in the order of the frequencies."""
    longest_k = max(1, min(3, percent // (100 - percent))) if percent < 100 else 3
    alone, room = n - len(items), n - need(n, percent)
    largest = 100 * n // percent
    values = items.astype(np.uint64)
    keys: set[int] = set()
    for i in range(max(0, min(len(items), room + 1 - alone))):
        # k of a pair with a set that is not larger, and of one with the largest partner
        small, large = (combination_size(int(dfs[i]), m, longest_k) for m in (n, largest))
        for k in range(large, small + 1):
            if k == 1:
                keys.add(int(values[i]))
                continue
            reach = [values[i + 1 : max(0, room + j - alone)] for j in range(2, k + 1)]
            first = mix(values[i : i + 1] + np.uint64(k))
            if k == 2:
                keys.update(mix(first ^ reach[0]).tolist())
                continue
            for j, second in enumerate(mix(first ^ reach[0])):
                keys.update(mix(second ^ reach[1][j + 1 :]).tolist())
    return keys


def members(shared: DataFrame, percent: int) -> DataFrame:
    """``(leader, rep)``: the sets of each bucket, under the smallest set that has one of its keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for rep, n, items, dfs in zip(*(c.to_pylist() for c in batch.columns)):
                    keys = sorted(prefix_keys(np.array(items, np.int64), np.array(dfs), n, percent))
                    for start in range(0, len(keys), 10_000):
                        part = np.array(keys[start : start + 10_000], np.uint64).view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(part), pa.array(np.full(len(part), rep))], ["key", "rep"]
                        )

    found = shared.mapInArrow(run, "key long, rep long")
    found = materialise(found, "keys")
    first = found.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("m")).where("m > 1")
    return materialise(found.join(first.select("key", "leader"), "key").select("leader", "rep").distinct(), "buckets")


def groups(member: DataFrame, sets: DataFrame) -> DataFrame:
    """``(cluster, leader, rep, blocks)``: where each set is compared, by cluster (leader null) or by bucket."""
    linked = components(member.select(F.col("leader").alias("a"), F.col("rep").alias("b")))
    sizes = sets.select("rep", "n")
    inside = materialise(linked.select(F.col("v").alias("rep"), F.col("c").alias("cluster")).join(sizes, "rep"), "clusters")
    blocks = lambda: F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks")
    moved = F.col("tokens") * F.col("blocks")
    by_cluster = inside.groupBy("cluster").agg(F.sum("n").alias("tokens"), blocks())
    own = inside.withColumnRenamed("rep", "leader").select("leader", "cluster")
    by_bucket = member.join(sizes, "rep").groupBy("leader").agg(F.sum("n").alias("tokens"), blocks()).join(own, "leader")
    cheaper = by_bucket.groupBy("cluster").agg(F.sum(moved).alias("bucket_cost"))
    chosen = by_cluster.join(cheaper, "cluster").select("cluster", "blocks", ((F.col("blocks") > 1) & (F.col("bucket_cost") < moved)).alias("split"))
    chosen = materialise(chosen, "plans")
    whole = inside.join(chosen.where("not split"), "cluster").select("cluster", F.lit(None).cast("long").alias("leader"), "rep", "blocks")
    parts = by_bucket.select("leader", "cluster", "blocks").join(chosen.where("split").select("cluster"), "cluster")
    return whole.unionByName(member.join(parts, "leader").select("cluster", "leader", "rep", "blocks"))


def links_among(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of positions whose links give the components of ``sets``, by an index of their tokens."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    tokens = np.concatenate(sets)
    similar = lambda shared, i: 100 * shared >= percent * (sizes[i] + sizes - shared)
    near = np.flatnonzero(similar(np.bincount(owner[np.isin(tokens, sets[0])], minlength=len(sets)), 0))
    found = [(0, int(j)) for j in near if j]
    group = np.arange(len(sets))
    group[near] = 0
    values, where = np.unique(tokens, return_inverse=True)
    posting = owner[np.argsort(where, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(values)))])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    # one end of a link that joins two components is outside the first set's
    for i in np.flatnonzero(group != 0).tolist():
        mine = where[begin[i] : begin[i + 1]]
        low, n = first[mine], first[mine + 1] - first[mine]
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(posting[at], minlength=len(sets))
        for j in np.flatnonzero(similar(shared, i) & (group != group[i])).tolist():
            if group[j] != group[i]:
                found.append((i, j))
                group[group == group[j]] = group[i]
    return found


def verified_links(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: links that give the components of each of ``groups``, block against block."""
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = placed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = placed.select("cluster", "leader", "rep", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        rep = group["rep"].to_numpy()
        found = links_among([np.asarray(s, np.int64) for s in group["items"]], percent)
        return pd.DataFrame({"a": [rep[i] for i, _ in found], "b": [rep[j] for _, j in found]}, dtype="int64")

    return tasks.join(sets.select("rep", "items"), "rep").groupBy("cluster", "leader", "i", "j").applyInPandas(compare, "a long, b long")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row of ``docs``."""
    # the heads are worked out again where they are counted, so that they need not be stored
    heads_of = heads(docs, percent, doc_id, text)
    sig = materialise(heads_of.drop("head"), "digests")
    reps = classes(sig)
    sets = class_sets(docs, heads_of, reps, percent, doc_id, text)
    shared = shared_tokens(sets, percent)
    sets = sets.join(shared.select("rep"), "rep", "left_semi")
    links = materialise(verified_links(groups(members(shared, percent), shared), sets, percent), "links")
    linked = components(links).withColumnRenamed("v", "rep")
    found = reps.select("rep", "d2", "doc_id").join(linked, "rep", "left").select(F.col("rep").alias("d1"), "d2", "doc_id", F.coalesce("c", "rep").alias("c"))
    smallest = found.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    found = found.join(smallest, "c").select("d1", "d2", "component_id")
    out = sig.select("doc_id", "n_shingles", "d1", "d2").join(found, ["d1", "d2"], "left")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", alone.alias("component_id"))


SQL = """
with words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
tokens as materialized (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from words where len(w) > 0)),
sizes as materialized (select doc_id, count(*) as n from tokens group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared from tokens a join tokens b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as materialized (
  select p.a, p.b from pairs p join sizes x on x.doc_id = p.a join sizes y on y.doc_id = p.b
  where 100 * shared >= 80 * (x.n + y.n - shared)),
both_ as (select a, b from links union all select b, a from links),
reach as (with recursive r(v, c) as (select doc_id, doc_id from sizes union select e.b, r.c from r join both_ e on e.a = r.v) select v, min(c) as c from r group by v)
select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(r.c, d.doc_id) as component_id
from documents d left join sizes s on s.doc_id = d.doc_id left join reach r on r.v = d.doc_id
"""


@llm_query("op12_combination_prefixes", SQL)
def op12(spark, sf_dir):
    """Component of every document under five-word shingles at 0.80."""
    return jaccard_components(table(spark, sf_dir, "documents"))
