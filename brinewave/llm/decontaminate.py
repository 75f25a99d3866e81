"""Benchmark passages in documents, with DataFrame functions only.

Words are the lower-cased runs of letters and digits. A document is looked at through
windows as long as a benchmark item, laid where the two share a five-word shingle: a window
without a shared shingle has similarity 0. Every window and item gets a 64-bit SimHash of
its shingles weighted by how often they occur. Four blocks of 16 bits index the items: two
fingerprints that differ in at most ``RADIUS`` = 19 bits differ in at most 4 bits in some
block, so each item is entered under every value within 4 bits of its block (2,517), and a
look-up by equal block value finds all fingerprints within the radius. Candidates are then
verified by the exact weighted similarity, sum of the smaller over sum of the larger counts,
of at least 0.8: the shingles of candidate windows and of items are counted and joined. At 0.8 a pair is expected to differ in 10 bits; a passage's exact copy in 0.

Rows are told apart by two hashes of the text, so copies are looked at once, and rows with
null or repeated ids are judged by their own text.

Defined cases: null and empty texts match nothing; items under five words have no shingle
and match nothing; a window never leaves the document, a shorter document is one window;
an empty benchmark gives no rows; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewave.llm.common import fresh, llm_query, materialise, table

WIDTH = 5
RADIUS = 19
BLOCKS, BLOCK_BITS = 4, 16
#: bits of a block that may differ: by the pigeonhole, RADIUS // BLOCKS
FLIPS = RADIUS // BLOCKS
_LANES, _WIDE_LANES = 0x0001000100010001, 0x0000000100000001
#: shingles that counters of 16 bits hold
LANE_TOP = 65_535


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(words: Column) -> Column:
    """Hash of the five words at each place; empty where there are fewer."""
    places = F.sequence(F.lit(0), F.size(words) - WIDTH)
    hashed = F.transform(places, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WIDTH))))
    return F.when(F.size(words) >= WIDTH, hashed).otherwise(F.array().cast("array<bigint>"))


def with_fingerprint(df: DataFrame, hashes: str) -> DataFrame:
    """Adds ``fp``: bit b is 1 if more than half of the shingle occurrences have it.

    Counters are packed four to a long, in lanes of 16 bits, so 16 sums give 64 counters;
    beyond ``LANE_TOP`` shingles two to a long, in lanes of 32 bits.
    """

    def lanes(k: int, mask: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(mask)))

    size = F.size(hashes)
    sums = {f"_s{k}": F.when(size <= LANE_TOP, lanes(k, _LANES)) for k in range(16)}
    sums |= {f"_w{k}": F.when(size > LANE_TOP, lanes(k, _WIDE_LANES)) for k in range(32)}
    df = df.withColumns(sums)
    fp = F.lit(0).cast("long")
    for b in range(64):
        narrow = F.shiftrightunsigned(F.col(f"_s{b % 16}"), 16 * (b // 16)).bitwiseAND(F.lit(0xFFFF))
        wide = F.shiftrightunsigned(F.col(f"_w{b % 32}"), 32 * (b // 32)).bitwiseAND(F.lit(0xFFFFFFFF))
        bit = (1 << b) - (1 << 64 if b == 63 else 0)
        fp = fp.bitwiseOR(F.when(2 * F.coalesce(narrow, wide) > size, F.lit(bit)).otherwise(F.lit(0)).cast("long"))
    return df.withColumn("fp", fp).drop(*sums)


def _block(fp: Column, b: int) -> Column:
    return F.shiftrightunsigned(fp, BLOCK_BITS * b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def items_of(benchmark: DataFrame) -> DataFrame:
    """``(item_id, words, hashes)`` of the items that have a shingle."""
    words = benchmark.select("item_id", word_list(F.col("text")).alias("words"))
    # by the number of words: a filter on the hashes would move below and split the text for each of them
    words = words.where(F.size("words") >= WIDTH)
    return words.select("item_id", F.size("words").alias("length"), shingle_hashes(F.col("words")).alias("hashes"))


def _key(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2")]


def windows(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``(k1, k2, hashes)``: item-sized windows of each text where it shares a shingle with an item."""
    seeds = materialise(items.select("length", F.posexplode("hashes").alias("q", "h")).distinct(), "item-shingles")
    place = docs.select(*_key(text), word_list(F.col(text)).alias("words"))
    # outer: else Spark infers a filter on the hashes, which moves below and splits the text for each of them
    place = place.select("k1", "k2", F.size("words").alias("n"), F.posexplode_outer(shingle_hashes(F.col("words"))).alias("p", "h"))
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.col("n") - F.col("length")))
    laid = place.join(seeds, "h").select("k1", "k2", start.alias("start"), "length").distinct()
    laid = materialise(laid.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "length")).alias("laid")), "windows")
    texts = docs.select(*_key(text), F.col(text).alias("text")).join(laid.select("k1", "k2"), ["k1", "k2"])
    texts = texts.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(laid, ["k1", "k2"])
    cut = texts.select("k1", "k2", word_list(F.col("text")).alias("words"), "laid").select("k1", "k2", "words", F.explode("laid").alias("w"))
    inside = F.slice("words", F.col("w.start") + 1, F.col("w.length"))
    return cut.select("k1", "k2", inside.alias("words")).select("k1", "k2", shingle_hashes(F.col("words")).alias("hashes"))


def near_items(fingerprints: DataFrame, items: DataFrame) -> DataFrame:
    """``(fp, item_id)``: all items within the radius of each fingerprint."""
    flips = [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= FLIPS]
    numbered = F.posexplode(F.array(*(_block(F.col("fp"), b) for b in range(BLOCKS))))
    probes = items.select("item_id", F.col("fp").alias("item_fp"), numbered.alias("block", "value"))
    probes = probes.select("item_id", "item_fp", "block", "value", F.explode(F.lit(flips)).alias("flip"))
    # a table of its own: Spark then joins by its real size, which no estimate of the items tells
    index = materialise(probes.select("item_id", "item_fp", "block", F.col("value").bitwiseXOR(F.col("flip")).alias("value")), "block-index")
    asked = fingerprints.select("fp", numbered.alias("block", "value"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
    return asked.join(index, ["block", "value"]).where(close).select("fp", "item_id").distinct()


def counted(rows: DataFrame, key: list[str], hashes: str = "hashes") -> DataFrame:
    """How often each shingle occurs: ``(key, h, k)``."""
    return rows.select(*key, F.explode(hashes).alias("h")).groupBy(*key, "h").agg(F.count("*").alias("k"))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``(k1, k2, item_id, shared, total)`` of each text that holds a benchmark item: its best window."""
    items = with_fingerprint(items_of(benchmark), "hashes")
    items = materialise(items, "items")
    found = with_fingerprint(windows(docs, items.select("length", "hashes"), text), "hashes")
    # windows with the same words are compared once
    same = F.xxhash64("hashes").alias("w1"), F.xxhash64("hashes", F.lit(1)).alias("w2")
    found = materialise(found.select("k1", "k2", *same, "fp", "hashes"), "fingerprints")
    pairs = materialise(near_items(found.select("fp").distinct(), items.select("item_id", "fp")), "candidates")
    places = found.select("k1", "k2", "w1", "w2", "fp").distinct()
    near = found.join(pairs.select("fp").distinct(), "fp", "left_semi")
    near = near.groupBy("w1", "w2", "fp").agg(F.first("hashes").alias("hashes"))
    near = materialise(near.select("w1", "w2", "fp", F.size("hashes").alias("n"), "hashes"), "near-windows")
    asked = near.select("w1", "w2", "fp", "n").join(pairs, "fp").join(items.select("item_id", F.size("hashes").alias("m")), "item_id")
    per_window = counted(near, ["w1", "w2"])
    per_item = counted(items, ["item_id"]).withColumnRenamed("k", "ki")
    both = asked.select("w1", "w2", "item_id").join(per_window, ["w1", "w2"]).join(per_item, ["item_id", "h"])
    shared = both.groupBy("w1", "w2", "item_id").agg(F.sum(F.least("k", "ki")).cast("int").alias("shared"))
    total = (F.col("n") + F.col("m") - F.col("shared")).alias("total")
    checked = asked.join(shared, ["w1", "w2", "item_id"]).select("w1", "w2", "item_id", "shared", total).where("5 * shared >= 4 * total")
    hits = places.join(materialise(checked, "similar"), ["w1", "w2"])
    return materialise(hits.groupBy("k1", "k2", "item_id").agg(F.max("shared").alias("shared"), F.min("total").alias("total")), "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item; columns unchanged."""
    names = [fresh(docs, n) for n in ("hit1", "hit2")]
    found = contaminated(docs, benchmark, text).select("k1", "k2").distinct().toDF(*names)
    same = (F.xxhash64(docs[text]) == F.col(names[0])) & (F.xxhash64(docs[text], F.lit(1)) == F.col(names[1]))
    return docs.join(found, same, "left_anti")


SQL = """
with norm as (
  select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text is not null),
items as (
  select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from benchmark where text is not null),
item_sh as (
  select item_id, len(w) as n, unnest(range(1, len(w) - 3)) as q, w from items where len(w) >= 5),
item_g as (select item_id, n, q, array_to_string(w[q:q + 4], ' ') as g from item_sh),
doc_sh as (select doc_id, len(w) as n, unnest(range(1, len(w) - 3)) as p, w from norm where len(w) >= 5),
doc_g as (select doc_id, n, p, array_to_string(w[p:p + 4], ' ') as g from doc_sh),
laid as (
  select distinct d.doc_id, greatest(1, least(d.p - i.q + 1, d.n - i.n + 1)) as s, i.n as size
  from doc_g d join item_g i using (g)),
win as (
  select l.doc_id, l.s, l.size, d.g, count(*) as k from laid l join doc_g d on d.doc_id = l.doc_id and d.p between l.s and l.s + l.size - 5 group by all),
win_n as (select doc_id, s, size, sum(k) as n from win group by all),
item_k as (select item_id, n as size, g, count(*) as k from item_g group by all),
item_n as (select item_id, size, sum(k) as n from item_k group by all),
both_ as (
  select w.doc_id, w.s, w.size, i.item_id, sum(least(w.k, i.k)) as shared from win w join item_k i using (g) group by all),
scored as (
  select b.doc_id, b.item_id, b.shared, wn.n + i.n - b.shared as total
  from both_ b join win_n wn on wn.doc_id = b.doc_id and wn.s = b.s and wn.size = b.size join item_n i on i.item_id = b.item_id)
select doc_id, item_id, max(shared)::int as shared, min(total)::int as total from scored where 5 * shared >= 4 * total group by all
"""


@llm_query("op3_simhash_decontamination", SQL)
def op3(spark, sf_dir):
    """Documents that hold a benchmark item, with the shared and total shingle counts of the best window."""
    docs = table(spark, sf_dir, "documents")
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", *_key("text")).join(found, ["k1", "k2"]).select("doc_id", "item_id", "shared", "total")
