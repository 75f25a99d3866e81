"""Product codes of vectors, trained and assigned in whole numbers by an integer Walsh-Hadamard transform.

A component x becomes floor(256 * x). Vectors are cut into ``PARTS`` equal consecutive
parts; every part position has a codebook of up to ``ENTRIES`` entries, refined in
``ROUNDS`` rounds of nearest entry and componentwise floor(sum / count).

The nearest entry is found in the transformed space. Parts and entries are padded with
zeros to a power of two P and multiplied by the Walsh-Hadamard matrix, whose rows are
ordered by the number of sign changes (sequency). The matrix is orthogonal up to the
factor P, so the squared differences of the coefficients sum to P times the squared
distance: all of it in 64-bit integers. The coefficients are taken one by one, low
sequency first, where most of the difference lies. The entry that is nearest by the first
coefficient gives a bound; an entry whose partial sum exceeds the best full sum known can
no longer be nearest and is dropped. Sums only grow, and an equal sum is never dropped, so
the result is exactly the nearest entry, ties to the lower index.

Spark does the rest: each task reduces its rows to one row per (part, entry) that has any,
these are summed, and codebooks (ENTRIES x dimension integers) are all that the driver
holds. No row depends on the partitioning, so lost tasks are simply run again.

Defined cases: a null vector, or one with a null or non-finite component, is dropped;
vectors of other lengths are padded with zeros to the longest one, rounded up to a multiple
of ``PARTS`` (an empty one is all zeros); a component beyond +-``LARGEST`` after scaling
raises ``OverflowError``, because its squares would leave 64 bits; the starting entries are
those of the smallest distinct ids, a null id last, and of several rows with one id the
lexicographically smallest; fewer ids give fewer entries; repeated rows count each; null
labels are one label; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewave.llm.common import llm_query, materialise, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: largest absolute component after scaling; 2**11 components then stay within 64 bits
LARGEST = 1 << 24


def sequency_matrix(size: int) -> np.ndarray:
    """Walsh-Hadamard matrix of a power of two, rows in the order of their sign changes."""
    rows = np.ones((1, 1), np.int64)
    while len(rows) < size:
        rows = np.block([[rows, rows], [rows, -rows]])
    changes = (rows[:, 1:] != rows[:, :-1]).sum(axis=1)
    return rows[np.argsort(changes)]


def transform(parts: np.ndarray) -> np.ndarray:
    """Coefficients of parts (last axis), padded with zeros to a power of two, in sequency order."""
    width = parts.shape[-1]
    size = 1 << max(0, width - 1).bit_length()
    return parts @ sequency_matrix(size)[:, :width].T


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each part, both in coefficients.

    ``parts`` is n x P and ``entries`` k x P; the distance is divided by P again.
    """
    n, size = parts.shape
    rows = np.arange(n)
    gap = parts[:, :1] - entries[None, :, 0]
    partial = gap * gap
    guess = partial.argmin(axis=1)
    bound = ((parts - entries[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(partial <= bound[:, None])
    left = partial[row, entry]
    for k in range(1, size):
        gap = parts[row, k] - entries[entry, k]
        left = left + gap * gap
        alive = left <= bound[row]
        row, entry, left = row[alive], entry[alive], left[alive]
    # rows come in order, and each keeps at least the entry of its bound
    first = np.searchsorted(row, rows)
    best = np.minimum.reduceat(left, first) if n else left
    hit = np.flatnonzero(left == best[row])
    index = entry[hit[np.searchsorted(row[hit], rows)]]
    return index, best // size


def whole_vectors(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, their scaled integer vectors): rows without a null or a non-finite component."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    row = np.repeat(np.arange(len(sizes)), sizes)
    good = np.asarray(pc.is_valid(column)).astype(bool)
    good[row[~np.isfinite(flat)]] = False
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = np.flatnonzero(good)
    inside = good[row]
    scaled = np.floor(flat[inside] * SCALE)
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise OverflowError(f"a component exceeds {LARGEST} after scaling by {SCALE}")
    out = np.zeros((len(kept), length), np.int64)
    out[(np.cumsum(good) - 1)[row[inside]], place[inside]] = scaled.astype(np.int64)
    return kept, out


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """``(id, x, label)`` of the rows whose vector is whole."""
    kept = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("x"), F.col(label).alias("label"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return kept.where(F.col("x").isNotNull() & ~bad)


def starting_entries(kept: DataFrame, length: int) -> np.ndarray:
    """Entries x PARTS x width: the vectors of the smallest distinct ids."""
    whole = F.concat("x", F.array_repeat(F.lit(0.0), F.lit(length) - F.size("x")))
    scaled = F.transform(whole, lambda v: F.floor(v * SCALE))
    last = F.col("id").isNull()
    found = kept.select("id", scaled.alias("v")).groupBy("id").agg(F.min("v").alias("v")).orderBy(last, "id").limit(ENTRIES)
    return np.array([r["v"] for r in found.collect()], np.int64).reshape(-1, PARTS, length // PARTS)


def partial_sums(kept: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``(part, entry, n, s)``: number and componentwise sum of the parts nearest to each entry, per task."""
    count, _, width = codebooks.shape
    coefficients = transform(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((PARTS, count), np.int64)
        total = np.zeros((PARTS, count, width), np.int64)
        for batch in batches:
            _, v = whole_vectors(batch.column(0), PARTS * width)
            v = v.reshape(-1, PARTS, width)
            for p in range(PARTS):
                index, _ = nearest(transform(v[:, p]), coefficients[:, p])
                n[p] += np.bincount(index, minlength=count)
                np.add.at(total[p], index, v[:, p])
        part, entry = np.nonzero(n)
        sums = pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), sums], ["part", "entry", "n", "s"])

    return kept.select("x").mapInArrow(run, "part int, entry int, n long, s array<long>")


def refined(kept: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Codebooks after one round; an entry without parts stays."""
    width = codebooks.shape[2]
    sums = [F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(width)]
    found = partial_sums(kept, codebooks).groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums)
    out = codebooks.copy()
    for r in found.collect():  # at most PARTS x ENTRIES rows
        out[r["entry"], r["part"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def codes(kept: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``(id, label, code, error)``: one byte for each part, and the summed squared distance."""
    width = codebooks.shape[2]
    coefficients = transform(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("x")
            _, v = whole_vectors(batch.column(at), PARTS * width)
            v = v.reshape(-1, PARTS, width)
            code = np.zeros((len(v), PARTS), np.uint8)
            error = np.zeros(len(v), np.int64)
            for p in range(PARTS):
                code[:, p], distance = nearest(transform(v[:, p]), coefficients[:, p])
                error += distance
            packed = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, pa.array(error)], ["id", "label", "code", "error"])

    kind = dict(kept.dtypes)
    return kept.select("id", "label", "x").mapInArrow(run, f"id {kind['id']}, label {kind['label']}, code binary, error long")


def decode(code: bytes, codebooks: np.ndarray) -> np.ndarray:
    """The scaled integer vector that a code stands for."""
    return codebooks[np.frombuffer(code, np.uint8), np.arange(PARTS)].reshape(-1)


def codebook_text(codebooks: np.ndarray) -> str:
    """All entries' components by part, entry and position."""
    return ",".join(map(str, codebooks.transpose(1, 0, 2).reshape(-1).tolist()))


def train(kept: DataFrame) -> np.ndarray | None:
    """Codebooks (entries x parts x width) of ``usable`` rows; None where there are none."""
    longest = kept.agg(F.max(F.size("x")).alias("n")).first()["n"]
    if longest is None:
        return None
    codebooks = starting_entries(kept, max(PARTS, -(-longest // PARTS) * PARTS))
    for _ in range(ROUNDS):
        codebooks = refined(kept, codebooks)
    return codebooks


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """``(id, label, code, error)`` of every whole vector, and the codebooks."""
    kept = usable(vectors, vec_id, embedding, label)
    codebooks = train(kept)
    if codebooks is None:
        return kept.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), None
    return codes(kept, codebooks), codebooks


_SCALED = f"""
kept as materialized (
  select row_number() over () as rid, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
comp as materialized (
  select rid, (i // (len(v) // {PARTS}))::int as part, (i % (len(v) // {PARTS}))::int as pos, v[i + 1] as x
  from (select rid, v, unnest(range(0, len(v))) as i from kept)),
ids as (
  select vec_id, min(v) as v, row_number() over (order by vec_id nulls last) as e from kept group by vec_id),
c0 as (
  select e, (i // (len(v) // {PARTS}))::int as part, (i % (len(v) // {PARTS}))::int as pos, v[i + 1] as x
  from (select e, v, unnest(range(0, len(v))) as i from ids where e <= {ENTRIES}))"""


def _assign(name: str, book: str) -> str:
    return f""",
{name} as materialized (
  select rid, part, min(d * {2 * ENTRIES} + e) % {2 * ENTRIES} as e, min(d * {2 * ENTRIES} + e) // {2 * ENTRIES} as d from (
    select c.rid, c.part, b.e, sum((c.x - b.x) * (c.x - b.x))::bigint as d
    from comp c join {book} b on b.part = c.part and b.pos = c.pos group by all)
  group by rid, part)"""


def _refine(name: str, book: str, assigned: str) -> str:
    return f""",
{name}_sum as materialized (
  select a.e, c.part, c.pos, sum(c.x)::bigint as s, count(*)::bigint as n
  from {assigned} a join comp c on c.rid = a.rid and c.part = a.part group by all),
{name} as materialized (
  select e, part, pos, (s - ((s % n) + n) % n) // n as x from {name}_sum
  union all
  select e, part, pos, x from {book} b
  where not exists (select 1 from {name}_sum s where s.e = b.e and s.part = b.part and s.pos = b.pos))"""


SQL = (
    "with"
    + _SCALED
    + "".join(_assign(f"a{k}", f"c{k}") + _refine(f"c{k + 1}", f"c{k}", f"a{k}") for k in range(ROUNDS))
    + _assign("last", f"c{ROUNDS}")
    + f""",
book as (select sha256(string_agg(x::varchar, ',' order by part, e, pos)) as h from c{ROUNDS}),
coded as (
  select k.vec_id, k.label, string_agg(lower(printf('%02x', l.e::int - 1)), '' order by l.part) as code, sum(l.d)::bigint as error
  from kept k join last l on l.rid = k.rid group by k.rid, k.vec_id, k.label)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, (select h from book) as codebooks_sha256 from coded
"""
)


@llm_query("op11_walsh_vector_codes", SQL)
def op11(spark, sf_dir):
    """Code and error of every whole vector, the error of its label, and the codebooks' digest."""
    found, codebooks = compress(table(spark, sf_dir, "embeddings"))
    digest = "" if codebooks is None else hashlib.sha256(codebook_text(codebooks).encode()).hexdigest()
    found = materialise(found, "vector-codes")
    # a table of its own: Spark then joins by its real size
    sums = materialise(found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same"), "label-errors")
    joined = found.join(sums, F.col("label").eqNullSafe(F.col("same")))
    return joined.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
