"""Alignment of two tokenizations of the same text, by whitespace-token anchors.

Tokenizer A is a byte-level BPE file, applied to a space and the text; tokenizer B is a
piece model that puts the space there itself. Both cover the same bytes, so a token is a
byte range. After both have run over the whole text, every place where a space-marked
token begins in A and in B alike is an anchor: the tokens before it end there in both, and
nothing that overlaps lies across it. Anchors cut a document into windows, pairs of id
tuples. What happens inside a window depends on nothing but its ids, so it is worked out
once and remembered under them: its groups (cut where both end) and its links (pairs of
tokens whose ranges overlap). The windows of a batch that are new are laid end to end and
worked out together from the sorted ends of their tokens.

A worker remembers at most ``MEMO`` windows of at most ``MEMO_TOKENS`` tokens; a full table is
emptied, so its memory is bounded whatever it reads.

Corpus counts are plain Spark: a row for each distinct linked id pair of a document, a count
for each pair (pre-aggregated in the tasks, so frequent pairs travel once per task), and a
join back. The counts grow with the vocabulary, so the join is a shuffled one at every size; Spark
splits its partitions where a pair is hot.

Texts of up to ``WHOLE`` characters go through compiled tokenizers at once. Longer ones keep
memory bounded: A's merges run in the streaming transducer of ``bpe``, and B reads word by
word: no piece of the model holds a space mark after another character, so no merge crosses
the place before a run of spaces, and the runs that begin there are tokenized one by one.
This, and that the model leaves characters alone, is checked when it is loaded; a model
without these properties is run on whole texts.

Defined cases: null and empty texts, and those whose tokens do not give back the bytes of
space and text in both, have no tokens: zeros and an empty digest; control strings in a text
are plain text; every row counts as a document, repeated rows and null ids included; an
empty table gives no rows; other columns pass through, new ones get fresh names.
"""

from __future__ import annotations

import functools
import hashlib
import importlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brinewave.llm import bpe
from brinewave.llm.common import fresh, llm_query, materialise, slices, table

MEMO, MEMO_TOKENS = 300_000, 48
#: characters of a text that is tokenized at once
WHOLE = 1 << 17
MARK = "▁"
# a run of spaces and what follows it up to the next space
_RUN = re.compile(r" +[^ ]*")


def default_paths() -> tuple[str, str]:
    path = importlib.import_module("public_tokenizers").path
    return path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


class ByteModel:
    """Ids of a byte-level BPE file, and the bytes each id stands for."""

    def __init__(self, path: str):
        self.path, vocab = path, bpe.vocabulary(path)
        self.pieces = vocab.pieces
        self.marked = np.array([p[:1] == b" " for p in self.pieces])
        # the compiled library takes ids for ranks
        ranks = {t: i for t, i in vocab.ids.items() if vocab.added.get(t.decode("utf-8", "replace")) != i}
        in_order = all(ranks.get(x + y) == 256 + k for k, (x, y) in enumerate(vocab.merges)) and len(ranks) == 256 + len(vocab.merges)
        library = importlib.import_module("tiktoken")
        self.model = library.Encoding("byte-bpe", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_order else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; control strings are plain text."""
        short = lambda t: self.model is not None and len(t) <= WHOLE
        return [self.model.encode_to_numpy(t, disallowed_special=()).tobytes() if short(t) else b"".join(bpe.encode_pieces([t], self.path)) for t in texts]


class PieceModel:
    """Ids of a piece model, and the bytes each id stands for."""

    def __init__(self, path: str):
        self.model = importlib.import_module("sentencepiece").SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.marked = np.array([n.startswith(MARK) for n in names])
        self.pieces = [
            bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)
        ]
        inner = any(MARK in n.lstrip(MARK) for n in names)
        odd = "a  b ﬁ ① \t\n ́x\r\n  한한 "
        self.by_words = not inner and self.model.normalize(odd) == (MARK + odd.replace(" ", MARK))

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.model.encode([t[1:] for t in texts], num_threads=1)
        # nothing is added to an empty text: a space alone is its own piece
        return [np.array(ids if t != " " else [self.model.piece_to_id(MARK)], "<u4").tobytes() for t, ids in zip(texts, found)]

    def _long(self, text: str) -> bytes:
        runs = _RUN.findall(text)
        known = sorted(set(runs))
        return b"".join(map(dict(zip(known, self._ids(known))).__getitem__, runs))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, which begins with the space the model adds itself."""
        long = [self.by_words and len(t) > WHOLE and MARK not in t for t in texts]
        at_once = iter(self._ids([t for t, x in zip(texts, long) if not x]))
        return [self._long(t) if x else next(at_once) for t, x in zip(texts, long)]


class Pieces:
    """The bytes of all ids, end to end."""

    def __init__(self, pieces: list[bytes], marked: np.ndarray):
        self.marked, self.size = marked, np.array([len(p) for p in pieces])
        self.first = np.cumsum(self.size) - self.size
        self.whole = np.frombuffer(b"".join(pieces), np.uint8)

    def spell(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.whole[np.arange(int(size.sum())) + np.repeat(self.first[ids] - ends + size, size)]


#: text of the groups of a window, each ended by ";", and its links: A's id in the upper 32 bits, B's in the lower, packed
Window = tuple[str, bytes]


#: stands between the ids of A and those of B in the key of a window
BETWEEN = 0xFFFFFFFF


def window_keys(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> list[bytes]:
    """The id tuples of all windows: ids of A, ``BETWEEN``, ids of B."""
    n = np.arange(len(last_a))
    out = np.full(len(a) + len(b) + len(n), BETWEEN, np.uint32)
    size_a, size_b = np.diff(last_a, prepend=0), np.diff(last_b, prepend=0)
    out[np.arange(len(a)) + np.repeat(last_b - size_b + n, size_a)] = a
    out[np.arange(len(b)) + np.repeat(last_a + n + 1, size_b)] = b
    packed, cut = out.tobytes(), (4 * (last_a + last_b + n + 1)).tolist()
    return [packed[i:j] for i, j in zip([0, *cut], cut)]


class Aligner:
    """Both tokenizers and the remembered windows of one worker."""

    def __init__(self, a_path: str, b_path: str):
        self.models = ByteModel(a_path), PieceModel(b_path)
        self.a, self.b = (Pieces(m.pieces, m.marked) for m in self.models)
        # every id as text, followed by each of the separators
        most = max(len(self.a.size), len(self.b.size))
        self.names = [f"{i}{mark}" for i in range(most) for mark in ",|;"]
        self.name_sizes = np.array([len(n) for n in self.names])
        self.windows: dict[bytes, Window] = {}

    def tokens(self, texts: list[str | None]) -> tuple[list[tuple[bytes, bytes]], np.ndarray]:
        """Packed ids of A and B of every text, and the bytes they cover; none where they do not cover space and text."""
        whole = [" " + t if t else "" for t in texts]
        data = [w.encode() for w in whole]
        sizes = np.array([len(d) for d in data], np.int64)
        asked = [w for w in whole if w]
        found = [dict(zip([i for i, w in enumerate(whole) if w], m.encode(asked))) for m in self.models]
        good = sizes > 0
        for ids_of, pieces in zip(found, (self.a, self.b)):
            for i in np.flatnonzero(good).tolist():
                good[i] = pieces.size[np.frombuffer(ids_of[i], "<u4")].sum() == sizes[i]
            fits = np.flatnonzero(good)
            if len(fits):
                ids = np.frombuffer(b"".join([ids_of[i] for i in fits.tolist()]), "<u4")
                differs = pieces.spell(ids, np.cumsum(pieces.size[ids])) != np.frombuffer(b"".join([data[i] for i in fits.tolist()]), np.uint8)
                good[fits] = np.add.reduceat(differs, np.cumsum(sizes[fits]) - sizes[fits]) == 0
        return [(found[0][i], found[1][i]) if g else (b"", b"") for i, g in enumerate(good.tolist())], np.where(good, sizes, 0)

    def __call__(self, texts: list[str | None]) -> list[tuple[bytes, bytes, list[Window]]]:
        """Packed ids of A and B and the windows in order, of every text."""
        found, sizes = self.tokens(texts)
        all_a, all_b = (b"".join([f[k] for f in found]) for k in (0, 1))
        a, b = np.frombuffer(all_a, "<u4"), np.frombuffer(all_b, "<u4")
        end_a, end_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        ends = np.cumsum(sizes)
        marks = np.zeros(int(sizes.sum()) + 1, np.uint8)
        marks[(end_a - self.a.size[a])[self.a.marked[a]]] = 1
        marks[(end_b - self.b.size[b])[self.b.marked[b]]] += 1
        marks[ends] = 2  # every text begins a window
        anchors = np.flatnonzero(marks == 2)
        anchors = anchors[anchors > 0]
        keys = window_keys(a, b, np.searchsorted(end_a, anchors) + 1, np.searchsorted(end_b, anchors) + 1)
        windows = list(map(self.windows.get, keys))
        if None in windows:
            new = dict.fromkeys([k for k, w in zip(keys, windows) if w is None])
            made = dict(zip(new, self.align(list(new))))
            windows = [w or made[k] for k, w in zip(keys, windows)]
            short = {k: w for k, w in made.items() if len(k) <= 4 * MEMO_TOKENS}
            if len(self.windows) + len(short) > MEMO:
                self.windows.clear()
            self.windows.update(itertools.islice(short.items(), MEMO))
        last = np.searchsorted(anchors, ends, side="right").tolist()
        return [(f[0], f[1], windows[i:j]) for f, i, j in zip(found, [0, *last], last)]

    def align(self, keys: list[bytes]) -> list[Window]:
        """Groups and links of windows not seen before, laid end to end."""
        ids = np.frombuffer(b"".join(keys), "<u4").astype(np.int64)
        middle, end = np.flatnonzero(ids == BETWEEN), np.cumsum([len(k) // 4 for k in keys])
        of_a = np.cumsum(np.bincount(middle + 1, minlength=len(ids) + 1)[:-1] - np.bincount(end, minlength=len(ids) + 1)[:-1]) == 0
        a, b = ids[of_a & (ids != BETWEEN)], ids[~of_a]
        start = np.concatenate([[0], end[:-1]])
        last_a, last_b = np.cumsum(middle - start), np.cumsum(end - middle - 1)
        size_a, size_b = self.a.size[a], self.b.size[b]
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        # a group ends where both do
        at = np.searchsorted(end_b, end_a)
        closes_a = end_b[at] == end_a
        closes_b = np.zeros(len(b), bool)
        closes_b[at[closes_a]] = True
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        first_b = np.flatnonzero(np.concatenate([[True], closes_b[:-1]]))  # of each group
        after_a = np.flatnonzero(closes_a) + 1
        # text of the groups: A's tokens of a group, then B's
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + first_b[group_a]] = 3 * a + closes_a
        codes[np.arange(len(b)) + after_a[group_b]] = 3 * b + 2 * closes_b
        text = "".join(map(self.names.__getitem__, codes.tolist()))
        cut = np.cumsum(self.name_sizes[codes])[last_a + last_b - 1].tolist()
        # tokens of B that begin before a token of A ends and end after it begins
        low, high = np.searchsorted(end_b, end_a - size_a, side="right"), np.searchsorted(end_b - size_b, end_a)
        n = high - low
        until = np.cumsum(n)
        mate = np.arange(until[-1]) - np.repeat(until - n - low, n)
        links = (np.repeat(a, n) << 32 | b[mate]).astype("<i8").tobytes()
        cut_links = (8 * until[last_a - 1]).tolist()
        return [(text[i:j], links[k:m]) for i, j, k, m in zip([0, *cut], cut, [0, *cut_links], cut_links)]


@functools.lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def alignments(docs: DataFrame, text: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with a_ids, b_ids and groups: how many tokens of A and of B each group takes, in order."""
    paths = paths or default_paths()
    at = docs.columns.index(text)
    more = StructType.fromDDL(f"{fresh(docs, 'a_ids')} array<int>, {fresh(docs, 'b_ids')} array<int>, {fresh(docs, 'groups')} array<array<int>>")
    schema = StructType([*docs.schema.fields, *more.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(*paths)
        for batch in slices(batches, text, 1 << 20):
            found = align(batch.column(at).to_pylist())
            ids = [pa.array([np.frombuffer(f[k], "<i4") for f in found], pa.list_(pa.int32())) for k in (0, 1)]
            sizes = lambda g: [side.count(",") + 1 for side in g.split("|")]
            groups = pa.array([[sizes(g) for w in f[2] for g in w[0].split(";")[:-1]] for f in found], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *ids, groups], schema.names)

    return docs.mapInArrow(run, schema)


DIGEST = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def digests(docs: DataFrame, key: str, text: str, paths: tuple[str, str]) -> DataFrame:
    """``(key, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times)``: distinct linked pairs and how often.

    A pair is A's id in the upper 32 bits and B's in the lower.
    """
    names = [c.split()[0] for c in DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(*paths)
        for batch in slices(batches, "text", 1 << 20):
            out = [[] for _ in names]
            for packed_a, packed_b, windows in align(batch.column(1).to_pylist()):
                groups = "".join([w[0] for w in windows])
                state = hashlib.sha256(groups[:-1].encode()).hexdigest() if windows else ""
                links = np.frombuffer(b"".join([w[1] for w in windows]), "<i8")
                pairs, times = np.unique(links, return_counts=True)
                row = len(packed_a) // 4, len(packed_b) // 4, groups.count(";"), len(links), state, pairs, times.astype(np.int32)
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], ["key", *names])

    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, f"key {dict(chosen.dtypes)['key']}, {DIGEST}")


def pair_counts(linked: DataFrame) -> DataFrame:
    """``(pair, n, best)`` of ``(row, pair)``: documents that hold a pair linked, and whether its A id has no higher one."""
    counts = materialise(linked.groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    joined = counts.join(top, F.shiftright("pair", 32) == F.col("a"))
    return materialise(joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-best")


def aligned_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """``(key, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum)`` of every row of ``docs``."""
    # rows get a number of their own, which the written table keeps
    rows = digests(docs, key, text, paths or default_paths()).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows, "alignments")
    linked = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = pair_counts(linked.select("row", "pair"))
    best, total = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)), F.sum(F.col("times") * F.col("n"))
    sums = linked.join(counts.hint("shuffle_hash"), "pair").groupBy("row").agg(best.alias("n_best"), total.alias("count_sum"))
    whole = rows.drop("pairs", "times").join(sums, "row", "left").drop("row")
    return whole.fillna(0, ["n_best", "count_sum"])


@llm_query("op13_whitespace_anchors")
def op13(spark, sf_dir):
    """Tokens, groups and links of every document under two tokenizers, with corpus-wide link counts."""
    found = aligned_counts(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
