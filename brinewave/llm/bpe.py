"""Byte-level BPE as a bounded-lookahead streaming transducer, and its incremental decoder.

Encoding runs in two levels. A lexer cuts the text into pre-tokens; it holds back only
the last one, which later text may extend (and an apostrophe before it). A pre-token is then merged by rank. Whether a
merge happens at some place depends only on merges of higher rank that overlap it on the
right, whose fate in turn depends on still higher ranks: ``sufficient_lookahead`` is the
longest such chain in bytes, computed from the merge list. Once that many bytes follow a
token boundary, nothing that comes later can move it, so the tokens before it are emitted
and forgotten. Restarting at a final boundary is exact, because no merge crosses it.
Memory is therefore constant however long the text or one of its words is: a look-up table
of at most ``MEMO_WORDS`` short words, and a window of twice the lookahead.

Decoding turns ids into bytes and feeds them to an incremental UTF-8 state machine, so a
character split over tokens appears once it is complete, and invalid bytes become U+FFFD.

Defined cases: a null text is empty and gives no ids; added tokens of the file (such as
``<|endoftext|>``) are matched in the text before anything else; repeated rows give equal
results; other columns pass through untouched.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import importlib
import json
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from brinewave.llm.common import fresh, llm_query, schema_with, table

#: at most so many words are remembered by a worker, none longer than WORD_BYTES
MEMO_WORDS = 300_000
WORD_BYTES = 64
#: up to so many bytes are merged one pair at a time
SHORT = 256
NONE = 1 << 60
#: the text is fed to the transducer in pieces of so many characters
PIECE = 1 << 16
#: an unfinished pre-token of more characters than this is streamed, not held
HELD = 1 << 12

# fixed value: the pre-token pattern of byte-level BPE
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RUNS = (
    (regex.compile(r" ?\p{L}+"), regex.compile(r"\p{L}+")),
    (regex.compile(r" ?\p{N}+"), regex.compile(r"\p{N}+")),
    (regex.compile(r" ?[^\s\p{L}\p{N}]+"), regex.compile(r"[^\s\p{L}\p{N}]+")),
)
# the same pattern where every character is below U+0100: the letters, numbers and spaces are known
_L, _N, _S = r"a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9²³¹¼½¾", r"\t-\r \x85\xa0"
_FIND_LATIN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
_FIND = regex.compile(PATTERN).findall
_SPACE = regex.compile(r"\s+")


def pre_tokens(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _FIND(text)
    return _FIND_LATIN(text)


def byte_alphabet() -> dict[str, int]:
    """Printable character of each byte, as byte-level vocabularies write them."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes that must follow a boundary before it is final.

    A merge can be prevented on its right only by a token that begins with a suffix of it
    and was made earlier, by a merge of higher rank; ``reach`` is how far such a chain goes.
    """
    beyond: dict[bytes, int] = {}
    most = 1
    for left, right in merges:
        token = left + right
        further = max((beyond.get(token[i:], 0) for i in range(1, len(token))), default=0)
        reach = len(token) + further
        most = max(most, reach)
        for i in range(1, len(token)):
            head = token[:i]
            if beyond.get(head, 0) < reach - i:
                beyond[head] = reach - i
    return most


class Vocabulary:
    """Merge list and ids of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_alphabet()
        raw = lambda token: bytes(letters[c] for c in token)
        self.ids = {raw(token): i for token, i in spec["model"]["vocab"].items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = [(raw(a), raw(b)) for a, b in pairs]
        # pair of ids, packed, to rank and merged id, packed
        self.ranks = {self.ids[a] << 20 | self.ids[b]: k << 20 | self.ids[a + b] for k, (a, b) in enumerate(self.merges)}
        self.bytes_ids = [self.ids[bytes([b])] for b in range(256)]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*self.ids.values(), *self.added.values()])
        self.pieces = [b""] * size
        for token, i in self.ids.items():
            self.pieces[i] = token
        for token, i in self.added.items():
            self.pieces[i] = token.encode()
        self.lookahead = sufficient_lookahead(self.merges)
        self.split_added = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None

    def merge(self, data: bytes) -> list[int]:
        """Ids of a bounded window of bytes, merged by rank, equal ranks from the left."""
        return self._merge_word(data) if len(data) <= SHORT else self._merge_window(data)

    def _merge_word(self, data: bytes) -> list[int]:
        get, single = self.ranks.get, self.bytes_ids
        ids = [single[b] for b in data]
        ranks = [get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NONE:
            i, new = ranks.index(best), best & 0xFFFFF
            ids[i] = new
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | new, NONE)
            if i < len(ranks):
                ranks[i] = get(new << 20 | ids[i + 1], NONE)
        return ids

    def _merge_window(self, data: bytes) -> list[int]:
        """All places of the best pair in one pass, which suits long windows."""
        get = self.ranks.get
        ids = [self.bytes_ids[b] for b in data]
        while len(ids) > 1:
            pairs = [a << 20 | b for a, b in zip(ids, ids[1:])]
            best, pair = min((get(p, NONE), p) for p in set(pairs))
            if best == NONE:
                break
            new, out, i, last = best & 0xFFFFF, [], 0, len(ids) - 1
            while i <= last:
                if i < last and pairs[i] == pair:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Memo(dict):
    """Packed ids of short words; emptied when full, so its size is bounded."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, word: str) -> bytes:
        data = word.encode()
        if len(data) > WORD_BYTES:
            run = MergeStream(self.vocab)
            return run.feed(data) + run.finish()
        packed = pack(self.vocab.merge(data))
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = packed
        return packed


@functools.lru_cache(maxsize=4)
def memo(path: str) -> _Memo:
    return _Memo(vocabulary(path))


def pack(ids: Iterable[int]) -> bytes:
    ids = list(ids)
    return struct.pack(f"<{len(ids)}I", *ids)


class MergeStream:
    """Merges one pre-token of any length within a window of bytes."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.open = vocab, b""
        self.window = 2 * vocab.lookahead

    def feed(self, data: bytes) -> bytes:
        out = []
        for start in range(0, len(data), self.window):
            self.open += data[start : start + self.window]
            if len(self.open) >= self.window:
                out.append(self._emit(len(self.open) - self.vocab.lookahead))
        return b"".join(out)

    def _emit(self, stable: int) -> bytes:
        """Tokens that end at or before ``stable``; the rest stays open."""
        ids, done = [], 0
        for i in self.vocab.merge(self.open):
            size = len(self.vocab.pieces[i])
            if done + size > stable:
                break
            ids.append(i)
            done += size
        self.open = self.open[done:]
        return pack(ids)

    def finish(self) -> bytes:
        packed, self.open = pack(self.vocab.merge(self.open)), b""
        return packed


class Encoder:
    """Text in pieces to packed little-endian 32-bit ids; added tokens are not looked for."""

    def __init__(self, path: str):
        self.memo, self.vocab = memo(path), vocabulary(path)
        self.held = ""
        self.run: tuple[regex.Pattern | None, MergeStream] | None = None

    def feed(self, text: str, last: bool = False) -> bytes:
        out = []
        if self.run is not None:
            text = self._continue(text, out)
            if self.run is not None:
                if last:
                    out.append(self._close())
                return b"".join(out)
        words = pre_tokens(self.held + text)
        self.held = "" if last or not words else words.pop()
        if len(self.held) == 1 and words and words[-1] == "'":  # may become 'll, 've or 're
            self.held = words.pop() + self.held
        out.append(b"".join(map(self.memo.__getitem__, words)))
        if len(self.held) > HELD:
            self._open(out)
        return b"".join(out)

    def _open(self, out: list[bytes]) -> None:
        """The last pre-token is very long: stream it instead of holding it."""
        stream = MergeStream(self.vocab)
        more = next((again for whole, again in _RUNS if whole.fullmatch(self.held)), None)
        keep = 0 if more else 1  # the last space of a run may belong to the next word
        body, self.held = self.held[: len(self.held) - keep], self.held[len(self.held) - keep :]
        out.append(stream.feed(body.encode()))
        self.run = (more, stream)

    def _continue(self, text: str, out: list[bytes]) -> str:
        """Feed what still belongs to the open run; returns the rest of the text."""
        more, stream = self.run
        if more is not None:
            found = more.match(text)
            end = found.end() if found else 0
            out.append(stream.feed(text[:end].encode()))
            if end == len(text):
                return ""
            out.append(self._close())
            return text[end:]
        text, self.held = self.held + text, ""
        end = _SPACE.match(text).end()
        out.append(stream.feed(text[: end - 1].encode()))
        self.held = text[end - 1 : end]
        if end == len(text):
            return ""
        rest, self.held = self.held + text[end:], ""
        out.append(stream.finish())
        self.run = None
        return rest

    def _close(self) -> bytes:
        _, stream = self.run
        tail = self.held.encode()
        self.run, self.held = None, ""
        return stream.feed(tail) + stream.finish()

    def finish(self) -> bytes:
        return self.feed("", last=True)


def encode_pieces(pieces: Iterable[str], path: str) -> Iterator[bytes]:
    """Packed ids of a text given in pieces, emitted as soon as they are final."""
    encoder = Encoder(path)
    for piece in pieces:
        for start in range(0, len(piece), PIECE):
            yield encoder.feed(piece[start : start + PIECE])
    yield encoder.finish()


def encode(text: str, path: str) -> bytes:
    """Packed ids of a whole text, with the added tokens of the file found in it."""
    vocab = vocabulary(path)
    if vocab.split_added is None or not any(t in text for t in vocab.added):
        return b"".join(encode_pieces([text], path))
    out, at = [], 0
    for found in vocab.split_added.finditer(text):
        out.extend(encode_pieces([text[at : found.start()]], path))
        out.append(pack([vocab.added[found[0]]]))
        at = found.end()
    out.extend(encode_pieces([text[at:]], path))
    return b"".join(out)


def decode_pieces(packed: bytes, path: str, step: int = PIECE) -> Iterator[str]:
    """Text of packed ids, in pieces: a UTF-8 state machine carries split characters over."""
    pieces = vocabulary(path).pieces
    state = codecs.getincrementaldecoder("utf-8")("replace")
    ids = np.frombuffer(packed, "<u4")
    for start in range(0, len(ids), step):
        yield state.decode(b"".join(map(pieces.__getitem__, ids[start : start + step].tolist())))
    yield state.decode(b"", True)


def default_path() -> str:
    return importlib.import_module("public_tokenizers").path("byte_bpe_50k.json")


def tokenize(docs: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with ``ids`` (packed little-endian 32-bit ids) and ``decoded`` (their text)."""
    path = path or default_path()
    at = docs.columns.index(text)
    schema = schema_with(docs, **{ids: "binary", decoded: "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [encode(t or "", path) for t in batch.column(at).to_pylist()]
            texts = ["".join(decode_pieces(p, path)) for p in packed]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary()), pa.array(texts, pa.string())], [*batch.schema.names, ids, decoded])

    return docs.mapInArrow(run, schema)


def token_digest(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 in place of the text, prefixed where taken.

    The digests are taken where the ids are made: neither ids nor texts leave the worker.
    """
    path = path or default_path()
    at = docs.columns.index(text)
    kept = [c for c in docs.columns if c != text]
    rest_of = docs.select(*kept)
    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = schema_with(rest_of, **{fresh(rest_of, k): kind for k, kind in kinds.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for t in batch.column(at):
                packed = encode(t.as_py() or "", path)
                counts.append(len(packed) // 4)
                ids_hex.append(hashlib.sha256(packed).hexdigest())
                state = hashlib.sha256()
                for piece in decode_pieces(packed, path):
                    state.update(piece.encode())
                text_hex.append(state.hexdigest())
            rest = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(counts, pa.int64()), pa.array(ids_hex), pa.array(text_hex)], schema.names)

    return docs.mapInArrow(run, schema)


@llm_query("op7_bpe_transducer")
def op7(spark, sf_dir):
    """Ids and decoded text of every document, as digests."""
    return token_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))
