"""The transducer against the tokenizers library, and its own invariants."""

import hashlib
import random

import pytest

from brinewave.llm import bpe
from brinewave.llm.common import prepare

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.default_path()
ODD = " \n\t  \x1c\x85aAéßñ١२½中'’s<|>\U0001F600é​0129--==__"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def ids(library, text):
    return bpe.pack(library.encode(text, add_special_tokens=False).ids)


def test_random_texts(library):
    r = random.Random(1)
    for _ in range(1500):
        text = "".join(r.choice(ODD) for _ in range(r.randint(0, 60))) + r.choice(["", "<|endoftext|>", "'ll don't"]) + r.choice(ODD)
        packed = bpe.encode(text, PATH)
        assert packed == ids(library, text), repr(text)
        assert "".join(bpe.decode_pieces(packed, PATH, 1)) == text


@pytest.mark.parametrize("text", ["a" * 30000, "ab" * 9000 + " " + "x" * 20000, "=" * 9000, "\n" * 9000 + "z", " " * 70000, "the" * 9000 + "1" * 9000])
def test_long_runs(library, text):
    assert bpe.encode(text, PATH) == ids(library, text)


def test_pieces_do_not_matter(library):
    r = random.Random(2)
    text = "".join(r.choice("etaoin shr\n dlu'll ") for _ in range(20000)) + "q" * 9000 + " " * 9000 + "end"
    for size in (1, 7, 1000):
        pieces = (text[i : i + size] for i in range(0, len(text), size))
        assert b"".join(bpe.encode_pieces(pieces, PATH)) == ids(library, text)


def test_memory_of_an_endless_word_is_bounded():
    stream = bpe.MergeStream(bpe.vocabulary(PATH))
    for _ in range(20):
        stream.feed(b"abcdefgh" * 1000)
        assert len(stream.open) < 2 * stream.window


def test_decoder_replaces_broken_bytes(library):
    vocab = bpe.vocabulary(PATH)
    broken = [vocab.ids[b"\xc3"], vocab.ids[b"a"], vocab.ids[b"\xa9"], vocab.ids[b"\xf0"]]
    assert "".join(bpe.decode_pieces(bpe.pack(broken), PATH)) == library.decode(broken, skip_special_tokens=False)


def test_table_with_nulls_and_clashing_columns(spark):
    prepare(spark)
    rows = [(1, None, "x"), (2, "", "y"), (None, "a b", "z"), (2, "a b", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    found = sorted(map(tuple, bpe.token_digest(df).collect()), key=str)
    empty = hashlib.sha256(b"").hexdigest()
    assert [r[2] for r in found].count(0) == 2 and all(r[3] == empty for r in found if r[2] == 0)
    assert len({r[3:] for r in found if r[2] == 2}) == 1
    assert bpe.token_digest(df.limit(0)).count() == 0
    got = bpe.tokenize(df).collect()
    assert all((r.decoded or "") == (r.text or "") for r in got)
