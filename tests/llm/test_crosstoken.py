"""Cross-tokenizer alignment against byte offsets compared token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from brinewave.llm import crosstoken as ct
from brinewave.llm.common import LLM_QUERIES

PATHS = ct.default_paths()
TEXTS = [
    None, "", " ", "\n", "a", "  two  spaces ", "Hello world, it's 2024!", "tab\tand\nline\r\n", "naïve café 한국어 日本語 🙂🙂",
    "<|endoftext|> and <s> </s> <unk> <0x41>", "a▁b ▁ mark", "x" * 500, " " * 300, "ab́ é", " no break", "\x00\x01 nul",
    "Hello world, it's 2024!", "Hello world", "world Hello", "!!!??? ...", "ﬁne ① ² text", "a " * 400, "trailing   ",
]


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def brute(texts):
    a_tok, b_tok = libraries()
    from brinewave.llm.bpe import vocabulary

    pieces = vocabulary(PATHS[0]).pieces
    name = lambda i: bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()
    rows, docs_with = [], Counter()
    for t in texts:
        ids = [a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)] if t else [[], []]
        parts = [[pieces[i] for i in ids[0]], [name(i) for i in ids[1]]]
        if not t or any(b"".join(p) != (" " + t).encode() for p in parts):
            rows.append(([], [], [], []))
            continue
        spans = []
        for p in parts:
            ends = np.cumsum([len(x) for x in p]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends)))
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, start = [], 0
        for e in both:
            groups.append([[i for i, (s, f) in zip(ids[k], spans[k]) if start <= s and f <= e] for k in (0, 1)])
            start = e
        links = [(x, y) for x, (s, e) in zip(ids[0], spans[0]) for y, (u, v) in zip(ids[1], spans[1]) if s < v and u < e]
        docs_with.update(set(links))
        rows.append((ids[0], ids[1], groups, links))
    top = defaultdict(int)
    for (x, _), n in docs_with.items():
        top[x] = max(top[x], n)
    out = []
    for a, b, groups, links in rows:
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        counts = [docs_with[p] for p in links]
        best = sum(n == top[x] for n, (x, _) in zip(counts, links))
        out.append((len(a), len(b), len(groups), len(links), best, sum(counts), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


def random_texts(n, seed):
    rng = random.Random(seed)
    words = ["the", "alignment", "of", " ", "\n", "un", "believable", "é", "日本", "1,234", "'s", "🙂", "\t", "xqzj", "  ", "-", "▁"]
    return ["".join(rng.choice(words) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_whole_query_against_brute_force(spark, tmp_path):
    texts = TEXTS + random_texts(80, 3)
    rows = [(i if i % 7 else None, t, 1, 2, "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n int, row int, pairs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = LLM_QUERIES["op13_whitespace_anchors"](spark, str(tmp_path)).collect()
    want = [(i if i % 7 else None, *w) for i, w in enumerate(brute(texts))]
    plain = lambda r: tuple(map(str, r))
    names = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert sorted(plain([r[c] for c in names]) for r in got) == sorted(map(plain, want))


def test_words_equal_whole_texts():
    _, b = libraries()
    model = ct.PieceModel(PATHS[1])
    assert model.by_words
    for t in [t for t in TEXTS if t] + random_texts(300, 4):
        assert np.frombuffer(model.encode([" " + t])[0], "<u4").tolist() == b.encode(t)
        if ct.MARK not in t:
            assert np.frombuffer(model._long(" " + t), "<u4").tolist() == b.encode(t)


def test_long_texts_take_the_streaming_ways(monkeypatch):
    texts = [t for t in TEXTS if t] + random_texts(100, 8)
    whole = ct.Aligner(*PATHS)(texts)
    monkeypatch.setattr(ct, "WHOLE", 10)
    assert ct.Aligner(*PATHS)(texts) == whole


def test_a_model_that_needs_whole_texts(monkeypatch):
    model = ct.PieceModel(PATHS[1])
    monkeypatch.setattr(ct, "WHOLE", 1)
    model.by_words = False
    assert np.frombuffer(model.encode([" two  words"])[0], "<u4").tolist() == model.model.encode("two  words")


def test_memory_of_windows_is_bounded(monkeypatch):
    monkeypatch.setattr(ct, "MEMO", 20)
    align = ct.Aligner(*PATHS)
    texts = random_texts(60, 5) + ["y" * 5000]
    first = align(texts)
    again = [align([t])[0] for t in reversed(texts)][::-1]
    assert first == again
    assert len(align.windows) <= 20


@pytest.mark.parametrize("text", ["one two three", "a  b", "Zürich\nx"])
def test_alignments_cover_all_tokens(spark, text):
    frame = spark.createDataFrame([(1, text, "kept")], "id int, text string, a_ids string")
    row = ct.alignments(frame).first()
    assert row["a_ids"] == "kept"
    found = row.asDict()
    assert sum(g[0] for g in found["groups"]) == len(found["_a_ids"])
    assert sum(g[1] for g in found["groups"]) == len(found["b_ids"])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert LLM_QUERIES["op13_whitespace_anchors"](spark, str(tmp_path)).collect() == []


def test_very_long_text(spark):
    text = "lorem ipsum dolor " * 40_000 + "z" * 50_000
    frame = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r["key"]: r for r in ct.aligned_counts(frame).collect()}
    assert got[2]["n_a"] == 0 and got[2]["groups_sha256"] == "" and got[2]["count_sum"] == 0
    assert got[1]["n_best"] == got[1]["n_links"] > 120_000 and got[1]["count_sum"] == got[1]["n_links"]
