"""Product codes against brute force in Python integers."""

import math
import random

import numpy as np
import pytest

from brinewave.llm import vectorcode as vc


def brute(rows, length):
    """rows of (id, vector) -> (codes, errors, codebooks), all by definition."""
    width = length // vc.PARTS
    kept = [(i, x) for i, x in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    whole = [[math.floor(v * 256) for v in x] + [0] * (length - len(x)) for _, x in kept]
    cut = [[w[p * width : (p + 1) * width] for p in range(vc.PARTS)] for w in whole]
    first = {}
    for (i, _), w in zip(kept, cut):
        first[i] = min(first.get(i, w), w)
    ids = sorted((i for i in first if i is not None)) + [None] * (None in first)
    books = [[first[i][p] for i in ids[: vc.ENTRIES]] for p in range(vc.PARTS)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda c, p: min((gap(c[p], e), k) for k, e in enumerate(books[p]))
    for _ in range(vc.ROUNDS):
        groups = {}
        for c in cut:
            for p in range(vc.PARTS):
                groups.setdefault((p, near(c, p)[1]), []).append(c[p])
        for (p, k), members in groups.items():
            books[p][k] = [sum(col) // len(members) for col in zip(*members)]
    found = [[near(c, p) for p in range(vc.PARTS)] for c in cut]
    return [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for (i, _), f in zip(kept, found)], books


def test_sequency_order():
    for size in (1, 2, 4, 16):
        m = vc.sequency_matrix(size)
        assert [(r[1:] != r[:-1]).sum() for r in m] == list(range(size))
        assert (m @ m.T == size * np.eye(size, dtype=int)).all()


@pytest.mark.parametrize("width", [1, 2, 3, 4, 7, 8])
def test_nearest_is_exact_with_ties(width):
    rng = np.random.default_rng(width)
    for top in (1, 3, 400):
        parts, entries = rng.integers(-top, top + 1, (300, width)), rng.integers(-top, top + 1, (64, width))
        index, distance = vc.nearest(vc.transform(parts), vc.transform(entries))
        want = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()


def test_no_rows():
    index, distance = vc.nearest(np.zeros((0, 4), np.int64), np.zeros((3, 4), np.int64))
    assert len(index) == len(distance) == 0


SCHEMA = "vec_id long, embedding array<double>, label int, code string, x int, error int"


def run(spark, tmp_path, rows):
    frame = spark.createDataFrame([(i, x, y, "c", 1, 2) for i, x, y in rows], SCHEMA)
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    from brinewave.llm.common import LLM_QUERIES

    return LLM_QUERIES["op11_walsh_vector_codes"](spark, str(tmp_path)).collect()


def test_whole_query_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    vector = lambda n: [rng.gauss(0, 0.5) for _ in range(n)]
    rows = [(i, vector(40), rng.choice([None, 1, 2])) for i in range(150)]
    rows += [(3, vector(40), 1), (3, rows[3][1], 1), (None, vector(40), None), (None, vector(40), 2)]
    rows += [(900, None, 1), (901, [1.0, None], 1), (902, [math.nan] * 40, 1), (903, [math.inf, 0.0], 2), (904, [], 2), (905, [0.25] * 5, 1)]
    rng.shuffle(rows)
    want, books = brute([(i, x) for i, x, _ in rows], 48)
    got = run(spark, tmp_path, rows)
    assert sorted((str(r.vec_id), r.code, r.error) for r in got) == sorted((str(i), c, e) for i, c, e in want)
    text = ",".join(str(v) for p in books for e in p for v in e)
    import hashlib

    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(text.encode()).hexdigest()}
    assert len({r.label_error for r in got}) == 3
    assert sum(r.error for r in got) == sum({r.label_error for r in got})


def test_decode_gives_the_error(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(32)], 0) for i in range(100)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found, books = vc.compress(frame)
    exact = {i: np.floor(np.float32(x).astype(float) * 256).astype(int) for i, x, _ in rows}
    for r in found.collect():
        assert ((vc.decode(r["code"], books) - exact[r["id"]]) ** 2).sum() == r["error"]


def test_empty_table_and_only_bad_rows(spark, tmp_path):
    assert run(spark, tmp_path / "a", []) == []
    assert run(spark, tmp_path / "b", [(1, None, 1), (2, [math.nan], None)]) == []


def test_equal_vectors_share_the_lowest_entry(spark, tmp_path):
    got = run(spark, tmp_path, [(i, [0.5] * 16, 1) for i in range(70)])
    assert {(r.code, r.error, r.label_error) for r in got} == {("00" * 16, 0, 0)}


def test_component_out_of_range_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="exceeds"):
        run(spark, tmp_path, [(1, [1e9] * 16, 1), (2, [0.0] * 16, 1)])
