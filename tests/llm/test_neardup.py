"""Components against brute force; kernels against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from brinewave.llm import neardup, shingles
from brinewave.llm.common import prepare
from brinewave.llm.components import components


def word_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", low) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(texts, percent):
    sets = [word_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def corpus():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "one two", "One  TWO", "one two three"]
    for _ in range(6):
        base = [r.choice(vocabulary) for _ in range(r.randint(20, 150))]
        for _ in range(25):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(r.choice([" ", "\n"]).join(copy))
    return texts + [" ".join(r.choice(vocabulary) for _ in range(40)) for _ in range(30)]


def test_components_match_brute_force(spark):
    prepare(spark)
    texts = corpus()
    want, sizes = brute(texts, 85)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as n_shingles", "2 as rep", "3 as key")
    got = {r.doc_id: r for r in neardup.near_duplicates(df).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == want
    assert all(got[i].kept == (want[i] == i) for i in got)


def test_sets_are_made_where_the_texts_are_read(spark):
    """No text is shuffled, other rows of a wanted id are left out, and joins by class do not move the sets."""
    prepare(spark)
    rows = [(i, f"a b c d e f{i} g{i % 7}") for i in range(400)] + [(5, "something else that has an id of before"), (None, "x")]
    docs = spark.createDataFrame(rows, "rep long, text string")
    sig = neardup.signatures(docs, "rep", "text")
    wanted = neardup.classes(sig).where("rep < 10 and n = 3").select("rep", "d1", "d2")
    made = neardup.full_sets(docs, wanted.select("rep"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert {r.rep for r in made.collect()} >= set(range(10)) and made.count() < 100
    sets, plain = neardup.write_sets(docs, wanted)
    assert sorted((r.rep, len(r["items"])) for r in sets.collect()) == [(i, 3) for i in range(10)]
    assert sorted(map(str, plain.collect())) == sorted(map(str, sets.collect()))
    plan = sets.join(sets.hint("merge").withColumnRenamed("items", "y"), "rep")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_small_blocks_find_the_same(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 300)
    texts = corpus()[6:110]
    want, _ = brute(texts, 85)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_null_ids_repeats_and_empty_tables(spark):
    prepare(spark)
    t = "a b c d e f g"
    df = spark.createDataFrame([(None, t), (7, t), (7, t), (None, "x y"), (9, None)], "doc_id long, text string")
    got = sorted(map(tuple, neardup.near_duplicates(df).collect()), key=str)
    assert [r[2] for r in got if r[1] == 3] == [7, 7, 7]
    assert (None, 1, None, True) in got and (9, 0, 9, True) in got
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_words_across_rows_and_batches():
    texts = ["Ab  cd", None, "ab\tCD", "cd ab", "é ab cd"]
    h, rows = shingles.words(pa.array(texts))
    per = [h[a:b].tolist() for a, b in zip(rows[:-1], rows[1:])]
    assert per[0] == per[2] == per[3][::-1] == per[4][1:] and per[1] == []
    alone = shingles.words(pa.array(["zz zz zz ab"]))[0]
    assert alone[3] == per[0][0] and alone[0] == alone[1]


def test_min_and_max_estimate_similarity():
    rng = np.random.default_rng(1)
    sign = shingles.MinMax(400)
    with np.errstate(over="ignore"):
        base = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        a, b = sign(np.sort(base[:900])), sign(np.sort(base[100:]))
    assert abs(np.mean(a == b) - 0.8) < 0.05


def test_links_between_finds_every_merger():
    r = random.Random(9)
    sets = [np.array(sorted(r.sample(range(14), r.randint(5, 12)))) for _ in range(60)]
    found = neardup.links_between(sets, np.arange(60), 80)

    def closure(pairs):
        root = list(range(60))
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [a if x == b else x for x in root]
        return [root.index(x) for x in root]

    every = [(i, j) for i in range(60) for j in range(i) if 100 * len(s := {*sets[i]} & {*sets[j]}) >= 80 * (len(sets[i]) + len(sets[j]) - len(s))]
    assert closure(found) == closure(every) and len(found) < 60


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(5, 5), (None, 3)]
    got = {r.v: r.c for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 150)) and len(got) == 91
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
