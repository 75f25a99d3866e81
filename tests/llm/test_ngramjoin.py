"""The n-gram join against all pairs, and the key rule as a property of random sets."""

import random
import re

import numpy as np
import pytest

from brinewave.llm import ngramjoin as nj
from brinewave.llm.common import LLM_QUERIES


def brute(rows, percent=80):
    """Row-wise (doc_id, n, component) over all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        smallest[r] = min((x for x in (smallest.get(r), d) if x is not None), default=None)
    return [(d, len(s), smallest[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    line = [word() for _ in range(30)]
    texts = [None, "", " \t", "One", "one two three four", "one two three four five", "ONE two three four five", "é É", "é é"]
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(5, 90))]
        if rng.random() < 0.5:
            base = line + base
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(0, 3)] = [word()] * rng.randrange(0, 2)
            texts.append(" ".join(copy))
    texts += [" ".join(line)] * 40 + [" ".join(line + [word()]) for _ in range(45)]  # a frequent passage
    texts += [" ".join(line[:k]) for k in range(5, 30)]
    return texts


def check(spark, tmp_path, rows):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, rep int, items string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = LLM_QUERIES["op12_combination_prefixes"](spark, str(tmp_path)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(key((r.doc_id, r.n_shingles, r.component_id)) for r in got) == sorted(map(key, brute(rows)))


@pytest.mark.parametrize("tokens", [300_000, 100])
def test_against_all_pairs(spark, tmp_path, monkeypatch, tokens):
    monkeypatch.setattr(nj, "BLOCK_TOKENS", tokens)
    check(spark, tmp_path, list(enumerate(corpus(1))))


def test_null_and_repeated_ids(spark, tmp_path):
    texts = corpus(2)[:60]
    rows = [(i // 2 if i % 5 else None, t) for i, t in enumerate(texts)]
    check(spark, tmp_path, rows + rows[:20] + [(None, "only here without any id at all"), (7, "q " * 3000), (8, "q " * 3001)])


def test_empty_table(spark, tmp_path):
    check(spark, tmp_path, [])


def test_chain_of_links(spark, tmp_path):
    """Each version replaces one end: neighbours link, the ends share nothing."""
    words = [f"c{i}" for i in range(300)]
    check(spark, tmp_path, [(900 - k, " ".join(words[3 * k : 3 * k + 60])) for k in range(60)])


def test_links_among_give_the_components():
    rng = np.random.default_rng(3)
    for _ in range(60):
        base = rng.choice(400, 40, replace=False)
        sets = [np.unique(np.concatenate([rng.choice(base, 40 - k, replace=False), rng.integers(400, 500, k)])) for k in rng.integers(0, 9, 12)]
        same = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))
        want = [(i, j) for i in range(12) for j in range(i) if same(sets[i], sets[j])]
        found = nj.links_among(sets, 80)
        assert all(same(sets[i], sets[j]) for i, j in found) and len(found) < 12
        parts = lambda edges: {frozenset(c) for c in closure(edges, 12)}
        assert parts(found) == parts(want)


def closure(edges, n):
    group = list(range(n))
    for i, j in edges:
        group = [group[i] if g == group[j] else g for g in group]
    return [[k for k in range(n) if group[k] == g] for g in set(group)]


def test_a_large_cluster_goes_bucket_by_bucket(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_TOKENS", 10)
    member = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (3, 4), (8, 8), (8, 9)], "leader long, rep long")
    sets = spark.createDataFrame([(i, 5) for i in (1, 2, 3, 4, 8, 9)], "rep long, n long")
    got = {(r.cluster, r.leader, r.rep, r.blocks) for r in nj.groups(member, sets).collect()}
    chain = {(1, a, b, 1) for a, b in [(1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (3, 4)]}
    assert got == {(8, None, 8, 1), (8, None, 9, 1)} | chain


@pytest.mark.parametrize("percent", [50, 67, 80, 90, 100])
def test_linked_sets_share_a_key(monkeypatch, percent):
    monkeypatch.setattr(nj, "RARE", 3)
    monkeypatch.setattr(nj, "COMMON", 6)
    monkeypatch.setattr(nj, "LONGEST", {2: 24, 3: 12})
    rng = random.Random(percent)
    links = 0
    for _ in range(400):
        n = rng.randrange(1, 40)
        base = rng.sample(range(60), n)
        other = [x for x in base if rng.random() > (100 - percent) / 250] + rng.sample(range(60, 70), rng.randrange(0, 3))
        a, b = set(base), set(other)
        if a == b or not b or 100 * len(a & b) < percent * len(a | b):
            continue
        links += 1
        df = {x: rng.randrange(2, 9) if x in a & b else rng.randrange(1, 9) for x in a | b}
        with np.errstate(over="ignore"):
            keys = []
            for s in (a, b):
                order = sorted((df[x], x) for x in s if df[x] > 1)
                keys.append(nj.prefix_keys(np.array([x for _, x in order], np.int64), np.array([d for d, _ in order]), len(s), percent))
        assert keys[0] & keys[1]
    assert links > 20 or percent == 100


def test_frequent_tokens_ask_for_combinations():
    assert [nj.combination_size(d, 50, 3) for d in (2, 32, 33, 1024, 1025)] == [1, 1, 2, 2, 3]
    assert [nj.combination_size(5000, n, 3) for n in (60, 61, 500, 501)] == [3, 2, 2, 1]
    assert nj.combination_size(5000, 10, 1) == 1
    items = np.arange(100, 110)
    with np.errstate(over="ignore"):
        rare, frequent = (nj.prefix_keys(items, np.full(10, d), 10, 80) for d in (2, 40))
    assert rare == {100, 101, 102} and len(frequent) == 3 + 2 + 1
