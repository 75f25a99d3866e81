"""HTML extraction, URL templates, reply trees and decontamination."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from brinewave.llm import decontaminate as d
from brinewave.llm import extract as x
from brinewave.llm import replytree as r
from brinewave.llm import urltree as u
from brinewave.llm.common import LLM_QUERIES, prepare

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header class="site"><h1>Site</h1></header>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>{open}<h1>A title</h1><p><b>First &amp; words
 of it.<br>More <p class="ad">Buy now</p><p>Last &lt;b&gt; &eacute; words.</p><ul><li>one item</li></ul>{close}
<section id="comments"><p>I think this comment is long enough to win by words alone, or is it not.</p></section><footer>&copy; me</footer></body></html>"""
WANT = "A title\nFirst & words of it. More\nLast <b> é words.\none item"


@pytest.fixture(scope="module")
def weights():
    counts = x.labelled_counts(PAGE.format(open="<article>", close="</article>"))
    return x.Weights(*counts)


@pytest.mark.parametrize("marks", [("<article>", "</article>"), ('<div class="post">', "</div>"), ("<main>", "</main>")])
def test_article_without_furniture(weights, marks):
    assert x.extract(PAGE.format(open=marks[0], close=marks[1]), weights) == WANT


def test_best_run_against_all_runs():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.randint(-4, 4) for _ in range(rng.randint(0, 12))]
        start, end = x.best_run(scores)
        best = max((sum(scores[a:b]) for a, b in combinations(range(len(scores) + 1), 2)), default=0)
        assert sum(scores[start:end]) == max(0, best)


def test_broken_and_empty_html(weights):
    assert [x.extract(h, weights) for h in (None, "", "<p></p>", "<!-- open", "<script>x")] == [""] * 5
    assert x.extract('<p>a "quoted <b class="x>text', weights).startswith('a "quoted')
    assert x.extract("plain &am", x.Weights(Counter(), Counter())) == "plain &am"
    x.extract("<p '" * 20000, weights)


def test_words_in_attribute_values_are_no_attributes():
    plain = ['<a href="/hidden-gems">', '<p title="Hidden costs">', '<p data-hidden="false">', '<a href="/x?id=menu">', "<p title='class=ad'>", '<p data-id="menu" xid=nav>', "<p title=class=ad>"]
    furniture = ["<p hidden>", '<p title="a" hidden="x">', "<p class = 'ad'>", "<p ID=menu>", '<p data-x="1"role="navigation"/>', '<p aria-hidden="true">', '<p style="display:none">']
    assert [t for t in plain if x.parts_of(t)[0].furniture] == [] and [t for t in furniture if not x.parts_of(t)[0].furniture] == []


BODY = "<h1>Title here</h1><p>Some words of an article that say a thing or two.</p><p>And a second paragraph of it.</p>"
TEXT = "Title here\nSome words of an article that say a thing or two.\nAnd a second paragraph of it."


@pytest.mark.parametrize("name", ["post has-sidebar", "content no-comments", "layout with-nav", "sidebar-layout", "page_with_sidebar", "main-content related-layout", "banner"])
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", "<main>{}</main>"])
def test_layout_names_around_an_article_keep_it(weights, name, inner):
    menu = '<div class="site-nav"><a href="/">Home page</a></div>'
    assert x.extract(f'<body>{menu}<div class="{name}">{inner.format(BODY)}</div></body>', weights) == TEXT


@pytest.mark.parametrize("tag", ['<section id="related-work">', '<p class="notice-text">', '<div class="search-text">', '<div class="alert-no-more">'])
def test_sections_of_an_article_stay(weights, tag):
    name = tag[1:].split()[0]
    page = f"<article>{BODY}{tag}Own words of the article</{name}><p>Last words.</p></article>"
    assert x.extract(page, weights) == TEXT + "\nOwn words of the article\nLast words."


@pytest.mark.parametrize("tag", ['<div class="comments">', '<div id="comments-area">', '<section class="comment-list">', '<div class="cookie-notice">', '<ul class="main-menu">', '<div class="related-posts">', '<div class="share-buttons">', '<div class="ad-slot">', '<div class="newsletter-signup">'])
@pytest.mark.parametrize("inside", [True, False])
def test_furniture_names_still_go(weights, tag, inside):
    name = tag[1:].split()[0]
    rest = f"{tag}<p>Words that are none of the article, however many of them there may be in here</p></{name}>"
    page = f"<article>{BODY}{rest}</article>" if inside else f"<article>{BODY}</article>{rest}"
    assert x.extract(f"<body>{page}</body>", weights) == TEXT


def test_long_comments_go_without_a_marked_article(weights):
    page = f'<body><div class="post">{BODY}</div><div id="comments"><p>{"much ado " * 200}</p></div></body>'
    assert x.extract(page, weights) == TEXT


def test_extract_table(spark):
    prepare(spark)
    rows = [(1, PAGE.format(open="<article>", close="</article>")), (2, None), (None, "<p>x</p>"), (None, "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("kind", F.lit(1))
    found = x.extract_text(df, x.train(df)).collect()
    assert [t.text for t in found] == [WANT, "", "x", "x"]
    assert x.extract_text(df.limit(0), x.train(df.limit(0))).count() == 0


def test_rules_and_hosts(spark):
    prepare(spark)
    urls = [None, "no scheme", "HTTP://A.Example.COM/en/7?x", "http://com/en/1", "xcom://notcom/en/1", "http://example.com/en/8#a", "http://a.b.net/de/8", "http://example.net/de/80", "http://xexample.net/de/8", "http://org/es"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    none = spark.createDataFrame([], "host string, path string, good int")
    got = {t.page_id: t for t in u.judge(df, u.build(none)).collect()}
    want = [("", ""), ("", ""), ("a.example.com", "/en/7"), ("com", "/en/1"), ("notcom", "/en/1"), ("example.com", "/en/8"), ("a.b.net", "/de/8"), ("example.net", "/de/80"), ("xexample.net", "/de/8"), ("org", "/es")]
    assert [(got[i].host, got[i].path) for i in range(len(urls))] == want
    assert [got[i].rule for i in range(len(urls))] == [None, None, "example.com/en/7", "com/en/", None, "com/en/", "net/de/", "example.net/de/8", "net/de/", None]
    assert got[0].verdict == "allow" and got[2].verdict == "allow" and got[3].verdict == "block"


def test_each_rule_has_the_verdict_of_the_contract(spark):
    """The verdict of each rule, whatever the purity of the template says."""
    prepare(spark)
    want = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    df = spark.createDataFrame([(i, f"http://www.{rule}1") for i, rule in enumerate(want)], "page_id long, url string")
    for good in (0, 1):
        tree = u.build(spark.createDataFrame([("h", f"/{i}", good) for i in range(30)], "host string, path string, good int"))
        got = u.judge(df, tree).orderBy("page_id").collect()
        assert {r.rule: r.verdict for r in got} == want


def test_bad_branch_is_rejected(spark):
    prepare(spark)
    rows = [("h", f"/good/{i}", 1) for i in range(60)] + [("h", f"/bad/{i}", 0) for i in range(60)] + [("h", f"/also/{i}.html", 1) for i in range(30)] + [("h", "/x", None)]
    tree = u.build(spark.createDataFrame(rows, "host string, path string, good int"))
    df = spark.createDataFrame([(1, "q://h/bad/999"), (2, "q://h/good/77"), (3, "q://h/new/1"), (4, "q://other/bad/1"), (4, "q://other/bad/1")], "page_id long, url string")
    got = {t.page_id: t for t in u.judge(df, tree).collect()}
    assert got[1].verdict == "block" and got[1].template == "h/bad/*/" and got[2].verdict == "allow" and got[4].purity == tree.overall


def test_bad_branch_among_many_stays_apart(spark):
    """The number of labelled siblings does not merge a branch that differs."""
    prepare(spark)
    rows = [("h", f"/{'abcdefghijklmnopqrst'[i // 20]}{'abcdefghijklmnopqrst'[i % 20]}/{j}", int(i > 0)) for i in range(60) for j in range(20)]
    tree = u.build(spark.createDataFrame(rows, "host string, path string, good int"))
    df = spark.createDataFrame([(1, "q://h/aa/999"), (2, "q://h/ab/999")], "page_id long, url string")
    got = {t.page_id: t for t in u.judge(df, tree).collect()}
    assert got[1].verdict == "block" and got[1].template == "h/aa/*/"
    assert got[2].verdict == "allow" and got[2].template == "h/*/*/"


def test_deep_branches_are_judged(spark):
    prepare(spark)
    rows = [("h", f"/a/b/c/d/{kind}/e/{i}", good) for kind, good in (("spam", 0), ("docs", 1)) for i in range(40)]
    tree = u.build(spark.createDataFrame(rows, "host string, path string, good int"))
    assert len(tree.levels) == 7
    df = spark.createDataFrame([(1, "q://h/a/b/c/d/spam/e/999/f"), (2, "q://h/a/b/c/d/docs/x"), (3, "q://h/a/b")], "page_id long, url string")
    got = {t.page_id: t for t in u.judge(df, tree).collect()}
    assert [got[i].template for i in (1, 2, 3)] == ["h/a/b/c/d/spam/e/*/", "h/a/b/c/d/docs/", "h/a/b/"]
    assert got[1].verdict == "block" and got[2].verdict == "allow"


def paths_of(parents):
    inner = set(parents.values())
    for leaf in sorted(set(parents) - inner):
        path, at = [], leaf
        while at is not None and at in parents:
            path.append(at)
            at = parents[at]
        yield leaf, path[::-1]


def test_paths_of_random_trees(spark):
    prepare(spark)
    rng, rows, want = random.Random(5), [], {}
    for tree in range(12):
        parents = {i: (None if i == 0 or rng.random() < 0.05 else rng.randrange(max(0, i - 3), i)) for i in range(rng.randint(1, 40))}
        rows += [(str(tree), i, p, "user", f"t{i}", float(i % 5)) for i, p in parents.items()]
        want |= {(str(tree), leaf): path for leaf, path in paths_of(parents)}
    df = spark.createDataFrame(rows, "tree string, node int, parent int, role string, text string, score double")
    got = {}
    for t in r.paths(df).collect():
        got.setdefault((t.tree, t.leaf), {})[t.place] = t.node
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == want
    best = r.conversations(df, best=1).collect()
    for t in best:
        ranked = sorted((-sum(n % 5 for n in p) / len(p), leaf) for (tree, leaf), p in want.items() if tree == t.tree)
        assert t.leaf == ranked[0][1] and [n.text for n in t.turns] == [f"t{n}" for n in want[(t.tree, t.leaf)]]


@pytest.mark.parametrize("turns", [1, 2, 3, 12, 200])
def test_one_conversation_alone(spark, tmp_path, turns):
    rows = [(7, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(turns)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {t.conv_id: t.n_turns for t in LLM_QUERIES["op2_reply_paths"](spark, str(tmp_path)).collect()}
    assert got == {7: turns, -1: 2}


def test_long_paths_beside_circles_with_tails(spark):
    kind = "tree string, node int, parent int, role string, text string, score double"
    line = [("long", i, i - 1 if i else None, "user", str(i), 1.0) for i in range(40)]
    circle = [("bad", 1, 3, "user", "a", 0.0), ("bad", 2, 1, "user", "b", 0.0), ("bad", 3, 2, "user", "c", 0.0), ("bad", 4, 3, "user", "tail", 0.0), ("bad", 5, 4, "user", "end", 0.0)]
    both = [("both", 1, None, "user", "root", 0.0), ("both", 2, 1, "user", "x", 0.0), ("both", 8, 9, "user", "y", 0.0), ("both", 9, 8, "user", "z", 0.0), ("both", 10, 9, "user", "tail", 0.0), ("self", 1, 1, "user", "me", 0.0)]
    found = r.conversations(spark.createDataFrame(line + circle + both, kind)).collect()
    assert {(t.tree, t.leaf): [x.text for x in t.turns] for t in found} == {("long", 39): [str(i) for i in range(40)], ("both", 2): ["root", "x"]}


def test_circles_and_empty_trees(spark):
    prepare(spark)
    kind = "tree string, node int, parent int, role string, text string, score double"
    circle = spark.createDataFrame([("a", 1, 2, "user", "x", 0.0), ("a", 2, 1, "user", "y", None)], kind)
    assert r.conversations(circle).count() == 0 and r.conversations(circle.limit(0)).count() == 0


def test_template_is_reversible(spark):
    rng = random.Random(6)
    pieces = ["\\", "<|", "|", "<", "<|im_end|>\n", "<|im_start|>", "assistant", "\n", "a", "\\|", "n", "é", "$1"]
    rows = [(i, [("".join(rng.choice(pieces) for _ in range(rng.randint(0, 3))), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))) for _ in range(rng.randint(1, 4))]) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, turns array<struct<role:string,text:string>>")
    for t in df.select("turns", r.turns_of(r.formatted(F.col("turns"))).alias("back")).collect():
        assert [tuple(a) for a in t.turns] == [tuple(b) for b in t.back]


def test_decontamination_against_all_windows(spark):
    """Flags of the operator against every item-sized window of every text."""
    prepare(spark)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 30))] for _ in range(8)] + [["too", "short"]]
    texts = [None, "", "one"]
    for _ in range(60):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        passage = list(rng.choice(items))
        if rng.random() < 0.5:
            passage[rng.randrange(len(passage))] = rng.choice(vocabulary)
        at = rng.randint(0, len(body))
        texts.append(rng.choice([" ", ", ", "\n"]).join(body[:at] + passage + body[at:]).upper())
    docs = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("k1", F.lit(0))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(99, None)], "item_id long, text string")

    def grams(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    def hit(text):
        w = (text or "").lower().replace(",", " ").split()
        for item in items:
            b = grams(item)
            for s in range(max(1, len(w) - len(item) + 1)):
                a = grams(w[s : s + len(item)])
                if b and 5 * sum((a & b).values()) >= 4 * sum((a | b).values()):
                    return True
        return False

    kept = Counter((t.doc_id, t.text) for t in d.decontaminate(docs, bench).collect())
    assert kept == Counter((i if i % 9 else None, t) for i, t in enumerate(texts) if not hit(t))
    assert d.decontaminate(docs.limit(0), bench).count() == 0
    assert d.decontaminate(docs, bench.limit(0)).count() == len(texts)


def test_radius_is_guaranteed(spark):
    """Every pair within the radius comes out of the block index, at the worst spread of the bits too."""
    prepare(spark)
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(3)]
    asked = []
    for fp in base:
        for spread in ([5, 5, 5, 4], [4, 5, 5, 5], [16, 3, 0, 0], [0, 0, 0, 16], [5, 5, 4, 5]):
            mask = 0
            for b, n in enumerate(spread):
                mask |= sum(1 << (16 * b + k) for k in rng.sample(range(15), min(n, 15)))
            asked.append(fp ^ mask)
    asked = [a for a in asked if any((a ^ b).bit_count() <= d.RADIUS for b in base)]
    got = d.near_items(spark.createDataFrame([(a,) for a in asked], "fp long"), spark.createDataFrame(list(enumerate(base)), "item_id long, fp long"))
    found = {(t.fp, t.item_id) for t in got.collect()}
    assert found == {(a, i) for a in asked for i, b in enumerate(base) if (a ^ b).bit_count() <= d.RADIUS}


def test_long_items_and_repeated_words(spark):
    prepare(spark)
    rng = random.Random(12)
    long = [f"w{rng.randrange(10**7)}" for _ in range(70_000)]
    mid = [f"m{rng.randrange(40)}" for _ in range(6000)]
    near = list(mid)
    near[3000:3004] = ["other"] * 4
    docs = spark.createDataFrame([(1, " ".join(["before", *long, "after"])), (2, " ".join(near)), (3, " ".join(long[:40_000]))], "doc_id long, text string")
    docs = docs.withColumn("hit1", F.lit(0)).withColumn("Hit2", F.lit(0))
    bench = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(mid))], "item_id long, text string")
    kept = d.decontaminate(docs, bench)
    assert kept.columns == docs.columns and [t.doc_id for t in kept.collect()] == [3]


def test_wide_counters_equal_narrow_ones(spark, monkeypatch):
    rng = random.Random(13)
    rows = spark.createDataFrame([([rng.randrange(-(2**63), 2**63) for _ in range(n)],) for n in (1, 2, 7, 300)], "h array<long>")
    narrow = [t.fp for t in d.with_fingerprint(rows, "h").collect()]
    monkeypatch.setattr(d, "LANE_TOP", 1)
    assert [t.fp for t in d.with_fingerprint(rows, "h").collect()] == narrow
    bits = lambda h: sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert [f % 2**64 for f in narrow] == [bits(t.h) for t in rows.collect()]
