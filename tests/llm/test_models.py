"""Language and quality: held-out accuracy, whole texts, defined cases."""

import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from brinewave.llm import language, quality
from brinewave.llm.common import flat_bytes, prepare, table

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
ROWS = [(1, None, "x"), (2, "", "x"), (3, " 123 !?", "y"), (3, " 123 !?", "y"), (None, "the end of the story", "z")]


@needs_tables
def test_language_held_out(spark):
    prepare(spark)
    docs = table(spark, FOLDER, "documents")
    model = language.train(docs)
    found = language.identify(docs, model).select("doc_id", "lang", "lang_pred", "score", language.held_out("doc_id").alias("h")).collect()
    test = [r for r in found if r.h]
    assert np.mean([r.lang == r.lang_pred for r in test]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)
    odd = spark.createDataFrame(ROWS, "doc_id long, text string, score string").withColumnRenamed("score", "extra")
    got = {(r.text, r.lang_pred) for r in language.identify(odd, model).collect()}
    assert {(None, "und"), ("", "und"), (" 123 !?", "und"), ("the end of the story", "en")} == got
    assert language.identify(odd.limit(0), model).count() == 0


def test_language_without_or_with_one_language(spark):
    prepare(spark)
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.train(none) is None
    odd = spark.createDataFrame([(1, "words here")], "doc_id long, text string")
    assert language.identify(odd, None).first().lang_pred == "und"
    one = language.train(spark.createDataFrame([(i, "some words", "xx") for i in range(30)], "doc_id long, text string, lang string"))
    assert language.identify(odd, one).first().lang_pred == "xx"


def test_language_features_do_not_cross_rows():
    texts = ["Éa", "éA", "bc", "Éabc"]
    x = language.vectors(*flat_bytes(pa.array(texts)))
    assert np.allclose(x[0], x[1]) and np.allclose(x[2], language.vectors(*flat_bytes(pa.array(["bc"])))[0])


@needs_tables
def test_quality_held_out(spark):
    prepare(spark)
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    model = quality.train(docs, labels)
    rows = quality.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(quality.held_out("doc_id")).collect()
    good, junk = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > j for g in good for j in junk]) > 0.9
    odd = spark.createDataFrame(ROWS, "doc_id long, text string, extra string")
    got = quality.score(odd, model).collect()
    assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if not r.text}) == 1
    assert quality.score(odd.limit(0), model).count() == 0


def test_quality_without_labels(spark):
    prepare(spark)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, extra string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.train(docs, none)).first().score == 0.5


def test_combination_is_fitted_on_whole_texts(spark):
    prepare(spark)
    rng = np.random.default_rng(4)
    text = lambda good: "".join(rng.choice(list("abcde " if good else "abcde#"), 9000))
    rows = [(i, text(i % 2), i % 2) for i in range(24)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    net = quality.train(docs, labels)
    used = quality.sample(docs, labels).collect()
    whole = net.features(pa.array([r.text for r in used]))
    assert np.allclose(net.combine, quality._logistic(whole, np.array([r.quality for r in used], np.float32)), atol=1e-5)


def test_every_byte_is_in_a_chunk():
    net = quality.ByteNet()
    net.compile()
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 249, 250, 256, 505, 506, 3000):
        text = bytes(rng.integers(97, 123, n)).decode()
        data, at = quality.padded(*flat_bytes(pa.array(["zzz", text, "yyy"])))
        whole = net.half_maxima(data)[at[1] : at[2]].max(axis=0)
        x = np.frombuffer(text.encode() + bytes(quality.SPAN - 1 + 2 * quality.HALF), np.uint8)
        embedded = net.w["embed"][x]
        slow = [sum(embedded[p + j] @ net.w["conv"][j * quality.EMBED : (j + 1) * quality.EMBED] for j in range(quality.SPAN)) for p in range(n + 1)]
        assert np.all(whole >= np.max(slow, axis=0) - 1e-4)


def test_gradients_match_differences():
    net = quality.ByteNet()
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (4, 60)).astype(np.uint8)
    y = np.array([0, 1, 1, 0], np.float32)

    def loss():
        view = np.lib.stride_tricks.sliding_window_view(net.w["embed"][x].reshape(4, -1), quality.SPAN * quality.EMBED, axis=1)[:, :: quality.EMBED]
        h = np.maximum((view @ net.w["conv"]).max(axis=1) + net.w["bias"], 0)
        z = (np.maximum(h @ net.w["inner"] + net.w["inner_bias"], 0) @ net.w["outer"] + net.w["outer_bias"])[:, 0]
        return float(np.mean(np.log1p(np.exp(-np.where(y > 0, z, -z)))))

    grads = net._gradients(x, y)
    for name, at in (("outer_bias", (0,)), ("inner_bias", (2,)), ("bias", (3,)), ("embed", (int(x[0, 5]), 1))):
        old = net.w[name][at]
        net.w[name][at] = old + 1e-2
        up = loss()
        net.w[name][at] = old - 1e-2
        down = loss()
        net.w[name][at] = old
        assert abs((up - down) / 2e-2 - grads[name][at]) < 5e-3


def test_an_id_that_occurs_often_is_one_document_of_the_sample(spark, monkeypatch):
    prepare(spark)
    rows = [(4, f"the same number again {i}", "en") for i in range(3000)] + [(i, f"the story of house {i} and its garden", "en") for i in range(40)]
    rows += [(i, f"das haus nummer {i} und der garten dahinter", "de") for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language, "Hierarchy", lambda x, langs: seen.append(langs.tolist()) or "model")
    assert language.train(docs, most=30) == "model"
    per = {lang: seen[0].count(lang) // (language.PIECES + 1) for lang in ("en", "de")}
    assert 20 <= per["en"] <= 30 and 20 <= per["de"] <= 30
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    chosen = quality.sample(docs, labels).collect()
    ids = [r.doc_id for r in chosen]
    assert len(ids) == len(set(ids)) > 20 and 4 in ids


def test_votes_against_their_definition():
    rng = np.random.default_rng(4)
    names = np.array([["a", "b", "c", "d"][i % 4] for i in range(80)], object)
    x = rng.normal(scale=0.4, size=(80, language.SIZE)).astype(np.float32)
    for k, name in enumerate("abcd"):
        x[names == name, k] += 6
    model = language.OneVersusOne(x, names)
    best, score = model(x)
    assert (np.array(model.names, object)[best] == names).all()
    margin = x @ model.weights[:, :-1].T + model.weights[:, -1]
    for row, chosen, p in zip(margin.tolist(), best.tolist(), score.tolist()):
        signed = {(a, b): m for m, (a, b) in zip(row, model.pairs)}
        wins = [sum(m >= 0 if a == k else m < 0 for (a, b), m in signed.items() if k in (a, b)) for k in range(4)]
        total = [sum(m if a == k else -m for (a, b), m in signed.items() if k in (a, b)) for k in range(4)]
        assert chosen == max(range(4), key=lambda k: (wins[k], total[k]))
        lead = min(m if a == chosen else -m for (a, b), m in signed.items() if chosen in (a, b))
        assert p == pytest.approx(1 / (1 + np.exp(-np.clip(4 * lead, -30, 30))), rel=1e-4)


def test_training_holds_one_copy_of_its_sample():
    """Beside the vectors in half precision, the driver holds one copy of them in single precision."""
    rng = np.random.default_rng(6)
    x = rng.random((1200, language.SIZE))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float16)
    langs = np.array([["de", "fr"][i % 2] for i in range(len(x))], object)
    tracemalloc.start()
    language.Hierarchy(x, langs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * 4 * x.size
