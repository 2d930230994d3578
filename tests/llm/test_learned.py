"""Toxicity, quality network and language filters: held-out accuracy and defined results."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import language_id, quality_net, toxicity
from tests.llm.cases import EDGE_TEXTS, documents, edge_documents

MID = "/root/testdata/sf0.1"


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def auc(rows):
    s = np.array([r[0] for r in rows]).argsort().argsort() + 1
    y = np.array([r[1] for r in rows])
    p = y.sum()
    return (s[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def held(doc_id, modulus, rest):
    return zlib.crc32(str(doc_id).encode()) % modulus == rest


@pytest.fixture(scope="module")
def mid(spark):
    return (spark.read.parquet(f"{MID}/documents.parquet"),
            spark.read.parquet(f"{MID}/labels.parquet"))


def test_toxicity_on_held_out_documents(spark, mid):
    docs, labels = mid
    model = toxicity.train(docs, labels)
    out = toxicity.score_documents(docs, model)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.where("held_out").join(labels, "doc_id").select("score", "toxic", "predicted").collect()
    # About a quarter of the toxic labels here mark texts without any telling word.
    assert auc(rows) > 0.9
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.03 * len(rows)
    score = toxicity.scores(model, ["", None, "the idiott of and", "and of the to for with"])
    assert score[0] == score[1] == 0 and score[2] > 10 * score[3]
    assert toxicity.logits(model, [["a"], []])[1] == -np.inf


def test_toxic_word_counts_anywhere_in_a_long_text():
    rng = np.random.default_rng(0)
    normal = [f"n{i}" for i in range(300)]
    clean = ["\n".join(rng.choice(normal, 200)) for _ in range(60)]
    toxic = ["\n".join([*rng.choice(normal, 150), "badword", *rng.choice(normal, 40)])
             for _ in range(30)]
    model = toxicity.fit(clean + toxic, np.array([0] * 60 + [1] * 30))
    long = " ".join([*rng.choice(normal, 3000), "badwords", *rng.choice(normal, 3000)])
    assert toxicity.scores(model, [long])[0] > 0.7 > toxicity.scores(model, [clean[0]])[0]


def test_quality_on_held_out_documents(spark, mid):
    docs, labels = mid
    vectors = quality_net.context_vectors(docs)
    net = quality_net.train(docs, labels, vectors)
    out = quality_net.score_documents(docs, vectors, net)
    rows = out.where("held_out").join(labels, "doc_id").select("score", "quality", "predicted").collect()
    assert auc(rows) > 0.98
    assert sum(r.predicted != r.quality for r in rows) <= 0.03 * len(rows)


def test_context_vectors_equal_brute_force(spark):
    """The distributed sum is the sum over all documents of neighbours' index vectors."""
    texts = ["a b c", "b a! ! x", None, "", "a b c"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    place, sign = quality_net.index_vectors()
    want = np.zeros((quality_net.VOCAB, quality_net.DIM))
    for t in texts:
        word, _ = quality_net.encode([t])
        for i, w in enumerate(word):
            for j in range(max(0, i - quality_net.REACH), min(len(word), i + quality_net.REACH + 1)):
                if i != j:
                    for k in range(quality_net.NONZERO):
                        want[w, place[word[j], k]] += sign[word[j], k]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality_net.context_vectors(docs), want, atol=1e-6)


def test_temperature_calibrates():
    """Probabilities of an over-fitted network are brought near the observed rates."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, quality_net.FEATURES))
    y = (rng.random(3000) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    net = quality_net.fit(x, y)
    assert net["temperature"] > 1
    fresh = rng.normal(size=(3000, quality_net.FEATURES))
    p = quality_net.probabilities(net, fresh)
    truth = 1 / (1 + np.exp(-fresh[:, 0]))
    assert abs(p.mean() - truth.mean()) < 0.05


def test_models_without_labels_and_empty_tables(spark):
    docs = edge_documents(spark)
    assert toxicity.train(docs, no_labels(spark)) is None
    vectors = quality_net.context_vectors(docs)
    assert quality_net.train(docs, no_labels(spark), vectors) is None
    for out in (toxicity.score_documents(docs, None),
                quality_net.score_documents(docs, vectors, None)):
        rows = out.collect()
        assert len(rows) == docs.count() and {r.score for r in rows} == {0.0}
        assert all(r.held_out == (held(r.doc_id, 3, 1) if r.doc_id is not None else False)
                   for r in rows)
    empty = docs.limit(0)
    assert not quality_net.context_vectors(empty).any()
    assert toxicity.score_documents(empty, None).count() == 0
    assert language_id.learn(empty.withColumn("lang", F.lit("en"))) is None
    rows = language_id.identify_documents(docs, None).collect()
    assert {r.lang_pred for r in rows} == {"und"}


def test_language_on_held_out_documents(spark, mid):
    docs, _ = mid
    out = language_id.identify_documents(docs, language_id.learn(docs))
    rows = out.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)
    assert all(0 <= r.score <= 1 and held(r.doc_id, 5, 0) for r in rows)


def test_rare_language_in_a_large_table_is_learned(spark):
    docs = spark.range(200_000).select(
        F.col("id").alias("doc_id"),
        F.expr("CASE WHEN id = 7 THEN 'жили были дед да баба' WHEN id % 2 = 0 THEN "
               "'hello world and all the others' ELSE 'bonjour le monde et tous les autres' END"
               ).alias("text"),
        F.expr("CASE WHEN id = 7 THEN 'ru' WHEN id % 2 = 0 THEN 'en' ELSE 'fr' END").alias("lang"))
    assert docs.where(language_id.learnable(F.col("doc_id"), 5, 0) & (F.col("lang") == "ru")).count()
    rows, thinned = language_id.training_rows(docs)
    n = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    assert n["ru"] == 1 and thinned["ru"] == 1
    assert all(0.9 * language_id.MAX_LABELLED < n[g] < 1.1 * language_id.MAX_LABELLED
               for g in ("en", "fr"))
    model = language_id.learn(docs)
    letters = np.unpackbits(language_id.letter_table()).astype(bool)
    texts = ["дед да баба", "hello others", "bonjour le monde"]
    assert language_id.identify(model, letters, texts)[0] == ["ru", "en", "fr"]


def test_filters_return_every_language_that_holds_a_gram(spark):
    """Against exact sets: no learned n-gram is missed, and undecided texts are defined."""
    rows = [(i, t, g) for i, (t, g) in enumerate([
        ("hello world and the others", "en"), ("bonjour le monde et les autres", "fr"),
        ("hallo welt und die anderen", "de"), (None, "de"), ("no language", None)] * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs, least_ratio=0.0)
    letters = np.unpackbits(language_id.letter_table()).astype(bool)
    for text, lang in (("hello world", "en"), ("bonjour le monde", "fr"), ("die anderen", "de")):
        h, _, _ = language_id.grams([text], letters)
        mask = model["planes"][0][language_id.slots_of(h)[0]]
        for at in language_id.slots_of(h)[1:]:
            mask = mask & model["planes"][0][at]
        bit = np.uint64(1 << model["langs"].index(lang))
        inner = (mask & bit) != 0
        assert inner.mean() >= 0.8
        assert language_id.identify(model, letters, [text])[0] == [lang]
    got = language_id.identify(model, letters, [None, "", "123 !?", "ЖЖЖЖ", *EDGE_TEXTS[:4]])
    assert got[0][:3] == ["und"] * 3 and got[0][3] in model["langs"] and got[1][3] == 0
