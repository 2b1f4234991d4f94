"""Language and toxicity: held-out accuracy on the tables, and awkward rows."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlink.llm import langid, toxicity
from cohortlink.llm.queries import language, toxic_documents

FOLDER = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = language(spark, FOLDER).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert 0.15 < len(held) / len(rows) < 0.35
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_like_a_plain_count():
    letters = langid.letter_table()
    texts = [("aa bb", "x"), ("bb cc!", "y"), ("Ça 1", "x")]
    counts = {"x": Counter(), "y": Counter()}
    for text, lang in texts:
        counts[lang].update(langid.features(text, letters).tolist())

    class Row:
        def __init__(self, lang, part):
            self.lang, self.part, self.texts = lang, part, {"x": 2, "y": 1}[lang]
            self.counts = np.array([counts[lang][part * langid.RANGE + i] for i in range(langid.RANGE)], np.int64).tobytes()
    model = langid.Model([Row(x, p) for x in "xy" for p in range((1 << langid.BITS) // langid.RANGE)])
    got, score = model.score("bb c", letters)
    total = {}
    for lang, own in counts.items():
        n = sum(own.values()) + 0.1 * 2 ** langid.BITS
        total[lang] = math.log({"x": 2, "y": 1}[lang] / 3) + sum(
            math.log((own[f] + 0.1) / n) for f in langid.features("bb c", letters).tolist())
    assert got == max(total, key=total.get)
    assert score == pytest.approx(1 / sum(math.exp(t - total[got]) for t in total.values()), rel=1e-4)


def test_n_grams_do_not_depend_on_what_is_between_words():
    letters = langid.letter_table()
    assert langid.features("Ab, cd", letters).tolist() == langid.features("..ab 12 CD!", letters).tolist()
    assert len(langid.features("ab", letters)) == 4 + 3 + 2
    assert len(langid.features("12 !", letters)) == len(langid.features(None, letters)) == 0


def test_language_rows(spark, make_docs):
    docs = make_docs([(1, "the house", "en"), (2, "das haus", "de"), (3, "x", None), (4, None, "fr"), (5, "", None)])
    model = langid.learn(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs.withColumn("score", F.lit("mine")), model).collect()}
    assert got[1][0] == "en" and got[2][0] == "de"
    assert got[4] == got[5] == ("und", 0.0)
    assert langid.predict(docs, langid.learn(docs.limit(0))).where("lang_pred = 'und'").count() == 5
    assert langid.predict(docs.limit(0), model).count() == 0
    long = make_docs([(1, "das haus " * 200_000)])
    assert langid.predict(long, model).first().lang_pred == "de"


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    got = toxic_documents(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    hits = sum(r.predicted and r.toxic for r in got)
    assert hits / sum(r.toxic for r in got) > 0.9
    assert hits / sum(r.predicted for r in got) > 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_ftrl_keeps_few_weights():
    rng = np.random.default_rng(1)
    model = toxicity.Ftrl()
    for _ in range(600):
        at = np.unique(rng.integers(10, 5000, 40))
        label = int(rng.random() < 0.3)
        model.learn(np.append(at, 5) if label else at, label)
    weights = model.weights(slice(None))
    assert weights.argmax() == 5 and weights[5] > 1
    assert (weights != 0).sum() < 400


def test_toxicity_rows(spark, make_docs):
    rows = [(i, "you idiot there" if i % 4 == 0 else f"fine day number {i}") for i in range(200)]
    docs = make_docs(rows + [(None, None), (900, ""), (901, "word " * 300_000 + "idiot")]).withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(4, 0), (None, 1), (7, None)],
                                   "doc_id long, toxic int")
    weights = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.predict(docs, weights).collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i in range(200))
    assert got[901].predicted == 1 and got[None].score == got[900].score < 0.5
    kept = toxicity.without_toxic(docs, weights)
    assert kept.columns == docs.columns and kept.count() == 150 + 2
    assert toxicity.learn(docs.limit(0), labels) == {}
    assert toxicity.predict(docs, {}).where("predicted = 1").count() == 0
    assert toxicity.predict(docs.limit(0), weights).count() == 0


def test_ftrl_against_scalar_updates():
    """FTRL-proximal coordinate by coordinate in plain Python; the constant has no L1."""
    import math
    rng = np.random.default_rng(7)
    examples = [(np.unique(rng.integers(0, 50, 8)), int(rng.random() < .3)) for _ in range(300)]
    z, n = {}, {}

    def weight(i):
        l1 = 0.0 if i == 1 << toxicity.BITS else toxicity.L1
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((toxicity.BETA + math.sqrt(ni)) / toxicity.ALPHA + toxicity.L2)
    model = toxicity.Ftrl()
    for at, y in examples:
        model.learn(at, y)
        keys = [int(i) for i in at] + [1 << toxicity.BITS]
        w = {i: weight(i) for i in keys}
        p = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values())))))
        g = (p - y) * (toxicity.TOXIC_WEIGHT if y else 1)
        for i in keys:
            ni = n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (math.sqrt(ni + g * g) - math.sqrt(ni)) / toxicity.ALPHA * w[i]
            n[i] = ni + g * g
    got = model.weights(slice(None))
    assert np.allclose([got[i] for i in z], [weight(i) for i in z], rtol=1e-9, atol=1e-12)
    assert got[-1] != 0
