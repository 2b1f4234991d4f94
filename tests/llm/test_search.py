"""Ranked lexical search against scoring every document for every query."""

import random
import re
from collections import Counter

import pytest

from cohortlink.llm.search import plain_weight, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, queries, k):
    terms = [plain_terms(t) for _, t in docs]
    n_docs, n_terms = sum(1 for t in terms if t), sum(map(len, terms))
    df = Counter(x for t in terms for x in set(t))
    out = []
    for item, text in queries:
        q = set(plain_terms(text))
        rows = []
        for i, ((doc, _), t) in enumerate(zip(docs, terms)):
            tf, m = Counter(t), 50 + (50 * len(t) * n_docs) // max(n_terms, 1)
            score = sum(plain_weight(n_docs, df[x]) * (10 ** 9 * tf[x] // (1000 * tf[x] + 20 * m)) for x in q if tf[x])
            if score > 0:
                rows.append((-score, doc is None, doc or 0, i, doc, score))
        out += [(item, r + 1, row[4], row[5]) for r, row in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_against_all_pairs(spark, make_docs, k):
    rng = random.Random(k)
    vocab = ["Alpha", "beta", "gamma", "délta", "x1", "9", "the", "of", "ÉCOLE", "naïve"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30))) + rng.choice(["", ".", ",the"])) for i in range(120)]
    docs += [(None, "alpha beta"), (7, "alpha beta"), (121, None), (122, ""), (123, "!!! ..."), (124, "x" * 50000 + " beta")]
    docs += docs[:4]
    queries = [(1, "alpha beta"), (2, "the of"), (3, None), (4, "ÉCOLE gamma 9"), (5, "zzz"), (6, "Beta, BETA; beta")]
    bench = spark.createDataFrame(queries, "item_id long, text string")
    got = search(make_docs(docs), bench, k=k).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, queries, k)


def test_only_pairs_that_reach_the_floor_leave_their_row(spark, make_docs, monkeypatch):
    """Every document shares a word with every query, yet only those at or above an item's k-th early score are kept."""
    from cohortlink.llm import search as module
    sizes, plain_stored = [], module.stored

    def watched(df):
        out = plain_stored(df)
        if {"item_id", "score"} <= set(out.columns) and "rank" not in out.columns:
            sizes.append(out.count())
        return out
    monkeypatch.setattr(module, "stored", watched)
    rng = random.Random(4)
    docs = [(i, "the " * rng.randint(1, 3) + " ".join(rng.choice(["alpha", "beta", "gamma", "x", "y"]) for _ in range(rng.randint(1, 40))))
            for i in range(300)]
    queries = [(i, f"the {w}") for i, w in enumerate(["alpha", "beta", "gamma", "alpha beta"])]
    got = module.search(make_docs(docs), spark.createDataFrame(queries, "item_id long, text string"), k=3).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, queries, 3)
    assert sizes and sum(sizes) < 300


def test_empty(spark, make_docs):
    bench = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search(make_docs([(1, "b")]).limit(0), bench).count() == 0
    assert search(make_docs([(1, "a")]), bench.limit(0)).count() == 0
