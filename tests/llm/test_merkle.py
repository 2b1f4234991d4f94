"""Merkle trees: equality, place of edits, likeness, and the order of documents."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlink.llm import merkle
from cohortlink.llm.queries import fingerprints


def text(seed, lines=30):
    rng = random.Random(seed)
    return "\n".join(" ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(rng.randrange(5, 40)))
                     for _ in range(lines))


@given(st.text(alphabet="ab \n;|é", max_size=200), st.text(alphabet="ab \n;|é", max_size=200))
@settings(max_examples=200, deadline=None)
def test_trees(left, right):
    a, b = merkle.tree(left), merkle.tree(right)
    assert (a[0] == b[0]) == (left == right)
    assert merkle.read(merkle.write(a)) == a
    near = merkle.likeness(merkle.write(a), merkle.write(b))
    assert 0 <= near <= 1 and near == merkle.likeness(merkle.write(b), merkle.write(a))
    assert near == merkle.alike(a, b) and (near == 1 or left != right)


def test_edits_are_found():
    lines = text(1).split("\n")
    changed = lines.copy()
    changed[17] += " more words here"
    a, b = (merkle.write(merkle.tree("\n".join(x))) for x in (lines, changed))
    sections = merkle.read(a)[1]
    (section, paragraph), = merkle.edits(a, b)
    assert sum(len(s[1]) for s in sections[:section]) + paragraph == 17
    assert merkle.edits(a, a) == [] and merkle.likeness(a, b) > 0.95


def test_likeness_follows_what_is_kept():
    for one_line in (False, True):
        whole, other = (text(i, 40) for i in (2, 3))
        if one_line:
            whole, other = whole.replace("\n", " "), other.replace("\n", " ")
        changed = merkle.edited(whole, other)
        a, b, c = (merkle.write(merkle.tree(t)) for t in (whole, changed, other))
        assert 0.4 < merkle.likeness(a, b) < 0.6 and merkle.likeness(a, c) < 0.05


@pytest.mark.parametrize("per_range", [1, 3, 1000])
def test_order(spark, make_docs, per_range):
    rows = [(7, "seven é lines"), (-3, "minus three"), (5, None), (5, "x"), (40, ""), (None, "none"), (12, "a\n" * 5),
            (2 ** 62, "z" * 70_000)]
    docs = make_docs(rows).withColumn("fingerprint", F.lit("mine")).repartition(4)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = {(r.doc_id, r.n_chars): r for r in merkle.compare_with_next(docs, per_range).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, following) in zip(ordered, [*ordered[1:], ordered[0]]):
        t, following = t or "", following or ""
        r = got[i, len(t)]
        assert r.edited_text == t[:len(t) - len(t) // 2] + following[:len(t) // 2]
        assert r.fingerprint == merkle.write(merkle.tree(t))
        assert r.edited_fingerprint == merkle.write(merkle.tree(r.edited_text))
        assert r.near_next == merkle.likeness(r.fingerprint, merkle.write(merkle.tree(following)))
    assert merkle.compare_with_next(docs.limit(0)).count() == 0
    alone = merkle.compare_with_next(make_docs([(1, "abcd")])).first()
    assert alone.edited_text == "abab" and alone.near_next == 1


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    got = {r.doc_id: r for r in fingerprints(spark, folder).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, following) in zip(rows, [*rows[1:], rows[0]]):
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(merkle.edited(t, following).encode()).hexdigest()
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t, set()).add(got[i].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    long = [r for r in got.values() if r.n_chars > 2000]
    assert sum(r.near_edited > 0.3 for r in long) > 0.9 * len(long)
