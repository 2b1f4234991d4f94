"""Exact dedup and mixing on awkward rows, and whether the mix meets its targets."""

import pytest
from pyspark.sql import functions as F

from cohortlink.llm.exact import drop_copies, mark_copies
from cohortlink.llm.mixture import mix, mixed, source_targets


def test_copies(spark, make_docs):
    long = "word " * 60000
    docs = make_docs([(4, "a  b"), (2, "a\tb"), (3, "ab"), (None, "a\nb"), (5, None), (1, ""), (6, long + "x"),
                      (7, long + "y"), (8, long + "x"), (9, " "), (9, "\r\n"), (10, "same"), (10, "same")])
    docs = docs.withColumn("keep_id", F.lit("mine"))
    got = sorted((r.doc_id is None, r.doc_id, r.keep_id, r.group_size, r.kept) for r in mark_copies(docs).collect()
                 if r.doc_id is not None)
    assert got == sorted([(False, 4, 2, 3, False), (False, 2, 2, 3, True), (False, 3, 3, 1, True), (False, 5, 1, 2, False),
                          (False, 1, 1, 2, True), (False, 6, 6, 2, True), (False, 7, 7, 1, True), (False, 8, 6, 2, False),
                          (False, 9, 9, 2, True), (False, 9, 9, 2, True), (False, 10, 10, 2, True), (False, 10, 10, 2, True)])
    kept = drop_copies(docs.drop("keep_id"))
    assert kept.columns == docs.columns[:-1]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 6, 7, 9, 10]
    assert mark_copies(docs.limit(0)).count() == 0


def test_one_id_for_several_texts(make_docs):
    start = "x" * 300
    docs = make_docs([(1, start + "a"), (2, start + "b"), (2, start + "a"), (0, start + "b")])
    assert drop_copies(docs).count() >= 2
    assert {r.text[-1] for r in drop_copies(docs).collect()} == {"a", "b"}


def targets(sizes, weights=(1, 2, 3), most=3):
    """Shared out again and again until no source is above its bound."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        level = (total - sum(full.values())) / sum(weight[s] for s in free) if free else 0
        over = {s: most * sizes[s] for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return full | {s: weight[s] * level for s in free}
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 900, "b": 10, "c": 20, None: 70}, {"b": 5}, {"a": 0, "b": 0}, {"a": 1, "b": 1, "c": 1},
                                   {"a": 4000, "b": 1000, "c": 300, "d": 300, "e": 300, "é": 800, "Z": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(targets(sizes))


def test_mix_meets_targets(spark, make_docs):
    rows = [(i, "w " * (i * 37 % 200), None, f"s{i * i % 5}" if i % 3 else "s0") for i in range(600)]
    rows += [(None, "x y", None, None), (700, None, None, "s1"), (701, "", None, None), (3, "w " * 111, None, "s4")]
    docs = make_docs(rows).withColumn("target", F.lit("mine"))
    got = mix(docs, block=4).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(sum(len((r[1] or "").split()) for r in rows))
    for s in target:
        assert abs(taken[s] - target[s]) <= 40 + 0.02 * target[s]
    again = {(r.doc_id, r.taken) for r in mix(docs.repartition(3), block=4).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    times = mixed(docs.drop("target"), block=4)
    assert times.columns == docs.columns[:-1]
    assert times.count() == sum(int(r.taken / r.size + 0.5) for r in got if r.size)
    assert mix(docs.limit(0)).count() == 0 and mixed(docs.limit(0)).count() == 0
