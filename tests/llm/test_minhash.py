"""MinHash near duplicates against all pairs of whole shingle sets."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlink.llm import minhash
from cohortlink.llm.minhash import drop_near_copies, mark_near_copies, near_components, parity_sketch


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) == 1:
        return set(words)
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def plain(rows):
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            up[find(i)] = find(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            smallest[r] = d if smallest.get(r) is None else min(smallest[r], d)
    return [(d, len(sets[i]), smallest.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def variants(rng, n):
    vocab = [f"w{i}" for i in range(40)]
    base = [rng.choice(vocab) for _ in range(rng.randint(1, 60))]
    rows = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(words) + 1)
            op = rng.random()
            if op < .4 and words:
                words[min(k, len(words) - 1)] = rng.choice(vocab)
            elif op < .7:
                words.insert(k, rng.choice(vocab))
            elif words:
                del words[min(k, len(words) - 1)]
        rows.append(" ".join(words))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, make_docs, seed):
    rng = random.Random(seed)
    texts = [t for _ in range(12) for t in variants(rng, rng.randint(1, 6))]
    texts += ["", None, "  \t", "One", "ONE", "one two", "a b a b a b", "x " * 3000 + "y", "x " * 3000 + "z"]
    rows = [(rng.choice([i, i, None]) if i % 17 == 0 else i, t) for i, t in enumerate(texts)]
    rows += rows[:5]
    got = mark_near_copies(make_docs(rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    want = plain(rows)
    assert sorted(map(tuple, [r[:3] for r in got]), key=str) == sorted(want, key=str)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)
    slim = near_components(make_docs(rows)).collect()
    assert sorted(map(tuple, slim), key=str) == sorted(map(tuple, got), key=str)


def test_parity_sketches_bound_the_difference():
    rng = random.Random(3)
    for n in (1, 5, 255, 300, 1000, 5000):
        base = [rng.getrandbits(63) for _ in range(n + n // 4 + 1)]
        a, b = np.unique(base[:n]), np.unique(base[rng.randint(0, n // 4):])
        p, q = parity_sketch(a), parity_sketch(b)
        while len(p) != len(q):
            p, q = sorted((p, q), key=len)
            q = q[:len(q) // 2] ^ q[len(q) // 2:]
        apart = sum(int(x).bit_count() for x in (p ^ q).view(np.uint64))
        assert len(p) & (len(p) - 1) == 0 and apart <= len(np.setxor1d(a, b))
        assert 64 * len(parity_sketch(a)) >= len(a)


def test_pairs_that_share_a_line_are_dropped_before_their_sketches_meet(spark, make_docs, monkeypatch):
    """A shared line in otherwise different texts makes many pairs of postings, but hardly any that carries sketches or sets."""
    sizes, plain_stored = {}, minhash.stored

    def watched(df):
        out = plain_stored(df)
        sizes[tuple(out.columns)] = out.count()
        return out
    monkeypatch.setattr(minhash, "stored", watched)
    rng = random.Random(8)
    line = [f"s{i}" for i in range(40)]
    rows = [(i, " ".join([f"w{rng.randrange(10 ** 6)}" for _ in range(60)] + line)) for i in range(50)]
    rows += [(100 + i, t + " end") for i, t in rows[:3]]
    got = {r.doc_id: r.component_id for r in near_components(make_docs(rows)).collect()}
    assert got == {d: c for d, _, c in plain(rows)}
    # The pairs met in the postings, those within the parity bound, and those within both bounds.
    assert sizes["a", "b", "n_a", "n_b", "by_parity"] <= 30 and sizes["a", "b", "most"] <= 30


def test_a_group_of_near_copies_meets_in_proportion_to_its_size(spark, make_docs, monkeypatch):
    """60 near copies have 1770 pairs; stars around pivots meet a few times 60, and texts apart leave no postings."""
    sizes, plain_stored = [], minhash.stored

    def watched(df):
        out = plain_stored(df)
        if out.columns == ["a", "b"] or out.columns[:2] == ["value", "id"]:
            sizes.append((out.columns[0], out.count()))
        return out
    monkeypatch.setattr(minhash, "stored", watched)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(f"u{i}" if j == i * 3 else w for j, w in enumerate(base))) for i in range(60)]
    rows += [(100 + i, " ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(100))) for i in range(40)]
    got = {r.doc_id: r.component_id for r in near_components(make_docs(rows)).collect()}
    assert got == {d: c for d, _, c in plain(rows)}
    assert max(n for c, n in sizes if c == "a") <= 4 * 60 and max(n for c, n in sizes if c == "value") <= 60 * 41


def test_long_sets_need_long_sketches(spark, make_docs):
    # 5000 shingles, 800 changed in the second: a sketch of fixed length would often miss the pair.
    a = [f"t{i}" for i in range(5001)]
    b = list(a)
    for i in range(0, 4000, 10):
        b[i] = f"u{i}"
    rows = [(1, " ".join(a)), (2, " ".join(b))]
    got = {r.doc_id: r.component_id for r in mark_near_copies(make_docs(rows)).collect()}
    assert got == {d: c for d, _, c in plain(rows)}


def test_cases(spark, make_docs):
    docs = make_docs([(3, "a b c"), (1, "A B C"), (2, None), (4, ""), (5, "q")]).withColumnRenamed("lang", "kept") \
        .withColumn("component_id", F.lit("x"))
    got = mark_near_copies(docs)
    assert got.columns[-3:] == ["n_shingles", "component_id", "kept"] and got.columns.count("kept") == 1
    rows = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()}
    assert rows == {3: (2, 1, False), 1: (2, 1, True), 2: (0, 2, True), 4: (0, 4, True), 5: (1, 5, True)}
    assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == [1, 2, 4, 5]
    assert mark_near_copies(docs.limit(0)).count() == 0
