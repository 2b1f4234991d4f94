"""Vector code compression against plain Lloyd rounds over every part."""

import hashlib
import math
import random

import numpy as np
import pytest

from cohortlink.llm.codes import compress, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    ints = {i: [math.floor(float(np.float32(x)) * 1024) for x in r[1]] for i, r in enumerate(kept)}
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, ints[i]))
    width = len(ints[order[0]])
    keep = [i for i in range(len(kept)) if len(ints[i]) == width]
    order = [i for i in order if i in keep][:256]
    cut = [p * width // 4 for p in range(5)]
    books = [[ints[i][cut[p]:cut[p + 1]] for i in order] for p in range(4)]

    def assign(p, v):
        d = [sum((a - b) ** 2 for a, b in zip(e, v)) for e in books[p]]
        best = min(range(len(d)), key=lambda j: (d[j], j))
        return best, d[best]
    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for i in keep:
                v = ints[i][cut[p]:cut[p + 1]]
                groups.setdefault(assign(p, v)[0], []).append(v)
            for e, vs in groups.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs)] if vs[0] else []
    out = {}
    for i in keep:
        codes = [assign(p, ints[i][cut[p]:cut[p + 1]]) for p in range(4)]
        out[i] = ("".join(f"{c:02x}" for c, _ in codes), sum(d for _, d in codes))
    by_label = {}
    for i in keep:
        by_label[kept[i][2]] = by_label.get(kept[i][2], 0) + out[i][1]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((kept[i][0], *out[i], by_label[kept[i][2]], sha) for i in keep), key=str)


def test_trie_is_brute_force():
    rng = np.random.default_rng(3)
    book = rng.integers(-5, 5, (17, 6))
    parts = np.unique(rng.integers(-5, 5, (3000, 6)), axis=0)
    entries, distances = nearest(parts, book)
    d = ((parts[:, None, :] - book[None]) ** 2).sum(-1)
    assert (entries == d.argmin(1)).all() and (distances == d.min(1)).all()


@pytest.mark.parametrize("seed", [0, 1])
def test_against_plain_rounds(spark, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(rng.choice([i, i, None]) if i % 13 == 0 else i, [c + rng.gauss(0, .05) for c in rng.choice(centres)], rng.choice([0, 1, None]))
            for i in range(300)]
    rows += rows[:20] + [(900, None, 1), (901, [1.0, None] + [0.0] * 6, 1), (902, [float("nan")] * 8, 0), (903, [float("inf")] + [0.0] * 7, 0),
                         (904, [0.5] * 5, 1)]
    rng.shuffle(rows)
    got = compress(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_few_and_none(spark):
    rows = [(5, [0.1, 0.2, 0.3, 0.4], 1), (3, [0.1, 0.2, 0.3, 0.5], None), (3, [0.1, 0.2, 0.3, 0.5], None)]
    assert sorted(map(tuple, compress(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == plain(rows)
    assert compress(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0
