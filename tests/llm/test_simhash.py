"""SimHash against a plain reckoning of all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortlink.llm.components import components
from cohortlink.llm.simhash import (drop_near_copies, fingerprint_of, grouped, hexadecimal, joined_up,
                                    mark_near_copies)


def plain_print(text, size=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


TEXTS = ["", None, "   \t", "One", "one two three", "one two three four", "Ä B c\x0bd  e\tf\r\ng", "a b a b a b a b",
         "x" * 70000 + " y", "a b c d e f g"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert fingerprint_of(text and text.encode()) % 2 ** 64 == plain_print(text)


def test_spark_hash_is_the_one_named(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b c d")), hexadecimal(F.lit(-2)), hexadecimal(F.lit(5))).first()
    assert got[0] % 2 ** 64 == xxhash.xxh64_intdigest(b"a b c d", 42)
    assert got[1:] == ("fffffffffffffffe", "0000000000000005")


def test_balls_find_all_near_pairs(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for p in list(prints):
        for _ in range(rng.randrange(4)):
            q = p
            for b in rng.sample(range(64), rng.randrange(7)):
                q ^= 1 << b
            prints.append(q)
    hub = rng.getrandbits(64)
    prints += [hub ^ 1 << a ^ 1 << b for a, b in combinations(range(24), 2)] + prints[:5]
    rng.shuffle(prints)
    rows = [(i, int(np.uint64(p).astype(np.int64))) for i, p in enumerate(prints)]
    want = roots(range(len(prints)), [(i, j) for i, j in combinations(range(len(prints)), 2)
                                      if (prints[i] ^ prints[j]).bit_count() <= 4])
    df = spark.createDataFrame(rows, "doc_id long, print long").repartition(5)
    for passes in (1, 3):
        got = df.join(grouped(df, passes=passes), "print").select("doc_id", "component_id").collect()
        assert dict(map(tuple, got)) == want
        assert len(got) == len(prints)


@pytest.mark.parametrize("pairs", [[], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)],
                                   [(i * 7 % 211, (i * 31 + 5) % 211) for i in range(90)], [(3, 3)]])
def test_components(spark, pairs):
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    labels = {r.node: r.label for r in got}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    want = roots(nodes, [p for p in pairs if p[0] != p[1]])
    assert set(labels) == nodes and len(got) == len(nodes)
    assert len({(labels[n], want[n]) for n in nodes}) == len(set(want.values())) == len(set(labels.values()))
    if pairs:
        a, b = joined_up(np.array(pairs, np.uint64).T)
        assert {int(x): int(y) for x, y in zip(a, b)} == {n: r for n, r in want.items() if n != r}


def test_documents(spark, make_docs):
    base = " ".join(f"word{i}" for i in range(400))
    docs = make_docs([(5, base), (9, base + " end"), (2, base.upper()), (7, "other words are here now"), (7, None), (3, ""),
                      (None, base), (11, "  "), (7, "other words are here now")]).withColumn("print", F.lit("mine"))
    rows = [(r.doc_id, r.component_id) for r in mark_near_copies(docs).collect()]
    assert sorted(rows, key=str) == sorted([(5, 2), (9, 2), (2, 2), (None, 2), (7, 7), (7, 7), (7, 3), (3, 3), (11, 3)], key=str)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 7]
    unnamed = make_docs([(None, base), (None, base)])
    assert drop_near_copies(unnamed).count() == 1
    assert mark_near_copies(docs.limit(0)).count() == 0 and drop_near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "comb", "reversed"])
def test_component_rounds_are_logarithmic(spark, shape):
    from cohortlink.llm.components import star_components
    n = 256
    pairs = {"chain": [(i, i + 1) for i in range(n)], "star": [(n, i) for i in range(n)],
             "comb": [(i, i + 1) for i in range(0, n, 2)] + [(i, i + n) for i in range(0, n, 2)],
             "reversed": [(n - i, n - i - 1) for i in range(n)]}[shape]
    labels, rounds = star_components(spark.createDataFrame(pairs, "a long, b long"))
    want = roots({x for p in pairs for x in p}, pairs)
    assert {r.node: r.label for r in labels.collect()} == want
    assert rounds <= np.log2(2 * n) + 2
