"""Every stage of the pipeline against a plain version on what the stage before kept."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cohortlink.llm import toxicity
from cohortlink.llm.common import remainder
from tests.llm.test_exact_mixture import targets
from tests.llm.test_simhash import plain_print, roots

FOLDER = "/root/testdata/sf0.001"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def mixed(rows, block=32):
    """How often the mix takes each document, to the nearest whole number."""
    size = defaultdict(int)
    for r in rows:
        size[r.source] += words(r.text)
    target = targets(size)
    total = sum(target.values())
    shares, low = [], 0.0
    for s in sorted(size, key=lambda s: (s is None, s or "")):
        shares.append((int(low / total * 2 ** 32), int((low + target[s]) / total * 2 ** 32), s))
        low += target[s]
    slots = Counter()
    for i in range(-int(-total // block)):
        point = i * 2654435769 % 2 ** 32
        slots.update(s for a, b, s in shares if a <= point < b)
    times = {}
    for s in size:
        stream = sorted((hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id, words(r.text)) for r in rows if r.source == s)
        visits = Counter(k % -(-size[s] // block) for k in range(slots[s]) if k * block < target[s])
        at = 0
        for _, doc_id, n in stream:
            taken = sum(visits[w // block] for w in range(at, at + n))
            at += n
            if n:
                times[doc_id] = int(taken / n + 0.5)
    return Counter({k: v for k, v in times.items() if v})


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER).cache()
        if name != "encoded":
            assert docs.columns == columns
        kept[name] = docs.collect()
    raw = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()

    all_docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where(remainder(F.col("doc_id"), 5) != 0)
    weights = toxicity.learn(all_docs, labels)
    score = {r.doc_id: sum(weights.get(int(p), 0) for p in toxicity.distinct_places(r.text, toxicity.Words()))
             + weights.get(1 << toxicity.BITS, -1e-9) for r in raw}
    assert {r.doc_id for r in kept["without_toxic"]} == {i for i, s in score.items() if s < 0}

    first = {}
    for r in sorted(kept["without_toxic"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    assert sorted(kept["exact_dedup"]) == sorted(first.values())

    prints = {r.doc_id: plain_print(r.text) for r in kept["exact_dedup"]}
    root = roots(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert sorted(kept["near_dedup"]) == sorted(r for r in kept["exact_dedup"] if root[r.doc_id] == r.doc_id)

    assert Counter(r.doc_id for r in kept["source_mix"]) == mixed(kept["near_dedup"])

    library = Tokenizer.from_file(corpus_pipeline.VOCABULARY)
    assert Counter(r.doc_id for r in kept["encoded"]) == Counter(r.doc_id for r in kept["source_mix"])
    for r in kept["encoded"]:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert (r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (len(ids), ids)

    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted(r.doc_id for r in kept["encoded"])


def test_awkward_rows_go_through(spark, make_docs, monkeypatch):
    docs = make_docs([(1, None), (2, ""), (None, "one two three four five " * 9), (3, "a b c d e f g", "en", "s1", 3), (3, "a b c d e f g"),
                      (4, "long " * 100_000, "en", None)])
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, FOLDER)
        rows.collect()
