"""Context-tree weighting against a plain tree, and the unigram model against plain counts."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortlink.llm import ctw
from cohortlink.llm.queries import language_model

TRAIN = ["The cat sat on the mat", "the cat  ate the\trat", "a rat sat", "", None, "Ä cat", "the the the the"] * 3
OTHER = ["the cat sat", "zebra", "Ä", None, "the mat the mat the mat", "the cat sat on the mat"]


def stream(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return b" ".join(words) + b"\n"


class Plain:
    """Trees in dictionaries, from the definition."""

    def __init__(self, texts):
        self.n = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for text in texts:
            for context, lead, bit in self.decisions(text):
                for d in range(ctw.DEPTH + 1):
                    self.n[context[:d], lead][bit] += 1
                    if d:
                        self.children[context[:d - 1], lead].add(context[:d])

    @staticmethod
    def decisions(text):
        data = b"\n" * ctw.DEPTH + stream(text)
        for i in range(ctw.DEPTH, len(data)):
            bits = f"{data[i]:08b}"
            for j in range(8):
                yield data[i - ctw.DEPTH:i][::-1], bits[:j], int(bits[j])

    def block(self, node):
        a, b = self.n[node]
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def below(self, node):
        return sum(self.weighted((c, node[1])) for c in self.children[node])

    def weighted(self, node):
        if len(node[0]) == ctw.DEPTH:
            return self.block(node)
        return math.log(.5 * math.exp(self.block(node)) + .5 * math.exp(self.below(node)))

    def one(self, context, lead, depth=0):
        node = context[:depth], lead
        if node not in self.n:
            return None
        a, b = self.n[node]
        here = (b + .5) / (a + b + 1)
        deeper = self.one(context, lead, depth + 1) if depth < ctw.DEPTH else None
        if deeper is None:
            return here
        own = 1 / (1 + math.exp(self.below(node) - self.block(node)))
        return own * here + (1 - own) * deeper

    def score(self, text):
        total = 0.0
        for context, lead, bit in self.decisions(text):
            p = self.one(context, lead)
            p = .5 if p is None else p
            total += math.log10(p if bit else 1 - p)
        return total


def base(train, text):
    def tokens(t):
        return stream(t).split() + [b""]
    counts = Counter(w for t in train for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return (len(tokens(text)), sum(counts[w] > 0 for w in tokens(text)), n,
            sum(math.log10((counts[w] + .1) / (n + .1 * (v + 1))) for w in tokens(text)))


def test_against_a_plain_tree(spark, make_docs):
    plain = Plain(TRAIN)
    model = ctw.learn(make_docs(list(enumerate(TRAIN))).select("text").repartition(3))
    texts = TRAIN[:7] + OTHER
    got = {r.doc_id: r for r in ctw.score(make_docs(list(enumerate(texts))), model).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].score == pytest.approx(plain.score(t), rel=1e-6)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == base(TRAIN, t)[:3]
        assert got[i].base_score == pytest.approx(base(TRAIN, t)[3], rel=1e-9)
        assert got[i].n_bytes == len(stream(t))


def test_texts_are_dealt_once_and_answers_are_not_kept_beside_their_shuffle(spark, make_docs, monkeypatch):
    """Only the counts are stored; a block of several chunks of text gives the same scores."""
    kept, plain_stored = [], ctw.stored
    monkeypatch.setattr(ctw, "stored", lambda df: kept.append(df.columns) or plain_stored(df))
    monkeypatch.setattr(ctw, "CHUNK", 20)
    plain, texts = Plain(TRAIN), TRAIN[:7] + OTHER
    scored = ctw.score(make_docs(list(enumerate(texts))), ctw.learn(make_docs(list(enumerate(TRAIN))).select("text")))
    got = {r.doc_id: r for r in scored.collect()}
    for i, t in enumerate(texts):
        assert got[i].score == pytest.approx(plain.score(t), rel=1e-6)
        assert (got[i].n_tokens, got[i].n_known, got[i].base_score) == (*base(TRAIN, t)[:2], pytest.approx(base(TRAIN, t)[3], rel=1e-9))
    assert kept == [["part", "keys", "counts"]]
    assert "ReusedExchange" in scored._jdf.queryExecution().executedPlan().toString()


def test_six_bytes_of_context_in_full_numbers(spark, make_docs):
    train = ["xabcdefg yabcdefh"] * 40
    plain = Plain(train)
    texts = ["xabcdefg", "yabcdefh", "xabcdefh", "other words"]
    got = {r.doc_id: r for r in ctw.score(make_docs(list(enumerate(texts))), ctw.learn(make_docs(list(enumerate(train))).select("text"))).collect()}
    assert all(got[i].score == pytest.approx(plain.score(t), rel=1e-9) for i, t in enumerate(texts))
    assert len(plain.decisions("a").__next__()[0]) == 6


@pytest.mark.parametrize("part", [0, 0x2061, ctw.FIRST_WORD_PART - 1])
def test_packed_numbers_come_back(part):
    low = np.array([0, 1, 255, 256, (1 << 8 * ctw.SUFFIX) - 1], np.uint64)
    keys = low + (np.uint64(part) << np.uint64(8 * ctw.SUFFIX))
    counts = np.array([1, 300, 1 << 33, 7, 255], np.int64)
    values = -np.array([0.0, 1e-300, 1 / 3, 12.5, 7e9])
    cell = ctw.pa.scalar
    assert (ctw.unpack_keys(cell(ctw.pack_keys(keys, part)), part) == keys).all()
    assert (ctw.unpack_counts(cell(ctw.pack_counts(counts)), 5) == counts).all()
    assert (ctw.unpack_values(cell(ctw.pack_values(values))) == values).all()
    assert not len(ctw.unpack_keys(cell(ctw.pack_keys(keys[:0], part)), part)) and not len(ctw.unpack_counts(cell(ctw.pack_counts(counts[:0])), 0))


def test_probabilities_of_all_bytes_add_up_to_one(monkeypatch):
    keys, counts = ctw.tally(ctw.grams([ctw.words_of((t or "").encode()) for t in TRAIN])[0])
    parts = [ctw.Subtree(keys[b:e], counts[b:e]) for _, b, e in ctw.cut(ctw.gram_parts(keys))]

    class Row:
        pass
    sums = defaultdict(lambda: np.zeros(3))
    for part in parts:
        for bit, level in enumerate(part.levels[ctw.SPLIT]):
            for k, *row in zip(level.keys.tolist(), level.n0, level.n1, level.log):
                sums[k >> 16 << 16 | bit << 8 | k & 255] += row
    rows = []
    for node, (n0, n1, log) in sums.items():
        row = Row()
        row.node, row.n0, row.n1, row.log = node, n0, n1, log
        rows.append(row)
    top = ctw.Top(rows)
    for context in (keys[5], keys[40], np.uint64(0x7A7A7A7A7A00), np.uint64(0x20657A7A7A00)):
        every = (context >> np.uint64(8) << np.uint64(8)) + np.arange(256, dtype=np.uint64)
        subtree = next((p for p in parts if ctw.gram_parts(p.levels[ctw.DEPTH][0].keys[:1] )[0] == ctw.gram_parts(every[:1])[0]), None)
        logs = ctw.log10s(every, subtree or ctw.Subtree(keys[:0], counts[:0]), top)
        assert (10.0 ** logs).sum() == pytest.approx(1)


def test_large_counts():
    n0, n1 = np.array([0, 3, 300, 70_000, 5, 16_383]), np.array([0, 700, 256, 5, 255, 1])
    want = [math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi) for a, b in zip(n0, n1)]
    assert ctw.log_block(n0, n1) == pytest.approx(want, rel=1e-10)


def test_rows(spark, make_docs):
    docs = make_docs([(1, "a b"), (1, "a b"), (None, None), (2, "x" * 300_000 + " y")])
    nothing = ctw.score(docs, ctw.learn(docs.limit(0).select("text"))).collect()
    assert sorted(r.score for r in nothing)[-1] == pytest.approx(8 * math.log10(.5))
    assert all(r.train_tokens == r.n_known == 0 for r in nothing) and len(nothing) == 4
    assert ctw.score(docs.limit(0), ctw.learn(docs.select("text"))).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = {i for i in rows if zlib.crc32(str(i).encode()) % 10 == 0}
    train = [t for i, t in rows.items() if i not in held]
    got = language_model(spark, folder).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if r.held_out} == held
    for r in got[:20]:
        assert (r.n_tokens, r.n_known, r.train_tokens) == base(train, rows[r.doc_id])[:3]
        assert r.base_score == pytest.approx(base(train, rows[r.doc_id])[3])
    assert all(r.bits_per_byte > 0 for r in got)


def test_beats_words_on_held_out_texts(spark):
    unseen = language_model(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
