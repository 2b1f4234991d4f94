"""Patience alignment and scans of planted and changed copies."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlink.llm import licenses as li
from cohortlink.llm.queries import license_scan

ALL = [li.Template(n, t, 0.8) for n, t in li.TEMPLATES.items()]
FILL = "some other words of the text that are here for any reason and under no terms at all ".split()


@given(st.lists(st.integers(0, 50), max_size=30))
def test_rising(numbers):
    run = [numbers[i] for i in li.rising(numbers)]
    longest = [1] * len(numbers)
    for i in range(len(numbers)):
        longest[i] = 1 + max([longest[j] for j in range(i) if numbers[j] < numbers[i]], default=0)
    assert len(run) == max(longest, default=0) and run == sorted(set(run))


@given(st.lists(st.sampled_from("abcdefgh"), max_size=25), st.lists(st.sampled_from("abcdefgh"), max_size=25))
@settings(max_examples=300)
def test_alignment(a, b):
    pairs = li.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert li.align(a, a) == [(i, i) for i in range(len(a))]


@pytest.mark.parametrize("name", li.TEMPLATES)
def test_copies_are_found_where_they_are(name):
    rng = random.Random(name)
    copy = li.TEMPLATES[name]
    text = " ".join(rng.choices(FILL, k=300)) + ". " + copy + " " + " ".join(rng.choices(FILL, k=300)) + "\n" + copy.upper()
    got = [m for m in li.scan(text, ALL) if m["license"] == name]
    assert [m["coverage"] for m in got] == [1, 1]
    assert all(li.WORD.findall(text[m["begin"]:m["end"]].lower()) == li.WORD.findall(copy.lower()) for m in got)


def test_changed_copy():
    words = li.TEMPLATES["MIT"].split()
    rng = random.Random(4)
    for i in rng.sample(range(len(words)), 12):
        words[i] = "changed"
    got, = li.scan("Intro words. " + " ".join(words), ALL)
    assert got["license"] == "MIT" and 0.85 < got["coverage"] < 1
    assert li.scan(" ".join(words[:60]), ALL) == []


@pytest.mark.parametrize("text", [
    "Licensed under the Apache License (the License), Version 2.0",
    "Licensed, that is licensed, under the Apache License: the Apache one, Version 2.0",
])
def test_repeated_marks_lose_no_copy(text):
    assert [m["coverage"] for m in li.scan(text, ALL) if m["license"] == "Apache-2.0 notice"] == [1]


@pytest.mark.parametrize("name", ["MIT", "ISC"])
def test_inserted_marks_in_a_long_copy(name):
    template = next(t for t in ALL if t.name == name)
    rng = random.Random(7)
    words = list(template.words)
    for _ in range(15):
        words.insert(rng.randrange(len(words)), rng.choice(sorted(template.marks)))
    got = [m for m in li.scan(" ".join(words), ALL) if m["license"] == name]
    assert [m["coverage"] for m in got] == [1]


def table_length(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        rows.append([0])
        for j, y in enumerate(b):
            rows[-1].append(rows[-2][j] + 1 if x == y else max(rows[-2][j + 1], rows[-1][j]))
    return rows[-1][-1]


@given(st.lists(st.sampled_from("abcdefgx"), max_size=30), st.sampled_from(["abcdef", "abcabd", "aab"]))
@settings(max_examples=300)
def test_against_every_window(words, text):
    template = li.Template("t", " ".join(text), 0.8)
    windows = [(b, e) for b in range(len(words)) for e in range(b + 1, min(len(words), b + len(text)) + 1)
               if table_length(words[b:e], template.words) >= template.least]
    apart, end = 0, 0
    for b, e in sorted(windows, key=lambda w: w[1]):
        if b >= end:
            apart, end = apart + 1, e
    regions = template.regions(words)
    assert len(regions) >= apart and all(p[1] <= q[0] for p, q in zip(regions, regions[1:]))
    for b, e in regions:
        pairs = li.longest(words[b:e], template.words)
        assert len(pairs) == table_length(words[b:e], template.words) >= template.least
        assert all(words[b + i] == template.words[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


@pytest.mark.parametrize("text, names", [
    ("Licensed under CC BY 4.0.", ["CC-BY-4.0 notice"]),
    ("Licensed under CC BY-NC-SA 3.0.", ["CC-BY-NC-SA-3.0 notice"]),
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0 notice"]),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0 notice"]),
    ("This work is licensed under the GNU Lesser General Public License, version 2.1.", ["LGPL-2.1 notice"]),
    ("Released under the BSD License", ["BSD notice"]), ("Released under the Other License", []),
    (li.TEMPLATES["BSD-2-Clause"], ["BSD-2-Clause"]), (li.TEMPLATES["BSD-3-Clause"], ["BSD-3-Clause"]),
    (li.TEMPLATES["MIT-0"], ["MIT-0"]), (li.TEMPLATES["LGPL-3.0 header"], ["LGPL-3.0 header"]),
    (li.TEMPLATES["AGPL-3.0 header"], ["AGPL-3.0 header"]),
])
def test_siblings(text, names):
    assert [m["license"] for m in li.scan("Words before. " + text + " words behind", ALL)] == names


@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-2", "GPL-3", "AGPL-3", "LGPL-2.1", "MPL-2.0"])
def test_full_texts(name):
    text = li.TEMPLATES[f"{name} text"]
    assert [m["license"] for m in li.scan(text, ALL) if m["coverage"] > 0.8 and m["license"].endswith("text")] == [f"{name} text"]


def test_rows(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "İ " * 5 + "Released under the MIT License."), (3, "x " * 200_000), (4, "...")])
    got = sorted((r.doc_id, len(r.matches), None if r.text is None else len(r.text)) for r in li.find(docs.withColumn("matches", F.lit("mine"))).collect())
    assert got == sorted([(1, 0, None), (2, 0, 0), (3, 1, 41), (3, 0, 400_000), (4, 0, 3)])
    match = li.find(docs).where("size(matches) > 0").first()
    assert match.text[match.matches[0].begin:match.matches[0].end] == "Released under the MIT License"
    assert li.find(docs.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r for r in license_scan(spark, folder).collect()}
    assert len(got) == len(texts)
    short = {n: re.compile(re.escape(t.rstrip("."))) for n, t in li.TEMPLATES.items() if n.endswith("notice")}
    planted = 0
    for i, text in texts.items():
        want = {n for n, p in short.items() if p.search(text)}
        planted += len(want)
        assert want <= {m.license for m in got[i].matches if m.coverage == 1}
        assert got[i].n_matches == len(got[i].matches)
    assert planted > 10
