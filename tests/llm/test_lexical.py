"""Ranked search against plain Python."""

import collections
import math
import random
import re

import numpy as np
import pytest
from edge import docs_of

from loomline.llm import lexical, registry

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=50):
    own = [(d, collections.Counter(TERM.findall((t or "").translate(LOW)))) for d, t in docs]
    own = [x for x in own if x[1]]
    total, n_docs = sum(sum(c.values()) for _, c in own), len(own)
    df = collections.Counter(t for _, c in own for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for d, c in own:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(TERM.findall((text or "").translate(LOW))) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item_id, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return collections.Counter(out)


def rows(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.fixture
def odd():
    r = random.Random(3)
    word = lambda: r.choice("Alpha beta GAMMA delta épée Épée 日本 x1 42 naïve foo_bar it's a-b \x00c".split(" "))
    docs = [(i, " ".join(word() for _ in range(r.choice([1, 3, 40])))) for i in range(300)]
    docs += [(None, "alpha beta"), (None, "alpha beta"), (7, "alpha beta"), (7, "alpha beta"), (1000, None), (1001, ""), (1002, " \n-- "), (-5, "alpha beta")]
    docs += [(2000 + i, "copies of one text alpha") for i in range(120)]
    items = [(1, "ALPHA beta Épée"), (2, "alpha alpha x1 42"), (2, "copies of nothing"), (None, "naïve 日本"), (3, None), (4, ""), (5, "unknownword"), (6, "c text")]
    return docs, items


@pytest.mark.parametrize("shard_docs", [1 << 16, 7])
@pytest.mark.parametrize("block", [4 << 20, 20])
def test_search_equals_plain_python(spark, monkeypatch, odd, shard_docs, block):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(lexical, "BLOCK", block)
    docs, items = odd
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == plain(docs, items)


def test_query(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert rows(registry.QUERIES["op11_impact_search"](spark, sf)) == plain(docs_of(spark, sf), items)


def test_query_on_odd_rows(spark, edge_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{edge_dir}/benchmark.parquet").collect()]
    assert rows(registry.QUERIES["op11_impact_search"](spark, edge_dir)) == plain(docs_of(spark, edge_dir), items)


def test_very_long_texts(spark):
    docs = [(1, "alpha Beta " * 400_000), (2, "x" * (3 << 20)), (3, "é" * (1 << 20) + " beta"), (4, "beta")]
    items = [(1, "beta"), (2, "x" * (3 << 20)), (3, "é" * (1 << 20))]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == plain(docs, items)


def test_the_best_are_safe_with_ties():
    r = np.random.default_rng(0)
    for n in (0, 1, 49, 50, 51, 500):
        scores, ids, none = r.integers(0, 4, n), r.integers(0, 30, n), r.random(n) < 0.2
        want = sorted((i for i in range(n) if scores[i] > 0), key=lambda i: (-scores[i], none[i], ids[i]))[:50]
        got = lexical.best(scores, none, ids, 50)
        assert [(scores[i], none[i], ids[i]) for i in got] == [(scores[i], none[i], ids[i]) for i in want]
