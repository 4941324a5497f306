"""Operators that work in two levels or by rare keys, against plain loops, with keys that hold most of the rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomline.functions import text as tx
from loomline.operators import corpus, evaluation, retrieval
from loomline.streaming import streams


def stops(values, patience, tolerance=1e-4):
    """Best step and stop of a series of (order, value)."""
    best, at, bad = math.inf, None, 0
    for o, v in values:
        if v is not None and v < best - tolerance:
            best, at, bad = v, o, 0
        else:
            bad += 1
        if bad >= patience:
            return at, o
    return at, None


@pytest.mark.parametrize("patience", [1, 3, 40])
def test_early_stop_is_a_plain_loop(spark, patience):
    r = random.Random(patience)
    series = {f"s{i}": [(o, r.choice([None, r.random(), round(r.random(), 1), 1 - o / 200 + r.random() / 50])) for o in range(r.choice([1, 5, 200]))] for i in range(30)}
    series |= {"down": [(o, 1 - o / 500) for o in range(400)], "slow": [(o, 1 - o * 4e-5) for o in range(50)], "none": [(o, None) for o in range(9)], None: [(o, r.random()) for o in range(90)]}
    df = spark.createDataFrame([(k, o, v) for k, s in series.items() for o, v in s], "k string, o long, v double").repartition(5)
    got = {x.k: (x.best_step, x.stop_step) for x in evaluation.early_stop(df, ["k"], "o", "v", patience, chunk=16).collect()}
    assert got == {k: stops(s, patience) for k, s in series.items()}
    assert evaluation.early_stop(df.limit(0), ["k"], "o", "v", patience).count() == 0


def test_running_sums_within_a_hot_and_a_null_key(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), i, r.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long, v int").repartition(7)
    got = {x.i: (x.total, x.round) for x in corpus.running(corpus.interleave(df, "k", "i"), F.col("v"), "i", "total", ["k"]).collect()}
    sums, counts, want = {}, {}, {}
    for k, i, v in rows:
        sums[k], counts[k] = sums.get(k, 0) + v, counts.get(k, 0) + 1
        want[i] = sums[k], counts[k]
    assert got == want


@pytest.mark.parametrize(("least", "veto"), [(0.0, 99.0), (0.2, 3.0), (0.2, 2.0), (0.5, 99.0), (0.8, 4.0)])
def test_weighted_jaccard_is_a_plain_loop(spark, least, veto):
    r = random.Random(7)
    words = [f"{c}{d}zo" for c in "bcdfghjk" for d in "pqrtvw"]
    text = lambda: " ".join(r.choices(words, [1 / (i + 1) for i in range(len(words))], k=r.choice([0, 1, 3, 8])) + ["bpzo"] * r.randint(0, 1))
    bank = spark.createDataFrame([(i, text()) for i in range(150)] + [(900, None)], "id int, text string")
    asked = spark.createDataFrame([(i, text() + r.choice(["", "", " neverseen"])) for i in range(150)] + [(900, None)], "id int, text string")
    sets = lambda d: {x.id: set(x.t or []) for x in d.select("id", tx.bank_tokens(F.col("text")).alias("t")).collect()}
    b, q = sets(bank), sets(asked)
    df = {}
    for s in b.values():
        for t in s:
            df[t] = df.get(t, 0) + 1
    w = lambda t: math.log((len(b) + 1) / (df[t] + 0.5)) + 1 if t in df else math.log(len(b) + 2) + 1
    want = {}
    for i, s in q.items():
        found = []
        for j, o in b.items():
            both = s & o
            if both and all(t in o for t in s if w(t) >= veto):
                score = round(sum(map(w, sorted(both))) / sum(map(w, sorted(s | o))), 4)
                if score >= least:
                    found.append((-score, j))
        if found:
            want[i] = min(found)
    got = {x.q: (-x.score, x.item) for x in retrieval.weighted_jaccard(asked, bank, least, veto).collect()}
    assert got.keys() == want.keys() and len(want) > 5
    assert all(abs(got[i][0] - want[i][0]) < 2e-4 for i in want)
    assert sum(got[i][1] == want[i][1] for i in want) >= len(want) - 1
    assert retrieval.weighted_jaccard(asked, bank.limit(0), least, veto).count() == 0


def test_frequent_terms_are_weighed_like_rare_ones(spark):
    docs = spark.createDataFrame([(i, "always " * (i % 3 + 1) + (f"rare{i}" if i % 2 else "")) for i in range(1500)], "doc_id int, text string")
    got = {(x.doc_id, x.tok): x.w for x in retrieval.term_weights(docs).collect()}
    n = 1500
    idf = {True: 1.0, False: math.log((1 + n) / 2) + 1}
    for i in range(n):
        m = i % 3 + 1
        own = {"always": idf[True]} | ({f"rare{i}": (0.5 + 0.5 / m) * idf[False]} if i % 2 else {})
        norm = math.sqrt(sum(v * v for v in own.values()) + 1e-12)
        assert all(abs(got.pop((i, t)) - v / norm) < 1e-9 for t, v in own.items())
    assert not got


@pytest.mark.parametrize("block", [7, 60, 1_000_000])
def test_runs_and_asof_cross_blocks(spark, block):
    r = random.Random(block)
    log = [(r.choice(["hot", "hot", "hot", "b", None]), r.randint(0, 900), i, r.choice(["x", "x", "x", "y", None])) for i in range(1200)]
    df = spark.createDataFrame(log, "k string, s long, id long, v string").withColumn("ts", F.timestamp_seconds("s")).drop("s").repartition(6)
    want = []
    for k in ("hot", "b", None):
        run = []
        for row in sorted((x for x in log if x[0] == k), key=lambda x: x[1:3]) + [(k, 0, 0, "end")]:
            if run and run[-1][3] != row[3]:
                if len(run) >= 3:
                    want.append((k, run[0][3], len(run), min(x[2] for x in run)))
                run = []
            run.append(row)
    got = [tuple(x) for x in streams.runs_of(df, "k", ["ts", "id"], "v", 3, block).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)

    right = [(r.choice(["hot", "b", "other"]), r.randint(0, 900), r.choice([None, r.randint(0, 9), r.randint(0, 9)])) for _ in range(90)]
    known = spark.createDataFrame(right, "k string, s long, value int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = {x.id: x.last_value for x in streams.asof(df, known, "k", "ts", "value", block).collect()}
    assert len(got) == len(log)
    for k, s, i, _ in log:
        best = max(((t, v) for kk, t, v in right if kk == k and t <= s and v is not None), default=(0, None))
        assert got[i] == best[1]
    assert all(x.last_value is None for x in streams.asof(df, known.limit(0), "k", "ts", "value", block).collect())
