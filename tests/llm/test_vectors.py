"""Neighbours and vector codes against brute force, on ordinary, odd and empty tables."""

import collections
import hashlib
import math

import numpy as np
import pytest
from edge import vectors

from loomline.llm import curves, lloyd, registry

SCHEMA = "vec_id long, embedding array<float>, label int"


def floats(v):
    return None if v is None else [None if c is None else float(np.float32(c)) for c in v]


def kept(rows):
    return [(i, floats(v), label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def plain_codes(rows, rounds=2):
    """Plain Python: (vec_id, code, error, label_error) of all kept rows, and the digest."""
    own = kept(rows)
    width = -(-max((len(v) for _, v, _ in own), default=0) // 16) * 16
    d = width // 16
    ints = [[math.floor(256 * c) for c in v] + [0] * (width - len(v)) for _, v, _ in own]
    first = sorted(zip(own, ints), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[1]))[:64]
    book = [[v[p * d : p * d + d] for _, v in first] for p in range(16)]

    def nearest(v):
        out = []
        for p in range(16):
            far = [sum((a - b) ** 2 for a, b in zip(v[p * d : p * d + d], e)) for e in book[p]]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        codes = [[e for e, _ in nearest(v)] for v in ints]
        for p in range(16):
            for e in range(len(first)):
                members = [v[p * d : p * d + d] for v, c in zip(ints, codes) if c[p] == e]
                if members:
                    book[p][e] = [sum(x) // len(members) for x in zip(*members)]
    last = [nearest(v) for v in ints]
    errors = [sum(f for _, f in x) for x in last]
    by_label = collections.Counter()
    for (_, _, label), e in zip(own, errors):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(c) for b in book for e in b for c in e).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for e, _ in x), e, by_label[label], digest) for (i, _, label), x, e in zip(own, last, errors)]


@pytest.mark.parametrize("rows", [
    vectors(), vectors(30), vectors(100, 20), vectors(80, 7),
    [(1, [1.0, 2.0], 0), (2, [], 1), (3, [5.0] * 40, None)], [(None, [0.5] * 16, None)],
    [(i, [float(i % 3)] * 16, i % 2) for i in range(200)], [(i, [300.0 * i - 9e4, -4e5] * 8, 0) for i in range(90)],
], ids=["odd", "few", "width20", "width7", "lengths", "one", "ties", "large"])
def test_codes_equal_plain_python(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in lloyd.compress(df.repartition(3)).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(plain_codes(rows), key=key)


def test_only_parts_that_moved_contribute():
    r = np.random.default_rng(0)
    v, old, new = r.integers(-9, 9, (50, 32)), r.integers(0, 4, (50, 16)).astype(np.uint8), None
    new = old.copy()
    assert not lloyd.contributions(v, old, new, 4).any()
    new[7, 3] = (old[7, 3] + 1) % 4
    got = lloyd.contributions(v, old, new, 4)
    assert got[3, new[7, 3]].tolist() == [1, *v[7, 6:8]] and got[3, old[7, 3]].tolist() == [-1, *-v[7, 6:8]] and np.count_nonzero(got.any(axis=2)) == 2
    other = r.integers(0, 4, (50, 16)).astype(np.uint8)
    assert (lloyd.contributions(v, None, old, 4) + lloyd.contributions(v, old, other, 4) == lloyd.contributions(v, None, other, 4)).all()


def test_nearest_in_longs_and_in_doubles_agree():
    r = np.random.default_rng(1)
    v, book = r.integers(-300, 300, (500, 4)), r.integers(-300, 300, (64, 4))
    far = ((v[:, None] - book[None]) ** 2).sum(2)
    for scale in (1, 1 << 18):
        at, least = lloyd.nearest(v * scale, book * scale)
        assert (at == far.argmin(1)).all() and (least == far.min(1) * scale * scale).all()


def test_hilbert_neighbours_are_adjacent_cells():
    for dims, bits in ((1, 6), (2, 5), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = curves.hilbert(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def plain_neighbours(rows, k=20, every=20):
    own = [(i, v) for i, v, _ in kept(rows) if any(v)]
    width = max((len(v) for _, v in own), default=0)
    x = np.array([v + [0.0] * (width - len(v)) for _, v in own], np.float64).reshape(len(own), width)
    out = []
    for a, (i, _) in enumerate(own):
        if i is not None and i % every == 0:
            score = (x * x[a]).sum(1)
            order = sorted((b for b in range(len(own)) if b != a), key=lambda b: (-score[b], own[b][0] is None, own[b][0] or 0))
            out += [(i, r + 1, own[b][0], float(score[b])) for r, b in enumerate(order[:k])]
    return sorted(out, key=lambda r: (r[0], r[1], r[2] is None, r[2]))


def found(df):
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()), key=lambda r: (r[0], r[1], r[2] is None, r[2]))


def same(got, want):
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-13, atol=0)


@pytest.mark.parametrize("rows", [vectors(), vectors(30, 3), [(0, [1.0, 2.0], 0), (20, [1.0], 0), (5, [], 0)], [(0, [1.0], 0)], [(1, [1.0], 0), (2, [2.0], 0)]], ids=["odd", "few", "lengths", "one", "no query"])
def test_neighbours_in_one_range_are_exact(spark, rows):
    from pyspark.sql import functions as F

    got = found(curves.search(spark.createDataFrame(rows, SCHEMA).repartition(3), F.pmod("vec_id", F.lit(20)) == 0))
    same(got, plain_neighbours(rows))


def test_neighbours_with_a_full_window_are_exact(spark, monkeypatch):
    """Ranges on all curves, each pair taken once: with the widest window, every pair is compared."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(curves, "RANGE", 40)
    monkeypatch.setattr(curves, "PER_RANGE", 2)
    monkeypatch.setattr(curves, "TARGET", 1.0)
    monkeypatch.setattr(curves, "window_of", lambda vectors, asked, width, ranges, k: (ranges, 1.0))
    rows = [r for r in vectors(400, 8)]
    rows += [(5000 + i, [100.0 * c for c in rows[i][1]], 0) for i in range(20)]  # of other norms
    got = curves.search(spark.createDataFrame(rows, SCHEMA), F.pmod("vec_id", F.lit(20)) == 0)
    assert got.first().ranges > 5
    same(found(got), plain_neighbours(rows))


@pytest.mark.parametrize("kind", ["random", "clusters", "norms", "hot"])
def test_neighbours_reach_the_recall(spark, monkeypatch, kind):
    from pyspark.sql import functions as F

    monkeypatch.setattr(curves, "RANGE", 64)
    monkeypatch.setattr(curves, "PER_RANGE", 2)
    r = np.random.default_rng(3)
    x = r.normal(size=(2500, 32))
    if kind == "clusters":
        x = r.normal(size=(25, 32))[r.integers(0, 25, 2500)] + 0.2 * x @ np.diag(0.7 ** np.arange(32))
    elif kind == "norms":
        x *= r.lognormal(0, 1, (2500, 1))
    elif kind == "hot":
        x[r.random(2500) < 0.35] = x[0]
    rows = [(i, v, 0) for i, v in enumerate(x.astype(np.float32).tolist())]
    got = curves.search(spark.createDataFrame(rows, SCHEMA), F.pmod("vec_id", F.lit(20)) == 0).collect()
    have = {(g.query_id, g.vec_id) for g in got}
    want = plain_neighbours(rows)
    assert len(got) == len(want) and np.mean([(w[0], w[2]) in have for w in want]) >= 0.9
    if kind == "clusters":  # structure is found: a narrow window suffices
        assert got[0].window * 2 + 1 < got[0].ranges / 2


def test_neighbours_of_the_given_table(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    same(found(registry.QUERIES["op12_hilbert_neighbours"](spark, sf)), plain_neighbours(rows))


def test_vectors_with_clashing_columns(spark, edge_dir):
    rows = vectors()
    same(found(registry.QUERIES["op12_hilbert_neighbours"](spark, edge_dir)), plain_neighbours(rows))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in registry.QUERIES["op13_delta_lloyd"](spark, edge_dir).collect()), key=key) == sorted(plain_codes(rows), key=key)
