"""Pairs, checkpoints, backends, tools, ingest and reminders on small fixtures."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline import cluster
from loomline.functions import scalars as sc
from loomline.operators import backends, pairs, retrieval, similarity
from loomline.sources import checkpoints
from loomline.streaming import streams


def test_gate_of_pairs(spark):
    rows = [
        (0, "Quanto é 7 vezes 9?", "O resultado é 63.", False, [], "approved"),
        (1, "Quanto é 7 vezes 8?", "O resultado é 54.", False, ["calculation"], "rejected"),
        (2, "Quem descobriu o polo?", "Um explorador.", True, [], "review"),
        (3, "Quanto é 2 + 3?", "São 5.", False, ["contaminated"], "rejected"),
        (4, "Olá mundo?", "olá  MUNDO?", False, ["echo", "duplicate"], "rejected"),
        (5, "Mostre um laço.", "for i in range(3):\n    print(i)\nPronto.", False, [], "approved"),
        (6, "Mostre outro laço.", "for i in range(3:\n    print(i)", False, ["code"], "rejected"),
        (7, None, None, None, ["empty", "short_answer", "echo"], "rejected"),
        (8, "Quem é você?", "Sou o ChatGPT, um modelo <|x", False, ["identity", "artefact"], "rejected"),
        (9, "q" * 141, "a" * 221, False, ["long_question", "long_answer"], "rejected"),
        (10, "Diga algo.", "sim " * 12, False, ["repetitive"], "rejected"),
        (11, "Diga 漢.", "Digo.", False, ["script"], "rejected"),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "id long, question string, answer string, factual boolean")
    frozen = spark.createDataFrame([(1, "quanto é 3 mais 2")], "id long, text string")
    known = spark.createDataFrame([("ola mundo?",), ("ola mundo?",)], "n string")
    got = {r.id: (r.problems, r.status) for r in pairs.gate(df, frozen, known).collect()}
    assert got == {r[0]: (r[4], r[5]) for r in rows}
    by_hand = {r.id: r.problems for r in pairs.gate(df, frozen, known, check_facts=False).collect()}
    assert by_hand[1] == [] and by_hand[8] == ["artefact"]
    assert pairs.gate(df.limit(0), frozen.limit(0), known.limit(0)).count() == 0


def test_facts_decide_where_they_apply(spark):
    df = spark.createDataFrame([(1, "What does G1 do?", "It cuts in a straight line.", True, True), (2, "What does G1 do?", "It stops.", True, False), (3, "What is it?", "It is a thing.", True, None)], "id long, question string, answer string, factual boolean, fact boolean")
    none = spark.createDataFrame([], "id long, text string")
    got = pairs.gate(df, none, none.select(F.col("text").alias("n")), fact=F.col("fact")).orderBy("id").collect()
    assert [(r.problems, r.verified, r.status) for r in got] == [([], True, "approved"), (["fact"], False, "rejected"), ([], None, "review")]


def test_small_talk_classes_in_order(spark):
    said = ["tchau, obrigado", "Valeu!", "oi, tudo bem?", "Olá", "eai", "eai meu amigo velho", "Estou muito cansada", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, c string")
    got = [r.k for r in df.select("i", sc.small_talk(F.col("c")).alias("k")).orderBy("i").collect()]
    assert got == ["farewell", "gratitude", "wellbeing", "greeting", "greeting", None, "user_feeling", None, None]


def test_rollback_restores_first_content_and_deletes_new_paths(spark):
    edits = spark.createDataFrame([(1, "a", 1, "old", True), (2, "a", 2, "mid", True), (2, "a", 3, "late", True), (2, "b", 4, None, False), (2, "c", 5, "", True)], "checkpoint int, path string, seq int, before string, existed boolean")
    state = spark.createDataFrame([("a", "now"), ("b", "made"), ("d", "other")], "path string, content string")
    saved = checkpoints.snapshots(edits)
    after, actions = checkpoints.rollback(state, saved)
    assert {r.path: r.content for r in after.collect()} == {"a": "mid", "c": "", "d": "other"}
    assert {r.path: r.action for r in actions.collect()} == {"a": "restored", "b": "deleted", "c": "restored"}
    assert {r.path: r.content for r in checkpoints.rollback(state, saved, 1)[0].collect()} == {"a": "old", "b": "made", "d": "other"}
    assert checkpoints.rollback(state, saved.limit(0))[1].count() == 0
    assert [(r.checkpoint, r.paths) for r in checkpoints.listed(saved).collect()] == [(2, 3), (1, 1)]


def test_backends_resolve_and_search(spark):
    class Gone(backends.Backend):
        name = "gone"

        def available(self):
            return False, "not here"

    assert backends.resolve([Gone(), backends.Hashed(8), backends.Latent(2)]).name == "hashed"
    assert backends.resolve([Gone(), backends.Hashed(8), backends.Latent(2)], "LSA").info() == {"name": "lsa", "dim": 2}
    assert backends.resolve([Gone(), backends.Hashed(8)], "gone").name == "hashed"
    with pytest.raises(LookupError, match="not here"):
        backends.resolve([Gone()])
    docs = spark.createDataFrame([(1, "red apples green apples"), (2, "blue cars fast cars"), (3, "green pears red apples"), (4, None), (5, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "fast blue cars")], "doc_id long, text string")
    encoder = backends.Encoder("letters", lambda: lambda ts: [[t.count("a"), t.count("r") + 1.0] for t in ts], 2)
    for own in (backends.Latent(2).fit(docs.where("text <> ''")), backends.Hashed(64)):
        vectors = {r.doc_id: r.vector for r in own.embed(docs).collect()}
        assert set(vectors) == {1, 2, 3} and all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in vectors.values())
        assert [(r.q, r.doc_id) for r in backends.search(own, asked, docs, 1).collect()] == [(1, 2)]
    assert encoder.embed(docs).count() == 5 and not backends.Encoder("x", None, 1, ["no_such_module"]).available()[0]


def test_latent_vectors_equal_numpy(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["aa bb cc aa", "bb cc dd", "dd ee ff ee", "aa ff ff bb"])], "doc_id long, text string")
    w = retrieval.term_weights(docs).toPandas().pivot(index="doc_id", columns="tok", values="w").fillna(0)
    _, _, vt = np.linalg.svd(w.to_numpy(), full_matrices=False)
    want = w.to_numpy() @ vt[:2].T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = np.array([r.vector for r in retrieval.lsa(docs, 2).orderBy("doc_id").collect()])
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-6)  # up to the signs of the axes


def test_blocks_change_nothing(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    rows = lambda: sorted(map(tuple, retrieval.dense_topk(vectors.where("vec_id < 10"), vectors, 3).collect()))
    whole = rows()
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 3)
    assert rows() == whole and len(whole) == 30
    parts = cluster.blocks(vectors, "vec_id", 7)
    assert len(parts) > 1 and sum(p.count() for p in parts) == 40
    docs = spark.createDataFrame([(1, "xx the quick"), (2, "hello")], "doc_id long, text string")
    items = spark.createDataFrame([(i, w) for i, w in enumerate(["ell", "quick", "none", "xx the"])], "item_id long, text string")
    monkeypatch.setattr(similarity, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, similarity.containment_pairs(docs, items).collect())) == [(1, 1), (1, 3), (2, 0)]


def test_dense_topk_multiplies_matrices_exactly(spark, monkeypatch):
    """Ties, copies, nulls, other lengths, NaN: equal to plain sums; and no product is made by a join of rows."""
    r = np.random.default_rng(5)
    own = [[float(x) for x in r.integers(-3, 4, 4)] for _ in range(150)] + [[0.25, 0.5, 0.5, 0.5]] * 60 + [list(map(float, r.normal(0, 1, 4))) for _ in range(60)]
    own += [None, [1.0, None, 0.0, 0.0], [1.0, 2.0], [], [float("nan"), 0.0, 1.0, 0.0], [float("inf"), 1.0, 1.0, 1.0], [1e-5, 0.0, 0.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(own)), "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(retrieval, "PRODUCTS", 64)
    asked = df.where("vec_id % 6 = 0 or vec_id >= 270")
    for k in (1, 4, 200):
        got = collections.defaultdict(list)
        for x in retrieval.dense_topk(asked, df, k).orderBy("q", "rank").collect():
            got[x.q].append((x.vec_id, None if x.score is None else f"{x.score:.4f}"))
        for q in (i for i in range(len(own)) if i % 6 == 0 or i >= 270):
            want = []
            for v in range(len(own)):
                a, b = own[q], own[v]
                if v != q:
                    ok = a is not None and b is not None and None not in a + b and len(a) == len(b)
                    want.append((v, sum((x * y for x, y in zip(a, b)), 0.0) if ok else None))
            want = [(v, None if s is None else round(s, 4) + 0.0) for v, s in want]
            want.sort(key=lambda x: (x[1] is None, x[1] == x[1], -(x[1] or 0.0), x[0]))
            assert got[q] == [(v, None if s is None else f"{s:.4f}") for v, s in want[:k]], (q, k)
    clean = df.where("vec_id < 270")
    assert "NestedLoop" not in retrieval.dense_topk(clean.where("vec_id % 6 = 0"), clean, 3)._jdf.queryExecution().toString()


def test_tools_and_scorers(spark):
    own, other = backends.Tools(), backends.Tools()
    other.add("half", lambda n: 1 / n, {"n": {"type": "number"}}, ["n"])
    assert own.mount("maths", other) == ["mcp_maths_half"]
    assert own.run("mcp_maths_half", n=2).value == 0.5
    assert [own.run("x").error, own.run("mcp_maths_half").error, own.run("mcp_maths_half", n=1, m=2).error] == ["no tool x", "missing: n", "unknown: m"]
    assert "ZeroDivisionError" in own.run("mcp_maths_half", n=0).error
    assert own.schemas()[0]["parameters"]["required"] == ["n"]
    df = spark.createDataFrame([("abc",)], "c string")
    length, gone = backends.Scorer("length", F.length, {"licence": "mit"}), backends.Scorer("gone", F.length, check=lambda: 1 / 0)
    assert length.status() == {"key": "length", "available": True, "reason": "", "licence": "mit"} and not gone.status()["available"]
    assert tuple(df.select(length(F.col("c")), gone(F.col("c"))).first()) == (3, None)


def test_ingest_stops_after_the_batch_that_reaches_the_sum(spark, tmp_path):
    for i in range(5):
        spark.range(i * 10, i * 10 + 10).selectExpr("id", "10 AS size").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id long, size int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert streams.ingest(stream(), str(tmp_path / "out"), "size", 250).count() == 30
    assert streams.ingest(stream(), str(tmp_path / "out"), "size", 10_000).count() == 30  # its input was passed over
    assert streams.ingest(stream(), str(tmp_path / "all"), "size", 10_000).count() == 50


def test_reminders_forget(spark, tmp_path):
    rows = [(1, 1, 1.0, 2.0), (1, 2, 90.0, 100.0), (1, 1, 1.0, 100.0), (1, 3, 200.0, 100.0)]
    spark.createDataFrame(rows, "user_id long, id long, due double, now double").coalesce(1).write.parquet(str(tmp_path / "polls"))
    read = lambda: spark.readStream.schema("user_id long, id long, due double, now double").parquet(str(tmp_path / "polls"))
    assert sorted(r.id for r in streams.drain(streams.fire_once(read())).collect()) == [1, 2]
    assert sorted(r.id for r in streams.drain(streams.fire_once(read(), 50.0)).collect()) == [1, 2]


def test_backend_query_equals_brute_force(spark):
    import re

    import harness
    import xxhash

    from loomline.plans import catalog

    con = harness.connection(f"{harness.DATA}/sf0.001")

    def vectors(sql):
        ids, rows = [], []
        for i, text in con.execute(sql).fetchall():
            v = np.zeros(128)
            for w in re.findall("[a-zà-ÿ_][a-zà-ÿ0-9_]+", (text or "").lower()):
                h = xxhash.xxh64(w.encode(), seed=42).intdigest()
                h = h - (1 << 64) if h >= 1 << 63 else h
                v[h % 128] += 1 if h >= 0 else -1
            if v.any():
                ids.append(i)
                rows.append(v / np.linalg.norm(v))
        return ids, np.array(rows)

    (qs, a), (ds, b) = vectors("SELECT item_id, text FROM benchmark"), vectors("SELECT doc_id, text FROM documents")
    scores = np.round(a @ b.T, 4)
    want = {(q, r + 1): s for q, row in zip(qs, scores) for r, s in enumerate(sorted(row, reverse=True)[:3])}
    got = catalog.QUERIES["backend_search"](spark, f"{harness.DATA}/sf0.001").collect()
    assert {(r.q, r["rank"]) for r in got} == set(want)
    assert all(abs(r.score - want[r.q, r["rank"]]) < 2e-4 and abs(r.score - scores[qs.index(r.q), ds.index(r.doc_id)]) < 2e-4 for r in got)


def test_knn_label_vote_joins_no_queries_with_vectors(spark):
    import harness

    from loomline.plans import catalog

    plan = catalog.QUERIES["knn_label_vote"](spark, f"{harness.DATA}/sf0.001")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan


def test_products_go_by_single_precision_where_its_rounding_is_below_the_margin(monkeypatch):
    from loomline.operators import retrieval as rt

    seen, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda p, *a, **b: seen.append(p.dtype) or partition(p, *a, **b))
    m = np.random.default_rng(5).normal(size=(3000, 64))
    m /= np.linalg.norm(m, axis=1)[:, None]
    m[500:520], m[40] = m[400:420], 0.0
    ids = np.arange(3000)
    for scale, kind in ((1.0, np.float32), (1e6, np.float64), (1e100, np.float64)):
        x = m * scale
        asked, best = ids[::50], rt._Best(60, 7)
        for a in range(0, 3000, 1000):
            rt._products(best, asked, x[asked], np.sqrt((x[asked] ** 2).sum(1)), ids[a : a + 1000], x[a : a + 1000])
        best.prune()
        q, v, s = best.parts[0]
        for i, e in enumerate(x[asked]):
            want = np.zeros(3000)
            for d in range(64):
                want += e[d] * x[:, d]
            want = sorted((w, j) for j, w in enumerate((-np.round(want, 4)).tolist()) if j != asked[i])[:7]
            assert sorted(zip((-np.round(s[q == i], 4)).tolist(), v[q == i].tolist()))[:7] == want
        assert set(seen) == {np.dtype(kind)}
        seen.clear()
