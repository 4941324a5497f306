"""Operators on small literal tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from loomline import cluster
from loomline.functions import hashing, scalars
from loomline.functions import text as tx
from loomline.operators import corpus, curation, evaluation, retrieval, similarity
from loomline.sources import records
from loomline.streaming import streams


def col(spark, kind, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")


def out(df, e):
    return [r[0] for r in df.orderBy("i").select(e).collect()]


def test_lookup_and_rank_survive_hot_and_null_keys(spark):
    facts = spark.createDataFrame([(i, "hot" if i < 900 else None if i < 905 else f"k{i}") for i in range(1000)], "id long, key string")
    dim = facts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    got = {r.id: r.first for r in cluster.lookup(facts, dim, "key", "n", 1000, F.col("id")).collect()}
    assert got == {i: 0 if i < 900 else 900 if i < 905 else i for i in range(1000)}
    ranks = cluster.gapless_rank(facts, ["key"], [F.col("id")], "r", 7).where("key = 'hot'").select("r").collect()
    assert sorted(r.r for r in ranks) == list(range(900))


def test_criteria(spark):
    df = col(spark, "string", ["7 vezes 9 é 63.", "64", "anti-horario", "Sim."])
    right = lambda any_=None, none=None, regex=None, nums=None: tx.is_right(F.col("c"), F.lit(any_).cast("array<array<string>>") if any_ is None else F.array(*[F.array(*map(F.lit, g)) for g in any_]), F.lit(None).cast("array<string>") if none is None else F.array(*map(F.lit, none)), F.lit(regex).cast("string"), F.lit(None).cast("array<bigint>") if nums is None else F.array(*[F.lit(n).cast("long") for n in nums]))
    assert out(df, right([["63"]])) == [True, False, False, False]
    assert out(df, right(none=["anti-horario"])) == [True, True, False, True]
    assert out(df, right(regex=r"\s*sim[.!?]?\s*$")) == [False, False, False, True]
    assert out(df, right(nums=[7, 9, 63])) == [True, False, True, True]


def test_numbers(spark):
    df = col(spark, "double", [1234.0, 12.5, 1234.56, 0.0])
    assert out(df, scalars.format_decimal_comma(F.col("c"))) == ["1.234", "12,5", "1.234,56", "0"]
    df = col(spark, "string", ["1.234,5", "2.380", "3.5", "x"])
    assert out(df, scalars.parse_decimal_comma(F.col("c"))) == [1234.5, 2380.0, 3.5, None]


def test_dates(spark):
    df = col(spark, "string", ["25/12", "1/1", "30/02/2027", None])
    day = scalars.parse_day(F.col("c"), F.lit("2026-09-27").cast("date"))
    assert out(df, day) == [datetime.date(2026, 12, 25), datetime.date(2027, 1, 1), None, None]


def test_chunks(spark):
    df = col(spark, "string", ["aaa\n\nbbb\n\n" + "c" * 25, "", "one"])
    assert out(df, tx.chunks(F.col("c"), 10)) == [["aaa\n\nbbb", "c" * 10, "c" * 10, "ccccc"], [], ["one"]]


def test_chunks_keep_digits_at_the_ends_of_lines(spark):
    """Line 0 must not lose a 0, nor line 1 a 1; spaces of any kind at a line's ends go."""
    df = col(spark, "string", ["0 call 4572244787104690\n16.155.205.171\n2 of 2", " a\u00a0 \n\u3000b\n\u2003\nc "])
    assert out(df, tx.chunks(F.col("c"), 900, "\n")) == [["0 call 4572244787104690\n16.155.205.171\n2 of 2"], ["a\nb\nc"]]


def test_split_is_the_number_modulo_ten(spark):
    df = col(spark, "string", ["f784ca375938f8e5", "0000000000000014", "ffffffffffffffff"])
    assert out(df, hashing.is_validation(F.col("c"))) == [int(x, 16) % 10 == 0 for x in ("f784ca375938f8e5", "14", "f" * 16)]


def test_chat_errors(spark):
    msg = lambda *x: [{"role": r, "content": c} for r, c in x]
    df = spark.createDataFrame([(0, msg(("user", "a question"), ("assistant", "an answer"))), (1, msg(("user", "x"))), (2, msg(("user", "same"), ("assistant", "Same "))), (3, msg(("assistant", "a"), ("user", " ")))], "i int, m array<struct<role:string,content:string>>")
    assert out(df, curation.errors(F.col("m"))) == [[], ["too_few"], ["echo"], ["alternation", "blank", "last_role", "short_answer"]]


def test_quarantine_and_human_override(spark):
    a = spark.createDataFrame([("a", "auto"), ("b", "user x"), ("c", "auto")], "id string, by string")
    q = spark.createDataFrame([("a",), ("b",)], "id string")
    assert sorted(r.id for r in curation.active(a, q, "id", F.col("by").startswith("user")).collect()) == ["b", "c"]


def test_containment_needs_no_cross_product(spark):
    docs = spark.createDataFrame([(1, "xx the quick brown fox yy"), (2, "hello"), (3, "the quick brown")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "quick brown fox"), (2, "ell")], "item_id long, text string")
    assert sorted(map(tuple, similarity.containment_pairs(docs, items).collect())) == [(1, 1), (2, 2)]


def test_jaccard_pairs_equal_brute_force(spark):
    import random

    r = random.Random(3)
    sets = [(i, sorted(r.sample("abcdefghij", r.randint(2, 8)))) for i in range(60)]
    df = spark.createDataFrame(sets, "id int, toks array<string>")
    got = {(x.l, x.r) for x in similarity.jaccard_pairs(df, df, 0.6).collect()}
    assert got == {(a, b) for a, x in sets for b, y in sets if len({*x} & {*y}) / len({*x} | {*y}) >= 0.6}


def test_offsets(spark):
    a = spark.createDataFrame([(1, 0, 1), (1, 1, 3), (1, 2, 6)], "doc int, i int, end int")
    b = spark.createDataFrame([(1, 0, 3), (1, 1, 4), (1, 2, 6)], "doc int, i int, end int")
    assert [(r.left, r.right) for r in similarity.offsets_join(a, b).collect()] == [(1, 0)]


def test_mixture(spark):
    df = spark.createDataFrame([("a", 10_000), ("b", 500)], "s string, size long")
    got = {r.s: r.weight for r in corpus.mixture(df, F.when(F.col("s") == "b", F.lit(0.3))).collect()}
    assert got == {"a": 0.7, "b": 0.3}


def test_tampered_parts_raise(spark):
    files = spark.createDataFrame([("f", bytearray(b"abcdefgh"))], "path string, content binary")
    parts = corpus.split_bytes(files, 3)
    assert corpus.join_bytes(parts).first().content == b"abcdefgh"
    with pytest.raises(Exception, match="does not match"):
        corpus.join_bytes(parts.withColumn("chunk", F.lit("x").cast("binary"))).collect()


def test_early_stop_and_average(spark):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate([3.0, 2.0, 2.5, 2.4, 1.0])], "run string, step int, loss double")
    assert evaluation.early_stop(df, ["run"], "step", "loss", 2).first()[1:] == (1, 3)
    assert evaluation.smoothed(df.where("step < 2"), ["run"], "step", "loss", 0.5).first()[1] == 2.5


def test_projected_mass_sums_to_one(spark):
    df = spark.createDataFrame([(1, t, t % 2, float(t)) for t in range(6)], "pos int, token int, target int, logit double")
    assert abs(sum(r.p for r in evaluation.projected_targets(df, ["pos"], 4, 1.0).collect()) - 1) < 1e-5


def test_verified_lookup_veto(spark):
    bank = spark.createDataFrame([(1, "what is the capital of rome italy"), (2, "what is the capital of berlin germany"), (3, "tool types for milling")], "id int, text string")
    q = spark.createDataFrame([(1, "capital berlin germany"), (2, "capital lisbon portugal")], "id int, text string")
    got = {r.q: r.item for r in retrieval.weighted_jaccard(q, bank, 0.1, 2.0).collect()}
    assert got == {1: 2}


def test_records_round_trip(spark, tmp_path):
    p = str(tmp_path / "log")
    df = spark.createDataFrame([("1", "curated")], "id string, origin string")
    assert records.append_jsonl(df, p) == 1 and records.append_jsonl(df, p) == 1
    (tmp_path / "log" / "bad.json").write_text('{"id": "2"}\n\nnot json\n')
    assert records.read_jsonl(spark, p, records.EXAMPLE).count() == 3
    assert records.read_jsonl(spark, str(tmp_path / "none"), records.EXAMPLE).count() == 0
    (tmp_path / "q.txt").write_text("# c\nmath|2+2?\nhello\n")
    assert [tuple(r) for r in records.read_questions(spark, str(tmp_path / "q.txt")).collect()] == [("math", "2+2?"), ("chat", "hello")]
    (tmp_path / ".env").write_text("# c\nA='1'\nB=x=y\nnothing\n")
    assert [tuple(r) for r in records.read_settings(spark, str(tmp_path / ".env")).collect()] == [("A", "1"), ("B", "x=y")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.md").write_text("long enough to be read")
    (tmp_path / "t" / "b.md").write_text("short")
    assert records.read_texts(spark, str(tmp_path / "t")).count() == 1
    base = spark.createDataFrame([("k", 1), ("m", 1)], "key string, v int")
    ch = spark.createDataFrame([("k", 2, 1), ("k", 3, 2)], "key string, v int, o int")
    assert sorted(map(tuple, records.upsert(base, ch, "key", "o").collect())) == [("k", 3), ("m", 1)]


def test_log_by_month_and_report(spark, tmp_path):
    log = spark.createDataFrame([("s", "2026-01-02T00:00:00", "q", "a", None, None, None), ("s", "2026-02-02T00:00:00", "q", "", None, None, None)], records.EXCHANGE)
    records.append_log(log, str(tmp_path / "m"))
    assert [p.name for p in (tmp_path / "m").glob("month=*")] == ["month=2026-01"]
    lines = [r.line for r in records.report(log.select("session", "ts"), ["session", "ts"]).collect()]
    assert lines[0] == "| session | ts |" and len(lines) == 4


def test_stream_equals_batch(spark):
    sf = "/root/testdata/sf0.001"
    batch = streams.events(cluster.table(spark, sf, "events"))
    a = sorted(map(tuple, streams.flat_window(streams.tumbling(batch, "1 day")).collect()))
    b = sorted(map(tuple, streams.flat_window(streams.drain(streams.tumbling(streams.event_stream(spark, sf), "1 day"), "complete")).collect()))
    assert a == b


def test_running_sums_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("v", F.col("id") % 7)
    got = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append([tuple(r) for r in corpus.running(df, F.col("v"), "id", "s").orderBy("id").select("id", "s").collect()])
    assert got[0] == got[1] and got[0][-1][1] == sum(i % 7 for i in range(500))


def test_dataset_versions(spark, tmp_path):
    from loomline.sources import datasets

    msg = [("user", "q"), ("assistant", "a")]
    rows = [(f"{i:016x}", "teacher-x" if i % 3 else None, msg) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, origin string, messages array<struct<role:string,content:string>>")
    path = "file://" + str(tmp_path)
    m = datasets.build_dataset(df, path)
    assert (m["version"], m["train_examples"], m["val_examples"], m["by_origin"]) == (1, 36, 4, {"curated": 14, "teacher": 26})
    (tmp_path / "v0002").mkdir()  # a run that died
    assert datasets.build_dataset(df, path)["version"] == 2
    assert datasets.read_dataset(spark, path, 2, "val").count() == 4
    only_val = df.where("id = '0000000000000000'")
    assert datasets.build_dataset(only_val, path)["train_examples"] == 1


def test_token_parts_resume(spark, tmp_path):
    from loomline.sources import datasets

    path = "file://" + str(tmp_path)
    df = spark.createDataFrame([(1, [1, 2], "train"), (2, [3], "val")], "doc_id long, ids array<int>, split string")
    assert datasets.write_part(df, path, "web", 0.3) and not datasets.write_part(df, path, "web")
    assert [tuple(r) for r in datasets.parts(spark, path).collect()] == [("web", 2, 2, 1, 0.3)]


def test_tokenizer_round_trip(spark):
    import public_tokenizers

    from loomline.functions import tokenizers as tk

    file = public_tokenizers.path("byte_bpe_50k.json")
    df = col(spark, "string", ["Hello, wörld", "", None])
    ids = df.select("i", tk.encode(F.col("c"), file).alias("c"))
    assert out(ids, tk.decode(F.col("c"), file)) == ["Hello, wörld", "", None]


def test_search_modes(spark):
    docs = spark.createDataFrame([(1, "lathe turning tools and inserts"), (2, "milling tools for steel"), (3, "capital of France is Paris"), (4, "steelworks")], "doc_id int, text string")
    ids = lambda mode: [r.doc_id for r in retrieval.search(docs, "milling steel", 3, mode).collect()]
    assert ids("semantic") == [2] and ids("keyword") == [2, 4] and ids("hybrid") == [2, 4]
    with pytest.raises(ValueError, match="no such mode"):
        retrieval.search(docs, "x", 1, "other")


def test_command_line(spark, capsys):
    from loomline.__main__ import main

    assert main(["list"]) == 0 and "curation_manifest" in capsys.readouterr().out
    assert main(["run", "setops_union", "/root/testdata/sf0.001"]) == 0
    assert main(["sql", "setops_union"]) == 0 and "UNION" in capsys.readouterr().out


def test_safety_predicates(spark):
    from loomline.functions import safety

    rows = [("src/app.py", True), ("/work/a/b", True), ("/work", True), ("/worker/x", False), ("../x", False), ("foo/System32/bar", False), ("C:\\Windows\\x", False), ("D:\\x", False), ("/etc/passwd", False)]
    df = spark.createDataFrame(rows, "p string, ok boolean")
    assert all(r.ok == r.got for r in df.withColumn("got", safety.is_safe_path(F.col("p"), "/work")).collect())
    commands = [("rm -rf build", True), ("RM  -RF x", True), ("dd if=a of=b", True), ("ls > /dev/null", True), ("chmod 777 x", True), ("git status", False), ("information", False)]
    df = spark.createDataFrame(commands, "c string, bad boolean")
    assert all(r.bad == r.got for r in df.withColumn("got", safety.is_critical(F.col("c"))).collect())


def test_arithmetic_in_words(spark):
    from loomline.functions import scalars

    df = spark.createDataFrame([("quanto e 9 vezes 7", "*", 7, 9), ("12 Dividido por 4", "/", 12, 4), ("3 menos 5", "-", 3, 5), ("5 mais 3", "+", 3, 5)], "q string, op string, a long, b long")
    assert all(tuple(r.m) == (r.op, r.a, r.b) for r in df.withColumn("m", scalars.arithmetic(F.col("q"))).collect())


def test_lsa_equals_numpy(spark):
    """Similarities in the space of the leading right singular vectors, by a dense decomposition."""
    import numpy as np

    docs = cluster.table(spark, "/root/testdata/sf0.001", "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    weights = retrieval.term_weights(docs).collect()
    toks, ids = sorted({r.tok for r in weights}), sorted({r.doc_id for r in weights})
    at, row = {t: i for i, t in enumerate(toks)}, {d: i for i, d in enumerate(ids)}
    m = np.zeros((len(ids), len(toks)))
    for r in weights:
        m[row[r.doc_id], at[r.tok]] = r.w
    x = m @ np.linalg.svd(m, full_matrices=False)[2][:8].T
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-12
    got = {r.doc_id: np.array(r.vector) for r in retrieval.lsa(docs, 8).collect()}
    own = np.stack([got[d] for d in ids])
    assert np.allclose(own @ own.T, x @ x.T, atol=1e-5)


def test_sparse_topk_equals_plain_cosines(spark):
    import collections
    import math

    texts = {1: "red apples and green apples", 2: "green tea and red tea leaves", 3: "steel milling tools", 4: "apples steel"}
    asked = {7: "red apples", 8: "milling steel tools tools"}
    split = lambda t: [w for w in t.split() if len(w) > 1]
    df = collections.Counter(w for t in texts.values() for w in set(split(t)))
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()}

    def vector(t):
        c = collections.Counter(w for w in split(t))
        v = {w: (0.5 + 0.5 * n / max(c.values())) * idf[w] for w, n in c.items() if w in idf}
        norm = math.sqrt(sum(x * x for x in v.values()) + 1e-12)
        return {w: x / norm for w, x in v.items()}

    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id int, text string")
    got = {(r.q, r.doc_id): r.score for r in retrieval.sparse_topk(frame(asked), frame(texts), 9).collect()}
    want = {(q, d): sum(x * vector(t).get(w, 0) for w, x in vector(a).items()) for q, a in asked.items() for d, t in texts.items()}
    assert {k: v for k, v in got.items()} == pytest.approx({k: round(v, 4) for k, v in want.items() if v > 0}, abs=2e-4)


def test_sparse_topk_shuffles_no_terms_of_documents(spark, monkeypatch):
    """Equal to the joins, with ties, copies, empty texts and blocks of queries; the documents' terms stay where they are read."""
    words = ["ab", "cd", "é_1", "the", "zz9", "q", "aa", "bb", "cc"]
    texts = [(i, None if i == 5 else " ".join(words[(i * j + j * j) % 9] for j in range(i % 13)) + (f" only{i}" if i % 4 else "")) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "The AB ab"), (2, "zz9 only7"), (3, "nothing here"), (4, ""), (5, "é_1 cc bb"), (6, "the"), (7, "aa cd")], "doc_id long, text string")
    rows = lambda d: sorted((r.q, r.rank, r.doc_id, round(r.score, 4)) for r in d.collect())
    want = rows(retrieval._sparse_joined(asked, docs, 4))
    made = []
    joined, keep = retrieval._sparse_joined, cluster.materialize
    monkeypatch.setattr(retrieval, "_sparse_joined", lambda *a: made.append("joined") or joined(*a))
    monkeypatch.setattr(cluster, "materialize", lambda d, tag: made.append(tag) or keep(d, tag))
    found = retrieval.sparse_topk(asked, docs, 4)
    assert rows(found) == want and len(want) > 15 and "terms" not in made and "joined" not in made
    monkeypatch.setattr(retrieval, "BLOCK_TERMS", 4)
    assert rows(retrieval.sparse_topk(asked, docs, 4)) == want
    assert "joined" not in made
    retrieval.sparse_topk(asked, docs.union(docs), 4)
    assert "joined" in made
