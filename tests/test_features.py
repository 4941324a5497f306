"""Calculations, greedy chains, seeded order, alignment, latent vectors and saved indexes against plain Python."""

import ast
import collections
import datetime
import hashlib
import math
import operator
import random

import numpy as np
import pyarrow as pa
import pytest

from loomline.operators import calculations, cells, chains, decisions, latent, ordering, similarity

OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos}
CALLS = {"sqrt": math.sqrt, "raiz": math.sqrt, "abs": abs, "ln": math.log, "log": math.log10, "sen": lambda x: math.sin(math.radians(x)), "cos": lambda x: math.cos(math.radians(x)), "tan": lambda x: math.tan(math.radians(x))}


def plain_value(text):
    def of(n):
        v = step(n)
        if not isinstance(v, float) or not math.isfinite(v):
            raise ValueError
        return v

    def step(n):
        if isinstance(n, ast.Constant):
            return float(n.value)
        if isinstance(n, ast.Name):
            return {"pi": math.pi}[n.id]
        if isinstance(n, ast.UnaryOp):
            return OPS[type(n.op)](of(n.operand))
        if isinstance(n, ast.BinOp):
            a, b = of(n.left), of(n.right)
            if isinstance(n.op, ast.Pow) and abs(b) > 100:
                raise ValueError
            return OPS[type(n.op)](a, b)
        if isinstance(n, ast.Call) and len(n.args) == 1:
            return CALLS[n.func.id](of(n.args[0]))
        raise ValueError

    try:
        return of(ast.parse(text.strip(), mode="eval").body)
    except (SyntaxError, ValueError, ZeroDivisionError, OverflowError, KeyError, TypeError, AttributeError):
        return None


def expression(r, depth):
    kind = r.random()
    if depth == 0 or kind < 0.25:
        return r.choice([str(r.randint(0, 12)), f"{r.randint(0, 99)}.{r.randint(0, 99)}", "pi", ".5", "1e2"])
    if kind < 0.4:
        return f"{r.choice('+-')}{r.choice(['', ' '])}{expression(r, depth - 1)}"
    if kind < 0.55:
        return f"{r.choice(list(CALLS))}({expression(r, depth - 1)})"
    if kind < 0.75:
        return f"({expression(r, depth - 1)})"
    return r.choice(["{}{}{}", "{} {} {}"]).format(expression(r, depth - 1), r.choice(["+", "-", "*", "/", "//", "%", "**"]), expression(r, depth - 1))


def test_expressions_equal_a_plain_evaluator():
    r = random.Random(1)
    texts = [expression(r, r.randint(1, 6)) for _ in range(6000)]
    for _ in range(2000):  # broken ones
        t = list(r.choice(texts))
        for _ in range(r.randint(1, 3)):
            t[r.randrange(len(t)) :] = r.choice(["", *"()+*/%.x 1", *t[:3]])
            t = t or ["1"]
        texts.append("".join(t))
    texts += ["", "1 +", "()", "sqrt 4", "2(3)", "007", "00", "1 2", "abs()", "-2**2", "2**-1", "2**3**2", "-(-3)", "7//-2", "-7%3", "(" * 40 + "1" + ")" * 40, "+".join(["1"] * 300), "1/0", "2**101", "9**99", "(-8)**0.5", "abs(-3)(2)", "pi(2)", "1e400"]
    got, right = calculations.evaluate(texts), 0
    for t, g in zip(texts, got.tolist()):
        want = plain_value(t)
        assert math.isnan(g) if want is None else math.isclose(g, want, rel_tol=1e-9, abs_tol=1e-9), (t, g, want)
        right += want is not None
    assert right > 4000 and len(texts) - right > 800


def test_expressions_do_not_depend_on_the_processor(monkeypatch):
    """numpy has functions of its own for some processors, which differ from the C library's in the last digits."""
    for name in ("power", "sin", "cos", "tan", "log", "log10"):
        monkeypatch.setattr(np, name, lambda *x, f=getattr(np, name): np.nextafter(f(*x), np.inf))
    texts = ["tan(- + 8**87.53)", "sen(9**50)", "cos(7**60.5)", "tan(ln(3)**90)", "sen(log(7)*10**60)", "(-8)**0.5", "0**-1", "9**99", "9**99*9**99*9**99*9**99", "ln(0)", "ln(0-1)", "log(0)", "2**0.5"]
    for t, g in zip(texts, calculations.evaluate(texts).tolist()):
        want = plain_value(t)
        assert math.isnan(g) if want is None else g == want, (t, g, want)


@pytest.mark.parametrize("question, value, error", [
    ("quanto é 17% de 2.380?", 404.6, None), ("quanto é 12 x 7?", 84.0, None), ("quanto é 1.250,50 mais 300", 1550.5, None), ("raiz de 81", 9.0, None), ("10/0", None, "division by zero"),
    ("2 elevado a 10", 1024.0, None), ("2 elevado a 101", None, None), ("Quanto é 3 mais 4 vezes 2?", 11.0, None), ("20 dividido por 8", None, None), ("20 ÷ 8 menos 1", 1.5, None), ("sen(30) + cos(60)", 1.0, None),
    ("oi, tudo bem?", None, None), ("quanto é bom estudar?", None, None), ("nota 10 pra você", None, None), ("qual o resultado de (2 + 3) * (4 - 1)?", 15.0, None), ("2^10", 1024.0, None), ("-3 + 2^-1", -2.5, None), (None, None, None), ("", None, None),
])
def test_calculations_in_words(spark, question, value, error):
    got = calculations.answered(spark.createDataFrame([(question,)], "q string"), "q").first()
    assert (got.value is None) == (value is None) and (value is None or math.isclose(got.value, value)) and got.error == error


def log_of(r, n, users, span):
    base = datetime.datetime(2024, 1, 1)
    rows = [(i, base + datetime.timedelta(minutes=r.randint(0, span) * r.choice([1, 1, 20])), 0 if r.random() < 0.4 else r.randrange(users), r.choice(["a", "b", "c", None])) for i in range(n)]
    return [*rows, (n, None, 1, "a"), (n + 1, base, None, "a")]


EVENTS = "event_id long, ts timestamp, user_id long, event_type string"


def plain_runs(rows, gap, strict, signed):
    last, out = {}, set()
    for i, ts, u, s in sorted((x for x in rows if x[1] and x[2] is not None), key=lambda x: (x[1], x[0])):
        before = last.get(u)
        old = before and (ts - before[0] > gap if strict else ts - before[0] >= gap)
        if before is None or old and (not signed or s != before[1]):
            last[u] = ts, s
            out.add(i)
    return out


@pytest.mark.parametrize("seed, n, span", [(1, 300, 3000), (2, 400, 30_000), (3, 60, 200), (4, 0, 10)])
def test_chains_equal_a_plain_loop(spark, seed, n, span):
    rows = log_of(random.Random(seed), n, 4, span)
    df = spark.createDataFrame(rows, EVENTS)
    for hours, strict, signed in ((12, False, True), (1, True, False)):
        got = chains.accepted(df, "user_id", "ts", "event_id", hours * 3_600_000_000, strict, "event_type" if signed else None)
        assert got.count() == len(rows)
        assert {x.event_id for x in got.where("accepted").collect()} == plain_runs(rows, datetime.timedelta(hours=hours), strict, signed)


def test_the_cases_of_throttle_and_cache(spark):
    base = datetime.datetime(2024, 1, 1)
    rows = [(i, base + datetime.timedelta(minutes=40 * i), 1, "ab"[i % 2]) for i in range(30)]
    df = spark.createDataFrame(rows, EVENTS)
    assert sorted(x.event_id for x in chains.throttled(df, "user_id", 12, "event_type").collect()) == [0, 19]
    assert sorted(x.event_id for x in chains.ttl_hits(df.where("event_id < 5"), "user_id", 3600).where("not hit").collect()) == [0, 2, 4]


def test_arguments_keep_the_last_of_a_repeated_key(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([('TOOL: f a="1" b="2" a="3"',), ("none",), (None,)], "c string").select(decisions.arguments(F.col("c")).alias("m")).collect()
    assert [x.m for x in row] == [{"a": "3", "b": "2"}, {}, None]


def test_seeded_order_and_blocks(spark):
    from pyspark.sql import functions as F

    r = random.Random(5)
    rows = [(f"k{i}", bytes(r.randrange(256) for _ in range(r.choice([0, 1, 7, 300])))) for i in range(500)] + [("k3", b"again"), ("k3", b"again"), (None, b"none"), ("big", bytes(5000))]
    df = spark.createDataFrame(rows, "id string, raw binary")
    seen = None
    for n in (1, 7, 40):
        own = ordering.shuffled(df.repartition(n), ["id"], 11, F.octet_length("raw"))
        got = sorted((x.position, x.offset, x.id, bytes(x.raw)) for x in own.collect())
        assert [x[0] for x in got] == list(range(len(rows)))
        assert [x[2] or "" for x in got] == sorted((x[0] or "" for x in rows), key=lambda k: hashlib.sha256(f"11:{k}".encode()).hexdigest())
        assert seen is None or seen == got
        seen = got
    whole = b"".join(x[3] for x in seen)
    for size in (64, 1000, 1 << 20):
        blocks = {x.block: bytes(x.content) for x in ordering.concatenated(own, size).collect()}
        assert [blocks[i] for i in range(len(blocks))] == [whole[i : i + size] for i in range(0, len(whole), size)]
    other = ordering.shuffled(df, ["id"], 12).orderBy("position").select("id").collect()
    assert [x.id for x in other] != [x[2] for x in seen]


def test_alignment_of_two_vocabularies(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from loomline.functions import tokenizers

    files = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")]
    texts = ["The quick brown fox 12345 jumps.", "", None, "ação é útil — naïve 日本語 🙂", "word " * 400, "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {x.id: x for x in tokenizers.aligned(df, "text", *files, 64).collect()}
    a, b = (Tokenizer.from_file(f) for f in files)
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].left_ids is None
            continue
        e = a.encode(t, add_special_tokens=False)
        if len(e.ids) > 63:
            t = t[: e.offsets[62][1]]
            e = a.encode(t, add_special_tokens=False)
        f = b.encode(t, add_special_tokens=False)
        ends, other, first = [0] + [z for _, z in e.offsets], [z for _, z in f.offsets][:64], {}
        for j, z in enumerate(other[:-1]):
            first.setdefault(z, j)
        want = [(k, first[z]) for k, z in enumerate(ends[:-1]) if z > 0 and z in first]
        assert (got[i].left_ids, got[i].right_ids) == (e.ids, f.ids[:64])
        assert [tuple(p) for p in got[i].pairs] == want
    assert len(got[0].pairs) > 3


def test_alignment_takes_few_texts_at_once(spark):
    """A worker must hold the tokens of few texts: texts of 0.8 MB together are never tokenised in one call."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from loomline.functions import tokenizers

    seen = []
    texts = ["word " * 4000, None, "", *["naïve 日本 " * 700] * 80]
    assert sum(len((t or "").encode()) for t in texts) > 2 * tokenizers.GROUP
    parts = list(tokenizers._groups([pa.array(texts), pa.array([], pa.string()), pa.array(texts[:3])]))
    for part, _ in parts:
        seen.append(sum(len((t or "").encode()) for t in part))
    assert max(seen) <= tokenizers.GROUP and [t for p, _ in parts for t in p] == texts + texts[:3] and sum(last for _, last in parts) == 3
    files = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")]
    got = tokenizers.aligned(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(1), "text", *files, 16).collect()
    a = Tokenizer.from_file(files[0])
    for x in got:
        t = texts[x.id]
        assert x.left_ids == (None if t is None else a.encode(t[: a.encode(t).offsets[14][1]] if t else "").ids)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= tokenizers.BATCH_ROWS


def test_cut_by_a_beginning_equals_cut_by_the_whole():
    import public_tokenizers

    from loomline.functions import tokenizers

    t = tokenizers._tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(3)
    parts = ["we're ", "they'll", "'", "'v", "e", "   ", "\n\n ", "x" * 50, "12345", "日本", "🙂", " the", "--", "\u00a0", "é"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 120))) for _ in range(1500)] + [None, "", "y" * 5000, " " * 5000, "'re" * 900]
    assert tokenizers._local(t) and not tokenizers._local(tokenizers._tokenizer(public_tokenizers.path("word_bpe_49k.json")))
    for most in (2, 3, 5, 9):
        assert tokenizers._cut(t, texts, most, True) == tokenizers._cut(t, texts, most, False)


@pytest.mark.parametrize("n_docs, n_terms, k", [(30, 50, 4), (200, 120, 6), (60, 20, 30)])
def test_latent_vectors_equal_numpy(spark, n_docs, n_terms, k):
    r = np.random.default_rng(n_docs)
    a = r.random((n_docs, n_terms)) * (r.random((n_docs, n_terms)) < 0.2) + np.outer(r.random(n_docs), np.arange(n_terms) == 0)
    rows = [(int(i), f"t{j}", float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    vectors, values = latent.right_vectors(spark.createDataFrame(rows, "doc_id long, tok string, w double"), k)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    rank = min(k, int((s > s[0] * 1e-6).sum()))
    assert len(values) == rank and np.allclose(values, s[:rank], rtol=1e-8)
    v = np.zeros((n_terms, rank))
    for x in vectors.collect():
        v[int(x.tok[1:])] = x.v
    near = lambda y: (lambda z: z @ z.T)(y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12))
    assert np.allclose(near(a @ v), near(a @ vt[:rank].T), atol=1e-6)


def test_saved_index(spark, tmp_path):
    r = np.random.default_rng(2)
    x = r.normal(size=(12, 16))[r.integers(0, 12, 1500)] + 0.3 * r.normal(size=(1500, 16))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows + [(9000, None), (9001, [float("nan")] * 16)], "vec_id long, embedding array<double>")
    path = f"file://{tmp_path}/index"
    with pytest.raises(FileNotFoundError):
        cells.load(spark, path)
    assert cells.save(df, path, 20) == 1500
    asked = df.where("vec_id % 25 = 0 and vec_id < 2000")
    got = collections.defaultdict(list)
    for y in cells.search(asked, path, 5, probes=1, exact=True).orderBy("q", "rank").collect():
        got[y.q].append(y.vec_id)
    for q in range(0, 1500, 25):
        s = x @ x[q]
        s[q] = -np.inf
        assert got[q] == np.lexsort((np.arange(1500), -s))[:5].tolist()
    assert cells.recall(asked, path, 5, 4) >= 0.9
    # an index whose cells do not have their rows is refused
    spark.createDataFrame([(1, [0.0] * 16, 0.0, 0)], "vec_id long, embedding array<double>, far double, cell int").write.mode("append").partitionBy("cell").parquet(f"{path}/cells")
    with pytest.raises(ValueError):
        cells.load(spark, path)


def test_jaccard_with_frequent_tokens_and_repeated_ids(spark):
    r = random.Random(4)
    words = ["the", "of", "a"] + [f"w{i}" for i in range(60)]
    sets = lambda n: [(r.choice([None, *range(n)]), sorted({r.choice(words[:3]) for _ in range(3)} | {r.choice(words) for _ in range(r.randint(0, 9))})) for _ in range(n)]
    a, b = sets(120), sets(90)
    a += [(500 + i, x[1]) for i, x in enumerate(b[:20])] + [(700, [])]
    for least in (0.3, 0.6, 1.0):
        got = {tuple(x) for x in similarity.jaccard_pairs(*[spark.createDataFrame(d, "id long, toks array<string>") for d in (a, b)], least).collect()}
        want = {(i, j, len(set(x) & set(y)) / len(set(x) | set(y))) for i, x in a for j, y in b if x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= least}
        assert got == want and want
