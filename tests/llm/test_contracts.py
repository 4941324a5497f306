"""Every query on ordinary, edge and empty tables; results against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from edge import docs_of

from loomline.llm import decontaminate, langid, lmscore, packing, privacy, registry, sharding, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(params=["sf", "edge_dir"])
def where(request):
    return request.getfixturevalue(request.param)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty(spark, empty_dir, name):
    assert registry.QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql_twin(spark, where, name):
    import duckdb
    import harness

    con = duckdb.connect()
    if name == "op13_delta_lloyd" and not where.endswith("sf0.001"):
        pytest.skip("the twin needs unique vec_ids; tests/llm/test_vectors.py has these cases")
    for t in ("documents", "labels", "pages", "benchmark", "embeddings"):
        files = f"{where}/{t}.parquet" + ("" if where.endswith("sf0.001") else "/*.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{files}'")
    assert harness.compare(registry.QUERIES[name](spark, where), con, registry.ORACLES[name]) == ""


def test_op1(spark, where):
    docs = collections.Counter((d, len((t or "").encode())) for d, t in docs_of(spark, where))
    rows = registry.QUERIES["op1_pseudo_likelihood"](spark, where).collect()
    assert collections.Counter((r.doc_id, r.n_tokens) for r in rows) == docs
    assert all((r.pll == 0 and r.pll_per_token is None) if r.n_tokens == 0 else r.pll < 0 for r in rows)


def cells_of(text):
    """(window, word) of the words with a word on each side, by splitting at white space."""
    low = bytes(np.asarray(_lower(text.encode())))
    w = low.split()
    return [((w[i - 2] if i > 1 else None, w[i - 1], w[i + 1], w[i + 2] if i + 2 < len(w) else None), w[i]) for i in range(1, len(w) - 1)]


def _lower(raw):
    from loomline.llm import _scan

    return _scan.lower(np.frombuffer(raw, np.uint8))


def test_op1_memory_equals_brute_force(spark, monkeypatch):
    """Every window a cell: gains and recall from counts of all windows without the own occurrence."""
    import math

    monkeypatch.setattr(lmscore, "MEMORY_SHARE", 1)
    stock = "the cat sat on a mat and the dog ate it".split()
    import random

    r = random.Random(4)
    docs = [(i, " ".join(r.choice(stock) for _ in range(r.randint(0, 30)))) for i in range(200)] + [(900, "naïve über text twice of all"), (901, "naïve über text twice of all"), (902, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    scored = lmscore.by_network(df).collect()
    cells = {d: cells_of(t) for d, t in docs}
    both, windows = collections.Counter(c for v in cells.values() for c in v), collections.Counter(c[0] for v in cells.values() for c in v)
    lps = {x.doc_id: x.lps for x in scored}
    rid = {x.doc_id: x.rid for x in scored}
    gains = {x.rid: x for x in lmscore.recalled(spark.createDataFrame([tuple(x) for x in scored], lmscore.SCORED)).collect()}
    for d, own in cells.items():
        assert len(lps[d]) == len(own)
        want, known = 0.0, 0
        for (win, word), lp in zip(own, lps[d]):
            n, total = both[win, word], windows[win]
            want += math.log(n - 1 + lmscore.PRIOR * math.exp(lp)) - math.log(total - 1 + lmscore.PRIOR) - lp if total > 1 else 0
            known += n > 1
        got = gains.get(rid[d])
        assert abs((got.gain if got else 0) - want) < 1e-3 * max(1, abs(want)) and (got.known if got else 0) == known


def test_op1_memory_looks_at_every_window(spark, monkeypatch):
    """recall and score from the windows of all words, also of windows that many rows hold."""
    import math
    import random

    r = random.Random(6)
    docs = [(i, " ".join(r.choice("one two three four five".split()) for _ in range(r.randint(0, 12)))) for i in range(150)] + [(500 + i, "always the same very common line") for i in range(80)] + [(None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    cells = [(d, cells_of(t or "")) for d, t in docs]
    both, windows = collections.Counter(c for _, v in cells for c in v), collections.Counter(c[0] for _, v in cells for c in v)
    model = lmscore.model_of(df)
    monkeypatch.setattr(lmscore, "model_of", lambda docs: model)
    lps = {x.doc_id: (x.net, x.lps) for x in lmscore.by_network(df).collect()}
    for share in (1 / 1000, 1 / 20, 1.0):  # all windows counted in two levels, some, none
        monkeypatch.setattr(lmscore, "HOT_SHARE", share)
        got = {x.doc_id: x for x in lmscore.score(df).collect()}
        assert len(got) == len(docs)
        for d, own in cells:
            net, lp = lps[d]
            known = sum(both[c] > 1 for c in own)
            assert len(lp) == len(own) and got[d].recall == (known / len(own) if own else None)
            want = net + sum(math.log(both[c] - 1 + lmscore.PRIOR * math.exp(p)) - math.log(windows[c[0]] - 1 + lmscore.PRIOR) - p for c, p in zip(own, lp) if windows[c[0]] > 1)
            assert abs(got[d].pll - want) < 1e-3 * max(1, abs(want))


def test_op1_cells_come_in_parts_and_leave_no_shuffle_files(spark):
    """The parts hold each cell once, each about as many; a part's shuffle files go when it is written."""
    import random
    import time

    from loomline import cluster

    r = random.Random(7)
    df = spark.createDataFrame([(i, " ".join(f"w{r.randint(0, 300)}" for _ in range(40))) for i in range(200)], "doc_id long, text string")
    model = spark.sparkContext.broadcast(lmscore.model_of(df))
    take = lambda k, n: collections.Counter((x.rid, x.w, x.k) for x in lmscore.cells_of_rows(df, model, np.zeros(0, np.int64), k, n).where("own is null").collect())
    parts = [take(k, lmscore.PASSES) for k in range(lmscore.PASSES)]
    assert sum(parts, collections.Counter()) == take(0, 1)
    assert len(parts) > 1 and all(0.8 < len(parts) * p.total() / (200 * 38) < 1.2 for p in parts)

    files = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",").split(",") if "shuffle_" in f}
    old, was = files(), spark.conf.get(cluster.FREE, None)
    freed = cluster.materialize(spark.range(9999).repartition(3, "id"), "freed", free=True)
    until = time.time() + 20
    while files() - old and time.time() < until:  # they go soon after
        time.sleep(0.1)
    assert not files() - old and freed.count() == 9999 and spark.conf.get(cluster.FREE, None) == was


def shuffled_records(spark, run):
    """Rows that the stages of run() write for shuffles."""
    import time

    store, jvm = spark._jsc.sc().statusStore(), spark._jvm

    def stages():
        time.sleep(1)  # the listener is behind by as much
        none = spark.sparkContext._gateway.new_array(jvm.double, 0)
        found = store.stageList(None, False, False, none, None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (found.apply(i) for i in range(found.size()))}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


def test_op1_cells_are_shuffled_many_in_a_row(spark):
    """30,000 cells: before, each was a row of the shuffle and of its sort."""
    import random

    r = random.Random(9)
    df = spark.createDataFrame([(i, " ".join(f"w{r.randint(10, 99)}" for _ in range(102))) for i in range(300)], "doc_id long, text string").coalesce(2)
    assert shuffled_records(spark, lambda: lmscore.score(df).count()) < 15_000


def test_op1_does_not_depend_on_the_number_of_buckets(spark, monkeypatch):
    """Buckets of few cells, some without a row of docs, dealt a slice at a time or all at once."""
    import random

    r = random.Random(10)
    docs = [(i, " ".join(r.choice("red green blue white black".split()) for _ in range(r.randint(0, 40)))) for i in range(200)] + [(300, None), (None, "red green blue white black"), (301, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    model = lmscore.model_of(df)
    monkeypatch.setattr(lmscore, "model_of", lambda docs: model)
    monkeypatch.setattr(lmscore, "HOT_SHARE", 1 / 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = []
        for bucket, at_once in ((1 << 19, 1 << 20), (50, 1 << 20), (50, 1)):
            monkeypatch.setattr(lmscore, "BUCKET", bucket)
            monkeypatch.setattr(lmscore, "DEALT_AT_ONCE", at_once)
            got.append(sorted(((x.doc_id if x.doc_id is not None else -1, x.n_tokens, round(x.pll, 6), x.recall) for x in lmscore.score(df).collect()), key=str))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    assert len(got[0]) == len(docs) and got[0] == got[1] == got[2]
    assert sum(x[3] or 0 for x in got[0]) > 10


def test_op1_scores_documents_that_occur_twice_apart(spark):
    import random

    r = random.Random(8)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3))
    texts = [" ".join(word() for _ in range(r.randint(60, 200))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i]) for i in range(60)], "doc_id long, text string")
    got = {x.doc_id: x for x in lmscore.score(df).collect()}
    twice = [got[i] for i in range(60)]
    once = [got[i] for i in range(60, 300)]
    cut = np.quantile([x.pll_per_token for x in once], 0.95)
    assert np.mean([x.pll_per_token > cut for x in twice]) > 0.9
    assert all(x.recall == 1 for x in twice if x.recall is not None) and np.mean([x.recall or 0 for x in once]) < 0.05


def test_op1_scores_are_sums_of_the_network(spark):
    r = np.random.default_rng(0)
    weights = [w + r.normal(0, 0.1, w.shape).astype(np.float32) for w in lmscore.start_weights()]
    ids, within = [1] * 256, [-2.0] * 256
    for i, b in enumerate(b"abcdefgh "):
        ids[b], within[b] = i + 2, 0.0
    texts = [b"abc def", b"h", b"ab" * 700_000, b"xyz", b"", b"hhg " * 400_000]
    got, (number, win, word, lp) = lmscore.Scorer(ids, within, weights).score(texts)
    for k in (0, 1, 3):
        x = [0, 0, *[ids[b] for b in texts[k]], 0, 0]
        ctx = np.array([((x[i - 2] * lmscore.TOKENS + x[i - 1]) * lmscore.TOKENS + x[i + 1]) * lmscore.TOKENS + x[i + 2] for i in range(2, len(x) - 2)])
        want = lmscore.log_probs(weights, ctx)[np.arange(len(ctx)), x[2:-2]].sum() + sum(within[b] for b in texts[k])
        assert abs(got[k] - want) < 1e-3
    assert got[4] == 0 and (np.diff(number) >= 0).all() and set(number.tolist()) <= {5}


def test_op1_training_lowers_the_loss():
    r = np.random.default_rng(0)
    ctx = np.unique(r.integers(0, lmscore.TOKENS**4, 3000))
    counts = np.zeros((len(ctx), lmscore.TOKENS), np.float32)
    counts[np.arange(len(ctx)), ctx % lmscore.TOKENS] = 5
    loss = lambda w: -(lmscore.log_probs(w, ctx) * counts).sum() / counts.sum()
    start = lmscore.start_weights()
    assert loss(lmscore.train_shard(start, ctx, counts, 8, 0.02, 0)) < 0.5 * loss(start)


def test_op3(spark, where):
    texts = collections.defaultdict(list)
    for d, t in docs_of(spark, where):
        texts[d].append(t or "")
    rows = registry.QUERIES["op3_robust_outliers"](spark, where).collect()
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    want = collections.Counter()
    for d, ts in texts.items():
        for t in ts:
            w = WORD.findall(t)
            seen = collections.defaultdict(list)
            for i in range(len(w) - 4):
                seen[tuple(w[i : i + 5])].append(i)
            covered = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
            lines = [x for x in t.split("\n") if WORD.search(x)]
            want[(d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))] += 1
    assert got == want
    assert all(not r.kept for r in rows if r.base_failed) and any(r.kept for r in rows)


def mcd_in_numpy(x):
    """The same starts, steps and reweighting, one group; the log-determinants of the starts after their first steps."""
    from loomline.llm import outliers as o

    floors, k = np.diag(np.array(list(o.FLOORS.values())) ** 2), x.shape[1]
    dist = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    def step(m, c):
        bins = np.floor(np.log2(np.maximum(dist(m, c), 1e-6)) * o.BINS)
        sub = x[np.array([(bins < b).sum() for b in bins]) < o.H * len(x)]
        return sub.mean(0), np.cov(sub.T, bias=True) * o.consistency(k, o.H) + floors

    logdet = lambda e: np.linalg.slogdet(e[1])[1]
    p = np.sort(x, axis=0)[[max(int(np.ceil(q * len(x))) - 1, 0) for q in (0.25, 0.5, 0.75)]]
    wide = np.diag(((p[2] - p[0]) / 1.349) ** 2) + floors
    starts = [(x.mean(0), np.cov(x.T, bias=True) + floors), (p[1], wide), (p[0], wide)]
    for _ in range(o.FIRST_STEPS):
        starts = [step(*e) for e in starts]
    best = min(starts, key=logdet)
    for _ in range(o.STEPS):
        new = step(*best)
        if logdet(new) >= logdet(best) - 1e-6:
            break
        best = new
    sub = x[dist(*best) <= o.chi2_quantile(o.WITHIN, k)]
    return dist(sub.mean(0), np.cov(sub.T, bias=True) * o.consistency(k, o.WITHIN) + floors), [logdet(e) for e in starts]


@pytest.mark.parametrize("junk, spread", [(20, 1.0), (133, 0.05), (133, 0.5)])
def test_op3_distances_equal_numpy(spark, junk, spread):
    """Few outliers, and a third of the rows in a far cluster, tight or wide: all of them lie beyond the cut."""
    from pyspark.sql import functions as F

    from loomline.llm import outliers

    r = np.random.default_rng(2)
    x = r.normal(0, 1, (400, 5)) @ np.diag([1, 0.3, 0.1, 0.2, 0.2])
    x[:junk] = x[:junk] * spread + (8 if junk == 20 else np.array([1.0, 2.0, 1.5, 0.2, 2.5]))
    names = list(outliers.FLOORS)
    df = spark.createDataFrame([(i, "en", "s", True, *map(float, v)) for i, v in enumerate(x)], "i int, lang string, source string, used boolean, " + ", ".join(f"{n} double" for n in names))
    got = {v.i: v.d2 for v in outliers.mcd_distances(df, names, ["lang", "source"]).select("i", F.col("d2")).collect()}
    want, dets = mcd_in_numpy(x)
    assert np.allclose([got[i] for i in range(400)], want, rtol=1e-6)
    assert want[:junk].min() > outliers.CUTOFF > np.quantile(want[junk:], 0.99)
    assert junk == 20 or dets[0] > min(dets) - 1e-9


def ids_of(tok, text):
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


@pytest.fixture(scope="session")
def tok():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_file())
    t.encode_special_tokens = True
    return t


def test_op4(spark, where, tok):
    docs = collections.Counter(docs_of(spark, where))
    rows = registry.QUERIES["op4_vector_packing"](spark, where).collect()
    by_seq = collections.defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
    pad = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= packing.MAX_TOKENS and len(own) <= packing.MAX_SEGMENTS
        pad += 0 if at & (at - 1) == 0 else packing.MAX_TOKENS - at
    total = sum(r.length for r in rows)
    assert pad <= 0.01 * total + packing.MAX_TOKENS
    want = collections.Counter()
    cuts = collections.defaultdict(set)
    for r in rows:
        cuts[r.doc_id, r.doc_tokens].add((r.start, r.length))
    for (d, t), n in docs.items():
        ids = ids_of(tok, t)
        for s, k in cuts[d, len(ids)]:
            want[d, s, k, zlib.crc32(ids[s : s + k].tobytes()), len(ids)] = 0
    for r in rows:
        assert (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) in want
    assert total == sum(len(ids_of(tok, t)) * n for (_, t), n in docs.items())


def test_op4_very_short_texts_need_no_padding(spark):
    df = spark.createDataFrame([(i, "a b") for i in range(3000)], "doc_id long, text string").coalesce(1)
    seqs = collections.defaultdict(int)
    for r in packing.pack_documents(df).collect():
        seqs[r.sequence_id] += r.length
    pad = sum(0 if n & (n - 1) == 0 else 2048 - n for n in seqs.values())
    assert sum(seqs.values()) == 9000 and pad <= 0.02 * 9000


def test_op6_without_broadcast(spark, sf, monkeypatch):
    want = sorted(map(tuple, registry.QUERIES["op6_lpt_shards"](spark, sf).select("doc_id", "shard", "slot").collect()))
    monkeypatch.setattr(sharding, "BROADCAST_RUNS", 0)
    assert sorted(map(tuple, registry.QUERIES["op6_lpt_shards"](spark, sf).select("doc_id", "shard", "slot").collect())) == want


def test_tokenizer_pieces(tok):
    texts = ["it's 'tis x'then we'll I'd they'reé 're' ''s 'l 'v !'s a'", "a1b22c³ ½", "", "  ", "word_word", "é'sé", "日本 don't", "A\u00a0b", "x" * 5000, "'", "'s", "d'", "\x1c a", "don't " * 9]
    own = packing.WordTokenizer(packing.tokenizer_file())
    for t, got in zip(texts, own.encode(texts)):
        assert got.tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_packing_of_examples_keeps_all_limits(spark):
    import random

    r = random.Random(4)
    rows = [(i, n := r.randint(1, 1000), r.randint(0, n // 2)) for i in range(2000)]
    df = spark.createDataFrame(rows + [(9001, 3000, 1), (9002, 700, 601), (9003, None, None)], "id long, n int, loss int").repartition(3)
    got = packing.pack_examples(df, "id", "n", "loss", 2048, 6, 600).collect()
    assert {x.example_id for x in got if x.sequence_id is None} == {9001, 9002} and any(x.example_id == 9003 and x.sequence_id is not None for x in got)
    got = [x for x in got if x.example_id < 9000]
    w = {i: (n, 1, k) for i, n, k in rows}
    seqs = collections.defaultdict(list)
    for x in got:
        seqs[x.sequence_id].append(w[x.example_id])
    assert sorted(x.example_id for x in got) == list(range(2000))
    assert all(all(sum(c) <= m for c, m in zip(zip(*s), (2048, 6, 600))) for s in seqs.values())
    least = max(sum(x[0] for x in w.values()) / 2048, 2000 / 6, sum(x[2] for x in w.values()) / 600)
    assert len(seqs) <= 1.15 * least + 3


def spans_of(t):
    luhn = lambda d: sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: [int(c) for c in s if c.isdigit()]
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(p.lstrip("0")) <= 3 and p.lstrip("0").rjust(3, "0") <= "255" for p in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]
    return [(k, *m.span()) for k, m in out]


def test_op5(spark, where):
    docs = docs_of(spark, where)
    rows = registry.QUERIES["op5_disclosure_terms"](spark, where).collect()
    line = lambda t: ",".join("%s:%d:%d" % s for s in spans_of(t or ""))
    want = collections.Counter((d, hashlib.sha256(line(t).encode()).hexdigest()) for d, t in docs)
    assert collections.Counter((r.doc_id, r.base_sha256) for r in rows) == want
    assert all(r.n_email == r.spans.count("email:") and r.n_card == r.spans.count("card:") for r in rows)
    assert all(r.n_spans == len([x for x in r.spans.split(",") if x]) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_secret + r.n_term for r in rows)


def test_op5_spans_equal_the_patterns():
    import random

    r, find = random.Random(5), privacy.Finder()
    for _ in range(20_000):
        t = "".join(r.choice("aZ9.@-+%_ ()\n1é") for _ in range(r.randint(0, 40)))
        assert find.spans(t) == spans_of(t), t


def test_op5_terms(spark):
    """A name that stands near one address in many surroundings, and nowhere else, gives it away; common words do not."""
    import random

    from pyspark.sql import functions as F

    r = random.Random(6)
    word = lambda: "".join(r.choice("bcdfg") + r.choice("aeiou") for _ in range(3))
    common = ["which", "there", "about", "wrote", "from"]
    rows = [(i, " ".join(r.choice(common) if r.random() < 0.4 else word() for _ in range(30)), "en") for i in range(2000)]
    rows += [(5000 + i, f"{word()} {word()} there Quagmire wrote{i} from box@host.example.com about {word()} {word()}", "en") for i in range(12)]
    rows += [(6000 + i, "copied passage Singular box2@host.example.com text", "en") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x.more for x in privacy.find(df).where("more <> ''").select("doc_id", "more").collect()}
    assert set(got) == {5000 + i for i in range(12)}
    text = dict((i, t) for i, t, _ in rows)
    flagged = {text[d][int(s) : int(e)] for d, m in got.items() for _, s, e in (x.split(":") for x in m.split(","))}
    assert flagged == {"Quagmire"}
    clean = privacy.stage(spark, df, "").select("doc_id", "text").where(F.col("doc_id") >= 5000).collect()
    assert len(clean) == 62 and not any("Quagmire" in x.text or "@" in x.text for x in clean)
    assert any("Singular" in x.text for x in clean)


def test_op5_pairs_equal_brute_force(spark):
    """Flagged pairs of a corpus in several scripts, by counting in plain Python."""
    import math
    import random

    r = random.Random(9)
    stock = ["Κώστας", "Квагмир", "Quagmire", "Straße", "naïve", "wording", "there", "about", "“Marlowe”", "Orwell—", "日本の人々", "tail_end", "x9y8words"]
    docs = []
    for i in range(400):
        w = [r.choice(stock[4:]) if r.random() < 0.5 else stock[r.randint(0, 3)] if r.random() < 0.003 else "".join(r.choice("abcdeé") for _ in range(5)) for _ in range(r.randint(5, 40))]
        for _ in range(r.choice([0, 0, 1, 2])):
            k = r.randint(0, 3)
            at = r.randint(0, len(w))
            w[at:at] = [stock[k], f"box{k}@h{k % 2}.example.com" if r.random() < 0.9 else "10.0.0.7,"]
        docs.append((i, " ".join(w)))
    pattern, taken, near, df = re.compile(r"[^\W\d_]{4,}"), [], collections.defaultdict(set), collections.Counter()
    ce, both = collections.Counter(), collections.defaultdict(set)
    for d, t in docs:
        spans = spans_of(t)
        free = [m for m in pattern.finditer(t) if not any(s < m.end() and m.start() < e for _, s, e in spans)]
        df.update({m[0].lower() for m in pattern.finditer(t)})
        words = [m.span() for m in WORD.finditer(t)]
        names = set()
        for kind, s, e in spans:
            v = t[s:e].lower()
            own = [f"{kind}:{v}"] + ([f"host:{v.split('@')[1]}"] if kind == "email" else [])
            names |= set(own)
            left, right = [x for x in words if x[0] < s][-privacy.NEAR :], [x for x in words if x[1] > e][: privacy.NEAR]
            lo, hi = left[0][0] if left else s, right[-1][1] if right else e
            for m in free:
                if lo <= m.start() and m.end() <= hi:
                    for x in own:
                        near[x, m[0].lower()].add((t[lo:s], t[e:hi]))
                        both[x, m[0].lower()].add(d)
        ce.update(names)
    want = set()
    for (x, w), places in near.items():
        if min(len(places), len(both[x, w])) >= privacy.SUPPORT:
            share = math.log(len(docs) * len(both[x, w]) / (ce[x] * max(df[w], len(both[x, w])))) / math.log(len(docs) / ce[x])
            if share >= privacy.GENERALISE:
                want.add((x, w, "remove" if share >= privacy.REMOVE else "generalise"))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    terms = {(r.doc_id, x.term): x.action for r in privacy.flagged_terms(table, _base(spark, table)).collect() for x in r.terms}
    text = dict(docs)
    held = collections.defaultdict(set)
    for d, t in docs:
        for kind, s, e in spans_of(t):
            held[d] |= {f"{kind}:{t[s:e].lower()}"} | ({"host:" + t[s:e].split("@")[1].lower()} if kind == "email" else set())
    expected = {}
    for d in held:
        for x, w, action in want:
            if x in held[d]:
                expected[d, w] = max(action, expected.get((d, w), ""))
    assert terms == expected and len({w for _, w in terms}) >= 3


def _base(spark, table):
    from pyspark.sql import functions as F

    from loomline.llm import _scan

    return _scan.over(table.select("doc_id", F.xxhash64("text").alias("key"), "text"), privacy._base_batches, privacy.BASE)


def test_op5_long_runs_of_digits_and_texts_without_white_space():
    import random
    import time

    find, r = privacy.Finder(), random.Random(13)
    for t in ("0" * 5000 + ".1.1.1", "1." + "0" * 6000 + "255.0.0", "9" * 5000 + ".1.1.1", "4" * 20_000, "+" + "1" * 9000):
        assert find.spans(t) == spans_of(t)
    for _ in range(300):
        t = "".join(r.choice(["0" * r.randint(1, 4500), "7" * r.randint(1, 4), ".", "1.1.1", "-", " ", "+1"]) for _ in range(r.randint(1, 9)))
        assert find.spans(t) == spans_of(t), t
    text = ",".join(f"name{chr(97 + i % 26)}{'abcdefghij'[i // 26 % 10]},a{i}@x{i}.example.com" for i in range(100_000))
    start = time.time()
    (batch,) = privacy._base_batches([_batch([(1, 2, text)])])
    assert time.time() - start < 20 and batch.num_rows > 10
    assert sum(len(x) for x in batch.column("entities").to_pylist()) == 200_000


def _batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "key", "text"])


def test_op5_secrets_and_many_entities():
    import time

    find = privacy.Finder()
    found = lambda t: [t[s:e] for _, s, e in find.secrets(t)]
    assert found('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and') == ["04dbebab91ab85687d33eeaaf9ac699e1188f962"]
    assert found("API_KEY: sk-a8B3kd92LmQ0zz7Tq1") == ["sk-a8B3kd92LmQ0zz7Tq1"]
    assert not found("see https://example.com/2024/a-long-page-name-12 = aaaaaaaaaaaaaaaaaaaaaaaa1, x = internationalisation")
    text = " ".join(f"word{i} a{i}@x{i}.example.com" for i in range(20_000))
    start = time.time()
    assert sum(len(w) for _, w, _ in find.near(text, find.spans(text))) >= 20_000
    assert time.time() - start < 10


def test_op6(spark, where):
    docs = docs_of(spark, where)
    rows = registry.QUERIES["op6_lpt_shards"](spark, where).collect()
    raw = lambda t: (t or "").encode()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == collections.Counter((d, len(raw(t)) + 16, zlib.crc32(raw(t))) for d, t in docs)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(40))
    # the loads are those of the plain heap over groups
    sizes = collections.Counter()
    for _, t in docs:
        sizes[t] += len(raw(t)) + 16
    loads = [0] * 40
    for s in sorted(sizes.values(), reverse=True):
        loads[loads.index(min(loads))] += s
    got = collections.Counter()
    for r in rows:
        got[r.shard] += r.size
    assert sorted(got[k] for k in range(40)) == sorted(loads)


def test_op6_placing_equal_sizes():
    import random

    r = random.Random(7)
    for _ in range(300):
        k = r.randint(1, 9)
        loads, size, count = [r.randint(0, 50) for _ in range(k)], r.randint(1, 20), r.randint(0, 60)
        want, own = [0] * k, list(loads)
        for _ in range(count):
            j = own.index(min(own))
            own[j] += size
            want[j] += 1
        assert sharding.place_equal(loads, size, count) == want


def fingerprint(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    import xxhash

    own = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def classes(fps):
    """Component of each fingerprint by comparing all pairs."""
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    u = np.array(sorted(parent), np.uint64)
    for f in u:
        for g in u[np.bitwise_count(u ^ f) <= 2]:
            a, b = root(int(f)), root(int(g))
            parent[max(a, b)] = min(a, b)
    return {f: root(f) for f in parent}


def test_op8(spark, where):
    docs = docs_of(spark, where)
    rows = registry.QUERIES["op8_popcount_simhash"](spark, where).collect()
    assert collections.Counter((r.doc_id, r.fingerprint) for r in rows) == collections.Counter((d, f"{fingerprint(t):016x}") for d, t in docs)
    comp = classes({int(r.fingerprint, 16) for r in rows})
    least = collections.defaultdict(list)
    for r in rows:
        least[comp[int(r.fingerprint, 16)]].append(r.doc_id)
    want = {c: min((d for d in ds if d is not None), default=None) for c, ds in least.items()}
    assert all(r.component_id == want[comp[int(r.fingerprint, 16)]] for r in rows)


def test_op8_links_in_sparse_and_dense_cells(spark):
    """Chains, clusters denser than a cell's limit, and strangers: the components are those of all pairs."""
    import random

    r = random.Random(8)
    fps = {r.getrandbits(64) for _ in range(500)}
    for _ in range(3):
        seed = r.getrandbits(64)
        fps |= {seed ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(200)}
        for _ in range(30):
            seed ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
            fps.add(seed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {x.node: x.label for x in simhash.components(simhash.links(df, len(fps)), len(fps)).collect()}
    want = classes(fps)
    a, b = collections.defaultdict(set), collections.defaultdict(set)
    for f in fps:
        a[got.get(signed(f), signed(f))].add(f)
        b[want[f]].add(f)
    assert {frozenset(x) for x in a.values()} == {frozenset(x) for x in b.values()}


def test_op9(spark, where):
    docs = docs_of(spark, where)
    rows = registry.QUERIES["op9_ppm_language"](spark, where).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(d for d, _ in docs)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    letters = collections.Counter((d, any(c.isalpha() for c in t or "")) for d, t in docs)
    assert collections.Counter((r.doc_id, r.lang_pred != "und") for r in rows) == letters
    assert all(0 <= r.score <= 1 for r in rows)


def test_op9_held_out_accuracy(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in registry.QUERIES["op9_ppm_language"](spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_op9_code_lengths_equal_a_plain_tree():
    """The table's sums are those of a context tree walked byte by byte."""
    import math

    texts = {"x": [b"abracadabra abracadabra", b"banana"], "y": [b"zxcvb zxcvb qwert"]}
    model = langid.train(texts)
    fold, a = model["fold"], langid.SYMBOLS
    for j, lang in enumerate(model["langs"]):
        x = [int(fold[b]) for b in b"\n\n\n" + b"\n\n\n".join(texts[lang])]
        tree = [collections.defaultdict(collections.Counter) for _ in range(4)]
        for k in range(4):
            for i in range(k, len(x)):
                tree[k][tuple(x[i - k : i])][x[i]] += 1

        def bits(ctx, s):
            for k in range(len(ctx), -1, -1):
                c = tree[k].get(tuple(ctx[len(ctx) - k :]))
                if c and c[s]:
                    return math.log2((sum(c.values()) + len(c)) / c[s])
                if c:
                    return math.log2((sum(c.values()) + len(c)) / len(c)) + (bits(ctx[1:][-k + 1 :] if k > 1 else [], s) if k else math.log2(a))
            return math.log2(a)

        for text in (b"abrax zx", b"q", b"banana zxcvb"):
            y = [int(fold[b]) for b in b"\n\n\n" + text]
            want = sum(bits(y[i - 3 : i], y[i]) for i in range(3, len(y)))
            assert abs(langid.Scorer(model).bits([b"pad", text])[1, j] - want) < 1e-3


def test_op10_exact_and_changed(spark):
    item = "Each week Anna sells 14 baskets of red apples for 3 dollars each while Peter sells 20 boxes of pears at the same market stall"
    other = item.replace("Anna", "Maria").replace("14", "55").replace("Peter", "Oskar").replace("20", "81")
    mixed = "Each week Anna sells 14 baskets of red apples for 3 dollars each"
    docs = [(1, "Before. " + item + ". After."), (2, "x " + other + " y"), (3, "nothing of the kind " * 30), (4, mixed), (5, None), (6, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(df, bench).collect()}
    assert set(got) == {1, 2}
    assert got[1].slots_changed == 0 and got[2].slots_changed == 4


def test_op10_conflicting_slots_are_no_match(spark):
    item = "if Anna has 5 red pens and gives 5 red pens to her friend then Anna has how many red pens in the end"
    bad = "if Maria has 6 red pens and gives 9 red pens to her friend then Oskar has how many red pens in the end"
    df = spark.createDataFrame([(1, bad), (2, bad.replace("9", "6").replace("Oskar", "Maria"))], "doc_id long, text string")
    m = {r.doc_id: r.n_found for r in decontaminate.contaminated(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert 2 in m and m.get(1, 0) < m[2]


def test_op10_finds_every_contained_item(spark, sf):
    docs = docs_of(spark, sf)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in docs for i, x in items if x in t}
    got = {(r.doc_id, r.item_id) for r in registry.QUERIES["op10_template_leaks"](spark, sf).collect()}
    assert want <= got


def plain_tokens(t):
    """(token in lower case, slot type, begins a sentence) by regular expressions; ASCII and Latin-1 case only."""
    low = lambda x: "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" and c != "×" else c for c in x)
    out, last = [], 0
    for m in re.finditer(r"[0-9]+(?:[.,]+[0-9]+)*|[\u3000-\u303f]|[\u3040-\u9fff\u0e00-\u0eff]|(?:(?![\u3000-\u9fff\u0e00-\u0eff])[A-Za-z\u0080-\U0010ffff])+", t):
        x = m[0]
        if "\u3000" <= x <= "\u303f":
            continue
        first = not out or any(c in ".!?\n:;|\"" for c in t[last : m.start()])
        up = lambda c: "A" <= c <= "Z" or "À" <= c <= "Þ"
        number = x[0] in "0123456789" or low(x) in decontaminate.NUMBER_WORDS
        kind = 1 if number else 3 if out and not first and out[-1][1] == 1 and low(x) in decontaminate.UNITS else 2 if len(x) > 1 and up(x[0]) and not up(x[1]) else 0
        if out and low(x) in decontaminate.NUMBER_WORDS and out[-1][3] and t[last : m.start()] in (" ", "-"):
            out[-1] = (out[-1][0] + " " + low(x), 1, out[-1][2], True)
        else:
            out.append((low(x), kind, first, number and x[0] not in "0123456789"))
        last = m.end()
    return [x[:3] for x in out]


def plain_forms(tokens, i, w):
    named = lambda k, first, form: k == 2 and (form == 2 or form == 0 and not first)
    return [tuple((k,) if form < 3 and k in (1, 3) else (2,) if form < 3 and named(k, first, form) else x for x, k, first in tokens[i : i + w]) for form in range(4)]


def plain_leaks(docs, items):
    """All (document row, item row, windows found) by comparing windows as tuples."""
    out = collections.Counter()
    read = [(d, plain_tokens(t or "")) for d, t in docs]
    for item_id, text in items:
        own = plain_tokens(text or "")
        w = min(decontaminate.WINDOW, len(own))
        if not w:
            continue
        wanted, n = collections.defaultdict(set), len(own) - w + 1
        for q in range(n):
            forms = plain_forms(own, q, w)
            few = sum(k in (0, 2) for _, k, _ in own[q : q + w]) < min(4, w - 1)
            for form, x in enumerate(forms):
                literal = sum(not isinstance(y, tuple) for y in x)
                if (w < 3 and form == 3) or w > 2 and (few if form == 3 else literal >= min(4, w - 1)):
                    wanted[x].add(q)
        for d, tokens in read:
            hits = sorted({(p, q) for p in range(len(tokens) - w + 1) if w > 2 or len(tokens) == w for x in plain_forms(tokens, p, w) for q in wanted.get(x, ())})
            best, start = 0, 0
            for i in range(1, len(hits) + 1):
                if i == len(hits) or hits[i][0] - hits[i - 1][0] > len(own):
                    part = hits[start:i]
                    met = {(p + k, q + k) for p, q in part for k in range(w) if own[q + k][1]}
                    votes = collections.Counter((own[y][1], own[y][0], tokens[x][0]) for x, y in met)
                    head = min(q for _, q in hits)  # ties: first in the item's matched part, then first met in the document
                    stands = lambda k, v: next(y for y in range(head, len(own)) if own[y][1] == k and own[y][0] == v)  # noqa: B023, E731
                    comes = lambda k, d: min(x for x, y in met if own[y][1] == k and tokens[x][0] == d)  # noqa: B023, E731
                    there, back = {}, {}
                    for k, v, x in sorted(votes, key=lambda e: (-votes[e], stands(e[0], e[1]), comes(e[0], e[2]))):  # noqa: B023
                        there.setdefault((k, v), x)
                        back.setdefault((k, x), v)
                    good = lambda x, y: there[own[y][1], own[y][0]] == tokens[x][0] and back[own[y][1], tokens[x][0]] == own[y][0]  # noqa: B023, E731
                    used = {q for p, q in part if all(good(p + k, q + k) for k in range(w) if own[q + k][1])}
                    need = max(1, -(-min(n, 2 * decontaminate.RUN) // 2))
                    best = max(best, len(used)) if len(used) >= need else best
                    start = i
            if best:
                out[d, item_id, best] += 1
    return out


def test_op10_equals_brute_force(spark, where):
    docs = docs_of(spark, where)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{where}/benchmark.parquet").collect()]
    want = plain_leaks(docs, items)
    got = collections.Counter((r.doc_id, r.item_id, r.n_found) for r in registry.QUERIES["op10_template_leaks"](spark, where).collect())
    assert got == want


def test_op10_templates_and_ties_equal_brute_force(spark):
    """Items made from a few templates, texts that repeat them with equal, changed and conflicting values."""
    import random

    r = random.Random(11)
    names, number = ["Anna", "Peter", "Maria", "Oskar", "Ines"], lambda: str(r.randint(1, 6))
    frames = ["each week {a} sells {x} baskets of red apples while {b} sells {y} boxes of the pears and {a} keeps {x}",
              "if {a} has {x} pens and gives {y} pens to {b} then how many pens has {a} after that",
              "{a} pays {x} dollars and {b} pays {x} dollars so they pay {y} dollars in all for the same old thing"]
    fill = lambda f: f.format(a=r.choice(names), b=r.choice(names), x=number(), y=number())
    items = [(i, fill(r.choice(frames)) + r.choice(["", " and nothing else at all on that day", " " + number()])) for i in range(60)]
    docs = [(i, " ".join(r.choice([fill(f), f.split("{y}")[0].format(a="Anna", b="Peter", x=number()), "some other words here"]) + r.choice([".", ""]) for f in r.choices(frames, k=r.randint(1, 4)))) for i in range(80)]
    want = plain_leaks(docs, items)
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert collections.Counter((x.doc_id, x.item_id, x.n_found) for x in got) == want and len(want) > 300


def test_op10_frames_that_many_items_share_in_little_time(monkeypatch):
    import random
    import time

    r = random.Random(12)
    word = lambda: "".join(r.choice("bcdfg") + r.choice("aeiou") for _ in range(4))
    frame = "consider the following statement about numbers and their"
    items = [(i, f"{frame} {' '.join(word() for _ in range(12))}".encode()) for i in range(10_000)]
    template = [(i, f"each week Anna sells {r.randint(1, 10**6)} baskets of apples and {r.randint(1, 10**6)} boxes of pears at the market".encode()) for i in range(10_000)]
    asked = b"x each week Maria sells 5 baskets of apples and 7 boxes of pears at the market. "
    for own, text, n in ((items, frame.encode() + b" ", 0), (template, asked, 10_000)):
        m = decontaminate.Matcher(decontaminate.index(own))
        full = text * (20_000 // len(text)) if n == 0 else text
        start = time.time()
        found = m.match([full, b"", full])
        took = time.time() - start
        assert [len(x) for x in found] == [n, 0, n] and took < (4 if n == 0 else 20)
        some = decontaminate.Matcher(decontaminate.index(own[:50]))
        want = [x for x in found[0] if x[0] < 50]
        assert some.match([full])[0] == want
        for limit in (1, 1000):  # the same, a few rows at a time
            monkeypatch.setattr(decontaminate, "EXPAND", limit)
            assert some.match([full, full]) == [want, want]
        monkeypatch.undo()


ANNA = "Each week Anna sells 14 baskets of red apples for 3 dollars each while Peter sells 20 boxes of pears at the same market stall"
SALE = "Anna sells 14 baskets a day. Anna pays 3 dollars each. Anna keeps the rest."


@pytest.mark.parametrize("item, text, found", [
    (ANNA, ANNA.lower(), True),
    (ANNA, ANNA.replace("14", "fourteen").replace("20", "twenty-five"), True),
    (ANNA, ANNA.replace("14", "1,400").replace("3 ", "3.5 "), True),
    (SALE, SALE.replace("Anna", "Maria").replace("14", "99"), True),
    ("What is 12 + 7?", "so What is 12 + 7? indeed", True),
    ("What is 12 + 7?", "What is 13 + 7?", False),
    ("What is 12 times 7?", "x What is 12 times 7? y", True),
    ("这个问题有几个苹果和梨子在桌子上面", "前面有。这个问题有几个苹果和梨子在桌子上面。后面", True),
    ("这个问题有几个苹果和梨子在桌子上面", "别的文字完全不同的内容在这里没有关系", False),
    ("x", "x", True), ("x", "x y", False), ("?!", "?!", False), ("", "", False),
    (ANNA, "Each week Maria buys bread and 14 rolls at the corner shop for the whole family of red cats", False),
])
def test_op10_cases(item, text, found):
    m = decontaminate.Matcher(decontaminate.index([(1, item.encode())]))
    assert bool(m.match([b"other text", text.encode(), b""])[1]) == found


def test_op10_long_texts_in_pieces():
    text = (b"filler words of no interest " * 90_000) + ANNA.encode() + b" more" * 10
    m = decontaminate.Matcher(decontaminate.index([(1, ANNA.encode())]))
    got = m.match([b"short", text, ANNA.encode()])
    assert not got[0] and got[1][0][1] == got[2][0][1] == got[2][0][2]


def staying(rows):
    """Rows (doc_id, text) that near-deduplication leaves, by comparing all pairs; texts of equal words count as one."""
    words = lambda t: tuple(re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split())
    sets = {w: {w[i : i + 5] for i in range(len(w) - 4)} or {w} for w in {words(t) for _, t in rows}}
    parent = {w: w for w in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_size = sorted((w for w in sets if w), key=lambda w: len(sets[w]))
    for i, a in enumerate(by_size):
        for b in by_size[i + 1 :]:
            if len(sets[a]) < 0.8 * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    best = {}
    for d, t in rows:
        k = root(words(t))
        if k not in best or (d is None, d or 0) < (best[k][0] is None, best[k][0] or 0):
            best[k] = (d, t)
    return collections.Counter(best.values())


def test_near_dedup_of_a_family_of_texts_in_between(spark):
    """A large family whose pairs are of every similarity from 0.3 to 0.95, as brute force says."""
    import random

    r = random.Random(11)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(4))
    base, rows = [word() for _ in range(100)], []
    for i in range(250):
        w = list(base)
        for k in r.sample(range(100), r.randint(0, 9)):
            w[k] = word()
        rows.append((i, " ".join(w)))
    left = simhash.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    kept, want = {x.doc_id for x in left}, {d for d, _ in staying(rows)}
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(96)} for d, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert want <= kept and len(kept) < 200
    assert not any(alike(a, b) for a in kept for b in kept if a < b)
    assert all(any(alike(a, b) for b in sets if b != a) for a in set(sets) - kept)


def test_near_dedup_finds_what_fingerprints_link_and_checks_it(spark, monkeypatch):
    """With bands that no two texts share, copies with close fingerprints are found; close fingerprints alone are not enough."""
    import random

    def apart(shingles, bounds):
        return np.random.default_rng().integers(1, 1 << 63, (len(bounds) - 1, 24), np.uint64)

    monkeypatch.setattr(simhash, "band_keys", apart)
    r = random.Random(12)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(4))
    rows, links = [], 0
    for i in range(40):
        w = [word() for _ in range(600)]
        copy = [*w[:-1], word()]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(copy))]
        links += bin(simhash.fingerprint(rows[-1][1].encode()) ^ simhash.fingerprint(rows[-2][1].encode())).count("1") <= simhash.RADIUS
    same = "one two three " * 100
    other = [(500 + i, same + " ".join(word() for _ in range(30))) for i in range(2)]
    assert links > 20 and len({simhash.fingerprint(t.encode()) for _, t in other}) == 1
    left = {x.doc_id for x in simhash.stage(spark, spark.createDataFrame(rows + other, "doc_id long, text string"), "").select("doc_id").collect()}
    assert {2 * i for i in range(40)} | {500, 501} <= left and len(left) == 82 - links


def test_components_of_stars_end_after_one_round_of_few_jobs(spark):
    links = spark.createDataFrame([(c, c + i) for c in range(0, 3000, 10) for i in range(1, 10)], "u long, v long")
    sc = spark.sparkContext
    sc.setJobGroup("stars", "stars")
    try:
        got = {x.node: x.label for x in simhash.components(links, 3000).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: i // 10 * 10 for i in range(3000)}
    assert len(sc.statusTracker().getJobIdsForGroup("stars")) <= 12


def test_components_of_many_nodes_go_by_shuffles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_NODES", 3)
    chain = [5, 2, 9, 1, 7, 4, 8]
    links = spark.createDataFrame([*zip(chain, chain[1:]), (20, 25), (20, 26)], "u long, v long")
    got = {x.node: x.label for x in simhash.components(links, 10).collect()}
    assert got == {**{x: 1 for x in chain}, 20: 20, 25: 20, 26: 20}


def test_near_dedup_keeps_texts_that_share_or_lack_an_id(spark):
    texts = {c: " ".join(f"{c}{i}" for i in range(40)) for c in ("x", "y", "z", "n", "m", "o")}
    rows = [(3, texts["x"]), (5, texts["x"]), (5, texts["y"]), (8, texts["z"]), (None, texts["n"]), (None, texts["m"]), (None, texts["o"]), (8, texts["z"])]
    df = spark.createDataFrame([(*r, "k", "s") for r in rows], "doc_id long, text string, tk string, State string")
    got = simhash.stage(spark, df, "")
    assert got.columns == df.columns
    want = [rows[0], rows[2], rows[3], *rows[4:7]]
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter(want)


def test_pipeline_on_an_empty_table(spark, empty_dir):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_pipeline_on_very_long_and_odd_texts(spark, empty_dir, tmp_path):
    """Texts over 1 MiB, without white space, of digits only; every stage runs and keeps what is clean."""
    import shutil

    import corpus_pipeline

    for name in ("benchmark", "labels", "pages", "embeddings"):
        shutil.copytree(f"{empty_dir}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    texts = ["0" * 5000 + ".1.1.1 is an address", "x" * (2 << 20), "word and number " * 100_000, ",".join(f"a{i}@x.example.com" for i in range(30_000)), None, "", "日本語" * 300_000]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert {0, 1, 2, 3, 6} <= left


def test_pipeline(spark, where):
    import corpus_pipeline
    from loomline import cluster

    docs = cluster.table(spark, where, "documents")
    columns = docs.columns
    left = None
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = cluster.materialize(stage(spark, before, where), name)
        if name != "packing":
            assert docs.columns == columns
        if name == "near_dedup":
            stays = staying([(r.doc_id, r.text) for r in before.collect()])
            assert collections.Counter((r.doc_id, r.text) for r in docs.collect()) == stays
            left = [r.doc_id for r in docs.select("doc_id").collect()]
        if name == "privacy":
            assert docs.count() == before.count()
            assert not any(privacy.Finder().spans(r.text or "") for r in docs.select("text").collect())
    assert {r.doc_id for r in docs.collect()} <= set(left)


def test_ledger_is_idempotent_and_additive(spark, tmp_path):
    from pyspark.sql import functions as F

    from loomline.llm import rollup

    ledger = rollup.Ledger(spark, "file://" + str(tmp_path))
    kind = "struct<source:string,lang:string,tokenizer:string,n_tokens:bigint>"
    rows = lambda *x: spark.createDataFrame(x, f"before {kind}, after {kind}")
    load = rows((None, ("a", "en", "v1", 10)), (None, ("a", "en", "v1", 5)), (None, ("b", None, "v1", None)))
    assert ledger.commit("1", load) and not ledger.commit("1", load)
    assert ledger.commit("2", rows((("a", "en", "v1", 10), ("a", "en", "v2", 12)), (("b", None, "v1", 0), None)))
    load.select(F.lit(1)).coalesce(1).write.parquet(f"file://{tmp_path}/deltas/stray=1")  # a writer that died before its commit
    assert not ledger.commit("2", load)
    totals = lambda: sorted(map(tuple, rollup.Ledger(spark, "file://" + str(tmp_path)).totals().collect()))
    want = [("a", "en", "v1", 1, 5), ("a", "en", "v2", 1, 12)]
    assert totals() == want
    assert ledger.compact() == 2 and totals() == want
    assert not ledger.commit("1", load) and totals() == want
    # a base that was not marked, and a second writer whose mark came later, change nothing
    load.select(F.lit(1)).coalesce(1).write.parquet(f"file://{tmp_path}/folded/000000009-x/sums")
    ledger._mark("commits", "2=later")
    assert totals() == want and not ledger.commit("2", load)
    assert ledger.commit("3", rows((None, ("a", "en", "v2", 3)))) and totals() == [want[0], ("a", "en", "v2", 2, 15)]
    assert ledger.compact() == 3 and totals() == [want[0], ("a", "en", "v2", 2, 15)]


def test_op7_blocks_bad_hosts_and_spares_the_rest(spark, tmp_path):
    """Planted hosts: a bad one, a bad domain with an unlabelled host, a good one, few bad labels; equal to the SQL twin."""
    import random

    import duckdb
    import harness

    from loomline.llm import hostrep

    r, pages, labels = random.Random(5), [], []

    def put(host, n, good, marked=True):
        for _ in range(n):
            i = len(pages)
            pages.append((i, f"https://{host}/en/2{i}", "x"))
            if marked:
                labels.append((i, int(r.random() < good), 0))

    for k in range(40):
        put(f"site{k}.fine{k % 8}.net", 20, 0.9)
    put("spam.lone.net", 40, 0.05)
    for k in range(5):
        put(f"h{k}.junkfarm.net", 30, 0.03)
    put("new.junkfarm.net", 3, 0, marked=False)
    put("once.fine1.net", 1, 0.0)
    put("fresh.other.net", 2, 0, marked=False)
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = registry.QUERIES["op7_host_reputation"](spark, str(tmp_path))
    verdicts = {x.host: x.verdict for x in got.collect()}
    bad = {"spam.lone.net", "new.junkfarm.net", *(f"h{k}.junkfarm.net" for k in range(5))}
    assert {h for h, v in verdicts.items() if v == "block"} == bad
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert harness.compare(got, con, hostrep.SQL) == ""


def test_op6_places_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(s, s % 5 + 1) for s in range(1, 101)], "bytes long, n long")
    rows = lambda d: sorted((r.bytes, [tuple(x) for x in r.runs]) for r in d[0].collect())
    whole = rows(sharding.places(df, 7))
    monkeypatch.setattr(sharding, "BLOCK", 9)
    monkeypatch.setattr(sharding, "BROADCAST_RUNS", 1)
    assert rows(sharding.places(df, 7)) == whole and len(whole) == 100


def test_near_dedup_removes_near_copies(spark):
    """Planted copies with 1, 3 and 5 of 300 words changed, a large group of them, and boilerplate that is no copy."""
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(4))
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    jaccard = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))

    def changed(text, n):
        w = text.split()
        for i in r.sample(range(5, 295), n):
            w[i] = word()
        return " ".join(w)

    prose = lambda n: " ".join(word() for _ in range(n))
    rows, copies, i = [], set(), 0
    for n in (1, 3, 5) * 20:
        text = prose(300)
        copy = changed(text, n)
        rows += [(i, text), (i + 1, copy)]
        copies |= {i + 1} if jaccard(text, copy) >= 0.8 else set()
        i += 2
    text, shared = prose(300), prose(150)
    group = [(1000 + k, changed(text, 2) if k else text) for k in range(60)]
    boiler = [(2000 + k, f"{prose(75)} {shared} {prose(75)}") for k in range(60)]
    df = spark.createDataFrame(rows + group + boiler + [(3000, ""), (3001, None), (3002, "two words"), (3003, "Two  words")], "doc_id long, text string")
    left = {x.doc_id for x in simhash.stage(spark, df, "").select("doc_id").collect()}
    want = {d for d, _ in rows + boiler} - copies | {1000, 3000, 3002}
    assert len(copies) > 50 and left == want


def test_op5_terms_far_from_the_entity_and_beyond_latin1(spark):
    """A flagged name goes wherever it stands in a text with its address, also if no place in that text is near; names that
    are always capitalised beyond Latin-1 or in typographic quotes are flagged."""
    import random

    r = random.Random(7)
    word = lambda: "".join(r.choice("bcdfg") + r.choice("aeiou") for _ in range(3))
    prose = lambda n: " ".join(word() for _ in range(n))
    names = ["Quagmire", "Łukasz", "Анна", "“Marlowe”"]
    rows = [(i, prose(30)) for i in range(2000)]
    for k, name in enumerate(names):
        rows += [(5000 + 100 * k + i, f"{prose(3)} {name} wrote from box{k}@host.example.com about {prose(40)} {name} {prose(2)}") for i in range(12)]
        rows.append((5050 + 100 * k, f"box{k}@host.example.com {prose(60)} {name}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {x.doc_id: x.text for x in privacy.stage(spark, df, "").select("doc_id", "text").collect()}
    assert not [d for d, t in clean.items() if any(n.strip("“”") in t for n in names)]
    assert all(clean[d] == t for d, t in rows if d < 5000)


def test_op7_tenants_of_a_listed_suffix_do_not_share_a_reputation(spark):
    """One bad tenant of a hosting domain pulls the others down only while that domain is not listed as a suffix."""
    from loomline.llm import hostrep

    bad, good = "bad.hosting.example", "good.hosting.example"
    pages = [(i, f"https://{bad}/{i}", "") for i in range(400)] + [(1000 + i, f"https://{good}/{i}", "") for i in range(3)] + [(2000 + i, f"https://site{i}.net/", "") for i in range(400)]
    labels = [(i, 0, 1) for i in range(400)] + [(2000 + i, 1, 0) for i in range(400)]
    p, m = spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    upper = lambda **k: {x.host: x.upper for x in hostrep.judge(p, m, **k).where(f"host in ('{bad}', '{good}')").distinct().collect()}
    shared, apart = upper(), upper(two_label=["hosting.example"])
    assert shared[bad] < hostrep.LEAST and apart[bad] < hostrep.LEAST and apart[good] > shared[good]
