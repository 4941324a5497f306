"""Masked pseudo-likelihood scoring with a bidirectional window network and a memory of the corpus.

Tokens are the bytes of the text (ASCII and Latin-1 letters folded to lower case), of which the 46 most frequent in the
corpus have ids of their own; the others share one id and are told apart by their own frequencies, so a rare byte costs what
its class and its share of the class cost. A network trained in numpy predicts each token from two tokens on its left and
two on its right: embeddings by position, a tanh layer, a softmax.

The network is of fixed size; what grows with the corpus is the memory. Each word with a word on both sides is a cell of it,
and the corpus gives how often each window (the two words on each side) and each word in it occur. A cell's word is predicted as a whole by the counts without its own occurrence, with the network as the prior of
weight PRIOR: (n(word, window) - 1 + PRIOR p) / (n(window) - 1 + PRIOR). A window that occurs once leaves the network's
probability as it is; a text that the corpus holds twice is recalled. A document's score is the sum of the conditional
log-probabilities of all its tokens, each given both sides.

Training sees the whole corpus: every (context, token) pair is counted over all documents, and the counts, grouped by
context, are dealt to a fixed number of shards. In each round every shard runs minibatch Adam over all its contexts,
starting from the same weights, and the driver averages the weights by token mass. Shards and weights have a fixed size;
the counts stay in the shared folder. A context occurs once however often the corpus repeats it, so a round costs no more
than the number of different contexts. Cells are dealt to buckets by the hash of their window, as many as the number of all
cells asks for, and counted there, each shuffled once, many in a row; so none of the memory is in one place. A window that
holds a share HOT_SHARE of all cells is counted in two levels instead. The windows come in PASSES parts by their hash, a pass
over the texts each, and a part's shuffle files go before the next part is dealt: all cells are counted, but never lie on disk
at once.

Defined cases: null and empty texts have 0 tokens, score 0 and a null mean; repeated rows get equal scores (and are each
other's memory); texts without cells have a null recall; texts over 1 MiB are scored in pieces that end at white space, which
do not see each other; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline import cluster
from loomline.llm import _scan

cluster.ship_by_value(__name__)

#: Token ids: 0 beyond the text, 1 for rare bytes, 2 and up for the most frequent ones.
TOKENS = 48
HIDDEN = 40
SHARDS = 12
ROUNDS = 4
EPOCHS = 3
BATCH = 2048
#: One word window in so many is a memory cell: all of them; weight of the network in a cell.
MEMORY_SHARE, PRIOR = 1, 1.0
#: Passes over the texts, each with the cells of one part of the windows.
PASSES = 2
#: Cells in a bucket, about; cells that a task deals at once.
BUCKET, DEALT_AT_ONCE = 1 << 19, 1 << 20
#: A window with this share of the cells is counted in two levels; windows that are counted at once when a task looks for such.
HOT_SHARE, COUNTED = cluster.HOT_SHARE, 1 << 20
PIECE = 1 << 20


def _histograms(batches):
    import numpy as np
    import pyarrow as pa

    hist = np.zeros(256, np.int64)
    for b in _scan.slices(batches):
        for raw in b.column(0).cast(pa.binary()).to_pylist():
            if raw:
                hist += np.bincount(_scan.lower(np.frombuffer(raw, np.uint8)), minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(hist)], names=["byte", "n"])


def alphabet(docs: DataFrame) -> tuple[list[int], list[float]]:
    """Token id of each byte value, and the log-probability of the byte given its id, from the byte counts of all documents."""
    import math

    n = dict.fromkeys(range(256), 0)
    n |= {r[0]: r[1] for r in _scan.over(docs.select("text"), _histograms, "byte int, n long").groupBy("byte").agg(F.sum("n")).collect()}
    top = sorted((b for b in n if n[b]), key=lambda b: (-n[b], b))[: TOKENS - 2]
    ids, within = [1] * 256, [0.0] * 256
    for i, b in enumerate(top):
        ids[b] = i + 2
    rare = [b for b in range(256) if ids[b] == 1]
    mass = sum(n[b] + 1 for b in rare)
    for b in rare:
        within[b] = math.log((n[b] + 1) / mass)
    return ids, within


def _pieces(raws: list[bytes]) -> list[tuple[int, bytes]]:
    """(number of the text, piece): texts over PIECE bytes in pieces that end before white space."""
    out = []
    for i, raw in enumerate(raws):
        at = 0
        while at < len(raw):
            end = at + PIECE
            while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
                end += 1
            out.append((i, raw[at:end]))
            at = end
    return out


def _tokens(raws, ids):
    """Token ids and lower-case bytes of the texts with two zeros before, between and after; the first position of each, its
    length, and which positions are of a text."""
    import numpy as np

    lens = np.array([len(r) for r in raws])
    starts = 2 + np.concatenate([[0], np.cumsum(lens + 2)[:-1]])
    raw = _scan.lower(np.frombuffer(b"\0\0" + b"".join(r + b"\0\0" for r in raws), np.uint8))
    x = ids[raw]
    real = np.ones(len(x), bool)
    for out in (np.arange(2), starts + lens, starts + lens + 1):
        x[out], real[out] = 0, False
    return x, raw, starts, lens, real


def _codes(x):
    """Context (two left, two right) of positions 2 to the last but two."""
    a = TOKENS
    return ((x[:-4] * a + x[1:-3]) * a + x[3:-1]) * a + x[4:]


def _count_batches(ids):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        own, lut = [], np.array(ids, np.int32)

        def merged(parts):
            keys = np.concatenate([k for k, _ in parts])
            keys, inv = np.unique(keys, return_inverse=True)
            return keys, np.bincount(inv, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

        for b in _scan.slices(batches):
            raws = [r for _, r in _pieces([r or b"" for r in b.column(0).cast(pa.binary()).to_pylist()])]
            for at in _scan.groups(raws, 1 << 20):
                x, *_, real = _tokens([raws[i] for i in at], lut)
                code = (_codes(x) * TOKENS + x[2:-2])[real[2:-2]]
                own.append(np.unique(code, return_counts=True))
                if len(own) >= 8:
                    own = [merged(own)]
        if own:
            keys, n = merged(own)
            for s in range(0, len(keys), 1 << 18):
                k = keys[s : s + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array((k // TOKENS).astype(np.int32)), pa.array((k % TOKENS).astype(np.int8)), pa.array(n[s : s + (1 << 18)])], names=["ctx", "tok", "n"])

    return run


def context_counts(docs: DataFrame, ids: list[int]) -> DataFrame:
    """ctx and, for each token seen in it, how often over all documents; a context has at most TOKENS entries."""
    pairs = _scan.over(docs.select("text"), _count_batches(ids), "ctx int, tok byte, n long").groupBy("ctx", "tok").agg(F.sum("n").alias("n"))
    return pairs.groupBy("ctx").agg(F.collect_list("tok").alias("toks"), F.collect_list("n").alias("ns"))


def start_weights(seed: int = 1):
    import numpy as np

    r = np.random.default_rng(seed)
    return [r.normal(0, 0.3, (4, TOKENS, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), r.normal(0, 0.1, (HIDDEN, TOKENS)).astype(np.float32), np.zeros(TOKENS, np.float32)]


def _split(ctx):
    import numpy as np

    a = TOKENS
    return np.stack([ctx // a**3, ctx // a**2 % a, ctx // a % a, ctx % a])


def log_probs(weights, ctx):
    """Log-probability of each token in each context."""
    import numpy as np

    e, b, w, c = weights
    i = _split(ctx)
    z = np.tanh(e[0][i[0]] + e[1][i[1]] + e[2][i[2]] + e[3][i[3]] + b) @ w + c
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def train_shard(weights, ctx, counts, epochs: int, rate: float, seed: int):
    """Minibatch Adam on the cross-entropy of dense counts (contexts x tokens). Returns new weights."""
    import numpy as np

    r, weights = np.random.default_rng(seed), [w.copy() for w in weights]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = r.permutation(len(ctx))
        for s in range(0, len(ctx), BATCH):
            at = order[s : s + BATCH]
            i, n = _split(ctx[at]), counts[at].astype(np.float32)
            e, b, w, c = weights
            h = np.tanh(e[0][i[0]] + e[1][i[1]] + e[2][i[2]] + e[3][i[3]] + b)
            z = h @ w + c
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            dz = (p * n.sum(1, keepdims=True) - n) / n.sum()
            dh = (dz @ w.T) * (1 - h * h)
            de = np.zeros_like(e)
            for k in range(4):
                one = np.zeros((TOKENS, len(at)), np.float32)
                one[i[k], np.arange(len(at))] = 1
                de[k] = one @ dh
            step += 1
            for j, g in enumerate((de, dh.sum(0), h.T @ dz, dz.sum(0))):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.99 * v[j] + 0.01 * g * g
                weights[j] -= rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8)
    return weights


def _dense(batches):
    """Contexts and dense counts of a shard; None if it is empty."""
    import numpy as np

    ctx, rows = [], []
    for b in batches:
        c, toks, ns = b.column(0).to_numpy(), b.column(1), b.column(2)
        part = np.zeros((len(c), TOKENS), np.float32)
        part[np.repeat(np.arange(len(c)), np.diff(toks.offsets.to_numpy())), toks.flatten().to_numpy()] = ns.flatten().to_numpy()
        ctx.append(c)
        rows.append(part)
    return (np.concatenate(ctx).astype(np.int64), np.concatenate(rows)) if ctx and sum(map(len, ctx)) else None


def fit(counts: DataFrame, rounds: int = ROUNDS, epochs: int = EPOCHS):
    """Weights after `rounds` rounds of training on all shards of counts, averaged by token mass."""
    import numpy as np

    spark, weights = counts.sparkSession, start_weights()
    for k in range(rounds):
        now = spark.sparkContext.broadcast(weights)

        def run(batches, k=k, now=now):
            import numpy as np
            import pyarrow as pa

            if (data := _dense(batches)) is not None:
                ctx, n = data
                order = np.argsort(ctx)
                new = train_shard(now.value, ctx[order], n[order], epochs, 0.02 / (1 + k), k)
                flat = np.concatenate([w.ravel() for w in new])
                yield pa.RecordBatch.from_arrays([pa.array([float(n.sum(dtype=np.float64))]), pa.array([flat.tolist()], pa.list_(pa.float32()))], names=["mass", "weights"])

        # one row a shard: at most SHARDS rows of a fixed size reach the driver
        got = _scan.over(counts, run, "mass double, weights array<float>").collect()
        if not got:
            return weights
        mean = np.average(np.array([r.weights for r in got], np.float64), axis=0, weights=[r.mass for r in got]).astype(np.float32)
        at, new = 0, []
        for w in weights:
            new.append(mean[at : at + w.size].reshape(w.shape))
            at += w.size
        weights = new
    return weights


class Scorer:
    """Log-probabilities by table: a context's row is computed by the network when it first occurs."""

    LIMIT = 1 << 19

    def __init__(self, ids, within, weights):
        import numpy as np

        self.ids, self.within, self.weights = np.array(ids, np.int32), np.array(within, np.float32), weights
        self.hasher, self.cls = _scan.Hasher(), _scan.byte_classes()
        self.clear()

    def clear(self):
        import numpy as np

        self.slot, self.rows, self.used = np.full(TOKENS**4, -1, np.int32), np.zeros((1 << 14, TOKENS), np.float32), 0

    def _learn(self, missing):
        import numpy as np

        if self.used + len(missing) > self.LIMIT:
            self.clear()
        while self.used + len(missing) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for s in range(0, len(missing), 1 << 15):
            part = missing[s : s + (1 << 15)]
            self.rows[self.used : self.used + len(part)] = log_probs(self.weights, part.astype(np.int64))
            self.slot[part] = np.arange(self.used, self.used + len(part), dtype=np.int32)
            self.used += len(part)

    def score(self, raws: list[bytes], part: int = 0, parts: int = 1):
        """Summed log-probabilities by the network of all tokens of each text; memory cells in order: number of the text,
        hash of the window, hash of window and word, log-probability of the word. With parts, the cells of a part of the
        windows; the network then looks at all tokens for part 0, for the others only at the tokens of their cells."""
        import numpy as np

        out, cells = np.zeros(len(raws)), [[] for _ in range(4)]
        pieces = _pieces(raws)
        for at in _scan.groups([p for _, p in pieces], 1 << 20):
            own = [pieces[i][1] for i in at]
            number = np.array([pieces[i][0] for i in at])
            x, raw, starts, lens, real = _tokens(own, self.ids)
            ws, we, win, word = self.memory(raw, real, starts)
            looked = real[2:-2]
            if parts > 1:
                mine = (win >> np.uint64(20)) % np.uint64(parts) == part
                ws, we, win, word = ws[mine], we[mine], win[mine], word[mine]
            if part:
                looked = np.zeros(len(looked) + 1, np.int8)
                looked[ws - 2] = 1
                looked[we - 2] -= 1
                looked = np.cumsum(looked[:-1], dtype=np.int8) > 0
            ctx, tok = _codes(x), x[2:-2]
            got = np.zeros(len(ctx), np.float32)
            for s in range(0, len(ctx), 1 << 20):
                at = s + np.flatnonzero(looked[s : s + (1 << 20)])
                now = ctx[at]
                slot = self.slot[now]
                if (slot < 0).any():
                    self._learn(np.unique(now[slot < 0]))
                    slot = self.slot[now]
                    if (slot < 0).any():
                        self._learn(np.unique(now))  # the table was cleared
                        slot = self.slot[now]
                got[at] = self.rows.ravel()[slot * np.int32(TOKENS) + tok[at]] + self.within[raw[2:-2][at]]
            out += np.bincount(number, np.add.reduceat(got, starts - 2, dtype=np.float64), len(raws))
            if len(ws):
                edges = np.stack([ws - 2, we - 2], axis=1).ravel()
                sums = np.add.reduceat(np.append(got, 0), edges, dtype=np.float64)[::2]
                for c, v in zip(cells, (number[np.searchsorted(starts, ws, "right") - 1], win, word, sums)):
                    c.append(v)
        kinds = (np.int64, np.uint64, np.uint64, np.float64)
        return out, [np.concatenate([np.zeros(0, k), *c]).astype(k) for c, k in zip(cells, kinds)]

    def memory(self, raw, real, starts):
        """Bounds of the words that are cells, hash of the window, hash of window and word. Pieces begin at starts."""
        import numpy as np

        inside = (self.cls[raw] != _scan.SPACE) & real
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # no word at either end
        ws, we = edges[::2], edges[1::2]
        if len(ws) < 3:
            return ws[:0], we[:0], np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        h, piece = self.hasher.spans(raw, ws, we), np.searchsorted(starts, ws, "right")
        window = np.zeros(len(ws), np.uint64)
        with np.errstate(over="ignore"):
            for k in (-2, -1, 1, 2):
                near = np.zeros(len(ws), np.uint64)
                to, at = (slice(-k, None), slice(None, k)) if k < 0 else (slice(None, -k), slice(k, None))
                near[to] = np.where(piece[at] == piece[to], h[at], 0)
                window = window * np.uint64(_scan.BASE) + near
            window = _scan.mix(window)
            sel = np.zeros(len(ws), bool)
            sel[1:-1] = (piece[1:-1] == piece[:-2]) & (piece[1:-1] == piece[2:])  # with a word on each side
            if MEMORY_SHARE > 1:
                sel &= (window >> np.uint64(20)) % np.uint64(MEMORY_SHARE) == 0
            return ws[sel], we[sel], window[sel], _scan.mix(window[sel] + h[sel] * np.uint64(0xD1342543DE82EF95))


def model_of(docs: DataFrame):
    ids, within = alphabet(docs)
    counts = cluster.materialize(context_counts(docs, ids).repartition(SHARDS, "ctx"), "contexts")
    return ids, within, fit(counts)


SCORED = "rid long, doc_id long, n_tokens long, net double, n_cells long, windows array<long>, words array<long>, lps array<float>"


def _scored_batches(model, make, part: int = 0, parts: int = 1):
    """From batches of (doc_id, text) to make(rid, doc_id, lengths, net, number of the text, window, word, lp) by batch."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        scorer, rid = Scorer(*model.value), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for b in _scan.slices(batches):
            raws = [r or b"" for r in b.column(1).cast(pa.binary()).to_pylist()]
            net, (number, win, word, lp) = scorer.score(raws, part, parts)
            first = rid + np.arange(len(raws), dtype=np.int64)
            rid += len(raws)
            yield make(first, b.column(0), np.array([len(r) for r in raws], np.int64), net, number, win.view(np.int64), word.view(np.int64), lp.astype(np.float32))

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def by_network(docs: DataFrame, model=None, only=None) -> DataFrame:
    """SCORED: the network's score and the memory cells of each row, or those of the windows `only`; rid is a number of the row."""
    model = model or docs.sparkSession.sparkContext.broadcast(model_of(docs))

    def make(rid, ids, lens, net, number, win, word, lp):
        import numpy as np
        import pyarrow as pa

        if only is not None:
            number, win, word, lp = (x[at] for at in (np.isin(win, only),) for x in (number, win, word, lp))
        upto = np.searchsorted(number, np.arange(len(rid) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(upto), pa.array(v)) for v in (win, word, lp)]
        return pa.RecordBatch.from_arrays([pa.array(rid), ids, pa.array(lens), pa.array(net), pa.array(np.diff(upto).astype(np.int64)), *lists], names=["rid", "doc_id", "n_tokens", "net", "n_cells", "windows", "words", "lps"])

    return _scan.over(_rows(docs), _scored_batches(model, make), SCORED)


OWN = "doc_id long, n_tokens long, net double, n_cells long"
DEALT = f"bucket int, first long, row array<int>, w array<long>, k array<int>, lp array<float>, own array<struct<rid long, {OWN}>>"


def _dealt_batches(model, without, buckets: int, part: int, parts: int):
    def dealt(held):
        import numpy as np
        import pyarrow as pa

        rid, lens, net, win, word, lp = (np.concatenate([h[i] for h in held]) for i in (0, 2, 3, 5, 6, 7))
        ids, row = pa.concat_arrays([h[1] for h in held]), np.concatenate([h[0][h[4]] for h in held]) - rid[0]
        n = np.bincount(row, minlength=len(rid)).astype(np.int64)
        if len(without):
            row, win, word, lp = (x[at] for at in (~np.isin(win, without),) for x in (row, win, word, lp))
        bucket = ((win.view(np.uint64) >> np.uint64(24)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        order, upto = np.argsort(bucket, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
        met = np.flatnonzero(np.diff(upto))
        some = np.flatnonzero(n) if part else np.arange(len(rid))
        own = pa.StructArray.from_arrays([pa.array(rid[some]), ids.take(pa.array(some)), pa.array(lens[some]), pa.array(net[some]), pa.array(n[some])], names=["rid", "doc_id", "n_tokens", "net", "n_cells"])
        # a row for each bucket with cells, and one for the rows of docs
        at = pa.array(np.append(upto[met], [len(order)] * 2).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(x[order])) for x in (row.astype(np.int32), win, (word >> 32).astype(np.int32), lp)]
        of_own = pa.ListArray.from_arrays(pa.array(np.append(np.zeros(len(met) + 1), len(some)).astype(np.int32)), own)
        to = np.append(met, _scan.mix(rid[:1].view(np.uint64) + np.uint64(_scan.BASE)) % np.uint64(buckets)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.full(len(to), rid[0])), *lists, of_own], names=["bucket", "first", "row", "w", "k", "lp", "own"])

    def run(batches):
        held, size = [], 0
        for got in _scored_batches(model, lambda *of_batch: of_batch, part, parts)(batches):
            held.append(got)
            size += len(got[0]) + len(got[4])
            if size >= DEALT_AT_ONCE:
                yield dealt(held)
                held, size = [], 0
        if held:
            yield dealt(held)

    return run


def dealt_cells(docs: DataFrame, model, without, buckets: int, part: int = 0, parts: int = 1) -> DataFrame:
    """DEALT: the cells of a part of the windows, but those of the windows `without`, many of a bucket in a row: number of the
    row of docs less `first`, window, word (32 bits, apart within a window), log-probability by the network. With part 0, `own`
    has each row of docs, so that a pass gives both; with the others those with cells of the part. n_cells counts them."""
    return _scan.over(_rows(docs), _dealt_batches(model, without, buckets, part, parts), DEALT)


def cells_of_rows(docs: DataFrame, model, without, part: int = 0, parts: int = 1) -> DataFrame:
    """What dealt_cells gives, a row for each cell, and in `own` for each row of docs."""
    dealt = dealt_cells(docs, model, without, 1, part, parts)
    cells = dealt.select("first", F.explode(F.arrays_zip("row", "w", "k", "lp")).alias("x")).select((F.col("first") + F.col("x.row")).alias("rid"), "x.w", "x.k", "x.lp")
    own = dealt.select(F.explode("own").alias("own")).select("own.rid", "own")
    return cells.unionByName(own, allowMissingColumns=True)


MET = f"rid long, lp float, n long, all long, {OWN}"


def _met_cells(bucket):
    """The cells of a bucket whose window occurs twice or more, with the numbers of their word in the window (n) and of the
    window (all); and the rows of docs of the bucket."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    flat = lambda c: pc.list_flatten(bucket.column(c).combine_chunks())
    w, k, lp, row = (flat(c).to_numpy() for c in ("w", "k", "lp", "row"))
    rid = np.repeat(bucket.column("first").to_numpy(), pc.list_value_length(bucket.column("row")).to_numpy()) + row
    order = np.argsort(w)
    same = np.diff(w[order]) == 0
    at = order[np.append(same, False) | np.append(False, same)] if len(w) else order
    at = at[np.lexsort((k[at], w[at]))]

    def counts(*keys):
        new = np.append(True, np.any([x[1:] != x[:-1] for x in keys], axis=0))[: len(at)]
        return np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] if len(at) else np.zeros(0, np.int64)

    cells = pa.table({"rid": rid[at], "lp": lp[at], "n": counts(w[at], k[at]), "all": counts(w[at])})
    out = pa.concat_tables([cells, pa.Table.from_struct_array(flat("own"))], promote_options="default")
    _scan.release()
    return out


def _frequent_batches(batches):
    """Windows with a share HOT_SHARE of COUNTED cells of a task, or of its last ones; a null window has the number of all."""
    import numpy as np
    import pyarrow as pa

    scorer, held, size = Scorer([1] * 256, [0.0] * 256, None), [], 0

    def found():
        windows, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= max(2, int(size * HOT_SHARE))
        return pa.RecordBatch.from_arrays([pa.array([None, *windows[often].view(np.int64).tolist()], pa.int64()), pa.array([size, *n[often].tolist()], pa.int64())], names=["w", "n"])

    for b in _scan.slices(batches):
        pieces = [p for _, p in _pieces([r or b"" for r in b.column(0).cast(pa.binary()).to_pylist()])]
        for at in _scan.groups(pieces, 1 << 20):
            own = [pieces[i] for i in at]
            _, raw, starts, _, real = _tokens(own, scorer.ids)
            held.append(scorer.memory(raw, real, starts)[2])
            size += len(held[-1])
            if size >= COUNTED:
                yield found()
                held, size = [], 0
    if size:
        yield found()


def frequent_windows(docs: DataFrame):
    """The windows that hold a share HOT_SHARE of all cells, at most 1 / HOT_SHARE: with twice that share none is missed, as a
    window is left out only where it has less than the share. And the number of all cells."""
    import numpy as np

    counts = cluster.materialize(_scan.over(docs.select("text"), _frequent_batches, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "frequent")
    total = (counts.where("w is null").select("n").first() or [0])[0]
    hot = counts.where(F.col("w").isNotNull() & (F.col("n") >= max(2, total * HOT_SHARE))).select("w").collect()
    return np.array(sorted(r.w for r in hot), np.int64), total


def _gain(n, all, lp):
    """What the memory adds to a cell's log-probability."""
    own = F.when(n > 1, F.log(n - 1 + PRIOR * F.exp(lp))).otherwise(F.lit(_log(PRIOR)) + lp)
    return own - F.log(all - 1 + PRIOR) - lp


def recalled(scored: DataFrame) -> DataFrame:
    """rid, gain (what the memory adds to the network's score) and known (cells whose word the rest of the corpus has in the
    same window), for rows with a window that occurs elsewhere."""
    cells = scored.select("rid", F.explode(F.arrays_zip("windows", "words", "lps")).alias("x")).select("rid", F.col("x.windows").alias("w"), F.col("x.words").alias("k"), F.col("x.lps").alias("lp"))
    words = cells.groupBy("w", "k").agg(F.count(F.lit(1)).alias("n"))
    words = cluster.materialize(words, "words")
    windows = words.groupBy("w").agg(F.sum("n").alias("all")).where(F.col("all") > 1)
    repeated = cluster.materialize(words.join(windows, "w").select("k", "n", F.col("n").alias("uses"), "all"), "repeated")
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = cluster.lookup(cells.select("rid", "k", "lp"), repeated, "k", "uses", max(total, 1), F.col("rid")).where("n is not null")
    return met.groupBy("rid").agg(F.sum(_gain(F.col("n"), F.col("all"), F.col("lp"))).alias("gain"), F.sum((F.col("n") > 1).cast("long")).alias("known"))


def _log(x: float) -> float:
    import math

    return math.log(x)


def _by_row(met: DataFrame) -> DataFrame:
    return met.groupBy("rid").agg(*[F.sum(c).alias(c) for c in ("gain", "known", "n_cells")], *[F.max(c).alias(c) for c in ("doc_id", "n_tokens", "net")])


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, pll (summed conditional log-probabilities, natural log), pll_per_token, net_per_token (by the
    network alone) and recall (share of the memory cells that the rest of the corpus has) of each row."""
    model, (hot, total) = docs.sparkSession.sparkContext.broadcast(model_of(docs)), frequent_windows(docs)
    buckets, parts = max(1, -(-total // (PASSES * BUCKET))), []
    for part in range(PASSES):
        met = dealt_cells(docs, model, hot, buckets, part, PASSES).groupBy("bucket").applyInArrow(_met_cells, MET)
        gain, known = F.when(F.col("lp").isNotNull(), _gain(F.col("n"), F.col("all"), F.col("lp"))), F.when(F.col("lp").isNotNull(), (F.col("n") > 1).cast("long"))
        # what a row itself has comes with part 0; its cells are counted in each part
        of_row = [(F.col(c) if not part else F.lit(None).cast(t)).alias(c) for c, t in (("doc_id", "long"), ("n_tokens", "long"), ("net", "double"))]
        met = met.select("rid", gain.alias("gain"), known.alias("known"), "n_cells", *of_row)
        parts.append(cluster.materialize(_by_row(met), "part", free=True))
    own = _by_row(reduce(DataFrame.unionByName, parts))
    if len(hot):  # their cells are counted apart, in two levels
        more = recalled(cluster.materialize(by_network(docs, model, hot), "scored")).select("rid", F.col("gain").alias("hot_gain"), F.col("known").alias("hot_known"))
        both = lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
        own = own.join(more, "rid", "left").withColumns({"gain": both(F.col("gain"), F.col("hot_gain")), "known": both(F.col("known"), F.col("hot_known"))})
    pll = F.col("net") + F.coalesce("gain", F.lit(0.0))
    per = lambda c: F.when(F.col("n_tokens") > 0, c / F.col("n_tokens"))
    recall = F.when(F.col("n_cells") > 0, F.coalesce("known", F.lit(0)) / F.col("n_cells"))
    return own.select("doc_id", "n_tokens", pll.alias("pll"), per(pll).alias("pll_per_token"), per(F.col("net")).alias("net_per_token"), recall.alias("recall"))


def query(spark, sf_dir):
    return score(cluster.table(spark, sf_dir, "documents"))
