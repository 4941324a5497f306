"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to three bytes. A byte's code length is that of method C: in the longest
context that was seen, count / (total + distinct), or else an escape, distinct / (total + distinct), and the next shorter
context, down to a uniform order -1. The statistics are frozen after training, so a text's code length is a sum of table
entries: the language with the shortest code is predicted. Symbols excluded by longer contexts are not discounted.

Training reads whole texts of at most `train_bytes` bytes a language (plus one text), chosen by a hash of the row.
Bytes are folded to lower case (ASCII and Latin-1) and to the 63 most frequent values and one for the rest.

Defined cases: null text and text without a letter are `und` with score 0; without any learned language every row is
`und`; of languages with equally short codes the first by name is chosen; a null doc_id is neither held out nor learned from;
repeated rows get equal results; texts of any length are read whole; an empty table gives an empty result; other columns are
not read by the query and kept by the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline import cluster
from loomline.llm import _scan

cluster.ship_by_value(__name__)

SYMBOLS = 64
#: Largest number of bytes a language that are learned from.
TRAIN_BYTES = 1 << 20
UNKNOWN = "und"


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_texts(docs: DataFrame, train_bytes: int) -> dict[str, list[bytes]]:
    """Whole texts by language, at most train_bytes and one text a language."""
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", "text", F.octet_length("text").cast("long").alias("bytes"), F.xxhash64("doc_id", F.octet_length("text")).alias("h"))
    totals = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.sum("bytes")).collect()}
    if not totals:
        return {}
    share = F.create_map(*[x for k, v in totals.items() for x in (F.lit(k), F.lit(min(1.0, 2 * train_bytes / max(v, 1))))])
    chosen = rows.where(F.pmod("h", F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    order = Window.partitionBy("lang").orderBy("h", "text")
    chosen = chosen.withColumn("upto", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(order))
    out: dict[str, list[bytes]] = {}
    for lang, text in chosen.where((F.col("upto") <= train_bytes) | (F.col("nth") == 1)).select("lang", "text").toLocalIterator():
        out.setdefault(lang, []).append(text.encode())
    return out


def train(texts: dict[str, list[bytes]]) -> dict:
    """Frozen code lengths in bits. rows: by sorted code of (three context symbols, symbol) that any language has seen;
    esc, low: by context for all other codes."""
    import numpy as np

    langs = sorted(texts)
    bufs = {k: _scan.lower(np.frombuffer(b"\n\n\n" + b"\n\n\n".join(texts[k]), np.uint8)) for k in langs}
    hist = sum(np.bincount(b, minlength=256) / max(len(b), 1) for b in bufs.values())
    top = [b for b in np.argsort(-hist, kind="stable")[: SYMBOLS - 1] if hist[b] > 0]
    fold = np.full(256, SYMBOLS - 1, np.int64)
    fold[top] = np.arange(len(top))
    a, n_langs = SYMBOLS, len(langs)
    low, esc, seen = np.zeros((a**3, n_langs), np.float32), np.zeros((a**3, n_langs), np.float32), []
    for j, lang in enumerate(langs):
        x = fold[bufs[lang]]
        below = np.full((1, a), np.log2(a))
        for order in range(3):
            code = np.zeros(max(len(x) - order, 0), np.int64)
            for i in range(order + 1):
                code = code * a + x[i : len(x) - order + i]
            counts = np.bincount(code, minlength=a ** (order + 1)).reshape(-1, a)
            total, distinct = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
            under = np.tile(below, (a if order else 1, 1))[: counts.shape[0]]
            with np.errstate(divide="ignore", invalid="ignore"):
                bits = np.where(counts > 0, np.log2((total + distinct) / counts), np.where(total > 0, np.log2((total + distinct) / distinct), 0) + under)
            below = bits
        low[:, j] = below.ravel()
        code = np.zeros(max(len(x) - 3, 0), np.int64)
        for i in range(4):
            code = code * a + x[i : len(x) - 3 + i]
        keys, counts = np.unique(code, return_counts=True)
        total = np.bincount(keys // a, weights=counts, minlength=a**3)
        distinct = np.bincount(keys // a, minlength=a**3)
        with np.errstate(divide="ignore", invalid="ignore"):
            esc[:, j] = np.where(total > 0, np.log2((total + distinct) / np.maximum(distinct, 1)), 0)
        seen.append((keys, np.log2((total + distinct)[keys // a] / counts)))
    codes = np.unique(np.concatenate([k for k, _ in seen])) if seen else np.zeros(0, np.int64)
    rows = (esc[codes // a] + low[codes % a**3]).astype(np.float32)
    for j, (keys, bits) in enumerate(seen):
        rows[np.searchsorted(codes, keys), j] = bits
    return {"langs": langs, "fold": fold.astype(np.uint8), "codes": codes.astype(np.int32), "rows": rows, "esc": esc, "low": low}


class Scorer:
    def __init__(self, model: dict):
        import numpy as np

        self.m = model
        # two levels, as most contexts of three symbols never occur: a number of the context, then a row for each symbol
        seen, number = np.unique(model["codes"] // SYMBOLS, return_inverse=True)
        self.context = np.zeros(SYMBOLS**3, np.int32)
        self.context[seen] = np.arange(1, len(seen) + 1, dtype=np.int32)
        self.slot = np.full((len(seen) + 1) * SYMBOLS, -1, np.int32)
        self.slot[(number + 1) * SYMBOLS + model["codes"] % SYMBOLS] = np.arange(len(model["codes"]), dtype=np.int32)

    def bits(self, raws: list[bytes]):
        """Code length of each text under each language."""
        import numpy as np

        m, a = self.m, SYMBOLS
        out = np.zeros((len(raws), len(m["langs"])))
        for at in _scan.groups(raws, 1 << 18):
            if sum(len(raws[i]) for i in at) > 1 << 20:  # one very long text, in overlapping pieces
                raw = raws[at[0]]
                for s in range(0, len(raw), 1 << 19):
                    lead = raw[max(0, s - 3) : s].rjust(3, b"\n")
                    out[at[0]] += self._sum(lead + raw[s : s + (1 << 19)], np.array([3]))[0]
                continue
            full = [i for i in at if raws[i]]
            if full:
                lens = np.array([len(raws[i]) + 3 for i in full])
                starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
                out[full] = self._sum(b"".join(b"\n\n\n" + raws[i] for i in full), starts + 3)
        return out

    def _sum(self, raw: bytes, starts):
        """Sums over [start, next start - 3), each after three context bytes."""
        import numpy as np

        m, a = self.m, SYMBOLS
        x = m["fold"][_scan.lower(np.frombuffer(raw, np.uint8))].astype(np.int32)
        before = (x[:-3] * a + x[1:-2]) * a + x[2:-1]
        code, slot = before * a + x[3:], self.slot[self.context[before] * a + x[3:]]
        cost = m["rows"][np.maximum(slot, 0)] if len(m["rows"]) else np.zeros((len(code), len(m["langs"])), np.float32)
        miss = np.flatnonzero(slot < 0)
        cost[miss] = m["esc"][code[miss] // a] + m["low"][code[miss] % a**3]
        own = np.ones(len(code), bool)  # code i stands for byte i + 3
        for k in (1, 2, 3):
            own[starts[1:] - 3 - k] = False
        cost[~own] = 0
        return np.add.reduceat(cost, starts - 3, axis=0, dtype=np.float64)


def has_letter(raw: bytes) -> bool:
    import re

    return bool(re.search(rb"[A-Za-z]", raw)) or any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def predictions(raws: list[bytes | None], scorer: Scorer | None) -> tuple[list[str], list[float]]:
    import numpy as np

    names, scores = [UNKNOWN] * len(raws), [0.0] * len(raws)
    full = [i for i, r in enumerate(raws) if r and has_letter(r)] if scorer else []
    if full:
        bits = scorer.bits([raws[i] for i in full])
        best = bits.argmin(1)
        chance = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
        for i, b, c in zip(full, best.tolist(), chance.tolist()):
            names[i], scores[i] = scorer.m["langs"][b], c
    return names, scores


def _model(docs: DataFrame, train_bytes: int):
    texts = training_texts(docs, train_bytes)
    return docs.sparkSession.sparkContext.broadcast(train(texts) if texts else None)


def identify(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the posterior of the predicted language) of each row."""
    model = _model(docs, train_bytes)

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(model.value) if model.value else None
        for b in _scan.slices(batches):
            names, scores = predictions(b.column(2).cast(pa.binary()).to_pylist(), scorer)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return _scan.over(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir):
    return identify(cluster.table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in no language that was learned (`und`) go. One scan; all columns stay as they are."""
    model = _model(docs, TRAIN_BYTES)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(model.value) if model.value else None
        for b in _scan.slices(batches):
            names, _ = predictions(b.column(at).cast(pa.binary()).to_pylist(), scorer)
            yield b.filter(pa.array([n != UNKNOWN for n in names], pa.bool_()))

    return _scan.over(docs, run, docs.schema)
