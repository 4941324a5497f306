"""Ranked lexical search over document shards.

A shard holds up to SHARD_BYTES of text (or one longer text) and SHARD_DOCS documents. Its index is one row of arrays: the
hashes of its terms in order, where each term's postings begin (compressed sparse rows), and for each posting the document
within the shard and its impact, an integer made of the term's count and the document's length. What an impact needs of the
corpus (N, L) is counted in a scan before; a term's weight needs its document frequency and is applied when a query is asked,
so the index serves any queries. Every term of every document is indexed.

Queries come in blocks of BLOCK bytes. Their terms' document frequencies are summed over the shards' row lengths; then each
shard adds a term's impacts into one dense array of scores, term by term, and its best documents are taken by partition,
with all that tie at the edge put in order by doc_id. A task merges its shards, so it sends at most `k` rows a query, and
these are merged in two levels: no task sees all tasks' rows of a query.

Terms are runs of ASCII letters, digits and all characters beyond ASCII; only A-Z are lower-cased. A term is known by a hash of
64 bits; a term of the corpus with the hash of another term of a query (chance about 1e-6 for a billion terms and 20,000 terms
asked) would count as that term.

Defined cases: a null text, or one without terms, counts in no number and is never found; a null query finds nothing; a
repeated document or query is one of its own (the same doc_id may have several ranks); null doc_ids come last among equals;
texts over PIECE bytes are read whole, in pieces that end between terms; empty tables give an empty result. Only doc_id,
item_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline import cluster
from loomline.llm import _scan

cluster.ship_by_value(__name__)

TOP = 50
SHARD_BYTES, SHARD_DOCS = 8 << 20, 1 << 16
#: Texts longer than this are scanned in pieces.
PIECE = 1 << 20
#: Bytes of queries that are broadcast at a time, and shards in a file of the index.
BLOCK, FILE_SHARDS = 4 << 20, 4
#: Groups of documents by which a query's rows of all tasks are merged first.
SPREAD = 64
INDEX = "docs binary, unnamed binary, terms binary, starts binary, posts binary, impacts binary"
FOUND = "n int, item_id long, doc_id long, score long"


class Terms:
    """Hashes of the terms of many texts, and the text that each belongs to."""

    def __init__(self):
        import numpy as np

        self.hasher, self.is_term, self.low = _scan.Hasher(), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
        self.is_term[48:58] = self.is_term[65:91] = self.is_term[97:123] = self.is_term[128:] = True
        self.low[65:91] += 32

    def bounds(self, buf):
        import numpy as np

        edge = np.flatnonzero(np.diff(np.concatenate([[0], self.is_term[buf].view(np.int8), [0]])))
        return edge[::2], edge[1::2]

    def pieces(self, raw: bytes):
        at = 0
        while at < len(raw):
            end = min(len(raw), at + PIECE)
            while end < len(raw) and self.is_term[raw[end]]:
                end += 1
            yield raw[at:end]
            at = end

    def parts(self, raws: list[bytes]):
        """(numbers of texts, buffer in which they are joined), for a few texts or a piece of one."""
        for at in _scan.groups(raws):
            if len(at) == 1 and len(raws[at[0]]) > PIECE:
                for p in self.pieces(raws[at[0]]):
                    yield at, [p]
            else:
                yield at, [raws[i] for i in at]

    def __call__(self, raws: list[bytes]):
        import numpy as np

        text, h = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for at, own in self.parts(raws):
            buf = np.frombuffer(b"\n".join(own), np.uint8)
            starts, ends = self.bounds(buf)
            h.append(self.hasher.spans(self.low[buf], starts, ends))
            text.append(np.array(at, np.int64)[np.searchsorted(np.cumsum([len(r) + 1 for r in own]), starts, "right")])
        return np.concatenate(text), np.concatenate(h)

    def count(self, raws: list[bytes]):
        """Terms of each text."""
        import numpy as np

        n = np.zeros(len(raws), np.int64)
        for at, own in self.parts(raws):
            starts, _ = self.bounds(np.frombuffer(b"\n".join(own), np.uint8))
            n[at] += np.bincount(np.searchsorted(np.cumsum([len(r) + 1 for r in own]), starts, "right"), minlength=len(at))
        return n


def sizes(docs: DataFrame) -> tuple[int, int]:
    """N, the documents with a term, and L, all their terms."""

    def run(batches):
        import pyarrow as pa

        terms, n, total = Terms(), 0, 0
        for b in _scan.slices(batches):
            own = terms.count([r for r in b.column(0).cast(pa.binary()).to_pylist() if r])
            n, total = n + int((own > 0).sum()), total + int(own.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "l": [total]})

    row = _scan.over(docs.select(F.col("text").cast("string").alias("text")), run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return row[0] or 0, row[1] or 0


def shard(terms: Terms, ids: list, raws: list[bytes], n_docs: int, n_terms: int):
    """The index of some documents as a row of arrays, or None if they have no terms."""
    import numpy as np

    text, h = terms(raws)
    if not len(h):
        return None
    own = np.bincount(text, minlength=len(raws))
    order = np.lexsort((text, h))
    text, h = text[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])]))
    tf = np.diff(np.append(first, len(h)))
    post, of = text[first], h[first]
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    # 50 * n * N may pass a long where a text has most of a large corpus, so it is done once a document in Python's integers
    m = np.array([100 - 50 + (50 * n * n_docs) // n_terms for n in own.tolist()], np.int64)[post]
    impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m)
    unnamed = [i for i, d in enumerate(ids) if d is None]
    arrays = (np.array([d or 0 for d in ids], np.int64), np.array(unnamed, np.int32), of[starts], np.append(starts, len(post)).astype(np.int32), post.astype(np.uint16), impact.astype(np.int32))
    return [x.tobytes() for x in arrays]


def build(docs: DataFrame) -> tuple[DataFrame, int]:
    """The index as a table of shards in the shared folder, and N."""
    n_docs, n_terms = sizes(docs)

    def run(batches):
        import pyarrow as pa

        terms, ids, raws, size = Terms(), [], [], 0

        def made():
            row = shard(terms, ids, raws, n_docs, n_terms)
            return [] if row is None else [pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=["docs", "unnamed", "terms", "starts", "posts", "impacts"])]

        for b in _scan.slices(batches):
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                if not raw:
                    continue
                if ids and (len(ids) >= SHARD_DOCS or size + len(raw) > SHARD_BYTES):
                    yield from made()
                    ids, raws, size = [], [], 0
                ids.append(doc_id)
                raws.append(raw)
                size += len(raw)
        yield from made()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    path = cluster.scratch_path(spark, "index")
    _scan.over(own, run, INDEX).write.option("maxRecordsPerFile", FILE_SHARDS).parquet(path)
    return spark.read.schema(INDEX).parquet(path), n_docs


class Shard:
    def __init__(self, docs, unnamed, terms, starts, posts, impacts):
        import numpy as np

        self.ids, self.none = np.frombuffer(docs, np.int64), np.zeros(len(docs) // 8, bool)
        self.none[np.frombuffer(unnamed, np.int32)] = True
        self.terms, self.starts = np.frombuffer(terms, np.uint64), np.frombuffer(starts, np.int32)
        self.posts, self.impacts = np.frombuffer(posts, np.uint16), np.frombuffer(impacts, np.int32)

    def scores(self, rows, weights):
        """Dense scores of all documents for the terms at these rows."""
        import numpy as np

        out = np.zeros(len(self.ids), np.int64)
        for r, w in zip(rows, weights):
            s, e = self.starts[r], self.starts[r + 1]
            out[self.posts[s:e]] += w * self.impacts[s:e].astype(np.int64)
        return out


def rows_of(terms, wanted):
    """For each wanted hash, its place in terms (sorted), or -1."""
    import numpy as np

    if not len(terms):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    return np.where(terms[at] == wanted, at, -1)


def best(scores, none, ids, k: int):
    """Indices of the k largest positive scores, largest first, equal ones by id with nulls last. All that tie with the k-th
    are kept until they are in order."""
    import numpy as np

    some = np.flatnonzero(scores > 0)
    if len(some) > k:
        least = scores[some[np.argpartition(scores[some], len(some) - k)[len(some) - k]]]
        some = some[scores[some] >= least]
    return some[np.lexsort((ids[some], none[some], -scores[some]))[:k]]


def ask(index: DataFrame, n_docs: int, items: list[tuple[int, int | None, bytes]], k: int) -> DataFrame:
    """FOUND: the k best documents of each task for each item (number, item_id, text)."""
    import math

    import numpy as np

    spark, terms = index.sparkSession, Terms()
    text, h = terms([raw for _, _, raw in items])
    wanted, at = np.unique(h, return_inverse=True)
    pairs = np.unique(np.stack([text, at], axis=1), axis=0) if len(h) else np.zeros((0, 2), np.int64)
    cuts = np.searchsorted(pairs[:, 0], np.arange(len(items) + 1))
    asked = spark.sparkContext.broadcast(wanted)

    def frequencies(batches):
        import pyarrow as pa

        df = np.zeros(len(asked.value), np.int64)
        for b in batches:
            for t, s in zip(*(c.to_pylist() for c in b.columns)):
                r = rows_of(np.frombuffer(t, np.uint64), asked.value)
                df += np.where(r >= 0, np.diff(np.frombuffer(s, np.int32))[r], 0)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["t", "df"])

    df = np.zeros(len(wanted), np.int64)
    for r in _scan.over(index.select("terms", "starts"), frequencies, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():
        df[r.t] = r.df  # as many as the block has terms
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()]
    shared = spark.sparkContext.broadcast((wanted, np.array(weight, np.int64), pairs[:, 1], cuts, [(n, i) for n, i, _ in items]))

    def run(batches):
        import pyarrow as pa

        wanted, weight, of, cuts, names = shared.value
        kept = [None] * len(names)
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                s = Shard(*row)
                at = rows_of(s.terms, wanted)
                for i in range(len(names)):
                    own = of[cuts[i] : cuts[i + 1]]
                    own = own[(at[own] >= 0) & (weight[own] > 0)]
                    if len(own):
                        scores = s.scores(at[own].tolist(), weight[own].tolist())
                        if kept[i] is not None and len(kept[i][0]) == k:
                            scores[scores < kept[i][0][-1]] = 0  # cannot be among the best
                        top = best(scores, s.none, s.ids, k)
                        found = scores[top], s.none[top], s.ids[top]
                        if kept[i] is not None and len(top):
                            found = [np.concatenate(x) for x in zip(kept[i], found)]
                            found = [x[t] for t in [best(*found, k)] for x in found]
                        if len(top):
                            kept[i] = found
        for (n, item_id), found in zip(names, kept):
            if found is not None:
                scores, none, ids = found
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(ids), pa.int32()), pa.array([item_id] * len(ids), pa.int64()), pa.array(ids, mask=none), pa.array(scores)], names=["n", "item_id", "doc_id", "score"])

    return _scan.over(index, run, FOUND)


def blocks(items: DataFrame):
    """Items as (number, item_id, text) in blocks of about BLOCK bytes, or one longer item."""
    own = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n, at = -(-size // BLOCK) or 1, 0
    for b in range(n):
        rows = sorted(own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if rows:
            yield [(at + i, r[0], r[1].encode()) for i, r in enumerate(rows)]
            at += len(rows)


def merged(found: DataFrame, k: int) -> DataFrame:
    """item_id, rank, doc_id and score: the k best of each n, in two levels."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    dealt = found.withColumn("b", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)))
    some = dealt.withColumn("r", F.row_number().over(Window.partitionBy("n", "b").orderBy(*order))).where(F.col("r") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("n").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item."""
    index, n_docs = build(docs)
    parts = [ask(index, n_docs, block, k) for block in blocks(items)]
    found = parts[0] if parts else docs.sparkSession.createDataFrame([], FOUND)
    if len(parts) > 1:
        for p in parts[1:]:
            found = found.unionByName(p)
    return merged(found, k)


def query(spark, sf_dir):
    return search(cluster.table(spark, sf_dir, "documents"), cluster.table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH words AS (
    SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS t
    FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
tf AS MATERIALIZED (SELECT rid, doc_id, t, count(*) AS tf FROM words GROUP BY rid, doc_id, t),
docs AS (SELECT rid, sum(tf)::BIGINT AS n FROM tf GROUP BY rid),
total AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM docs),
m AS (SELECT rid, 100 - 50 + ((50 * n * nn) // l) AS m FROM docs, total),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t, nn),
asked AS (
    SELECT DISTINCT qid, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS t
    FROM (SELECT row_number() OVER () AS qid, item_id, text FROM benchmark)),
scored AS (
    SELECT qid, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
    FROM asked JOIN tf USING (t) JOIN w USING (t) JOIN m USING (rid) GROUP BY qid, item_id, rid, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS r FROM scored WHERE score > 0)
SELECT item_id, r::INTEGER AS rank, doc_id, score FROM ranked WHERE r <= 50
"""
