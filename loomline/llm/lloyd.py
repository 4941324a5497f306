"""Vector codes by Lloyd's algorithm on integers, with sums that are maintained by differences.

A component x becomes floor(SCALE * x). A vector is cut into PARTS equal consecutive parts, and each part position has a
codebook of ENTRIES entries, which begins as that part of the rows that come first by vec_id. A round assigns every part to
its codebook's nearest entry and replaces each entry by the floored mean of its parts.

What a round keeps is written to the shared folder: the assignments, in the table of the vectors, and the running sums and
counts of all entries. The next round compares each part's new entry with its previous one, and only parts that moved
contribute: minus to the entry they left, plus to the one they came to. These contributions are summed in the task and
then by (part, entry, position), so at most PARTS * ENTRIES * (1 + width of a part) numbers leave a task, however many rows
it has; adding them to the running sums gives the new means exactly, as all are integers. One scan of the vectors a round
gives both the assignments and the contributions. Only codebooks reach the driver.

Defined cases: vectors that are null or hold null or non-finite components are dropped; a zero vector is kept. Vectors that
are shorter than the longest one, or whose length is no multiple of PARTS, count as filled up with zeros. Components are cut
off at a power of two that keeps every distance within a long (2 ** 27 for 64 components, so for |x| of 524,288 and more).
With fewer than ENTRIES rows there are as many entries as rows. Equal distances go to the lower entry; rows with equal vec_id
are rows of their own, in the order of their components; null vec_ids come last. A sum of errors beyond a long is null.
An empty table gives an empty result. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline import cluster
from loomline.llm import _scan

cluster.ship_by_value(__name__)

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
STATE = "vec_id long, label string, v array<int>, code binary, part int, entry int, pos int, delta long"
CODED = "vec_id long, label string, code string, error long"


def limit_of(width: int) -> int:
    """The largest power of two L with width * (2 L) ** 2 < 2 ** 62."""
    return 1 << max(0, min(30, (61 - max(width, 1).bit_length()) // 2 - 1))


def integers(rows: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, label and v (integers) of the rows that are kept, and the width of v, a multiple of PARTS."""
    x = F.col("embedding").cast("array<double>")
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.alias("x"))
    finite = F.forall("x", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    own = own.where(F.col("x").isNotNull() & finite)
    width = -(-own.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0] // PARTS) * PARTS
    most = limit_of(width)
    cut = F.transform("x", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(most))), F.lit(float(-most)))).cast("int"))
    return own.select("vec_id", "label", F.concat(cut, F.array_repeat(F.lit(0), F.lit(width) - F.size("x"))).alias("v")), width


def nearest(v, book):
    """Nearest entry of each row (ties to the lower one) and its squared distance; v (rows, d) and book (entries, d) are
    integers. Products are taken in doubles where these are exact, else in longs."""
    import numpy as np

    d = v.shape[1]
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(book).max(initial=0)))
    if d * (2 * most) ** 2 < 1 << 52:
        a, b = v.astype(np.float64), book.astype(np.float64)
        far = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
        at = far.argmin(1)
        return at, far[np.arange(len(v)), at].astype(np.int64)
    at, least = np.zeros(len(v), np.int64), np.full(len(v), np.iinfo(np.int64).max)
    for j in range(len(book)):
        far = ((v - book[j]) ** 2).sum(1)
        at[far < least] = j
        least = np.minimum(least, far)
    return at, least


def assign(v, book):
    """Codes (rows, PARTS) as bytes and errors of v (rows, width); book is (PARTS, entries, d)."""
    import numpy as np

    d = book.shape[2]
    code, error = np.zeros((len(v), PARTS), np.uint8), np.zeros(len(v), np.int64)
    for p in range(PARTS):
        code[:, p], far = nearest(v[:, p * d : (p + 1) * d], book[p])
        error += far
    return code, error


def contributions(v, old, new, entries: int):
    """(PARTS, entries, 1 + d): counts and sums that entries gain and lose by the parts whose entry changed. old is None in
    the first round, where every part arrives."""
    import numpy as np

    d = v.shape[1] // PARTS
    out = np.zeros((PARTS, entries, 1 + d), np.int64)
    for p in range(PARTS):
        moved = slice(None) if old is None else np.flatnonzero(old[:, p] != new[:, p])
        x = v[moved, p * d : (p + 1) * d]
        for sign, to in ((1, new[moved, p]), *([] if old is None else [(-1, old[moved, p])])):
            np.add.at(out[p, :, 0], to, sign)
            np.add.at(out[p, :, 1:], to, sign * x)
    return out


def vectors(batch, width: int):
    """Columns vec_id, label, v and code of a batch; v and code as arrays, code None where there is none yet."""
    import numpy as np

    v = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, width)
    code = batch.column(3)
    return v, None if code.null_count else np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(-1, PARTS)


def step(state: DataFrame, book, width: int) -> DataFrame:
    """The table of STATE: the rows with their new codes, and rows of (part, entry, pos, delta); pos 0 is the count."""
    shared = state.sparkSession.sparkContext.broadcast(book)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        own, total = shared.value, np.zeros((PARTS, shared.value.shape[1], 1 + width // PARTS), np.int64)
        types = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        names = ["vec_id", "label", "v", "code", "part", "entry", "pos", "delta"]
        for b in batches:
            if b.num_rows:
                v, old = vectors(b, width)
                code, _ = assign(v, own)
                total += contributions(v, old, code, own.shape[1])
                cols = [b.column(0), b.column(1), b.column(2).cast(types[2]), pa.array([r.tobytes() for r in code], types[3]), *[pa.nulls(b.num_rows, t) for t in types[4:]]]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        part, entry, pos = np.nonzero(total)
        cols = [*[pa.nulls(len(part), t) for t in types[:4]], *[pa.array(x.astype(np.int32)) for x in (part, entry, pos)], pa.array(total[part, entry, pos])]
        yield pa.RecordBatch.from_arrays(cols, names=names)

    return _scan.over(state, run, STATE)


def moved(book, sums):
    """The codebook of the running sums; entries without parts stay."""
    import numpy as np

    n = sums[:, :, :1]
    return np.where(n > 0, sums[:, :, 1:] // np.maximum(n, 1), book)


def fit(rows: DataFrame, width: int, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, object, list[int]]:
    """(the last state's vectors, codebooks after all rounds, how many parts' contributions each round summed)."""
    import numpy as np

    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    book = np.array([r.v for r in first], np.int64).reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2)
    state, running, counts = rows.withColumn("code", F.lit(None).cast("binary")), None, []
    for k in range(rounds if len(first) else 0):
        out = cluster.materialize(step(state, book, width), f"round-{k}")
        delta = out.where("part is not null").select("part", "entry", "pos", "delta")
        kept = delta if running is None else running.unionByName(delta)
        running = cluster.materialize(kept.groupBy("part", "entry", "pos").agg(F.sum("delta").alias("delta")), f"sums-{k}")
        sums = np.zeros((PARTS, len(first), 1 + width // PARTS), np.int64)
        for r in running.collect():  # PARTS * entries * (1 + d) rows at most
            sums[r.part, r.entry, r.pos] = r.delta
        book = moved(book, sums)
        counts.append(int(sums[:, :, 0].sum()))
        state = out.where("part is null").select("vec_id", "label", "v", "code")
    return state, book, counts


def coded(state: DataFrame, book, width: int) -> DataFrame:
    """vec_id, label, code (hex) and error under the codebooks."""
    shared = state.sparkSession.sparkContext.broadcast(book)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                code, error = assign(vectors(b, width)[0], shared.value)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes().hex() for r in code], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return _scan.over(state, run, CODED)


def digest(book) -> str:
    """SHA-256 of all components by part, entry and position."""
    import hashlib

    return hashlib.sha256(",".join(str(x) for x in book.reshape(-1).tolist()).encode()).hexdigest()


def compress(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each kept row."""
    kept, width = integers(rows)
    kept = cluster.materialize(kept, "integers")
    state, book, _ = fit(kept, width)
    own = cluster.materialize(coded(state, book, width).withColumn("k", F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))), "coded")
    sums = own.groupBy("k").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    out = cluster.lookup(own, cluster.materialize(sums, "labels"), "k", "n", own.count(), F.struct("vec_id", "code"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))


def query(spark, sf_dir):
    return compress(cluster.table(spark, sf_dir, "embeddings"))


#: Every assignment is a join of parts with their codebook; rounds are written out one after the other. For vectors of 64
#: components and unique vec_ids.
SQL = """
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, v[p * 4 + 1] AS a, v[p * 4 + 2] AS b, v[p * 4 + 3] AS c, v[p * 4 + 4] AS d FROM kept, (SELECT unnest(range(16)) AS p)),
begin AS MATERIALIZED (
    SELECT p, e, a, b, c, d FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)),
near1 AS MATERIALIZED (
    SELECT vec_id, x.p, any_value(x.a) AS a, any_value(x.b) AS b, any_value(x.c) AS c, any_value(x.d) AS d,
           min(struct_pack(f := (x.a-k.a)*(x.a-k.a) + (x.b-k.b)*(x.b-k.b) + (x.c-k.c)*(x.c-k.c) + (x.d-k.d)*(x.d-k.d), e := k.e)) AS m
    FROM parts x JOIN begin k ON x.p = k.p GROUP BY vec_id, x.p),
mean1 AS (SELECT p, m.e AS e, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d FROM near1 GROUP BY p, m.e),
book1 AS MATERIALIZED (
    SELECT k.p, k.e, coalesce(CAST(floor(m.a / m.n) AS BIGINT), k.a) AS a, coalesce(CAST(floor(m.b / m.n) AS BIGINT), k.b) AS b,
           coalesce(CAST(floor(m.c / m.n) AS BIGINT), k.c) AS c, coalesce(CAST(floor(m.d / m.n) AS BIGINT), k.d) AS d
    FROM begin k LEFT JOIN mean1 m ON k.p = m.p AND k.e = m.e),
near2 AS MATERIALIZED (
    SELECT vec_id, x.p, any_value(x.a) AS a, any_value(x.b) AS b, any_value(x.c) AS c, any_value(x.d) AS d,
           min(struct_pack(f := (x.a-k.a)*(x.a-k.a) + (x.b-k.b)*(x.b-k.b) + (x.c-k.c)*(x.c-k.c) + (x.d-k.d)*(x.d-k.d), e := k.e)) AS m
    FROM parts x JOIN book1 k ON x.p = k.p GROUP BY vec_id, x.p),
mean2 AS (SELECT p, m.e AS e, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d FROM near2 GROUP BY p, m.e),
book2 AS MATERIALIZED (
    SELECT k.p, k.e, coalesce(CAST(floor(m.a / m.n) AS BIGINT), k.a) AS a, coalesce(CAST(floor(m.b / m.n) AS BIGINT), k.b) AS b,
           coalesce(CAST(floor(m.c / m.n) AS BIGINT), k.c) AS c, coalesce(CAST(floor(m.d / m.n) AS BIGINT), k.d) AS d
    FROM book1 k LEFT JOIN mean2 m ON k.p = m.p AND k.e = m.e),
near3 AS (
    SELECT vec_id, x.p, min(struct_pack(f := (x.a-k.a)*(x.a-k.a) + (x.b-k.b)*(x.b-k.b) + (x.c-k.c)*(x.c-k.c) + (x.d-k.d)*(x.d-k.d), e := k.e)) AS m
    FROM parts x JOIN book2 k ON x.p = k.p GROUP BY vec_id, x.p),
coded AS (SELECT vec_id, string_agg(format('{:02x}', m.e), '' ORDER BY p) AS code, CAST(sum(m.f) AS BIGINT) AS error FROM near3 GROUP BY vec_id),
books AS (SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY p, e)) AS h FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded JOIN kept USING (vec_id), books
"""
