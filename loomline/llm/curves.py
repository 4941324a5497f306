"""Approximate nearest neighbours by inner product, along several shifted Hilbert curves.

Vectors are divided by the largest norm and get one more component, so that all have length one and the largest inner product
with a query is the smallest distance (for vectors of one norm that component is zero). For each of CURVES curves they are
projected on DIMS random orthonormal directions, squashed to the unit cube by mean and deviation, shifted, cut into a grid
and ordered by the Hilbert key of their cell. A curve is cut into ranges of about RANGE distinct vectors by the quantiles of
a sample of keys. A query is compared with all vectors of its range and of the `window` ranges before and after, on each
curve; a pair that an earlier curve has in its window is not taken again. Products are exact, so merging is ranking.

How wide the window must be depends on the data: neighbours in a few dimensions lie close on some curve, while in vectors
without any structure (as in the given tables) no projection tells near from far, and nearly all ranges are needed. So it is
measured: for PROBES queries the true neighbours are found among all vectors, with the least distance in ranges on any
curve; the window is the least that holds TARGET of them. Recall is therefore about TARGET whatever the data; what varies is
the work, up to comparing each query with everything. The measured share comes with the result.

Only distinct vectors are placed and compared, with the least k + 1 ids that have them: more copies of one vector can never
be among a query's k nearest. A task holds the vectors of one range (or part of it, if ranges get large) and a block of queries.

Samples, all by hash: FIT vectors for means and deviations, KEYS keys for ranges, PROBES queries for the window. Every vector
is indexed.

Defined cases: vectors that are null, zero, empty or hold null or non-finite components take no part; vectors of another length
than the longest are filled up with zeros. Repeated rows are rows of their own, so a query's own row is left out once; a null
vec_id is no query and comes last among equals. Products beyond a double are infinite, undefined ones are never found. An empty table or
one without queries gives an empty result. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline import cluster
from loomline.llm import _scan

cluster.ship_by_value(__name__)

NEAREST, EVERY = 20, 20
CURVES, DIMS, BITS = 4, 4, 10
#: Bits below a key that tell apart vectors of one cell, so that any range can be cut.
SALT = 15
RANGE, RANGE_BYTES = 2048, 8 << 20
FIT, KEYS, PROBES, TARGET = 8192, 262_144, 128, 0.95
#: Sampled keys for a range at least.
PER_RANGE = 16
#: Queries that are compared at a time.
BLOCK = 256
LISTS = "qn long, ids array<long>, scores array<double>"


def hilbert(cells, bits: int):
    """Positions on the Hilbert curve of the cells (n, dims) of a grid of 2 ** bits a side."""
    import numpy as np

    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for axis in x:
            on = (axis & bit) != 0
            swapped = np.where(on, 0, (x[0] ^ axis) & below)
            x[0] ^= np.where(on, below, swapped)
            axis ^= swapped
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(turn)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | axis >> level & 1
    return key


class Curves:
    """Keys of vectors of a width on all curves."""

    def __init__(self, width: int, norm: float, seed: int = 7):
        import numpy as np

        r = np.random.default_rng(seed)
        self.width, self.norm, n = width, norm, min(DIMS, width + 1)
        self.axes = [np.linalg.qr(r.normal(size=(width + 1, n)))[0] for _ in range(CURVES)]
        self.shift = [r.random(n) * (t > 0) for t in range(CURVES)]
        self.mean, self.deviation = [np.zeros(n)] * CURVES, [np.ones(n)] * CURVES

    def lifted(self, x, asked: bool):
        import numpy as np

        with np.errstate(over="ignore", invalid="ignore"):
            scaled = x / self.norm
            own = np.sqrt((scaled**2).sum(1))
            if asked:  # a query's length does not matter
                scaled, last = scaled / np.maximum(own, 1e-300)[:, None], np.zeros(len(x))
            else:
                last = np.sqrt(np.maximum(0, 1 - own**2))
        return np.nan_to_num(np.concatenate([scaled, last[:, None]], axis=1))

    def fit(self, x):
        both = [self.lifted(x, False) @ a for a in self.axes]
        self.mean, self.deviation = [y.mean(0) for y in both], [y.std(0) + 1e-9 for y in both]

    def keys(self, x, salts, asked: bool):
        """(n, CURVES) keys; salts are SALT bits."""
        import numpy as np

        up, out = self.lifted(x, asked), []
        for axes, shift, mean, deviation in zip(self.axes, self.shift, self.mean, self.deviation):
            u = 1 / (1 + np.exp(np.clip(-1.7 * (up @ axes - mean) / deviation, -40, 40)))
            cells = np.minimum((u + shift) / 2 * (1 << BITS), (1 << BITS) - 1).astype(np.int64)
            out.append(hilbert(cells, BITS) << SALT | salts)
        return np.stack(out, axis=1)


def matrix(batch_column, width: int):
    """Rows of an Arrow list column as doubles, filled up with zeros; minus zero becomes zero."""
    import numpy as np

    flat = batch_column.flatten().to_numpy(zero_copy_only=False)
    sizes = batch_column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width))
    if len(flat):
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out + 0.0


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and x (doubles) of the rows that take part."""
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    return own.where(F.col("x").isNotNull() & finite & F.exists("x", lambda c: c != 0))


def packed(rows: DataFrame, curves: Curves, kind: str) -> DataFrame:
    """vec_id, v (the components' bytes, of the kind that the table has), own (product with itself), keys as a vector and
    asks as a query."""
    shared = rows.sparkSession.sparkContext.broadcast(curves)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        c = shared.value
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1), c.width)
                raw = [r.tobytes() for r in x.astype(kind)]
                salts = np.array([xxhash.xxh64_intdigest(r) >> (64 - SALT) for r in raw], np.int64)
                keys = [pa.array(list(c.keys(x, salts, asked)), pa.list_(pa.int64())) for asked in (False, True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array(products(x, x)), *keys], names=["vec_id", "v", "own", "keys", "asks"])

    return _scan.over(rows, run, "vec_id long, v binary, own double, keys array<long>, asks array<long>")


def products(a, b):
    """Row by row inner products, the same for equal rows wherever they stand."""
    import numpy as np

    with np.errstate(over="ignore", invalid="ignore"):
        return (a * b).sum(1)


def sampled(table: DataFrame, total: int, most: int, *key: str) -> DataFrame:
    """About `most` rows at most (all, if fewer), by the hash of key."""
    return table.where(F.pmod(F.xxhash64(*key), F.lit(-(-max(total, 1) // most))) == 0)


def cut_points(vectors: DataFrame, total: int, rows: int):
    """(CURVES, ranges - 1) least keys of all ranges but the first."""
    import numpy as np

    n = min(-(-total // rows), max(1, min(total, KEYS) // PER_RANGE))
    if n <= 1:
        return np.zeros((CURVES, 0), np.int64)
    keys = np.array([r[0] for r in sampled(vectors.select("keys", "v"), total, KEYS, "v").select("keys").collect()], np.int64)
    keys.sort(axis=0)
    return keys[np.arange(1, n) * len(keys) // n].T.copy()


def placed(table: DataFrame, column: str, cuts) -> DataFrame:
    """The table with `at`, the range of each curve, from the keys in `column`."""
    shared = table.sparkSession.sparkContext.broadcast(cuts)
    others = [c for c in table.columns if c != column]
    schema = table.select(*others, F.lit(None).cast("array<int>").alias("at")).schema

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            keys = b.column(len(others)).flatten().to_numpy().reshape(-1, CURVES)
            at = np.stack([np.searchsorted(c, keys[:, t], "right") for t, c in enumerate(shared.value)], axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(list(at), pa.list_(pa.int32()))], names=[*others, "at"])

    return _scan.over(table.select(*others, column), run, schema)


def stacked(raws, width: int):
    """Vectors of `width` components from their bytes, as doubles."""
    import numpy as np

    raw = b"".join(raws)
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * width * len(raws) else np.float64).reshape(-1, width).astype(np.float64)


def top_pairs(scores, k: int):
    """(rows, columns) of the k largest finite scores of each row, with all that tie or nearly tie with the last."""
    import numpy as np

    n = scores.shape[1]
    scores = np.where(np.isnan(scores), -np.inf, scores)
    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
    slack = 1e-12 * np.abs(np.where(np.isfinite(scores), scores, 0)).max(axis=1, initial=0)
    return np.nonzero((scores >= (least - slack)[:, None]) & (scores > -np.inf))


def window_of(vectors: DataFrame, asked: DataFrame, width: int, ranges: int, k: int) -> tuple[int, float]:
    """The least window that holds TARGET of the true neighbours of PROBES queries, and the share that it holds."""
    import numpy as np

    probes = asked.orderBy(F.xxhash64("v"), "v").limit(PROBES).select("v", "at").collect()
    shared = vectors.sparkSession.sparkContext.broadcast(([bytes(r.v) for r in probes], np.array([r["at"] for r in probes])))

    def run(batches):
        import pyarrow as pa

        raw, at = shared.value
        q, known = stacked(raw, width), {r: i for i, r in enumerate(raw)}
        kept = None
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column(0).to_pylist()
            x, places = stacked(own, width), b.column(1).flatten().to_numpy().reshape(-1, CURVES)
            with np.errstate(over="ignore", invalid="ignore"):
                scores = q @ x.T
            for j, r in enumerate(own):
                if r in known:
                    scores[known[r], j] = -np.inf
            i, j = top_pairs(scores, k)
            far = np.abs(at[i] - places[j]).min(axis=1)
            found = i, scores[i, j], far
            kept = found if kept is None else [np.concatenate(z) for z in zip(kept, found)]
            order = np.lexsort((-kept[1], kept[0]))
            i = kept[0][order]
            order = order[np.arange(len(i)) - np.searchsorted(i, i, "left") < k]
            kept = [z[order] for z in kept]
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(kept[1]), pa.array(kept[2].astype(np.int32))], names=["i", "score", "far"])

    near = _scan.over(vectors.select("v", "at"), run, "i long, score double, far int")
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "far"))
    far = np.sort([r.far for r in near.withColumn("r", rank).where(F.col("r") <= k).select("far").collect()])  # PROBES * k
    if not len(far):
        return ranges, 1.0
    window = int(far[min(len(far) - 1, int(np.ceil(TARGET * len(far))) - 1)])
    return window, float((far <= window).mean())


def compared(vectors: DataFrame, asked: DataFrame, width: int, ranges: int, window: int, parts: int, k: int) -> DataFrame:
    """LISTS: of each query and range in its window, the k best rows that no earlier curve has, as one list."""
    curve = F.explode(F.array(*[F.lit(t) for t in range(CURVES)])).alias("curve")
    none = lambda kind: F.lit(None).cast(kind)
    part = F.pmod(F.xxhash64("v"), F.lit(parts)).cast("int")
    a = vectors.select(curve, "v", "ids", "at").select("curve", F.col("at")[F.col("curve")].alias("range"), part.alias("part"), none("long").alias("qn"), "v", "ids", "at")
    ask = asked.select(curve, "qn", "v", "at").withColumn("range", F.explode(F.sequence(F.greatest(F.col("at")[F.col("curve")] - window, F.lit(0)), F.least(F.col("at")[F.col("curve")] + window, F.lit(ranges - 1)))))
    b = ask.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("curve", "range", "part", "qn", "v", none("array<long>").alias("ids"), "at")
    dealt = a.unionByName(b).repartition("curve", "range", "part").sortWithinPartitions("curve", "range", "part", F.col("qn").asc_nulls_first())

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def answers(t, rows, queries):
            x, ids, places = rows
            q, at = stacked([r for _, r, _ in queries], width), np.array([p for _, _, p in queries])
            with np.errstate(over="ignore", invalid="ignore"):
                scores = q @ x.T
            for s in range(t):
                scores[np.abs(at[:, s][:, None] - places[:, s][None, :]) <= window] = -np.inf
            i, j = top_pairs(scores, k)
            if not len(i):
                return
            score = products(q[i], x[j])
            n = np.array([len(ids[z]) for z in j])
            i, score, of = np.repeat(i, n), np.repeat(score, n), [d for z in j for d in ids[z]]
            nulls = np.array([d is None for d in of])
            names = np.array([d or 0 for d in of], np.int64)
            order = np.lexsort((names, nulls, -score, i))
            sorted_i = i[order]
            order = order[np.arange(len(order)) - np.searchsorted(sorted_i, sorted_i, "left") < k]
            some, begin = np.unique(i[order], return_index=True)
            cut = pa.array(np.append(begin, len(order)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, x) for x in (pa.array(names[order], mask=nulls[order]), pa.array(score[order]))]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([n for n, _, _ in queries], np.int64)[some]), *lists], names=["qn", "ids", "scores"])

        group, held, rows, queries = None, [], None, []
        for b in batches:
            for curve, rng, part, qn, v, ids, at in zip(*(c.to_pylist() for c in b.columns)):
                if (curve, rng, part) != group:
                    if queries:
                        yield from answers(group[0], rows, queries)
                    group, held, rows, queries = (curve, rng, part), [], None, []
                if qn is None:
                    held.append((v, ids, at))
                elif held or rows:
                    if rows is None:
                        rows, held = (stacked([r for r, _, _ in held], width), [i for _, i, _ in held], np.array([p for _, _, p in held])), []
                    queries.append((qn, v, at))
                    if len(queries) >= BLOCK:
                        yield from answers(curve, rows, queries)
                        queries = []
        if queries:
            yield from answers(group[0], rows, queries)

    return _scan.over(dealt, run, LISTS)


def merged(found: DataFrame, k: int) -> DataFrame:
    """qn and list (vec_id, score): the k best of all lists of a query. Lists come in order of queries, so a task holds a few
    lists of one query, however many ranges it has."""

    def run(batches):
        def best(own):
            return sorted(own, key=lambda e: (-e[1], e[0] is None, e[0] or 0))[:k]

        query, own = None, []
        for b in batches:
            out = []
            for qn, ids, scores in zip(*(c.to_pylist() for c in b.columns)):
                if qn != query:
                    if own:
                        out.append((query, best(own)))
                    query, own = qn, []
                elif len(own) > 50 * k:
                    own = best(own)
                own += zip(ids, scores)
            if out:
                yield batch(out)
        if own:
            yield batch([(query, best(own))])

    def batch(out):
        import pyarrow as pa

        rows = [[{"vec_id": i, "score": s} for i, s in own] for _, own in out]
        return pa.RecordBatch.from_arrays([pa.array([q for q, _ in out], pa.int64()), pa.array(rows, pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])))], names=["qn", "list"])

    return _scan.over(found.repartition("qn").sortWithinPartitions("qn"), run, "qn long, list array<struct<vec_id:long,score:double>>")


def search(table: DataFrame, is_query, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of each row for which is_query holds (a condition on vec_id);
    window, ranges and sample_recall tell how far was looked."""
    rows = usable(table)
    biggest = F.array_max(F.transform("x", F.abs))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + (c / biggest) * (c / biggest))) * biggest
    total, width, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0)), F.max(norm)).first()
    curves = Curves(width, min(most or 1.0, 1e300))
    if total:
        import numpy as np

        few = [r[0] for r in sampled(rows, total, FIT, "vec_id", "x").select("x").collect()]
        curves.fit(np.array([r + [0.0] * (width - len(r)) for r in few]).reshape(len(few), width) if few else np.zeros((1, width)))
    kind = "f4" if table.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"
    own = cluster.materialize(packed(rows, curves, kind), "packed")

    # distinct vectors with the ids that can matter; a hot vector's rows are cut before they are shuffled
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last()))
    least = own.select("v", "vec_id", "keys").withColumn("r", rank).where(F.col("r") <= k + 1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("r", "vec_id"))), lambda e: e["vec_id"])
    vectors = cluster.materialize(least.groupBy("v").agg(F.first("keys").alias("keys"), ids.alias("ids")), "vectors")
    n = vectors.count()
    size = max(1, min(RANGE, RANGE_BYTES // max(1, 8 * width)))
    cuts = cut_points(vectors, n, size)
    ranges = cuts.shape[1] + 1
    vectors = cluster.materialize(placed(vectors, "keys", cuts), "placed")
    queries = own.where(is_query)
    kinds = queries.groupBy("v").agg(F.first("asks").alias("asks"), F.count(F.lit(1)).alias("n")).withColumn("qn", F.monotonically_increasing_id())
    asked = cluster.materialize(placed(kinds, "asks", cuts), "asked")
    window, recall = window_of(vectors, asked, width, ranges, k) if ranges > 1 else (0, 1.0)

    found = compared(vectors, asked, width, ranges, window, -(-n // (ranges * 4 * size)) or 1, k + 1)
    lists = merged(found, k + 1)
    answers = cluster.materialize(asked.select("qn", "v", "n").join(lists, "qn"), "answers").drop("qn")
    joined = cluster.lookup(queries.select("vec_id", "v", "own"), answers, "v", "n", queries.count(), F.struct("vec_id", "v"))
    # the k + 1 best less the query's own row, or less the last
    mine = F.array_position(F.transform("list", lambda e: F.coalesce((e["vec_id"] == F.col("vec_id")) & (e["score"] == F.col("own")), F.lit(False))), F.lit(True))
    others = F.slice(F.filter("list", lambda e, i: i + 1 != F.col("mine")), 1, k)
    out = joined.where("list is not null").withColumn("mine", mine).select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("i", "e"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "e.vec_id", "e.score", F.lit(window).alias("window"), F.lit(ranges).alias("ranges"), F.lit(recall).alias("sample_recall"))


def query(spark, sf_dir):
    return search(cluster.table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(EVERY)) == 0)
