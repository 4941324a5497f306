"""A saved vector index in cells.

Vectors are dealt to the nearest of a number of centres, and each cell is a folder, so a search reads only the cells that it
looks into. Beside the cells stand the centres with each cell's radius and rows. A search takes the nearest cells of a query;
an exact search goes on with every cell that can hold something better than what was found: no product in a cell exceeds
that with its centre by more than the query's length times the radius.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline import cluster
from loomline.sources import datasets

cluster.ship_by_value(__name__)

#: Vectors that centres are fitted on, by hash, and rounds of it.
SAMPLE, ROUNDS = 20_000, 8
#: Rows of a cell that one task compares at a time.
PART = 20_000
CENTRES = "cell int, centre array<double>, radius double, rows long"


def fit(vectors: DataFrame, cells: int):
    """Centres by Lloyd's rounds on a sample of SAMPLE vectors at most; empty ones stay where they are."""
    import numpy as np

    n = vectors.count()
    rows = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(-(-max(n, 1) // SAMPLE))) == 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
    x = np.array([r[0] for r in rows], np.float64)
    centres = x[:cells].copy()
    for _ in range(ROUNDS if len(x) else 0):
        at = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        n_at = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(n_at[:, None] > 0, sums / np.maximum(n_at, 1)[:, None], centres)
    return centres


def save(vectors: DataFrame, path: str, cells: int) -> int:
    """Write the index of (vec_id, embedding) below path and return its rows. Vectors without finite components are left
    out. The index counts as there once its centres are written."""
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & finite)
    centres = fit(own, cells)
    shared = spark.sparkContext.broadcast(centres)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        c = shared.value
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                far = np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1))
                at = far.argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array(np.sqrt(((x - c[at]) ** 2).sum(1)))], names=["vec_id", "embedding", "cell", "far"])

    placed = own.mapInArrow(run, "vec_id long, embedding array<double>, cell int, far double")
    placed.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    written = spark.read.schema("vec_id long, embedding array<double>, far double, cell int").parquet(f"{path}/cells")
    sums = {r.cell: r for r in written.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("rows")).collect()}  # a row a cell
    rows = [(i, c.tolist(), sums[i].radius, sums[i].rows) for i, c in enumerate(centres) if i in sums]
    spark.createDataFrame(rows, CENTRES).coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    return sum(r[3] for r in rows)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cells, centres) of a saved index. One whose cells do not have the rows that its centres tell is refused."""
    if "_SUCCESS" not in datasets.children(spark, f"{path}/centres"):
        raise FileNotFoundError(path)
    cells = spark.read.schema("vec_id long, embedding array<double>, far double, cell int").parquet(f"{path}/cells")
    centres = spark.read.schema(CENTRES).parquet(f"{path}/centres")
    rows, told = cells.count(), centres.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    if rows != told:
        raise ValueError(f"the index at {path} has {rows} rows instead of {told}")
    return cells, centres


def ranked_cells(queries: DataFrame, centres: DataFrame) -> DataFrame:
    """q, qe, and an array `near` of (score, bound, cell, parts), nearest cells first. Centres are as many as cells."""
    import numpy as np

    rows = centres.orderBy("cell").collect()
    c = np.array([r.centre for r in rows], np.float64)
    shared = queries.sparkSession.sparkContext.broadcast((c, np.array([r.radius for r in rows]), [r.cell for r in rows], [-(-r.rows // PART) for r in rows]))

    def run(batches):
        import pyarrow as pa

        c, radius, cells, parts = shared.value
        kind = pa.list_(pa.struct([("bound", pa.float64()), ("cell", pa.int32()), ("parts", pa.int32())]))
        for b in batches:
            if b.num_rows:
                q = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                far = (c**2).sum(1) - 2 * q @ c.T
                bound = q @ c.T + np.sqrt((q**2).sum(1))[:, None] * radius
                near = [[{"bound": bound[i, j], "cell": cells[j], "parts": parts[j]} for j in row] for i, row in enumerate(np.argsort(far, axis=1, kind="stable"))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, kind)], names=["q", "qe", "near"])

    own = queries.select(F.col("vec_id").cast("long").alias("q"), F.col("embedding").cast("array<double>").alias("qe"))
    return own.mapInArrow(run, "q long, qe array<double>, near array<struct<bound:double,cell:int,parts:int>>")


def compared(asked: DataFrame, cells: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """q, vec_id and score: the k best of each query in each cell part that it asks (q, qe, cell, parts)."""
    ask = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "part", "q", "qe")
    own = cells.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).select("cell", "part", "vec_id", "embedding")

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        names = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return names.empty_table()
        flat = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False)
        q, x = flat(left.column("qe")).reshape(left.num_rows, -1), flat(right.column("embedding")).reshape(right.num_rows, -1)
        qn, ids, out = left.column("q").to_numpy(), right.column("vec_id").to_numpy(), []
        for i in range(0, len(q), 256):
            scores = q[i : i + 256] @ x.T
            scores[qn[i : i + 256, None] == ids[None, :]] = -np.inf
            least = np.partition(scores, -k, axis=1)[:, -k] - 1e-12 if len(x) > k else np.full(len(scores), -np.inf)
            a, b = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
            out.append((qn[i + a], ids[b], (q[i + a] * x[b]).sum(1)))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=names)

    found = ask.groupBy("cell", "part").cogroup(own.groupBy("cell", "part")).applyInArrow(run, "q long, vec_id long, score double")
    return best(found, k).drop("rank")


def best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(queries: DataFrame, path: str, k: int, probes: int = 8, exact: bool = False) -> DataFrame:
    """q, rank, vec_id and score of the k best other vectors of each query (vec_id, embedding) by inner product. It looks into
    the `probes` nearest cells; if exact, also into all those that can hold something better."""
    cells, centres = load(queries.sparkSession, path)
    asked = cluster.materialize(ranked_cells(queries, centres), "asked")
    parts = centres.select("cell", F.ceil(F.col("rows") / PART).cast("int").alias("parts"))
    first = asked.select("q", "qe", F.explode(F.slice("near", 1, probes)).alias("c")).select("q", "qe", "c.cell", "c.parts")
    found = cluster.materialize(compared(first, cells, parts, k), "first")
    if exact:
        edge = found.groupBy("q").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("have"))
        least = F.when(F.col("have") >= k, F.col("least") - 1e-9).otherwise(F.lit(float("-inf")))
        rest = asked.join(edge, "q", "left").withColumn("least", F.coalesce(least, F.lit(float("-inf"))))
        more = rest.select("q", "qe", "least", F.explode(F.slice("near", probes + 1, 1 << 30)).alias("c")).where("c.bound >= least").select("q", "qe", "c.cell", "c.parts")
        found = found.unionByName(compared(more, cells, parts, k))
    return best(found, k).select("q", "rank", "vec_id", "score")


def recall(queries: DataFrame, path: str, k: int, probes: int) -> float:
    """Share of the k truly best vectors of the queries that a search with so many probes finds."""
    got = search(queries, path, k, probes).select("q", "vec_id").withColumn("hit", F.lit(1))
    true = search(queries, path, k, probes, exact=True).select("q", "vec_id")
    return true.join(got, ["q", "vec_id"], "left").agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]
