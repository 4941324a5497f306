"""What every operator needs from the cluster: tables, shared storage, skew-safe joins and gapless ranks."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key with this share of the rows or more is hot; there can be at most 1 / HOT_SHARE such keys.
HOT_SHARE = 1 / 1000


def ship_by_value(module_name: str) -> None:
    """Workers need not be able to import this module: its functions travel with the task."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one on a single machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = "file://" + tempfile.mkdtemp(prefix="loomline-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/loomline-{uuid.uuid4().hex}/{tag}"
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(parent)
    return path


#: Spark's setting by which the shuffle files of a query go when the query ends, not when the driver collects garbage.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str, free: bool = False) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it again. Survives lost executors. With `free` the
    shuffle files of the write go when it ends."""
    spark = df.sparkSession
    path, was = scratch_path(spark, tag), spark.conf.get(FREE, None)
    try:
        if free:
            spark.conf.set(FREE, "true")
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.unset(FREE) if was is None else spark.conf.set(FREE, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete the folders of materialized tables that nothing reads any more."""
    for t in tables:
        if (path := getattr(t, "_scratch", None)) if t is not None else None:
            jvm = t.sparkSession.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
            folder.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small(table: DataFrame, rows: int) -> DataFrame:
    """The table, marked for broadcast if it was counted and has no more than so many rows."""
    return F.broadcast(table) if table.count() <= rows else table


def blocks(table: DataFrame, key: str, rows: int) -> list[DataFrame]:
    """The table in parts by the hash of `key`, each of about `rows` rows at most, so that each may be broadcast. What meets a
    part is scanned once a part; with more than one part, the caller should materialize the results."""
    n = -(-table.count() // rows)
    if n <= 1:
        return [table]
    return [table.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def fresh(columns: list[str], *names: str) -> list[str]:
    """Column names like `names` that none of `columns` has, whatever the case of its letters."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def lower_batches(spark: SparkSession, rows: int, size: int) -> None:
    """At most so many rows and bytes in an Arrow batch that a worker gets; a smaller setting of the session stays."""
    as_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key)
        if now.startswith("-") or not 0 < as_bytes(now) <= most:
            spark.conf.set(key, str(most))


def lookup(facts: DataFrame, dim: DataFrame, key: str, count: str, total: int, spread: Column) -> DataFrame:
    """Left join of facts with dim, which has one row a key and, in `count`, the number of facts of that key.

    Keys with at least total * HOT_SHARE facts are at most 1 / HOT_SHARE: they are broadcast, so their facts
    are not shuffled by key. The others are joined by a shuffle in which each key is small. `spread` gives
    facts already joined something to be dealt by. `count` is not part of the result.
    """
    least = max(2, int(total * HOT_SHARE) + 1)
    values = [c for c in dim.columns if c not in (key, count)]
    hot = dim.where(F.col(count) >= least).select(F.col(key).alias("__hk"), F.struct(*values).alias("__hv"))
    cold = dim.where(F.col(count) < least).select(F.struct(F.lit(0).alias("h"), F.col(key).alias("k"), F.lit(0).cast("long").alias("s")).alias("__ck"), F.struct(*values).alias("__cv"))
    first = facts.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__hk")), "left")
    done = F.col("__hv").isNotNull()
    none = F.lit(None).cast(dim.schema[key].dataType)
    ck = F.struct(F.when(done, 1).otherwise(0).alias("h"), F.when(done, none).otherwise(F.col(key)).alias("k"), F.when(done, F.xxhash64(spread)).otherwise(F.lit(0).cast("long")).alias("s"))
    both = first.withColumn("__fk", ck).join(cold, F.col("__fk") == F.col("__ck"), "left")
    return both.select(*facts.columns, *[F.coalesce(F.col("__hv")[v], F.col("__cv")[v]).alias(v) for v in values])


def gapless_rank(df: DataFrame, by: list[str], order: list[Column], out: str, buckets: int) -> DataFrame:
    """0, 1, 2, ... within each `by`, in two levels: a rank within (by, bucket of the order's hash) plus the rows of
    the buckets before. No task holds all rows of a `by`. The order decides within a bucket."""
    dealt = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(c).alias(f"__o_{c}") for c in by], F.col("__b").alias("__ob"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    ranked = dealt.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__b").orderBy(*order)) - 1)
    on = F.col("__b") == F.col("__ob")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"__o_{c}"))
    return ranked.join(offsets, on, "left").select(*df.columns, (F.col("__r") + F.col("__off")).cast("long").alias(out))
