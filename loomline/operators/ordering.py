"""A seeded order of all rows, and blocks of fixed size in that order.

The order is by a keyed hash, so it depends on the seed and the keys alone, not on partitions. Places and byte offsets are
found in two levels: within ranges of the hash, plus the sums of the ranges before. No task sees all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline import cluster

#: Ranges of the hash; a range is a task's work.
RANGES = 1024


def shuffled(df: DataFrame, key: list[str], seed: int, size: Column | None = None) -> DataFrame:
    """df with `position`, from 0, in an order by seed and key; with a size, also `offset`, the sum of the sizes before.
    Rows with equal keys stand together, in the order of their other columns' hash."""
    h, p, s = cluster.fresh(df.columns, "h", "p", "s")
    hashed = F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]).cast("binary"), 256)
    own = df.withColumn(h, hashed).withColumn(p, F.floor(F.conv(F.substring(h, 1, 6), 16, 10).cast("long") * RANGES / (1 << 24)).cast("int"))
    own = own.withColumn(s, (size if size is not None else F.lit(0)).cast("long"))
    sums = own.groupBy(p).agg(F.count(F.lit(1)).alias("_n"), F.sum(s).alias("_s"))
    before = Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
    offsets = sums.select(F.col(p).alias("_q"), "_n", "_s").select("_q", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s"))
    inside = Window.partitionBy(p).orderBy(h, F.xxhash64(*df.columns))
    ranked = own.withColumn("position", F.row_number().over(inside) - 1).withColumn("offset", F.coalesce(F.sum(s).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ranked.join(F.broadcast(offsets), F.col(p) == F.col("_q"))
    columns = [*df.columns, (F.col("position") + F.col("_n")).cast("long").alias("position")]
    return placed.select(*columns, *([] if size is None else [(F.col("offset") + F.col("_s")).cast("long").alias("offset")]))


def concatenated(pieces: DataFrame, size: int) -> DataFrame:
    """block and content (bytes) of all pieces (offset, raw) one after the other, cut into blocks of `size` bytes; the last
    block is what is left. A piece is cut before it is dealt out, so a long one is many rows, each of a block at most."""
    end = F.col("offset") + F.octet_length("raw")
    numbers = F.when(F.octet_length("raw") > 0, F.sequence(F.floor(F.col("offset") / size), F.floor((end - 1) / size)))

    def cut(b):
        at = F.greatest(b * size - F.col("offset"), F.lit(0))
        upto = F.least((b + 1) * size, end) - F.col("offset")
        return F.struct(b.alias("block"), (F.col("offset") + at).alias("at"), F.substring("raw", (at + 1).cast("int"), (upto - at).cast("int")).alias("x"))

    parts = pieces.select(F.explode(F.transform(numbers, cut)).alias("c")).select("c.*")
    own = parts.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v"))
    return own.select("block", F.aggregate("v", F.lit(b""), lambda a, x: F.concat(a, x["x"])).alias("content"))
