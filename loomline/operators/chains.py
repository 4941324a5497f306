"""Greedy acceptance over a log: a row counts only against the last row that was accepted.

A throttle runs again after so many hours and with another signature, both counted from the last run; a cache stores again
when what it stored is too old, and a hit does not make it younger. Which rows are accepted thus depends on the rows accepted
before. Each row's successor, the row that would be accepted next if this one is, does not: it is found for all rows at
once, and the accepted ones are those that are reached from a key's first row. Pointers are doubled, so a chain of n rows
takes log2 n joins.

Time is cut into blocks as long as the gap. A row's successor stands in the next block or in the first later one that has
rows, so windows run over (key, block), and over one row a block and key; a key with many rows is many groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline import cluster


def successors(log: DataFrame, gap: int, strict: bool) -> DataFrame:
    """k, b, t, i, s of the log (key, time, unique id, signature) with `next`, the id of the successor."""
    block = lambda t: F.floor(F.col(t) / F.lit(gap)).cast("long")
    own = log.withColumn("b", block("t"))
    row = F.struct("t", "i", "s")
    inside = Window.partitionBy("k", "b").orderBy("t", "i")
    rest = inside.rowsBetween(1, Window.unboundedFollowing)
    blocks = own.groupBy("k", "b").agg(F.min(row).alias("head"), F.max(row).alias("tail"))
    before = blocks.select("k", "b", F.lag("tail").over(Window.partitionBy("k").orderBy("b")).alias("_tail"))
    # where the signature changes, also across blocks
    own = own.join(before, ["k", "b"])
    was = F.coalesce(F.lag(F.struct("s")).over(inside), F.when(F.col("_tail").isNotNull(), F.struct(F.col("_tail")["s"].alias("s"))))
    own = own.withColumn("_c", F.when(was.isNotNull() & ~was["s"].eqNullSafe(F.col("s")), F.struct("t", "i")))
    changes = own.groupBy("k", "b").agg(F.min("_c").alias("_c"))
    later = Window.partitionBy("k").orderBy("b").rowsBetween(1, Window.unboundedFollowing)
    changes = changes.select("k", "b", F.first("_c", ignorenulls=True).over(later).alias("_later"))
    own = own.join(changes, ["k", "b"]).withColumn("change", F.coalesce(F.first("_c", ignorenulls=True).over(rest), F.col("_later"))["i"])
    own = own.select("k", "b", "t", "i", "s", "change")

    # the first row at or after t + gap
    event = F.struct("t", "i", "s", "change")
    none = F.lit(None).cast(own.select(event.alias("e")).schema["e"].dataType)
    asked = own.withColumn("t", F.col("t") + F.lit(gap + int(strict))).withColumn("b", block("t"))
    both = own.select("k", "b", "t", F.lit(1).alias("o"), F.col("i").alias("o2"), event.alias("e"), F.lit(None).cast(own.schema["i"].dataType).alias("q"), F.lit(None).cast(own.schema["s"].dataType).alias("qs"))
    both = both.unionByName(asked.select("k", "b", "t", F.lit(0).alias("o"), F.col("i").alias("o2"), none.alias("e"), F.col("i").alias("q"), F.col("s").alias("qs")))
    heads = both.groupBy("k", "b").agg(F.min("e").alias("e")).select("k", "b", F.first("e", ignorenulls=True).over(later).alias("_head"))
    found = F.first("e", ignorenulls=True).over(Window.partitionBy("k", "b").orderBy("t", "o", "o2").rowsBetween(0, Window.unboundedFollowing))
    asked = both.withColumn("f", found).where("q is not null").join(heads, ["k", "b"]).withColumn("f", F.coalesce("f", "_head"))
    return asked.select("k", F.col("q").alias("i"), F.col("qs").alias("s"), "f")


def accepted(log: DataFrame, key: str, ts: str, id: str, gap: int, strict: bool = False, signature: str | None = None) -> DataFrame:
    """The log with `accepted`: whether a row is its key's first, or `gap` microseconds or more (strict: more) after the last
    accepted row and, if a signature is named, of another signature than that one. Rows of equal time go by id, which is
    unique; rows without key, time or id are not accepted."""
    k, t, i, s, mark = cluster.fresh(log.columns, "k", "t", "i", "s", "mark")
    own = log.select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(id).alias("i"), (F.col(signature) if signature else F.lit(0)).alias("s"))
    own = cluster.materialize(own.where("k is not null and t is not null and i is not null"), "log")
    next_ = successors(own, gap, strict)
    other = ~F.col("f")["s"].eqNullSafe(F.col("s")) if signature else F.lit(True)
    pointers = cluster.materialize(next_.select("i", F.when(other, F.col("f")["i"]).otherwise(F.col("f")["change"]).alias("n")).where("n is not null"), "pointers")
    reached = cluster.materialize(own.groupBy("k").agg(F.min(F.struct("t", "i")).alias("h")).select(F.col("h")["i"].alias("i")), "reached")
    while pointers.limit(1).count():
        further = reached.unionByName(reached.join(pointers, "i").select(F.col("n").alias("i")))
        twice = pointers.join(pointers.select(F.col("i").alias("n"), F.col("n").alias("m")), "n").select("i", F.col("m").alias("n"))
        reached, pointers = cluster.materialize(further, "reached"), cluster.materialize(twice, "pointers")
    out = log.join(reached.select(F.col("i").alias(i), F.lit(True).alias(mark)), F.col(id) == F.col(i), "left")
    return out.select(*log.columns, F.coalesce(F.col(mark), F.lit(False)).alias("accepted"))


def throttled(log: DataFrame, by: str, hours: int, signature: str) -> DataFrame:
    """Rows that run: at least so many hours after the last run, and of another signature than it."""
    return accepted(log, by, "ts", "event_id", hours * 3_600_000_000, signature=signature).where("accepted").drop("accepted")


def ttl_hits(log: DataFrame, key: str, seconds: int) -> DataFrame:
    """hit: what the key stored at its last miss is at most so old. A hit stores nothing."""
    return accepted(log, key, "ts", "event_id", seconds * 1_000_000, strict=True).withColumn("hit", ~F.col("accepted")).drop("accepted")
