"""Corpora as tables: splits, budgets, mixtures, windows, chats as token streams, sharding of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline import cluster

ROLES = {"user": 257, "assistant": 258}
END, IGNORE = 259, -100
#: Ranges of an order, by key, whose sums are broadcast at most.
BROADCAST_RANGES = 100_000


def running(df: DataFrame, value: Column, order: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Running sum in order, of all rows or within each `by`, in two levels: within contiguous ranges of the order, plus the
    sums of the ranges before. No task sorts all rows, nor all rows of a `by`."""
    spark, by = df.sparkSession, by or []
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_v", value.cast("long")).repartitionByRange(n, order).withColumn("_p", F.spark_partition_id())
    # structs are equal where their fields are both null
    own = cluster.materialize(ranged.withColumn("_k", F.struct("_p", *by)), "ranges")
    before = Window.partitionBy(*[F.col(f"_k.{c}") for c in by]).orderBy("_k._p").rowsBetween(Window.unboundedPreceding, -1)
    # a row a range and `by`
    offsets = own.groupBy("_k").agg(F.sum("_v").alias("s")).select("_k", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_o"))
    within = F.sum("_v").over(Window.partitionBy("_k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    offsets = cluster.small(offsets, BROADCAST_RANGES) if by else F.broadcast(offsets)
    return own.withColumn("_w", within).join(offsets, "_k").withColumn(out, F.col("_w") + F.col("_o")).drop("_p", "_k", "_v", "_w", "_o")


def budget(docs: DataFrame, size: Column, order: str, limit: int) -> DataFrame:
    """Rows in order until the sum of sizes reaches the limit; the row that reaches it is in."""
    return running(docs, size, order, "_upto").where(F.col("_upto") - size < limit).drop("_upto")


def batch_budget(docs: DataFrame, size: Column, order: str, limit: int, batch: int) -> DataFrame:
    """As budget, but the limit is looked at only after each batch of rows."""
    own = running(running(docs, F.lit(1), order, "_rn"), size, order, "_upto")
    group = F.floor((F.col("_rn") - 1) / batch)
    ends = own.groupBy(group.alias("g")).agg(F.max("_upto").alias("end")).where(F.col("end") < limit)
    last = ends.agg(F.coalesce(F.max("g"), F.lit(-1))).first()[0]
    return own.where(group <= last + 1).drop("_rn", "_upto")


def every_nth(docs: DataFrame, order: str, n: int) -> DataFrame:
    """split: every n-th row is for validation."""
    return running(docs, F.lit(1), order, "_rn").withColumn("split", F.when(F.col("_rn") % n == 0, "val").otherwise("train")).drop("_rn")


def interleave(docs: DataFrame, by: str, order: str) -> DataFrame:
    """round: first rows of all sources, then second rows, and so on. A source may hold most of the rows."""
    return running(docs, F.lit(1), order, "round", [by])


def mixture(sizes: DataFrame, fixed: Column) -> DataFrame:
    """weight by source: fixed shares as given, the rest in proportion to size; normalised."""
    everything = Window.partitionBy()
    own = sizes.withColumn("_f", fixed)
    free = F.sum(F.when(F.col("_f").isNull(), F.col("size")).otherwise(0)).over(everything)
    left = F.greatest(1 - F.coalesce(F.sum("_f").over(everything), F.lit(0.0)), F.lit(0.0))
    raw = F.coalesce(F.col("_f"), left * F.col("size") / F.when(free > 0, free))
    own = own.withColumn("_w", raw)
    return own.withColumn("weight", F.round(F.col("_w") / F.sum("_w").over(everything), 6)).drop("_f", "_w")


def chat_tokens(messages: Column) -> Column:
    """Struct (ids, labels): role tag, bytes and end tag of each message; labels only on assistant bytes and their end."""
    from loomline.functions import text as tx

    known = F.filter(messages, lambda m: m["role"].isin(*ROLES))
    tag = lambda m: F.when(m["role"] == "user", ROLES["user"]).otherwise(ROLES["assistant"])
    ids = F.flatten(F.transform(known, lambda m: F.concat(F.array(tag(m)), tx.byte_tokens(m["content"]), F.array(F.lit(END)))))
    labels = F.flatten(F.transform(known, lambda m: F.when(m["role"] == "assistant", F.concat(F.array(F.lit(IGNORE)), tx.byte_tokens(m["content"]), F.array(F.lit(END)))).otherwise(F.array_repeat(F.lit(IGNORE), F.octet_length(m["content"]) + 2))))
    return F.struct(ids.alias("ids"), labels.alias("labels"))


def backward_pack(messages: DataFrame, by: str, order: str, size: Column, limit: int) -> DataFrame:
    """Whole messages from the newest back while they fit; the newest is always in."""
    newest = Window.partitionBy(by).orderBy(F.desc(order))
    own = messages.withColumns({"_back": F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, 0)), "_rn": F.row_number().over(newest)})
    return own.where((F.col("_back") <= limit) | (F.col("_rn") == 1)).drop("_back", "_rn")


def windows(docs: DataFrame, tokens: Column, size: int) -> DataFrame:
    """(doc_id, w, toks): windows of `size` tokens without overlap, the last one shorter."""
    own = docs.select("doc_id", tokens.alias("_t")).where(F.size("_t") > 0)
    return own.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.size("_t") - 1) / size).cast("int"))).alias("w"), "_t").select("doc_id", "w", F.slice("_t", F.col("w") * size + 1, F.lit(size)).alias("toks"))


def frozen_prefix(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first n rows, shared equally by the sources."""
    k = rows.select(by).distinct().count()
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_r") <= n // max(k, 1)).drop("_r")


def split_bytes(files: DataFrame, size: int) -> DataFrame:
    """(path, part, chunk, sha): binary content in parts of `size` bytes."""
    n = F.ceil(F.length("content") / size).cast("int")
    own = files.select("path", "content", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).alias("part"))
    own = own.select("path", "part", F.substring("content", F.col("part") * size + 1, F.lit(size)).alias("chunk"))
    return own.withColumn("sha", F.sha2("chunk", 256))


def join_bytes(parts: DataFrame) -> DataFrame:
    """Whole contents from parts; a part whose hash differs raises."""
    good = F.when(F.sha2("chunk", 256) == F.col("sha"), F.hex("chunk")).otherwise(F.raise_error(F.concat(F.lit("part does not match its hash: "), F.col("path"))).cast("string"))
    own = parts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", good.alias("h")))).alias("p"))
    return own.select("path", F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("content"))
