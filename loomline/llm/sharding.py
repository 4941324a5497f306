"""Longest-processing-time sharding: groups that must stay together, largest first, each to the least loaded shard.

Only sizes matter to the heap, so it runs over the distinct group sizes and their counts, not over the groups: sizes that
differ and sum to B bytes are at most sqrt(2 B) many (14 million for 100 TB). They come to the driver as a sorted stream
and their places are written in blocks of BLOCK sizes, so it holds one block and the loads. All groups of one size are
placed in one step: where there are more of them than shards, the heap's outcome for equal items is
computed by filling the shards to a level. Which group gets which place is its gapless rank within its size.

Law: `bytes`. Groups are equal texts (a null text is a group of its own, apart from the empty text).

Defined cases: null text has size 16 and the CRC of no bytes; repeated rows are rows of their own with slots of their own;
an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline import cluster

SHARDS = 40
OVERHEAD = 16
#: Groups of one size, or rows of one shard, that are ranked in one task on average.
RANKED = 20_000
#: Sizes whose places the driver holds at a time, and runs (about 40 bytes each) up to which the places are broadcast.
BLOCK, BROADCAST_RUNS = 50_000, 100_000


def place_equal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` items of one size each shard gets when each goes to the least loaded (then first) shard."""
    k, given = len(loads), [0] * len(loads)
    if count > 2 * k:
        # the level that the loads reach when all but about k of the items are placed
        below, above = min(loads), max(loads) + size * count
        held = lambda level: sum((level - x + size - 1) // size for x in loads if x < level)
        while above - below > 1:
            mid = (below + above) // 2
            below, above = (mid, above) if held(mid) <= count - k else (below, mid)
        given = [max(0, (below - x + size - 1) // size) for x in loads]
    heap = [(x + g * size, j) for j, (x, g) in enumerate(zip(loads, given))]
    heapq.heapify(heap)
    for _ in range(count - sum(given)):
        load, j = heap[0]
        given[j] += 1
        heapq.heapreplace(heap, (load + size, j))
    return given


def plan(sizes, shards: int):
    """For (size, groups of that size) in falling order of size: (size, runs), where runs are (shard, rank below which
    groups go there) in order."""
    loads = [0] * shards
    for size, count in sizes:
        upto, runs = 0, []
        for j, n in enumerate(place_equal(loads, size, count)):
            if n:
                upto += n
                runs.append((j, upto))
                loads[j] += n * size
        yield size, runs


def places(counted: DataFrame, shards: int) -> tuple[DataFrame, bool]:
    """bytes and runs, from one row a size with bytes and n; and whether they are few enough to be broadcast."""
    spark, schema = counted.sparkSession, "bytes long, runs array<struct<shard:int,upto:long>>"
    path, block, n_runs, blocks = None, [], 0, 0

    def put():
        nonlocal path, blocks
        path = path or cluster.scratch_path(spark, "places")
        spark.createDataFrame(block, schema).write.mode("append").parquet(path)
        block.clear()
        blocks += 1

    for size, runs in plan(((r.bytes, r.n) for r in counted.orderBy(F.desc("bytes")).toLocalIterator()), shards):
        block.append((size, runs))
        n_runs += len(runs)
        if len(block) >= BLOCK:
            put()
    if blocks:
        put()
    table = spark.read.schema(schema).parquet(path) if blocks else spark.createDataFrame(block, schema)
    return table, n_runs <= BROADCAST_RUNS


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw).cast("long") + OVERHEAD).alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), F.coalesce(F.unhex(F.sha2(F.col("text").cast("string").cast("binary"), 256)), F.unhex(F.lit(""))).alias("key"))
    own = cluster.materialize(own, "rows")
    groups = cluster.materialize(own.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("copies")), "groups")
    counted = cluster.materialize(groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("rows")), "sizes")
    total, most = counted.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("n"), F.lit(1))).first()
    table, few = places(counted, shards)
    ranked = cluster.gapless_rank(groups, ["bytes"], [F.col("key")], "rank", max(1, -(-most // RANKED)))
    # one size may have most of the groups
    if few:
        ranked = ranked.join(F.broadcast(table), "bytes")
    else:
        ranked = cluster.lookup(ranked, table.join(counted.select("bytes", "n"), "bytes"), "bytes", "n", groups.count(), F.col("key"))
    placed = ranked.select("key", "copies", F.filter("runs", lambda r: r["upto"] > F.col("rank"))[0]["shard"].alias("shard"))
    rows = cluster.lookup(own, placed, "key", "copies", total, F.struct("doc_id", "text_crc32"))
    rows = cluster.materialize(rows.select("doc_id", "size", "text_crc32", "shard"), "placed")
    slots = cluster.gapless_rank(rows, ["shard"], [F.col("doc_id"), F.col("size"), F.col("text_crc32")], "slot", max(4, -(-total // (shards * RANKED))))
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir):
    return assign(cluster.table(spark, sf_dir, "documents"))
