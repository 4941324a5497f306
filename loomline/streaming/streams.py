"""Structured Streaming over append logs, and the batch twins of the same plans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomline import cluster
from loomline.sources import datasets


def events(df: DataFrame) -> DataFrame:
    """Event time as a timestamp with zone, which watermarks need."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = cluster.table(spark, sf_dir, "events").schema
    return events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def drain(stream: DataFrame, mode: str = "append", key: list[str] | None = None, to: str | None = None) -> DataFrame:
    """Run a stream over all that is there and return what it wrote. A batch is a folder of its own, so one that is run again
    replaces itself. In update mode a batch has only what changed: with a key, the latest batch's row of a key counts. In
    complete mode the last batch is the result. With `to`, a stream goes on where an earlier one with that folder ended."""
    spark, schema = stream.sparkSession, stream.schema
    out = to or cluster.scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", out + "-state").trigger(availableNow=True)
    query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    query.awaitTermination()
    if not datasets.children(spark, out):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    elif key:
        rows = rows.groupBy(*key).agg(F.max_by(F.struct(*schema.names), "batch").alias("_r")).select("_r.*")
    return rows.select(*schema.names)


def ingest(stream: DataFrame, path: str, size, most: int) -> DataFrame:
    """Append micro-batches to path until the sum of the column `size` reaches `most`; the batch that reaches it is whole and
    the last, later ones are not read. A batch is a folder of its own, so one that is run again replaces itself, and what was
    written before a restart counts. How many files are a batch is the reader's option maxFilesPerTrigger."""
    spark, schema = stream.sparkSession, stream.schema

    def written(but: str | None = None):
        own = [b for b in datasets.children(spark, path) if b.startswith("batch-") and b != but and "_SUCCESS" in datasets.children(spark, f"{path}/{b}")]
        return spark.read.schema(schema).parquet(*[f"{path}/{b}" for b in own]) if own else spark.createDataFrame([], schema)

    def batch(df, n):
        name = f"batch-{n:09d}"
        if (written(name).agg(F.sum(size)).first()[0] or 0) < most:
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    stream.writeStream.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    return written()


def tumbling(df: DataFrame, width: str) -> DataFrame:
    return df.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sliding(df: DataFrame, width: str, step: str) -> DataFrame:
    return df.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(df: DataFrame, gap: str) -> DataFrame:
    return df.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def flat_window(df: DataFrame) -> DataFrame:
    """Bounds of the window w as text."""
    f = "yyyy-MM-dd HH:mm:ss"
    return df.select(F.date_format("w.start", f).alias("w_start"), F.date_format("w.end", f).alias("w_end"), *[c for c in df.columns if c != "w"])


def deduplicated(stream: DataFrame, key: list[str], delay: str) -> DataFrame:
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


STATE = T.StructType([T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType())])
TOTALS = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType())])


def user_totals(stream: DataFrame) -> DataFrame:
    """Running count and sum by user, kept in the state store (update mode: the latest row of a user counts)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def fold(key, frames, state):
        import pandas as pd

        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return stream.groupBy("user_id").applyInPandasWithState(fold, TOTALS, STATE, "update", GroupStateTimeout.NoTimeout)


FIRED = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("id", T.LongType())])


def fire_once(stream: DataFrame, keep: float | None = None) -> DataFrame:
    """Reminders (user_id, id, due, now) that are due, each once: the ids that have fired are kept in the state store by
    user, so a restart or a repeated poll does not fire them again. With `keep`, a reminder that is overdue by more than
    that does not fire any more, and its id is forgotten, so a user's state does not grow for ever."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def poll(key, frames, state):
        import pandas as pd

        ids, dues, latest = state.get if state.exists else ([], [], float("-inf"))
        fired, new = dict(zip(ids, dues)), []
        for f in frames:
            latest = max(latest, float(f["now"].max()))
            ready = f["due"] <= f["now"]
            if keep is not None:
                ready &= f["due"] >= f["now"] - keep
            for i, d in zip(f.loc[ready, "id"].tolist(), f.loc[ready, "due"].tolist()):
                if i not in fired:
                    fired[i] = d
                    new.append(i)
        if keep is not None:
            fired = {i: d for i, d in fired.items() if d >= latest - keep}
        state.update((list(fired), list(fired.values()), latest))
        yield pd.DataFrame({"user_id": [key[0]] * len(new), "id": new}, dtype="int64")

    return stream.groupBy("user_id").applyInPandasWithState(poll, FIRED, "fired array<long>, dues array<double>, latest double", "append", GroupStateTimeout.NoTimeout)


def due(log: DataFrame, now, deadline) -> DataFrame:
    return log.where(deadline <= now)


def _blocked(log: DataFrame, by: str, ts: str, seconds: int) -> DataFrame:
    """log with _k, the key and its block of time; blocks are ordered, and rows without time are in the first one. Windows over
    _k hold a block of a key at most; structs are equal where their fields are both null."""
    block = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))
    return log.withColumn("_k", F.struct(F.col(by).alias("key"), F.coalesce(block, F.lit(-(1 << 62))).alias("block")))


def runs_of(log: DataFrame, by: str, order: list[str], value: str, least: int, block: int = 3600) -> DataFrame:
    """Runs of at least `least` equal values in a row (gaps and islands), and the least of the last order column in each. The
    first order column is a time. Islands are found in blocks of so many seconds; only those at a block's ends, two a block
    at most, can go on in another block and meet by key, so a key with many rows is many tasks."""
    at = F.struct(*order)
    inside = Window.partitionBy("_k").orderBy("_at")
    own = _blocked(log.select(by, *order, value), by, order[0], block).select("_k", at.alias("_at"), F.col(value).alias("_v"), F.col(order[-1]).alias("_id"))
    own = own.withColumn("_g", F.row_number().over(inside) - F.row_number().over(Window.partitionBy("_k", "_v").orderBy("_at")))
    islands = own.groupBy("_k", "_v", "_g").agg(F.count(F.lit(1)).alias("length"), F.min("_id").alias("first_id"), F.min("_at").alias("_a"), F.max("_at").alias("_b"))
    whole = Window.partitionBy("_k")
    islands = islands.withColumns({"_first": F.col("_a") == F.min("_a").over(whole), "_last": F.col("_b") == F.max("_b").over(whole)})
    islands = islands.where(F.col("_first") | F.col("_last") | (F.col("length") >= least))
    edge = F.col("_first") | F.col("_last")
    done = islands.where(~edge).select("_k.key", "_v", "length", "first_id")
    line = Window.partitionBy("_k.key").orderBy("_k.block", "_a")
    before = F.lag(F.struct("_v")).over(line)
    begins = ~F.col("_first") | before.isNull() | ~before["_v"].eqNullSafe(F.col("_v"))
    met = islands.where(edge).withColumn("_new", begins).withColumn("_run", F.sum(F.col("_new").cast("int")).over(line))
    met = met.groupBy("_k.key", "_v", "_run").agg(F.sum("length").alias("length"), F.min("first_id").alias("first_id")).where(F.col("length") >= least)
    return done.unionByName(met.select("key", "_v", "length", "first_id")).select(F.col("key").alias(by), F.col("_v").alias(value), "length", "first_id")


def asof(left: DataFrame, right: DataFrame, by: str, ts: str, value: str, block: int = 86_400) -> DataFrame:
    """left with the value of the latest right row at or before its time, of the same key; of right rows of one time, the
    greatest value. No range join: the union is sorted in blocks of so many seconds, and what a block ends with is handed on
    over one row a block and key, so a key with many rows is many tasks."""
    kind = right.schema[value].dataType
    asked = _blocked(left.select(by, ts, F.struct(*left.columns).alias("_l")), by, ts, block).select("_k", ts, "_l", F.lit(None).cast(kind).alias("_v"), F.lit(1).alias("_o"))
    known = _blocked(right.select(by, ts, value).where(F.col(value).isNotNull()), by, ts, block).select("_k", ts, F.lit(None).cast(asked.schema["_l"].dataType).alias("_l"), F.col(value).alias("_v"), F.lit(0).alias("_o"))
    # blocks in which something is asked or known; a row each
    ends = asked.select("_k", F.lit(None).cast(known.select(F.struct(ts, "_v").alias("e")).schema["e"].dataType).alias("e")).unionByName(known.select("_k", F.struct(ts, "_v").alias("e"))).groupBy("_k").agg(F.max("e").alias("e"))
    earlier = Window.partitionBy("_k.key").orderBy("_k.block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_k", F.last("e", ignorenulls=True).over(earlier)["_v"].alias("_before"))
    inside = Window.partitionBy("_k").orderBy(ts, "_o", "_v").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(known).withColumn("_last", F.last("_v", ignorenulls=True).over(inside)).where("_l is not null")
    return both.join(ends, "_k").select("_l.*", F.coalesce("_last", "_before").alias(f"last_{value}"))
