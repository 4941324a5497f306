"""Keyed state over streams: throttles, caches, timers, tasks that pause, and side tables that are read again by age.

State lives in the state store and is written with the offsets, so a query that is stopped or killed goes on where it was; a
batch that is run again starts from the same state. Rows of a key are taken in order of time within a batch.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline import cluster
from loomline.sources import datasets

cluster.ship_by_value(__name__)


def ordered(frames):
    """Rows (t, id, ...) of all frames of a key as tuples, by time and id."""
    return sorted(r for f in frames for r in f.itertuples(index=False, name=None))


def runs(stream: DataFrame, key: str, hours: int, signature: str) -> DataFrame:
    """key and id of the rows that run: so many hours or more after the key's last run, and of another signature than it. The
    stream has ts (timestamp), id (long) and a signature (string). State is one row a key."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    gap = hours * 3_600_000_000

    def fold(k, frames, state):
        import pandas as pd

        last, out = state.get if state.exists else None, []
        for t, i, s in ordered(frames):
            if last is None or t - last[0] >= gap and s != last[1]:
                last = t, s
                out.append(i)
        if last is not None:
            state.update(last)
        yield pd.DataFrame({key: [k[0]] * len(out), "id": out}, dtype="int64")

    own = stream.select(key, F.unix_micros("ts").alias("t"), "id", F.col(signature).alias("s"))
    # the function gets t, id and s: the key comes apart
    return own.groupBy(key).applyInPandasWithState(_without(fold, key), f"{key} long, id long", "t long, s string", "append", GroupStateTimeout.NoTimeout)


def _without(fold, key: str):
    def run(k, frames, state):
        return fold(k, (f.drop(columns=key) for f in frames), state)

    return run


def hits(stream: DataFrame, key: str, seconds: int, delay: str) -> DataFrame:
    """key, id and hit of each row (ts, id): whether the entry that the key's last miss stored is at most so old. A miss
    stores; a hit does not make the entry younger. An entry leaves the state when the watermark, `delay` behind, is past it."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    ttl = seconds * 1_000_000

    def fold(k, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        stored, ids, found = state.get[0] if state.exists else None, [], []
        for t, i in ordered(frames):
            hit = stored is not None and t - stored <= ttl
            stored = stored if hit else t
            ids.append(i)
            found.append(hit)
        over = (stored + ttl) // 1000 + 1
        if over > state.getCurrentWatermarkMs():
            state.update((stored,))
            state.setTimeoutTimestamp(over)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: pd.Series([k[0]] * len(ids), dtype="int64"), "id": pd.Series(ids, dtype="int64"), "hit": pd.Series(found, dtype=bool)})

    own = stream.withWatermark("ts", delay).select(key, "ts", F.unix_micros("ts").alias("t"), "id")
    return own.groupBy(key).applyInPandasWithState(_without(lambda k, frames, state: fold(k, (f.drop(columns="ts") for f in frames), state), key), f"{key} long, id long, hit boolean", "stored long", "append", GroupStateTimeout.EventTimeTimeout)


def reminders(stream: DataFrame, key: str, delay: str) -> DataFrame:
    """key, id and due of reminders (ts, id, due: timestamps) when the watermark, `delay` behind the stream's time, has
    reached them: each once, also if nothing more comes for its key, and over restarts. A key has a timer for its earliest
    reminder, and state only while it has reminders that wait."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def fold(k, frames, state):
        import pandas as pd

        waiting = dict(zip(*state.get)) if state.exists else {}
        for f in frames:
            waiting.update(zip(f["id"].tolist(), f["due"].tolist()))
        now = state.getCurrentWatermarkMs() * 1000
        ready = sorted((d, i) for i, d in waiting.items() if d <= now)
        for _, i in ready:
            del waiting[i]
        if waiting:
            state.update((list(waiting), list(waiting.values())))
            state.setTimeoutTimestamp(-(-min(waiting.values()) // 1000))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: [k[0]] * len(ready), "id": [i for _, i in ready], "due": [d for d, _ in ready]}, dtype="int64")

    own = stream.withWatermark("ts", delay).where("id is not null and due is not null").select(key, "ts", "id", F.unix_micros("due").alias("due"))
    out = own.groupBy(key).applyInPandasWithState(fold, f"{key} long, id long, due long", "ids array<long>, dues array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("due", F.timestamp_micros("due"))


RUNNING, WAITING = "running", "waiting_permission"


def steps(stream: DataFrame, key: str) -> DataFrame:
    """key and id of the steps of tasks that have run, in the order of rows (ts, id, kind). 'ask' makes a task wait for
    permission; what comes while it waits is kept; 'grant' lets it go on, up to the next ask that was kept. Any other kind
    is a step. A grant that nothing waits for does nothing."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def fold(k, frames, state):
        import pandas as pd

        status, ids, kinds = state.get if state.exists else (RUNNING, [], [])
        kept, done = list(zip(ids, kinds)), []

        def go(i, kind):
            nonlocal status
            if kind == "ask":
                status = WAITING
            else:
                done.append(i)

        for _, i, kind in ordered(frames):
            if kind != "grant":
                if status == WAITING:
                    kept.append((i, kind))
                else:
                    go(i, kind)
            elif status == WAITING:
                status = RUNNING
                while kept and status == RUNNING:
                    go(*kept.pop(0))
        state.update((status, [i for i, _ in kept], [x for _, x in kept]))
        yield pd.DataFrame({key: [k[0]] * len(done), "id": done}, dtype="int64")

    own = stream.select(key, F.unix_micros("ts").alias("t"), "id", "kind")
    return own.groupBy(key).applyInPandasWithState(_without(fold, key), f"{key} long, id long", "status string, ids array<long>, kinds array<string>", "append", GroupStateTimeout.NoTimeout)


def state_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state that a query with this checkpoint has stored, a row a key: what a restart goes on from."""
    state = spark.read.format("statestore").load(checkpoint)
    value = "value.groupState.*" if "groupState" in state.select("value.*").columns else "value.*"
    return state.select("key.*", value)


def waiting_tasks(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """key and the ids that are kept of the tasks that wait for permission."""
    return state_of(spark, checkpoint).where(F.col("status") == WAITING).select(key, "ids")


def latest_version(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """Name and table of the last finished version below path; versions are folders that are never changed."""
    done = [v for v in datasets.children(spark, path) if "_SUCCESS" in datasets.children(spark, f"{path}/{v}")]
    return done[-1], spark.read.parquet(f"{path}/{done[-1]}")


def enriched(stream: DataFrame, side: str, on: str, seconds: float, out: str, clock=time.time, **options) -> DataFrame:
    """The stream's rows with the columns of a versioned side table and its version, written to out. The side table's latest
    version is looked up again when it was last looked up so many seconds ago or more; a batch has one version throughout."""
    spark, held = stream.sparkSession, {}

    def batch(df, n):
        now = clock()
        if not held or now - held["at"] >= seconds:
            held["name"], held["table"] = latest_version(spark, side)
            held["at"] = now
        df.join(held["table"], on, "left").withColumn("side_version", F.lit(held["name"])).write.mode("overwrite").parquet(f"{out}/batch={n}")

    writer = stream.writeStream.option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.foreachBatch(batch).start().awaitTermination()
    return spark.read.parquet(out)
