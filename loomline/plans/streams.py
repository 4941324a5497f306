"""Windows, state and time over events; streams with batch twins."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline import cluster
from loomline.cluster import table
from loomline.operators import chains
from loomline.plans.registry import ORACLES, QUERIES, query
from loomline.streaming import stateful
from loomline.streaming import streams as st

FMT = "'%Y-%m-%d %H:%M:%S'"


def ev(t):
    return st.events(t("events"))


def stream(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


TUMBLE = f"SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), {FMT}) AS w_start, strftime(time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY, {FMT}) AS w_end, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


@query("tumbling_counts", TUMBLE)
def tumbling_counts(t):
    return st.flat_window(st.tumbling(ev(t), "1 day"))


@stream("stream_tumbling", TUMBLE)
def stream_tumbling(spark, sf_dir):
    return st.flat_window(st.drain(st.tumbling(st.event_stream(spark, sf_dir).withWatermark("ts", "1 hour"), "1 day"), "complete"))


@query("sliding_counts", f"SELECT strftime(s, {FMT}) AS w_start, strftime(s + INTERVAL 2 HOUR, {FMT}) AS w_end, event_type, count(*)::BIGINT AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY ALL")
def sliding_counts(t):
    return st.flat_window(st.sliding(ev(t), "2 hours", "1 hour"))


@query("session_counts", f"WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true)::INT AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT strftime(min(ts), {FMT}) AS w_start, strftime(max(ts) + INTERVAL 30 MINUTE, {FMT}) AS w_end, user_id, count(*)::BIGINT AS n FROM s GROUP BY user_id, k")
def session_counts(t):
    return st.flat_window(st.sessions(ev(t), "30 minutes"))


@query("session_history", "WITH g AS (SELECT user_id, event_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true)::INT AS new FROM events) SELECT user_id, count(*)::BIGINT AS n, sum(new)::BIGINT AS sessions FROM g GROUP BY user_id")
def session_history(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))
    g = ev(t).withColumn("new", F.coalesce((gap >= 1_800_000_000).cast("int"), F.lit(1)))
    return g.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("new").alias("sessions"))


@stream("stream_dedupe", "SELECT event_type, count(*)::BIGINT AS n FROM (SELECT DISTINCT event_id, event_type FROM events) GROUP BY event_type")
def stream_dedupe(spark, sf_dir):
    s = st.event_stream(spark, sf_dir)
    twice = s.union(s)  # every event arrives twice
    return st.drain(st.deduplicated(twice, ["event_id"], "2 days").select("event_id", "event_type")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@stream("stream_static_enrich", "SELECT c_mktsegment, count(*)::BIGINT AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY c_mktsegment")
def stream_static_enrich(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = st.event_stream(spark, sf_dir).join(c, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_mktsegment")
    return st.drain(joined).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@stream("stream_user_state", "SELECT user_id, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_user_state(spark, sf_dir):
    out = st.drain(st.user_totals(st.event_stream(spark, sf_dir)), "update", ["user_id"])
    return out.select("user_id", "n", F.round("total", 4).alias("total"))


@stream("stream_reminders", "SELECT user_id, event_id AS id FROM events WHERE value < 10")
def stream_reminders(spark, sf_dir):
    s = st.event_stream(spark, sf_dir)
    polls = s.union(s).select("user_id", F.col("event_id").alias("id"), F.col("value").alias("due"), F.lit(9.9999999).alias("now"))  # polled twice
    return st.drain(st.fire_once(polls)).select("user_id", "id")


@query("due_reminders", "SELECT event_id FROM events WHERE ts + to_seconds(value::BIGINT) <= TIMESTAMP '2024-01-10 00:00:00' AND event_type <> 'error'")
def due_reminders(t):
    deadline = F.timestamp_micros(F.unix_micros("ts") + F.bround("value").cast("long") * 1_000_000)
    return st.due(ev(t).where("event_type <> 'error'"), F.lit("2024-01-10 00:00:00").cast("timestamp"), deadline).select("event_id")


def greedy(gap: str, after: str, other: str = "") -> str:
    """Rows (event_id) of events that are accepted one after the other, each only against the one before."""
    return f"""WITH RECURSIVE r AS (SELECT user_id, min((ts, event_id, event_type)) AS x FROM events GROUP BY user_id
UNION ALL SELECT r.user_id, min((e.ts, e.event_id, e.event_type)) FROM r JOIN events e ON e.user_id = r.user_id AND e.ts {after} r.x[1] + INTERVAL {gap} {other} GROUP BY r.user_id)
SELECT x[2] AS event_id FROM r"""


TTL = f"SELECT user_id, count(*)::BIGINT AS n, count(*) FILTER (WHERE event_id NOT IN ({greedy('1 HOUR', '>')}))::BIGINT AS hits FROM events GROUP BY user_id"
THROTTLE = greedy("12 HOUR", ">=", "AND e.event_type <> r.x[3]")


@query("ttl_cache_hits", TTL)
def ttl_cache_hits(t):
    return chains.ttl_hits(ev(t), "user_id", 3600).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("int")).alias("hits"))


@query("throttle_runs", THROTTLE)
def throttle_runs(t):
    return chains.throttled(ev(t), "user_id", 12, "event_type").select("event_id")


@stream("stream_cache_hits", TTL)
def stream_cache_hits(spark, sf_dir):
    s = st.event_stream(spark, sf_dir).withColumnRenamed("event_id", "id")
    return st.drain(stateful.hits(s, "user_id", 3600, "1 hour")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("int")).alias("hits"))


@stream("stream_throttle", THROTTLE)
def stream_throttle(spark, sf_dir):
    s = st.event_stream(spark, sf_dir).withColumnRenamed("event_id", "id")
    return st.drain(stateful.runs(s, "user_id", 12, "event_type")).select(F.col("id").alias("event_id"))


@stream("stream_timers", "SELECT user_id, event_id AS id FROM events WHERE ts + to_microseconds(CAST(round(value) AS BIGINT) * 60000000) <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)")
def stream_timers(spark, sf_dir):
    """Reminders some minutes after their event; they fire as the stream's time passes them."""
    s = st.event_stream(spark, sf_dir).withColumn("due", F.timestamp_micros(F.unix_micros("ts") + F.round("value").cast("long") * 60_000_000))
    return st.drain(stateful.reminders(s.withColumnRenamed("event_id", "id"), "user_id", "1 hour")).select("user_id", "id")


@stream("stream_ingest", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def stream_ingest(spark, sf_dir):
    """Batches of files until a sum is reached; one file is one batch, which is taken whole."""
    path = cluster.scratch_path(spark, "ingest")
    out = st.ingest(st.event_stream(spark, sf_dir), path, F.col("value"), 1000)
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@stream("stream_tasks")
def stream_tasks(spark, sf_dir):
    """Users as tasks: errors ask for permission, signups grant it, all else are steps."""
    kind = F.when(F.col("event_type") == "error", "ask").when(F.col("event_type") == "signup", "grant").otherwise("step")
    s = st.event_stream(spark, sf_dir).withColumn("kind", kind).withColumnRenamed("event_id", "id")
    return st.drain(stateful.steps(s, "user_id"))


@stream("stream_refreshed_side", "SELECT c_mktsegment, count(*)::BIGINT AS n, 'v1' AS side_version FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY c_mktsegment")
def stream_refreshed_side(spark, sf_dir):
    side = cluster.scratch_path(spark, "side")
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment").write.parquet(f"{side}/v1")
    out = stateful.enriched(st.event_stream(spark, sf_dir), side, "user_id", 20.0, cluster.scratch_path(spark, "enriched"))
    return out.groupBy("c_mktsegment", "side_version").agg(F.count(F.lit(1)).alias("n"))


@query("run_detect", "WITH g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events) SELECT user_id, event_type, count(*)::BIGINT AS length, min(event_id) AS first_id FROM g GROUP BY user_id, event_type, g HAVING count(*) >= 3")
def run_detect(t):
    return st.runs_of(ev(t), "user_id", ["ts", "event_id"], "event_type", 3)


@query("latest_per_key", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_per_key(t):
    return ev(t).groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("r")).select("user_id", "r.event_id", "r.event_type")


@query("tail_last_n", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 4")
def tail_last_n(t):
    return t("events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))).where("r <= 4").select("event_id", "user_id")


@query("asof_last_event", "WITH p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts), c AS (SELECT * FROM events WHERE event_type = 'click') SELECT c.event_id, p.value AS last_value FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts")
def asof_last_event(t):
    e = ev(t)
    p = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return st.asof(e.where("event_type = 'click'").select("user_id", "ts", "event_id"), p, "user_id", "ts", "value").select("event_id", "last_value")


@query("checkpoint_restore", "SELECT user_id, arg_min(event_type, event_id) AS restored FROM events GROUP BY user_id")
def checkpoint_restore(t):
    return t("events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("restored"))


@query("checkpoint_rollback", """WITH e AS (SELECT user_id AS path, event_id, event_id // 1000 AS cp, event_type AS content, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
last AS (SELECT max(cp) AS cp FROM e), snap AS (SELECT path, arg_min({'b': before}, event_id).b AS before FROM e WHERE cp = (SELECT cp FROM last) GROUP BY path),
state AS (SELECT path, arg_max(content, event_id) AS content FROM e GROUP BY path)
SELECT path, coalesce(s.before, state.content) AS content, CASE WHEN s.path IS NULL THEN 'kept' WHEN s.before IS NULL THEN 'deleted' ELSE 'restored' END AS action FROM state LEFT JOIN snap s USING (path)""".replace("coalesce(s.before, state.content)", "CASE WHEN s.path IS NULL THEN state.content ELSE s.before END"))
def checkpoint_rollback(t):
    """Events as edits of a path by user, a thousand a checkpoint; the last checkpoint is undone."""
    from loomline.sources import checkpoints

    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    edits = t("events").select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 1000).alias("checkpoint"), before.alias("before")).withColumn("existed", F.col("before").isNotNull())
    state = t("events").groupBy(F.col("user_id").alias("path")).agg(F.max_by("event_type", "event_id").alias("content"))
    after, actions = checkpoints.rollback(state, checkpoints.snapshots(edits))
    both = after.join(actions, "path", "full")
    return both.select("path", "content", F.coalesce("action", F.lit("kept")).alias("action"))


@query("distinct_sessions", "SELECT count(*)::BIGINT AS n, (SELECT count(*) FROM (SELECT DISTINCT CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END FROM events))::BIGINT AS sessions FROM events")
def distinct_sessions(t):
    key = F.when(F.col("user_id") % 10 != 0, F.col("user_id"))  # a null counts once
    return t("events").agg(F.count(F.lit(1)).alias("n"), (F.count_distinct(key) + F.max(key.isNull().cast("int"))).alias("sessions"))
