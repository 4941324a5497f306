"""State changes, routing and decision tables as queries."""

from pyspark.sql import functions as F

from loomline.functions import text as tx
from loomline.operators import decisions as de
from loomline.plans.registry import query


@query("review_decisions", "SELECT state, count(*)::BIGINT AS n, count(edited_from)::BIGINT AS edited FROM (SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'approved' WHEN quality = 0 OR toxic = 1 THEN 'rejected' ELSE 'pending' END AS state, NULL AS edited_from FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'approved', doc_id::VARCHAR FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 1) GROUP BY state")
def review_decisions(t):
    action = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "approve").when((F.col("quality") == 1) & (F.col("toxic") == 1), "edit").otherwise("reject")
    d = t("labels").select("doc_id", action.alias("action"), F.lit("edited text").alias("text"))
    return de.review(t("documents").select("doc_id", "text"), d, "doc_id").groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count("edited_from").alias("edited"))


LEDGER = "(SELECT c_custkey AS version, CASE c_custkey % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'previous' ELSE 'candidate' END AS status, c_acctbal AS value, 'r' || (c_custkey % 2 + 1) AS ruler FROM customer) AS l"


def ledger(t):
    """Customers as versions with a nested measure."""
    k = F.col("c_custkey")
    status = F.when(k % 5 == 0, "active").when(k % 5 == 1, "previous").otherwise("candidate")
    return t("customer").select(k.alias("version"), status.alias("status"), F.struct(F.col("c_acctbal").alias("value"), F.concat(F.lit("r"), (k % 2 + 1).cast("string")).alias("ruler")).alias("probe"))


@query("ledger_activate", f"SELECT version, CASE WHEN version = (SELECT max(c_custkey) FROM customer) THEN 'active' WHEN status = 'active' THEN 'previous' ELSE status END AS status FROM {LEDGER}")
def ledger_activate(t):
    own = ledger(t)
    return de.activate(own, own.agg(F.max("version")).first()[0]).select("version", "status")


@query("ledger_backfill", f"SELECT version, round(value * 2, 4) AS value, CASE WHEN ruler <> 'r2' THEN value END AS old_value FROM {LEDGER}")
def ledger_backfill(t):
    own = de.backfill(ledger(t), "probe", F.round(F.col("probe.value") * 2, 4), "ruler", "r2")
    return own.select("version", F.col("probe.value").alias("value"), F.col("probe_v1.value").alias("old_value"))


HEAD = r"trim(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g'))"


@query("route_candidates", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {HEAD} ORDER BY doc_id) AS r FROM documents WHERE {HEAD} NOT IN (SELECT {HEAD} FROM benchmark)) WHERE r = 1")
def route_candidates(t):
    head = tx.normalize(F.col("text"))
    return de.route(t("documents").select("doc_id", "text"), head, "doc_id", t("benchmark").select(head.alias("q"))).select("doc_id")


@query("failover_answers", "SELECT page_id, coalesce(nullif(trim(regexp_extract(url, '[?&]page=([^&#]*)', 1)), ''), nullif(trim(regexp_extract(url, '#(.*)$', 1)), ''), 'none') AS answer FROM pages")
def failover_answers(t):
    u = F.col("url")
    return t("pages").select("page_id", de.failover(F.regexp_extract(u, r"[?&]page=([^&#]*)", 1), F.regexp_extract(u, r"#(.*)$", 1), F.lit("none")).alias("answer"))


@query("task_outcomes", "WITH s AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type IN ('purchase', 'error')) AS checks, bool_or(event_type = 'purchase' AND value > 95) AS ok FROM events GROUP BY user_id) SELECT user_id, CASE WHEN ok THEN 'verified' WHEN checks > 0 THEN 'failed' ELSE 'open' END AS outcome FROM s")
def task_outcomes(t):
    action = F.when(F.col("event_type") == "purchase", "test").when(F.col("event_type") == "error", "command").otherwise("read")
    return de.task_outcomes(t("events").select("user_id", action.alias("action"), ((F.col("event_type") == "purchase") & (F.col("value") > 95)).alias("ok")), "user_id")


PHASE = "['understand', 'plan', 'implement', 'test', 'analyze', 'fix', 'review', 'done']"


@query("phase_machine", f"SELECT event_id, phase, ok, CASE WHEN phase = 'analyze' AND ok THEN 'review' WHEN phase = 'fix' THEN 'test' ELSE {PHASE}[least(event_id % 8 + 2, 8)] END AS following FROM (SELECT event_id, {PHASE}[event_id % 8 + 1] AS phase, value > 50 AS ok FROM events)")
def phase_machine(t):
    rows = t("events").select("event_id", F.element_at(F.array(*map(F.lit, de.PHASES)), (F.col("event_id") % 8 + 1).cast("int")).alias("phase"), (F.col("value") > 50).alias("ok"))
    return rows.withColumn("following", de.next_phase(F.col("phase"), F.col("ok")))


@query("call_arguments", """SELECT page_id, regexp_extract(html, '\\w+="([^"]*)"', 1) AS first_value, len(list_distinct(regexp_extract_all(html, '(\\w+)="([^"]*)"', 1)))::BIGINT AS keys FROM pages""")
def call_arguments(t):
    pairs = F.regexp_extract_all("html", F.lit(r'(\w+)="([^"]*)"'), F.lit(1))
    return t("pages").select("page_id", F.regexp_extract("html", r'\w+="([^"]*)"', 1).alias("first_value"), F.size(F.array_distinct(pairs)).cast("long").alias("keys"))


@query("call_map", """SELECT page_id, len(list_distinct(regexp_extract_all(html, '(\\w+)="([^"]*)"', 1)))::BIGINT AS keys, regexp_extract_all(html, '\\bhref="([^"]*)"', 1)[-1] AS href FROM pages""")
def call_map(t):
    """Arguments of all tags of a page as one map; a page names most keys more than once."""
    return t("pages").select("page_id", de.arguments(F.col("html")).alias("m")).select("page_id", F.size("m").cast("long").alias("keys"), F.try_element_at("m", F.lit("href")).alias("href"))


@query("progress_eta", "WITH p AS (SELECT user_id, event_id, ts, event_id - lag(event_id) OVER w AS ds, epoch_us(ts) / 1e6::DOUBLE - lag(epoch_us(ts) / 1e6::DOUBLE) OVER w AS dt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, round(ds / nullif(dt, 0), 6) AS rate, round((100000 - event_id) / nullif(ds / nullif(dt, 0), 0), 2) AS \"left\" FROM p")
def progress_eta(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    own = de.progress(e, "user_id", "event_id", F.col("event_id"), F.unix_micros("ts") / 1e6, 100_000)
    return own.select("event_id", F.round("rate", 6).alias("rate"), F.round("left", 2).alias("left"))


@query("cache_eviction", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 2")
def cache_eviction(t):
    return de.evict(t("events"), "user_id", "event_id", 2).select("user_id", "event_id")


@query("growth_plan", "SELECT p_partkey, i::INT AS layer, (i * p_size // (p_size + 5))::INT AS source FROM part, (SELECT unnest(range(0, 100)) AS i) WHERE i < p_size + 5")
def growth_plan(t):
    """Models of p_size layers grow by five."""
    own = t("part").select("p_partkey", de.growth(F.col("p_size"), F.col("p_size") + 5).alias("plan"))
    return own.select("p_partkey", F.posexplode("plan").alias("layer", "source"))


@query("soft_loss", "WITH x AS (SELECT l_orderkey, l_tax AS p, l_discount * 10 / 2.0::DOUBLE AS l FROM lineitem), z AS (SELECT *, max(l) OVER (PARTITION BY l_orderkey) + ln(sum(exp(l - m)) OVER (PARTITION BY l_orderkey)) AS z FROM (SELECT *, max(l) OVER (PARTITION BY l_orderkey) AS m FROM x)) SELECT l_orderkey, round(-sum(p * (l - z)) * 4, 6) AS loss FROM z GROUP BY l_orderkey")
def soft_loss(t):
    own = de.soft_cross_entropy(t("lineitem"), ["l_orderkey"], F.col("l_tax"), F.col("l_discount") * 10, 2.0)
    return own.select("l_orderkey", F.round("loss", 6).alias("loss"))


@query("relative_due", """SELECT event_id, strftime(CASE event_id % 5 WHEN 0 THEN ts + to_minutes(event_id % 90 + 1) WHEN 1 THEN ts + to_hours(event_id % 30 + 1) WHEN 2 THEN ts + to_days((event_id % 20 + 1)::INT) WHEN 3 THEN date_trunc('day', ts) + INTERVAL 1 DAY + to_hours(event_id % 24) END, '%Y-%m-%d %H:%M') AS due FROM events""")
def relative_due(t):
    i = F.col("event_id")
    said = [F.concat(F.lit("call me in "), i % 90 + 1, F.lit(" minutes")), F.concat(F.lit("in "), i % 30 + 1, F.lit(" hours")), F.concat(F.lit("in "), i % 20 + 1, F.lit(" days")), F.concat(F.lit("tomorrow at "), i % 24), F.lit("whenever")]
    rows = t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.element_at(F.array(*said), (i % 5 + 1).cast("int")).alias("c"))
    return rows.select("event_id", F.date_format(de.relative_due(F.col("c"), F.col("ts")), "yyyy-MM-dd HH:mm").alias("due"))


@query("list_edits", "SELECT c_custkey, (2 + c_custkey % 2)::BIGINT AS inserted, (2 - (c_custkey % 3 = 0)::INT)::BIGINT AS deleted FROM customer")
def list_edits(t):
    """Lists of two items by customer; an item with the same normal form is not added, and is deleted."""
    k, items = F.col("c_custkey"), F.array("c_mktsegment", "c_name")
    new = F.when(k % 2 == 0, F.concat(F.lit("  "), F.upper("c_mktsegment"))).otherwise("other")
    old = F.when(k % 3 == 0, F.lower("c_name")).otherwise("another")
    return t("customer").select("c_custkey", F.size(de.set_insert(items, new, tx.normalize)).cast("long").alias("inserted"), F.size(de.set_delete(items, old, tx.normalize)).cast("long").alias("deleted"))


TAGS = "list_distinct(list_concat(list_filter(['discount', 'desconto', 'sketch', 'pytest', 'async', 'rag', 'permission'], lambda w: contains(lower(x), w)), list_transform(list_filter(f, lambda n: n LIKE '%.py' OR n LIKE '%.cs'), lambda n: CASE WHEN n LIKE '%.py' THEN 'python' ELSE 'csharp' END)))"


@query("entry_tags", f"SELECT conv_id, turn, array_to_string(list_sort({TAGS}), ',') AS tags FROM (SELECT conv_id, turn, text || [' Discount', ' async sketch', '', ' rag'][conv_id % 4 + 1] AS x, [['a.py', 'b.cs', 'c.py'], ['d.txt'], ['e.cs'], []][turn % 4 + 1] AS f FROM conversations)")
def entry_tags(t):
    files = F.element_at(F.array(F.array(F.lit("a.py"), F.lit("b.cs"), F.lit("c.py")), F.array(F.lit("d.txt")), F.array(F.lit("e.cs")), F.array().cast("array<string>")), (F.col("turn") % 4 + 1).cast("int"))
    more = F.element_at(F.array(*map(F.lit, [" Discount", " async sketch", "", " rag"])), (F.col("conv_id") % 4 + 1).cast("int"))
    return t("conversations").select("conv_id", "turn", F.array_join(F.array_sort(de.tags(F.concat("text", more), files)), ",").alias("tags"))


@query("usage_arrays", "SELECT source AS version, doc_id // 1000 AS block, list(doc_id ORDER BY doc_id) AS ids FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY ALL")
def usage_arrays(t):
    used = t("documents").select("doc_id", F.col("source").alias("version")).join(t("labels").where("quality = 1").select("doc_id"), "doc_id")
    return de.usage(used, "version", "doc_id", 1000)


@query("model_lines", "SELECT p_partkey, CASE WHEN p < 10000000 THEN 'nano' WHEN p < 100000000 THEN 'small' WHEN p < 1000000000 THEN 'base' ELSE 'large' END AS line, CASE WHEN p_size >= 40 THEN 64 WHEN p_size >= 20 THEN 32 WHEN p_size >= 10 THEN 16 ELSE 8 END AS batch FROM (SELECT p_partkey, p_size, p_partkey * 4000000 AS p FROM part)")
def model_lines(t):
    return t("part").select("p_partkey", de.model_line(F.col("p_partkey") * 4_000_000).alias("line"), de.batch_plan(F.col("p_size"))["batch"].alias("batch"))


@query("compare_models", "SELECT user_id, max(value) FILTER (WHERE event_type = 'view') AS a, max(value) FILTER (WHERE event_type = 'click') AS b, CASE WHEN max(value) FILTER (WHERE event_type = 'view') > max(value) FILTER (WHERE event_type = 'click') THEN 'a' WHEN max(value) FILTER (WHERE event_type = 'click') IS NULL THEN 'a' ELSE 'b' END AS verdict FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id")
def compare_models(t):
    p = t("events").where(F.col("event_type").isin("view", "click")).groupBy("user_id").pivot("event_type", ["view", "click"]).agg(F.max("value"))
    return p.select("user_id", F.col("view").alias("a"), F.col("click").alias("b"), F.when(F.col("view") > F.col("click"), "a").when(F.col("click").isNull(), "a").otherwise("b").alias("verdict"))


@query("verdict_counts", "SELECT toxic AS verdict, count(*)::BIGINT AS n FROM labels WHERE toxic IS NOT NULL GROUP BY toxic")
def verdict_counts(t):
    return t("labels").where("toxic is not null").groupBy(F.col("toxic").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("repeat_corpus", "SELECT count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars FROM (SELECT text FROM conversations, range(0, 3) UNION ALL SELECT unnest(string_split(text, chr(10))) FROM documents) WHERE length(text) > 20")
def repeat_corpus(t):
    chats = t("conversations").select("text", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select("text")
    lines = t("documents").select(F.explode(F.split("text", "\n", -1)).alias("text"))
    return chats.union(lines).where(F.length("text") > 20).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("note_search", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) AS r FROM conversations WHERE contains(strip_accents(lower(text)), 'the') AND contains(strip_accents(lower(text)), 'and')) WHERE r <= 10")
def note_search(t):
    from pyspark.sql.window import Window

    n = tx.strip_accents(F.lower("text"))
    hits = t("conversations").where(F.forall(F.array(F.lit("the"), F.lit("and")), lambda w: n.contains(w)))
    return hits.withColumn("r", F.row_number().over(Window.partitionBy("role").orderBy(F.desc("conv_id"), F.desc("turn")))).where("r <= 10").select("conv_id", "turn")


@query("vocab_map", "WITH v AS (SELECT tok, (row_number() OVER (ORDER BY tok) - 1)::BIGINT AS id FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS tok FROM benchmark)), w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS tok FROM documents) SELECT w.tok, coalesce(v.id, -1) AS id FROM w LEFT JOIN v USING (tok)")
def vocab_map(t):
    from loomline.plans.corpora import vocabulary

    words = t("documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("tok")).distinct()
    return words.join(vocabulary(t), "tok", "left").select("tok", F.coalesce("id", F.lit(-1)).alias("id"))


@query("durations", "SELECT user_id, round(epoch(max(ts)) - epoch(min(ts)), 3) AS seconds FROM events GROUP BY user_id")
def durations(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return e.select("user_id", F.round((F.unix_micros("b") - F.unix_micros("a")) / 1e6, 3).alias("seconds"))
