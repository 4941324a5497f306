"""Evaluation metrics, gates and ledgers."""

from pyspark.sql import functions as F

from loomline.functions import text as tx
from loomline.operators import evaluation as ev
from loomline.plans.registry import query


def judged(t):
    return t("documents").select("doc_id", "lang", "source").join(t("labels"), "doc_id")


@query("eval_by_category", "SELECT lang, count(*)::BIGINT AS items, round(avg(quality), 4) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def eval_by_category(t):
    return ev.accuracy(judged(t), F.col("quality"), [["lang"]], ["lang"])


@query("eval_grouping_sets", "SELECT lang, source, count(*)::BIGINT AS items, round(avg(quality), 4) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), ())")
def eval_grouping_sets(t):
    return ev.accuracy(judged(t), F.col("quality"), [["lang"], ["source"], []], ["lang", "source"])


@query("eval_slices", "SELECT round(avg(quality), 4) AS overall, round(avg(quality) FILTER (WHERE lang = 'en'), 4) AS en, round(avg(quality) FILTER (WHERE lang <> 'en'), 4) AS other, round(avg(quality) FILTER (WHERE lang = 'xx'), 4) AS absent FROM documents JOIN labels USING (doc_id)")
def eval_slices(t):
    q = lambda c: F.round(F.avg(F.when(c, F.col("quality"))), 4)
    return judged(t).agg(F.round(F.avg("quality"), 4).alias("overall"), q(F.col("lang") == "en").alias("en"), q(F.col("lang") != "en").alias("other"), q(F.col("lang") == "xx").alias("absent"))


@query("eval_rollup", "SELECT p_brand, l_returnflag, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ROLLUP (p_brand, l_returnflag)")
def eval_rollup(t):
    d = t("lineitem").select("l_partkey", "l_returnflag", "l_quantity").join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return d.rollup("p_brand", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("eval_cube", "SELECT l_linestatus, l_returnflag, count(*)::BIGINT AS n, round(avg(l_discount), 4) AS disc FROM lineitem GROUP BY CUBE (l_linestatus, l_returnflag)")
def eval_cube(t):
    return t("lineitem").cube("l_linestatus", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 4).alias("disc"))


@query("eval_consistency", "WITH p AS (SELECT user_id, avg((value > 50)::INT) AS p FROM events GROUP BY user_id) SELECT count(*)::BIGINT AS items, round(avg(p), 4) AS accuracy, round(avg(greatest(p, 1 - p)), 4) AS consistency FROM p")
def eval_consistency(t):
    return ev.consistency(t("events"), "user_id", F.col("value") > 50)


@query("eval_perplexity", "SELECT event_type, round(exp(sum(value / 100) / count(*)), 4) AS perplexity, round(sum(value / 100) / sum(length(props) + 1), 6) AS loss_per_char FROM events GROUP BY event_type")
def eval_perplexity(t):
    return ev.perplexity(t("events"), ["event_type"], F.col("value") / 100, F.lit(1), F.length("props") + 1)


@query("eval_pass_at_k", "WITH p AS (SELECT user_id, avg((event_type = 'purchase')::INT) AS p1, bool_or(event_type = 'purchase') AS pk, avg((event_type <> 'error')::INT) AS v, count(*) AS n FROM events GROUP BY user_id) SELECT round(avg(p1), 4) AS pass_1, round(avg(pk::INT), 4) AS pass_k, round(sum(v * n) / sum(n), 4) AS valid FROM p")
def eval_pass_at_k(t):
    return ev.pass_rates(t("events"), "user_id", F.col("event_type") == "purchase", F.col("event_type") != "error")


@query("eval_pair_accuracy", "SELECT lang, (sum((quality > toxic)::INT))::BIGINT || '/' || count(*) AS \"right\" FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def eval_pair_accuracy(t):
    return ev.pair_accuracy(judged(t), "lang", F.col("quality") > F.col("toxic"))


@query("eval_weakest", "SELECT lang, round(1 - coalesce(avg(quality), 0), 3) AS need FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def eval_weakest(t):
    d = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left").groupBy("lang").agg(F.round(1 - F.coalesce(F.avg("quality"), F.lit(0.0)), 3).alias("need"))
    return d.orderBy(F.desc("need"), "lang")


@query("eval_mean_of_means", "SELECT round(avg(m), 6) AS mean_of_means, round(sum(s) / sum(n), 6) AS weighted FROM (SELECT user_id, avg(value) AS m, sum(value) AS s, count(*) AS n FROM events GROUP BY user_id)")
def eval_mean_of_means(t):
    u = t("events").groupBy("user_id").agg(F.avg("value").alias("m"), F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    return u.agg(F.round(F.avg("m"), 6).alias("mean_of_means"), F.round(F.sum("s") / F.sum("n"), 6).alias("weighted"))


@query("word_f1", r"""WITH a AS (SELECT item_id AS id, regexp_extract_all(strip_accents(lower(split_part(text, '.', 1))), '[a-z0-9_]+') AS w FROM benchmark), b AS (SELECT item_id AS id, regexp_extract_all(strip_accents(lower(text)), '[a-z0-9_]+') AS w FROM benchmark),
ac AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(w) AS w FROM a) GROUP BY id, w), bc AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(w) AS w FROM b) GROUP BY id, w),
s AS (SELECT ac.id, sum(least(ac.c, bc.c)) AS s FROM ac JOIN bc USING (id, w) GROUP BY ac.id)
SELECT a.id, round(coalesce(2 * coalesce(s.s, 0)::DOUBLE / (len(a.w) + len(b.w)), 0), 4) AS f1 FROM a JOIN b USING (id) LEFT JOIN s USING (id)""")
def word_f1(t):
    own = lambda c: t("benchmark").select(F.col("item_id").alias("id"), F.regexp_extract_all(tx.strip_accents(F.lower(c)), F.lit("[a-z0-9_]+"), F.lit(0)).alias("w"))
    return ev.word_f1(own(F.split_part("text", F.lit("."), F.lit(1))), own(F.col("text")), "id")


#: Customers as versions: major number by nation, minor number by key, each with the one before in its nation as parent.
LSQL = """(SELECT 'v' || c_nationkey || '.' || c_custkey AS version, c_nationkey AS major, 'v' || c_nationkey || '.' || lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS parent,
round((c_acctbal + 1000) / 11000, 3) AS accuracy, 67 AS items, ((c_custkey * 37) % 100) / 100.0::DOUBLE AS probe, 24 AS probe_items, 20.0::DOUBLE + c_custkey % 7 AS perplexity, c_custkey AS k FROM customer) AS l"""


def ledger(t):
    from pyspark.sql.window import Window

    name = lambda k: F.concat(F.lit("v"), "c_nationkey", F.lit("."), k)
    before = F.lag("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    return t("customer").select(name(F.col("c_custkey")).alias("version"), name(before).alias("parent"), F.round((F.col("c_acctbal") + 1000) / 11000, 3).alias("accuracy"), F.lit(67).alias("items"),
                                (F.col("c_custkey") * 37 % 100 / 100.0).alias("probe"), F.lit(24).alias("probe_items"), (F.lit(20.0) + F.col("c_custkey") % 7).alias("perplexity"))


@query("promote_gate", f"WITH l AS (SELECT * FROM {LSQL}) SELECT a.version, a.parent, round_even((a.accuracy - b.accuracy) * a.items, 0)::BIGINT AS gain, round_even((a.probe - b.probe) * a.probe_items, 0)::BIGINT AS probe_gain, coalesce(round_even((a.accuracy - b.accuracy) * a.items, 0) > 0 AND round_even((a.probe - b.probe) * a.probe_items, 0) >= 0 AND a.perplexity <= 1.03::DOUBLE * b.perplexity, true) AS promote FROM l a LEFT JOIN l b ON a.parent = b.version")
def promote_gate(t):
    return ev.improved(ledger(t))


@query("version_next", f"SELECT major, minor, 'v' || major || '.' || (minor + 1) AS next FROM (SELECT regexp_extract(version, '^v?(\\d+)\\.', 1)::INT AS major, max(regexp_extract(version, '\\.(\\d+)$', 1)::INT) AS minor FROM {LSQL} GROUP BY 1)")
def version_next(t):
    return ev.next_version(ledger(t), "version")


@query("version_active", f"SELECT version, CASE WHEN k = max(k) OVER (PARTITION BY major) THEN 'active' ELSE 'previous' END AS status, coalesce(lag(version) OVER (PARTITION BY major ORDER BY k), '-') AS before FROM {LSQL}")
def version_active(t):
    """The last version of each line is active; before it was the one with the next lower number."""
    from pyspark.sql.window import Window

    number = lambda i: F.regexp_extract("version", r"^v?(\d+)\.(\d+)$", i).cast("long")
    line = Window.partitionBy("major")
    own = ledger(t).select("version", number(1).alias("major"), number(2).alias("minor"))
    return own.select("version", F.when(F.col("minor") == F.max("minor").over(line), "active").otherwise("previous").alias("status"), F.coalesce(F.lag("version").over(line.orderBy("minor")), F.lit("-")).alias("before"))


@query("ledger_explode", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.absent') AS absent FROM events")
def ledger_explode(t):
    e = t("events").select("event_id", F.from_json("props", "k bigint, absent string").alias("p"))
    return e.select("event_id", "p.k", "p.absent")


@query("json_props", "SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def json_props(t):
    return t("events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("total"))


@query("loss_ema", "SELECT event_type, round(list_reduce(list(value ORDER BY event_id), lambda a, x: 0.98::DOUBLE * a + (1 - 0.98::DOUBLE) * x), 6) AS smoothed FROM events GROUP BY event_type")
def loss_ema(t):
    return ev.smoothed(t("events"), ["event_type"], "event_id", "value")


@query("loss_early_stop", """WITH s AS (SELECT user_id, list({'best': value, 'at': event_id, 'bad': 0, 'stop': NULL::BIGINT, 'v': value, 'o': event_id} ORDER BY event_id) AS l FROM events GROUP BY user_id),
r AS (SELECT user_id, list_reduce(l, lambda a, x: CASE WHEN a.stop IS NOT NULL THEN a WHEN x.v < a.best - 0.0001::DOUBLE THEN {'best': x.v, 'at': x.o, 'bad': 0, 'stop': NULL::BIGINT, 'v': x.v, 'o': x.o}
  ELSE {'best': a.best, 'at': a.at, 'bad': a.bad + 1, 'stop': CASE WHEN a.bad + 1 >= 3 THEN x.o END, 'v': x.v, 'o': x.o} END) AS d FROM s)
SELECT user_id, d.at AS best_step, d.stop AS stop_step FROM r""")
def loss_early_stop(t):
    return ev.early_stop(t("events"), ["user_id"], "event_id", "value", 3)


@query("target_projection", "WITH x AS (SELECT l_orderkey, l_linenumber::BIGINT * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS token, (l_partkey % 3)::BIGINT AS target, l_discount * 20 AS logit FROM lineitem), r AS (SELECT *, exp((logit - max(logit) OVER (PARTITION BY l_orderkey)) / 2.0::DOUBLE) AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY logit DESC, token) AS r FROM x), m AS (SELECT l_orderkey, target, sum(e) AS e FROM r WHERE r <= 3 AND target > 0 GROUP BY 1, 2) SELECT l_orderkey, target, round(e / sum(e) OVER (PARTITION BY l_orderkey), 6) AS p FROM m")
def target_projection(t):
    x = t("lineitem").select("l_orderkey", (F.col("l_linenumber").cast("long") * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("token"), F.when(F.col("l_partkey") % 3 > 0, (F.col("l_partkey") % 3).cast("long")).alias("target"), (F.col("l_discount") * 20).alias("logit"))
    return ev.projected_targets(x, ["l_orderkey"], 3, 2.0)


@query("python_compiles", "SELECT item_id, item_id % 2 = 0 AS ok FROM benchmark")
def python_compiles(t):
    """Whole texts as a string literal compile; as statements prose does not."""
    code = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit('x = """'), "text", F.lit(' """'))).otherwise(F.col("text"))
    return t("benchmark").select("item_id", ev.python_compiles(code).alias("ok"))
