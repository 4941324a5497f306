"""Sources and sinks as round trips: rows are written to the shared folder and read again."""

from pyspark.sql import functions as F

from loomline import cluster
from loomline.functions import safety
from loomline.plans.registry import query
from loomline.sources import datasets, records


def folder(d, tag):
    return cluster.scratch_path(d.sparkSession, tag)


def put_files(spark, path, files):
    """Write a few small files by name."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, text in files:
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
        out.write(bytearray(text.encode()))
        out.close()
    return path


@query("records_jsonl", "SELECT doc_id::VARCHAR AS id, source AS origin, 2 * (count(*) OVER ())::BIGINT AS written FROM documents")
def records_jsonl(t):
    d = t("documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("origin"))
    path = folder(d, "lines")
    n = records.append_jsonl(d, path)
    put_files(d.sparkSession, path, [("bad.json", '\n\nnot json\n{"id": \n')])  # blank and malformed lines
    n += records.append_jsonl(d.where("false"), path) + records.append_jsonl(d, folder(d, "again"))
    return records.read_jsonl(d.sparkSession, path, records.EXAMPLE).select("id", "origin", F.lit(n).cast("long").alias("written"))


@query("records_overwritten", "SELECT c_mktsegment AS origin, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def records_overwritten(t):
    d = t("customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("origin"))
    path = folder(d, "lines")
    records.write_jsonl(d.limit(1), path)
    records.write_jsonl(d, path)
    return records.read_jsonl(d.sparkSession, path, records.EXAMPLE).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query("log_by_month", "SELECT strftime(ts, '%Y-%m') AS month, event_type AS kind, count(*)::BIGINT AS n FROM events WHERE value > 50 GROUP BY ALL")
def log_by_month(t):
    e = t("events").select(F.col("user_id").cast("string").alias("session"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.lit("q").alias("user"), F.when(F.col("value") > 50, "a").otherwise(" ").alias("assistant"), F.lit("s").alias("source"), F.col("event_type").alias("kind"), F.lit("m").alias("model"))
    path = folder(e, "log")
    records.append_log(e, path)
    log = records.read_jsonl(e.sparkSession, path, records.EXCHANGE)
    return log.groupBy(F.substring("ts", 1, 7).alias("month"), "kind").agg(F.count(F.lit(1)).alias("n"))


def one_a_file(rows, order, path, kind, by=None):
    """Each row of its own file, names in order."""
    own = rows.repartitionByRange(8, order).sortWithinPartitions(order)
    writer = own.drop(order).write.option("maxRecordsPerFile", 1)
    (writer.partitionBy(by) if by else writer).format(kind).save(path)
    return path


@query("records_newest_files", "SELECT item_id::VARCHAR AS id, text AS origin FROM benchmark ORDER BY item_id DESC LIMIT 7")
def records_newest_files(t):
    d = t("benchmark").select("item_id", F.col("item_id").cast("string").alias("id"), F.col("text").alias("origin"))
    path = one_a_file(d, "item_id", folder(d, "files"), "json")
    return records.read_documents(d.sparkSession, path, records.EXAMPLE, newest=7).select("id", "origin")


def tree(t):
    """Items as text files in folders of ten; every fifth is blank but for a word."""
    i = F.col("item_id")
    d = t("benchmark").select("item_id", F.when(i % 5 == 0, "word").otherwise(F.col("text")).alias("text"), F.floor(i / 10).alias("d"))
    return d.sparkSession, one_a_file(d, "item_id", folder(d, "tree"), "text", "d")


@query("text_tree", "SELECT (item_id // 10)::INT AS d, text || chr(10) AS text FROM benchmark WHERE item_id % 5 > 0 AND length(trim(text)) >= 20")
def text_tree(t):
    return records.read_texts(*tree(t)).select(F.regexp_extract("path", r"/d=(\d+)/", 1).cast("int").alias("d"), "text")


@query("file_listing", "SELECT (item_id // 10)::INT AS d, octet_length(encode(CASE WHEN item_id % 5 = 0 THEN 'word' ELSE text END)) + 1::BIGINT AS length FROM benchmark")
def file_listing(t):
    return records.list_files(*tree(t), "*.txt").select(F.regexp_extract("path", r"/d=(\d+)/", 1).cast("int").alias("d"), "length")


@query("question_list", "SELECT CASE WHEN item_id % 3 = 0 THEN 'chat' ELSE 'r' || (item_id % 3) END AS category, trim(regexp_replace(text, '[\\s|]+', ' ', 'g')) AS question FROM benchmark WHERE item_id % 7 > 0")
def question_list(t):
    """Lines of a question list: comments, blank lines, with and without a category."""
    i, text = F.col("item_id"), F.regexp_replace("text", r"[\s|]+", " ")
    line = F.when(i % 7 == 0, F.element_at(F.array(F.lit("# comment"), F.lit("")), (i % 2 + 1).cast("int"))).when(i % 3 == 0, text).otherwise(F.concat(F.lit(" r"), i % 3, F.lit(" | "), text))
    d = t("benchmark").select(line.alias("value"))
    path = folder(d, "questions")
    d.write.text(path)
    return records.read_questions(d.sparkSession, path)


@query("settings_file", "SELECT 'KEY' || r_regionkey AS key, r_name || '=1' AS value FROM region")
def settings_file(t):
    r = t("region")
    lines = ["# comment", "nothing"] + [f"KEY{x.r_regionkey}='{x.r_name}=1'" for x in r.toLocalIterator()]
    return records.read_settings(r.sparkSession, put_files(r.sparkSession, folder(r, "settings"), [(".env", "\n".join(lines))]) + "/.env")


@query("eval_export", "SELECT printf('v1-%03d', row_number() OVER (ORDER BY item_id)) AS id, text AS question, '' AS reference FROM benchmark")
def eval_export(t):
    items = records.numbered(t("benchmark").select("item_id", F.col("text").alias("question")), "v1", "item_id")
    path = folder(items, "items")
    records.write_jsonl(items.select("id", "question"), path)
    read = records.read_jsonl(items.sparkSession, path, records.EVAL_ITEM)
    return read.select("id", "question", F.coalesce("reference", F.lit("")).alias("reference"))


@query("token_parts", "SELECT part, count(*)::BIGINT AS docs, coalesce(sum(n) FILTER (WHERE doc_id % 10 <> 0), 0)::BIGINT AS train_tokens, coalesce(sum(n) FILTER (WHERE doc_id % 10 = 0), 0)::BIGINT AS val_tokens, CASE WHEN part = 'main' THEN 0.25::DOUBLE END AS fixed_weight FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 'main' ELSE 'other' END AS part, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS n FROM documents) GROUP BY part")
def token_parts(t):
    words = F.regexp_extract_all("text", F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))
    name = F.when(F.col("lang") == "en", "main").otherwise("other")
    d = t("documents").select("doc_id", name.alias("part"), F.transform(words, lambda w: F.length(w)).alias("ids"), F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train").alias("split"))
    path = folder(d, "corpus")
    for part, weight in (("main", 0.25), ("other", None)):
        own = d.where(F.col("part") == part).drop("part")
        assert datasets.write_part(own, path, part, weight) and not datasets.write_part(own, path, part)
    return datasets.parts(d.sparkSession, path)


@query("index_reloaded", "SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def index_reloaded(t):
    e = t("embeddings")
    dim = len(e.first().embedding)
    path = folder(e, "index")
    datasets.save_index(e, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return datasets.load_index(e.sparkSession, path, dim).select("vec_id", "label", F.round(total, 4).alias("total"))


@query("dataset_version", "WITH x AS (SELECT source, concat('0x', left(sha256(doc_id::VARCHAR), 16))::UBIGINT % 10 = 0 AS val FROM documents) SELECT 2::BIGINT AS version, count(*) FILTER (WHERE NOT val)::BIGINT AS train_examples, count(*) FILTER (WHERE val)::BIGINT AS val_examples FROM x")
def dataset_version(t):
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    x = t("documents").select(F.substring(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), 1, 16).alias("id"), F.col("source").alias("origin"), F.array(message("user", F.col("lang")), message("assistant", F.col("text"))).alias("messages"))
    path = folder(x, "versions")
    datasets.build_dataset(x, path)
    version = datasets.build_dataset(x, path)["version"]
    rows = lambda split: datasets.read_dataset(x.sparkSession, path, version, split).agg(F.count(F.lit(1)).alias(f"{split}_examples"))
    return rows("train").crossJoin(rows("val")).select(F.lit(version).cast("long").alias("version"), "train_examples", "val_examples")  # one row each


@query("preference_upsert", "SELECT coalesce(c_custkey, k) AS key, coalesce(v, c_mktsegment) AS value FROM customer FULL JOIN (SELECT o_custkey AS k, arg_max(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY 1) ON c_custkey = k")
def preference_upsert(t):
    base = t("customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    return records.upsert(base, t("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), "o_orderkey"), "key", "o_orderkey")


@query("ledger_report", "SELECT '| ' || n_name || ' | ' || r_name || ' |' AS line FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT '| n_name | r_name |' UNION ALL SELECT '|---|---|'")
def ledger_report(t):
    d = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return records.report(d, ["n_name", "r_name"]).select("line")


@query("entry_markdown", "SELECT conv_id, turn, '# ' || role || CASE WHEN text <> '' THEN chr(10) || chr(10) || '## Text' || chr(10) || text ELSE '' END AS entry FROM conversations")
def entry_markdown(t):
    return t("conversations").select("conv_id", "turn", records.entry_markdown(F.col("role"), [("Text", F.col("text")), ("Notes", F.lit(""))]).alias("entry"))


@query("path_safety", r"SELECT page_id, p AS path, NOT regexp_matches(p, '\.\.|/etc|/usr|/bin|/sbin|C:\\Windows|System32', 'i') AND (NOT (starts_with(p, '/') OR regexp_matches(p, '^[A-Za-z]:')) OR p = '/en' OR starts_with(p, '/en/')) AS safe FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)")
def path_safety(t):
    p = t("pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    return p.withColumn("safe", safety.is_safe_path(F.col("path"), "/en"))


@query("critical_commands", r"SELECT conv_id, turn, regexp_matches(text, '\brm\s+-rf\b|\bdel\s+/[sf]\b|\bformat\b|\bmkfs\b|\bdd\s+if=|>\s*/dev/|\bshutdown\b|\breboot\b|\bchmod\s+777\b', 'i') AS critical FROM conversations")
def critical_commands(t):
    return t("conversations").select("conv_id", "turn", safety.is_critical(F.col("text")).alias("critical"))


@query("usable_results", "SELECT page_id, NOT (contains(lower(url), 'pinterest.') OR contains(lower(url), 'facebook.com') OR contains(lower(url), 'twitter.com') OR contains(lower(url), 'x.com') OR contains(lower(url), 'instagram.') OR contains(lower(url), 'tiktok.')) AND length(regexp_extract(html, '<title>([^<]*)', 1)) >= 5 AS usable FROM pages")
def usable_results(t):
    return t("pages").select("page_id", safety.is_usable_result(F.col("url"), F.regexp_extract("html", "<title>([^<]*)", 1)).alias("usable"))
