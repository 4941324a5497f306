"""Chats: assembly, validation, context, token streams."""

from pyspark.sql import functions as F

from loomline.functions import text as tx
from loomline.operators import corpus, curation, pairs
from loomline.plans.registry import query


def messages(t):
    c = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return c.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


LISTS = "SELECT conv_id, list(role ORDER BY turn) AS r, list(text ORDER BY turn) AS x FROM conversations GROUP BY conv_id"


@query("chat_examples", rf"""SELECT conv_id, len(r)::BIGINT AS n, left(sha1('[' || array_to_string(list_transform(range(1, len(r) + 1), lambda i: '["' || r[i] || '", "' || replace(replace(trim(regexp_replace(lower(x[i]), '\s+', ' ', 'g')), '\', '\\'), '"', '\"') || '"]'), ', ') || ']'), 16) AS id FROM ({LISTS})""")
def chat_examples(t):
    from loomline.functions import hashing

    return messages(t).select("conv_id", F.size("messages").cast("long").alias("n"), hashing.example_id(F.col("messages")).alias("id"))


@query("chat_validate", rf"""
WITH c AS ({LISTS}), e AS (
  SELECT conv_id, CASE WHEN len(r) < 2 THEN ['too_few'] ELSE list_filter([
    CASE WHEN len(list_filter(r, lambda y: y NOT IN ('user', 'assistant'))) > 0 THEN 'role' END,
    CASE WHEN len(list_filter(range(1, len(r) + 1), lambda i: r[i] <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) > 0 THEN 'alternation' END,
    CASE WHEN len(list_filter(x, lambda y: regexp_replace(y, '\s+', '', 'g') = '')) > 0 THEN 'blank' END,
    CASE WHEN len(list_filter(x, lambda y: length(y) > 1500)) > 0 THEN 'too_long' END,
    CASE WHEN len(list_filter(x, lambda y: contains(y, chr(65533)))) > 0 THEN 'encoding' END,
    CASE WHEN len(list_filter(x, lambda y: regexp_matches(y, '<\||\[/?INST\]|</?s>|###\s*(Instruction|Response)'))) > 0 THEN 'artefact' END,
    CASE WHEN r[-1] <> 'assistant' THEN 'last_role' END,
    CASE WHEN length(trim(regexp_replace(x[-1], '\s+', ' ', 'g'))) < 2 THEN 'short_answer' END,
    CASE WHEN lower(trim(regexp_replace(x[-1], '\s+', ' ', 'g'))) = lower(trim(regexp_replace(x[-2], '\s+', ' ', 'g'))) THEN 'echo' END,
    CASE WHEN len(w) >= 12 AND len(list_distinct(w)) < 0.3::DOUBLE * len(w) THEN 'degenerate' END], lambda y: y IS NOT NULL) END AS bad
  FROM (SELECT *, list_filter(regexp_split_to_array(x[-1], '\s+'), lambda y: y <> '') AS w FROM c)
)
SELECT error, count(*)::BIGINT AS n FROM (SELECT unnest(CASE WHEN len(bad) = 0 THEN ['ok'] ELSE bad END) AS error FROM e) GROUP BY error""")
def chat_validate(t):
    e = messages(t).select(curation.errors(F.col("messages")).alias("bad"))
    return e.select(F.explode(F.when(F.size("bad") == 0, F.array(F.lit("ok"))).otherwise(F.col("bad"))).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def _said(side):
    return f"(SELECT conv_id, turn, trim(text) AS x FROM conversations WHERE role = '{side}')"


NX = r"trim(regexp_replace(strip_accents(lower({})), '\s+', ' ', 'g'))"
COUNT = "len(list_filter(regexp_extract_all(lower(a), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ({})))"
FR, EN = (", ".join(f"'{w}'" for w in tx.STOPWORDS[k]) for k in ("fr", "en"))
GATE = [
    ("empty", "q <> '' AND a <> ''"), ("long_question", "length(q) <= 400"), ("long_answer", "length(a) <= 900"), ("short_answer", "length(a) >= 2"),
    ("script", r"NOT regexp_matches(q || a, '[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]')"),
    ("language", f"len(regexp_extract_all(lower(a), '[\\p{{L}}\\p{{N}}_]+')) < 4 OR {COUNT.format(FR)} >= {COUNT.format(EN)}"),
    ("identity", f"NOT regexp_matches(na, '{pairs.IDENTITIES}')"), ("artefact", "NOT contains(a, '<|') AND NOT contains(a, chr(65533))"), ("echo", "nq <> na"),
    ("repetitive", "NOT (len(w) >= 12 AND len(list_distinct(w)) < 0.35::DOUBLE * len(w))"), ("contaminated", "NOT leak"), ("duplicate", "again = 1"),
]
STYLE = ["length(a) <= 160", r"regexp_matches(a, '^[\p{Lu}\d]')", r"regexp_matches(a, '[.!?)\"]$') OR contains(a, chr(10))"]


@query("pair_status", rf"""WITH p AS (SELECT u.conv_id, u.turn, u.x AS q, s.x AS a FROM {_said('user')} u JOIN {_said('assistant')} s ON u.conv_id = s.conv_id AND s.turn = u.turn + 1),
n AS (SELECT *, {NX.format('q')} AS nq, {NX.format('a')} AS na, count(*) OVER (PARTITION BY {NX.format('q')}) AS again,
  list_distinct(regexp_extract_all({NX.format('q')}, '[\p{{L}}\p{{N}}_]+')) AS toks, trim({NX.format('q')}, ' ?!.') AS bare FROM p),
b AS (SELECT trim({NX.format('text')}, ' ?!.') AS bare, list_distinct(regexp_extract_all({NX.format('text')}, '[\p{{L}}\p{{N}}_]+')) AS bt FROM benchmark),
l AS (SELECT n.*, EXISTS (SELECT 1 FROM b WHERE b.bare = n.bare OR (len(n.toks) > 0 AND len(list_intersect(bt, n.toks)) >= 0.85::DOUBLE * (len(bt) + len(n.toks) - len(list_intersect(bt, n.toks))))) AS leak, list_filter(string_split(na, ' '), lambda y: y <> '') AS w FROM n),
g AS (SELECT conv_id, turn, {' + '.join(f'({x})::INT' for _, x in GATE)} AS good, {' + '.join(f'({x})::INT' for x in STYLE)} AS style, list_filter([{', '.join(f"CASE WHEN NOT ({x}) THEN '{k}' END" for k, x in GATE)}], lambda y: y IS NOT NULL) AS bad FROM l)
SELECT conv_id, turn, array_to_string(bad, ' ') AS problems, round(0.7::DOUBLE * (good::DOUBLE / 12) + 0.3::DOUBLE * (style::DOUBLE / 3), 3) AS quality,
CASE WHEN len(bad) > 0 THEN 'rejected' WHEN conv_id % 2 = 0 OR 0.7::DOUBLE + 0.1::DOUBLE * style < 0.75 THEN 'review' ELSE 'approved' END AS status FROM g""")
def pair_status(t):
    """Each question with the answer after it; a question that is asked twice or more is a known one. The texts hold neither
    calculations nor code, so the twin leaves these checks out."""
    c = t("conversations")
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    own = q.join(a, ["conv_id", "turn"]).withColumns({"id": F.struct("conv_id", "turn"), "factual": F.col("conv_id") % 2 == 0})
    known = own.groupBy(tx.normalize(F.trim("question")).alias("n")).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    language = pairs.seems(pairs.prose(F.trim("answer")), tx.STOPWORDS["fr"], tx.STOPWORDS["en"])
    done = pairs.gate(own, t("benchmark").select(F.col("item_id").alias("id"), "text"), known, language, max_question=400, max_answer=900)
    return done.select("conv_id", "turn", F.array_join("problems", " ").alias("problems"), "quality", "status")


@query("chat_context_window", "SELECT conv_id, turn, coalesce(len(list(text) OVER w), 0)::BIGINT AS n, coalesce(sum(length(text)) OVER w, 0)::BIGINT AS chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)")
def chat_context_window(t):
    c = curation.session_context(t("conversations"), "conv_id", "turn", ["role", "text"], 8)
    return c.select("conv_id", "turn", F.size("context").cast("long").alias("n"), F.aggregate("context", F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"])).alias("chars"))


@query("chat_useful", "SELECT conv_id, turn, prev_turn, n_before::BIGINT AS n_before FROM (SELECT *, lag(turn) OVER w AS prev_turn, row_number() OVER w - 1 AS n_before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND length(text) BETWEEN 1 AND 1500")
def chat_useful(t):
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t("conversations").select("*", F.lag("turn").over(w).alias("prev_turn"), (F.row_number().over(w) - 1).cast("long").alias("n_before"))
    return c.where((F.col("role") == "assistant") & F.length("text").between(1, 1500)).select("conv_id", "turn", "prev_turn", "n_before")


@query("chat_to_text", "SELECT conv_id, md5(string_agg(CASE WHEN role = 'user' THEN 'Question: ' ELSE 'Answer: ' END || text, chr(10) ORDER BY turn)) AS h FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id HAVING count(*) >= 2")
def chat_to_text(t):
    known = F.filter("messages", lambda m: m["role"].isin("user", "assistant"))
    c = messages(t).select("conv_id", known.alias("m")).where(F.size("m") >= 2)
    return c.select("conv_id", F.md5(F.array_join(F.transform("m", lambda m: F.concat(F.when(m["role"] == "user", "Question: ").otherwise("Answer: "), m["content"])), "\n").cast("binary")).alias("h"))


@query("chat_token_labels", "SELECT conv_id, sum(octet_length(encode(text)) + 2)::BIGINT AS n, sum(CASE WHEN role = 'user' THEN octet_length(encode(text)) + 2 ELSE 1 END)::BIGINT AS masked FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def chat_token_labels(t):
    c = messages(t).select("conv_id", corpus.chat_tokens(F.col("messages")).alias("t")).where(F.size("t.ids") > 0)
    return c.select("conv_id", F.size("t.ids").cast("long").alias("n"), F.size(F.filter("t.labels", lambda x: x == corpus.IGNORE)).cast("long").alias("masked"))


@query("chat_backward_pack", "SELECT conv_id, count(*)::BIGINT AS n, min(turn) AS first_turn FROM (SELECT *, sum(length(text)) OVER w AS back, row_number() OVER w AS rn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) WHERE back <= 2000 OR rn = 1 GROUP BY conv_id")
def chat_backward_pack(t):
    c = corpus.backward_pack(t("conversations"), "conv_id", "turn", F.length("text"), 2000)
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first_turn"))


@query("chat_role_filter", "SELECT role, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars FROM conversations WHERE role IN ('user', 'assistant') GROUP BY role")
def chat_role_filter(t):
    return t("conversations").where(F.col("role").isin("user", "assistant")).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("chat_single_turn", f"SELECT conv_id, left(x[1], 60) AS question FROM ({LISTS}) WHERE len(r) = 2 AND r[1] = 'user'")
def chat_single_turn(t):
    return messages(t).where((F.size("messages") == 2) & (F.col("messages")[0]["role"] == "user")).select("conv_id", F.substring(F.col("messages")[0]["content"], 1, 60).alias("question"))


@query("criteria_match", r"WITH c AS (SELECT conv_id, turn, trim(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g')) AS n, text FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, (regexp_matches(n, '(^|[^\p{L}\p{N}_])the') AND (regexp_matches(n, '(^|[^\p{L}\p{N}_])and([^\p{L}\p{N}_]|$)') OR regexp_matches(n, '(^|[^\p{L}\p{N}_])of([^\p{L}\p{N}_]|$)')) AND NOT regexp_matches(n, '(^|[^\p{L}\p{N}_])license')) AS ok FROM c")
def criteria_match(t):
    groups = F.array(F.array(F.lit("the")), F.array(F.lit("=and"), F.lit("=of")))
    ok = tx.is_right(F.col("text"), groups, F.array(F.lit("license")), F.lit(None).cast("string"), F.lit(None).cast("array<bigint>"))
    return t("conversations").where("role = 'assistant'").select("conv_id", "turn", ok.alias("ok"))
