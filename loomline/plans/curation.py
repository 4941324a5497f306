"""Curation over documents, labels and benchmark items."""

from pyspark.sql import functions as F

from loomline.functions import scalars as sc
from loomline.functions import text as tx
from loomline.operators import curation as cu
from loomline.operators import similarity as si
from loomline.plans.registry import query
from loomline.plans.texts import NORM, WORDS

CID = r"left(sha1(trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g'))), 16)"


@query("curation_manifest", f"""
WITH ided AS (SELECT doc_id, lang, n_chars, text, {CID} AS cid FROM documents),
firsts AS (SELECT min(doc_id) AS doc_id FROM ided GROUP BY cid),
own AS (SELECT *, {WORDS.format('text')} AS w FROM ided WHERE doc_id IN (SELECT doc_id FROM firsts) AND length(trim(text)) >= 300),
kept AS (SELECT * FROM own WHERE NOT (len(w) >= 12 AND len(list_distinct(w)) < 0.3::DOUBLE * len(w)) AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(own.text, b.text)))
SELECT lang, CASE WHEN concat('0x', cid)::UBIGINT % 10 = 0 THEN 'val' ELSE 'train' END AS split, count(*)::BIGINT AS docs, sum(n_chars)::BIGINT AS chars, round(avg(quality), 4) AS quality
FROM kept LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""")
def curation_manifest(t):
    return cu.manifest(t("documents"), t("benchmark"), t("labels"))


M = ["length(text) >= 200", "length(text) <= 20000", "NOT (len(w) >= 12 AND len(list_distinct(w)) < 0.35::DOUBLE * len(w))", r"NOT regexp_matches(text, '<\||\[/?INST\]|</?s>|###\s*(Instruction|Response)')", "NOT contains(text, chr(65533))", r"NOT regexp_matches(text, '[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]')", "len(w) >= 30"]
S = [r"regexp_matches(text, '^[\p{Lu}]')", r"regexp_matches(text, '[.!?]\s*$')", r"NOT regexp_matches(text, '[#*$%&|<>]{3,}')"]
QUALITY = f"SELECT doc_id, round(0.7::DOUBLE * (({' + '.join(f'({x})::INT' for x in M)})::DOUBLE / 7) + 0.3::DOUBLE * (({' + '.join(f'({x})::INT' for x in S)})::DOUBLE / 3), 3) AS quality, CASE WHEN NOT ({' AND '.join(M)}) THEN 'rejected' WHEN {' AND '.join(S)} THEN 'approved' ELSE 'review' END AS status FROM (SELECT *, {WORDS.format('text')} AS w FROM documents)"


@query("quality_score", QUALITY)
def quality_score(t):
    return cu.quality(t("documents").select("doc_id", "text")).select("doc_id", "quality", "status")


@query("quality_status", f"SELECT q.status, l.quality AS label, count(*)::BIGINT AS n FROM ({QUALITY}) q LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2")
def quality_status(t):
    q = cu.quality(t("documents").select("doc_id", "text")).select("doc_id", "status")
    return q.join(t("labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "left").groupBy("status", "label").agg(F.count(F.lit(1)).alias("n"))


@query("code_like_filter", "SELECT doc_id FROM documents WHERE length(text) BETWEEN 200 AND 60000 AND list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) <= 300 AND NOT contains(lower(left(text, 600)), 'auto-generated') AND NOT contains(lower(left(text, 600)), 'do not edit') AND NOT contains(lower(left(text, 600)), 'generated by')")
def code_like_filter(t):
    return t("documents").where(~cu.generated_code(F.col("text"))).select("doc_id")


@query("license_filter", r"SELECT doc_id, lower(regexp_extract(text, '(?i)(apache|mit|bsd|gpl)[a-z -]*license', 1)) AS licence FROM documents WHERE regexp_matches(text, '(?i)licen[sc]e') AND length(text) BETWEEN 200 AND 60000")
def license_filter(t):
    d = t("documents").where(F.col("text").rlike("(?i)licen[sc]e") & F.length("text").between(200, 60_000))
    return d.select("doc_id", F.lower(F.regexp_extract("text", r"(?i)(apache|mit|bsd|gpl)[a-z -]*license", 1)).alias("licence"))


@query("code_accepted", "SELECT doc_id FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'MIT' WHEN doc_id % 3 = 1 THEN 'gpl-3.0' ELSE 'Apache-2.0' END AS lic, CASE WHEN lang = 'en' THEN 'Python' ELSE 'Java' END AS pl FROM documents) WHERE lower(pl) = 'python' AND lower(lic) IN ('mit', 'apache-2.0', 'bsd-2-clause', 'bsd-3-clause', 'isc', 'unlicense', 'cc0-1.0') AND length(text) BETWEEN 200 AND 60000")
def code_accepted(t):
    lic = F.when(F.col("doc_id") % 3 == 0, "MIT").when(F.col("doc_id") % 3 == 1, "gpl-3.0").otherwise("Apache-2.0")
    return t("documents").where(cu.accepted_code(F.col("text"), lic, F.when(F.col("lang") == "en", "Python").otherwise("Java"))).select("doc_id")


SRC = "CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 0 WHEN source IN ('src4', 'src5', 'src6', 'src7') THEN 1 WHEN source IN ('src8', 'src9', 'src10', 'src11') THEN 2 ELSE 3 END"


def _queue(c):
    return F.when(c.isin("src0", "src1", "src2", "src3"), 0).when(c.isin("src4", "src5", "src6", "src7"), 1).when(c.isin("src8", "src9", "src10", "src11"), 2).otherwise(3)


@query("pending_queue", f"SELECT doc_id, queue FROM (SELECT doc_id, {SRC} AS queue, row_number() OVER (PARTITION BY {CID} ORDER BY {SRC}, doc_id) AS r FROM documents WHERE {CID} NOT IN (SELECT {CID} FROM documents JOIN labels USING (doc_id))) WHERE r = 1")
def pending_queue(t):
    from loomline.functions.hashing import content_id

    d = t("documents").select("doc_id", _queue(F.col("source")).alias("queue"), content_id(tx.strip_accents(F.col("text"))).alias("cid"))
    decided = d.join(t("labels").select("doc_id"), "doc_id", "left_semi")
    return cu.pending(d, decided, "cid", ["queue", "doc_id"]).select("doc_id", "queue")


@query("quarantine_override", "SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND (l.toxic = 0 OR d.source = 'src0')")
def quarantine_override(t):
    l = t("labels")
    approved = t("documents").select("doc_id", "source").join(l.where("quality = 1").select("doc_id"), "doc_id")
    return cu.active(approved, l.where("toxic = 1").select("doc_id"), "doc_id", F.col("source") == "src0").select("doc_id")


@query("quarantine_suspended", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def quarantine_suspended(t):
    l = t("labels")
    return t("documents").select("doc_id").join(l.where("quality = 1").select("doc_id"), "doc_id", "left_semi").join(l.where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("dedupe_exact", f"SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY {CID}")
def dedupe_exact(t):
    from loomline.functions.hashing import content_id

    return t("documents").groupBy(content_id(tx.strip_accents(F.col("text"))).alias("cid")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


@query("dedupe_first_human", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, n_chars ORDER BY CASE WHEN source = 'src1' THEN 0 ELSE 1 END, CASE WHEN source = 'src1' THEN -doc_id ELSE doc_id END) AS r FROM documents) WHERE r = 1")
def dedupe_first_human(t):
    human = F.col("source") == "src1"
    d = t("documents").select("doc_id", "source", "lang", "n_chars", F.when(human, 0).otherwise(1).alias("a"), F.when(human, -F.col("doc_id")).otherwise(F.col("doc_id")).alias("b"), F.struct("lang", "n_chars").alias("k"))
    return cu.first_wins(d, "k", ["a", "b"]).select("doc_id", "source")


@query("decontaminate_exact", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def decontaminate_exact(t):
    return si.containment_pairs(t("documents"), t("benchmark"))


HEADS = r"SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS toks FROM documents"
ITEMS = r"SELECT item_id AS id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS toks FROM benchmark"


@query("decontaminate_jaccard", f"SELECT l, r, round(jaccard, 4) AS jaccard FROM (SELECT a.id AS l, b.id AS r, len(list_intersect(a.toks, b.toks))::DOUBLE / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks))) AS jaccard FROM ({HEADS}) a, ({ITEMS}) b WHERE len(a.toks) > 0) WHERE jaccard >= 0.4")
def decontaminate_jaccard(t):
    a = t("documents").select(F.col("doc_id").alias("id"), F.array_distinct(tx.tokens(F.col("text"), tx.WORD)).alias("toks")).where(F.size("toks") > 0)
    b = t("benchmark").select(F.col("item_id").alias("id"), F.array_distinct(tx.tokens(F.col("text"), tx.WORD)).alias("toks"))
    return si.jaccard_pairs(a, b, 0.4).select("l", "r", F.round("jaccard", 4).alias("jaccard"))


@query("arithmetic_match", r"WITH x AS (SELECT doc_id, regexp_extract(text, '(?i)(\d{1,9})\s*(x|\*|vezes|mais|\+|menos|-|dividido por|/)\s*(\d{1,9})', ['a', 'op', 'b']) AS m FROM documents), y AS (SELECT doc_id, CASE lower(m.op) WHEN 'x' THEN '*' WHEN 'vezes' THEN '*' WHEN 'mais' THEN '+' WHEN 'menos' THEN '-' WHEN 'dividido por' THEN '/' ELSE m.op END AS op, m.a::BIGINT AS a, m.b::BIGINT AS b FROM x WHERE m.op <> '') SELECT doc_id, op, CASE WHEN op IN ('+', '*') THEN least(a, b) ELSE a END AS a, CASE WHEN op IN ('+', '*') THEN greatest(a, b) ELSE b END AS b FROM y")
def arithmetic_match(t):
    d = t("documents").select("doc_id", sc.arithmetic(F.col("text")).alias("m")).where("m is not null")
    return d.select("doc_id", "m.op", "m.a", "m.b")


ASKED = """SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'user' UNION ALL SELECT 1000000000 + item_id, CASE WHEN item_id % 2 = 0 THEN upper(text) || ' ?!' ELSE 'please tell ' || text END FROM benchmark UNION ALL SELECT 2000000000 + p_partkey, (p_partkey % 50) || ' vezes ' || p_size FROM part"""
FROZEN = "SELECT item_id AS id, text FROM benchmark UNION ALL SELECT 2000000000 + n_nationkey, n_nationkey || ' x ' || (n_regionkey + 10) FROM nation"
KEYED = r"""(SELECT *, trim(n, ' ?!.') AS bare, list_distinct(regexp_extract_all(n, '[\p{L}\p{N}_]+')) AS toks, CASE WHEN op IN ('+', '*') THEN concat_ws(' ', least(a, b), op, greatest(a, b)) ELSE concat_ws(' ', a, op, b) END AS key FROM (
SELECT id, n, CASE lower(m.op) WHEN 'x' THEN '*' WHEN 'vezes' THEN '*' WHEN 'mais' THEN '+' WHEN 'menos' THEN '-' WHEN 'dividido por' THEN '/' ELSE m.op END AS op, try_cast(m.a AS BIGINT) AS a, try_cast(m.b AS BIGINT) AS b FROM (
SELECT id, {0} AS n, regexp_extract(text, '(?i)(\d{{1,9}})\s*(x|\*|vezes|mais|\+|menos|-|dividido por|/)\s*(\d{{1,9}})', ['a', 'op', 'b']) AS m FROM ({1}))))"""


@query("question_contamination", f"""WITH q AS {KEYED.replace('{{', '{').replace('}}', '}').replace('{0}', NORM.format('text')).replace('{1}', ASKED)}, f AS {KEYED.replace('{{', '{').replace('}}', '}').replace('{0}', NORM.format('text')).replace('{1}', FROZEN)}
SELECT DISTINCT q.id FROM q, f WHERE q.bare = f.bare OR (q.a IS NOT NULL AND f.a IS NOT NULL AND q.key = f.key) OR (len(q.toks) > 0 AND len(f.toks) > 0 AND len(list_intersect(q.toks, f.toks))::DOUBLE / (len(q.toks) + len(f.toks) - len(list_intersect(q.toks, f.toks))) >= 0.6)""")
def question_contamination(t):
    """What users ask, items asked anew, and calculations, against items and frozen calculations."""
    i = F.col("item_id")
    again = F.when(i % 2 == 0, F.concat(F.upper("text"), F.lit(" ?!"))).otherwise(F.concat(F.lit("please tell "), "text"))
    asked = t("conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    asked = asked.unionByName(t("benchmark").select((i + 1_000_000_000).alias("id"), again.alias("text")))
    asked = asked.unionByName(t("part").select((F.col("p_partkey") + 2_000_000_000).alias("id"), F.concat(F.col("p_partkey") % 50, F.lit(" vezes "), "p_size").alias("text")))
    frozen = t("benchmark").select(i.alias("id"), "text").unionByName(t("nation").select((F.col("n_nationkey").cast("long") + 2_000_000_000).alias("id"), F.concat("n_nationkey", F.lit(" x "), F.col("n_regionkey") + 10).alias("text")))
    return si.contaminated(asked, frozen, 0.6)


@query("exclude_known", f"SELECT doc_id FROM documents WHERE {NORM.format('text')} NOT IN (SELECT {NORM.format('text')} FROM benchmark) AND length(trim(text)) >= 6")
def exclude_known(t):
    head = lambda: tx.normalize(F.col("text"))
    known = t("benchmark").select(head().alias("k")).distinct()
    return t("documents").where(F.length(F.trim("text")) >= 6).select("doc_id", head().alias("k")).join(known, "k", "left_anti").select("doc_id")


@query("origin_counts", "SELECT CASE WHEN starts_with(source, 'src1') THEN 'teacher' ELSE source END AS origin, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def origin_counts(t):
    o = F.when(F.col("source").startswith("src1"), F.concat(F.lit("teacher-"), "source")).otherwise(F.col("source"))
    return t("documents").groupBy(cu.canonical_origin(o).alias("origin")).agg(F.count(F.lit(1)).alias("n"))


@query("funnel_metrics", "SELECT source, count(*)::BIGINT AS raw, count(l.doc_id)::BIGINT AS reviewed, count(*) FILTER (WHERE quality = 1 AND toxic = 0)::BIGINT AS approved, count(*) FILTER (WHERE quality = 0 OR toxic = 1)::BIGINT AS rejected FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def funnel_metrics(t):
    d = t("documents").select("doc_id", "source").join(t("labels").withColumn("seen", F.lit(1)), "doc_id", "left")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("raw"), F.count("seen").alias("reviewed"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("approved"), F.count_if((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("rejected"))


@query("review_outcomes", "SELECT CASE WHEN l.doc_id IS NULL THEN 'todo' WHEN toxic = 1 THEN 'contaminated' ELSE 'done' END AS state, count(*)::BIGINT AS n, count(DISTINCT source)::BIGINT AS sources FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def review_outcomes(t):
    d = t("documents").select("doc_id", "source").join(t("labels").withColumn("seen", F.lit(True)), "doc_id", "left")
    state = F.when(F.col("seen").isNull(), "todo").when(F.col("toxic") == 1, "contaminated").otherwise("done")
    return d.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))


@query("generation_status", f"SELECT source, count(*) FILTER (WHERE status = 'approved')::BIGINT AS approved, count(*) FILTER (WHERE status = 'rejected')::BIGINT AS rejected, count(*) FILTER (WHERE status = 'review')::BIGINT AS review FROM ({QUALITY}) JOIN documents USING (doc_id) GROUP BY source")
def generation_status(t):
    q = cu.quality(t("documents").select("doc_id", "source", "text"))
    return q.groupBy("source").pivot("status", ["approved", "rejected", "review"]).agg(F.count(F.lit(1))).na.fill(0)
