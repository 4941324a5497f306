"""Search and ranking."""

from pyspark.sql import functions as F

from loomline import cluster
from loomline.functions import text as tx
from loomline.operators import retrieval as rt
from loomline.plans.registry import query

TOK = "regexp_extract_all(lower(text), '[a-zà-ÿ_][a-zà-ÿ0-9_]+')"
TF = f"SELECT doc_id, tok, count(*)::BIGINT AS c FROM (SELECT doc_id, unnest({TOK}) AS tok FROM documents) GROUP BY doc_id, tok"
IDF = f"SELECT tok, count(*)::BIGINT AS df, ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + count(*))) + 1 AS idf FROM (SELECT unnest(list_distinct({TOK})) AS tok FROM documents) GROUP BY tok"
W = f"""tf AS ({TF}), idf AS ({IDF}),
raw AS (SELECT doc_id, tok, (0.5::DOUBLE + 0.5::DOUBLE * c / max(c) OVER (PARTITION BY doc_id)) * idf AS w FROM tf JOIN idf USING (tok)),
wt AS (SELECT doc_id, tok, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id) + 1e-12::DOUBLE) AS w FROM raw)"""


def docs(t):
    return t("documents").select("doc_id", "text")


@query("tf_df", f"WITH idf AS ({IDF}) SELECT tok, df, round(idf, 6) AS idf FROM idf WHERE df >= 5")
def tf_df(t):
    return rt.idf(docs(t)).where("df >= 5").select("tok", "df", F.round("idf", 6).alias("idf"))


@query("tfidf_vectors", f"WITH {W} SELECT doc_id, count(*)::BIGINT AS terms, round(max(w), 6) AS top, round(sum(w * w), 6) AS norm FROM wt GROUP BY doc_id")
def tfidf_vectors(t):
    return rt.term_weights(docs(t)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.max("w"), 6).alias("top"), F.round(F.sum(F.col("w") * F.col("w")), 6).alias("norm"))


@query("tfidf_topk", f"""WITH {W},
qtf AS (SELECT item_id, tok, count(*) AS c FROM (SELECT item_id, unnest({TOK}) AS tok FROM benchmark) GROUP BY item_id, tok),
qraw AS (SELECT item_id, tok, (0.5::DOUBLE + 0.5::DOUBLE * c / max(c) OVER (PARTITION BY item_id)) * idf AS w FROM (SELECT item_id, tok, c, max(c) OVER (PARTITION BY item_id) AS mc FROM qtf) JOIN idf USING (tok)),
qall AS (SELECT item_id, tok, c, max(c) OVER (PARTITION BY item_id) AS m FROM qtf),
qw AS (SELECT item_id, tok, (0.5::DOUBLE + 0.5::DOUBLE * c / m) * idf AS w FROM qall JOIN idf USING (tok)),
q AS (SELECT item_id AS q, tok, w / sqrt(sum(w * w) OVER (PARTITION BY item_id) + 1e-12::DOUBLE) AS qw FROM qw),
s AS (SELECT q, doc_id, round(sum(w * qw), 4) AS score FROM wt JOIN q USING (tok) GROUP BY q, doc_id)
SELECT q, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INT AS rank FROM s) WHERE rank <= 3""".replace("""qraw AS (SELECT item_id, tok, (0.5::DOUBLE + 0.5::DOUBLE * c / max(c) OVER (PARTITION BY item_id)) * idf AS w FROM (SELECT item_id, tok, c, max(c) OVER (PARTITION BY item_id) AS mc FROM qtf) JOIN idf USING (tok)),
""", ""))
def tfidf_topk(t):
    q = t("benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return rt.sparse_topk(q, docs(t), 3)


COS = "SELECT a.vec_id AS q, b.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS score, b.label, a.label AS qlabel FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0"


@query("cosine_topk", f"SELECT q, vec_id, score, rank FROM (SELECT q, vec_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id)::INT AS rank FROM ({COS})) WHERE rank <= 5")
def cosine_topk(t):
    v = t("embeddings").select("vec_id", "embedding")
    return rt.dense_topk(v.where("vec_id % 50 = 0"), v, 5)


@query("knn_label_vote", f"WITH k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS r FROM ({COS})) WHERE r <= 7), v AS (SELECT q, label, count(*) AS n FROM k GROUP BY q, label) SELECT q, label, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, label) AS r FROM v) WHERE r = 1")
def knn_label_vote(t):
    v = t("embeddings")
    k = rt.dense_topk(v.where("vec_id % 50 = 0").select("vec_id", "embedding"), v.select("vec_id", "embedding"), 7)
    votes = k.join(v.select("vec_id", "label"), "vec_id").groupBy("q", "label").agg(F.count(F.lit(1)).alias("n"))
    return rt.top(votes.withColumn("score", F.col("n")), "q", 1, "label").select("q", "label", "n")


Q = "the that with les und"
SCORE = " + ".join(f"contains(lower(text), '{w}')::INT" for w in dict.fromkeys(Q.split()) if len(w) > 2)


@query("keyword_search", f"SELECT doc_id, ({SCORE})::INT AS score FROM documents WHERE ({SCORE}) > 0 ORDER BY score DESC, doc_id LIMIT 20")
def keyword_search(t):
    d = docs(t).select("doc_id", rt.keyword_score(Q, F.col("text")).alias("score")).where("score > 0")
    return d.orderBy(F.desc("score"), "doc_id").limit(20)


POOL = f"SELECT doc_id, text, round(({SCORE})::DOUBLE / 5, 4) AS score FROM documents"
SHARE = f"len(list_intersect(['the', 'that', 'with', 'les', 'und'], {TOK}))::DOUBLE / 5"


@query("hybrid_search", f"SELECT doc_id, hybrid FROM (SELECT doc_id, round(score + 0.12::DOUBLE * {SHARE}, 4) AS hybrid FROM (SELECT * FROM ({POOL}) ORDER BY score DESC, doc_id LIMIT 20)) WHERE hybrid >= 0.2 ORDER BY hybrid DESC, doc_id LIMIT 10")
def hybrid_search(t):
    pool = docs(t).withColumn("score", F.round(rt.keyword_score(Q, F.col("text")) / F.lit(5.0), 4))
    return rt.hybrid(pool, Q, 10, 0.12, 0.2).select("doc_id", "hybrid")


@query("search_fill", f"SELECT doc_id, score, source FROM (SELECT doc_id, score, 0 AS source FROM ({POOL}) WHERE score >= 1 UNION ALL SELECT doc_id, 0.2::DOUBLE AS score, 1 AS source FROM documents WHERE contains(lower(text), 'license')) ORDER BY source, score DESC, doc_id LIMIT 30")
def search_fill(t):
    pool = docs(t).withColumn("score", F.round(rt.keyword_score(Q, F.col("text")) / F.lit(5.0), 4))
    first = pool.where("score >= 1")
    return rt.fill(first, docs(t).where(F.lower("text").contains("license")).withColumn("score", F.lit(0.2)), 30)


STOP = ", ".join(f"'{w}'" for ws in tx.STOPWORDS.values() for w in ws)
STEM = "CASE " + " ".join(f"WHEN ends_with(w, '{s}') AND length(w) > {len(s) + 3} THEN left(w, length(w) - {len(s)})" for s in tx.SUFFIXES) + " ELSE w END"
BANK = rf"list_distinct(list_transform(list_filter(regexp_extract_all(strip_accents(lower({{0}})), '[a-z0-9_]+(?:\(\))?|[#%*+/=<>-]+'), lambda w: w NOT IN ({STOP})), lambda w: {STEM}))"


#: What users ask, and items in other words: with a word that the bank does not have, with one more, and cut short.
QUESTIONS = """SELECT conv_id * 1000 + turn AS q, text FROM conversations WHERE role = 'user' UNION ALL
SELECT 1000000000 + item_id, CASE item_id % 3 WHEN 0 THEN text || ' zzunknown' WHEN 1 THEN 'THE ' || text ELSE array_to_string(string_split(text, ' ')[1:12], ' ') END FROM benchmark"""


@query("weighted_jaccard_lookup", f"""WITH b AS (SELECT item_id AS item, unnest({BANK.format('text')}) AS t FROM benchmark), n AS (SELECT count(*) AS n FROM benchmark),
wt AS (SELECT t, ln((n + 1) / (count(*) + 0.5::DOUBLE)) + 1 AS w FROM b, n GROUP BY t, n),
q AS (SELECT q, x.t, coalesce(w, ln(n + 2) + 1) AS w FROM (SELECT q, unnest({BANK.format('text')}) AS t FROM ({QUESTIONS})) x CROSS JOIN n LEFT JOIN wt ON x.t = wt.t),
qs AS (SELECT q, sum(w) AS qsum, sum((w >= 3.0)::INT) AS heavy FROM q GROUP BY q), bs AS (SELECT item, sum(w) AS bsum FROM b JOIN wt USING (t) GROUP BY item),
c AS (SELECT q, item, sum(w) AS shared, sum((w >= 3.0)::INT) AS held FROM q JOIN b USING (t) GROUP BY q, item),
s AS (SELECT q, item, round(shared / (qsum + bsum - shared), 4) AS score FROM c JOIN qs USING (q) JOIN bs USING (item) WHERE held = heavy)
SELECT q, item, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, item) AS r FROM s WHERE score >= 0.2) WHERE r = 1""")
def weighted_jaccard_lookup(t):
    """Questions looked up in the bank: a match must have the question's rare words, and enough weight in common."""
    bank = t("benchmark").select(F.col("item_id").alias("id"), "text")
    asked = t("conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    i = F.col("item_id")
    other = F.when(i % 3 == 0, F.concat("text", F.lit(" zzunknown"))).when(i % 3 == 1, F.concat(F.lit("THE "), "text")).otherwise(F.array_join(F.slice(F.split("text", " "), 1, 12), " "))
    asked = asked.unionByName(t("benchmark").select((i + 1_000_000_000).alias("id"), other.alias("text")))
    return rt.weighted_jaccard(asked, bank, 0.2, 3.0)


@query("fuse_sources", """WITH s AS (
  SELECT lang AS topic, least(0.95, 0.5 + avg(quality)) AS conf, 'solution' AS mode FROM documents JOIN labels USING (doc_id) GROUP BY lang HAVING avg(quality) >= 0.35
  UNION ALL SELECT regexp_extract(url, '/(en|de|fr|es)/', 1), 0.45::DOUBLE, 'page' FROM pages WHERE regexp_matches(url, '/(en|de|fr|es)/') GROUP BY 1
  UNION ALL SELECT lang, 0.3::DOUBLE, 'keyword' FROM documents GROUP BY lang)
SELECT topic, round(least(0.98, max(conf) + CASE WHEN count(*) > 1 THEN 0.1::DOUBLE ELSE 0 END), 4) AS confidence, string_agg(mode, '+' ORDER BY mode) AS modes FROM s GROUP BY topic""")
def fuse_sources(t):
    solved = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id").groupBy(F.col("lang").alias("topic")).agg(F.avg("quality").alias("q")).where("q >= 0.35").select("topic", F.least(F.lit(0.95), 0.5 + F.col("q")).alias("conf"), F.lit("solution").alias("mode"))
    topic = F.regexp_extract("url", "/(en|de|fr|es)/", 1)
    page = t("pages").where(topic != "").select(topic.alias("topic")).distinct().select("topic", F.lit(0.45).alias("conf"), F.lit("page").alias("mode"))
    word = t("documents").select(F.col("lang").alias("topic")).distinct().select("topic", F.lit(0.3).alias("conf"), F.lit("keyword").alias("mode"))
    both = solved.unionByName(page).unionByName(word)
    boost = F.when(F.count(F.lit(1)) > 1, 0.1).otherwise(0.0)
    return both.groupBy("topic").agg(F.round(F.least(F.lit(0.98), F.max("conf") + boost), 4).alias("confidence"), F.array_join(F.array_sort(F.collect_list("mode")), "+").alias("modes"))


@query("lsa_similarity")
def lsa_similarity(t):
    vectors = rt.lsa(t("benchmark").select(F.col("item_id").alias("doc_id"), "text"), 8)
    v = cluster.materialize(vectors.select(F.col("doc_id").alias("vec_id"), F.col("vector").alias("embedding")), "vectors")
    return rt.dense_topk(v.where("vec_id % 50 = 0"), v, 3)


@query("index_search", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS q, e.vec_id, list_inner_product(q.v, e.v) AS score FROM q JOIN e ON q.vec_id <> e.vec_id)
SELECT q, rank::INTEGER AS rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def index_search(t):
    """An index in 16 cells is saved, loaded and searched exactly: from the nearest cells on, as far as bounds ask for."""
    from loomline.operators import cells

    e = t("embeddings")
    path = cluster.scratch_path(e.sparkSession, "index")
    cells.save(e, path, 16)
    found = cells.search(e.where("vec_id % 50 = 0"), path, 10, probes=4, exact=True)
    return found.select("q", "rank", "vec_id", F.round("score", 6).alias("score"))


@query("backend_search")
def backend_search(t):
    from loomline.operators import backends

    own = backends.resolve([backends.Hashed(128)])
    items = t("benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return backends.search(own, items, docs(t), 3)


@query("numbered_citations", "SELECT lang, n::BIGINT AS n, head FROM (SELECT lang, head, row_number() OVER (PARTITION BY lang ORDER BY first_id) AS n FROM (SELECT lang, text AS head, min(doc_id) AS first_id FROM documents GROUP BY 1, 2)) WHERE n <= 12")
def numbered_citations(t):
    from pyspark.sql.window import Window

    d = t("documents").groupBy("lang", F.col("text").alias("head")).agg(F.min("doc_id").alias("first_id"))
    return d.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("first_id")).cast("long")).where("n <= 12").select("lang", "n", "head")
