"""Corpus packing, budgets, mixtures and windows."""

from pyspark.sql import functions as F

from loomline.functions import text as tx
from loomline.operators import corpus as co
from loomline.operators import ordering
from loomline.plans.registry import query


@query("corpus_pack", "SELECT split, count(*)::BIGINT AS docs, sum(n_chars)::BIGINT AS chars FROM (SELECT n_chars, CASE WHEN row_number() OVER (ORDER BY doc_id) % 200 = 0 THEN 'val' ELSE 'train' END AS split FROM documents) GROUP BY split")
def corpus_pack(t):
    d = co.every_nth(t("documents").select("doc_id", "n_chars"), "doc_id", 200)
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))


@query("corpus_budget", "SELECT doc_id, n_chars FROM (SELECT *, sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM documents) WHERE upto - n_chars < 100000")
def corpus_budget(t):
    return co.budget(t("documents").select("doc_id", "n_chars"), F.col("n_chars"), "doc_id", 100_000)


@query("corpus_batch_budget", "WITH r AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 20 AS g, sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM documents), e AS (SELECT g, max(upto) AS e FROM r GROUP BY g) SELECT doc_id, n_chars FROM r WHERE g <= (SELECT coalesce(max(g), -1) + 1 FROM e WHERE e < 100000)")
def corpus_batch_budget(t):
    return co.batch_budget(t("documents").select("doc_id", "n_chars"), F.col("n_chars"), "doc_id", 100_000, 20)


@query("corpus_interleave", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS round FROM documents")
def corpus_interleave(t):
    return co.interleave(t("documents").select("source", "doc_id"), "source", "doc_id").withColumn("round", F.col("round").cast("int")).orderBy("round", "source")


@query("corpus_mixture", "WITH s AS (SELECT lang, sum(n_chars)::BIGINT AS size FROM documents GROUP BY lang), f AS (SELECT *, CASE WHEN lang = 'en' THEN 0.3::DOUBLE END AS f FROM s), w AS (SELECT lang, size, coalesce(f, (1 - 0.3::DOUBLE) * size / sum(CASE WHEN f IS NULL THEN size ELSE 0 END) OVER ()) AS w FROM f) SELECT lang, size, round(w / sum(w) OVER (), 6) AS weight FROM w")
def corpus_mixture(t):
    s = t("documents").groupBy("lang").agg(F.sum("n_chars").alias("size"))
    return co.mixture(s, F.when(F.col("lang") == "en", F.lit(0.3))).select("lang", "size", "weight")


@query("corpus_windows", r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS t FROM documents), x AS (SELECT doc_id, t, unnest(range(0, (len(t) - 1) // 128 + 1)) AS w FROM w WHERE len(t) > 0) SELECT doc_id, w::INT AS w, len(t[w * 128 + 1 : w * 128 + 128])::BIGINT AS n, md5(array_to_string(t[w * 128 + 1 : w * 128 + 128], ' ')) AS h FROM x")
def corpus_windows(t):
    w = co.windows(t("documents"), tx.words(F.col("text")), 128)
    return w.select("doc_id", "w", F.size("toks").cast("long").alias("n"), F.md5(F.array_join("toks", " ").cast("binary")).alias("h"))


@query("frozen_prefix", "SELECT lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 100 // (SELECT count(DISTINCT lang) FROM documents)")
def frozen_prefix(t):
    return co.frozen_prefix(t("documents").select("lang", "doc_id"), "lang", "doc_id", 100)


@query("shard_prune", "SELECT count(*)::BIGINT AS n, min(doc_id) AS first_id FROM documents WHERE doc_id % 8 = 3")
def shard_prune(t):
    return t("documents").where(F.pmod("doc_id", F.lit(8)) == 3).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("corpus_concat", "SELECT doc_id // 50 AS block, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS h FROM documents GROUP BY 1")
def corpus_concat(t):
    # blocks of 50 documents, so no row grows with the corpus
    d = t("documents").groupBy(F.floor(F.col("doc_id") / 50).alias("block")).agg(F.array_sort(F.collect_list(F.struct("doc_id", F.col("text").alias("x")))).alias("v"))
    return d.select("block", F.md5(F.array_join(F.transform("v", lambda v: v["x"]), "\n\n").cast("binary")).alias("h"))


@query("file_parts", "SELECT item_id::VARCHAR AS path, i::INT AS part, sha256(substr(text, i * 64 + 1, 64)) AS sha FROM (SELECT item_id, regexp_replace(text, '[^ -~]', '?', 'g') AS text, unnest(range(0, greatest((length(text) + 63) // 64, 1))) AS i FROM benchmark)")
def file_parts(t):
    files = t("benchmark").select(F.col("item_id").cast("string").alias("path"), F.regexp_replace("text", "[^ -~]", "?").cast("binary").alias("content"))
    return co.split_bytes(files, 64).select("path", "part", "sha")


@query("file_reassembled", "SELECT item_id::VARCHAR AS path, sha256(text) AS sha FROM benchmark")
def file_reassembled(t):
    files = t("benchmark").select(F.col("item_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return co.join_bytes(co.split_bytes(files, 50)).select("path", F.sha2("content", 256).alias("sha"))


@query("vocabulary", "SELECT tok, (row_number() OVER (ORDER BY tok) - 1)::BIGINT AS id FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS tok FROM benchmark)")
def vocabulary(t):
    from loomline.operators.corpus import running

    v = t("benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("tok")).distinct()
    return running(v, F.lit(1), "tok", "n").select("tok", (F.col("n") - 1).alias("id"))


@query("offset_alignment", r"""WITH a AS (SELECT item_id AS doc, generate_subscripts(e, 1) - 1 AS i, unnest(e) AS e FROM (SELECT item_id, list_transform(range(1, length(text) // 3 + 1), lambda k: k * 3) AS e FROM benchmark)),
b AS (SELECT item_id AS doc, generate_subscripts(e, 1) - 1 AS i, unnest(e) AS e FROM (SELECT item_id, list_transform(range(1, length(text) // 5 + 1), lambda k: k * 5) AS e FROM benchmark)),
ai AS (SELECT * FROM (SELECT *, max(i) OVER (PARTITION BY doc) AS m FROM a) WHERE i < m), bi AS (SELECT * FROM (SELECT *, max(i) OVER (PARTITION BY doc) AS m FROM b) WHERE i < m)
SELECT doc, count(*)::BIGINT AS n, sum(ai.i)::BIGINT AS l, sum(bi.i)::BIGINT AS r FROM ai JOIN bi USING (doc, e) GROUP BY doc""")
def offset_alignment(t):
    from loomline.operators.similarity import offsets_join

    ends = lambda k: t("benchmark").select(F.col("item_id").alias("doc"), F.posexplode(F.transform(F.sequence(F.lit(1), F.floor(F.length("text") / k).cast("int")), lambda x: x * k)).alias("i", "end"))
    j = offsets_join(ends(3), ends(5))
    return j.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.sum("left").alias("l"), F.sum("right").alias("r"))


PIECES = """SELECT 'chat:' || r || ':' || conv_id || ':' || turn AS id, '<' || role || '>' || text || '</s>' AS piece FROM conversations, (SELECT unnest(range(2)) AS r) WHERE role <> 'system'
UNION ALL SELECT 'doc:' || doc_id, '<doc>' || trim(text, ' ') || '</s>' FROM documents WHERE length(trim(text, ' ')) > 20"""


def pieces(t):
    """Chat turns, twice each, and documents of more than 20 characters, as (id, piece)."""
    c = t("conversations").where("role <> 'system'").withColumn("r", F.explode(F.array(F.lit(0), F.lit(1))))
    chats = c.select(F.concat_ws(":", F.lit("chat"), "r", "conv_id", "turn").alias("id"), F.concat(F.lit("<"), "role", F.lit(">"), "text", F.lit("</s>")).alias("piece"))
    docs = t("documents").withColumn("x", F.trim("text")).where(F.length("x") > 20)
    return chats.unionByName(docs.select(F.concat(F.lit("doc:"), "doc_id").alias("id"), F.concat(F.lit("<doc>"), "x", F.lit("</s>")).alias("piece")))


@query("corpus_shuffled", f"SELECT id, (row_number() OVER (ORDER BY sha256('7:' || id)) - 1)::BIGINT AS position, (sum(octet_length(encode(piece))) OVER (ORDER BY sha256('7:' || id)) - octet_length(encode(piece)))::BIGINT AS \"offset\" FROM ({PIECES})")
def corpus_shuffled(t):
    own = pieces(t)
    return ordering.shuffled(own, ["id"], 7, F.octet_length("piece")).select("id", "position", "offset")


@query("corpus_blocks", f"""WITH w AS (SELECT string_agg(hex(encode(piece)), '' ORDER BY sha256('7:' || id)) AS x FROM ({PIECES}))
SELECT b::BIGINT AS block, least(65536, length(x) // 2 - b * 65536)::BIGINT AS bytes, sha256(substr(x, b * 131072 + 1, 131072)) AS sha FROM w, (SELECT unnest(range((length(x) + 131071) // 131072)) AS b FROM w)""")
def corpus_blocks(t):
    own = ordering.shuffled(pieces(t).withColumn("raw", F.col("piece").cast("binary")).drop("piece"), ["id"], 7, F.octet_length("raw"))
    return ordering.concatenated(own, 65536).select("block", F.octet_length("content").cast("long").alias("bytes"), F.sha2(F.hex("content").cast("binary"), 256).alias("sha"))


@query("token_alignment")
def token_alignment(t):
    """Documents cut to 256 tokens of one public vocabulary, beside the tokens of another that end at the same characters."""
    import public_tokenizers

    from loomline.functions import tokenizers

    a, b = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    d = t("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return tokenizers.aligned(d, "text", a, b, 256).select("doc_id", F.size("left_ids").alias("left_tokens"), F.size("right_ids").alias("right_tokens"), F.size("pairs").alias("pairs"))
