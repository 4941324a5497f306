"""Text functions over documents and pages."""

from pyspark.sql import functions as F

from loomline.functions import hashing
from loomline.functions import text as tx
from loomline.plans.registry import query

NORM = r"trim(regexp_replace(strip_accents(lower({0})), '\s+', ' ', 'g'))"
WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"


@query("text_normalize", f"SELECT doc_id, md5(n) AS h, length(n)::BIGINT AS len FROM (SELECT doc_id, {NORM.format('text')} AS n FROM documents)")
def text_normalize(t):
    n = tx.normalize(F.col("text"))
    return t("documents").select("doc_id", n.alias("n")).select("doc_id", F.md5(F.col("n").cast("binary")).alias("h"), F.length("n").cast("long").alias("len"))


@query("text_tokens_rag", "SELECT doc_id, len(k)::BIGINT AS n, len(list_distinct(k))::BIGINT AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-zà-ÿ_][a-zà-ÿ0-9_]+') AS k FROM documents)")
def text_tokens(t):
    d = t("documents").select("doc_id", tx.tokens(F.col("text")).alias("k"))
    return d.select("doc_id", F.size("k").cast("long").alias("n"), F.size(F.array_distinct("k")).cast("long").alias("n_distinct"))


@query("text_word_stats", f"SELECT doc_id, len(w)::BIGINT AS words, len(list_distinct(w))::BIGINT AS uniq, round(len(list_distinct(w))::DOUBLE / greatest(len(w), 1), 6) AS ratio, (len(w) >= 12 AND len(list_distinct(w)) < 0.35::DOUBLE * len(w)) AS repetitive FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)")
def text_word_stats(t):
    d = t("documents").select("doc_id", tx.words(F.col("text")).alias("w"))
    n, u = F.size("w"), F.size(F.array_distinct("w"))
    return d.select("doc_id", n.cast("long").alias("words"), u.cast("long").alias("uniq"), F.round(u / F.greatest(n, F.lit(1)), 6).alias("ratio"), tx.repetitive(F.col("w"), 0.35).alias("repetitive"))


@query("text_clean_lines", r"SELECT doc_id, md5(c) AS h, length(c)::BIGINT AS len FROM (SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) >= 120 AND left(trim(x), 1) NOT IN ('|', '{', '*', '#', '=')), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), chr(10)) AS c FROM documents)")
def text_clean_lines(t):
    d = t("documents").select("doc_id", tx.clean_lines(F.col("text")).alias("c"))
    return d.select("doc_id", F.md5(F.col("c").cast("binary")).alias("h"), F.length("c").cast("long").alias("len"))


@query("text_chunks", """
WITH RECURSIVE lines AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS k, p FROM (
    SELECT doc_id, generate_subscripts(s, 1) AS i, trim(unnest(s)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE p <> ''
), pieces AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, j)::BIGINT AS k, substr(p, j * 900 + 1, 900) AS x, length(p) > 900 AS cut
  FROM (SELECT doc_id, k, p, unnest(range(0, ((length(p) - 1) // 900) + 1)) AS j FROM lines)
), walk AS (
  SELECT doc_id, k, length(x) AS open, cut, 1 AS chunk FROM pieces WHERE k = 1
  UNION ALL
  SELECT p.doc_id, p.k, CASE WHEN p.cut OR w.cut OR w.open + 1 + length(p.x) > 900 THEN length(p.x) ELSE w.open + 1 + length(p.x) END,
    p.cut, CASE WHEN p.cut OR w.cut OR w.open + 1 + length(p.x) > 900 THEN w.chunk + 1 ELSE w.chunk END
  FROM walk w JOIN pieces p ON p.doc_id = w.doc_id AND p.k = w.k + 1
)
SELECT doc_id, 'd' || doc_id || CASE WHEN chunk > 1 THEN '#chunk' || (chunk - 1) ELSE '' END AS label, max(open)::BIGINT AS len FROM walk GROUP BY doc_id, chunk
""")
def text_chunks(t):
    d = t("documents").select("doc_id", F.posexplode(tx.chunks(F.col("text"), 900, "\n")).alias("i", "c"))
    return d.select("doc_id", tx.chunk_label(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("i")).alias("label"), F.length("c").cast("long").alias("len"))


@query("text_slug", "SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60) AS slug FROM part")
def text_slug(t):
    return t("part").select("p_partkey", tx.slug(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


def _hits(lang):
    return F.size(F.filter("w", lambda w: w.isin(*tx.STOPWORDS[lang])))


@query("text_script_guess", "WITH k AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents), h AS (SELECT doc_id, lang, len(w) AS n, " + ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(s) for s in ws)}))) AS {k}" for k, ws in tx.STOPWORDS.items()) + ") FROM k), g AS (SELECT lang, CASE WHEN n < 4 THEN 'short' WHEN en >= greatest(fr, de, es) THEN 'en' WHEN fr >= greatest(de, es) THEN 'fr' WHEN de >= es THEN 'de' ELSE 'es' END AS guess FROM h) SELECT lang, guess, count(*)::BIGINT AS n FROM g GROUP BY lang, guess".replace(") FROM k)", " FROM k)"))
def text_script_guess(t):
    d = t("documents").select("lang", tx.tokens(F.col("text"), tx.WORD).alias("w"))
    d = d.select("lang", F.size("w").alias("n"), *[_hits(k).alias(k) for k in tx.STOPWORDS])
    guess = F.when(F.col("n") < 4, "short").when(F.col("en") >= F.greatest("fr", "de", "es"), "en").when(F.col("fr") >= F.greatest("de", "es"), "fr").when(F.col("de") >= F.col("es"), "de").otherwise("es")
    return d.groupBy("lang", guess.alias("guess")).agg(F.count(F.lit(1)).alias("n"))


@query("text_flags", r"SELECT lang, count(*) FILTER (WHERE regexp_matches(text, '[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]'))::BIGINT AS cjk, count(*) FILTER (WHERE contains(text, chr(65533)))::BIGINT AS broken, count(*) FILTER (WHERE regexp_matches(text, '<\||\[/?INST\]|</?s>|###\s*(Instruction|Response)'))::BIGINT AS artefacts, count(*) FILTER (WHERE regexp_matches(text, '[0-9]'))::BIGINT AS digits FROM documents GROUP BY lang")
def text_flags(t):
    c = F.col("text")
    return t("documents").groupBy("lang").agg(F.count_if(c.rlike(tx.CJK)).alias("cjk"), F.count_if(c.contains("�")).alias("broken"), F.count_if(c.rlike(tx.ARTEFACTS)).alias("artefacts"), F.count_if(c.rlike("[0-9]")).alias("digits"))


@query("text_replace_count", "SELECT doc_id, ((length(text) - length(replace(text, 'the ', ''))) // 4)::BIGINT AS n, md5(CASE WHEN contains(text, 'the ') THEN substr(text, 1, strpos(text, 'the ') - 1) || 'THE ' || substr(text, strpos(text, 'the ') + 4) ELSE text END) AS h FROM documents")
def text_replace_count(t):
    c = F.col("text")
    return t("documents").select("doc_id", tx.count_of(c, "the ").alias("n"), F.md5(tx.replace_first(c, "the ", "THE ").cast("binary")).alias("h"))


@query("line_search", "SELECT doc_id, line::BIGINT AS line, snippet FROM (SELECT doc_id, generate_subscripts(s, 1) - 1 AS line, unnest(s) AS x, left(trim(unnest(s)), 200) AS snippet FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE regexp_matches(x, '(?i)license') ORDER BY doc_id, line LIMIT 50")
def line_search(t):
    d = t("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "x")).where(F.col("x").rlike("(?i)license"))
    return d.select("doc_id", F.col("line").cast("long").alias("line"), F.substring(F.trim("x"), 1, 200).alias("snippet")).orderBy("doc_id", "line").limit(50)


@query("symbol_search", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents), p(kind, pat) AS (VALUES ('definition', '^\s*(The|Der|Le|La) \w+'), ('assignment', '^\s*\w+\s*[:=]')) SELECT kind, count(*)::BIGINT AS lines, count(DISTINCT doc_id)::BIGINT AS docs FROM l JOIN p ON regexp_matches(x, pat) GROUP BY kind")
def symbol_search(t):
    d = t("documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("x"))
    kinds = F.array_compact(F.array(F.when(F.col("x").rlike(r"^\s*(The|Der|Le|La) \w+"), "definition"), F.when(F.col("x").rlike(r"^\s*\w+\s*[:=]"), "assignment")))
    return d.select("doc_id", F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("doc_id").alias("docs"))


@query("doc_ids", r"SELECT doc_id, left(sha1(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))), 16) AS content_id, left(sha256(source || '::' || left(text, 200)), 16) AS document_id, left(sha256(lower(trim(left(text, 40)))), 24) AS cache_key FROM documents")
def doc_ids(t):
    return t("documents").select("doc_id", hashing.content_id(F.col("text")).alias("content_id"), hashing.document_id(F.col("source"), F.col("text")).alias("document_id"), hashing.cache_key(F.substring("text", 1, 40)).alias("cache_key"))


@query("doc_split", r"SELECT doc_id, CASE WHEN concat('0x', left(sha1(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))), 16))::UBIGINT % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM documents")
def doc_split(t):
    return t("documents").select("doc_id", F.when(hashing.is_validation(hashing.content_id(F.col("text"))), "val").otherwise("train").alias("split"))


@query("byte_tokens", "SELECT item_id, octet_length(encode(text))::BIGINT AS n, list_sum(list_transform(range(0, octet_length(encode(text))), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::INT))::BIGINT AS total FROM benchmark")
def byte_tokens(t):
    b = tx.byte_tokens(F.col("text"))
    return t("benchmark").select("item_id", b.alias("b")).select("item_id", F.size("b").cast("long").alias("n"), F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("html_text", r"SELECT page_id, md5(x) AS h, length(x)::BIGINT AS len FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM pages)")
def html_text(t):
    p = t("pages").select("page_id", tx.html_text(F.col("html")).alias("x"))
    return p.select("page_id", F.md5(F.col("x").cast("binary")).alias("h"), F.length("x").cast("long").alias("len"))


@query("snippet_order", """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, CASE WHEN page_id % 3 > 0 THEN regexp_extract(html, '(?is)<p[^>]*>([^<]*)</p>', 1) ELSE '' END AS snippet FROM pages)
SELECT host, rank::INTEGER AS rank, page_id FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY (snippet = '')::INT, length(snippet) DESC, page_id) AS rank FROM p) WHERE rank <= 5""")
def snippet_order(t):
    """Hits of a host: those with a snippet first, longer ones before."""
    from loomline.operators import retrieval

    snippet = F.when(F.col("page_id") % 3 > 0, F.regexp_extract("html", r"(?is)<p[^>]*>([^<]*)</p>", 1)).otherwise("")
    hits = t("pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"), snippet.alias("snippet"))
    return retrieval.by_snippet(hits, "host", 5).select("host", "rank", "page_id")


LINES = "(SELECT conv_id, turn, ['- ', '12. ', '  * \"', ''][conv_id % 4 + 1] || text AS line FROM conversations)"


@query("bullet_lines", rf"""SELECT conv_id, turn, md5(regexp_replace(regexp_replace(line, '^\s*(?:[-*•]|\d+[.)])\s*', ''), '^["''\s]+|["''\s]+$', '', 'g')) AS h FROM {LINES}""")
def bullet_lines(t):
    begin = F.element_at(F.array(*map(F.lit, ["- ", "12. ", '  * "', ""])), (F.col("conv_id") % 4 + 1).cast("int"))
    return t("conversations").select("conv_id", "turn", F.md5(tx.clean_bullet(F.concat(begin, "text")).cast("binary")).alias("h"))


CODE = "(SELECT doc_id, text, ['', '    x = 1' || chr(10) || chr(10) || '    return x' || chr(10), 'def f(x):' || chr(10) || '    return x' || chr(10), '  y' || chr(10) || 'print(1)' || chr(10)][doc_id % 4 + 1] || text AS body FROM documents)"


def coded(t):
    """Documents behind a few lines of code, by doc_id."""
    begin = F.element_at(F.array(*map(F.lit, ["", "    x = 1\n\n    return x\n", "def f(x):\n    return x\n", "  y\nprint(1)\n"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return t("documents").select("doc_id", F.concat(begin, "text").alias("body"))


@query("function_bodies", rf"""WITH l AS (SELECT doc_id, string_split(body, chr(10)) AS l FROM {CODE}), s AS (SELECT *, list_position(list_transform(l, lambda x: regexp_matches(x, '^[^\t\n\x0B\f\r ]')), true) AS stop FROM l)
SELECT doc_id, md5(array_to_string(CASE WHEN stop > 0 THEN l[1:stop - 1] ELSE l END, chr(10))) AS h FROM s""")
def function_bodies(t):
    return coded(t).select("doc_id", F.md5(tx.body_of(F.col("body")).cast("binary")).alias("h"))


@query("code_blocks", r"""WITH l AS (SELECT doc_id, string_split(body, chr(10)) AS l FROM """ + CODE + r"""),
c AS (SELECT doc_id, l, list_transform(l, lambda x: regexp_matches(x, '^(def |for |if |while |class |import |from |with |try:|print\(|[a-zA-Z_][a-zA-Z0-9_]*[\t\n\x0B\f\r ]*=[^=])')) AS code, list_transform(l, lambda x: regexp_matches(x, '^([ \t]|else|elif|except|finally)')) AS more FROM l),
s AS (SELECT *, list_position(code, true) AS b FROM c), e AS (SELECT *, list_position(list_transform(range(b, len(l) + 1), lambda i: code[i] OR more[i]), false) AS e FROM s WHERE b > 0)
SELECT doc_id, md5(array_to_string(l[b : CASE WHEN e > 0 THEN b + e - 2 ELSE len(l) END], chr(10))) AS h FROM e WHERE CASE WHEN e > 0 THEN e - 1 ELSE len(l) - b + 1 END >= 2""")
def code_blocks(t):
    from loomline.operators import pairs

    own = coded(t).select("doc_id", pairs.code_block(F.col("body")).alias("x")).where("x is not null")
    return own.select("doc_id", F.md5(F.col("x").cast("binary")).alias("h"))


@query("html_links", r"""SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS label FROM pages""")
def html_links(t):
    return t("pages").select("page_id", F.explode(tx.links(F.col("html"))).alias("x")).select("page_id", "x.href", "x.label")


@query("url_parts", r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page, contains(url, 'spam') OR contains(url, 'cheap') AS blocked, CASE WHEN regexp_extract(url, '[?&]ref=([^&#]*)', 1) <> '' THEN regexp_extract(url, '[?&]ref=([^&#]*)', 1) ELSE url END AS target FROM pages")
def url_parts(t):
    u = F.col("url")
    return t("pages").select("page_id", F.regexp_extract(u, r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract(u, r"[?&]page=([^&#]*)", 1).alias("page"), F.exists(F.array(F.lit("spam"), F.lit("cheap")), lambda b: F.lower(u).contains(b)).alias("blocked"), tx.unwrap_redirect(u, "ref").alias("target"))


@query("text_preview", "SELECT doc_id, left(text, 80) AS preview, trim(regexp_replace('<think>' || left(text, 20) || '</think>' || right(text, 30), '(?s)<think>.*?</think>', '', 'g')) AS answer FROM documents")
def text_preview(t):
    c = F.col("text")
    return t("documents").select("doc_id", F.substring(c, 1, 80).alias("preview"), tx.strip_think(F.concat(F.lit("<think>"), F.substring(c, 1, 20), F.lit("</think>"), F.right(c, F.lit(30)))).alias("answer"))


@query("symbol_spans", r"SELECT doc_id, len(list_distinct(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9_]+(?:\(\))?|[#%*+/=<>-]+')))::BIGINT AS n FROM documents")
def symbol_spans(t):
    found = F.regexp_extract_all(tx.strip_accents(F.lower("text")), F.lit(r"[a-z0-9_]+(?:\(\))?|[#%*+/=<>-]+"), F.lit(0))
    return t("documents").select("doc_id", F.size(F.array_distinct(found)).cast("long").alias("n"))


@query("bpe_tokens")
def bpe_tokens(t):
    from loomline.functions import tokenizers as tk

    import public_tokenizers

    ids = tk.encode(F.col("text"), public_tokenizers.path("byte_bpe_50k.json"))
    return t("benchmark").select("item_id", ids.alias("ids")).select("item_id", F.size("ids").cast("long").alias("n"), F.array_max("ids").alias("top"))
