"""Curation: validation, quality gates, queues, quarantine, dedupe, session context, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions import hashing
from loomline.functions import text as tx
from loomline.operators import similarity

MAX_CHARS = 1500
LICENCES = ["mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "unlicense", "cc0-1.0"]


def canonical_origin(c: Column) -> Column:
    return F.when(c.startswith("teacher"), "teacher").otherwise(F.coalesce(c, F.lit("curated")))


def errors(messages: Column, known: Column | None = None) -> Column:
    """Ordered list of what is wrong with a chat of messages (role, content)."""
    few = F.size(messages) < 2
    roles = F.transform(messages, lambda m: m["role"])
    text = F.transform(messages, lambda m: m["content"])
    last = F.element_at(text, -1)
    ws = tx.words(last)
    checks = [
        (F.exists(roles, lambda r: ~r.isin("user", "assistant")), "role"),
        (F.exists(F.transform(roles, lambda r, i: r != F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: x), "alternation"),
        (F.exists(text, lambda t: F.regexp_replace(t, r"\s+", "") == ""), "blank"),
        (F.exists(text, lambda t: F.length(t) > MAX_CHARS), "too_long"),
        (F.exists(text, lambda t: t.contains("�")), "encoding"),
        (F.exists(text, lambda t: t.rlike(tx.ARTEFACTS)), "artefact"),
        (F.element_at(roles, -1) != "assistant", "last_role"),
        (F.length(tx.collapse(last)) < 2, "short_answer"),
        (F.lower(tx.collapse(last)) == F.lower(tx.collapse(F.element_at(text, -2))), "echo"),
        (tx.repetitive(ws, 0.3), "degenerate"),
    ]
    if known is not None:
        checks.append((known, "duplicate"))
    found = F.array_compact(F.array(*[F.when(bad, name) for bad, name in checks]))
    return F.when(few, F.array(F.lit("too_few"))).otherwise(found)


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, quality (0 to 1) and status by mandatory and style checks of a text."""
    ws = tx.words(F.col("text"))
    mandatory = [F.length("text") >= 200, F.length("text") <= 20_000, ~tx.repetitive(ws, 0.35), ~F.col("text").rlike(tx.ARTEFACTS), ~F.col("text").contains("�"), ~F.col("text").rlike(tx.CJK), F.size(ws) >= 30]
    style = [F.col("text").rlike(r"^[\p{Lu}]"), F.col("text").rlike(r"[.!?]\s*$"), ~F.col("text").rlike(r"[#*$%&|<>]{3,}")]
    m = sum((x.cast("int") for x in mandatory), F.lit(0)) / len(mandatory)
    s = sum((x.cast("int") for x in style), F.lit(0)) / len(style)
    own = docs.select("*", F.round(0.7 * m + 0.3 * s, 3).alias("quality"), (m == 1).alias("_ok"), (s == 1).alias("_fine"))
    status = F.when(~F.col("_ok"), "rejected").when(F.col("_fine"), "approved").otherwise("review")
    return own.withColumn("status", status).drop("_ok", "_fine")


def first_wins(candidates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key: the first by order."""
    return candidates.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def pending(candidates: DataFrame, decided: DataFrame, key: str, order: list[str]) -> DataFrame:
    return first_wins(candidates.join(decided.select(key).distinct(), key, "left_anti"), key, order)


def active(approved: DataFrame, quarantine: DataFrame, key: str, human: Column) -> DataFrame:
    """Approved rows without those in quarantine, unless a human approved them."""
    marked = approved.join(quarantine.select(key).distinct().withColumn("_q", F.lit(True)), key, "left")
    return marked.where(F.col("_q").isNull() | human).drop("_q")


def session_context(log: DataFrame, by: str, order: str, columns: list[str], before: int = 4) -> DataFrame:
    """`context`: the structs of the `before` rows before each, in order, of the same session."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-before, -1)
    return log.withColumn("context", F.collect_list(F.struct(*columns)).over(w))


def accepted_code(text: Column, licence: Column, language: Column) -> Column:
    return (F.lower(language) == "python") & F.lower(licence).isin(LICENCES) & F.length(text).between(200, 60_000)


def generated_code(text: Column) -> Column:
    """Minified, machine-made or oversized sources."""
    head = F.lower(F.substring(text, 1, 600))
    return ~F.length(text).between(200, 60_000) | (tx.max_line(text) > 300) | head.contains("auto-generated") | head.contains("do not edit") | head.contains("generated by")


def manifest(docs: DataFrame, benchmark: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents deduplicated, filtered, decontaminated and split, summed up by language and split."""
    ided = docs.select("doc_id", "lang", "n_chars", "text", hashing.content_id(tx.strip_accents(F.col("text"))).alias("cid"))
    first = ided.groupBy("cid").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    own = ided.join(first, "doc_id", "left_semi").where((F.length(F.trim("text")) >= 300) & ~tx.repetitive(tx.words(F.col("text")), 0.3))
    leaks = similarity.containment_pairs(docs.where(F.length(F.trim("text")) >= 300), benchmark).select("doc_id").distinct()
    clean = own.join(leaks, "doc_id", "left_anti").join(labels.select("doc_id", "quality"), "doc_id", "left")
    split = F.when(hashing.is_validation(F.col("cid")), "val").otherwise("train")
    return clean.groupBy("lang", split.alias("split")).agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.round(F.avg("quality"), 4).alias("quality"))
