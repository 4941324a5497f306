"""Text as column expressions: normalising, tokenising, chunking, cleaning, HTML, matching."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of at least two characters that begin with a letter or underscore (lower-case input).
RAG_TOKEN = r"[a-zà-ÿ_][a-zà-ÿ0-9_]+"
WORD = r"[\p{L}\p{N}_]+"
STOPWORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with"],
    "fr": ["le", "la", "de", "et", "les", "des", "que", "un", "une", "pour"],
    "de": ["der", "die", "das", "und", "ist", "ein", "mit", "zu", "den", "von"],
    "es": ["el", "los", "las", "que", "y", "del", "una", "por", "con", "para"],
}
#: Markers of a chat template left in a text.
ARTEFACTS = r"<\||\[/?INST\]|</?s>|###\s*(Instruction|Response)"
#: Unicode's space separators, as SQL's trim removes them.
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]"
#: Suffixes of the light stemmer, longest families first.
SUFFIXES = ["mente", "coes", "cao", "oes", "aes", "ais", "eis", "es", "s"]


@cache
def _accents() -> tuple[str, str]:
    """Characters whose decomposition begins with one base letter, and those letters (by rule from the Unicode data)."""
    pairs = []
    for cp in range(0xA0, 0x2000):
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) > 1 and all(unicodedata.category(c) == "Mn" for c in d[1:]):
            pairs.append((chr(cp), d[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(c: Column) -> Column:
    """Text of one-byte characters has none and is passed through."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.regexp_replace(F.translate(c, *_accents()), r"\p{Mn}+", ""))


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize(c: Column) -> Column:
    return collapse(strip_accents(F.lower(c)))


def bare(c: Column) -> Column:
    """Normalised, without spaces, question and exclamation marks and stops at the ends."""
    return F.regexp_replace(normalize(c), r"^[ ?!.]+|[ ?!.]+$", "")


def tokens(c: Column, pattern: str = RAG_TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def stem(w: Column) -> Column:
    """Drop the first listed suffix of a word that stays longer than three characters."""
    out = F.when(F.lit(False), w)
    for s in SUFFIXES:
        out = out.when(w.endswith(s) & (F.length(w) > len(s) + 3), F.substring(w, F.lit(1), F.length(w) - len(s)))
    return out.otherwise(w)


def bank_tokens(c: Column) -> Column:
    """Accentless words and runs of symbols, without stopwords, stemmed; distinct."""
    stop = F.array(*[F.lit(w) for ws in STOPWORDS.values() for w in ws])
    found = F.regexp_extract_all(strip_accents(F.lower(c)), F.lit(r"[a-z0-9_]+(?:\(\))?|[#%*+/=<>-]+"), F.lit(0))
    return F.array_distinct(F.transform(F.array_except(found, stop), stem))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def overlap(query: Column, doc: Column) -> Column:
    """Share of the query's distinct tokens that the document has."""
    return F.size(F.array_intersect(query, doc)) / F.greatest(F.size(F.array_distinct(query)), F.lit(1))


def repetitive(ws: Column, limit: float) -> Column:
    """At least 12 words, of which less than `limit` are distinct."""
    return (F.size(ws) >= 12) & (F.size(F.array_distinct(ws)) < limit * F.size(ws))


def max_line(c: Column) -> Column:
    return F.array_max(F.transform(F.split(c, "\n"), F.length))


def clean_lines(c: Column, least: int = 120) -> Column:
    """Lines of at least `least` characters that are not tables, lists or headings, collapsed."""
    own = F.filter(F.split(c, "\n"), lambda x: (F.length(F.trim(x)) >= least) & ~F.substring(F.trim(x), 1, 1).isin("|", "{", "*", "#", "="))
    return F.array_join(F.transform(own, collapse), "\n")


def chunks(c: Column, limit: int = 900, sep: str = "\n\n") -> Column:
    """Paragraphs packed greedily up to `limit` characters; longer ones are cut into slices. An array of texts."""
    # not F.trim alone: it has a second parameter, which transform would fill with the paragraph's index
    parts = F.filter(F.transform(F.split(c, sep), lambda p: F.trim(p, F.lit(SPACES))), lambda p: p != "")
    pieces = F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / limit).cast("int")), lambda i: F.struct(F.substring(p, i * limit + 1, F.lit(limit)).alias("t"), (F.length(p) > limit).alias("cut")))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def merge(a, x):
        joined = F.when(a["open"] == "", x["t"]).otherwise(F.concat(a["open"], F.lit(sep), x["t"]))
        flushed = F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))
        return (F.when(x["cut"], F.struct(F.concat(flushed, F.array(x["t"])).alias("done"), F.lit("").alias("open")))
                .when(F.length(joined) <= limit, F.struct(a["done"].alias("done"), joined.alias("open")))
                .otherwise(F.struct(flushed.alias("done"), x["t"].alias("open"))))

    return F.aggregate(pieces, start, merge, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))


def chunk_label(source: Column, i: Column) -> Column:
    return F.concat(source, F.when(i > 0, F.concat(F.lit("#chunk"), i.cast("string"))).otherwise(F.lit("")))


def slug(c: Column, limit: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9_-]+", "_"), r"^_+|_+$", ""), 1, limit)


def html_text(c: Column, limit: int | None = None) -> Column:
    """Without scripts, styles and tags, collapsed."""
    bare_text = collapse(F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]+>", " "))
    return F.substring(bare_text, 1, limit) if limit else bare_text


def links(c: Column) -> Column:
    """Targets and texts of anchors: an array of structs (href, label)."""
    pattern = F.lit(r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>')
    return F.arrays_zip(F.regexp_extract_all(c, pattern, F.lit(1)).alias("href"), F.regexp_extract_all(c, pattern, F.lit(2)).alias("label"))


def unwrap_redirect(url: Column, key: str = "uddg") -> Column:
    """The target that a redirecting link carries in a query parameter, decoded, or the link itself."""
    found = F.regexp_extract(url, rf"[?&]{key}=([^&#]*)", 1)
    return F.when(found != "", F.try_url_decode(found)).otherwise(url)


def strip_think(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def clean_bullet(c: Column) -> Column:
    """A list line without its bullet or number and without quotes at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s*(?:[-*•]|\d+[.)])\s*", ""), r"^[\"'\s]+|[\"'\s]+$", "")


def term_pattern(term: Column) -> Column:
    """Pattern of a criterion's term: begins at a word's start; with = the whole word; ends with no further digit."""
    whole = term.startswith("=")
    own = F.when(whole, F.substring(term, F.lit(2), F.length(term))).otherwise(term)
    quoted = F.regexp_replace(own, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    tail = F.when(whole, F.lit(r"(?![\p{L}\p{N}_])")).when(own.rlike(r"\d$"), F.lit(r"(?!\d)")).otherwise(F.lit(""))
    return F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), quoted, tail)


def has_term(c: Column, term: Column) -> Column:
    return F.regexp_like(normalize(c), term_pattern(normalize(term)))


def is_right(answer: Column, any_groups: Column, none: Column, regex: Column, only_numbers: Column) -> Column:
    """Criteria of an evaluation item: each group has a term, no forbidden term, the pattern fits at the start, and no
    other numbers than those listed. A null criterion holds."""
    ok = F.coalesce(F.forall(any_groups, lambda g: F.exists(g, lambda t: has_term(answer, t))), F.lit(True))
    ok &= F.coalesce(~F.exists(none, lambda t: has_term(answer, t)), F.lit(True))
    ok &= F.coalesce(F.regexp_like(normalize(answer), F.concat(F.lit("^(?:"), regex, F.lit(")"))), F.lit(True))
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))
    return ok & F.coalesce(F.size(F.array_except(numbers, only_numbers)) == 0, F.lit(True))


def count_of(c: Column, needle: str) -> Column:
    """Occurrences of a literal text that do not overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def replace_first(c: Column, old: str, new: str) -> Column:
    at = F.instr(c, old)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit(new), F.substring(c, at + len(old), F.length(c)))).otherwise(c)


def body_of(c: Column) -> Column:
    """Lines up to the first that is neither blank nor indented."""
    lines = F.split(c, "\n")
    stop = F.array_position(F.transform(lines, lambda x: x.rlike(r"^\S")), True)
    return F.array_join(F.when(stop > 0, F.slice(lines, 1, (stop - 1).cast("int"))).otherwise(lines), "\n")


def byte_tokens(c: Column) -> Column:
    """UTF-8 bytes as integers."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("[0-9A-F]{2}"), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("int"))
