"""Identity of records and deterministic splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions import text as tx


def content_id(c: Column) -> Column:
    return F.substring(F.sha1(tx.collapse(F.lower(c)).cast("binary")), 1, 16)


def example_id(messages: Column) -> Column:
    """Of the (role, content) pairs as JSON lists with a space after commas."""
    quoted = lambda s: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(s, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    one = lambda m: F.concat(F.lit("["), quoted(m["role"]), F.lit(", "), quoted(tx.collapse(F.lower(m["content"]))), F.lit("]"))
    return F.substring(F.sha1(F.concat(F.lit("["), F.array_join(F.transform(messages, one), ", "), F.lit("]")).cast("binary")), 1, 16)


def document_id(source: Column, c: Column) -> Column:
    return F.substring(F.sha2(F.concat(source, F.lit("::"), F.substring(c, 1, 200)).cast("binary"), 256), 1, 16)


def cache_key(query: Column) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(query)).cast("binary"), 256), 1, 24)


def is_validation(hex_id: Column, one_in: int = 10) -> Column:
    """A fixed tenth (or other share) by the id's number. The unsigned 64-bit value is taken modulo in two halves."""
    high, low = F.conv(F.substring(hex_id, 1, 8), 16, 10).cast("long"), F.conv(F.substring(hex_id, 9, 8), 16, 10).cast("long")
    return F.pmod(F.pmod(high, F.lit(one_in)) * ((1 << 32) % one_in) + low, F.lit(one_in)) == 0
