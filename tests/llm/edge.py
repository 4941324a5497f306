"""Tables with all the odd cases."""

import random

from pyspark.sql import types as T

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that the operators use for columns of their own.
CLASHES = ["fp", "key", "kept", "used", "component_id", "sequence_id", "shard", "slot", "bytes", "label", "node", "base", "more", "host", "d2", "w", "h", "t", "n", "rank", "level", "est", "item_id", "score", "lang_pred", "ids", "size"]


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, odd characters."""
    r = random.Random(1)
    base = prose(r, 300)
    texts = [None, "", " \n\t ", "one", "two words", base, base, base + " extra", base.replace("alpha", "Alpha", 1), prose(r, 40_000), "spam " * 5000,
             "mail bob.a@x.example.com or +1 (555) 123-4567 now", "4111 1111 1111 1111 and 10.0.0.255", "Ünïcödé straße «quoted» naïve", "日本語のテキスト です", "it's we'll don't 'tis 's", "a\r\nb\r\n\r\na", "İstanbul ΟΔΟΣ ½ x²",
             "\x00\x01 control", "| a | b |\n| a | b |", "9" * 300]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["s0", "s1", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, "en", "s0", 1), (None, None, None, None, None), (3, "another text with the id three", "en", "s1", None)]
    return rows + [(100 + i, prose(r, r.randint(20, 200)), r.choice(["en", "de"]), "s0", 0) for i in range(120)]


def vectors(n=300, width=64):
    """Rows without a vector, or one that is zero, has nulls or is not finite; equal vectors, repeated rows and ids, null ids."""
    r = random.Random(2)
    own = [[r.gauss(0, 1) for _ in range(width)] for _ in range(n)]
    rows = [(i, v, r.choice([0, 1, None])) for i, v in enumerate(own)]
    rows += [(1000 + i, own[7], 1) for i in range(60)] + [rows[20], rows[20], (None, own[3], None), (40, own[5], 2)]
    odd = [None, [0.0] * width, [None] + own[0][1:], [float("nan")] + own[0][1:], [float("inf")] + own[0][1:], [-0.0] + own[0][1:]]
    return rows + [(2000 + 20 * i, v, 0) for i, v in enumerate(odd)]


def write(spark, path, docs, clash=False):
    from pyspark.sql import functions as F

    def put(name, rows, schema, extra=True):
        df = spark.createDataFrame(rows, schema)
        if clash and extra:
            df = df.select("*", *[F.lit("clash").alias(c) for c in CLASHES if c not in df.columns])
        df.coalesce(2).write.parquet(f"{path}/{name}.parquet")

    some = docs or []
    put("documents", some, DOCS)
    put("labels", [(1, 1, 0), (None, None, None), (3, 0, 1), (3, 0, 1), (5, None, 1)] if some else [], "doc_id long, quality int, toxic int")
    put("benchmark", [(1, "how many apples does Bob have after buying 12 more apples at 3 dollars each"), (2, None), (None, "short one here"), (4, ""), (5, "x")] if some else [], "item_id long, text string", False)
    put("embeddings", vectors() if some else [], "vec_id long, embedding array<float>, label int")
    put("pages", [(1, "http://A.example.org/es/x?q#f", ""), (2, None, None), (3, "nohost", ""), (3, "nohost", ""), (5, "https://b.c.example.com:80/fr/1", ""), (None, "x://", "")] if some else [], "page_id long, url string, html string")
    return str(path)


def docs_of(spark, d):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
