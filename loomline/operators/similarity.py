"""Containment, similarity and arithmetic matches between documents and a reference set, by inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline import cluster
from loomline.functions import scalars as sc
from loomline.functions import text as tx

cluster.ship_by_value(__name__)

#: Reference sets up to this many rows and bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 64 << 20
#: The most frequent tokens whose counts order the tokens of a set; longer tokens are taken for rare.
FREQUENT, TOKEN_BYTES = 50_000, 64


def _small(df: DataFrame) -> DataFrame:
    rows, size = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def containment_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) where the document contains the item's text. The longest inner word of an item is its anchor:
    a document with the item has the anchor among its words, so an equi-join finds all candidates."""
    inner = F.slice(tx.words(F.col("text")), 2, F.greatest(F.size(tx.words(F.col("text"))) - 2, F.lit(0)))
    anchored = items.select("item_id", F.col("text").alias("item"), F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("anchor"))
    # anchors meet words without the texts; these come back for the few candidates
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("anchor"))
    found = words.join(_small(anchored.where("anchor is not null").select("item_id", "item", "anchor")), "anchor").select(F.col("doc_id").alias("_id"), "item_id", "item").distinct()
    long = docs.select("doc_id", "text").join(found, F.col("doc_id").eqNullSafe(F.col("_id"))).where(F.col("text").contains(F.col("item"))).select("doc_id", "item_id")
    # items of one or two words have no inner word: sent to all tasks, in blocks
    found = long
    for part in cluster.blocks(anchored.where("anchor is null and length(item) > 0").select("item_id", "item"), "item", BROADCAST_ROWS):
        short = docs.select("doc_id", "text").join(F.broadcast(part), F.col("text").contains(F.col("item"))).select("doc_id", "item_id")
        found = found.unionByName(short)
    return found.distinct()


def prefixes(sets: DataFrame, frequent: dict, least: float) -> DataFrame:
    """sets with p: of each set of n tokens its n - ceil(n * least) + 1 rarest, by their counts and then by themselves. Sets
    whose similarity is `least` or more have a token of their prefixes in common."""
    shared = sets.sparkSession.sparkContext.broadcast(frequent)

    @F.arrow_udf("array<string>")
    def rarest(batch):
        import math

        import pyarrow as pa

        df = shared.value
        return pa.array([sorted(x, key=lambda t: (df.get(t, 0), t))[: len(x) - math.ceil(len(x) * least - 1e-9) + 1] for x in batch.to_pylist()], pa.list_(pa.string()))

    return sets.withColumn("p", rarest("toks"))


def jaccard_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(l, r, jaccard) with at least `least`, from rows (id, toks: distinct tokens). Sets that are too large or too small for
    all of the other side leave first. Of each set only its rarest tokens go into the index, with the set's number and size
    and the token's place: a pair whose sizes and places leave no room for enough common tokens is no candidate. Sets
    themselves meet only as candidates."""
    size = F.size("toks")
    left, right = (d.where(size > 0).withColumn("n", F.monotonically_increasing_id()) for d in (left, right))
    for _ in range(2):  # each side by the sizes of the other; tokens are made once
        lo, hi = right.agg(F.min(size), F.max(size)).first()
        left, right = right, cluster.materialize(left.where((size >= (lo or 0) * least - 1e-9) & (size * least - 1e-9 <= (hi or 0))), "tokens")
    tokens = left.select(F.explode("toks").alias("t")).unionAll(right.select(F.explode("toks").alias("t"))).where(F.octet_length("t") <= TOKEN_BYTES)
    counts = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1").orderBy(F.desc("df"), "t").limit(FREQUENT)
    frequent = {r.t: r.df for r in counts.collect()}

    def index(d, number, length, place):
        own = prefixes(d, frequent, least).select(F.col("n").alias(number), size.alias(length), F.posexplode("p").alias(place, "t"))
        return own.select(number, length, place, F.xxhash64("t").alias("h"))

    room = F.least(F.col("ln") - F.col("li"), F.col("rn") - F.col("ri"))
    enough = room >= (F.col("ln") + F.col("rn")) * F.lit(least / (1 + least)) - 1e-9
    lengths = (F.col("ln") >= F.col("rn") * least - 1e-9) & (F.col("rn") >= F.col("ln") * least - 1e-9)
    found = index(left, "l", "ln", "li").join(index(right, "r", "rn", "ri"), "h").where(lengths & enough).select("l", "r").distinct()
    met = found.join(left.select(F.col("n").alias("l"), F.col("id").alias("lid"), F.col("toks").alias("lt")), "l")
    met = met.join(_small(right.select(F.col("n").alias("r"), F.col("id").alias("rid"), F.col("toks").alias("rt"))), "r")
    met = met.select(F.col("lid").alias("l"), F.col("rid").alias("r"), tx.jaccard(F.col("lt"), F.col("rt")).alias("jaccard"))
    return met.where(F.col("jaccard") >= least).distinct()


def arithmetic_key(c) -> F.Column:
    x = sc.arithmetic(c)
    return F.when(x.isNotNull(), F.concat_ws(" ", x["a"].cast("string"), x["op"], x["b"].cast("string")))


def contaminated(questions: DataFrame, frozen: DataFrame, least: float) -> DataFrame:
    """questions (id, text) that equal a frozen text when normalised, ask for the same calculation, or have similar words."""
    q = questions.select("id", tx.bare(F.col("text")).alias("n"), arithmetic_key(F.col("text")).alias("k"), F.array_distinct(tx.tokens(tx.normalize(F.col("text")), tx.WORD)).alias("toks"))
    f = frozen.select("id", tx.bare(F.col("text")).alias("n"), arithmetic_key(F.col("text")).alias("k"), F.array_distinct(tx.tokens(tx.normalize(F.col("text")), tx.WORD)).alias("toks"))
    equal = q.join(_small(f.select("n").distinct()), "n", "left_semi").select("id")
    same = q.join(_small(f.where("k is not null").select("k").distinct()), "k", "left_semi").select("id")
    near = jaccard_pairs(q.where(F.size("toks") > 0), f.where(F.size("toks") > 0), least).select(F.col("l").alias("id"))
    return equal.union(same).union(near).distinct()


def offsets_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tokens of two segmentations (doc, i, end) that end at the same character; the first on the right, no last tokens."""
    from pyspark.sql.window import Window

    last = Window.partitionBy("doc")
    inner = lambda d: d.withColumn("m", F.max("i").over(last)).where("i < m and end > 0").drop("m")
    right = inner(b).groupBy("doc", "end").agg(F.min("i").alias("right"))
    return inner(a).join(right, ["doc", "end"]).select("doc", F.col("i").alias("left"), "right")
