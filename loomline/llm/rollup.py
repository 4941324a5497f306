"""Token counts kept by deltas.

A change row has a before image, an after image or both: an insert has only the second, a delete only the first, a
revision both. A batch of changes is folded to signed sums by source, language and tokenizer version, and these few rows
are all that is stored. Totals are the sum over the committed batches; no document is read again.

A batch is committed once, whatever is retried: its delta is written under a new name, and the commit is the creation of
one empty file whose name holds the batch and the delta, so there is no state in which a commit exists without its content.
Of two writers of one batch that create such files at the same time the first one counts, for writers and readers alike (by
time, then name). Deltas that no commit names are never read. The file system must create a file at once or not at all and
list what was created, as HDFS, local file systems and the large object stores do.

compact() folds the deltas that are committed into one base, whose folder holds the names of its batches too; the base
counts from the creation of one empty file on. Totals are the newest base and the deltas of batches that it does not hold,
so reading takes two listings and the deltas since then.

Defined cases: null source, language and tokenizer are groups of their own; null counts are 0; a null text has 0 tokens;
repeated change rows in a batch count each time (deduplicate the feed by its own key before); groups that come down to no
documents and no tokens are left out; an empty batch commits nothing but its name; only the named columns are read.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline import cluster

KEYS = ["source", "lang", "tokenizer"]
DELTA = T.StructType([T.StructField(k, T.StringType()) for k in KEYS] + [T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())])


def image(source, lang, tokenizer, n_tokens):
    return F.struct(source.cast("string").alias("source"), lang.cast("string").alias("lang"), tokenizer.cast("string").alias("tokenizer"), F.coalesce(n_tokens.cast("long"), F.lit(0).cast("long")).alias("n_tokens"))


def fold(changes: DataFrame) -> DataFrame:
    """Signed sums of change rows with the nullable structs `before` and `after` (see image)."""
    signed = changes.select(F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("i")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("i")))).alias("x")).where("x.i is not null")
    sums = signed.groupBy(*[F.col(f"x.i.{k}").alias(k) for k in KEYS]).agg(F.sum(F.col("x.sign").cast("long")).alias("n_docs"), F.sum(F.col("x.sign") * F.col("x.i.n_tokens")).alias("n_tokens"))
    return sums.where("n_docs <> 0 or n_tokens <> 0")


class Ledger:
    """Committed batches under one folder, which all writers share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _marks(self, kind: str) -> list[tuple[int, str]]:
        """Time and name of the empty files of a kind ('commits' or 'bases'), first ones first."""
        root = self._path(f"{self.path}/{kind}")
        if not self._fs.exists(root):
            return []
        files = [(f.getModificationTime(), f.getPath().getName()) for f in self._fs.listStatus(root)]
        return sorted(f for f in files if not f[1].startswith("."))

    def _mark(self, kind: str, name: str):
        self._fs.create(self._path(f"{self.path}/{kind}/{name}"), False).close()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch; False if it had been applied before, by this or another writer."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch) or batch.startswith("."):
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self.batches():
            return False
        attempt = uuid.uuid4().hex
        fold(changes).coalesce(1).write.parquet(f"{self.path}/deltas/{batch}={attempt}")
        self._mark("commits", f"{batch}={attempt}")
        return self.batches()[batch] == f"{batch}={attempt}"

    def batches(self) -> dict[str, str]:
        """Committed batches and their deltas."""
        found: dict[str, str] = {}
        for _, name in self._marks("commits"):
            if "=" in name:
                found.setdefault(name.split("=", 1)[0], name)
        return found

    def _base(self) -> tuple[DataFrame | None, set[str]]:
        """Rows of the newest base and the batches in it."""
        marks = self._marks("bases")
        if not marks:
            return None, set()
        at = f"{self.path}/folded/{marks[-1][1]}"
        held = self.spark.read.schema("batch string").parquet(f"{at}/batches")
        return self.spark.read.schema(DELTA).parquet(f"{at}/sums"), {r[0] for r in held.collect()}

    def _rows(self) -> tuple[DataFrame, list[str]]:
        base, held = self._base()
        batches = self.batches()
        paths = [f"{self.path}/deltas/{d}" for b, d in batches.items() if b not in held]
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        return rows if base is None else rows.unionByName(base), sorted(held | set(batches))

    def totals(self) -> DataFrame:
        """n_docs and n_tokens by source, lang and tokenizer, over all committed batches."""
        return _totals(self._rows()[0])

    def compact(self) -> int:
        """Fold all that is committed into a new base; the number of its batches. Deltas and older bases stay, for readers
        that have begun, until the folder's owner removes them."""
        rows, batches = self._rows()
        name = f"{len(batches):09d}-{uuid.uuid4().hex}"
        _totals(rows).coalesce(1).write.parquet(f"{self.path}/folded/{name}/sums")
        self.spark.createDataFrame([(b,) for b in batches], "batch string").coalesce(1).write.parquet(f"{self.path}/folded/{name}/batches")
        self._mark("bases", name)
        return len(batches)


def _totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")


#: Tokenizer versions of the query: runs of non-space, and runs of letters or digits or single other characters.
WORDS, PIECES = "words@1", "pieces@2"
PIECE = r"[\p{L}\p{M}]+|\p{N}+|[^\p{L}\p{M}\p{N}\x20\x09-\x0D]"


def query(spark, sf_dir):
    """All documents are loaded under words@1; English is recounted under pieces@2 (revisions); documents labelled toxic are
    deleted; the second batch is sent twice."""
    docs, labels = cluster.table(spark, sf_dir, "documents"), cluster.table(spark, sf_dir, "labels")
    text = F.coalesce("text", F.lit(""))
    counts = docs.select("doc_id", "source", "lang", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"), F.when(F.col("lang") == "en", F.regexp_count(text, F.lit(PIECE))).alias("pieces"))
    counts = cluster.materialize(counts, "counts")
    first = image(F.col("source"), F.col("lang"), F.lit(WORDS), F.col("words"))
    second = F.when(F.col("pieces").isNotNull(), image(F.col("source"), F.col("lang"), F.lit(PIECES), F.col("pieces")))
    none = F.lit(None).cast("struct<source:string,lang:string,tokenizer:string,n_tokens:bigint>")
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    ledger = Ledger(spark, cluster.scratch_path(spark, "ledger"))
    revised = counts.where("pieces is not null").select(first.alias("before"), second.alias("after"))
    ledger.commit("load", counts.select(none.alias("before"), first.alias("after")))
    ledger.commit("recount", revised)
    ledger.commit("recount", revised)
    ledger.commit("takedown", counts.join(toxic, "doc_id", "left_semi").select(F.coalesce(second, first).alias("before"), none.alias("after")))
    ledger.compact()
    return ledger.totals().select(*KEYS, "n_docs", "n_tokens")


SQL = r"""
WITH kept AS (
  SELECT source, lang, coalesce(text, '') AS text FROM documents
  WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)
), counted AS (
  SELECT source, lang, CASE WHEN lang = 'en' THEN 'pieces@2' ELSE 'words@1' END AS tokenizer,
    CASE WHEN lang = 'en' THEN len(regexp_extract_all(text, '[\p{L}\p{M}]+|\p{N}+|[^\p{L}\p{M}\p{N}\x20\x09-\x0D]'))
         ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS n
  FROM kept
)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens
FROM counted GROUP BY source, lang, tokenizer
"""
