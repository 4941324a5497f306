"""Dataset versions, token corpora by part, and search indexes as folders of Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import hashing
from loomline.operators import curation


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def build_dataset(examples: DataFrame, path: str) -> dict:
    """A new version below path: examples split by id into train and val, and a manifest. If no example falls in train,
    all of them train. The version is the number of finished versions plus one; a folder counts once its manifest is
    there, so a run that died leaves nothing that is read."""
    spark = examples.sparkSession
    done = [v for v in children(spark, path) if "_SUCCESS" in children(spark, f"{path}/{v}/manifest")]
    version = len(done) + 1
    out = f"{path}/v{version:04d}"
    rows = examples.select("id", F.coalesce("origin", F.lit("curated")).alias("origin"), "messages")
    split = F.when(hashing.is_validation(F.col("id")), "val").otherwise("train")
    if not rows.where(split == "train").limit(1).count():
        split = F.lit("train")
    rows.withColumn("split", split).write.mode("overwrite").partitionBy("split").parquet(f"{out}/examples")
    written = spark.read.parquet(f"{out}/examples")
    sums = written.groupBy(curation.canonical_origin(F.col("origin")).alias("origin")).agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val"))
    manifest = sums.agg(F.lit(version).alias("version"), F.sum("train").alias("train_examples"), F.sum("val").alias("val_examples"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("origin", (F.col("train") + F.col("val")).alias("n"))))).alias("by_origin"))
    manifest.write.mode("overwrite").json(f"{out}/manifest")
    return manifest.first().asDict()


def read_dataset(spark: SparkSession, path: str, version: int, split: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v{version:04d}/examples").where(F.col("split") == split).drop("split")


def write_part(tokens: DataFrame, path: str, part: str, fixed_weight: float | None = None) -> bool:
    """A part of a token corpus (doc_id, ids, split) with its sums beside it. A finished part is left as it is."""
    spark = tokens.sparkSession
    if "_SUCCESS" in children(spark, f"{path}/{part}/meta"):
        return False
    tokens.write.mode("overwrite").partitionBy("split").parquet(f"{path}/{part}/tokens")
    sums = spark.read.parquet(f"{path}/{part}/tokens").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.when(F.col("split") == "train", F.size("ids"))), F.lit(0)).alias("train_tokens"), F.coalesce(F.sum(F.when(F.col("split") == "val", F.size("ids"))), F.lit(0)).alias("val_tokens"))
    sums.withColumn("fixed_weight", F.lit(fixed_weight).cast("double")).write.mode("overwrite").json(f"{path}/{part}/meta")
    return True


def parts(spark: SparkSession, path: str) -> DataFrame:
    """Sums of all finished parts."""
    done = [p for p in children(spark, path) if "_SUCCESS" in children(spark, f"{path}/{p}/meta")]
    schema = "docs long, train_tokens long, val_tokens long, fixed_weight double"
    if not done:
        return spark.createDataFrame([], "part string, " + schema)
    rows = spark.read.schema(schema).json([f"{path}/{p}/meta" for p in done])
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/meta/[^/]+$", 1).alias("part"), "*")


def save_index(vectors: DataFrame, path: str) -> None:
    """Texts and vectors in the same rows, so they cannot come apart."""
    vectors.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str, dim: int) -> DataFrame:
    return spark.read.parquet(path).where(F.size("embedding") == dim)
