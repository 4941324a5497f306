"""Records in files: tolerant JSON lines, one-record files, text trees, key-value files, monthly logs, reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
EXAMPLE = T.StructType([T.StructField("id", T.StringType()), T.StructField("origin", T.StringType()), T.StructField("messages", MESSAGES), T.StructField("created", T.StringType()), T.StructField("meta", T.MapType(T.StringType(), T.StringType()))])
EXCHANGE = T.StructType([T.StructField(n, T.StringType()) for n in ("session", "ts", "user", "assistant", "source", "kind", "model")])
EVAL_ITEM = T.StructType([T.StructField("id", T.StringType()), T.StructField("category", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("question", T.StringType()), T.StructField("reference", T.StringType()), T.StructField("criteria", T.StructType([T.StructField("any", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("none", T.ArrayType(T.StringType())), T.StructField("regex", T.StringType()), T.StructField("only_numbers", T.ArrayType(T.LongType()))]))])


def _read(reader, schema, path):
    try:
        return reader.load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return SparkSession.active().createDataFrame([], schema)


def read_jsonl(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """Blank and malformed lines are left out; a missing path is an empty table."""
    return _read(spark.read.format("json").schema(schema).option("mode", "DROPMALFORMED"), schema, path)


def read_documents(spark: SparkSession, path: str, schema: T.StructType, newest: int | None = None) -> DataFrame:
    """One JSON record a file; `newest` keeps that many by file name from the end."""
    df = _read(spark.read.format("json").schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json"), schema, path)
    if newest is None:
        return df
    return df.withColumn("_file", F.col("_metadata.file_name")).orderBy(F.desc("_file")).limit(newest).drop("_file")


def read_texts(spark: SparkSession, path: str, suffixes=("md", "txt"), least: int = 20) -> DataFrame:
    """(path, text) of whole text files below a folder with at least `least` characters; invalid UTF-8 is replaced."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(path)
    text = F.make_valid_utf8(F.decode("content", "UTF-8"))
    return df.select("path", text.alias("text")).where(F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) >= least)


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return df.select("path", "length", "modificationTime").orderBy("path")


def read_questions(spark: SparkSession, path: str, default: str = "chat") -> DataFrame:
    """Lines 'category|question'; # begins a comment."""
    line = F.trim("value")
    parts = F.split(line, r"\|", 2)
    df = spark.read.text(path).where(~line.startswith("#") & (line != ""))
    return df.select(F.when(F.size(parts) > 1, F.trim(parts[0])).otherwise(F.lit(default)).alias("category"), F.trim(F.element_at(parts, -1)).alias("question"))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """Lines KEY=value of one small file, without quotes around values; comments and lines without = are left out. Spark's
    file sources skip names that begin with a dot, so the file system is asked for the text."""
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(file)
    text = jvm.org.apache.commons.io.IOUtils.toString(stream, jvm.java.nio.charset.StandardCharsets.UTF_8)
    stream.close()
    df = spark.createDataFrame([(x,) for x in text.splitlines()], "value string")
    parts = F.split(F.trim("value"), "=", 2)
    df = df.where(~F.trim("value").startswith("#") & (F.size(parts) == 2))
    return df.select(F.trim(parts[0]).alias("key"), F.regexp_replace(F.trim(parts[1]), r"^[\"']|[\"']$", "").alias("value"))


def numbered(items: DataFrame, version: str, order: str) -> DataFrame:
    """Ids 'version-001' by order."""
    from loomline.operators.corpus import running

    return running(items, F.lit(1), order, "_n").withColumn("id", F.format_string("%s-%03d", F.lit(version), "_n")).drop("_n")


def append_jsonl(df: DataFrame, path: str) -> int:
    """Append and return the number of rows written, counted in the same pass."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").json(path)
    return seen.get["n"]


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Exchanges with both sides, by month."""
    own = df.where((F.trim("user") != "") & (F.trim("assistant") != "")).withColumn("month", F.substring(ts, 1, 7))
    own.write.mode("append").partitionBy("month").json(path)


def entry_markdown(title: Column, sections: list[tuple[str, Column]]) -> Column:
    """A record as Markdown; sections that are null or empty are left out."""
    parts = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"## {name}\n"), c)) for name, c in sections]
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), *parts)


def report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Lines of a Markdown table."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "ord int, line string")
    return head.unionByName(df.select(F.lit(2).alias("ord"), row.alias("line"))).orderBy("ord", "line")


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Last change a key wins over the base."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*base.columns), order).alias("r")).select("r.*")
    return base.join(last.select(key), key, "left_anti").unionByName(last)
