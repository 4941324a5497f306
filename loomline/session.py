"""Session for tests, benchmarks and notebooks; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cpus: int | str = 8, partitions: int | None = None, memory: str = "12g") -> SparkSession:
    n = partitions or (cpus if isinstance(cpus, int) else 8)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("loomline")
        .config("spark.sql.shuffle.partitions", str(n)).config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
