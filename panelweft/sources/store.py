"""A store of forecast cells that fills may be added to, killed and repeated."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import missing_cells


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def batches(spark: SparkSession, path: str) -> DataFrame:
    """(batch, n_rows) of every fill that was completed: a row per fill."""
    schema = "batch string, n_rows bigint"
    if not _exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/commits")


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all completed fills. What a killed fill left behind is never read."""
    names = [r["batch"] for r in batches(spark, path).select("batch").collect()]
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/batches/{n}" for n in names])


def fill(path: str, required: DataFrame, keys: list[str], schema: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Computes the required keys that no completed fill holds and adds them; the whole store afterwards.

    compute(missing keys) gives the rows of `schema`; a key that it has no value for is stored with nulls, and is then held like any other.
    Rows are written to a folder of their own, and count from the moment that one more row is committed to the list of fills. So a fill
    that is killed adds nothing, the next one does its work, and a fill of what is there already writes nothing.
    """
    spark = required.sparkSession
    missing = missing_cells(stored(spark, path, schema), required, keys)
    if not missing.isEmpty():
        batch = uuid.uuid4().hex
        made = missing.join(compute(missing), keys, "left")
        names = spark.createDataFrame([], schema).columns
        made.select(*names).write.parquet(f"{path}/batches/{batch}")
        n = spark.read.schema(schema).parquet(f"{path}/batches/{batch}").count()
        spark.createDataFrame([(batch, n)], "batch string, n_rows bigint").coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return stored(spark, path, schema)


def write_csv(df: DataFrame, path: str, config: dict) -> None:
    """A CSV table whose first file is a line of configuration that begins with #."""
    line = "# config: " + " | ".join(f"{k}={v}" for k, v in sorted(config.items()))
    df.sparkSession.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    df.write.mode("append").option("header", True).csv(path)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of the configuration lines of a CSV table."""
    lines = spark.read.text(path).where(F.col("value").startswith("# config: "))
    pairs = lines.select(F.explode(F.split(F.expr("substring(value, 11)"), r" \| ")).alias("p")).select(F.split("p", "=", 2).alias("p"))
    return pairs.select(F.col("p")[0].alias("name"), F.col("p")[1].alias("value"))
