"""The two layouts of a labelled matrix.

wide: ``sample_id, features ARRAY<DOUBLE>, label``. long: ``sample_id, feature INT, value DOUBLE, label``.
Features are data, not columns: a schema of tens of thousands of columns is more than a query plan bears.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsieve.sources.scratch import read_table


def wide(df: DataFrame, sample_id: str, features: str, label: str) -> DataFrame:
    return df.select(F.col(sample_id).alias("sample_id"), F.col(features).cast("array<double>").alias("features"), F.col(label).alias("label"))


def wide_from_columns(df: DataFrame, sample_id: str, columns: list[str], label: str) -> DataFrame:
    return df.select(F.col(sample_id).alias("sample_id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("features"), F.col(label).alias("label"))


def to_long(matrix: DataFrame) -> DataFrame:
    """One row for each value; NaN becomes null, so that missing is said in one way."""
    out = matrix.select(*[c for c in matrix.columns if c != "features"], F.posexplode("features").alias("feature", "value"))
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def columns_to_long(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """Columns as rows: their place in the list is the feature."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    return df.select(*keep, F.posexplode(values).alias("feature", "value")).withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def to_wide(long: DataFrame) -> DataFrame:
    """Back to arrays, features in order; all samples need all features."""
    rows = long.groupBy("sample_id", "label").agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("_v"))
    return rows.select("sample_id", F.transform("_v", lambda x: x["value"]).alias("features"), "label")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
