"""Where results go: appended Parquet, a JSON manifest, a Markdown table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_table(rows: DataFrame, path: str, schema: StructType) -> None:
    """Appends, unless the table that is there has other columns."""
    spark = rows.sparkSession
    if exists(spark, path):
        there = spark.read.parquet(path).columns
        if there != schema.fieldNames():
            raise ValueError(f"{path} has other columns: {sorted(set(there) ^ set(schema.fieldNames()))}")
    rows.write.mode("append").parquet(path)


def write_json(spark: SparkSession, record: dict, path: str) -> None:
    """One line of JSON, by Spark's writer, so that any file system will do."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def markdown(table: DataFrame, limit: int = 1000) -> str:
    """A small result as Markdown; more rows than ``limit`` are an error, not a cut."""
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the table has over {limit} rows")
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])


def replace_part(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` without the groups that ``new`` has, and ``new``: a table kept up part by part."""
    return table.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)
