"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: No file ``_SUCCESS``, and on ``file://`` no checksum file beside each part (Parquet pages have their own). Other stores
#: ignore the last two.
PLAIN = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

_written: list[tuple[object, object]] = []
atexit.register(lambda: _delete())


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset (tests, local runs) a folder under the local temp directory is chosen and set;
    on a cluster that would be a folder of one machine, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), "colsieve-scratch")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    _written.append((p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p))
    return path


def clear() -> None:
    """Deletes all tables written so far. Call it once results are saved: they read these tables until then."""
    while _written:
        fs, path = _written.pop()
        fs.delete(path, True)


def _delete() -> None:
    """At the end of the application."""
    try:
        clear()
    except Exception:  # noqa: BLE001  the JVM may have gone before
        pass


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet and read again: cuts the lineage, survives lost executors, keeps the schema.

    On a local disk Hadoop without its native library starts a process for each file and folder that it makes, so only
    the tables themselves are made (``PLAIN``)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**PLAIN | options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that :func:`written` has returned and that no frame still to be run reads."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        for entry in [e for e in _written if path is not None and e[1].toString() == path]:
            entry[0].delete(entry[1], True)
            _written.remove(entry)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
