"""Intermediate tables of operators that work in rounds: written once, under the shared folder that the cluster names, and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of this application: under spark.checkpoint.dir; where that is unset under the warehouse, or a temporary folder in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.startswith("local"):
        found = "file://" + tempfile.mkdtemp(prefix="stratalake-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", found)
    found = found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    return f"{found.rstrip('/')}/stratalake/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back: later rounds neither compute it again nor carry its plan, and lost executors cost nothing before it."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> bool:
    """Deletes the stages of this application, once no frame made from them is needed; whether there were any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
