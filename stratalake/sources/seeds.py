"""Reference seeds from CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_seed(spark: SparkSession, path: str, schema: T.StructType, rename: dict[str, str] | None = None) -> DataFrame:
    """A CSV file with a header and `#` comment lines in the declared schema: columns renamed, empty cells null, cells that don't fit their type null."""
    raw = spark.read.option("header", True).option("comment", "#").option("multiLine", True).option("escape", '"').csv(path)
    for old, new in (rename or {}).items():
        raw = raw.withColumnRenamed(old, new)
    cells = [(F.nullif(F.trim(F.col(f.name)), F.lit("")) if f.name in raw.columns else F.lit(None).cast("string")) for f in schema]
    return raw.select(*[c.try_cast(f.dataType).alias(f.name) for c, f in zip(cells, schema, strict=True)])
