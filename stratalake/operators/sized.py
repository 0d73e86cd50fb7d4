"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 200_000  # of a hash join
BYTES = 64 << 20
THETA_ROWS = 256  # of a join without an equality, where each row of the other side meets all


def _bytes(f: T.StructField) -> Column:
    """About how many bytes a value takes: the length of texts, eight for each number."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 8
    return F.lit(8)


def is_small(df: DataFrame, rows: int = ROWS, most: int = BYTES) -> bool:
    """Whether df has at most `rows` rows and `most` bytes; reads no more than it must."""
    size = F.lit(0)
    for f in df.schema:
        size = size + _bytes(f)
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    return found.n <= rows and found.size <= most


def small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most `rows` rows of BYTES together; else the planner joins it by a shuffle."""
    return F.broadcast(df) if is_small(df, rows) else df
