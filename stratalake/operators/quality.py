"""Data-quality tests: each returns the rows that offend; a test passes with none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def in_set(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """Rows whose value is not allowed; null is allowed."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def unique(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is given and not among the parents."""
    return df.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def missing(expected: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(seen.select(*keys).distinct(), keys, "left_anti")


def run(spark: SparkSession, tests: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """(name, failing_rows, status) of each test."""
    rows = []
    for name, make in tests.items():
        n = make().count()
        rows.append((name, n, "Success" if n == 0 else "Failed"))
    return spark.createDataFrame(rows, "name string, failing_rows long, status string")


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls, rows) of each column."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls"), F.col("_rows").alias("rows")) for c in columns])).alias("x")).select("x.*")


def wilson(hits: Column, total: Column, z: float = 1.96) -> Column:
    """struct<lo,hi>: the Wilson score interval of a proportion; null without trials."""
    p = hits / total
    z2 = z * z
    middle, spread = p + z2 / (2 * total), z * F.sqrt(p * (1 - p) / total + z2 / (4 * total * total))
    return F.when(total > 0, F.struct(((middle - spread) / (1 + z2 / total)).alias("lo"), ((middle + spread) / (1 + z2 / total)).alias("hi")))


def word_errors(read: Column, truth: Column) -> Column:
    """Edits by word from one text to another: each distinct word becomes one letter (over a million of them, those for surrogates left out), and the letters are compared."""
    words = lambda t: F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")
    known = F.array_distinct(F.concat(words(read), words(truth)))
    code = lambda w: F.array_position(known, w) + F.when(F.array_position(known, w) < 0xD800 - 0x3400, 0x3400).otherwise(0x3C00)
    letters = lambda t: F.array_join(F.transform(words(t), lambda w: F.decode(F.unhex(F.lpad(F.hex(code(w)), 8, "0")), "UTF-32")), "")
    return F.levenshtein(letters(read), letters(truth))
