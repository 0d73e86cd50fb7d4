"""Keyed maintenance of tables: idempotent append, upsert, delete of what is no longer produced, pending work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_keys(df: DataFrame, keys: list[str]) -> None:
    """Raises if a key is null or repeated: an upsert would write such rows again and again."""
    null = None
    for k in keys:
        null = F.col(k).isNull() if null is None else null | F.col(k).isNull()
    bad = df.where(null).limit(5).collect()
    if bad:
        raise ValueError(f"rows with a null key: {bad}")
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"keys that occur more than once: {twice}")


def new_rows(batch: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of batch whose key is not in existing; of rows with the same key, the least by `order`."""
    rest = [c for c in batch.columns if c not in keys]
    once = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])
    return once.join(existing.select(*keys), keys, "left_anti").select(*batch.columns)


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of changes in place of, or beside, its own."""
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*base.columns))


def without_obsolete(base: DataFrame, produced: DataFrame, scope: DataFrame, keys: list[str], scope_keys: list[str]) -> DataFrame:
    """base without the rows in scope (those of the inputs read again) that are no longer produced."""
    gone = base.join(scope.select(*scope_keys).distinct(), scope_keys, "left_semi").join(produced.select(*keys), keys, "left_anti").select(*keys)
    return base.join(gone, keys, "left_anti")


def pending(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The inputs without an output."""
    return inputs.join(done.select(*keys).distinct(), keys, "left_anti")
