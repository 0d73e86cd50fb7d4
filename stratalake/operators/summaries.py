"""Quantiles and distinct counts of groups from small summaries that tasks merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake.operators.sized import small


def sketched_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], accuracy: int = 1000) -> DataFrame:
    """(keys, q, quantile): for each q a value of the group whose rank is at most 1/accuracy of the group's rows from q's. Sketches of bounded size are merged."""
    found = df.groupBy(*keys).agg(F.percentile_approx(value, qs, accuracy).alias("_v"))
    return found.where("_v is not null").select(*keys, F.explode(F.arrays_zip(F.lit(qs).alias("q"), F.col("_v").alias("quantile"))).alias("_z")).select(*keys, "_z.*")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], accuracy: int = 1000) -> DataFrame:
    """(keys, q, quantile): the exact quantile of each group, interpolated between the two nearest ranks; nulls don't count, and a group of nulls has none.

    A sketch brackets each quantile between two values, some thousandths of the group's ranks apart. How many rows lie before the bracket is counted, and only
    the distinct values inside it are ranked, with their numbers. No buffer holds a group's values."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_x"))
    slack = 2.0 / accuracy
    ends = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_x", [max(0.0, q - slack) for q in qs], accuracy).alias("_lo"), F.percentile_approx("_x", [min(1.0, q + slack) for q in qs], accuracy).alias("_hi"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    # Where the bracket would reach beyond the group it is open, and so it is in groups so small that it would hold less than some rows.
    little = F.col("_n") <= 4 * accuracy
    lo, hi = (F.transform(c, lambda v, i: F.when(little | F.get(F.lit([edge(q) for q in qs]), i), end).otherwise(v)) for c, edge, end in (("_lo", lambda q: q <= slack, F.col("_least")), ("_hi", lambda q: q >= 1 - slack, F.col("_most"))))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    on = same[0] if same else F.lit(True)
    for c in same[1:]:
        on = on & c
    brackets = small(ends.select(*keys, "_n", lo.alias("_lo"), hi.alias("_hi")))
    met = rows.alias("r").join(brackets.alias("b"), on).select(*(F.col(f"r.{k}").alias(k) for k in keys), "_x", "_n", "_lo", "_hi")
    # A row counts before the bracket of each q that lies above it (null), or under its value inside; rows above count for none.
    marks = F.transform("_lo", lambda v, i: F.when(F.col("_x") < v, F.struct(i.alias("i"), F.lit(None).cast(df.schema[value].dataType).alias("v"))).when(F.col("_x") <= F.get(F.col("_hi"), i), F.struct(i.alias("i"), F.col("_x").alias("v"))))
    held = met.select(*keys, "_n", F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m")).groupBy(*keys, "_n", F.col("m.i").alias("i"), F.col("m.v").alias("v")).agg(F.count("*").alias("c"))
    upto = held.withColumn("_upto", F.sum("c").over(Window.partitionBy(*keys, "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)))
    place = F.get(F.lit(qs), F.col("i")) * (F.col("_n") - 1)
    low, high = F.floor(place), F.ceil(place)
    holds = lambda rank: (F.col("_upto") - F.col("c") <= rank) & (rank < F.col("_upto"))
    ranked = upto.where("v is not null").groupBy(*keys, "_n", "i").agg(F.max(F.when(holds(low), F.col("v"))).alias("a"), F.max(F.when(holds(high), F.col("v"))).alias("b"))
    return ranked.select(*keys, F.get(F.lit(qs), F.col("i")).alias("q"), (F.col("a") + (F.col("b") - F.col("a")) * (place - low)).alias("quantile"))


def distinct_counts(df: DataFrame, keys: list[str], few: dict[str, Column], many: dict[str, Column] | None = None, error: float = 0.01) -> DataFrame:
    """keys and how many distinct values each column has in a group, all in one pass and one shuffle: sets of the columns in `few`, whose distinct values are known to be
    few (kinds, days, hours), and for those in `many` sketches, which are right within the relative error given."""
    sets = [F.size(F.collect_set(c)).cast("long").alias(n) for n, c in few.items()]
    return df.groupBy(*keys).agg(*sets, *(F.approx_count_distinct(c, error).alias(n) for n, c in (many or {}).items()))
