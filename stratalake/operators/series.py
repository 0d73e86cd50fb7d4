"""Latest rows, series, gaps, calendars and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake.operators.sized import small


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by `order`, which must be total: a window ranks a key's rows. latest_by does without one where plain comparisons suffice."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest_by(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """One row for each key, that with the greatest values of `by`: a max_by aggregate, so a key's rows meet already reduced, whatever their
    number. Rows equal in all of `by` must be equal."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in rest]).select(*df.columns)


def trend(value: Column, before: Column, tolerance: float = 1e-6) -> Column:
    """NO_BASE, STABLE, UP or DOWN."""
    return F.when(before.isNull(), "NO_BASE").when(F.abs(value - before) < tolerance, "STABLE").when(value > before, "UP").otherwise("DOWN")


def with_trend(df: DataFrame, keys: list[str], order: list[str], value: str, last_of: str) -> DataFrame:
    """Adds previous (value of the row before in its series), variation (two decimals), trend and is_current (whether last_of is the series' last)."""
    series = Window.partitionBy(*keys)
    before = F.lag(value).over(series.orderBy(*order))
    out = df.withColumn("previous", before).withColumn("is_current", F.col(last_of) == F.max(last_of).over(series))
    return out.withColumn("variation", F.round(F.col(value) - F.col("previous"), 2)).withColumn("trend", trend(F.col(value), F.col("previous")))


def gaps(df: DataFrame, keys: list[str], at: str, seconds: int) -> DataFrame:
    """Pairs of neighbours in a series that lie more than `seconds` apart: keys, gap_start, gap_end, gap_seconds."""
    prior = F.lag(at).over(Window.partitionBy(*keys).orderBy(at))
    out = df.select(*keys, prior.alias("gap_start"), F.col(at).alias("gap_end")).where("gap_start is not null")
    return out.withColumn("gap_seconds", F.timestamp_diff("SECOND", F.col("gap_start"), F.col("gap_end"))).where(F.col("gap_seconds") > seconds)


def calendar(df: DataFrame, day: Column, keys: list[str] | None = None) -> DataFrame:
    """A row for each day from the first to the last of df (of each key)."""
    ends = df.groupBy(*(keys or [])).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    return ends.where("_lo is not null").select(*(keys or []), F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day"))).alias("day"))


def unpivot(df: DataFrame, ids: list[str], measures: dict[str, Column], name: str = "indicator", value: str = "value") -> DataFrame:
    """One row for each id and measure."""
    return df.select(*ids, F.explode(F.array(*[F.struct(F.lit(k).alias(name), v.cast("double").alias(value)) for k, v in measures.items()])).alias("_m")).select(*ids, f"_m.{name}", f"_m.{value}")


def block(df: DataFrame, columns: list[tuple[str, str]], **values: Column) -> DataFrame:
    """df in the full schema of a stacked view: the given columns cast, the others null."""
    unknown = set(values) - {c for c, _ in columns}
    if unknown:
        raise ValueError(f"not columns of the view: {sorted(unknown)}")
    return df.select(*[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in columns])


def stack(blocks: list[DataFrame]) -> DataFrame:
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out


def descending(column: Column) -> Column:
    """A number or a count of microseconds, so that what is greatest comes first in an ascending order, and null last."""
    return F.coalesce(-column, F.lit((1 << 63) - 1))


def same_sets(df: DataFrame, keys: list[str], ids: str, order: list[Column]) -> DataFrame:
    """One row for each distinct set of ids within its keys, that with the least `order` (ascending columns, see descending): an aggregate, so a set that very many rows
    have is reduced before rows meet."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys, F.array_sort(ids).alias("_set")).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in rest]).select(*df.columns)


def timeline(at: Column, item: Column, by: str = "; ") -> Column:
    """Aggregate: the items in order of `at`, joined; null if there are none."""
    pairs = F.array_sort(F.collect_list(F.when(at.isNotNull() & item.isNotNull(), F.struct(at.alias("at"), item.alias("item")))))
    return F.nullif(F.array_join(F.transform(pairs, lambda p: p["item"]), by), F.lit(""))


def counts_within(df: DataFrame, id_: str, kind: str, at: str, reach: int) -> DataFrame:
    """(id, kind, n): for each row and each kind but its own, how many rows of that kind lie within `reach` of its `at` (a whole number), where any do.

    No pair is made: a count is the difference of two ranks, each the rows of earlier ticks of `reach` and the place within its own tick, so a busy tick is sorted, not
    joined with itself. Kinds are few."""
    rows = df.select(F.col(id_).alias("id"), F.col(kind).alias("own"), F.col(at).alias("at"))
    kinds = rows.select(F.col("own").alias("kind")).where("kind is not null").distinct()
    edge = lambda place, order, sign: F.struct(place.alias("place"), F.lit(order).alias("order"), F.lit(sign).alias("sign"))
    # At equal places a stretch's begin comes before the rows there, and its end behind them.
    asked = rows.join(small(kinds), F.col("own") != F.col("kind")).select("id", "kind", F.explode(F.array(edge(F.col("at") - reach, 0, -1), edge(F.col("at") + reach, 2, 1))).alias("e")).select("id", "kind", "e.*", F.lit(0).alias("n"))
    held = rows.where("own is not null").select(F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.col("own").alias("kind"), F.col("at").alias("place"), F.lit(1).alias("order"), F.lit(0).alias("sign"), F.lit(1).alias("n"))
    every = asked.unionByName(held).withColumn("tick", F.floor(F.col("place") / reach))
    before = Window.partitionBy("kind").orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)
    ticks = every.groupBy("kind", "tick").agg(F.sum("n").alias("m")).select("kind", "tick", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("kind", "tick").orderBy("place", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = every.withColumn("rank", F.sum("n").over(inside)).where("sign <> 0").join(ticks, ["kind", "tick"])
    return ranked.groupBy("id", "kind").agg(F.sum(F.col("sign") * (F.col("earlier") + F.col("rank"))).alias("n")).where("n > 0")
