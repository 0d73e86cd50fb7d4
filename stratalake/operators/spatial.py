"""Spatial and spatio-temporal joins by cells, so that no pair of far rows is ever made."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake.functions.geo import EARTH_M, great_circle_m
from stratalake.operators.sized import THETA_ROWS, is_small, small
from stratalake.operators.stages import stored

DEGREE_M = 111_194.9  # metres in a degree of latitude, rounded down


def _around(cell: Column, count: int = 1) -> Column:
    return F.sequence(cell - count, cell + count)


class Grid:
    """Cells that a circle of radius_m around a point of one can't leave by more than one.

    They are bands of latitude of radius height; within a band, longitudes are cut into equal cells no narrower than the radius is one band
    further towards the pole, and not at all near the poles. They divide the whole circle, so they wrap around."""

    def __init__(self, radius_m: float):
        self.height = radius_m / DEGREE_M

    def band(self, lat: Column) -> Column:
        return F.floor(lat / self.height).cast("long")

    def _turns(self, b: Column) -> Column:
        edge = F.greatest(F.abs(b - 1), F.abs(b + 2)) * self.height
        return F.when(edge >= 85, F.lit(1)).otherwise(F.greatest(F.floor(360.0 * F.cos(F.radians(F.least(edge, F.lit(85.0)))) / (self.height * 1.0001)), F.lit(1))).cast("long")

    def column(self, lon: Column, b: Column) -> Column:
        return F.pmod(F.floor((lon + 180.0) * self._turns(b) / 360.0).cast("long"), self._turns(b))

    def placed(self, df: DataFrame, lon: str, lat: str) -> DataFrame:
        """df with the cell of each point."""
        return df.withColumn("_band", self.band(F.col(lat))).withColumn("_column", self.column(F.col(lon), F.col("_band")))

    def spread(self, df: DataFrame, lon: str, lat: str) -> DataFrame:
        """df with a row for each cell that the circle of a point can touch."""
        out = df.withColumn("_band", F.explode(_around(self.band(F.col(lat)))))
        return out.withColumn("_column", F.explode(F.array_distinct(F.transform(_around(self.column(F.col(lon), F.col("_band"))), lambda c: F.pmod(c, self._turns(F.col("_band")))))))


def within(points: DataFrame, places: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of points (pid, plon, plat) and places (qid, qlon, qlat) at most radius_m apart, with dist_m: each place is spread over the cells that its circle can touch,
    and points meet it by equality of cells."""
    grid = Grid(radius_m)
    left, right = grid.placed(points, "plon", "plat"), grid.spread(places, "qlon", "qlat")
    pairs = left.join(right, ["_band", "_column"]).withColumn("dist_m", great_circle_m(F.col("plon"), F.col("plat"), F.col("qlon"), F.col("qlat")))
    return pairs.where(F.col("dist_m") <= radius_m).drop("_band", "_column")


# ------------------------------------------------------------------ nearest places

SIDE = 2.001  # of a cube around the unit sphere; a cell of level n has a 2^n-th of it
DEEPEST = 20  # cells of about ten metres


def _on_sphere(lon: Column, lat: Column) -> list[Column]:
    """x, y, z of a point on the unit sphere, so that cells know neither poles nor a date line."""
    p, q = F.radians(lat), F.radians(lon)
    return [F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p)]


def _cell(axis: Column, size: Column) -> Column:
    return F.floor((axis + SIDE / 2) / size).cast("long")


def _key(x: Column, y: Column, z: Column) -> Column:
    return x + y * (1 << DEEPEST) + z * (1 << 2 * DEEPEST)


def _size(level: Column) -> Column:
    return F.lit(SIDE) / F.pow(F.lit(2.0), level)


def _levels(places: int) -> list[int]:
    """Every second level, from the one cell of the whole cube to some levels below one place a cell."""
    return list(range(0, min(DEEPEST, 2 * math.ceil((math.log(max(places, 1), 4) + 3) / 2)) + 1, 2))


def _chord(metres: Column) -> Column:
    """The straight distance on the unit sphere, rounded outwards."""
    return 2 * F.sin(F.least(metres / (2 * EARTH_M), F.lit(math.pi / 2))) * (1 + 1e-9) + 1e-9


def nearest(points: DataFrame, places: DataFrame, rows: int = THETA_ROWS) -> DataFrame:
    """For each pid of points (pid, plon, plat) the nearest of places (qid, qlon, qlat), of equally near ones the least qid: pid, qid, dist_m.

    Few places are broadcast as one row. Otherwise a pyramid of cells holds one place for each occupied cell of each level. A point's own deepest occupied cell gives a place, and so a
    radius within which the nearest one must lie; cells twice as wide as that radius leave eight that it can touch, whose places the point meets by
    equality. Points so far from all places that only the whole Earth is wide enough meet the outlines of at most `rows` cells first, and then the places of those
    cells that may hold something nearer than what any other cell has for certain."""
    points, places = points.select("pid", "plon", "plat").where("plon is not null and plat is not null"), places.select("qid", "qlon", "qlat").where("qlon is not null and qlat is not null")
    best = lambda pairs: pairs.groupBy("pid").agg(F.min(F.struct("dist_m", "qid")).alias("_b")).select("pid", F.col("_b.qid").alias("qid"), F.col("_b.dist_m").alias("dist_m"))
    away = great_circle_m(F.col("plon"), F.col("plat"), F.col("qlon"), F.col("qlat"))
    if is_small(places, rows):
        # All places stand beside each point, in one row, so a point makes no row for each of them, and its own task holds no more rows than it has points.
        held = places.agg(F.collect_list(F.struct("qid", "qlon", "qlat")).alias("_q"))
        each = F.array_min(F.transform("_q", lambda q: F.struct(great_circle_m(F.col("plon"), F.col("plat"), q["qlon"], q["qlat"]).alias("dist_m"), q["qid"].alias("qid"))))
        met = points.repartition("pid").crossJoin(F.broadcast(held)).where(F.size("_q") > 0).select("pid", each.alias("_b"))
        return best(met.select("pid", "_b.*"))
    x, y, z = _on_sphere(F.col("qlon"), F.col("qlat"))
    spots = stored(places.groupBy("qlon", "qlat").agg(F.min("qid").alias("qid")).select("*", x.alias("x"), y.alias("y"), z.alias("z")), "spots")
    levels = _levels(spots.count())
    at = F.explode(F.array(*(F.lit(n) for n in levels)))
    own = _key(*(_cell(F.col(c), _size(F.col("level"))) for c in "xyz"))
    celled = stored(spots.withColumn("level", at).withColumn("cell", own), "cells")
    ends = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    pyramid = stored(celled.groupBy("level", "cell").agg(*(F.min_by(c, "qid").alias(c) for c in ("qlon", "qlat")), *ends), "pyramid")
    # A first place for each point.
    px, py, pz = _on_sphere(F.col("plon"), F.col("plat"))
    asked = points.select("*", px.alias("x"), py.alias("y"), pz.alias("z")).withColumn("level", at).withColumn("cell", own)
    met = asked.join(small(pyramid.select("level", "cell", "qlon", "qlat")), ["level", "cell"])
    first = met.groupBy("pid", "plon", "plat", "x", "y", "z").agg(F.max_by(F.struct("qlon", "qlat"), "level").alias("q"))
    reach = _chord(great_circle_m(F.col("plon"), F.col("plat"), F.col("q.qlon"), F.col("q.qlat")))
    wide = F.greatest(*(F.when(F.lit(SIDE / 2**n) >= 2 * F.col("reach"), F.lit(n)).otherwise(F.lit(0)) for n in levels))
    first = stored(first.select("pid", "plon", "plat", "x", "y", "z", reach.alias("reach")).withColumn("level", wide), "reach")
    # The cells that its circle touches.
    near = first.where("level > 0")
    for c in "xyz":
        lo, hi = (_cell(F.col(c) + sign * F.col("reach"), _size(F.col("level"))) for sign in (-1, 1))
        last = F.pow(F.lit(2.0), F.col("level")).cast("long") - 1
        near = near.withColumn(f"c{c}", F.explode(F.sequence(F.greatest(lo, F.lit(0)), F.least(hi, last))))
    near = near.withColumn("cell", _key(F.col("cx"), F.col("cy"), F.col("cz"))).select("pid", "plon", "plat", "level", "cell")
    # Far points: the outlines of few cells, from the deepest level that has no more than `rows`.
    counts = dict(pyramid.groupBy("level").count().collect())
    coarse = max(n for n in levels if n == 0 or counts[n] <= max(rows, 1))
    outlines = pyramid.where(F.col("level") == coarse).select("cell", "qlon", "qlat", *(f"{n}_{c}" for c in "xyz" for n in ("lo", "hi")))
    gap = lambda c: F.greatest(F.col(f"lo_{c}") - F.col(c), F.col(c) - F.col(f"hi_{c}"), F.lit(0.0))
    least = F.sqrt(sum((gap(c) * gap(c) for c in "yz"), gap("x") * gap("x"))) - 1e-9
    far = first.where("level = 0").join(F.broadcast(outlines)).select("pid", "plon", "plat", F.struct("cell", least.alias("least")).alias("c"), _chord(away).alias("most"))
    far = far.groupBy("pid", "plon", "plat").agg(F.collect_list("c").alias("cells"), F.min("most").alias("most"))
    far = far.select("pid", "plon", "plat", F.lit(coarse).alias("level"), F.explode(F.filter("cells", lambda c: c["least"] <= F.col("most"))).alias("c")).select("pid", "plon", "plat", "level", "c.cell")
    pairs = near.unionByName(far).join(celled.select("level", "cell", "qid", "qlon", "qlat"), ["level", "cell"])
    return best(pairs.withColumn("dist_m", away))


# ------------------------------------------------------------------ corroboration


def _observed(events: DataFrame) -> DataFrame:
    """The events that can corroborate or be corroborated, with their time in microseconds."""
    return events.where("lon is not null and lat is not null and at is not null").withColumn("us", F.unix_micros(F.col("at").cast("timestamp")))


def _witnesses(asked: DataFrame, seen: DataFrame, radius_m: float, seconds: int, on: list[str]) -> DataFrame:
    """Pairs of asked (a..., plon, plat, a_us) and seen (b..., qlon, qlat, b_us) within radius and seconds, by equal cells of time and space and equality of `on`."""
    grid, span = Grid(radius_m), max(1, seconds) * 1_000_000
    left = grid.placed(asked, "plon", "plat").withColumn("_tick", F.explode(_around(F.floor(F.col("a_us") / span).cast("long"))))
    right = grid.spread(seen, "qlon", "qlat").withColumn("_tick", F.floor(F.col("b_us") / span).cast("long"))
    pairs = left.join(right, ["_tick", "_band", "_column", *on]).where(F.abs(F.col("a_us") - F.col("b_us")) <= seconds * 1_000_000)
    return pairs.where(great_circle_m(F.col("plon"), F.col("plat"), F.col("qlon"), F.col("qlat")) <= radius_m)


def corroborate(events: DataFrame, radius_m: float, seconds: int) -> DataFrame:
    """For each event (id, source, modality, at, lon, lat) the events of other sources within radius_m and seconds of it: id, others (sorted ids),
    sources and modalities (sorted, distinct). The relation is pairwise, and `others` is a list of pairs; corroborating_kinds does without them."""
    seen = _observed(events)
    left = seen.select(F.col("id").alias("a"), F.col("source").alias("a_source"), F.col("us").alias("a_us"), F.col("lon").alias("plon"), F.col("lat").alias("plat"))
    right = seen.select(F.col("id").alias("b"), F.col("source").alias("b_source"), F.col("modality").alias("b_modality"), F.col("us").alias("b_us"), F.col("lon").alias("qlon"), F.col("lat").alias("qlat"))
    pairs = _witnesses(left, right, radius_m, seconds, []).where("a_source <> b_source")
    return pairs.groupBy(F.col("a").alias("id")).agg(F.array_sort(F.collect_list("b")).alias("others"), F.array_sort(F.collect_set("b_source")).alias("sources"), F.array_sort(F.collect_set("b_modality")).alias("modalities"))


KINDS = 256


def corroborating_kinds(events: DataFrame, radius_m: float, seconds: int) -> DataFrame:
    """id, sources and modalities as corroborate has them, without a list of pairs: of each kind (source and modality; few, at most KINDS) one witness is enough.

    Cells of half the radius hold no two events farther apart than it, so within a cell the events of a kind that are next in time, before and after, decide:
    running extremes over the sorted cell give them. Only kinds without such a witness are sought among the neighbours, so a dense cell makes no pairs."""
    seen = _observed(events).where("source is not null")
    kinds = sorted(((r.source, r.modality) for r in seen.select("source", "modality").distinct().limit(KINDS + 1).collect()), key=repr)
    if len(kinds) > KINDS:
        raise ValueError(f"more than {KINDS} kinds")
    empty = events.select("id").limit(0).withColumn("sources", F.lit(None).cast("array<string>")).withColumn("modalities", F.lit(None).cast("array<string>"))
    if not kinds:
        return empty
    known = F.array(*(F.struct(F.lit(s).cast("string").alias("source"), F.lit(m).cast("string").alias("modality")) for s, m in kinds))
    kind = F.array_position(known, F.struct(F.col("source").cast("string").alias("source"), F.col("modality").cast("string").alias("modality"))).cast("int") - 1
    side = radius_m / 2 / DEGREE_M * 0.999
    band = F.floor(F.col("lat") / side).cast("long")
    width = F.greatest(F.ceil(360.0 * F.cos(F.radians(F.least(F.when(band >= 0, band).otherwise(-band - 1) * side, F.lit(90.0)))) / side), F.lit(1)).cast("long")
    span = seconds * 1_000_000
    rows = seen.withColumn("kind", kind).withColumn("_b", band).withColumn("_c", F.pmod(F.floor((F.col("lon") + 180.0) * width / 360.0).cast("long"), width)).withColumn("_t", F.floor(F.col("us") / (64 * max(1, span))))
    cell = Window.partitionBy("_b", "_c", "_t")
    for name, order, extreme in (("before", F.col("us"), F.max), ("after", F.desc("us"), F.min)):
        rows = rows.withColumn(name, F.array(*(extreme(F.when(F.col("kind") == j, F.col("us"))).over(cell.orderBy(order)) for j in range(len(kinds)))))
    near = lambda j: (F.col("us") - F.get(F.col("before"), j) <= span) | (F.get(F.col("after"), j) - F.col("us") <= span)
    other = F.filter(F.sequence(F.lit(0), F.lit(len(kinds) - 1)), lambda j: F.get(known, j)["source"] != F.col("source").cast("string"))
    rows = stored(rows.select("id", "us", "lon", "lat", "kind", F.filter(other, lambda j: F.coalesce(near(j), F.lit(False))).alias("met"), F.filter(other, lambda j: ~F.coalesce(near(j), F.lit(False))).alias("left")), "kinds")
    asked = rows.select(F.col("id").alias("a"), F.col("us").alias("a_us"), F.col("lon").alias("plon"), F.col("lat").alias("plat"), F.explode("left").alias("kind"))
    there = rows.select("kind", F.col("us").alias("b_us"), F.col("lon").alias("qlon"), F.col("lat").alias("qlat")).distinct()
    found = _witnesses(asked, there, radius_m, seconds, ["kind"]).select(F.col("a").alias("id"), "kind").distinct()
    found = found.unionByName(rows.select("id", F.explode("met").alias("kind")))
    of = lambda name: F.array_sort(F.collect_set(F.get(known, F.col("kind"))[name]))
    return found.groupBy("id").agg(of("source").alias("sources"), of("modality").alias("modalities"))


def band_pairs(df: DataFrame, key: str, at: Column, seconds: int) -> tuple[DataFrame, DataFrame]:
    """(left, right) for a band self-join on `at` (in seconds): both have _tick; rows of left stand in three windows, and pairs within
    `seconds` share one."""
    tick = F.floor(at / seconds).cast("long")
    return df.withColumn("_tick", F.explode(_around(tick))), df.withColumn("_tick", tick)
