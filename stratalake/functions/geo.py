"""Geography over WKT text (longitude first) and plain numbers, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8
NUMBER = r"-?\d+(?:\.\d+)?"
# WGS84 and the UTM scale, fixed values
AXIS, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def great_circle_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance in metres between points in degrees."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def vertices(wkt: Column) -> Column:
    """array<struct<x,y>> of the vertices of a WKT text; the closing vertex of a ring of more than two is dropped; empty if none."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(wkt, F.lit("")), F.lit("(" + NUMBER + ")"), F.lit(1)), lambda x: x.cast("double"))
    paired = lambda n: F.transform(F.filter(n, lambda _, i: i % 2 == 0), lambda x, i: F.struct(x.alias("x"), F.get(n, i * 2 + 1).alias("y")))
    whole = let(numbers, lambda n: F.filter(paired(n), lambda p: p["y"].isNotNull()))
    closed = lambda v: (F.size(v) > 2) & (F.get(v, F.lit(0)) == F.get(v, F.size(v) - 1))
    return let(whole, lambda v: F.when(closed(v), F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0)))).otherwise(v))


def centre(wkt: Column) -> Column:
    """struct<x,y> of the mean vertex, null if the text has none."""
    mean = lambda v, name: F.aggregate(v, F.lit(0.0), lambda a, p: a + p[name]) / F.size(v)
    return let(vertices(wkt), lambda v: F.when(F.size(v) > 0, F.struct(mean(v, "x").alias("x"), mean(v, "y").alias("y"))))


def wkt_distance_m(a: Column, b: Column) -> Column:
    """Metres between the centres of two WKT texts, null if either has no vertex."""
    return let(centre(a), lambda p: let(centre(b), lambda q: great_circle_m(p["x"], p["y"], q["x"], q["y"])))


def point(lon: Column, lat: Column, digits: int | None = None) -> Column:
    """POINT(lon lat), null outside the range of longitudes and latitudes."""
    text = (lambda v: F.format_string(f"%.{digits}f", v)) if digits is not None else (lambda v: v.cast("string"))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.concat(F.lit("POINT("), text(lon), F.lit(" "), text(lat), F.lit(")")))


def dms_point(text: Column) -> Column:
    """Two groups of degrees, minutes, seconds and hemisphere -> POINT with six decimals; anything else null. S, W and O are negative."""
    pattern = r"(\d+)\D+(\d+)\D+([\d.]+)\D*([NSEWLO])"
    upper = F.upper(F.coalesce(text, F.lit("")))
    part = lambda g: F.regexp_extract_all(upper, F.lit(pattern), F.lit(g))

    def degrees(i: int) -> Column:
        number = lambda g: F.get(part(g), F.lit(i)).try_cast("double")
        value = number(1) + number(2) / 60 + number(3) / 3600
        return F.when(F.get(part(4), F.lit(i)).isin("S", "W", "O"), -value).otherwise(value)

    lat, lon = degrees(0), degrees(1)
    return F.when((F.size(part(1)) == 2) & lat.isNotNull() & lon.isNotNull(), F.format_string("POINT(%.6f %.6f)", lon, lat))


def geojson_wkt(text: Column) -> Column:
    """GeoJSON Point, LineString or Polygon -> WKT with the numbers as written; anything else, and bad JSON, null."""
    kind = F.upper(F.get_json_object(text, "$.type"))
    raw = F.get_json_object(text, "$.coordinates")
    pair = lambda p: F.array_join(F.slice(p, 1, 2), " ")
    line = lambda ps: F.array_join(F.transform(ps, pair), ", ")
    one = F.from_json(raw, "array<string>")
    many = F.from_json(raw, "array<array<string>>")
    rings = F.from_json(raw, "array<array<array<string>>>")
    body = F.when((kind == "POINT") & (F.size(one) >= 2), pair(one)).when((kind == "LINESTRING") & (F.size(many) > 0), line(many))
    body = body.when((kind == "POLYGON") & (F.size(rings) > 0), F.array_join(F.transform(rings, lambda r: F.concat(F.lit("("), line(r), F.lit(")"))), ", "))
    return F.when(body.isNotNull() & (body != ""), F.concat(kind, F.lit("("), body, F.lit(")")))


def utm_inverse(east: Column, north: Column, zone: Column, south: Column) -> Column:
    """struct<x,y> in degrees of UTM coordinates on WGS84: the inverse transverse Mercator series in the footpoint latitude."""
    e2 = FLATTENING * (2 - FLATTENING)
    ep2 = e2 / (1 - e2)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    y = F.when(south, north - 1e7).otherwise(north)
    mu = y / (SCALE * AXIS * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    series = {2: 3 * e1 / 2 - 27 * e1**3 / 32, 4: 21 * e1**2 / 16 - 55 * e1**4 / 32, 6: 151 * e1**3 / 96, 8: 1097 * e1**4 / 512}
    def of_mu(mu: Column) -> Column:
        foot = mu
        for k, a in series.items():
            foot = foot + a * F.sin(k * mu)
        return let(foot, of_foot)

    def of_foot(foot: Column) -> Column:
        sin2 = F.pow(F.sin(foot), 2)
        d = (east - 5e5) * F.sqrt(1 - e2 * sin2) / (AXIS * SCALE)
        # The radii of curvature across and along the meridian are in the ratio that follows.
        ratio = (1 - e2 * sin2) / (1 - e2)
        return let(F.struct(foot.alias("foot"), d.alias("d"), ratio.alias("ratio"), F.pow(F.tan(foot), 2).alias("t"), (ep2 * F.pow(F.cos(foot), 2)).alias("c")), of_parts)

    def of_parts(p: Column) -> Column:
        d, t, c = p["d"], p["t"], p["c"]
        lat = p["foot"] - p["ratio"] * F.tan(p["foot"]) * (F.pow(d, 2) / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * F.pow(d, 6) / 720)
        lon = (d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * F.pow(d, 5) / 120) / F.cos(p["foot"])
        return F.struct((F.degrees(lon) + zone * 6 - 183).alias("x"), F.degrees(lat).alias("y"))

    return let(mu, of_mu)


def decametric_point(text: Column, area_wkt: Column, reach_km: float = 150) -> Column:
    """A pair of five-digit UTM coordinates in tens of metres -> POINT at the centre of its square. The area gives the zone and settles
    the lost million-metre digit: of the ten candidates the nearest to its centre counts, null if it is beyond reach_km."""
    pattern = r"(\d{5})\s*-\s*(\d{5})"
    shown = F.coalesce(text, F.lit(""))
    read = lambda g: F.regexp_extract(shown, pattern, g).try_cast("double") * 10 + 5

    def of_known(k: Column) -> Column:
        def candidate(i: Column) -> Column:
            place = utm_inverse(k["east"], k["north"] + i * 1e6, F.floor((k["x"] + 180) / 6) + 1, k["y"] < 0)
            km = lambda p: 111.195 * F.hypot(p["y"] - k["y"], (p["x"] - k["x"]) * F.cos(F.radians(k["y"])))
            return let(place, lambda p: F.struct(km(p).alias("km"), p["x"].alias("x"), p["y"].alias("y")))

        best = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(9)), candidate))
        usable = k["east"].isNotNull() & k["north"].isNotNull() & k["x"].isNotNull()
        return F.when(usable, let(best, lambda p: F.when(p["km"] <= reach_km, F.format_string("POINT(%.6f %.6f)", p["x"], p["y"]))))

    return let(centre(area_wkt), lambda m: let(F.struct(read(1).alias("east"), read(2).alias("north"), m["x"].alias("x"), m["y"].alias("y")), of_known))
