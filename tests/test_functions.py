"""Golden cases of the scalar transformations."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stratalake.functions import geo, text, times


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(
    ("given", "want"),
    [("22° 41' 38.8\" S, 45° 07' 10.7\" W", "POINT(-45.119639 -22.694111)"), ("Sem localizacao", None), (None, None), ("22° 41' 38.8\" S", None), ("", None)],
)
def test_dms(spark, given, want):
    assert one(spark, geo.dms_point(lit(given))) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ('{"type":"Point","coordinates":[1.5,2]}', "POINT(1.5 2)"),
        ('{"type":"LineString","coordinates":[[1,2],[3,4]]}', "LINESTRING(1 2, 3 4)"),
        ('{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,0]]]}', "POLYGON((0 0, 1 0, 0 0))"),
        ('{"type":"MultiPoint","coordinates":[[1,2]]}', None),
        ('{"type":"Point"}', None),
        ("{bad", None),
        (None, None),
    ],
)
def test_geojson(spark, given, want):
    assert one(spark, geo.geojson_wkt(lit(given))) == want


def test_decametric(spark):
    area = "POLYGON((-45 -22.8, -44.4 -22.8, -44.4 -22.4, -45 -22.4, -45 -22.8))"
    got = one(spark, geo.decametric_point(lit("50231-49457"), lit(area)))
    lon, lat = map(float, got[6:-1].split())
    assert abs(lon + 44.977467) < 1e-5 and abs(lat + 22.655864) < 1e-5
    assert one(spark, geo.decametric_point(lit("nothing"), lit(area))) is None
    assert one(spark, geo.decametric_point(lit("50231-49457"), lit(None))) is None
    assert one(spark, geo.decametric_point(lit("99999-11111"), lit(area))) is None


def test_distance(spark):
    assert round(one(spark, geo.wkt_distance_m(lit("POINT(0 0)"), lit("POINT(0 1)"))), 2) == 111195.08
    square = "POLYGON((0 0, 0 2, 2 2, 2 0, 0 0))"
    assert one(spark, geo.wkt_distance_m(lit(square), lit("POINT(1 1)"))) == 0
    assert one(spark, geo.wkt_distance_m(lit("POINT EMPTY"), lit("POINT(1 1)"))) is None


def test_point_range(spark):
    assert one(spark, geo.point(F.lit(10.0), F.lit(95.0))) is None


@pytest.mark.parametrize(
    ("given", "want"),
    [("250539 NOV 24", datetime(2024, 11, 25, 8, 39)), ("Obs 250539 nov 24 x", datetime(2024, 11, 25, 8, 39)), ("250539 NOV 24 250540 NOV 24", None), ("252439 NOV 24", None), ("250539 XXX 24", None), ("310539 FEV 24", None), (None, None)],
)
def test_date_time_group(spark, given, want):
    assert one(spark, times.date_time_group(lit(given), "-03:00")) == want


def test_times(spark):
    assert one(spark, times.day_first(lit("25/11/2024 14:09:32"), zone="-03:00")) == datetime(2024, 11, 25, 17, 9, 32)
    assert one(spark, times.day_first(lit("never"))) is None
    assert one(spark, times.iso(lit("2024-11-25T10:00:00Z"))) == datetime(2024, 11, 25, 10)
    assert one(spark, times.iso(lit("2024-11-25T10:00:59Z"), utc=True)) == datetime(2024, 11, 25, 10)


VALUES = {"URGENT": ["alta", "critica"], "ROUTINE": ["baixa"]}


@pytest.mark.parametrize(("given", "want"), [("Alta", "URGENT"), (" critica ", "URGENT"), ("urgent", "URGENT"), ("Baixa", "ROUTINE"), ("xyz", None), (None, None)])
def test_vocabulary(spark, given, want):
    assert one(spark, text.vocabulary(lit(given), VALUES)) == want


def test_vocabulary_word(spark):
    kinds = {"ENEMY": ["cavalo", "tambor"]}
    found = lambda other: one(spark, text.vocabulary_or_word(lit(None), kinds, lit(other), ["cavalo", "tambor"]))
    assert found("tres cavalos na ponte") == "ENEMY"
    assert found("tamborim") is None
    with pytest.raises(ValueError, match="rio"):
        text.vocabulary_or_word(lit(None), kinds, lit(""), ["rio"])


def test_comparable(spark):
    assert {one(spark, text.comparable(lit(x))) for x in ("1ª Cia", "1a  Cia", "1 Cia ", "1A CIA")} == {"1 cia"}


def test_small_ones(spark):
    assert one(spark, text.integer(lit("56.1"))) == 56 and one(spark, text.integer(lit("x"))) is None
    cells = F.create_map(lit("a"), lit("1"), lit("Obs"), lit("z"), lit("n"), lit(None))
    assert one(spark, text.leftover(cells, ["a"])) == '{"Obs":"z"}'
    assert one(spark, text.leftover(cells, ["a", "Obs"])) is None
    assert [one(spark, text.weapon(lit("2/Ob/Me | Ntz"), i)) for i in (1, 2, 3)] == ["2", "Ob", "Me"]
    assert one(spark, text.composed(lit("a"), lit(None), lit("b"))) == "a_b"
