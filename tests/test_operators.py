"""Operators against brute force, on both their small and their large way."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratalake.operators import keyed, lookups, quality, series, spatial, summaries


def metres(a, b):
    (x1, y1), (x2, y2) = a, b
    p, q = math.radians(y1), math.radians(y2)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1, math.sqrt(h)))


@pytest.fixture(scope="module")
def globe(spark):
    r = random.Random(4)
    pts = [(i, r.uniform(-180, 180), math.degrees(math.asin(r.uniform(-1, 1)))) for i in range(300)] + [(300, 179.9999, 10.0), (301, 0.0, 89.9999), (302, 0.0, -90.0)]
    places = [(i, r.uniform(-180, 180), math.degrees(math.asin(r.uniform(-1, 1)))) for i in range(200)] + [(200, -179.9999, 10.0), (201, 180.0, 89.9), (202, 90.0, -89.95), (203, 0.0, -89.95)]
    return pts, places, spark.createDataFrame(pts, "pid long, plon double, plat double"), spark.createDataFrame(places, "qid long, qlon double, qlat double")


@pytest.mark.parametrize("radius", [30_000, 900_000, 6_000_000])
def test_within(globe, radius):
    pts, places, p, q = globe
    want = {(a[0], b[0]) for a in pts for b in places if metres(a[1:], b[1:]) <= radius}
    rows = [(r.pid, r.qid) for r in spatial.within(p, q, radius).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


@pytest.mark.parametrize("rows", [10_000, 0])
def test_nearest(globe, rows):
    pts, places, p, q = globe
    want = {a[0]: min((metres(a[1:], b[1:]), b[0]) for b in places) for a in pts}
    got = {r.pid: (r.dist_m, r.qid) for r in spatial.nearest(p, q, rows=rows).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-3 for k in want)


def test_nearest_of_many(spark):
    # 100,000 points and 10,000 places in towns, at a pole, across the date line and on one spot, with far points, against all distances.
    rng = np.random.default_rng(6)

    def somewhere(n):
        towns = np.stack([rng.uniform(-180, 180, 12), rng.uniform(-80, 80, 12)], 1)
        near = towns[rng.integers(0, 12, n)] + rng.normal(0, 0.3, (n, 2))
        near[: n // 10] = np.stack([rng.uniform(-180, 180, n // 10), 90 - np.abs(rng.normal(0, 0.5, n // 10))], 1)
        near[n // 10 : n // 5] = np.stack([180 + rng.normal(0, 0.2, n // 10), rng.normal(-17, 0.2, n // 10)], 1)
        near[-50:] = near[-1]
        return np.stack([(near[:, 0] + 180) % 360 - 180, np.clip(near[:, 1], -90, 90)], 1)

    p, q = somewhere(100_000), somewhere(10_000)
    frame = lambda a, names: spark.createDataFrame(pd.DataFrame({names[0]: np.arange(len(a)), names[1]: a[:, 0], names[2]: a[:, 1]}))
    df = spatial.nearest(frame(p, ("pid", "plon", "plat")), frame(q, ("qid", "qlon", "qlat")))
    got = df.toPandas().sort_values("pid")
    assert got["pid"].tolist() == list(range(len(p)))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 4

    def sphere(a):
        lon, lat = np.radians(a[:, 0]), np.radians(a[:, 1])
        return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1)

    u, v = sphere(p), sphere(q)
    for lo in range(0, len(u), 5000):
        gap = np.linalg.norm(u[lo : lo + 5000] - v[(u[lo : lo + 5000] @ v.T).argmax(1)], axis=1)
        own = np.linalg.norm(u[lo : lo + 5000] - v[got["qid"].to_numpy()[lo : lo + 5000]], axis=1)
        assert np.all(own <= gap + 1e-9)


def test_few_places_make_no_rows_of_points(spark):
    p = spark.range(2000).select(F.col("id").alias("pid"), (F.col("id") % 360 - 180.0).alias("plon"), (F.col("id") % 120 - 60.0).alias("plat"))
    q = spark.range(25).select(F.col("id").alias("qid"), (F.col("id") * 14 - 180.0).alias("qlon"), (F.col("id") * 4 - 50.0).alias("qlat"))
    df = spatial.nearest(p, q)
    assert len(df.collect()) == 2000
    made, open_ = [], [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        name = node.getClass().getSimpleName()
        if "NestedLoopJoin" in name:
            made.append(node.metrics().apply("numOutputRows").value())
        inner = node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan() if name.endswith("QueryStageExec") else None
        below = node.children()
        open_ += [inner] if inner is not None else [below.apply(i) for i in range(below.size())]
    assert made
    assert max(made) <= 2000


def test_corroborate_is_pairwise(spark):
    at = lambda s: f"2024-11-25 10:{s // 60:02d}:{s % 60:02d}" if s < 3600 else f"2024-11-25 11:{(s - 3600) // 60:02d}:{(s - 3600) % 60:02d}"
    deg = 1 / 111195.08
    rows = [("a", "X", "JSON", at(0), 0.0, 0.0), ("b", "Y", "TEXT", at(60), 0.0, 1500 * deg), ("c", "Z", "AUDIO", at(120), 0.0, 3000 * deg), ("d", "X", "JSON", at(0), 10.0, 0.0), ("e", "Y", "TEXT", at(3601), 10.0, 0.0), ("f", "X", "JSON", at(0), 20.0, 0.0), ("g", "Y", "TEXT", at(0), 20.0, 2001 * deg), ("h", "X", "JSON", at(0), 30.0, 0.0), ("i", "X", "TEXT", at(0), 30.0, 0.0), ("j", "Y", "TEXT", at(0), None, None)]
    df = spark.createDataFrame(rows, "id string, source string, modality string, at string, lon double, lat double").withColumn("at", F.col("at").cast("timestamp"))
    got = {r.id: r.others for r in spatial.corroborate(df, 2000, 3600).collect()}
    assert got == {"a": ["b"], "b": ["a", "c"], "c": ["b"]}


@pytest.mark.parametrize("rows", [10_000, 0])
def test_most_alike(spark, rows):
    refs = spark.createDataFrame([("1", "1o Pel Fuz/511"), ("2", "2o Pel Fuz/511"), ("3", "1o Pel Fuz/512"), ("4", "Esqd Cav")], "v string, k string")
    read = spark.createDataFrame([(1, "10 Pel Fuz/511", "511"), (2, "Pel Fuz", "511"), (3, "20 Pe", "511"), (4, "nothing at all", None), (5, "", None), (6, None, None), (7, "Esqd Ca", None), (8, "1o Pel Fuz/51", None)], "id int, t string, c string")
    got = {r.id: r.value for r in lookups.most_alike(read, "id", F.col("t"), refs, F.col("k"), F.col("v"), 2, F.col("c"), rows).collect()}
    assert got == {1: "1", 2: None, 3: "2", 4: None, 5: None, 6: None, 7: "4", 8: None}


@pytest.mark.parametrize("rows", [10_000, 0])
def test_contained_longest(spark, rows):
    refs = spark.createDataFrame([("b", "511o Btl"), ("c", "1a Cia/511o Btl"), ("p", "2o Pel/1a Cia/511o Btl")], "v string, k string")
    read = spark.createDataFrame([(1, "Cap Cmt 2o Pel/1a Cia/511o Btl - 123"), (2, "Maj 511o Btl"), (3, "none"), (4, None)], "id int, t string")
    got = {r.id: r.value for r in lookups.contained_longest(read, "id", F.col("t"), refs, F.col("k"), F.col("v"), rows).collect()}
    assert got == {1: "p", 2: "b", 3: None, 4: None}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def alike_by_hand(read, refs, limit):
    out = {}
    for i, t, c in read:
        near = sorted((edits(t, k[: len(t)]), v) for k, v in set(refs) if not c or k.endswith(c)) if t else []
        near = [x for x in near if x[0] <= limit]
        out[i] = near[0][1] if near and sum(d == near[0][0] for d, _ in near) == 1 else None
    return out


@pytest.mark.parametrize(("limit", "letters"), [(0, "abc"), (2, "abc"), (3, "abcdefgh"), (9, "ab"), (5, "abcdefghijklmnop")])
def test_most_alike_equals_brute_force(spark, limit, letters):
    r = random.Random(limit)
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    refs = [(word(r.randint(1, 24)) + r.choice(["", "xy"]), i % 90) for i in range(120)]
    read = []
    for i in range(160):
        t = list(r.choice(refs)[0] if r.random() < 0.8 else word(r.randint(0, 20)))
        for _ in range(r.randint(0, limit)):
            at = r.randint(0, len(t))
            t[at : at + r.randint(0, 1)] = r.choice(["", "z", r.choice(letters)])
        read.append((i, "".join(t)[: r.randint(1, 24)], r.choice([None, None, "", "xy"])))
    df, known = spark.createDataFrame(read, "id int, t string, c string"), spark.createDataFrame(refs, "k string, v int")
    got = {x.id: x.value for x in lookups.most_alike(df, "id", F.col("t"), known, F.col("k"), F.col("v"), limit, F.col("c"), rows=0).collect()}
    assert got == alike_by_hand(read, refs, limit)


def test_dense_names_make_no_pairs(spark, monkeypatch):
    # Every number is a name, so texts with wrong letters are as near to many of them; no name is compared with a text for sharing a piece.
    monkeypatch.setattr(lookups, "candidates", None)
    refs = [(f"n#{i:04d}", v) for i in range(300) for v in ([i, i + 1000] if i % 50 == 3 else [i])]
    read = [(i, f"n#{i:04d}".replace("1", "l").replace("7", ""), None) for i in range(0, 1000, 3)]
    df, known = spark.createDataFrame(read, "id int, t string, c string"), spark.createDataFrame(refs, "k string, v int")
    got = {x.id: x.value for x in lookups.most_alike(df, "id", F.col("t"), known, F.col("k"), F.col("v"), 3, None, rows=0).collect()}
    assert got == alike_by_hand(read, refs, 3)
    assert {None} < set(got.values())


def test_few_of_all_pairs_are_candidates(spark):
    # Names that differ in few letters, read with many wrong ones, as in the catalogue: 9 edits of 18 letters are allowed.
    names = spark.range(1000).select(F.format_string("supplier#%09d", F.col("id")).alias("_s"))
    texts = names.select(F.regexp_replace("_s", "0", "o").alias("_t"), F.lit(None).cast("string").alias("_c"))
    index, counts = lookups.piece_index(names)
    plan = lookups.piece_plan(texts, counts, 9)
    assert plan.where("spent < 6").count() == 0 and plan.count() == 1000
    assert lookups.candidates(plan, index, 0, 9).count() < 0.05 * 1000 * 1000


def test_prefixes_meet_one_row_each(spark):
    r = random.Random(5)
    keys = ["".join(r.choice("ab") for _ in range(r.randint(1, 8))) for _ in range(200)]
    refs = [(k, i % 50) for i, k in enumerate(keys)]
    read = [(i, "".join(r.choice("ab") for _ in range(r.randint(1, 4))), r.choice([None, "", "a", "ba"])) for i in range(300)]
    df, known = spark.createDataFrame(read, "id int, t string, c string"), spark.createDataFrame(refs, "k string, v int")
    got = {x.id: x.value for x in lookups.prefix_unique(df, "id", F.col("t"), known, F.col("k"), F.col("v"), F.col("c")).collect()}
    want = {}
    for i, t, c in read:
        met = {v for k, v in refs if k.startswith(t) and (not c or k.endswith(c))}
        want[i] = met.pop() if len(met) == 1 else None
    assert got == want


def test_prefix_unique(spark):
    refs = spark.createDataFrame([("1", "Pel C Ap/1"), ("2", "Pel Com/1"), ("3", "Pel Com/2"), ("4", "1a Cia/2")], "v string, k string")
    read = spark.createDataFrame([(1, "Pel C", "1"), (2, "Pel Com", "1"), (3, "1ª Cia", None), (4, "Pel Com", None), (5, None, None)], "id int, t string, c string")
    got = {r.id: r.value for r in lookups.prefix_unique(read, "id", F.col("t"), refs, F.col("k"), F.col("v"), F.col("c")).collect()}
    assert got == {1: None, 2: "2", 3: "4", 4: None, 5: None}


def test_keyed(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    got = sorted(map(tuple, keyed.upsert(base, spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string"), ["k"]).collect()))
    assert got == [(1, "a"), (2, "x"), (3, "y")]
    assert [tuple(r) for r in keyed.new_rows(spark.createDataFrame([(2, "x"), (4, "p"), (4, "o")], "k int, v string"), base, ["k"], ["v"]).collect()] == [(4, "o")]
    with pytest.raises(ValueError, match="null"):
        keyed.check_keys(spark.createDataFrame([(None, "x")], "k int, v string"), ["k"])
    with pytest.raises(ValueError, match="more than once"):
        keyed.check_keys(spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), ["k"])


def test_trend(spark):
    df = spark.createDataFrame([("s", 1, 5.0), ("s", 2, 5.0), ("s", 3, 7.25), ("s", 4, 1.0)], "k string, t int, v double")
    rows = series.with_trend(df, ["k"], ["t"], "v", "t").orderBy("t").collect()
    assert [r.trend for r in rows] == ["NO_BASE", "STABLE", "UP", "DOWN"] and [r.is_current for r in rows] == [False, False, False, True]


def test_word_errors_and_wilson(spark):
    df = spark.createDataFrame([("a b c d", "a x c"), ("", "a b"), ("A b", "a B")], "r string, t string")
    assert [r.e for r in df.select(quality.word_errors(F.col("r"), F.col("t")).alias("e")).collect()] == [2, 2, 0]
    w = spark.range(1).select(quality.wilson(F.lit(20.0), F.lit(22.0)).alias("w")).first()["w"]
    assert abs(w["lo"] - 0.7218) < 1e-3 and abs(w["hi"] - 0.9747) < 1e-3


def test_word_errors_of_very_many_words(spark):
    n = 43_000
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)), " ".join(f"w{i}" for i in range(n - 2000)) + " x")], "r string, t string")
    codes = df.select(F.transform(F.sequence(F.lit(41_900), F.lit(42_100)), lambda p: F.decode(F.unhex(F.lpad(F.hex(p + F.when(p < 0xD800 - 0x3400, 0x3400).otherwise(0x3C00)), 8, "0")), "UTF-32")).alias("c")).first().c
    assert len(set(codes)) == 201 and all(len(c) == 1 and "\ufffd" != c for c in codes)


def test_small_counts_bytes(spark):
    from stratalake.operators.sized import is_small

    wide = spark.range(100).select("id", F.repeat(F.lit("x"), 100_000).alias("t"), F.array("id").alias("a"))
    assert is_small(wide) and not is_small(wide, most=1 << 20) and not is_small(wide, rows=99) and is_small(wide.limit(0))


def test_block_refuses_unknown_columns(spark):
    with pytest.raises(ValueError, match="zz"):
        series.block(spark.range(1), [("a", "int")], zz=F.lit(1))


def test_counts_within_equal_brute_force(spark):
    r = random.Random(4)
    rows = [(i, r.choice("abc"), r.randint(-30, 60) if i % 5 else 7) for i in range(120)] + [(200, None, 3), (201, "a", None)]
    got = {(x.id, x.kind): x.n for x in series.counts_within(spark.createDataFrame(rows, "i long, k string, t long"), "i", "k", "t", 10).collect()}
    want = {(i, k): n for i, own, t in rows if own and t is not None for k in "abc" if k != own and (n := sum(1 for _, o, u in rows if o == k and u is not None and abs(u - t) <= 10))}
    assert got == want


def test_no_pairs_of_all_beyond_the_limit(spark):
    # Whatever is too many for a join without an equality goes by keys.
    p = spark.createDataFrame([(i, float(i % 50), float(i % 40)) for i in range(400)], "pid long, plon double, plat double")
    q = p.toDF("qid", "qlon", "qlat")
    read = spark.createDataFrame([(i, f"unit {i}") for i in range(300)], "id long, t string")
    refs = read.toDF("x", "k")
    plans = [spatial.nearest(p, q), lookups.most_alike(read.where("id > 10"), "id", F.col("t"), refs, F.col("k"), F.col("k"), 2), lookups.contained_longest(read, "id", F.col("t"), refs, F.col("k"), F.col("k"))]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan
        # A nested loop may only meet the few lengths that references have, or the beginnings that the alphabet bounds.
        assert plan.count("BroadcastNestedLoopJoin") <= 2


def test_quantiles(spark):
    r = random.Random(3)
    rows = [(k, None if r.random() < 0.05 else float(r.choice([r.gauss(0, 10), round(r.gauss(0, 2))]))) for k in ["a"] * 5000 + ["b"] * 37 + [None] * 400 for _ in [0]] + [("c", 2.5), ("d", None)]
    df, qs = spark.createDataFrame(rows, "k string, v double").repartition(5), [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    exact = {(x.k, x.q): x.quantile for x in summaries.exact_quantiles(df, ["k"], "v", qs, 100).collect()}
    near = {(x.k, x.q): x.quantile for x in summaries.sketched_quantiles(df, ["k"], "v", qs, 100).collect()}
    assert {k for k, _ in exact} == {k for k, _ in near} == {"a", "b", "c", None}
    for k in ("a", "b", "c", None):
        own = sorted(v for x, v in rows if x == k and v is not None)
        for q in qs:
            assert abs(exact[k, q] - float(np.quantile(own, q))) < 1e-9
            ranks = [i for i, v in enumerate(own) if v == near[k, q]]
            assert min(ranks) - 1 - len(own) / 100 <= q * (len(own) - 1) <= max(ranks) + 1 + len(own) / 100
    for n in (150, 190, 205, 401, 999):
        own = [float(i * 7919 % 1009) for i in range(n)]
        found = summaries.exact_quantiles(spark.createDataFrame([(x,) for x in own], "v double"), [], "v", qs, 100).collect()
        assert all(abs(x.quantile - float(np.quantile(own, x.q))) < 1e-9 for x in found) and len(found) == len(qs)
    plan = summaries.exact_quantiles(df, ["k"], "v", qs)._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "collect_list" not in plan


def test_distinct_counts_shuffle_once(spark):
    df = spark.createDataFrame([("x", i % 3, i % 5, i) for i in range(4000)] + [("y", None, 1, 1)], "k string, a int, b int, c int")
    found = summaries.distinct_counts(df, ["k"], {"a": F.col("a"), "b": F.col("b")}, {"c": F.col("c")})
    got = {r.k: (r.a, r.b, r.c) for r in found.collect()}
    assert got["x"][:2] == (3, 5) and abs(got["x"][2] - 4000) < 200 and got["y"] == (0, 1, 1)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Expand" not in plan and found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_same_sets_without_a_window(spark):
    rows = [(1, ["b", "a"], 3, 5), (2, ["a", "b"], 3, 9), (3, ["a", "b"], 4, None), (4, ["c"], 1, 1), (5, [], 1, 1)]
    df = spark.createDataFrame(rows, "i int, s array<string>, n int, t long")
    once = series.same_sets(df, [], "s", [series.descending(F.col("n")), series.descending(F.col("t")), F.col("i")])
    assert sorted(r.i for r in once.collect()) == [3, 4, 5]
    assert "Window" not in once._jdf.queryExecution().executedPlan().toString()


def observations(n, spread, seed):
    r = random.Random(seed)
    centre = [(0.0, 0.0), (179.999, 60.0), (20.0, 89.99), (-45.0, -22.0)]
    rows = []
    for i in range(n):
        x, y = r.choice(centre)
        lon = (x + r.gauss(0, spread) / max(0.02, math.cos(math.radians(y))) + 180) % 360 - 180
        rows.append((i, r.choice("ABC") if i % 17 else None, r.choice(["JSON", "TEXT", None]), r.randint(0, 20_000), lon, min(90.0, y + r.gauss(0, spread))))
    return [*rows, (n, "A", "JSON", None, 0.0, 0.0), (n + 1, "B", "JSON", 5, None, None), (n + 2, *rows[0][1:])]


SEEN = "id long, source string, modality string, s long, lon double, lat double"


def test_corroboration_equals_brute_force(spark):
    rows = observations(260, 0.02, 2)
    df = spark.createDataFrame(rows, SEEN).withColumn("at", F.timestamp_seconds("s"))
    want = {}
    for a in rows:
        met = [b for b in rows if None not in (a[1], b[1], a[3], b[3], a[4], b[4]) and a[1] != b[1] and abs(a[3] - b[3]) <= 1800 and metres(a[4:], b[4:]) <= 2000]
        if met:
            want[a[0]] = (sorted(b[0] for b in met), sorted({b[1] for b in met}), sorted({b[2] for b in met} - {None}))
    got = {r.id: (r.others, r.sources, r.modalities) for r in spatial.corroborate(df, 2000, 1800).collect()}
    assert got == want and len(want) > 100
    kinds = {r.id: (r.sources, r.modalities) for r in spatial.corroborating_kinds(df, 2000, 1800).collect()}
    assert kinds == {k: v[1:] for k, v in want.items()}
    assert spatial.corroborating_kinds(df.where("id < 0"), 2000, 1800).collect() == []


def test_a_dense_cell_makes_no_pairs(spark):
    # 100,000 events of six kinds within a kilometre and an hour: ten billion pairs.
    df = spark.range(100_000).select("id", F.element_at(F.lit(["A", "B", "C"]), (F.col("id") % 3 + 1).cast("int")).alias("source"), F.when(F.col("id") % 2 == 0, "JSON").otherwise("TEXT").alias("modality"), F.timestamp_seconds(F.col("id") * 7919 % 3600).alias("at"), (F.col("id") * 104729 % 1000 / 1e5).alias("lon"), (F.col("id") * 15485863 % 1000 / 1e5).alias("lat"))
    got = spatial.corroborating_kinds(df, 2000, 3600).groupBy("sources", "modalities").count().collect()
    assert sorted((r.sources, r.modalities) for r in got) == [(s, ["JSON", "TEXT"]) for s in (["A", "B"], ["A", "C"], ["B", "C"])] and sum(r["count"] for r in got) == 100_000
