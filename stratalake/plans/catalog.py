"""Every query of the engine by name, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalake.functions import geo, text, times
from stratalake.operators import keyed, lookups, quality, series, spatial, summaries
from stratalake.operators.sized import small
from stratalake.sources import arrays

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def stamp(column) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def seconds(column):
    """Seconds since 1970 of a wall-clock time, in no zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), column)


# ------------------------------------------------------------------ flagship


@query("""
WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r = 1),
p AS (SELECT a.event_id, count(*) AS n_others, count(DISTINCT b.event_type) AS n_types FROM latest a JOIN latest b ON a.event_type <> b.event_type AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000 GROUP BY a.event_id)
SELECT l.event_id, l.user_id, l.event_type, coalesce(n_others, 0) AS n_others, coalesce(n_types, 0) AS n_types FROM latest l LEFT JOIN p ON l.event_id = p.event_id
ORDER BY n_others DESC, l.event_id LIMIT 50""")
def corroborated_latest(spark, d):
    newest = series.latest_by(load(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], ["ts", "event_id"])
    placed = newest.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    met = series.counts_within(placed, "event_id", "event_type", "us", 600_000_000).groupBy(F.col("id").alias("event_id")).agg(F.sum("n").alias("n_others"), F.count("*").alias("n_types"))
    out = newest.join(met, "event_id", "left").select("event_id", "user_id", "event_type", F.coalesce("n_others", F.lit(0)).alias("n_others"), F.coalesce("n_types", F.lit(0)).alias("n_types"))
    return out.orderBy(F.desc("n_others"), "event_id").limit(50)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return corroborated_latest(spark, d)


# ------------------------------------------------------------------ latest rows and series


@query("""SELECT user_id, event_type, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r = 1""")
def latest_per_key(spark, d):
    ev = load(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return series.latest_by(ev, ["user_id", "event_type"], ["ts", "event_id"]).withColumn("ts", stamp("ts"))


@query("""SELECT l_suppkey, l_returnflag, l_linestatus, l_linenumber, l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_linestatus, l_linenumber ORDER BY l_shipdate DESC, l_orderkey DESC, l_partkey DESC) r FROM lineitem) WHERE r = 1""")
def latest_per_four_keys(spark, d):
    keys = ["l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber"]
    li = load(spark, d, "lineitem").select(*keys, "l_orderkey", "l_partkey", "l_shipdate")
    return series.latest_by(li, keys, ["l_shipdate", "l_orderkey", "l_partkey"]).drop("l_shipdate")


@query("""
WITH m AS (SELECT o_custkey, o_orderkey, o_orderdate, 'price' AS indicator, o_totalprice AS value FROM orders UNION ALL SELECT o_custkey, o_orderkey, o_orderdate, 'month', CAST(month(o_orderdate) AS DOUBLE) FROM orders),
s AS (SELECT *, lag(value) OVER (PARTITION BY o_custkey, indicator ORDER BY o_orderdate, o_orderkey) AS previous, o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey, indicator) AS is_current FROM m)
SELECT o_custkey, o_orderkey, indicator, value, previous, is_current, CASE WHEN previous IS NULL THEN 'NO_BASE' WHEN abs(value - previous) < 1e-6 THEN 'STABLE' WHEN value > previous THEN 'UP' ELSE 'DOWN' END AS trend FROM s""")
def lag_trend(spark, d):
    o = load(spark, d, "orders")
    m = series.unpivot(o, ["o_custkey", "o_orderkey", "o_orderdate"], {"price": F.col("o_totalprice"), "month": F.month("o_orderdate")})
    out = series.with_trend(m, ["o_custkey", "indicator"], ["o_orderdate", "o_orderkey"], "value", "o_orderdate")
    return out.select("o_custkey", "o_orderkey", "indicator", "value", "previous", "is_current", "trend")


@query("""SELECT user_id, strftime(prev, '%Y-%m-%d %H:%M:%S') AS gap_start, strftime(ts, '%Y-%m-%d %H:%M:%S') AS gap_end FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events) WHERE (epoch_us(ts) - epoch_us(prev)) // 1000000 > 3600""")
def gap_detection(spark, d):
    g = series.gaps(load(spark, d, "events"), ["user_id"], "ts", 3600)
    return g.select("user_id", stamp("gap_start").alias("gap_start"), stamp("gap_end").alias("gap_end"))


@query("""
WITH s AS (SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), '|') AS types, max(ts) AS t, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, types, n FROM (SELECT *, row_number() OVER (PARTITION BY types ORDER BY n DESC, t DESC, user_id) r FROM s) WHERE r = 1""")
def set_identity_dedupe(spark, d):
    s = load(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("types"), F.max("ts").alias("t"), F.count("*").alias("n"))
    out = series.same_sets(s, [], "types", [series.descending(F.col("n")), series.descending(F.unix_micros(F.col("t").cast("timestamp"))), F.col("user_id")])
    return out.select("user_id", F.array_join(F.array_sort("types"), "|").alias("types"), "n")


# ------------------------------------------------------------------ spatial and band joins


@query("""
SELECT a.event_id, count(*) AS n, count(DISTINCT b.event_type) AS n_types, array_to_string(list_sort(list(b.event_id)), ',') AS others FROM events a JOIN events b
ON a.event_type <> b.event_type AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000 AND abs(a.user_id - b.user_id) <= 5 GROUP BY a.event_id""")
def corroboration_band_join(spark, d):
    ev = load(spark, d, "events").select("event_id", "event_type", "user_id", "ts").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")
    left, right = spatial.band_pairs(ev, "event_id", F.col("us") / 1_000_000, 600)
    # Users are cut into bands as well, so a dense hour is spread over them.
    left = left.withColumn("_band", F.explode(F.sequence(F.floor(F.col("user_id") / 5) - 1, F.floor(F.col("user_id") / 5) + 1)))
    right = right.select("_tick", F.floor(F.col("user_id") / 5).alias("_band"), F.col("event_id").alias("b_id"), F.col("event_type").alias("b_type"), F.col("user_id").alias("b_user"), F.col("us").alias("b_us"))
    met = left.join(right, ["_tick", "_band"]).where((F.col("event_type") != F.col("b_type")) & (F.abs(F.col("us") - F.col("b_us")) <= 600_000_000) & (F.abs(F.col("user_id") - F.col("b_user")) <= 5))
    return met.groupBy("event_id").agg(F.count("*").alias("n"), F.countDistinct("b_type").alias("n_types"), F.array_join(F.array_sort(F.collect_list("b_id")), ",").alias("others"))


@query("""
WITH e AS (SELECT event_id, event_type AS source, CASE WHEN event_id % 3 = 0 THEN 'TEXT' ELSE 'JSON' END AS modality, epoch_us(ts) AS us, (user_id % 100) / 100.0 AS lon, (user_id * 7 % 100) / 100.0 AS lat FROM events),
p AS (SELECT a.event_id, b.source, b.modality FROM e a JOIN e b ON a.source <> b.source AND abs(a.us - b.us) <= 600000000
WHERE 2 * 6371008.8 * asin(sqrt(least(1.0, power(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))) <= 30000)
SELECT event_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, array_to_string(list_sort(list(DISTINCT modality)), ',') AS modalities FROM p GROUP BY event_id""")
def corroborating_kinds(spark, d):
    """Which other kinds of events an event has near it in time and space; no list of pairs is made."""
    e = load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), F.when(F.col("event_id") % 3 == 0, "TEXT").otherwise("JSON").alias("modality"), F.col("ts").alias("at"), (F.col("user_id") % 100 / 100.0).alias("lon"), (F.col("user_id") * 7 % 100 / 100.0).alias("lat"))
    met = spatial.corroborating_kinds(e, 30_000, 600)
    return met.select(F.col("id").alias("event_id"), F.array_join("sources", ",").alias("sources"), F.array_join("modalities", ",").alias("modalities"))


_POINTS = """
p AS (SELECT c_custkey AS pid, (c_custkey * 37 % 36000) / 100.0 - 180 AS plon, (c_custkey * 53 % 12000) / 100.0 - 60 AS plat FROM customer),
q AS (SELECT n_nationkey AS qid, n_name, (n_nationkey * 1440 % 36000) / 100.0 - 180 AS qlon, (n_nationkey * 977 % 12000) / 100.0 - 60 AS qlat FROM nation),
x AS (SELECT *, 2 * 6371008.8 * asin(sqrt(least(1.0, power(sin((radians(qlat) - radians(plat)) / 2), 2) + cos(radians(plat)) * cos(radians(qlat)) * power(sin(radians(qlon - plon) / 2), 2)))) AS dist FROM p CROSS JOIN q)"""


def _points(spark, d):
    p = load(spark, d, "customer").select(F.col("c_custkey").alias("pid"), ((F.col("c_custkey") * 37 % 36000) / 100.0 - 180).alias("plon"), ((F.col("c_custkey") * 53 % 12000) / 100.0 - 60).alias("plat"))
    q = load(spark, d, "nation").select(F.col("n_nationkey").alias("qid"), "n_name", ((F.col("n_nationkey") * 1440 % 36000) / 100.0 - 180).alias("qlon"), ((F.col("n_nationkey") * 977 % 12000) / 100.0 - 60).alias("qlat"))
    return p, q


@query(f"WITH {_POINTS} SELECT pid, qid, n_name, round(dist / 1000, 3) AS dist_km FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY dist, qid) r FROM x) WHERE r = 1")
def nearest_place(spark, d):
    p, q = _points(spark, d)
    out = spatial.nearest(p, q).join(small(q.select("qid", "n_name")), "qid")
    return out.select("pid", "qid", "n_name", F.round(F.col("dist_m") / 1000, 3).alias("dist_km"))


_MANY = """
p AS (SELECT c_custkey AS pid, (c_custkey * 37 % 36000) / 100.0 - 180 AS plon, (c_custkey * 53 % 18000) / 100.0 - 90 AS plat FROM customer),
q AS (SELECT p_partkey AS qid, (p_partkey * 7919 % 36000) / 100.0 - 180 AS qlon, (p_partkey * 6007 % 18000) / 100.0 - 90 AS qlat FROM part),
x AS (SELECT *, 2 * 6371008.8 * asin(sqrt(least(1.0, power(sin((radians(qlat) - radians(plat)) / 2), 2) + cos(radians(plat)) * cos(radians(qlat)) * power(sin(radians(qlon - plon) / 2), 2)))) AS dist FROM p CROSS JOIN q)"""


@query(f"WITH {_MANY} SELECT pid, round(min(dist) / 1000, 3) AS dist_km FROM x GROUP BY pid")
def nearest_of_many_places(spark, d):
    """Every part is a place, so from scale 0.01 on there are more than are broadcast."""
    p = load(spark, d, "customer").select(F.col("c_custkey").alias("pid"), ((F.col("c_custkey") * 37 % 36000) / 100.0 - 180).alias("plon"), ((F.col("c_custkey") * 53 % 18000) / 100.0 - 90).alias("plat"))
    q = load(spark, d, "part").select(F.col("p_partkey").alias("qid"), ((F.col("p_partkey") * 7919 % 36000) / 100.0 - 180).alias("qlon"), ((F.col("p_partkey") * 6007 % 18000) / 100.0 - 90).alias("qlat"))
    return spatial.nearest(p, q).select("pid", F.round(F.col("dist_m") / 1000, 3).alias("dist_km"))


@query(f"WITH {_POINTS} SELECT q.qid, q.n_name, count(x.pid) AS n, round(min(x.dist) / 1000, 3) AS least_km FROM q LEFT JOIN (SELECT * FROM x WHERE dist <= 500000) x ON x.qid = q.qid GROUP BY q.qid, q.n_name")
def range_join_radius(spark, d):
    p, q = _points(spark, d)
    met = spatial.within(p, q.drop("n_name"), 500_000).groupBy("qid").agg(F.count("*").alias("n"), F.min("dist_m").alias("m"))
    return q.join(met, "qid", "left").select("qid", "n_name", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.col("m") / 1000, 3).alias("least_km"))


# ------------------------------------------------------------------ lookups


@query("""
WITH a AS (SELECT s_suppkey, lower(s_name) AS t FROM (SELECT s_suppkey, replace(s_name, '0', 'o') AS s_name FROM supplier)),
c AS (SELECT a.s_suppkey, b.s_suppkey AS v, levenshtein(a.t, substring(lower(b.s_name), 1, length(a.t))) AS dist FROM a CROSS JOIN supplier b),
m AS (SELECT s_suppkey, min(dist) AS dist FROM c GROUP BY s_suppkey),
f AS (SELECT c.s_suppkey, count(*) AS n, min(v) AS v FROM c JOIN m ON c.s_suppkey = m.s_suppkey AND c.dist = m.dist WHERE c.dist <= 9 GROUP BY c.s_suppkey)
SELECT s.s_suppkey, CASE WHEN f.n = 1 THEN f.v END AS value FROM supplier s LEFT JOIN f ON s.s_suppkey = f.s_suppkey""")
def fuzzy_nearest_string(spark, d):
    s = load(spark, d, "supplier")
    read = s.select("s_suppkey", F.regexp_replace("s_name", "0", "o").alias("t"))
    refs = s.select(F.col("s_name").alias("k"), F.col("s_suppkey").alias("v"))
    return lookups.most_alike(read, "s_suppkey", F.col("t"), refs, F.col("k"), F.col("v"), limit=9)


@query("""
WITH a AS (SELECT c_custkey, replace(replace(lower(c_name), '1', 'l'), '7', '') AS t FROM customer),
c AS (SELECT a.c_custkey, b.c_custkey AS v, levenshtein(a.t, substring(lower(b.c_name), 1, length(a.t))) AS dist FROM a CROSS JOIN customer b),
m AS (SELECT c_custkey, min(dist) AS dist FROM c GROUP BY c_custkey),
f AS (SELECT c.c_custkey, count(*) AS n, min(v) AS v FROM c JOIN m ON c.c_custkey = m.c_custkey AND c.dist = m.dist WHERE c.dist <= 3 GROUP BY c.c_custkey)
SELECT s.c_custkey, CASE WHEN f.n = 1 THEN f.v END AS value FROM customer s LEFT JOIN f ON s.c_custkey = f.c_custkey""")
def fuzzy_among_many(spark, d):
    """Every customer is a reference, so from scale 0.01 on there are more than are broadcast."""
    c = load(spark, d, "customer")
    read = c.select("c_custkey", F.regexp_replace(F.regexp_replace("c_name", "1", "l"), "7", "").alias("t"))
    return lookups.most_alike(read, "c_custkey", F.col("t"), c.select(F.col("c_name").alias("k"), F.col("c_custkey").alias("v")), F.col("k"), F.col("v"), limit=3)


@query("""
WITH t AS (SELECT DISTINCT p_type FROM part), r AS (SELECT p_partkey, substring(p_type, 1, 3 + p_partkey % 12) AS pre FROM part),
f AS (SELECT p_partkey, CASE WHEN min(t.p_type) = max(t.p_type) THEN max(t.p_type) END AS value FROM r JOIN t ON starts_with(lower(trim(t.p_type)), lower(trim(r.pre))) GROUP BY p_partkey)
SELECT r.p_partkey, f.value FROM r LEFT JOIN f ON r.p_partkey = f.p_partkey""")
def prefix_lookup_unique(spark, d):
    p = load(spark, d, "part")
    read = p.select("p_partkey", F.substring(F.col("p_type"), F.lit(1), (3 + F.col("p_partkey") % 12).cast("int")).alias("pre"))
    return lookups.prefix_unique(read, "p_partkey", F.col("pre"), p.select("p_type").distinct(), F.col("p_type"), F.col("p_type"))


@query("""
WITH w AS (SELECT DISTINCT unnest(string_split(p_type, ' ')) AS v FROM part), r AS (SELECT p_partkey, p_name || ' ' || p_type AS t FROM part),
f AS (SELECT p_partkey, max(lpad(CAST(length(v) AS VARCHAR), 5, '0') || v) AS b FROM r JOIN w ON v <> '' AND contains(lower(t), lower(v)) GROUP BY p_partkey)
SELECT r.p_partkey, substring(f.b, 6) AS value FROM r LEFT JOIN f ON r.p_partkey = f.p_partkey""")
def contained_lookup_longest(spark, d):
    p = load(spark, d, "part")
    refs = p.select(F.explode(F.split("p_type", " ")).alias("v")).distinct().where("v <> ''")
    read = p.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("t"))
    return lookups.contained_longest(read, "p_partkey", F.col("t"), refs, F.col("v"), F.col("v"))


@query("""
WITH r AS (SELECT s_suppkey, '  ' || lower(n_name) || CASE WHEN s_suppkey % 5 = 0 THEN 'x' ELSE ' ' END AS t FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, n_nationkey AS found FROM r LEFT JOIN nation ON lower(trim(n_name)) = lower(trim(t))""")
def exact_lookup_normalised(spark, d):
    n = load(spark, d, "nation")
    read = load(spark, d, "supplier").join(small(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("  "), F.lower("n_name"), F.when(F.col("s_suppkey") % 5 == 0, "x").otherwise(" ")).alias("t"))
    return lookups.exact(read, F.col("t"), n, F.col("n_name"), F.col("n_nationkey"), "found").select("s_suppkey", "found")


@query("""
WITH r AS (SELECT o_orderkey, ' ' || lower(substring(o_orderpriority, 1, 1 + o_orderkey % 20)) AS t FROM orders), k AS (SELECT lower(trim(o_orderpriority)) AS k, max(upper(o_orderpriority)) AS v FROM orders GROUP BY 1)
SELECT o_orderkey, coalesce(v, t) AS term FROM r LEFT JOIN k ON lower(trim(t)) = k""")
def dictionary_passthrough(spark, d):
    o = load(spark, d, "orders")
    read = o.select("o_orderkey", F.concat(F.lit(" "), F.lower(F.substring(F.col("o_orderpriority"), F.lit(1), (1 + F.col("o_orderkey") % 20).cast("int")))).alias("t"))
    return lookups.dictionary(read, F.col("t"), o.select("o_orderpriority").distinct(), F.col("o_orderpriority"), F.upper("o_orderpriority"), "term").select("o_orderkey", "term")


# ------------------------------------------------------------------ joins


@query("""
WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS r FROM (SELECT DISTINCT event_type FROM events)),
e AS (SELECT date_trunc('hour', ts) AS h, user_id, r FROM events JOIN k USING (event_type)),
a AS (SELECT h, user_id, count(*) AS n FROM e WHERE r = 1 GROUP BY 1, 2), b AS (SELECT h, user_id, count(*) AS n FROM e WHERE r = 2 GROUP BY 1, 2), c AS (SELECT h, user_id, count(*) AS n FROM e WHERE r = 3 GROUP BY 1, 2)
SELECT strftime(a.h, '%Y-%m-%d %H:%M:%S') AS hour, a.user_id, a.n AS n_first, coalesce(b.n, 0) AS n_second, coalesce(c.n, 0) AS n_third FROM a LEFT JOIN b ON a.h = b.h AND a.user_id = b.user_id LEFT JOIN c ON a.h = c.h AND a.user_id = c.user_id""")
def three_source_hourly_fusion(spark, d):
    return _fusion(load(spark, d, "events"))


def _fusion(ev: DataFrame) -> DataFrame:
    kinds = ev.select("event_type").distinct().withColumn("r", F.row_number().over(Window.orderBy("event_type"))).where("r <= 3")
    e = ev.join(small(kinds), "event_type").select(F.date_trunc("hour", "ts").alias("h"), "user_id", "r")
    # The three sources are one aggregate: a hour and user without the first source has no row, as in the left joins.
    n = lambda r: F.count_if(F.col("r") == r)
    out = e.groupBy("h", "user_id").agg(n(1).alias("n_first"), n(2).alias("n_second"), n(3).alias("n_third")).where("n_first > 0")
    return out.select(stamp("h").alias("hour"), "user_id", "n_first", "n_second", "n_third")


@query("""
WITH s AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, CASE WHEN hour(ts) < 12 THEN 'MORNING' ELSE 'AFTERNOON' END AS shift FROM events),
c AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM s), u AS (SELECT DISTINCT user_id FROM s)
SELECT u.user_id, strftime(c.day, '%Y-%m-%d') AS day, t.shift FROM u CROSS JOIN c CROSS JOIN (VALUES ('MORNING'), ('AFTERNOON')) t(shift) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = u.user_id AND s.day = c.day AND s.shift = t.shift)""")
def expected_vs_observed(spark, d):
    seen = load(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), F.when(F.hour("ts") < 12, "MORNING").otherwise("AFTERNOON").alias("shift")).distinct()
    days = series.calendar(seen, F.col("day"))
    expected = seen.select("user_id").distinct().join(small(days)).withColumn("shift", F.explode(F.array(F.lit("MORNING"), F.lit("AFTERNOON"))))
    return quality.missing(expected, seen, ["user_id", "day", "shift"]).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "shift")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10)")
def anti_join_new_rows(spark, d):
    return keyed.new_rows(load(spark, d, "orders").select("o_orderkey", "o_custkey"), load(spark, d, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"], ["o_custkey"])


@query("SELECT event_id, user_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events t WHERE t.user_id = e.user_id AND t.event_type = e.event_type AND t.value > 90)")
def not_exists_twin(spark, d):
    ev = load(spark, d, "events")
    return ev.select("event_id", "user_id", "event_type").join(ev.where("value > 90").select("user_id", "event_type").distinct(), ["user_id", "event_type"], "left_anti").select("event_id", "user_id", "event_type")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_in(spark, d):
    o = load(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_semi")


@query("""
WITH u AS (SELECT 'n' || n_nationkey AS code, n_name AS name, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, NULL FROM region)
SELECT c.code, c.name, p.name AS parent_name FROM u c JOIN u p ON p.code = c.parent""")
def parent_child_self_join(spark, d):
    cat = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    u = load(spark, d, "nation").select(cat("n", "n_nationkey").alias("code"), F.col("n_name").alias("name"), cat("r", "n_regionkey").alias("parent")).unionByName(load(spark, d, "region").select(cat("r", "r_regionkey").alias("code"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent")))
    return u.alias("c").join(u.alias("p"), F.col("p.code") == F.col("c.parent")).select("c.code", "c.name", F.col("p.name").alias("parent_name"))


# ------------------------------------------------------------------ calendars and reshaping


@query("""
WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type, user_id FROM events), c AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM e), t AS (SELECT DISTINCT event_type FROM events)
SELECT strftime(c.day, '%Y-%m-%d') AS day, t.event_type, count(DISTINCT e.user_id) AS n_users, count(e.user_id) AS n FROM c CROSS JOIN t LEFT JOIN e ON e.day = c.day AND e.event_type = t.event_type GROUP BY c.day, t.event_type""")
def calendar_zero_fill(spark, d):
    ev = load(spark, d, "events")
    e = ev.select(F.to_date("ts").alias("day"), "event_type", "user_id")
    facts = e.groupBy("day", "event_type").agg(F.countDistinct("user_id").alias("n_users"), F.count("*").alias("n"))
    grid = series.calendar(e, F.col("day")).join(small(ev.select("event_type").distinct()))
    zero = F.lit(0)
    return grid.join(facts, ["day", "event_type"], "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", F.coalesce("n_users", zero).alias("n_users"), F.coalesce("n", zero).alias("n"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, indicator, value FROM (
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'quantity' AS indicator, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'discount', l_discount FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'tax', l_tax FROM lineitem)""")
def unpivot_measures(spark, d):
    return series.unpivot(load(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], {"quantity": F.col("l_quantity"), "discount": F.col("l_discount"), "tax": F.col("l_tax")})


@query("SELECT conv_id, turn, w AS word, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w FROM conversations) GROUP BY conv_id, turn, w")
def explode_array(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("word")).groupBy("conv_id", "turn", "word").agg(F.count("*").alias("n"))


@query("""SELECT 'NATION' AS kind, CAST(n_nationkey AS BIGINT) AS id, n_name AS name, NULL::DOUBLE AS amount FROM nation UNION ALL SELECT 'REGION', CAST(r_regionkey AS BIGINT), r_name, NULL FROM region UNION ALL SELECT 'SUPPLIER', s_suppkey, s_name, s_acctbal FROM supplier""")
def union_blocks(spark, d):
    columns = [("kind", "string"), ("id", "bigint"), ("name", "string"), ("amount", "double")]
    return series.stack([
        series.block(load(spark, d, "nation"), columns, kind=F.lit("NATION"), id=F.col("n_nationkey"), name=F.col("n_name")),
        series.block(load(spark, d, "region"), columns, kind=F.lit("REGION"), id=F.col("r_regionkey"), name=F.col("r_name")),
        series.block(load(spark, d, "supplier"), columns, kind=F.lit("SUPPLIER"), id=F.col("s_suppkey"), name=F.col("s_name"), amount=F.col("s_acctbal")),
    ])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, d):
    return load(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


# ------------------------------------------------------------------ aggregates


@query("SELECT event_type, count(*) AS n, count(value) AS n_value, round(sum(value), 3) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def agg_basic(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("n_value"), F.round(F.sum("value"), 3).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT user_id, count(DISTINCT event_type) AS n_types, count(DISTINCT CAST(ts AS DATE)) AS n_days, count(DISTINCT hour(ts)) AS n_hours FROM events GROUP BY user_id")
def count_distinct_multi(spark, d):
    return summaries.distinct_counts(load(spark, d, "events"), ["user_id"], {"n_types": F.col("event_type"), "n_days": F.to_date("ts"), "n_hours": F.hour("ts")})


@query("SELECT user_id, string_agg(event_type, '; ' ORDER BY ts, event_type) AS timeline FROM events GROUP BY user_id")
def ordered_concat(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(series.timeline(F.col("ts"), F.col("event_type")).alias("timeline"))


@query("""SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ', ') AS priorities, nullif(array_to_string(list_sort(list(DISTINCT o_orderstatus) FILTER (WHERE o_orderstatus = 'P')), ', '), '') AS pending FROM orders GROUP BY o_custkey""")
def distinct_list_display(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg(text.listing(F.collect_set("o_orderpriority")).alias("priorities"), text.listing(F.collect_set(F.when(F.col("o_orderstatus") == "P", F.col("o_orderstatus")))).alias("pending"))


@query("SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_totalprice, b := o_orderkey)) AS o_orderkey, max(o_totalprice) AS price FROM orders GROUP BY o_custkey")
def argmax_struct(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"), F.max("o_totalprice").alias("price"))


@query("""WITH e AS (SELECT CASE WHEN value < 20 THEN NULL ELSE value END AS value, nullif(event_type, 'click') AS event_type, props FROM events)
SELECT 'value' AS "column", count(*) FILTER (WHERE value IS NULL) AS nulls, count(*) AS rows FROM e UNION ALL SELECT 'event_type', count(*) FILTER (WHERE event_type IS NULL), count(*) FROM e UNION ALL SELECT 'props', count(*) FILTER (WHERE props IS NULL), count(*) FROM e""")
def null_profile(spark, d):
    e = load(spark, d, "events").select(F.when(F.col("value") >= 20, F.col("value")).alias("value"), F.nullif(F.col("event_type"), F.lit("click")).alias("event_type"), "props")
    return quality.null_profile(e, ["value", "event_type", "props"])


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def percentile_latency(spark, d):
    p = lambda q: F.round(F.percentile("value", q), 6)
    return load(spark, d, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def percentile_by_ranks(spark, d):
    """As percentile_latency, without a buffer of a group's values."""
    found = summaries.exact_quantiles(load(spark, d, "events"), ["event_type"], "value", [0.5, 0.9, 0.99])
    return found.groupBy("event_type").agg(*(F.round(F.max(F.when(F.col("q") == q, F.col("quantile"))), 6).alias(n) for q, n in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))))


def percentile_sketch(spark, d):
    """(event_type, q, quantile), within a thousandth of the group's ranks; SQL has no such bound, so tests hold it against the ranks."""
    return summaries.sketched_quantiles(load(spark, d, "events"), ["event_type"], "value", [0.5, 0.9, 0.99], 1000)


QUERIES["percentile_sketch"] = percentile_sketch


# ------------------------------------------------------------------ predicates


@query("SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS")
def relative_time_window(spark, d):
    ev = load(spark, d, "events")
    last = ev.agg(F.max("ts")).first()[0]
    return (ev.where(F.col("ts") >= F.lit(last).cast("timestamp_ntz") - F.expr("interval 24 hours")) if last else ev.limit(0)).select("event_id", "user_id")


@query("SELECT event_id, CASE WHEN hour(ts) < 6 THEN 'NIGHT' WHEN hour(ts) < 12 THEN 'MORNING' WHEN hour(ts) < 18 THEN 'AFTERNOON' WHEN hour(ts) < 24 THEN 'EVENING' END AS period FROM events")
def day_period_buckets(spark, d):
    return load(spark, d, "events").select("event_id", times.day_period(F.hour("ts"), [(6, "NIGHT"), (12, "MORNING"), (18, "AFTERNOON"), (24, "EVENING")]).alias("period"))


_KINDS = {"INTEREST": ["click", "view"], "SALE": ["purchase", "buy"]}


@query("SELECT event_id, CASE WHEN lower(trim(event_type)) IN ('interest', 'click', 'view') THEN 'INTEREST' WHEN lower(trim(event_type)) IN ('sale', 'purchase', 'buy') THEN 'SALE' END AS kind FROM events")
def domain_mapping(spark, d):
    return load(spark, d, "events").select("event_id", text.vocabulary(F.col("event_type"), _KINDS).alias("kind"))


@query(r"""SELECT doc_id, CASE WHEN lower(trim(source)) IN ('article', 'the') THEN 'ARTICLE' WHEN lower(trim(source)) IN ('joint', 'and', 'with') THEN 'JOINT' WHEN regexp_matches(lower(text), '\bwiths?\b') THEN 'JOINT' WHEN regexp_matches(lower(text), '\bthes?\b') THEN 'ARTICLE' END AS kind FROM documents""")
def domain_fallback_word(spark, d):
    return load(spark, d, "documents").select("doc_id", text.vocabulary_or_word(F.col("source"), {"ARTICLE": ["the"], "JOINT": ["and", "with"]}, F.col("text"), ["with", "the"]).alias("kind"))


@query(r"SELECT doc_id, n_chars FROM documents WHERE regexp_matches(lower(text), 'license|avec|keit')")
def keyword_restriction(spark, d):
    return load(spark, d, "documents").where(F.lower("text").rlike("license|avec|keit")).select("doc_id", "n_chars")


# ------------------------------------------------------------------ payloads and parsing


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT event_id, user_id, event_type, props FROM events")
def json_array_records(spark, d):
    """The events as files of one JSON array each (50,000 consecutive event_ids), whose records are then cut apart."""
    rows = load(spark, d, "events").select("event_id", "user_id", "event_type", "props")
    made = arrays.whole_arrays(rows, F.to_json(F.struct(*rows.columns)), F.coalesce(F.floor(F.col("event_id") / 50_000), F.lit(-1)), "arrays")
    found = arrays.objects(arrays.records(arrays.pieces(spark, made, glob="*.txt")))
    return found.select(F.from_json("text", rows.schema).alias("r")).select("r.*")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, len(json_keys(props)) AS n_keys FROM events")
def json_to_map(spark, d):
    m = text.payload_map(F.col("props"))
    return load(spark, d, "events").select("event_id", F.try_element_at(m, F.lit("k")).alias("k"), F.size(m).cast("bigint").alias("n_keys"))


@query("SELECT event_id, strftime(ts + INTERVAL 3 HOURS, '%Y-%m-%d %H:%M:%S') AS utc FROM events")
def ts_parse_br(spark, d):
    shown = F.date_format("ts", "dd/MM/yyyy HH:mm:ss")
    return load(spark, d, "events").select("event_id", stamp(times.local(times.day_first(shown, zone="-03:00"), "UTC")).alias("utc"))


@query("SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS utc, NULL::VARCHAR AS bad FROM events")
def ts_parse_iso(spark, d):
    shown = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return load(spark, d, "events").select("event_id", stamp(times.local(times.iso(shown, utc=True), "UTC")).alias("utc"), stamp(times.iso(F.lit("no time"), utc=True)).alias("bad"))


@query("SELECT event_id, CASE WHEN event_id % 5 > 0 THEN strftime(date_trunc('minute', ts) + INTERVAL 3 HOURS, '%Y-%m-%d %H:%M:%S') END AS utc FROM events")
def gdh_parse(spark, d):
    month = F.get(F.array(*[F.lit(m) for m in list(times.MONTHS)[:12]]), F.month("ts") - 1)
    group = F.concat(F.date_format("ts", "ddHHmm"), F.lit(" "), month, F.lit(" "), F.date_format("ts", "yy"))
    shown = F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("Obs "), group)).otherwise(F.concat(group, F.lit(" / "), group))
    return load(spark, d, "events").select("event_id", stamp(times.local(times.date_time_group(shown, "-03:00"), "UTC")).alias("utc"))


_LON, _LAT = "(c_custkey * 37 % 40000) / 100.0 - 200", "(c_custkey * 53 % 12000) / 100.0 - 60"


@query(f"SELECT c_custkey, CASE WHEN {_LON} BETWEEN -180 AND 180 THEN printf('POINT(%.2f %.2f)', CAST({_LON} AS DOUBLE), CAST({_LAT} AS DOUBLE)) END AS wkt FROM customer")
def latlon_point(spark, d):
    k = F.col("c_custkey")
    return load(spark, d, "customer").select("c_custkey", geo.point(((k * 37 % 40000) / 100.0 - 200).cast("double"), ((k * 53 % 12000) / 100.0 - 60).cast("double"), 2).alias("wkt"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN printf('POINT(%.6f %.6f)', -(c_custkey % 180 + (c_custkey % 60) / 60.0::DOUBLE + (c_custkey % 599) / 10.0::DOUBLE / 3600), (c_custkey % 90 + (c_custkey % 59) / 60.0::DOUBLE + (c_custkey % 599) / 10.0::DOUBLE / 3600)) END AS wkt FROM customer""")
def dms_point(spark, d):
    k = F.col("c_custkey")
    shown = F.format_string("%d° %d' %.1f\" N, %d° %d' %.1f\" W", k % 90, k % 59, (k % 599) / 10, k % 180, k % 60, (k % 599) / 10)
    return load(spark, d, "customer").select("c_custkey", geo.dms_point(F.when(k % 4 > 0, shown).otherwise("Sem localizacao")).alias("wkt"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'POINT(' || c_custkey || ' 1.5)' WHEN 1 THEN 'LINESTRING(' || c_custkey || ' 2, 3 ' || c_custkey || ')' WHEN 2 THEN 'POLYGON((0 0, ' || c_custkey || ' 1, 0 1, 0 0))' END AS wkt FROM customer""")
def geojson_wkt(spark, d):
    k = F.col("c_custkey").cast("string")
    of = lambda kind, *parts: F.concat(F.lit('{"type":"' + kind + '","coordinates":'), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("}"))
    kind = F.col("c_custkey") % 4
    shown = F.when(kind == 0, of("Point", "[", k, ",1.5]")).when(kind == 1, of("LineString", "[[", k, ",2],[3,", k, "]]")).when(kind == 2, of("Polygon", "[[[0,0],[", k, ",1],[0,1],[0,0]]]")).otherwise(F.lit("{bad"))
    return load(spark, d, "customer").select("c_custkey", geo.geojson_wkt(shown).alias("wkt"))


def _utm_sql() -> str:
    """The inverse transverse Mercator series of geo.utm_inverse, step by step, for zone 23 south."""
    e2 = geo.FLATTENING * (2 - geo.FLATTENING)
    ep2, e1 = e2 / (1 - e2), (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    unit = geo.SCALE * geo.AXIS * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)
    a2, a4, a6, a8 = 3 * e1 / 2 - 27 * e1**3 / 32, 21 * e1**2 / 16 - 55 * e1**4 / 32, 151 * e1**3 / 96, 1097 * e1**4 / 512
    return f"""
WITH r AS (SELECT c_custkey, 30000 + c_custkey * 37 % 40000 AS e5, c_custkey * 7919 % 100000 AS n5 FROM customer),
c AS (SELECT c_custkey, CAST(e5 * 10 + 5 AS DOUBLE) AS e, (CAST(n5 * 10 + 5 + i * 1000000 AS DOUBLE) - 1e7) / CAST({unit!r} AS DOUBLE) AS mu FROM r CROSS JOIN range(10) t(i)),
f AS (SELECT c_custkey, e, mu + {a2!r}::DOUBLE * sin(2 * mu) + {a4!r}::DOUBLE * sin(4 * mu) + {a6!r}::DOUBLE * sin(6 * mu) + {a8!r}::DOUBLE * sin(8 * mu) AS p FROM c),
g AS (SELECT c_custkey, p, (e - 5e5) * sqrt(1 - {e2!r}::DOUBLE * power(sin(p), 2)) / ({geo.AXIS!r}::DOUBLE * {geo.SCALE!r}::DOUBLE) AS d, (1 - {e2!r}::DOUBLE * power(sin(p), 2)) / (1 - {e2!r}::DOUBLE) AS q, power(tan(p), 2) AS t, {ep2!r}::DOUBLE * power(cos(p), 2) AS k FROM f),
h AS (SELECT c_custkey, degrees(p - q * tan(p) * (power(d, 2) / 2 - (5 + 3 * t + 10 * k - 4 * k * k - 9 * {ep2!r}::DOUBLE) * power(d, 4) / 24 + (61 + 90 * t + 298 * k + 45 * t * t - 252 * {ep2!r}::DOUBLE - 3 * k * k) * power(d, 6) / 720)) AS lat,
 degrees((d - (1 + 2 * t + k) * power(d, 3) / 6 + (5 - 2 * k + 28 * t - 3 * k * k + 8 * {ep2!r}::DOUBLE + 24 * t * t) * power(d, 5) / 120) / cos(p)) + 23 * 6 - 183 AS lon FROM g),
m AS (SELECT *, 111.195::DOUBLE * sqrt(power(lat + 22.7, 2) + power((lon + 45) * cos(radians(-22.7)), 2)) AS km FROM h),
b AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY km) AS r FROM m)
SELECT c_custkey, CASE WHEN km <= 150 THEN printf('POINT(%.6f %.6f)', lon, lat) END AS wkt FROM b WHERE r = 1"""


@query(_utm_sql())
def utm_point(spark, d):
    k = F.col("c_custkey")
    shown = F.format_string("%05d-%05d", 30000 + k * 37 % 40000, k * 7919 % 100000)
    area = F.lit("POLYGON((-45.3 -22.9, -44.7 -22.9, -44.7 -22.5, -45.3 -22.5, -45.3 -22.9))")
    return load(spark, d, "customer").select("c_custkey", geo.decametric_point(shown, area).alias("wkt"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{\"extra\":\"' || event_type || '\"}' END AS rest FROM events")
def leftover_json(spark, d):
    cells = F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("extra"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")))
    return load(spark, d, "events").select("event_id", text.leftover(cells, ["id"]).alias("rest"))


@query("SELECT event_id, sha256(concat_ws('|', event_type, CAST(event_id AS VARCHAR), strftime(ts, '%Y-%m-%d %H:%M:%S'))) AS identity FROM events")
def event_identity(spark, d):
    return load(spark, d, "events").select("event_id", text.event_id(F.col("event_type"), F.col("event_id").cast("string"), stamp("ts")).alias("identity"))


# ------------------------------------------------------------------ data quality


@query("SELECT event_id, user_id FROM events WHERE CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END IS NULL")
def dq_not_null(spark, d):
    e = load(spark, d, "events").withColumn("event_type", F.when(F.col("event_id") % 11 != 0, F.col("event_type")))
    return quality.not_null(e, "event_type").select("event_id", "user_id")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def dq_in_set(spark, d):
    return quality.in_set(load(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_unique(spark, d):
    return quality.unique(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def dq_orphans(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return quality.orphans(li, "l_orderkey", load(spark, d, "orders").where("o_orderstatus <> 'P'"), "o_orderkey").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("""WITH s AS (SELECT doc_id, quality, toxic FROM labels), x AS (SELECT source, sum(quality)::DOUBLE AS h, count(*)::DOUBLE AS n FROM s JOIN documents USING (doc_id) GROUP BY source)
SELECT source, round((h / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(h / n * (1 - h / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS lo, round((h / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(h / n * (1 - h / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS hi FROM x""")
def wilson_interval(spark, d):
    m = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("quality").cast("double").alias("h"), F.count("*").cast("double").alias("n"))
    w = quality.wilson(F.col("h"), F.col("n"))
    return m.select("source", F.round(w["lo"], 6).alias("lo"), F.round(w["hi"], 6).alias("hi"))


# ------------------------------------------------------------------ keyed maintenance


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 10 <> 1 UNION ALL SELECT o_orderkey, 'U', o_totalprice + 1 FROM orders WHERE o_orderkey % 10 = 1""")
def upsert_merge(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changes = o.where("o_orderkey % 10 = 1").select("o_orderkey", F.lit("U").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return keyed.upsert(o.where("o_orderkey % 3 <> 0"), changes, ["o_orderkey"])


@query("SELECT event_id, user_id FROM events WHERE NOT (user_id % 4 = 0 AND event_type = 'click')")
def delete_obsolete(spark, d):
    ev = load(spark, d, "events").select("event_id", "user_id", "event_type")
    read_again = ev.where("user_id % 4 = 0")
    return keyed.without_obsolete(ev, read_again.where("event_type <> 'click'"), read_again, ["event_id"], ["user_id"]).select("event_id", "user_id")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def pending_work(spark, d):
    done = load(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return keyed.pending(load(spark, d, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


# ------------------------------------------------------------------ indicators


@query("SELECT event_type, round(avg(epoch_us(ts) % 3600000000 / 60000000.0), 3) AS mean_minutes, count(*) AS n FROM events GROUP BY event_type")
def mean_latency_by_unit(spark, d):
    minutes = (F.minute("ts") * 60 + F.second("ts") + F.date_format("ts", "SSSSSS").cast("double") / 1e6) / 60
    return load(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(minutes), 3).alias("mean_minutes"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT o_orderstatus, count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT r.o_orderstatus, r.n AS raw_rows, coalesce(k.n, 0) AS kept_rows, round(coalesce(k.n, 0) * 100.0::DOUBLE / r.n, 4) AS pct FROM r LEFT JOIN k USING (o_orderstatus)""")
def preservation_rate(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    kept = o.join(load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("k"))
    out = o.groupBy("o_orderstatus").agg(F.count("*").alias("raw_rows")).join(kept, "o_orderstatus", "left").withColumn("kept_rows", F.coalesce("k", F.lit(0)))
    return out.select("o_orderstatus", "raw_rows", "kept_rows", F.round(F.col("kept_rows") * F.lit(100.0) / F.col("raw_rows"), 4).alias("pct"))


@query("SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r = 1")
def q1_latest_position(spark, d):
    return series.latest_by(load(spark, d, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"]).withColumn("ts", stamp("ts"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 4 HOURS GROUP BY event_type")
def q2_recent_window(spark, d):
    ev = load(spark, d, "events")
    # The end is one value, and as a literal it reaches the scan, which then skips what is older.
    last = ev.agg(F.max("ts")).first()[0]
    recent = ev.where(F.col("ts") >= F.lit(last).cast("timestamp_ntz") - F.expr("interval 4 hours")) if last else ev.limit(0)
    return recent.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


ORACLE_SQL["q3_fusion"] = ORACLE_SQL["three_source_hourly_fusion"]
QUERIES["q3_fusion"] = QUERIES["three_source_hourly_fusion"]


@query("SELECT user_id % 10 AS unit, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def q4_latency_pct(spark, d):
    p = lambda q: F.round(F.percentile("value", q), 6)
    return load(spark, d, "events").groupBy((F.col("user_id") % 10).alias("unit")).agg(p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT user_id, count(*) AS n_gaps, max(gap) AS longest FROM (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) // 1000000 AS gap FROM events) WHERE gap > 3600 GROUP BY user_id")
def q5_coverage_gaps(spark, d):
    g = series.gaps(load(spark, d, "events"), ["user_id"], "ts", 3600)
    return g.groupBy("user_id").agg(F.count("*").alias("n_gaps"), F.max("gap_seconds").alias("longest"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_counts(spark, d):
    return load(spark, d, "events").groupBy(stamp(F.date_trunc("hour", "ts")).alias("hour"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT n_name, count(*) AS n, round(avg(s_acctbal), 4) AS mean, max(s_acctbal) AS most, sum(CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END)::BIGINT AS n_high FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def area_summary(spark, d):
    j = load(spark, d, "supplier").join(small(load(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.avg("s_acctbal"), 4).alias("mean"), F.max("s_acctbal").alias("most"), F.count_if(F.col("s_acctbal") > 5000).alias("n_high"))
