import math
import random
import zlib
from datetime import datetime, timedelta

import duckdb
import pytest

from stratalake.llm import point_in_time as pit
from stratalake.llm.point_in_time import Plan

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, hot string, tile int"
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, t long, rid string, hot string"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, cents string"
START = datetime(2024, 1, 1)


def shop(n: int, seed: int = 1):
    """Tables with a hot client, sale and item, late and repeated rows, nulls and ties."""
    r = random.Random(seed)
    at = lambda: START + timedelta(minutes=r.randint(0, 60_000), microseconds=r.choice([0, 0, 1, 999_999]))
    late = lambda x: x + timedelta(seconds=r.choice([0, 5, 600, 90_000, 260_000, 1_500_000]))
    who = lambda: r.choice([7, 7, 7, None, *range(6)])
    clicks = []
    for i in range(3 * n):
        ts = None if r.random() < 0.02 else at()
        clicks.append((i, ts, None if r.random() < 0.02 else late(ts or START), who(), r.choice(["view", "purchase", None]), r.choice([None, -2.345, 5.005, 10.0]), r.choice(["{}", None]), "x", 1))
    clicks += [clicks[5], clicks[5], (3 * n, clicks[6][1], clicks[6][2], clicks[6][3], "view", 1.0, "{}", "x", 1)]
    sales = []
    for i in range(n):
        sold = None if r.random() < 0.02 else at()
        sales.append((i, who(), "done", r.choice([None, 12.345, 7.0]), sold, None if r.random() < 0.02 else late(sold or START), 1, 9, "x", "y"))
    lines = []
    for _ in range(4 * n):
        sale = r.choice([7, 7, r.randrange(n), r.randrange(n), r.randrange(n), None, n + 50])
        sold = sales[sale][4] if sale is not None and sale < n else None
        shipped = None if r.random() < 0.05 else (sold or START).replace(hour=0, minute=0, second=0, microsecond=0) + timedelta(days=r.randint(-1, 16))
        lines.append((sale, 1, r.choice([None, 7, 7, *range(12)]), 1, 1, r.choice([None, 3.335, 20.0]), 0.0, "f", shipped, "z"))
    return clicks, sales, lines


def by_hand(clicks, sales, lines, plan=Plan()):
    cents = lambda x: 0 if x is None or not math.isfinite(x) else math.floor(100 * x + 0.5)
    delay, day = timedelta(minutes=plan.delay_minutes), timedelta(days=1)
    known = lambda arrived, t: arrived is not None and arrived + delay <= t
    rows, clicks = [], set(clicks)
    for sale_id, client, _, _, sold, *_ in sales:
        if client is None or sold is None:
            continue
        t = sold + timedelta(seconds=zlib.crc32(b"" if sale_id is None else str(sale_id).encode()) % 259_200)
        label = any(s[1] == client and s[4] is not None and t < s[4] <= t + plan.label_days * day for s in sales)
        for d in plan.windows:
            inside = lambda ts: ts is not None and t - d * day < ts <= t  # noqa: B023, E731
            c = [x for x in clicks if x[3] == client and inside(x[1]) and known(x[2], t)]
            s = [x for x in sales if x[1] == client and inside(x[4]) and known(x[5], t)]
            own = [x for o in s if o[0] is not None for x in lines if x[0] == o[0] and x[8] is not None and x[8] <= t]
            last = max(c, key=lambda x: (x[1], x[0] if x[0] is not None else -1), default=(None,))[0]
            us = (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
            rows.append((sale_id, d, us, label, len(c), sum(x[4] == "purchase" for x in c), sum(cents(x[5]) for x in c), last, len(s), sum(cents(x[3]) for x in s), len(own), len({x[2] for x in own} - {None}), sum(cents(x[5]) for x in own)))
    return sorted(rows, key=repr)


def frames(spark, clicks, sales, lines, parts=3):
    return [spark.createDataFrame(rows, schema).repartition(parts) for rows, schema in ((clicks, CLICKS), (sales, SALES), (lines, LINES))]


@pytest.mark.parametrize("plan", [Plan(), Plan(windows=(1, 3, 40), delay_minutes=0, label_days=1, tile_days=2, share=3), Plan(windows=(5,))])
def test_equals_brute_force(spark, plan):
    tables = shop(70)
    got = pit.features(*frames(spark, *tables), plan).collect()
    assert sorted((tuple(r) for r in got), key=repr) == by_hand(*tables, plan)


def test_tiles_by_the_hour_and_small_batches(spark):
    tables = shop(60, 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = pit.features(*frames(spark, *tables), Plan(share=10**6)).collect()
        assert sorted((tuple(r) for r in got), key=repr) == by_hand(*tables)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_equals_sql(spark, folder):
    tables = shop(150, 3)
    names = ("clicks", "sales", "sale_lines")
    root = folder(**dict(zip(names, frames(spark, *tables), strict=True)))
    got = pit.query(spark, root)
    con = duckdb.connect()
    for name in names:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root.removeprefix('file://')}/{name}.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({pit.SQL})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr) == by_hand(*tables)


def test_defined_cases(spark):
    clicks, sales, lines = shop(20, 8)
    sales += [sales[0], sales[0], (None, 3, "x", float("nan"), START, START, 1, 9, "x", "y"), (900, 2, "x", float("inf"), START + timedelta(days=2), START, 1, 9, "x", "y")]
    clicks.append((None, START + timedelta(days=2), START, 2, "view", float("inf"), None, "x", 1))
    got = pit.features(*frames(spark, clicks, sales, lines)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == by_hand(clicks, sales, lines)
    assert pit.features(*frames(spark, clicks, [], lines)).collect() == []
    alone = pit.features(*frames(spark, [], sales[:9], [])).collect()
    assert sorted((tuple(r) for r in alone), key=repr) == by_hand([], sales[:9], [])
