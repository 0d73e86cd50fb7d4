"""Point-in-time features: for every sale, what was known about its client at a time t after it, over windows of event time.

Rows of clicks, sales and sale lines (which happen when their sale does) are summed by tiles of event time, and tiles by prefix sums: all rows of a client
up to a time are the tiles before it and, exactly, the raw rows of its own tile up to it. A window (t - d, t] is the difference of two such sums, at t and at its
edge t - d. From the sum at t the rows that weren't available then are subtracted: a row is unavailable from its event to its availability (for
a line: when it has been shipped, too), or to its leaving the window, whichever is first. As its addition and its subtraction start together, both are one
step: the row enters the window's sum when it becomes available, at the latest when the edge passes it. The number of items in a window is the number of
items present in it: the intervals in which an item's lines keep it present are united first, so that each item counts once. Whether a sale follows within the
label's days is the difference of two sums of the same tiles.

Steps and questions (four a sale) of a client's tile come together, sorted by time, and are added up batch by batch, so a task holds one
batch whatever the size of a tile. Tiles are 32 days long, or an hour for clients with over 1/1000 of all rows, of which there can be no more than a thousand: those
few are all that is broadcast, and the driver gets a count. Lines are summed by sale and day of shipping, and by sale and item, before they meet their sales.

Defined cases: a sale without client or time of sale has no result and counts in no window; a click without client or time doesn't count, and one that is equal to
another in all columns counts once; other repeated rows each count, and each row of sales has results of its own; without a time of
arrival (of shipping, for a line) a row is never available; a null or non-finite amount is 0 cents; a null click_id is less than any; a null sale_id has no lines and the
checksum of the empty text; lines without a sale don't count. Empty tables give zeros, empty sales an empty result. Other columns make clicks differ, and are ignored else.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalake.llm.common import bounded, table, written

SECOND = 1_000_000
HOUR, DAY = 3600 * SECOND, 86_400 * SECOND
NEVER = 1 << 62
NONE = -(1 << 63)  # of a click's time or id
SUMS = ["n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "line_cents", "n_items"]
STEP, ASK = 1, 2
EVENT = 1  # bit of the sums by event time; the sums known under the i-th window have bit 2 << i


@dataclass(frozen=True)
class Plan:
    windows: tuple[int, ...] = (2, 14)  # days
    delay_minutes: int = 240
    label_days: int = 7
    tile_days: int = 32
    share: int = 1000


DEFAULT = Plan()


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time, which is UTC if it has no zone, whatever the session's zone."""
    c = F.col(name)
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(c)
    return F.unix_date(c.cast("date")) * F.lit(DAY) + F.hour(c) * F.lit(HOUR) + F.minute(c).cast("long") * (60 * SECOND) + (F.expr(f"extract(SECOND FROM `{name}`)") * SECOND).cast("long")


def cents(c: Column) -> Column:
    x = F.lit(100.0) * c + F.lit(0.5)
    return F.when(c.isNull() | F.isnan(c) | (F.abs(x) > 1e15), F.lit(0)).otherwise(F.floor(x)).cast("long")


# ------------------------------------------------------------------ steps and questions


def _steps(df: DataFrame, values: dict[str, Column], moments: list[tuple[int, Column, int]], last: tuple[Column, ...] | None = None) -> DataFrame:
    """Rows of the sums: at each moment (bits, time, sign; a null time is none) the values are added to the sums with these bits. last: time and id of
    what may be the latest click from the time of its availability on."""
    at = F.array(*(F.struct(F.lit(bits).alias("bits"), time.cast("long").alias("time"), F.lit(sign).alias("sign")) for bits, time, sign in moments))
    keep = {f"v_{k}": v for k, v in values.items()} | ({"l_ts": last[0], "l_id": last[1], "l_from": last[2]} if last else {})
    df = df.select("client", "hot", *(v.cast("long").alias(k) for k, v in keep.items()), F.explode(F.filter(at, lambda x: x["time"].isNotNull())).alias("s"))
    known = ((F.col("s.bits") > EVENT) & (F.col("s.time") >= F.col("l_from"))) if last else F.lit(False)
    return df.select(
        "client",
        "hot",
        F.col("s.time").alias("time"),
        F.lit(STEP).alias("kind"),
        F.col("s.bits").alias("bits"),
        F.lit(0).cast("long").alias("rid"),
        *((F.col(f"v_{k}") * F.col("s.sign") if k in values else F.lit(0)).cast("long").alias(k) for k in SUMS),
        *(F.when(known, F.col(c)).otherwise(F.lit(NONE)).alias(to) if last else F.lit(NONE).alias(to) for c, to in (("l_ts", "last_ts"), ("l_id", "last_id"))),
    )


def _entries(plan: Plan, ts: Column, available: Column) -> list[tuple[int, Column, int]]:
    """The moments of a row: its event, and when it enters each window's sum; one moment for all windows that it enters at once."""
    enters = [F.least(F.greatest(ts, available), ts + d * DAY) for d in plan.windows]
    moments, every = [(EVENT, ts, 1)], sum(2 << i for i in range(len(enters)))
    together = enters[0] == enters[-1] if len(enters) > 1 else F.lit(True)
    for other in enters[1:-1]:
        together = together & (other == enters[0])
    moments.append((every, F.when(together, enters[0]), 1))
    return moments + [(2 << i, F.when(~together, e), 1) for i, e in enumerate(enters)]


def _presence(lines: DataFrame, sales: DataFrame, plan: Plan) -> DataFrame:
    """Steps of the number of items present in each window, from the union of the intervals in which an item's lines are in it."""
    first = lines.where("item_id is not null and shipped is not null").groupBy("sale_id", "item_id").agg(F.min("shipped").alias("shipped"))
    found = first.join(sales.where("sale_id is not null").select("sale_id", "client", "hot", "ts", "available"), "sale_id")
    enter = F.greatest("ts", "available", "shipped")
    found = found.select("client", "hot", "item_id", "ts", enter.alias("enter")).where(F.col("enter") < F.col("ts") + max(plan.windows) * DAY)
    # All intervals of a window are as long, but for their late beginnings: what lies before a row is united up to the latest event plus the window. Clients with
    # many rows are dealt by day, and each day begins with what the days before have reached.
    found = written(found.withColumn("tile", F.when(F.col("hot"), F.floor(F.col("enter") / DAY)).otherwise(0)), "presence")
    days = found.where("hot").groupBy("client", "hot", "item_id", "tile").agg(F.max("ts").alias("ts"))
    before = Window.partitionBy("client", "item_id").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    reached = days.select("client", "hot", "item_id", F.max("ts").over(before).alias("ts"), F.lit(None).cast("long").alias("enter"), "tile").where("ts is not null")
    upto = Window.partitionBy("client", "item_id", "tile").orderBy(F.col("enter").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    rows = found.unionByName(reached).withColumn("before", F.max("ts").over(upto)).where("enter is not null and (before is null or ts > before)")
    moments, starts = [], []
    for i, d in enumerate(plan.windows):
        start, end = F.greatest(F.col("enter"), F.col("before") + d * DAY), F.col("ts") + d * DAY
        starts.append(F.when(start < end, start))
        moments.append((2 << i, F.when(start < end, end), -1))
    return _steps(rows, {"n_items": F.lit(1)}, moments + [(2 << i, s, 1) for i, s in enumerate(starts)])


def _asked(sales: DataFrame, plan: Plan) -> DataFrame:
    """A row for each time that a sale asks the sums for: t (bits 0), the label's end (bits -1), and the edge of the i-th window (bits i + 1)."""
    t = F.col("t")
    times = [(0, t), (-1, t + plan.label_days * DAY), *((i + 1, t - d * DAY) for i, d in enumerate(plan.windows))]
    df = sales.select("client", "hot", "rid", F.explode(F.array(*(F.struct(F.lit(b).alias("bits"), x.cast("long").alias("time")) for b, x in times))).alias("s"))
    return df.select("client", "hot", "s.time", F.lit(ASK).alias("kind"), "s.bits", "rid", *(F.lit(0).cast("long").alias(k) for k in SUMS), F.lit(NONE).alias("last_ts"), F.lit(NONE).alias("last_id"))


def _carried(steps: DataFrame, streams: list[int]) -> DataFrame:
    """Steps at the start of each tile that is asked for: the prefix sums of the client's tiles before it, by bit."""
    has = {b: F.col("bits").bitwiseAND(b) > 0 for b in streams}
    sums = [F.sum(F.when((F.col("kind") == STEP) & has[b], F.col(k)).otherwise(0)).alias(f"{k}_{b}") for b in streams for k in SUMS]
    latest = F.max(F.when(F.col("last_ts") > NONE, F.struct("last_ts", "last_id"))).alias("last")
    tiles = steps.groupBy("client", "tile").agg(*sums, latest, F.max("kind").alias("asked"))
    before = Window.partitionBy("client").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"{k}_{b}" for b in streams for k in SUMS]
    upto = tiles.select("client", "tile", "asked", *(F.sum(n).over(before).alias(n) for n in names), F.max("last").over(before).alias("last")).where((F.col("asked") == ASK) & F.col(names[0]).isNotNull())
    each = F.array(*(F.struct(F.lit(b).alias("bits"), *(F.col(f"{k}_{b}").alias(k) for k in SUMS)) for b in streams))
    upto = upto.select("client", "tile", "last", F.explode(each).alias("s"))
    latest = [F.coalesce(F.when(F.col("s.bits") > EVENT, F.col(f"last.{c}")), F.lit(NONE)).alias(c) for c in ("last_ts", "last_id")]
    return upto.select("client", "tile", F.lit(NONE).alias("time"), F.lit(STEP).alias("kind"), "s.bits", F.lit(0).cast("long").alias("rid"), *(F.col(f"s.{k}") for k in SUMS), *latest)


def _answers(plan: Plan):
    """Tasks: rows sorted by client, tile, time and kind -> for each question what it adds to the sale's results."""
    n = len(plan.windows)
    names = ["rid", "label", *(f"{k}_{i}" for i in range(n) for k in SUMS), "last_ts", "last_id"]

    def run(batches):
        held = None  # the sums so far, as a row for each bit, of the tile that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            if held is not None:
                col = {c: np.concatenate([held[c], x]) for c, x in col.items()}
            new = np.ones(len(col["client"]), bool)
            new[1:] = (col["client"][1:] != col["client"][:-1]) | (col["tile"][1:] != col["tile"][:-1])
            start = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            step = col["kind"] == STEP

            def summed(name, bit):
                total = np.cumsum(np.where(step & (col["bits"] & bit > 0), col[name], 0))
                first = total[start] - np.where(step[start] & (col["bits"][start] & bit > 0), col[name][start], 0)
                return total - first[group]

            totals = {(k, b): summed(k, b) for b in [EVENT, *(2 << i for i in range(n))] for k in SUMS}
            # The latest click so far: rows ranked by tile, time and id, so a running maximum never leaves its tile.
            order = np.lexsort((col["last_id"], col["last_ts"], group))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            latest = order[np.maximum.accumulate(rank)]
            last_ts, last_id = col["last_ts"][latest], col["last_id"][latest]
            ask = np.flatnonzero(~step)
            if len(ask):
                what = col["bits"][ask]
                out = {"rid": col["rid"][ask], "label": totals["n_sales", EVENT][ask] * np.select([what == 0, what == -1], [-1, 1], 0)}
                for i in range(n):
                    for k in SUMS:
                        out[f"{k}_{i}"] = np.where(what == 0, totals[k, 2 << i][ask], np.where(what == i + 1, -totals[k, EVENT][ask], 0))
                out |= {"last_ts": np.where(what == 0, last_ts[ask], NONE), "last_id": np.where(what == 0, last_id[ask], NONE)}
                yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.int64()) for c in names], names=names)
            bits = np.array([EVENT, *(2 << i for i in range(n))])
            fixed = {"client": col["client"][-1], "tile": col["tile"][-1], "time": NONE, "kind": STEP, "rid": 0}
            held = {c: np.full(len(bits), v, col[c].dtype) for c, v in fixed.items()} | {"bits": bits.astype(col["bits"].dtype)}
            held |= {k: np.array([totals[k, b][-1] for b in bits]) for k in SUMS} | {c: np.where(bits > EVENT, v[-1], NONE) for c, v in (("last_ts", last_ts), ("last_id", last_id))}

    return run, ", ".join(f"{c} long" for c in names)


# ------------------------------------------------------------------ the operator


def features(clicks: DataFrame, sales: DataFrame, lines: DataFrame, plan: Plan = DEFAULT) -> DataFrame:
    """A row for each sale and window d: sale_id, d, t_us, label, the sums and last_click_id."""
    delay = plan.delay_minutes * 60 * SECOND
    available = lambda df: F.coalesce(micros(df, "arrived_at") + delay, F.lit(NEVER)).alias("available")
    t = F.col("ts") + F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit("")).cast("binary")) % 259_200 * SECOND
    sales = sales.select("sale_id", F.col("client_id").alias("client"), micros(sales, "sold_at").alias("ts"), available(sales), cents(F.col("total")).alias("cents"))
    sales = sales.where("client is not null and ts is not null").withColumn("t", t)
    seen = clicks.where("client_id is not null and ts is not null")
    # Clients with over 1/share of all rows.
    counts = seen.groupBy("client_id").count().select(F.col("client_id").alias("client"), "count").unionByName(sales.groupBy("client").count())
    counts = written(counts.groupBy("client").agg(F.sum("count").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("n") * plan.share > total).select("client", F.lit(True).alias("hot")))
    marked = lambda df: df.join(hot, "client", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))

    sales = written(marked(sales).withColumn("rid", F.monotonically_increasing_id()), "sales")
    seen = seen.distinct().select(F.col("client_id").alias("client"), micros(clicks, "ts").alias("ts"), available(clicks), (F.col("kind") == "purchase").alias("bought"), cents(F.col("value")).alias("cents"), F.coalesce(F.col("click_id").cast("long"), F.lit(NONE)).alias("click_id"))
    lines = lines.where("sale_id is not null").select("sale_id", "item_id", micros(lines, "shipped_at").alias("shipped"), cents(F.col("amount")).alias("cents"))
    shipped = written(lines.groupBy("sale_id", "shipped").agg(F.count("*").alias("n"), F.sum("cents").alias("cents")), "shipped")
    of_sale = shipped.groupBy("sale_id").agg(F.sum("n").alias("n_lines"), F.sum("cents").alias("line_cents"))

    ts, ready = F.col("ts"), F.col("available")
    click_values = {"n_clicks": F.lit(1), "n_purchases": F.coalesce(F.col("bought").cast("int"), F.lit(0)), "click_cents": F.col("cents")}
    sale_values = {"n_sales": F.lit(1), "sale_cents": F.col("cents")}
    line_values = {"n_lines": F.col("n"), "line_cents": F.col("line_cents")}
    entries = _entries(plan, ts, ready)
    by_line = shipped.withColumnRenamed("cents", "line_cents").join(sales.where("sale_id is not null"), "sale_id").withColumn("available", F.greatest("available", F.coalesce("shipped", F.lit(NEVER))))
    # The lines' sums by event time stand with their sale.
    at_sale = sales.join(of_sale, "sale_id", "left").na.fill(0, ["n_lines", "line_cents"])
    parts = [
        _steps(marked(seen), click_values, entries, (ts, F.col("click_id"), ready)),
        _steps(at_sale, sale_values | {"n_lines": F.col("n_lines"), "line_cents": F.col("line_cents")}, entries[:1]),
        _steps(sales, sale_values, entries[1:]),
        _steps(by_line, line_values, entries[1:]),
        _presence(lines, sales, plan),
        _asked(sales, plan),
    ]
    # Each part is a job of its own, which reports its own metrics only: what tasks report of a plan of all parts grows to megabytes with their number.
    tile = F.floor(F.col("time") / F.when(F.col("hot"), F.lit(HOUR)).otherwise(F.lit(plan.tile_days * DAY)))
    parts = [written(p.withColumn("tile", tile).drop("hot"), "steps") for p in parts]
    steps = sales.sparkSession.read.schema(parts[0].schema).parquet(*(p._stored_at for p in parts))
    rows = steps.unionByName(_carried(steps, [EVENT, *(2 << i for i in range(len(plan.windows)))]))
    run, schema = _answers(plan)
    answers = rows.repartition("client", "tile").sortWithinPartitions("client", "tile", "time", "kind").mapInArrow(run, schema)
    n = len(plan.windows)
    wide = answers.groupBy("rid").agg(F.sum("label").alias("label"), *(F.sum(f"{k}_{i}").alias(f"{k}_{i}") for i in range(n) for k in SUMS), F.max("last_ts").alias("last_ts"), F.max("last_id").alias("last_id"))
    out = wide.join(sales.select("rid", "sale_id", "t"), "rid")
    latest = lambda d: F.when((F.col("last_ts") > F.col("t") - d * DAY) & (F.col("last_id") > NONE), F.col("last_id"))
    each = F.array(*(F.struct(F.lit(d).alias("d"), *(F.col(f"{k}_{i}").alias(k) for k in SUMS), latest(d).alias("last_click_id")) for i, d in enumerate(plan.windows)))
    out = out.select("sale_id", F.col("t").alias("t_us"), (F.col("label") > 0).alias("label"), F.explode(each).alias("s"))
    return out.select("sale_id", "s.d", "t_us", "label", "s.n_clicks", "s.n_purchases", "s.click_cents", "s.last_click_id", "s.n_sales", "s.sale_cents", "s.n_lines", "s.n_items", "s.line_cents")


@bounded
def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines"))


SQL = """
WITH RECURSIVE bits(i, k, v) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
q AS (SELECT sale_id, client_id, sold_at, sold_at + to_seconds(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(sale_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 259200) AS t FROM sales, tab WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
w AS (SELECT q.*, d, t - to_days(d) AS edge FROM q, (VALUES (2), (14)) v(d)),
c AS (SELECT w.sale_id, w.d, count(*) AS n_clicks, count(*) FILTER (WHERE kind = 'purchase') AS n_purchases, sum(floor(100 * coalesce(value, 0) + 0.5)::BIGINT)::BIGINT AS click_cents, arg_max(click_id, (ts, click_id)) AS last_click_id FROM w JOIN (SELECT DISTINCT * FROM clicks) c ON c.client_id = w.client_id AND c.ts > w.edge AND c.ts <= w.t AND c.arrived_at + INTERVAL 240 MINUTE <= w.t GROUP BY ALL),
s AS (SELECT w.sale_id, w.d, w.t, s.sale_id AS other, s.total FROM w JOIN sales s ON s.client_id = w.client_id AND s.sold_at > w.edge AND s.sold_at <= w.t AND s.arrived_at + INTERVAL 240 MINUTE <= w.t),
n AS (SELECT sale_id, d, count(*) AS n_sales, sum(floor(100 * coalesce(total, 0) + 0.5)::BIGINT)::BIGINT AS sale_cents FROM s GROUP BY ALL),
l AS (SELECT s.sale_id, s.d, count(*) AS n_lines, count(DISTINCT l.item_id) AS n_items, sum(floor(100 * coalesce(l.amount, 0) + 0.5)::BIGINT)::BIGINT AS line_cents FROM s JOIN sale_lines l ON l.sale_id = s.other AND l.shipped_at <= s.t GROUP BY ALL)
SELECT w.sale_id, w.d, epoch_us(w.t) AS t_us, EXISTS (SELECT 1 FROM sales f WHERE f.client_id = w.client_id AND f.sold_at > w.t AND f.sold_at <= w.t + INTERVAL 7 DAY) AS label,
coalesce(c.n_clicks, 0) AS n_clicks, coalesce(c.n_purchases, 0) AS n_purchases, coalesce(c.click_cents, 0) AS click_cents, c.last_click_id, coalesce(n.n_sales, 0) AS n_sales, coalesce(n.sale_cents, 0) AS sale_cents,
coalesce(l.n_lines, 0) AS n_lines, coalesce(l.n_items, 0) AS n_items, coalesce(l.line_cents, 0) AS line_cents
FROM w LEFT JOIN c ON c.sale_id = w.sale_id AND c.d = w.d LEFT JOIN n ON n.sale_id = w.sale_id AND n.d = w.d LEFT JOIN l ON l.sale_id = w.sale_id AND l.d = w.d
"""
