"""Sharding by a k-d tree over metadata, in DataFrame operations only.

Points are groups of equal texts, which share a shard wherever they can; a point weighs the bytes of its rows and lies at the least value of its
rows in every metadata dimension, scaled to 0 to 1. A node of the tree that stands for k shards is split along its widest dimension at the weighted median (for
odd k, at the share of k // 2), until each leaf stands for one shard, whose bytes then are near the k-th part of all.

A median is sought for all nodes of a level at once. Histograms over the values of the points (summed before the shuffle) narrow the place down to
the few points of one bin, by the dimension and then by a hash of the text; these are sorted, and the point in which the median falls is cut. A point
of one row, or of less than a plan.slack-th part of a shard's bytes, isn't cut but goes to the nearer side; so at most shards - 1 groups lie in several shards,
and a shard is off by about a row and 3 % of its bytes at most. Only bins, cuts and nodes, whose number doesn't grow with the input, reach the driver.

Rows find the shard of their group by a join; groups that are cut or hold over 1/256 of all rows, of which there are few, by a broadcast one. Rows of a
cut group are numbered, as are those of a shard: within blocks of about BLOCK_ROWS rows that tasks sort, from the number of rows in the blocks before.

Defined cases: a null text weighs as an empty one, and both are one group; null metadata and a doc_id that is null or no number count as the least value; repeated rows are
rows of their own; with fewer rows than shards some shards stay empty; an empty table gives an empty result; all columns of the input are kept
or ignored whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalake.llm.common import discard, shielded, table, written

ROW_BYTES = 16
BLOCK_ROWS = 1 << 16


@dataclass(frozen=True)
class Plan:
    shards: int = 40
    bins: int = 1024
    few: int = 4096  # points that one task sorts for a node
    slack: int = 32


DEFAULT = Plan()


def _share(c: Column) -> Column:
    """A name's place between 0 and 1, by hash."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) / F.lit(2.0**32), F.lit(0.0))


DIMENSIONS = {
    "source": lambda: _share(F.col("source")),
    "lang": lambda: _share(F.col("lang")),
    "n_chars": lambda: F.char_length(F.coalesce(F.col("text"), F.lit(""))).cast("double"),
    "doc_id": lambda: F.expr("try_cast(doc_id AS double)"),
}


def _of(node: Column, values: list, kind: str) -> Column:
    """The value of each row's node, of one value a node."""
    return F.get(F.array(*(F.lit(v).cast(kind) for v in values)), node)


def _groups(rows: DataFrame, dims: list[str]) -> DataFrame:
    """The points: (g, size) of a text, its number of rows and its place in all dimensions."""
    points = written(rows.groupBy("g", "size").agg(F.count("*").alias("rows"), *(F.min(x).alias(x) for x in dims)), "points")
    ends = points.agg(*(f(x).alias(f"{n}_{x}") for x in dims for n, f in (("lo", F.min), ("hi", F.max)))).first()

    def scaled(x: str) -> Column:
        lo, hi = ends[f"lo_{x}"], ends[f"hi_{x}"]
        return F.lit(0.0) if lo is None or hi <= lo else F.coalesce((F.col(x) - F.lit(lo)) / F.lit(hi - lo), F.lit(0.0))

    hashed = F.shiftright("g", 11).cast("double")
    return points.select("g", "size", "rows", F.lit(0).cast("long").alias("lo"), F.col("rows").alias("hi"), hashed.alias("h"), *(scaled(x).alias(x) for x in dims), F.lit(0).alias("node"))


def _medians(pieces: DataFrame, dims: list[str], goals: dict[int, tuple[str, int]], n_nodes: int, ends: dict[int, tuple], plan: Plan) -> dict[int, dict]:
    """For each node of goals (dimension, bytes that go left) the piece in which that place falls, and the bytes of the node before it."""
    node, weight = F.col("node"), (F.col("hi") - F.col("lo")) * F.col("size")
    of = lambda values, kind: _of(node, [values.get(i) for i in range(n_nodes)], kind)
    along = {i: dims.index(d) for i, (d, _) in goals.items()}
    x = F.get(F.array(*dims), of(along, "int"))
    active = pieces.where(node.isin(list(goals))).withColumn("x", x).withColumn("weight", weight)
    state = {i: {"x": ends[i][:2], "h": None, "before": 0, "count": ends[i][2]} for i in goals}

    def bracket() -> DataFrame:
        side = lambda name, k: of({i: s[name][k] for i, s in state.items() if s[name]}, "double")
        inside = (F.col("x") >= side("x", 0)) & (F.col("x") <= side("x", 1))
        return active.where(inside & F.coalesce((F.col("h") >= side("h", 0)) & (F.col("h") <= side("h", 1)), F.lit(True)))

    rest = lambda: of({i: goals[i][1] - s["before"] for i, s in state.items()}, "long")
    while wide := [i for i, s in state.items() if s["count"] > plan.few]:
        for i in wide:
            if state[i]["x"][0] == state[i]["x"][1] and not state[i]["h"]:
                state[i]["h"] = (-(2.0**52), 2.0**52)
        by_h = {i: s["h"] is not None for i, s in state.items()}
        if stuck := [i for i in wide if by_h[i] and state[i]["h"][0] == state[i]["h"][1]]:
            wide = [i for i in wide if i not in stuck]  # texts that share 53 bits of their hash
            if not wide:
                break
        value = F.when(of(by_h, "boolean"), F.col("h")).otherwise(F.col("x"))
        lo, hi = (of({i: s["h" if by_h[i] else "x"][k] for i, s in state.items()}, "double") for k in (0, 1))
        place = F.when(hi > lo, F.least(F.floor((value - lo) / (hi - lo) * plan.bins), F.lit(plan.bins - 1))).otherwise(F.lit(0))
        bins = bracket().where(node.isin(wide)).withColumn("value", value).groupBy("node", place.alias("bin")).agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        upto = bins.withColumn("upto", F.sum("weight").over(Window.partitionBy("node").orderBy("bin")))
        for r in upto.where((F.col("upto") - F.col("weight") <= rest()) & (F.col("upto") > rest())).collect():
            s = state[r.node]
            s["h" if by_h[r.node] else "x"], s["before"], s["count"] = (r.lo, r.hi), s["before"] + r.upto - r.weight, r.n
    order = Window.partitionBy("node").orderBy("x", "h", "g", "size", "lo").rowsBetween(Window.unboundedPreceding, 0)
    upto = bracket().withColumn("upto", F.sum("weight").over(order))
    found = upto.where((F.col("upto") - F.col("weight") <= rest()) & (F.col("upto") > rest())).collect()
    return {r.node: r.asDict() | {"offset": goals[r.node][1] - state[r.node]["before"] - (r.upto - r.weight)} for r in found}


def tree(points: DataFrame, dims: list[str], plan: Plan) -> DataFrame:
    """(g, size, rows, lo, hi, shard): the rows from lo to hi of a group lie in this shard."""
    pieces, nodes, total, levels = written(points, "pieces"), [(0, plan.shards)], None, []
    while any(k > 1 for _, k in nodes):
        open_ = [i for i, (_, k) in enumerate(nodes) if k > 1]
        stats = pieces.where(F.col("node").isin(open_)).groupBy("node").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("size")).alias("bytes"), F.count("*").alias("n"), *(f(x).alias(f"{n}_{x}") for x in dims for n, f in (("lo", F.min), ("hi", F.max))))
        goals, ends = {}, {}
        for r in stats.collect():
            widest = max(dims, key=lambda x: r[f"hi_{x}"] - r[f"lo_{x}"])
            goals[r.node] = (widest, r.bytes * (nodes[r.node][1] // 2) // nodes[r.node][1])
            ends[r.node] = (r[f"lo_{widest}"], r[f"hi_{widest}"], r.n)
            total = total or r.bytes
        slack = (total or 0) // (plan.shards * plan.slack)
        cuts = _medians(pieces, dims, goals, len(nodes), ends, plan) if goals else {}
        for c in cuts.values():
            many = c["hi"] - c["lo"]
            near = (2 * c["offset"] + c["size"]) // (2 * c["size"])
            c["at"] = c["lo"] + (near if many > 1 and c["weight"] > slack else many if 2 * c["offset"] > c["weight"] else 0)
        # Children, in the order of their shards.
        children, left, right = [], [], []
        for first, k in nodes:
            left.append(len(children))
            children.append((first, max(1, k // 2)))
            if k > 1:
                children.append((first + k // 2, k - k // 2))
            right.append(len(children) - 1)
        node = F.col("node")
        cut = lambda name, kind: _of(node, [cuts.get(i, {}).get(name) for i in range(len(nodes))], kind)
        x = F.get(F.array(*dims), _of(node, [dims.index(goals[i][0]) if i in goals else None for i in range(len(nodes))], "int"))
        own, there = F.struct(x.alias("x"), "h", "g", "size", "lo"), F.struct(cut("x", "double").alias("x"), cut("h", "double").alias("h"), cut("g", "long").alias("g"), cut("size", "long").alias("size"), cut("lo", "long").alias("lo"))
        at = F.when(cut("at", "long").isNull() | (own < there), F.col("hi")).when(own == there, cut("at", "long")).otherwise(F.col("lo"))
        halves = F.array(*(F.struct(_of(node, side, "int").alias("node"), lo.alias("lo"), hi.alias("hi")) for side, lo, hi in ((left, F.col("lo"), at), (right, at, F.col("hi")))))
        keep = ["g", "size", "rows", "h", *dims]
        levels.append(pieces)
        pieces = written(pieces.select(*keep, F.explode(F.filter(halves, lambda s: s["lo"] < s["hi"])).alias("s")).select(*keep, "s.*"), "pieces")
        nodes = children
    if levels:
        discard(*levels)
    return pieces.select("g", "size", "rows", "lo", "hi", _of(F.col("node"), [first for first, _ in nodes], "int").alias("shard"))


def _numbered(rows: DataFrame, keys: list[str], blocks: Column, name: str) -> DataFrame:
    """rows with the column name: gapless numbers from 0 within keys. blocks: into how many blocks the rows of a key go."""
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("rid"), blocks))
    sizes = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("rid")) - 1)
    return within.join(starts, [*keys, "_block"]).withColumn(name, F.col("_start") + F.col("_at")).drop("_block", "_start", "_at")


def assign(docs: DataFrame, plan: Plan = DEFAULT, keep: list[str] | None = None, dimensions: dict | None = None) -> DataFrame:
    """The columns `keep` of docs (all, if none are named) with size, text_crc32, shard and slot; a column of docs of one of these names is left out."""
    dimensions = dimensions or DIMENSIONS
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("size", "text_crc32", "shard", "slot")]
    missing = [c for c in ("source", "lang") if c not in docs.columns]
    inner, _ = shielded(docs.select(*keep, *(F.lit(None).cast("string").alias(c) for c in missing)) if missing else docs, ["doc_id", "text", "source", "lang"])
    where = dict(zip(docs.columns, inner.columns, strict=False)) if not missing else dict(zip(keep, inner.columns, strict=False))
    text, dims = F.coalesce(F.col("text"), F.lit("")), [f"x_{d}" for d in dimensions]
    rows = inner.select(
        *(F.col(where[c]).alias(f"k{i}") for i, c in enumerate(keep)),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g"),
        *(make().alias(x) for x, make in zip(dims, dimensions.values(), strict=True)),
        F.monotonically_increasing_id().alias("rid"),
    )
    rows = written(rows, "rows")
    pieces = written(tree(_groups(rows, dims), dims, plan), "shards")
    n = rows.count()
    rows = rows.drop(*dims)
    # At most 2 x shards pieces of cut groups, and 256 groups of many rows.
    cut = (F.col("lo") > 0) | (F.col("hi") < F.col("rows"))
    many = F.col("rows") * 256 > n
    few, split = F.broadcast(pieces.where(many & ~cut).select("g", "size", "shard")), F.broadcast(pieces.where(cut).select("g", "size", "lo", "hi", "shard"))
    rare = pieces.where(~cut & ~many).select("g", "size", "shard")
    special = F.broadcast(pieces.where(cut | many).select("g", "size").distinct())
    in_cut = rows.join(F.broadcast(pieces.where(cut).select("g", "size").distinct()), ["g", "size"], "left_semi")
    in_cut = _numbered(in_cut, ["g", "size"], F.lit(n // BLOCK_ROWS + 1), "r")
    in_cut = in_cut.alias("r").join(split.alias("s"), (F.col("r.g") == F.col("s.g")) & (F.col("r.size") == F.col("s.size")) & (F.col("r.r") >= F.col("s.lo")) & (F.col("r.r") < F.col("s.hi"))).select("r.*", "s.shard").drop("r")
    plain = rows.join(special, ["g", "size"], "left_anti").join(rare, ["g", "size"])
    found = written(plain.unionByName(rows.join(few, ["g", "size"])).unionByName(in_cut), "assigned")
    per_shard = dict(found.groupBy("shard").count().collect())
    blocks = _of(F.col("shard"), [per_shard.get(i, 0) // BLOCK_ROWS + 1 for i in range(plan.shards)], "long")
    out = _numbered(found, ["shard"], blocks, "slot")
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, plan: Plan = DEFAULT) -> None:
    """Writes docs as Parquet, a folder shard=i for each shard that has rows."""
    placed = assign(docs, plan)
    placed.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
