"""Lookups of read text in reference tables. Each returns one value for each read row, by a join and an aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.functions.text import comparable, folded
from stratalake.operators.sized import THETA_ROWS, is_small, small
from stratalake.operators.stages import stored


def exact(read: DataFrame, text: Column, refs: DataFrame, key: Column, value: Column, name: str) -> DataFrame:
    """Adds `name`: the greatest value of the references whose comparable key equals the comparable text; null if none does."""
    table = refs.groupBy(comparable(key).alias("_k")).agg(F.max(value).alias(name))
    return read.withColumn("_t", comparable(text)).join(table, F.col("_t") == F.col("_k"), "left").drop("_t", "_k")


def dictionary(read: DataFrame, text: Column, refs: DataFrame, key: Column, value: Column, name: str) -> DataFrame:
    """Adds `name`: the looked-up value (case and outer blanks don't matter), the text itself where there is none."""
    table = refs.groupBy(F.lower(F.trim(key)).alias("_k")).agg(F.max(value).alias("_v"))
    out = read.withColumn("_t", F.lower(F.trim(text))).join(table, F.col("_t") == F.col("_k"), "left")
    return out.withColumn(name, F.coalesce("_v", text)).drop("_t", "_k", "_v")


def _suits(context: Column | None, stored: Column) -> Column:
    return F.lit(True) if context is None else context.isNull() | (context == "") | stored.endswith(context)


def prefix_unique(read: DataFrame, id_: str, text: Column, refs: DataFrame, key: Column, value: Column, context: Column | None = None, least: int = 1) -> DataFrame:
    """(id, value): the value of the references that begin with the text (and end with the context), if there is just one; else null.

    Stored keys are a trie as a table: one row for each prefix, with the least and the greatest value below it, so a text meets one row at most. With a context there is one
    row for each prefix and each ending that is asked for, found by the endings that occur as contexts."""
    entries = refs.select(comparable(key).alias("_s"), value.alias("_v")).where("_s is not null and _v is not null").distinct()
    asked = read.select(F.col(id_), comparable(text).alias("_t"), (F.coalesce(comparable(context), F.lit("")) if context is not None else F.lit("")).alias("_c"))
    ends = asked.select("_c").distinct().withColumn("_n", F.length("_c"))
    if context is None:
        ended = entries.withColumn("_c", F.lit(""))
    else:
        # Of the endings of each key only those that occur as contexts stay; their lengths are few.
        lengths = small(ends.select("_n").distinct())
        cut = entries.join(lengths, F.col("_n") <= F.length("_s")).withColumn("_c", F.when(F.col("_n") > 0, F.expr("right(_s, _n)")).otherwise("")).drop("_n")
        ended = cut.join(ends.select("_c"), "_c", "left_semi")
    starts = F.transform(F.sequence(F.lit(least), F.greatest(F.length("_s"), F.lit(least))), lambda n: F.substring(F.col("_s"), F.lit(1), n))
    trie = ended.withColumn("_t", F.explode(starts)).groupBy("_t", "_c").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    found = asked.join(trie, ["_t", "_c"]).select(id_, F.when(F.col("_lo") == F.col("_hi"), F.col("_hi")).alias("value"))
    return read.select(id_).join(found, id_, "left")


def contained_longest(read: DataFrame, id_: str, text: Column, refs: DataFrame, key: Column, value: Column, rows: int = THETA_ROWS) -> DataFrame:
    """(id, value): the value of the longest reference that the text contains (of equally long ones the greatest), null if it holds none.

    Few references are broadcast; otherwise the text is cut into all its substrings of the lengths that references have, which meet them by equality."""
    stored = refs.select(comparable(key).alias("_s"), value.alias("_v")).where("_s is not null and _s <> '' and _v is not null").groupBy("_s").agg(F.max("_v").alias("_v"))
    asked = read.select(F.col(id_), comparable(text).alias("_t"))
    if is_small(stored, rows):
        met = asked.join(F.broadcast(stored), F.col("_t").contains(F.col("_s")))
    else:
        lengths = stored.select(F.length("_s").alias("_n")).distinct()
        cut = asked.join(F.broadcast(lengths), F.col("_n") <= F.length("_t"))
        cut = cut.withColumn("_x", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_t") - F.col("_n") + 1), lambda i: F.substring(F.col("_t"), i, F.col("_n"))))))
        met = cut.join(stored, F.col("_x") == F.col("_s"))
    found = met.groupBy(id_).agg(F.max(F.struct(F.length("_s").alias("n"), F.col("_v").alias("v"))).alias("_b")).select(id_, F.col("_b.v").alias("value"))
    return read.select(id_).join(found, id_, "left")


GRAM = 4  # letters of the longest piece
BEYOND = 3  # edits beyond those that are spent, up to which a tree of beginnings is searched
FANOUT = 16  # by which the nodes of that tree may grow from one depth to the next
TASK_ROWS = 20_000
MASKS = 1024  # patterns of spent letters that get tables of their own


def _grams(text: str, longest: int = GRAM) -> Column:
    """All pieces of a text of 1 to `longest` letters: array<struct<x,at>>, places from 0."""
    n = F.length(text)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.struct(F.substring(F.col(text), i + 1, F.lit(k)).alias("x"), i.cast("int").alias("at")))).otherwise(F.expr("cast(array() as array<struct<x:string,at:int>>)"))
    return F.concat(*(of(k) for k in range(1, longest + 1)))


def piece_index(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the stored texts _s: (x, s_at, _s) for each place of each piece, and (x, n, places): how often a piece occurs, and where single letters do."""
    index = stored(keys.select("_s", F.explode(_grams("_s")).alias("p")).select("_s", "p.x", F.col("p.at").alias("s_at")), "pieces")
    places = F.collect_set(F.when(F.length("x") == 1, F.col("s_at")))
    return index, stored(index.groupBy("x").agg(F.count("*").alias("n"), places.alias("places")), "counts")


def piece_plan(texts: DataFrame, counts: DataFrame, limit: int) -> DataFrame:
    """For each text (_t, _c): spent, how many of its letters no stored text has anywhere near their place, each of which costs an edit whatever the stored
    text; free, its other letters; and its pieces of such letters, rarest first. Texts that spend more than the limit are left out."""
    cut = texts.select("_t", "_c", F.explode(_grams("_t")).alias("p")).select("_t", "_c", "p.x", "p.at").join(small(counts), "x", "left")
    # Within `limit` edits a letter is kept at most so many places to the left, and half as many to the right, as both texts end together.
    near = F.exists("places", lambda p: (p >= F.col("at") - limit) & (p <= F.col("at") + limit // 2))
    lost = (F.length("x") == 1) & ~F.coalesce(near, F.lit(False))
    pieces = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("x")).alias("k"), "at", "x")))
    gathered = cut.groupBy("_t", "_c").agg(F.collect_set(F.when(lost, F.col("at"))).alias("lost"), pieces.alias("pieces"))
    whole = F.filter("pieces", lambda p: ~F.exists(F.col("lost"), lambda i: (i >= p["at"]) & (i < p["at"] - p["k"])))
    spent = F.size("lost")
    return gathered.select("_t", "_c", spent.alias("spent"), (F.length("_t") - spent).alias("free"), whole.alias("pieces")).where(F.col("spent") <= limit)


def candidates(plan: DataFrame, index: DataFrame, extra: int, limit: int) -> DataFrame:
    """(_t, _c, edits, _s), some of them repeated: among them every stored text within `edits`, that is spent + extra (and within the limit), of the text.

    Of extra + 1 separate pieces one is kept as it is, so the rarest such pieces are sought, where that many edits can have moved them."""
    more = F.least(F.lit(extra), F.lit(limit) - F.col("spent"))
    longest = F.least(F.lit(GRAM), F.floor(F.col("free") / (more + 1)).cast("int"))
    none = F.expr("cast(array() as array<struct<n:bigint,k:int,at:int,x:string>>)")
    apart = lambda chosen, p: ~F.exists(chosen, lambda c: (c["at"] < p["at"] - p["k"]) & (p["at"] < c["at"] - c["k"]))
    picked = F.aggregate(F.filter("pieces", lambda p: -p["k"] <= longest), none, lambda chosen, p: F.when((F.size(chosen) <= more) & apart(chosen, p), F.concat(chosen, F.array(p))).otherwise(chosen))
    sought = plan.where(F.col("free") > more).select("_t", "_c", (F.col("spent") + more).alias("edits"), F.explode(picked).alias("p")).where("p.n > 0").select("_t", "_c", "edits", "p.at", "p.x")
    short = F.greatest(F.length("_t") - F.length("_s"), F.lit(0))
    moved = F.col("s_at") - F.col("at")
    there = (moved <= F.floor((F.col("edits") - short) / 2)) & (-moved <= F.floor((F.col("edits") + short) / 2)) & (F.col("s_at") + F.length("x") <= F.length("_t"))
    named = F.col("_c").isNull() | (F.col("_c") == "") | F.col("_s").endswith(F.col("_c"))
    return sought.join(index, "x").where(there & named).select("_t", "_c", "edits", "_s")


def _same() -> Column:
    return (F.col("_t") == F.col("_t2")) & F.col("_c").eqNullSafe(F.col("_c2"))


def _edits(limit: int) -> Column:
    return F.levenshtein(F.col("_t"), F.substring(F.col("_s"), F.lit(1), F.length("_t")), limit)


def _least(near: DataFrame) -> DataFrame:
    """(_t, _c, d, n, _v) of pairs (_t, _c, _v, _w) at distance d: the least distance, how many stored entries have it, and the least of their values."""
    by = near.groupBy("_t", "_c", "d").agg(F.sum("_w").alias("n"), F.min("_v").alias("_v"))
    return by.groupBy("_t", "_c").agg(F.min_by(F.struct("d", "n", "_v"), "d").alias("b")).select("_t", "_c", "b.*")


def _by_pieces(texts: DataFrame, entries: DataFrame, limit: int, budgets: set[int]) -> list[DataFrame]:
    """(_t, _c, d, n, _v) as of _least, over all stored texts, in rounds of growing budgets: a text is settled once the least distance that it has met is within its budget."""
    index, counts = piece_index(entries.select("_s"))
    left = stored(piece_plan(texts, counts, limit), "asked")
    found, n = [], left.count()
    for extra in sorted(budgets):
        near = candidates(left, index, extra, limit).withColumn("d", _edits(limit)).where("d between 0 and edits").drop("edits").distinct()
        settled = stored(_least(near.join(entries, "_s")), f"settled-{extra}")
        found.append(settled)
        n -= settled.count()
        if not n:
            break
        if extra < limit:
            left = stored(left.join(settled.select("_t", "_c").toDF("_t2", "_c2"), _same(), "left_anti"), f"left-{extra}")
    else:
        # Texts with no more letters than edits may keep no piece. They meet the references that their context names, or without one the distinct beginnings of
        # references as long as they, which the alphabet bounds.
        tiny, named = left.where(F.col("free") <= F.lit(limit) - F.col("spent")).select("_t", "_c"), F.coalesce("_c", F.lit("")) != ""
        if not tiny.isEmpty():
            ends = entries.withColumn("_e", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_s"), F.lit(1))), lambda i: F.substring(F.col("_s"), i, F.length("_s")))))
            columns = ["_t", "_c", "_s", "_v", "_w"]
            met = tiny.where(named).join(ends, F.col("_c") == F.col("_e")).select(*columns)
            starts = entries.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(limit)))).groupBy("_n", F.substring(F.col("_s"), F.lit(1), F.col("_n")).alias("_s")).agg(F.min("_v").alias("_v"), F.sum("_w").alias("_w"))
            met = met.unionByName(tiny.where(~named).join(small(starts), F.length("_t") == F.col("_n")).select(*columns))
            found.append(_least(met.withColumn("d", _edits(limit)).where("d >= 0")))
    return found


def _dealt(df: DataFrame, by: str) -> DataFrame:
    """df, written, dealt to tasks of at most TASK_ROWS rows: rows are short, and each is worked on for long."""
    df = stored(df, "dealt")
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS)), by)


def spent_letters(texts: DataFrame, entries: DataFrame, limit: int) -> DataFrame:
    """texts (_t, _c) with lost: the places of the letters that no stored text has anywhere near, each of which costs an edit whatever the stored text. Texts that
    lose more than the limit are left out."""
    letters = entries.select(F.explode(_grams("_s", 1)).alias("p")).select("p.x", "p.at").distinct()
    near = letters.select("x", F.explode(F.sequence(F.col("at") - limit // 2, F.col("at") + limit)).alias("i"))
    # One row: the letters that can be kept at each place.
    reach = near.groupBy("i").agg(F.array_join(F.collect_set("x"), "").alias("xs")).agg(F.map_from_entries(F.collect_list(F.struct("i", "xs"))).alias("reach"))
    kept = lambda i: F.coalesce(F.contains(F.try_element_at("reach", i), F.substring(F.col("_t"), i + 1, F.lit(1))), F.lit(False))
    lost = F.filter(F.sequence(F.lit(0), F.length("_t") - 1), lambda i: ~kept(i))
    return texts.crossJoin(F.broadcast(reach)).select("_t", "_c", lost.alias("lost")).where(F.size("lost") <= limit)


def _by_masks(asked: DataFrame, entries: DataFrame, numbers: dict[tuple, int]) -> DataFrame:
    """(_t, _c, d, n, _v) as of _least of the texts that some stored text, none of which is shorter, equals but for the lost letters: with the edits that are spent
    anyway, nothing can be put in or left out, so equality outside of the lost places decides.

    `numbers` has the masks (length, lost places) by number, with all their beginnings. The table of a mask is made from that of the mask with one place
    less, so it shrinks as places are added."""
    spark = asked.sparkSession
    summed = (F.sum("_w").alias("_w"), F.min("_v").alias("_v"))
    whole = F.explode(F.array(*(F.struct(F.lit(i).alias("mask"), F.lit(m[0]).alias("n")) for m, i in numbers.items() if not m[1])))
    level = stored(entries.select("_w", "_v", "_s", whole.alias("m")).groupBy("m.mask", F.substring(F.col("_s"), F.lit(1), F.col("m.n")).alias("key")).agg(*summed), "mask-0")
    tables = level
    for size in range(1, max(len(m[1]) for m in numbers) + 1):
        more = spark.createDataFrame([(numbers[m[0], m[1][:-1]], i, m[1][-1] + 1) for m, i in numbers.items() if len(m[1]) == size], "mask int, deeper int, at int")
        level = level.join(F.broadcast(more), "mask").groupBy(F.col("deeper").alias("mask"), F.overlay("key", F.lit(" "), F.col("at"), F.lit(1)).alias("key")).agg(*summed)
        level = stored(level, f"mask-{size}")
        tables = tables.unionByName(level)
    key = F.aggregate("lost", F.col("_t"), lambda t, i: F.overlay(t, F.lit(" "), i + 1, F.lit(1)))
    met = asked.withColumn("key", key).join(tables, ["mask", "key"])
    return met.select("_t", "_c", F.size("lost").alias("d"), F.col("_w").alias("n"), "_v")


def beginnings(entries: DataFrame, longest: int) -> tuple[list[int], DataFrame]:
    """(depths, tree): the beginnings of stored texts at some depths (whole texts where they are shorter), each below its own beginning at the depth before:
    k, up, node, how many entries it has (_w), and the least of their values."""
    counts = [1, *entries.agg(*(F.approx_count_distinct(F.substring("_s", 1, d)) for d in range(1, longest + 1))).first()]
    depths = [0]
    while depths[-1] < longest:
        at = depths[-1]
        depths.append(max((d for d in range(at + 1, longest + 1) if counts[d] <= FANOUT * counts[at]), default=at + 1))
    steps = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(up).alias("up"), F.lit(to).alias("to")) for k, (up, to) in enumerate(zip(depths[:-1], depths[1:], strict=True)))))
    start = lambda n: F.substring(F.col("_s"), F.lit(1), F.col(n))
    tree = entries.select("_s", "_w", "_v", steps.alias("p")).groupBy("p.k", start("p.up").alias("up"), start("p.to").alias("below")).agg(F.sum("_w").alias("_w"), F.min("_v").alias("_v"))
    return depths[1:], stored(tree, "tree")


def descend(texts: DataFrame, depths: list[int], tree: DataFrame, extra: int, limit: int) -> DataFrame:
    """(_t, _c, d, _v, _w): of each beginning as long as the text that is within spent + extra (and the limit) edits of it.

    From depth to depth, a beginning stays if some beginning of the text is so near that the letters lost in the rest fit into the budget. A lost letter costs an
    edit that puts none in, so no more than `extra` letters are put in."""
    states = texts.select("_t", "_c", "lost", F.least(F.size("lost") + extra, F.lit(limit)).alias("edits"), F.lit("").alias("node"))
    found = None
    for k, depth in enumerate(depths):
        met = states.join(small(tree.where(F.col("k") == k).drop("k")), F.col("node") == F.col("up")).drop("node", "up")
        own = F.levenshtein(F.col("_t"), F.substring(F.col("below"), F.lit(1), F.length("_t")), limit)
        met = met.withColumn("d", F.when(F.length("_t") <= depth, own))
        reached = F.sequence(F.greatest(F.length("below") - extra, F.lit(0)), F.greatest(F.least(F.length("_t"), F.length("below") + limit), F.length("below") - extra, F.lit(0)))
        rest = lambda j: F.size(F.filter("lost", lambda i: i >= j))
        open_ = F.exists(reached, lambda j: F.levenshtein(F.substring(F.col("_t"), F.lit(1), j), F.col("below"), limit).between(0, F.col("edits") - rest(j)))
        met = stored(met.where(F.when(F.col("d").isNotNull(), F.col("d").between(0, F.col("edits"))).otherwise(open_)), f"depth-{depth}")
        ended = met.where("d is not null").select("_t", "_c", "d", "_v", "_w")
        found = ended if found is None else found.unionByName(ended)
        states = met.where("d is null").select("_t", "_c", "lost", "edits", F.col("below").alias("node"))
        if states.isEmpty():
            break
    return found


def _without_context(texts: DataFrame, entries: DataFrame, limit: int) -> list[DataFrame]:
    """(_t, _c, d, n, _v) as of _least, of texts without a context. First what is met by the spent edits alone, by tables of masks or else down a tree; then, in rounds
    of growing budgets, what is met down the tree; the rest by pieces."""
    left = stored(spent_letters(texts, entries, limit), "spent")
    sizes = entries.agg(F.min(F.length("_s"))).first()
    masks = left.where(F.length("_t") <= F.lit(sizes[0])).groupBy(F.length("_t").alias("n"), "lost").count().orderBy(F.desc("count"), "n", "lost").limit(MASKS).collect()
    masks = [(r.n, tuple(r.lost)) for r in masks]
    found, tree = [], None
    if masks:
        numbers = {m: i for i, m in enumerate(sorted({(n, lost[:k]) for n, lost in masks for k in range(len(lost) + 1)}))}
        asked = texts.sparkSession.createDataFrame([(n, list(lost), numbers[n, lost]) for n, lost in masks], "n int, lost array<int>, mask int")
        left = left.withColumn("n", F.length("_t")).join(F.broadcast(asked), ["n", "lost"], "left").drop("n")
        found.append(stored(_by_masks(left.where("mask is not null"), entries, numbers), "masked"))
        left = stored(left.join(found[-1].select("_t", "_c").toDF("_t2", "_c2"), _same(), "left_anti"), "left")
    else:
        left = left.withColumn("mask", F.lit(None).cast("int"))
    for extra in sorted({min(b, limit) for b in (0, 1, 2, limit)}):
        if extra > BEYOND and left.isEmpty():
            break
        if extra > BEYOND:
            return [*found, *_by_pieces(left.select("_t", "_c"), entries, limit, {extra})]
        now = left if extra else left.where("mask is null")
        if now.isEmpty():
            continue
        tree = tree or beginnings(entries, left.agg(F.max(F.length("_t"))).first()[0])
        settled = stored(_least(descend(now, *tree, extra, limit)), f"settled-{extra}")
        found.append(settled)
        left = stored(left.join(settled.select("_t", "_c").toDF("_t2", "_c2"), _same(), "left_anti"), f"left-{extra}")
    return found


def _nearest(texts: DataFrame, entries: DataFrame, limit: int) -> DataFrame:
    """(_t, _c, d, n, _v) as of _least, over all stored texts, without joining all with all."""
    entries = stored(_dealt(entries.groupBy("_s").agg(F.count("*").alias("_w"), F.min("_v").alias("_v")), "_s"), "entries")
    texts = _dealt(texts, "_t")
    named = F.coalesce("_c", F.lit("")) != ""
    found = _without_context(texts.where(~named), entries, limit)
    if not (rest := texts.where(named)).isEmpty():
        found += _by_pieces(rest, entries, limit, {min(b, limit) for b in (0, 1, 2, limit)})
    columns = ["_t", "_c", "d", "n", "_v"]
    out = _least(entries.limit(0).select(F.lit("").alias("_t"), F.lit("").alias("_c"), F.lit(0).alias("d"), "_w", "_v")) if not found else found[0].select(*columns)
    for f in found[1:]:
        out = out.unionByName(f.select(*columns))
    return out


def most_alike(read: DataFrame, id_: str, text: Column, refs: DataFrame, key: Column, value: Column, limit: int = 2, context: Column | None = None, rows: int = THETA_ROWS) -> DataFrame:
    """(id, value): the value of the reference whose beginning, as long as the text, is fewest edits away; null beyond `limit`, or if two
    are equally near, or for an empty text.

    Few references are broadcast. Otherwise letters that no reference has near their place are spent beforehand, and each distinct text is met by equality of the
    others; texts that find nothing so go down a tree of the references' beginnings, with a budget of edits that grows in rounds; those that need many edits, or have
    a context, seek the references that share one of their rarest pieces."""
    entries = refs.select(folded(key).alias("_s"), value.alias("_v")).where("_s is not null and _v is not null").distinct()
    asked = read.select(F.col(id_), folded(text).alias("_t"), (folded(context) if context is not None else F.lit(None).cast("string")).alias("_c")).where("_t <> ''")
    texts = asked.select("_t", "_c").distinct()
    if is_small(refs, rows):
        met = texts.join(F.broadcast(entries), _suits(F.col("_c"), F.col("_s"))).withColumn("_w", F.lit(1))
        least = _least(met.withColumn("d", _edits(limit)).where("d >= 0"))
    else:
        least = _nearest(texts, entries, limit)
    found = least.where("n = 1").select(F.col("_t").alias("_t2"), F.col("_c").alias("_c2"), F.col("_v").alias("value"))
    found = asked.join(found, _same()).select(id_, "value")
    return read.select(id_).join(found, id_, "left")
