"""Quotation linking: chat messages without their quotes, each with the message that it answers. DataFrame operations only.

Lines that begin with quote marks (`>`, with blanks before and between them) are parsed into levels; a run of lines of one level is a passage. A
quoted passage is normalised (lower-cased, white space as single spaces) and hashed, whole and by line, and the hashes are joined to those of
the messages' own passages and lines. The message answered is the one that the first linked passage of level 1 comes from: an earlier
turn of the same conversation if there is one, else a message of another conversation; of several the least (conversation, turn); a match of the whole
passage goes before one of a line. A message without such a link answers the turn before it.

Sizes: the index of originals has a row per hash, aggregated before it is shuffled, so a line that half of all messages hold is one row. Places
in a conversation are counted by ranges of TURNS turns, so a conversation with a third of all rows is spread as well.

Defined cases: a null text is empty; a null turn comes last in its conversation and null conversations are one; a null role is kept; repeated rows each get
a place, in no particular order among themselves; a quote that is found nowhere leaves no link; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalake.llm.common import SPACES, table, written

TURNS = 1024
MARKS = r"^([ \t]*>)+"
LAST_TURN = (1 << 62) - 1


def normalised(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, r"[\x09-\x0D\x20]+", " ")))


def hashed(text: Column) -> Column:
    return F.sha2(text, 256)


def parse(messages: DataFrame) -> DataFrame:
    """Adds passages (array of level, text, lines) to messages; text becomes the message's own text."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r", ""), "\n"), lambda x: F.struct(F.length(F.translate(F.regexp_extract(x, MARKS, 0), " \t", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("text")))
    n = F.size("_lines")
    level = lambda i: F.get(F.col("_lines"), i)["level"]
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))
    of = lambda b, k: F.slice("_lines", b + 1, F.coalesce(F.get("_begins", k + 1), n) - b)
    passages = F.transform("_begins", lambda b, k: F.struct(level(b).alias("level"), F.array_join(F.transform(of(b, k), lambda x: x["text"]), "\n").alias("text"), F.transform(of(b, k), lambda x: x["text"]).alias("lines")))
    own = F.btrim(F.array_join(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["text"]), "\n"), F.lit(SPACES))
    return messages.select("*", lines.alias("_lines")).select("*", begins.alias("_begins")).withColumn("passages", passages).withColumn("text", own).drop("_lines", "_begins")


def originals(parsed: DataFrame) -> DataFrame:
    """(hash, conv_id, turn): what messages say themselves: their whole own text, their passages and lines of level 0."""
    said = F.flatten(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: F.concat(F.array(p["text"]), p["lines"])))
    pieces = F.array_distinct(F.transform(F.concat(F.array("text"), said), normalised))
    return parsed.select("conv_id", "turn", F.explode(F.filter(pieces, lambda x: x != "")).alias("piece")).select(hashed(F.col("piece")).alias("hash"), "conv_id", "turn")


def quotations(parsed: DataFrame) -> DataFrame:
    """(uid, conv_id, turn, passage, level, kind, hash) of the quoted passages: kind 0 is the whole passage, 1 a line of it."""
    each = parsed.select("uid", "conv_id", "turn", F.posexplode("passages").alias("passage", "p")).where("p.level > 0")
    keys = F.concat(F.array(F.struct(F.lit(0).alias("kind"), normalised(F.col("p.text")).alias("piece"))), F.transform("p.lines", lambda x: F.struct(F.lit(1).alias("kind"), normalised(x).alias("piece"))))
    keyed = each.select("uid", "conv_id", "turn", "passage", F.col("p.level").alias("level"), F.explode(keys).alias("k")).where("k.piece <> ''")
    return keyed.select("uid", "conv_id", "turn", "passage", "level", F.col("k.kind").alias("kind"), hashed(F.col("k.piece")).alias("hash")).distinct()


def links(parsed: DataFrame) -> DataFrame:
    """(uid, passage, level, reply_conv_id, reply_turn): the original of each quoted passage that has one. parsed must be written: it is
    read several times."""
    quoted = quotations(parsed)
    # Only hashes that are quoted need an index.
    said = originals(parsed).join(quoted.select("hash").distinct(), "hash", "left_semi").where("conv_id is not null and turn is not null")
    near = said.groupBy("hash", "conv_id").agg(F.min("turn").alias("near_turn"))
    source = F.struct("conv_id", F.col("near_turn").alias("turn"))
    # Of any two conversations one at least is not the quoting one.
    far = near.groupBy("hash").agg(F.min(source).alias("least"), F.max(source).alias("last"))
    met = quoted.join(near, ["hash", "conv_id"], "left").join(far, "hash", "left")
    other = F.when(~F.col("least.conv_id").eqNullSafe(F.col("conv_id")), F.col("least")).when(~F.col("last.conv_id").eqNullSafe(F.col("conv_id")), F.col("last"))
    here = F.when(F.col("near_turn") < F.col("turn"), F.struct("conv_id", F.col("near_turn").alias("turn")))
    met = met.withColumn("source", F.coalesce(here, other)).where("source is not null").withColumn("away", F.when(here.isNotNull(), F.lit(0)).otherwise(F.lit(1)))
    best = met.groupBy("uid", "passage", "level").agg(F.min(F.struct("kind", "away", "source")).alias("best"))
    return best.select("uid", "passage", "level", F.col("best.source.conv_id").alias("reply_conv_id"), F.col("best.source.turn").alias("reply_turn"))


def conversations(messages: DataFrame) -> DataFrame:
    """A row for each message: conv_id, turn, position (its place in the conversation, from 0), role, text (without quotes), quote_levels, quoted_passages,
    reply_conv_id and reply_turn (the message answered), by_quote (whether a quotation says so)."""
    rows = messages.select("conv_id", "turn", "role", "text").withColumn("uid", F.monotonically_increasing_id())
    parsed = written(parse(rows), "parsed")
    linked = links(parsed).where("level = 1").groupBy("uid").agg(F.min(F.struct("passage", "reply_conv_id", "reply_turn")).alias("first")).select("uid", F.col("first.reply_conv_id").alias("q_conv"), F.col("first.reply_turn").alias("q_turn"))
    turn = F.coalesce("turn", F.lit(LAST_TURN))
    ranged = parsed.withColumn("range", F.floor(turn / TURNS).cast("long"))
    of_range = Window.partitionBy("conv_id").orderBy("range")
    ranges = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"), F.max("turn").alias("last"))
    ranges = ranges.select("conv_id", "range", F.coalesce(F.sum("n").over(of_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lag("last").over(of_range).alias("last_before"))
    inside = Window.partitionBy("conv_id", "range").orderBy(turn, "role", "text", "uid")
    levels = F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0))
    placed = ranged.select("uid", "conv_id", "range", "turn", "role", "text", levels.alias("quote_levels"), F.size(F.filter("passages", lambda p: p["level"] > 0)).alias("quoted_passages"), (F.row_number().over(inside) - 1).alias("rank"), F.lag("turn").over(inside).alias("prior"))
    out = placed.alias("m").join(ranges.alias("g"), F.col("m.conv_id").eqNullSafe(F.col("g.conv_id")) & (F.col("m.range") == F.col("g.range"))).join(linked, "uid", "left")
    prior = F.when(F.col("rank") > 0, F.col("prior")).otherwise(F.col("last_before"))
    quoted = F.col("q_turn").isNotNull()
    return out.select(
        F.col("m.conv_id").alias("conv_id"), "turn", (F.col("rank") + F.col("before")).cast("long").alias("position"), "role", "text", F.col("quote_levels").cast("int").alias("quote_levels"), F.col("quoted_passages").cast("int").alias("quoted_passages"),
        F.when(quoted, F.col("q_conv")).when(prior.isNotNull(), F.col("m.conv_id")).alias("reply_conv_id"), F.when(quoted, F.col("q_turn")).otherwise(prior).alias("reply_turn"), quoted.alias("by_quote"),
    )


def transcripts(placed: DataFrame) -> DataFrame:
    """(conv_id, part, text): the conversations as text, TURNS messages a part, each message under its role."""
    said = F.concat(F.lit("["), F.coalesce("role", F.lit("")), F.lit("]\n"), F.col("text"))
    parts = placed.withColumn("part", F.floor(F.col("position") / TURNS).cast("long")).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("position", said.alias("said")))).alias("all"))
    return parts.select("conv_id", "part", F.array_join(F.transform("all", lambda x: x["said"]), "\n\n").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH rows AS (SELECT row_number() OVER () AS uid, conv_id, turn, role, replace(coalesce(text, ''), chr(13), '') AS raw FROM conversations),
cut AS (SELECT uid, conv_id, turn, role, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) AS no FROM rows),
lines AS (SELECT uid, conv_id, turn, role, no, length(regexp_replace(regexp_extract(line, '^([ \t]*>)+'), '[ \t]', '', 'g')) AS level, regexp_replace(line, '^([ \t]*>)+', '') AS body FROM cut),
steps AS (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY uid ORDER BY no) IS DISTINCT FROM level THEN 1 ELSE 0 END AS step FROM lines),
runs AS (SELECT *, sum(step) OVER (PARTITION BY uid ORDER BY no) - 1 AS passage FROM steps),
passages AS (SELECT uid, conv_id, turn, passage, level, string_agg(body, chr(10) ORDER BY no) AS body FROM runs GROUP BY uid, conv_id, turn, passage, level),
own AS (SELECT r.uid, r.conv_id, r.turn, r.role, trim(coalesce(string_agg(p.body, chr(10) ORDER BY p.passage) FILTER (WHERE p.level = 0), ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text,
 max(p.level) AS quote_levels, count(*) FILTER (WHERE p.level > 0) AS quoted_passages
 FROM rows r JOIN passages p ON r.uid = p.uid GROUP BY r.uid, r.conv_id, r.turn, r.role),
pieces AS (SELECT conv_id, turn, text AS piece FROM own UNION ALL SELECT conv_id, turn, body FROM passages WHERE level = 0 UNION ALL SELECT conv_id, turn, body FROM runs WHERE level = 0),
said AS (SELECT DISTINCT conv_id, turn, lower(trim(regexp_replace(piece, '[\x09-\x0D\x20]+', ' ', 'g'))) AS piece FROM pieces WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
quoted AS (SELECT DISTINCT uid, conv_id, turn, passage, level, kind, lower(trim(regexp_replace(body, '[\x09-\x0D\x20]+', ' ', 'g'))) AS piece FROM
 (SELECT uid, conv_id, turn, passage, level, 0 AS kind, body FROM passages WHERE level > 0 UNION ALL SELECT uid, conv_id, turn, passage, level, 1 AS kind, body FROM runs WHERE level > 0)),
first_said AS (SELECT piece, conv_id, min(turn) AS t FROM said WHERE piece <> '' GROUP BY piece, conv_id),
met AS (SELECT q.uid, q.passage, q.level, q.kind, CASE WHEN s.conv_id = q.conv_id THEN 0 ELSE 1 END AS away, s.conv_id AS rc, s.t AS rt
 FROM quoted q JOIN first_said s ON q.piece = s.piece WHERE s.conv_id IS DISTINCT FROM q.conv_id OR s.t < q.turn),
best AS (SELECT uid, rc, rt FROM met WHERE level = 1 QUALIFY row_number() OVER (PARTITION BY uid ORDER BY passage, kind, away, rc, rt) = 1),
placed AS (SELECT uid, conv_id, turn, role, text, quote_levels, quoted_passages, row_number() OVER w - 1 AS position, lag(turn) OVER w AS prior FROM own
 WINDOW w AS (PARTITION BY conv_id ORDER BY coalesce(turn, 4611686018427387903), role NULLS FIRST, text, uid))
SELECT p.conv_id, p.turn, CAST(p.position AS BIGINT) AS position, p.role, p.text, CAST(p.quote_levels AS INTEGER) AS quote_levels, CAST(p.quoted_passages AS INTEGER) AS quoted_passages,
 CASE WHEN b.rt IS NOT NULL THEN b.rc WHEN p.prior IS NOT NULL THEN p.conv_id END AS reply_conv_id, coalesce(b.rt, p.prior) AS reply_turn, b.rt IS NOT NULL AS by_quote
FROM placed p LEFT JOIN best b ON p.uid = b.uid
"""
