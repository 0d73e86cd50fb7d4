import random

import duckdb

from stratalake.llm import quotes


def chats():
    r = random.Random(2)
    rows = []
    for c in range(25):
        for t in range(r.randint(1, 8)):
            own = "\n".join(r.choice(["Hello  there", "yes", "No way", f"line {r.randint(0, 40)}", "", "  x > y"]) for _ in range(r.randint(0, 3)))
            quote = ""
            if rows and r.random() < 0.6:
                source = (r.choice(rows)[3] or "").split("\n")
                quote = "\n".join(r.choice(["> ", ">", "> > ", " >>"]) + x.upper() for x in source[: r.randint(1, 3)]) + "\n"
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice([quote + own, own + "\n" + quote, None if r.random() < 0.1 else own])))
    return rows + [(None, 1, "user", "yes"), (3, None, "user", "> yes\nyes"), rows[5], (50, 5000, "user", "far"), (50, 0, "user", "near"), (50, 1, "user", "> " * 60 + "deep"), (51, 0, "user", "word " * 40_000)]


def test_equals_sql(spark, folder):
    df = spark.createDataFrame([(*x, "k") for x in chats()], "conv_id long, turn long, role string, text string, uid string").repartition(3)
    root = folder(conversations=df)
    got = quotes.query(spark, root)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{root.removeprefix('file://')}/conversations.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({quotes.SQL})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want)) and sum(r[-1] for r in rows) >= 5


def test_links(spark):
    said = [(1, 0, "user", "How are you?\nFine day."), (1, 1, "assistant", "> how  ARE you?\nGood."), (1, 2, "user", "> > How are you?\n> Good.\nGlad."), (1, 3, "assistant", "> never said\nHm."), (2, 0, "user", "> Glad.\nWhy?")]
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")).collect()}
    reply = {k: (r.reply_conv_id, r.reply_turn, r.by_quote) for k, r in got.items()}
    assert reply == {(1, 0): (None, None, False), (1, 1): (1, 0, True), (1, 2): (1, 1, True), (1, 3): (1, 2, False), (2, 0): (1, 2, True)}
    assert got[1, 2].text == "Glad." and got[1, 2].quote_levels == 2 and got[1, 2].quoted_passages == 2


def test_transcripts_and_empty(spark):
    df = spark.createDataFrame([(1, 1, "b", "> a\ntwo"), (1, 0, "a", "one")], "conv_id long, turn long, role string, text string")
    assert quotes.transcripts(quotes.conversations(df)).first().text == "[a]\none\n\n[b]\ntwo"
    assert quotes.conversations(df.limit(0)).count() == 0


def test_native(spark):
    df = spark.createDataFrame([(1, 0, "a", "one")], "conv_id long, turn long, role string, text string")
    plan = quotes.parse(df.withColumn("uid", df.turn))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
