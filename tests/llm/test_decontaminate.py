import random

from llm_data import prose

from stratalake.llm import decontaminate as D


def least(pattern, text):
    """Least edits between the pattern and any substring of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_matcher_equals_brute_force():
    r = random.Random(3)
    hits = 0
    for n in range(250):
        letters = "ab c" if n % 2 else "abcdefghijklmnop qrst"
        items = [(i, D.normalised("".join(r.choice(letters) for _ in range(r.randint(30, 120))))) for i in range(3)]
        text = list("".join(r.choice(letters) for _ in range(100)) + r.choice(items)[1] + "".join(r.choice(letters) for _ in range(60)))
        for _ in range(r.randint(0, 14)):
            p, k = r.randrange(len(text)), r.random()
            if k < 0.33:
                text[p] = r.choice(letters)
            elif k < 0.66:
                del text[p]
            else:
                text.insert(p, r.choice(letters))
        text = "".join(text)
        want = [(i, d) for i, (_, x) in enumerate(items) if (d := least(x, D.normalised(text))) <= len(x) // 10]
        hits += len(want)
        assert [(a, b) for a, b, _ in D.Matcher(items, 10).find(text)] == want
    assert hits > 150


def tables(spark, frame):
    items = [(i, prose(50 + i, 30)) for i in range(8)] + [(20, prose(50, 30)), (21, None), (22, ""), (23, "the of and")]
    edited = prose(51, 30).replace("the ", "hte ", 1)
    docs = [(1, prose(1, 20) + " " + prose(50, 30).upper() + "\n" + prose(2, 20), "en"), (2, edited, "en"), (3, prose(3, 300), "en"), (4, None, "en"), (5, "", "en"), (6, "so: The  of and.", "en"), (11, "bathe of and", "en"), (7, prose(52, 15), "en"), (8, prose(9, 30_000) + " " + prose(57, 30).replace(" ", "\n\t"), "en"), (8, prose(57, 30), "en"), (None, prose(53, 30), "en")]
    benchmark = spark.createDataFrame([(i, t, "k") for i, t in items], "item_id long, text string, doc_id string")
    return frame(docs), benchmark, {(1, 0), (1, 20), (2, 1), (6, 23), (8, 7), (None, 3)}


def test_query_and_blocks(spark, frame, folder, monkeypatch):
    docs, benchmark, want = tables(spark, frame)
    sf = folder(documents=docs, benchmark=benchmark)
    for chars in (4_000_000, 300):
        monkeypatch.setattr(D, "BLOCK_CHARS", chars)
        D.item_blocks.__defaults__ = (chars,)
        got = D.query(spark, sf).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == 7
        assert all(r.distance <= r.budget for r in got) and {r.distance for r in got if r.doc_id == 1} == {0}


def test_stage(spark, frame, folder):
    docs, benchmark, _ = tables(spark, frame)
    out = D.stage(spark, docs, folder(benchmark=benchmark))
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [3, 4, 5, 7, 11]


def test_short_items_are_found_whole_and_unchanged():
    items = [(1, "the cat"), (2, "42"), (3, "naïve?"), (4, "x" * 39)]
    held = lambda text: [items[n][0] for n, *_ in D.Matcher(items).find(text)]
    assert held("The  CAT sat; 42") == [1, 2] and held("see the cat's 142, 42a") == [1]
    assert held("the cats bathe cat the-cat 4 2") == [] and held("so naïve?so") == [3] and held("x" * 39) == [4] and held("x" * 40) == held("x" * 38) == []


def test_item_ids_of_any_type(spark, frame):
    items = spark.createDataFrame([(1.5, prose(50, 30))], "item_id double, text string")
    assert [r.item_id for r in D.find(frame([(1, prose(50, 30), "en")]), items).collect()] == [1.5]


def test_empty(spark, frame, folder):
    docs, benchmark, _ = tables(spark, frame)
    assert D.query(spark, folder(documents=frame([]), benchmark=benchmark)).count() == 0
    assert D.query(spark, folder(documents=docs, benchmark=benchmark.limit(0))).count() == 0
    assert D.clean(docs, benchmark.limit(0)).count() == docs.count()
