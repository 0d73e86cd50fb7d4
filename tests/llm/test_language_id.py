import math
import random
from collections import Counter

import numpy as np
from llm_data import prose
from pyspark.sql import functions as F

from stratalake.llm import language_id
from stratalake.llm.common import held_out

ODD = ["ü" * 3 + "ber straße", "été où garçon", "el niño año"]


def rows():
    r = random.Random(1)
    out = []
    for i in range(240):
        k = i % 2
        words = [r.choice(["the", "and", "thing", "with"] if k else ["der", "und", "straße", "nicht"]) for _ in range(30)]
        out.append((i, " ".join(words), "en" if k else "de"))
    return out


def test_held_out_accuracy_and_cases(spark, frame, folder):
    given = rows() + [(1000, None, "en"), (1001, "", "de"), (1002, "123 !? \n", "en"), (1003, "the and with " * 60_000, None), (None, "der und", "de"), (1004, "the thing", None), (1004, "the thing", None)]
    got = language_id.query(spark, folder(documents=frame(given))).collect()
    assert len(got) == len(given)
    by = {r.doc_id: r for r in got}
    held = [i for i, _, _ in rows() if by[i].held_out]
    assert len(held) > 30 and all(by[i].lang_pred == ("en" if i % 2 else "de") for i in held)
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "en" and by[None].lang_pred == "de" and all(0 <= r.score <= 1 for r in got)
    want = {r.doc_id: r.h for r in spark.createDataFrame([(i,) for i, _, _ in rows()], "doc_id long").select("doc_id", held_out(F.col("doc_id"), 4).alias("h")).collect()}
    assert all(by[i].held_out == h for i, h in want.items())


def test_empty_and_unlabelled(spark, frame, folder):
    assert language_id.query(spark, folder(documents=frame([]))).count() == 0
    assert [r.lang_pred for r in language_id.query(spark, folder(documents=frame([(1, "the", None)]))).collect()] == ["und"]


def by_hand(text):
    """The n-grams of a text, straight from their definition."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    plain = f" {' '.join(letters.split(' '))} "
    while "  " in plain:
        plain = plain.replace("  ", " ")
    return [plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1) if plain[i : i + n].strip()]


TEXTS = ["a1b  " + prose(3, 300) + " éß\U0001d400x", "", "7", "the", " und  so ", "x" * 900 + "--" + "é y" * 40]


def test_grams_of_many_texts_in_pieces(monkeypatch):
    number = {}  # of each n-gram, by its bucket
    for size in (language_id.PIECE, 7, 64, 501):
        monkeypatch.setattr(language_id, "PIECE", size)
        got = [Counter() for _ in TEXTS]
        for buckets, rows in language_id.grams(TEXTS, 1 << 30):
            if buckets is None:
                assert rows.tolist() == [any(c.isalpha() for c in t) for t in TEXTS]
                continue
            for x, row in zip(buckets.tolist(), rows.tolist(), strict=True):
                got[row][x] += 1
        for t, seen in zip(TEXTS, got, strict=True):
            want = Counter(by_hand(t))
            assert sorted(seen.values()) == sorted(want.values())
            one = {g: language_id_bucket(g) for g in want}
            assert {one[g]: n for g, n in want.items()} == dict(seen)
            number |= one
    assert len(set(number.values())) == len(number)


def language_id_bucket(gram):
    key = 0
    for c in gram:
        key = (key * 0x100000001B3 + ord(c) + 1) % 2**64
    return int(language_id.mix64(np.array([(key + (len(gram) << 56)) % 2**64], np.uint64))[0] & np.uint64((1 << 30) - 1))


def test_equals_brute_force_naive_bayes(spark, frame):
    given = [(i, t, lang) for i, t, lang in rows()]
    model = language_id.fit(frame(given), 10**6, 1 << 12)
    counts = {lang: Counter() for lang in ("de", "en")}
    for _, t, lang in given:
        counts[lang].update(language_id_bucket(g) % (1 << 12) for g in by_hand(t))
    logs = {lang: {b: math.log((counts[lang][b] + 0.5) / (sum(counts[lang].values()) + 0.5 * (1 << 12))) for b in range(1 << 12)} for lang in counts}
    asked = [(k, t, None) for k, t in enumerate(["the thing und", "nicht straße", "with the and x", "zzz", "é"])]
    for r in language_id.predict(frame(asked), model, ["doc_id"]).collect():
        total = {lang: sum(logs[lang][language_id_bucket(g) % (1 << 12)] for g in by_hand(asked[r.doc_id][1])) for lang in logs}
        best = max(sorted(total), key=total.get)
        assert r.lang_pred == best and abs(r.score - 1 / sum(math.exp(x - total[best]) for x in total.values())) < 1e-9
        assert abs(r.fit - (total[best] / len(by_hand(asked[r.doc_id][1])) + math.log(1 << 12))) < 1e-9


def test_many_languages_in_blocks(spark, frame, monkeypatch):
    word = lambda k: chr(97 + k // 26) * 3 + chr(97 + k % 26) * 4
    docs = frame([(k, f"{word(k)} {word(k)}", f"l{k:03}") for k in range(300)])
    model = language_id.fit(docs, 5, 1 << 12)
    assert len(model["langs"]) == 300 and model["logp"].shape == (1 << 12, 300)
    whole = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language_id.predict(docs, model, ["doc_id"]).collect()}
    assert all(whole[k][0] == f"l{k:03}" for k in range(300))
    monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", 70)
    assert {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language_id.predict(docs, model, ["doc_id"]).collect()} == whole


def test_sample_at_any_size(spark, frame):
    docs = spark.range(20_000).selectExpr("id as doc_id", "if(id < 100, 'rare', 'often') as lang")
    got = dict(language_id.sample_of(docs, [("rare", 100), ("often", 19_900)], 1_000).groupBy("lang").count().collect())
    assert got["rare"] == 100 and 850 < got["often"] < 1_150
    # As if counted over 5e10 rows: what is asked for is a share of all hashes, which never rounds to none.
    many = language_id.sample_of(docs, [("often", 5 * 10**10)], 5 * 10**10 * 30 // 20_000)
    assert 10 < many.where("lang = 'often'").count() < 60 and "-9223372036854775808" not in language_id.sample_of(docs, [("often", 5 * 10**10)], 5_000)._jdf.queryExecution().toString()


def test_stage_keeps_columns(spark, frame):
    docs = frame(rows() + [(900, "12 34", "en"), (901, "the and", None), (902, "日本語の文章です", None)])
    out = language_id.stage(spark, docs, "")
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert 900 not in got and 902 not in got and got[901].lang == "en" and len(got) == 241 and got[5].component == "y" and got[5].score == 0.5


def test_scores_do_not_depend_on_how_many_values_are_taken_at_once(monkeypatch):
    rng = np.random.default_rng(1)
    logp = np.log(rng.random((language_id.N_BUCKETS, 7)))
    texts = ["", "a", "one two three " * 300, "x", "4711", "many words of one text"] * 3
    want = language_id.totals_of(texts, logp)
    for taken in (7, 70, 3000):
        monkeypatch.setattr(language_id, "TAKEN", taken)
        got = language_id.totals_of(texts, logp)
        assert np.allclose(got[0], want[0]) and (got[1] == want[1]).all() and (got[2] == want[2]).all()
