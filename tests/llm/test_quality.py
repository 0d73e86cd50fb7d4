import re
from collections import Counter

from llm_data import prose

from stratalake.llm import quality

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    w = re.findall(WORD, text)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_base_columns(spark, frame, folder):
    given = [(i, prose(i, 30 + i * 3), "en") for i in range(40)] + [(100, None, "en"), (101, "", "en"), (102, " \t\x0b\x0c\r\n", "en"), (103, "a a a a", "en"), (104, "x y\nx y\n \nx y ", "en"), (105, "go " * 5000, "en"), (106, prose(1, 40_000), "en"), (107, "é日本 🙂🙂 | # <b> a b\x1fc", "en"), (108, ("one two three four\n" * 30) + prose(3, 100), "en"), (109, "a b c a b", "en"), (110, "a b c a b c a b", "en"), (5, prose(5, 45), "en"), (None, prose(8, 90), "en")]
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.query(spark, folder(documents=frame(given))).collect()), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t, _ in given), key=repr)


def test_verdicts(spark, frame, folder):
    symbols = lambda i: " ".join(w + "#*%&"[k % 4] * 2 for k, w in enumerate(prose(i, 120).split()))
    given = [(i, prose(i, 150), "en") for i in range(120)] + [(1000 + i, symbols(i), "en") for i in range(12)] + [(2000 + i, prose(i, 40) + " " + "spam eggs ham. " * 30, "en") for i in range(12)]
    got = {r.doc_id: r for r in quality.query(spark, folder(documents=frame(given))).collect()}
    assert all(got[i].kept for i in range(120)) and not any(r.kept for i, r in got.items() if i >= 1000)
    assert all(not r.kept for r in got.values() if r.base_failed) and all(0 <= r.quality <= 1 for r in got.values())


def test_expectation_maximisation_finds_accuracies():
    import random

    r = random.Random(1)
    truth = [(0.95, 0.7), (0.9, 0.5), (0.98, 0.8), (0.85, 0.6), (0.97, 0.4)]
    votes = Counter()
    for _ in range(20_000):
        good = r.random() < 0.85
        votes[tuple(0 if r.random() < 0.2 else ((1 if r.random() < g else -1) if good else (-1 if r.random() < b else 1)) for g, b in truth)] += 1
    _, accuracy, share = quality.posteriors(sorted(votes.items()), 60)
    assert abs(share - 0.85) < 0.05 and all(abs(a[0] - t[0]) < 0.05 for a, t in zip(accuracy, truth, strict=True))
    assert quality.posteriors([])[0] == []


def test_empty_and_native(spark, frame, folder):
    assert quality.query(spark, folder(documents=frame([]))).count() == 0
    plan = quality.measures(frame([(1, "a", "en")]), ["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
