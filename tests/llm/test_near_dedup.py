import itertools
import random
import re

import numpy as np
import pytest
from llm_data import WORDS, prose

from stratalake.llm import near_dedup
from stratalake.llm.common import components


def sets_of(text, width):
    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width, percent):
    sets = [sets_of(t, width) for _, t, _ in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= percent * len(sets[i] | sets[j]):
            up[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(rows[i][0])
    return [None if rows[i][0] is None else min(x for x in groups[top(i)] if x is not None) for i in range(len(rows))], [len(s) for s in sets]


def corpus():
    r = random.Random(7)
    rows = [(i, prose(i, r.choice([1, 2, 5, 60, 200])), "en") for i in range(40)]
    for g in range(6):
        base = prose(100 + g, 120).split()
        for k in range(14):
            words = list(base)
            for _ in range(k // 2):
                words[r.randrange(len(words))] = r.choice(WORDS)
            rows.append((1000 + g * 100 + k, " ".join(words) if k % 3 else " ".join(words).upper() + "\n", "en"))
    rows += [(2000, None, "en"), (2001, "", "en"), (2002, " \t", "en"), (2003, "A  b", "en"), (2004, "a B", "en"), (None, prose(1, 60), "en"), (1000, rows[40][1], "en"), (2005, prose(5, 30_000), "en"), (2006, prose(5, 30_000) + " x", "en"), (3, "other text under the same id", "en")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [256, 2])
def test_equals_brute_force(spark, frame, folder, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = corpus()
    want, sizes = brute(rows, 3, 85)
    got = near_dedup.query(spark, folder(documents=frame(rows))).collect()
    expected = sorted(((i, n, c, i is None or i == c) for (i, _, _), n, c in zip(rows, sizes, want, strict=True)), key=repr)
    assert sorted(map(tuple, got), key=repr) == expected


def test_empty(spark, frame, folder):
    assert near_dedup.query(spark, folder(documents=frame([]))).count() == 0


def test_stage(spark, frame):
    rows = corpus()
    docs = frame(rows)
    want, _ = brute(rows, 5, 80)
    out = near_dedup.stage(spark, docs, "")
    assert out.columns == docs.columns
    kept = sorted((r.doc_id, r.text) for r in out.collect() if r.doc_id is not None)
    assert {k[0] for k in kept} == {i for (i, _, _), c in zip(rows, want, strict=True) if i is not None and i == c}
    assert len([k for k in kept if k[0] == 1000]) <= 1 and sum(r.doc_id is None for r in out.collect()) == 1


def test_components(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60) if i % 13] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(500, 500), (None, 3), (3, None)] + [(900, 901 + k) for k in range(50)]
    got = {x.id: x.component for x in components(spark.createDataFrame(pairs, "a long, b long"), "t").collect()}
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    assert got == {k: top(k) for k in up}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_pruning_bounds():
    for plan in (near_dedup.CONTRACT, near_dedup.DEFAULT):
        least = near_dedup.least_matches(plan)
        r = np.random.default_rng(1)
        a = r.integers(0, 2**32, (20_000, plan.hashes), dtype=np.uint32)
        b = np.where(r.random(a.shape) < plan.percent / 100, a, a ^ np.uint32(1))
        assert len(near_dedup.alike(a, b, least, plan.step)) >= 19_995
        assert len(near_dedup.alike(a, np.where(r.random(a.shape) < 0.3, a, a ^ np.uint32(1)), least, plan.step)) < 20
        assert (1 - (plan.percent / 100) ** plan.rows) ** plan.bands < 1e-4


def test_text_ids(spark):
    rows = [(None if i is None else f"d{i:09d}", t, lang) for i, t, lang in corpus()]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    got = sorted((r.doc_id or "", r.component or "") for r in near_dedup.classes(docs, near_dedup.CONTRACT).collect())
    assert got == sorted((r[0] or "", c or "") for r, c in zip(rows, brute(rows, 3, 85)[0], strict=True))
    kept = near_dedup.stage(spark, docs, "").collect()
    assert {r.doc_id for r in kept} == {c for c in brute(rows, 5, 80)[0]}


def test_long_ids_are_not_broadcast_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BROADCAST_BYTES", 1000)
    docs = spark.createDataFrame([("x" * 400 + str(i),) for i in range(9)], "doc_id string")
    out = near_dedup.with_ids(docs, "doc_id", docs.limit(4).withColumnRenamed("doc_id", "id"), "left_semi")
    assert "ResolvedHint (strategy=broadcast)" not in out._jdf.queryExecution().analyzed().toString() and out.count() == 4
