import random
import zlib

import pytest
from llm_data import prose

from stratalake.llm import sharding
from stratalake.llm.sharding import Plan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, g string, rid int, lo int, node int"


def rows_of(n: int, seed: int = 1):
    r = random.Random(seed)
    copies = [prose(900 + i, 30 + 40 * i) for i in range(4)]
    out = []
    for i in range(n):
        text = r.choice(copies) if r.random() < 0.3 else None if r.random() < 0.03 else prose(i, r.randint(0, 200))
        if r.random() < 0.25:
            text = "the one text of a quarter of all rows, é"
        out.append((i, text, r.choice(["en", "de", None]), r.choice(["hot", "hot", "b", "c", None]), 1, 2, "x", "y", 3, 4, 5))
    return out


def by_hand(rows, plan):
    """{shard: {text: rows}} from sorted lists, whole."""
    share = lambda v: zlib.crc32(v.encode()) / 2**32 if v is not None else 0.0
    groups = {}
    for doc, text, lang, source, *_ in rows:
        g = groups.setdefault(text or "", [0, [], len((text or "").encode()) + 16])
        g[0] += 1
        g[1].append((share(source), share(lang), float(len(text or "")), None if doc is None else float(doc)))
    least = {t: [min((v for v in col if v is not None), default=None) for col in zip(*g[1], strict=True)] for t, g in groups.items()}
    for d in range(4):
        known = [x[d] for x in least.values() if x[d] is not None]
        lo, hi = min(known), max(known)
        for x in least.values():
            x[d] = 0.0 if hi <= lo or x[d] is None else (x[d] - lo) / (hi - lo)
    total = sum(g[0] * g[2] for g in groups.values())
    return groups, least, total


def shards_by_hand(rows, plan, hashes):
    groups, least, total = by_hand(rows, plan)
    slack, shards = total // (plan.shards * plan.slack), {}

    def split(pieces, first, k):
        if k == 1 or not pieces:
            shards[first] = {}
            for t, lo, hi in pieces:
                shards[first][t] = shards[first].get(t, 0) + hi - lo
            for other in range(first + 1, first + k):
                shards[other] = {}
            return
        spread = [max(least[t][d] for t, _, _ in pieces) - min(least[t][d] for t, _, _ in pieces) for d in range(4)]
        d = spread.index(max(spread))
        pieces = sorted(pieces, key=lambda p: (least[p[0]][d], float(hashes[p[0]] >> 11), hashes[p[0]], groups[p[0]][2], p[1]))
        goal, before, at = sum((hi - lo) * groups[t][2] for t, lo, hi in pieces) * (k // 2) // k, 0, 0
        while before + (w := (pieces[at][2] - pieces[at][1]) * groups[pieces[at][0]][2]) <= goal:
            before, at = before + w, at + 1
        t, lo, hi = pieces[at]
        size, offset = groups[t][2], goal - before
        cut = lo + ((2 * offset + size) // (2 * size) if hi - lo > 1 and w > slack else hi - lo if 2 * offset > w else 0)
        split(pieces[:at] + [(t, lo, cut)] * (cut > lo), first, k // 2)
        split([(t, cut, hi)] * (hi > cut) + pieces[at + 1 :], first + k // 2, k - k // 2)

    split([(t, 0, g[0]) for t, g in groups.items()], 0, plan.shards)
    return shards


@pytest.mark.parametrize("plan", [Plan(), Plan(shards=7, bins=4, few=3), Plan(shards=1)])
def test_equals_brute_force(spark, plan):
    rows = rows_of(900)
    rows += [(None, "a text of no id", "en", "b", 1, 2, "x", "y", 3, 4, 5), rows[5], rows[5], (5000, "", None, None, 1, 2, "x", "y", 3, 4, 5), (5001, "word " * 20_000, "en", "b", 1, 2, "x", "y", 3, 4, 5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    hashes = {r.t: r.g for r in df.selectExpr("coalesce(text, '') AS t", "xxhash64(coalesce(text, '')) AS g").distinct().collect()}
    got = sharding.assign(df, plan).collect()
    found = {i: {} for i in range(plan.shards)}
    for r in got:
        own = found[r.shard]
        own[r.text or ""] = own.get(r.text or "", 0) + 1
    want = shards_by_hand(rows, plan, hashes)
    assert found == {i: {t: n for t, n in s.items() if n} for i, s in want.items()}
    assert len(got) == len(rows) and sorted(map(repr, ((r.doc_id, r.text, r.lang, r.source) for r in got))) == sorted(map(repr, (x[:4] for x in rows)))
    for i in range(plan.shards):
        assert sorted(r.slot for r in got if r.shard == i) == list(range(sum(found[i].values())))
    assert all(r.size == len((r.text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in got)


def test_shards_are_near_equal_and_groups_stay_whole(spark, folder):
    rows = rows_of(3000, 2)
    got = sharding.query(spark, folder(documents=spark.createDataFrame(rows, SCHEMA))).collect()
    sizes, texts = [0] * 40, {}
    of = {x[0]: x[1] or "" for x in rows}
    for r in got:
        sizes[r.shard] += r.size
        texts.setdefault(of[r.doc_id], set()).add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None
    mean = sum(sizes) / 40
    assert max(sizes) < 1.06 * mean + 1500 and min(sizes) > 0.94 * mean - 1500
    assert sum(len(s) - 1 for s in texts.values()) <= 39 and sum(len(s) > 1 for s in texts.values()) < 10


def test_blocks_number_rows_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 16)
    rows = rows_of(700, 4)
    got = sharding.assign(spark.createDataFrame(rows, SCHEMA).repartition(4), Plan(shards=3), keep=["doc_id"]).collect()
    for i in range(3):
        own = sorted(r.slot for r in got if r.shard == i)
        assert own == list(range(len(own)))
    assert sorted(r.doc_id for r in got) == list(range(700))


def test_defined_cases(spark, folder, tmp_path):
    assert sharding.query(spark, folder(documents=spark.createDataFrame([], SCHEMA))).collect() == []
    one = sharding.query(spark, folder(documents=spark.createDataFrame([(None, None, None, None, None, 2, "x", "y", 3, 4, 5)] * 3, SCHEMA))).collect()
    assert [r.size for r in one] == [16] * 3 and len({(r.shard, r.slot) for r in one}) == 3
    two = sharding.assign(spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, text string"), Plan(shards=2)).collect()
    assert sorted(r.doc_id for r in two) == ["a", "b"] and {r.shard for r in two} == {0, 1}
    sharding.write_shards(spark.createDataFrame(rows_of(80), SCHEMA), f"file://{tmp_path}/out", Plan(shards=4))
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == 80 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_no_python_in_the_plan(spark, folder):
    plan = sharding.query(spark, folder(documents=spark.createDataFrame(rows_of(50), SCHEMA)))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
