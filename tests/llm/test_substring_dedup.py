import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from llm_data import prose

from stratalake.llm import substring_dedup as S


def words(t):
    return (t or "").encode().lower().split()


def repeated(rows, n=50):
    """Documents that hold n words of a lesser document, by brute force."""
    seen = defaultdict(set)
    for i, t, _ in rows:
        if i is not None:
            w = words(t)
            for k in range(len(w) - n + 1):
                seen[tuple(w[k : k + n])].add(i)
    return {i for ids in seen.values() for i in ids if i != min(ids)}


def corpus():
    shared = [prose(500 + k, 60) for k in range(5)]
    rows = [(i, prose(i, 40 + i * 7), "en") for i in range(30)]
    rows += [(100 + i, prose(200 + i, 30) + " " + shared[i % 5].upper() + "\n" + prose(300 + i, 25), "en") for i in range(30)]
    rows += [(200, shared[0] + " tail", "en"), (201, "go " * 300, "en"), (202, "go " * 90, "en"), (203, None, "en"), (204, "", "en"), (None, shared[1], "en"), (205, prose(77, 20_000) + " " + shared[2], "en"), (101, rows[31][1], "en")]
    # A passage whose least holder isn't in the group of the key's least document: a and b share one side, b and c the other.
    left, mid, right = prose(601, 40), prose(602, 20), prose(603, 40)
    rows += [(300, left + " " + mid, "en"), (301, left + " " + mid + " " + right, "en"), (302, mid + " " + right, "en")]
    random.Random(3).shuffle(rows)
    return rows


def test_finds_every_exact_repeat(spark, frame, folder):
    rows = corpus()
    got = S.query(spark, folder(documents=frame(rows))).collect()
    text = {i: words(t) for i, t, _ in rows}
    assert {r.doc_id for r in got} == repeated(rows)
    for r in got:
        assert r.doc_id > r.match_doc_id and r.stop_word - r.start_word >= 50 and r.similarity >= 0.8
        if r.similarity == 1.0 and r.doc_id not in (201, 202):
            assert text[r.doc_id][r.start_word : r.stop_word] == text[r.match_doc_id][r.match_start_word : r.match_stop_word]


def test_cut_leaves_no_repeat_and_other_text(spark, frame):
    rows = corpus()
    docs = frame(rows)
    out = S.stage(spark, docs, "")
    assert out.columns == docs.columns
    left = [(r.doc_id, r.text, None) for r in out.collect()]
    assert not repeated(left)
    by = {i: t for i, t, _ in left}
    clean = {i for i, _, _ in rows} - repeated(rows) - {None}
    assert all(by[i] == t for i, t, _ in rows if i in clean)
    assert words(by[107]) == words(prose(207, 30)) + words(prose(307, 25))
    assert {r.doc_id: r.n_chars for r in out.collect()}[107] == len(by[107])


def test_near_passages(spark, frame, folder):
    rows = []
    for k in range(40):
        passage = prose(700 + k, 120).split()
        other = list(passage)
        other[60] = "edited"
        rows += [(2 * k, prose(k, 30) + " " + " ".join(passage), "en"), (2 * k + 1, " ".join(other) + " " + prose(5000 + k, 30), "en")]
    found = {(r.doc_id, r.match_doc_id) for r in S.query(spark, folder(documents=frame(rows))).collect()}
    assert found == {(2 * k + 1, 2 * k) for k in range(40)}


def test_empty(spark, frame, folder):
    assert S.query(spark, folder(documents=frame([]))).count() == 0


def test_compact_windows_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(150):
        m, t, ties = int(rng.integers(0, 120)), int(rng.integers(2, 20)), rng.random() < 0.5
        h = (rng.integers(1, 6 if ties else 10**9, m).astype(np.uint64)) << np.uint64(30)
        want = set()
        for c in range(m):
            lo, hi = c, c
            while lo > 0 and h[lo - 1] >= h[c]:
                lo -= 1
            while hi < m - 1 and h[hi + 1] >= h[c]:
                hi += 1
            if hi - lo + 1 >= t:
                want.add((lo, hi, int(h[c])))
        first, _, left, right = S.compact_windows(h, np.array([0, m]), t)
        assert {(int(a), int(b), int(h[x])) for x, a, b in zip(first, left, right, strict=True)} == want


def test_texts_laid_end_to_end():
    rng = np.random.default_rng(2)
    lens = rng.integers(0, 200, 12)
    off = np.concatenate([[0], np.cumsum(lens)])
    v = rng.integers(1, 2**62, int(off[-1])).astype(np.uint64)
    many = sorted(zip(*[x.tolist() for x in S.windows_of(v, off)], strict=True))
    each = []
    for a, b in zip(off, off[1:], strict=False):
        key, *places = S.windows_of(v[a:b], np.array([0, b - a]))
        each += zip(key.tolist(), *[(x + a).tolist() for x in places], strict=True)
    assert many == sorted(each) and many


def test_blocks_lose_nothing(spark, frame, folder, monkeypatch):
    rows = corpus()
    sf = folder(documents=frame(rows))
    monkeypatch.setattr(S, "BLOCK", 2)
    monkeypatch.setattr(S, "PAIRS", 300)
    monkeypatch.setattr(S, "CELLS", 50)
    assert {r.doc_id for r in S.query(spark, sf).collect()} == repeated(rows)


def shingled(k, n, inserted=0):
    values = list(range(1000 * k, 1000 * k + n))
    # A word inserted mid-way replaces WIDTH - 1 shingles by as many, and one more for each word.
    half = n // 2
    return np.array(values if not inserted else values[:half] + [10**6 + i for i in range(inserted + 4)] + values[half + 4 :], np.uint32)


def test_insertions_on_either_side_near_the_threshold():
    for n, inserted in ((60, 5), (76, 8)):
        plain, longer = shingled(1, n), shingled(1, n, inserted)
        similarity = (n - 4) / (n + inserted + 4)
        assert similarity >= 0.8
        for a, b in ((plain, longer), (longer, plain)):
            ((i, j, lo, hi, s),) = S.passages(a, b)
            assert (i, j, lo, hi) == (0, len(a) - 1, 0, len(b) - 1) and abs(s - similarity) < 1e-9
        assert not S.passages(longer[:40], plain) and not S.passages(shingled(1, n, 20), plain)


def test_exact_passages_of_repetitive_texts_equal_brute_force():
    rng = np.random.default_rng(13)
    held = 0
    for _ in range(400):
        line = rng.integers(0, 2**32, int(rng.integers(1, 9))).astype(np.uint32)
        make = lambda: np.concatenate([rng.integers(0, 2**32, int(rng.integers(0, 20))).astype(np.uint32), np.resize(np.roll(line, int(rng.integers(0, 9))), int(rng.integers(20, 160))), rng.integers(0, 2**32, int(rng.integers(0, 20))).astype(np.uint32)])  # noqa: B023, E731
        a, b = make(), make()
        there = {b[k : k + S.LEAST].tobytes() for k in range(len(b) - S.LEAST + 1)}
        want = {p for k in range(len(a) - S.LEAST + 1) if a[k : k + S.LEAST].tobytes() in there for p in range(k, k + S.LEAST)}
        got = S.passages(a, b)
        held += bool(want)
        assert want <= {p for i, j, *_ in got for p in range(i, j + 1)}
        for i, j, lo, hi, s in got:
            p, q = set(a[i : j + 1].tolist()), set(b[lo : hi + 1].tolist())
            assert len(p & q) >= 0.8 * len(p | q) and (s < 1.0 or p == q)
    assert held > 100


def test_a_passage_inside_a_dense_stretch_is_found():
    # 60 shingles with one replaced word, then stretches of matches too thin for the similarity though the whole is dense enough.
    plain = shingled(2, 130)
    other = plain.copy()
    for k in (28, 62, 74, 86, 98, 110):
        other[k : k + 5] = np.arange(5) + 10**6 + 10 * k
    got = S.passages(other, plain)
    assert got and max(j - i + 1 for i, j, *_ in got) >= 60
    for i, j, lo, hi, s in got:
        p, q = set(other[i : j + 1].tolist()), set(plain[lo : hi + 1].tolist())
        assert s == len(p & q) / len(p | q) >= 0.8


def test_near_passages_that_the_least_document_of_a_key_lacks(spark, frame, folder):
    # 42 of 62 words stand in a lesser document too, too few for a passage, so most keys of the two near copies have it as their least document.
    rows, values = [], {}
    for k in range(60):
        line = prose(9000 + k, 42)
        near = (prose(9100 + k, 10) + " " + line + " " + prose(9200 + k, 10)).split()
        other = list(near)
        if k % 3 == 0:
            other[30] = "edited"
        elif k % 3 == 1:
            other.insert(31, "inserted")
        else:
            del other[31]
        texts = [prose(9300 + k, 60) + " " + line + " " + prose(9400 + k, 60), " ".join(near) + " " + prose(9500 + k, 40), prose(9600 + k, 40) + " " + " ".join(other)]
        rows += [(10 * k + i, t, "en") for i, t in enumerate(texts)]
    for i, t, _ in rows:
        ((_, v, _),) = S._slices([pa.RecordBatch.from_pydict({"doc_id": [i], "text": [t]})])
        values[i] = v
    keys = {i: joint_keys(v) for i, v in values.items()}
    small = {i: v.astype(np.uint32) for i, v in values.items()}
    want = {(a, b) for k in range(60) for a, b in ((10 * k + 2, 10 * k + 1),) if keys[a] & keys[b] and S.passages(small[a], small[b])}
    assert len(want) >= 55
    found = {(r.doc_id, r.match_doc_id) for r in S.query(spark, folder(documents=frame(rows))).collect()}
    assert want <= found and all(S.passages(small[a], small[b]) for a, b in found)


def joint_keys(values):
    """The keys of two functions of one text."""
    key, left, right, c, d = S.windows_of(values, np.array([0, len(values)]))
    n = len(key)
    batch = pa.RecordBatch.from_pydict({"id": np.ones(n, np.int64), "key": key.view(np.int64), "place": S._pack(left, right), "centre": S._pack(c, d), "open": np.ones(n, bool)})
    return {x for b in S._joint([batch]) for x in b.column("key").to_pylist()}


def test_agreed_equals_brute_force():
    rng = np.random.default_rng(11)
    for _ in range(200):
        n, t = int(rng.integers(0, 14)), int(rng.integers(1, 6))
        group, function, left = np.sort(rng.integers(0, 3, n)), rng.integers(0, 4, n), rng.integers(0, 20, n)
        right = left + t - 1 + rng.integers(0, 10, n)
        want = {(g, p) for g in range(3) for p in range(40) if len({f for x, f, lo, hi in zip(group, function, left, right, strict=True) if x == g and lo <= p and p + t - 1 <= hi}) >= 2}
        got = {(g, p) for g, lo, hi in zip(*S.agreed(group, function, left, right, 2, t), strict=True) for p in range(lo, hi - t + 2)}
        assert got == want


def test_groups_of_near_copies_keep_their_links(spark, frame, folder):
    # Three near copies of one passage at the least length and similarity, the least with another neighbour: all but the least have a link.
    rows = []
    for k in range(100):
        passage = prose(20_000 + k, 70).split()
        for i in range(3):
            own = list(passage)
            own[25 + 2 * i] = f"edited{k}x{i}"
            rows.append((10 * k + i, prose(30_000 + 10 * k + i, 25) + " " + " ".join(own) + " " + prose(40_000 + 10 * k + i, 30), "en"))
    found = {r.doc_id for r in S.query(spark, folder(documents=frame(rows))).collect()}
    want = set()
    for k in range(100):
        sets = [words(t) for i, t, _ in rows if i // 10 == k]
        shing = [{tuple(w[n : n + 5]) for n in range(25, 25 + 66)} for w in sets]
        want |= {10 * k + i for i in (1, 2) if any(5 * len(shing[i] & shing[j]) >= 4 * len(shing[i] | shing[j]) for j in range(i))}
    assert len(want) >= 150 and len(want & found) >= 0.98 * len(want)


def test_only_pairs_that_cannot_be_alike_are_left_out():
    # Stretches with some words replaced, inserted and deleted: whatever holds a passage around a common shingle passes both filters.
    rng = np.random.default_rng(5)
    passed = 0
    for k in range(400):
        a = rng.integers(0, 2**16, 150).astype(np.int64)
        b = a.copy()
        for _ in range(int(rng.integers(0, 5))):
            at = int(rng.integers(0, len(b) - 6))
            new = rng.integers(0, 2**16, int(rng.integers(4, 8)))
            b = np.concatenate([b[:at], new, b[at + int(rng.integers(4, 7)) :]])
        common = np.flatnonzero(np.isin(a, b))
        low = int(common[rng.integers(0, len(common))])
        near = common[(common >= low) & (common < low + 40)]
        high = int(near[rng.integers(0, len(near))])
        p, q = a[max(0, high - S.REACH + 1) : low + S.REACH], b[max(0, int(np.flatnonzero(b == a[low])[0]) - 75) :][: S.REACH]
        if a[low] not in q or a[high] not in q:
            continue
        in_p, last_p, in_q = int(np.flatnonzero(p == a[low])[0]), int(np.flatnonzero(p == a[high])[0]), int(np.flatnonzero(q == a[low])[0])
        alike = any(i <= in_p and last_p <= j for i, j, *_ in S.passages(p, q))
        known, back = np.isin(p, q)[None], np.isin(q, p)[None]
        one = lambda x: np.array([x])
        if len(p) + len(q) - len(set(p.tolist())) - len(set(q.tolist())):
            continue
        through = S.dense_around(known, one(in_p), one(last_p))[0] and S.alike_around(known, back, one(in_p), one(in_q), one(last_p))[0] >= -S.SLACK
        assert through or not alike
        passed += bool(alike)
    assert passed > 100


def test_keys_of_the_least_near_passage():
    # One replaced word in the middle of 50 words: 41 of 51 shingles shared, a similarity of 0.80 in one window.
    rng = np.random.default_rng(7)
    shared = 0
    for _ in range(600):
        a = rng.integers(1, 2**62, S.LEAST).astype(np.uint64)
        b = a.copy()
        b[20:25] = rng.integers(1, 2**62, 5).astype(np.uint64)
        one, two = (set(S.windows_of(x, np.array([0, len(x)]))[0].tolist()) for x in (a, b))
        shared += len(one & two) >= S.ENOUGH
    assert shared >= 0.985 * 600


def test_text_ids(spark):
    rows = [(None if i is None else f"d{i:09d}", t, lang) for i, t, lang in corpus()]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    got = S.repeats(docs).collect()
    assert {r.a for r in got} == repeated(rows) and all(r.a > r.b for r in got)
    left = S.stage(spark, docs, "")
    assert left.columns == docs.columns and not S.repeats(left).where("similarity = 1").count()


def test_tasks_grow_with_rows(spark, frame, folder, monkeypatch):
    monkeypatch.setattr(S, "TASK_WINDOWS", 40)
    monkeypatch.setattr(S, "BUCKET_BYTES", 10_000)
    assert {r.doc_id for r in S.query(spark, folder(documents=frame(corpus()))).collect()} == repeated(corpus())
