import hashlib
import random

import duckdb
import numpy as np
import pytest

from stratalake.llm import vector_codes as codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, place long"


def vectors(n: int, dims: int = 64, seed: int = 1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.4, (12, dims))
    return [(int(i), (centres[i % 12] + rng.normal(0, 0.1, dims)).astype(np.float32).tolist(), None if i % 11 == 0 else int(i % 5), "x", "y", 1) for i in range(n)]


def by_hand(rows, parts=16, entries=64, rounds=2):
    """The same with all distances, in Python's integers."""
    whole = [(i, [int(np.floor(np.float64(x) * 256)) for x in v], label) for i, v, label, *_ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    w = len(whole[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    firsts = sorted((i, v) for i, v, _ in whole if i is not None)[:entries]
    books = [[cut(v, p) for _, v in firsts] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, v, _ in whole:
                held.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, own in held.items():
                books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = []
    for i, v, label in whole:
        got = [near(cut(v, p), books[p]) for p in range(parts)]
        found.append((i, "".join(f"{e:02x}" for _, e in got), sum(d for d, _ in got), label))
    total = {}
    for _, _, d, label in found:
        total[label] = total.get(label, 0) + d
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((i, code, d, total[label], digest) for i, code, d, label in found), key=repr)


@pytest.mark.parametrize(("shape", "spread"), [((64, 4), 300), ((64, 4), 2), ((5, 1), 3), ((200, 8), 40), ((64, 3), 1 << 26)])
def test_tree_equals_all_distances(shape, spread):
    rng = np.random.default_rng(3)
    entries = rng.integers(-spread, spread + 1, shape)
    entries[shape[0] // 2] = entries[1]
    points = np.concatenate([rng.integers(-spread, spread + 1, (3000, shape[1])), entries])
    which, best, met = codes.Tree(entries).nearest(points)
    squares = codes._squares(points, entries)
    assert np.array_equal(which, squares.argmin(axis=1)) and np.array_equal(best, squares.min(axis=1))
    assert shape[0] < 64 or spread < 300 or shape[1] > 4 or met < 0.8 * squares.size


def test_equals_brute_force_and_sql(spark, folder):
    rows = vectors(300)
    rows += [(1000, None, 1, "x", "y", 1), (1001, [], 1, "x", "y", 1), (1002, [None] * 64, 1, "x", "y", 1), (1003, [float("nan")] * 64, 2, "x", "y", 1), (1004, [float("inf")] + [0.0] * 63, None, "x", "y", 1)]
    rows += [(1005, rows[5][1], 9, "x", "y", 1), (1006, [-900.0] * 64, 9, "x", "y", 1)]
    random.Random(1).shuffle(rows)
    root = folder(embeddings=spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = codes.query(spark, root)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    found = sorted((tuple(r) for r in got.collect()), key=repr)
    assert found == by_hand(rows) and len(found) == 302
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{root.removeprefix('file://')}/embeddings.parquet/*.parquet')")
    assert sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({codes.SQL})").fetchall(), key=repr) == found


def test_defined_cases(spark, folder):
    rows = vectors(5)
    odd = [*rows, (None, rows[0][1], 1, "x", "y", 1), rows[2], (77, [0.5] * 32, 1, "x", "y", 1), (78, [0.5] * 3, 1, "x", "y", 1), (79, [3e38] * 64, 1, "x", "y", 1)]
    got = codes.query(spark, folder(embeddings=spark.createDataFrame(odd, SCHEMA))).collect()
    assert sorted(r.vec_id for r in got if r.vec_id is not None) == [0, 1, 2, 2, 3, 4, 79] and sum(r.vec_id is None for r in got) == 1
    assert all(0 <= r.error < 2**63 for r in got) and len({r.code for r in got if r.vec_id == 2}) == 1
    assert codes.query(spark, folder(embeddings=spark.createDataFrame([], SCHEMA))).collect() == []


def test_decoding_gives_the_entries(spark):
    df = spark.createDataFrame(vectors(200), SCHEMA)
    books = codes.fit(df)
    back = codes.decode(codes.encode(df, books), books).alias("c").join(df.alias("d"), "vec_id").select("c.error", "c.embedding", "d.embedding").collect()
    for error, near, own in back:
        assert error == sum((int(a * 256) - int(np.floor(b * 256))) ** 2 for a, b in zip(near, own, strict=True))
