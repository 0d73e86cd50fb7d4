import math
import pickle
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_data import prose

from stratalake.llm import language_model as M


def words(t):
    return (t or "").encode().lower().split() + [None]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


GIVEN = [(i, prose(i, 40 + i % 90), "en") for i in range(400)] + [(1000, None, "en"), (1001, "", "en"), (1002, "Zebra zebra ZEBRA unseen", "en"), (1003, prose(4, 50_000), "en"), (None, "the and", "en"), (5, prose(5, 45), "en")]


@pytest.mark.parametrize("head", [1 << 20, 8])
def test_base_score_and_order(spark, frame, folder, monkeypatch, head):
    monkeypatch.setattr(M, "HEAD", head)
    got = M.query(spark, folder(documents=frame(GIVEN))).collect()
    count = Counter()
    for i, t, _ in GIVEN:
        if not held(i):
            count.update(words(t))
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), held(i), len(words(t)), sum(count[w] > 0 for w in words(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t, _ in GIVEN)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_better_than_base_on_held_out_text(spark, frame, folder):
    chain = lambda i: " ".join(f"{a}{k % 5} after{a}{k % 5}" for k, a in enumerate("xy"[i % 2] * 40))
    got = M.query(spark, folder(documents=frame([(i, chain(i), "en") for i in range(300)]))).collect()
    out = [r for r in got if r.held_out]
    assert len(out) > 20 and sum(r.score for r in out) > 0.6 * sum(r.base_score for r in out)


def test_probabilities_sum_to_one():
    toks, rows = M.tokens(pa.array([prose(1, 500)]))
    values, counts = np.unique(toks, return_counts=True)
    totals = np.ones(16)
    np.add.at(totals, (values & np.uint64(15)).astype(int), counts + 1)
    model = M.Model(values, counts, totals)
    model.train(toks, rows, np.zeros(model.weights.shape[:2], np.float32))
    assert np.abs(model.weights.sum(axis=2)).max() < 1e-3
    n = len(model.codes)
    for k in (0, 1, 7, 300):
        feats = [np.repeat(f, n) for f in M.features(toks, rows, k, k + 1)]
        token, digit, at, digits = model._paths(np.arange(n), feats)
        scores = model._scores(at, digits).astype(float)
        logs = scores[np.arange(len(token)), digit] - np.log(np.exp(scores).sum(axis=1))
        assert abs(np.exp(np.bincount(token, logs)).sum() - 1) < 1e-4


def test_prefix_code():
    rng = np.random.default_rng(3)
    for n in (1, 16, 17, 300, 5000):
        counts = np.sort((1e6 / rng.zipf(1.3, n)) + 1)[::-1]
        codes, lengths, longest, end = M.prefix_code(counts)
        widths = M.BRANCH ** (longest - lengths)
        # Each leaf has a stretch of its own, aligned to its length, and the mean length is near the entropy.
        assert (codes % widths == 0).all() and (np.diff(codes) == widths[:-1]).all() and end <= M.BRANCH**longest
        share = counts / counts.sum()
        assert (share * lengths).sum() <= max(1, (share * -np.log2(share) / 4).sum() + 1)


def test_empty_and_untrained(spark, frame, folder):
    assert M.query(spark, folder(documents=frame([]))).count() == 0
    only = next(i for i in range(100) if held(i))
    r = M.query(spark, folder(documents=frame([(only, "a b", "en")]))).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and math.isfinite(r.score)


def test_trains_on_every_text_once(spark, monkeypatch):
    texts = spark.range(14_000).selectExpr("id as doc_id", "concat('to be ', id) as text").repartition(3)
    seen = spark.sparkContext.accumulator(0)
    made = M._train_task

    def watched(shared):
        run = made(shared)

        def outer(batches):
            def counted():
                for batch in batches:
                    seen.add(batch.num_rows)
                    yield batch

            yield from run(counted())

        return outer

    monkeypatch.setattr(M, "_train_task", watched)
    M.fit(texts, M.count(texts))
    assert seen.value == 14_000


def test_vocabulary_grows_with_the_corpus(spark):
    sizes = []
    for n in (1_000, 10_000):
        texts = spark.range(n).selectExpr("id as doc_id", "concat('word', id div 3, ' and ', id) as text")
        model, *_ = M.fit(texts, M.count(texts))
        sizes.append(len(model.vocab))
    assert sizes[0] >= 300 and sizes[1] > 9 * sizes[0]


def test_a_very_long_text_is_scored_in_steps():
    text = pa.array([prose(9, 300_000)])
    toks, rows = M.tokens(text)
    model = M.Model(np.zeros(0, np.uint64), np.zeros(0), np.ones(16))
    whole = [model.logs(toks, rows, lo, min(len(toks), lo + M.STEP))[0] for lo in range(0, len(toks), M.STEP)]
    assert sum(map(len, whole)) == len(toks) == 300_001


def test_what_is_broadcast_needs_no_package():
    model = M.Model(np.arange(5, dtype=np.uint64), np.arange(5.0) + 1, np.ones(16))
    model.weights += 1
    state = pickle.dumps(vars(model))
    assert b"stratalake" not in state
    toks, rows = M.tokens(pa.array(["a b c"]))
    assert np.array_equal(M.restored(pickle.loads(state)).logs(toks, rows, 0, 4)[0], model.logs(toks, rows, 0, 4)[0])


def test_updates_are_averaged_in_groups_of_bounded_size(spark):
    """Means over any fan equal the weighted mean of all tasks, and no group of a step holds more than fan updates of a part."""
    rng = np.random.default_rng(3)
    tasks, rows = 23, 4
    moved = rng.normal(size=(tasks, 2, rows, M.BRANCH)).astype(np.float16)
    squares = rng.random((tasks, 2, rows)).astype(np.float32)
    squares[:, 1, 2] = 0
    made = [(p, t, bytearray(moved[t, p].tobytes()), bytearray(squares[t, p].tobytes()), False) for t in range(tasks) for p in range(2)]
    frame = spark.createDataFrame(made, M.MOVED).repartition(5)
    want = (moved.astype(np.float64) * squares[..., None]).sum(0) / (squares.sum(0) + 1e-20)[..., None]
    for fan in (2, 5, 22, 23, 100):
        got = {r.part: np.frombuffer(bytes(r.moved), np.float32).reshape(rows, -1) for r in M.averaged(frame, tasks, fan).collect()}
        assert all(np.allclose(got[p], want[p], atol=1e-4) for p in range(2)), fan


def test_training_sums_no_row_that_is_met_once(monkeypatch):
    """Gradients of rows met once are taken as they are; the weights are those of sums over all of them."""
    r = np.random.default_rng(3)
    toks = (r.integers(0, 1 << 60, 500, dtype=np.uint64) << np.uint64(4))[r.zipf(1.4, 9000) % 500]
    rows = np.array([0, 4000, 9000])
    values, counts = np.unique(toks, return_counts=True)
    model = M.Model(values, counts, np.full(M.FORMS, 2.0), 14)
    plain = M.Model(values, counts, np.full(M.FORMS, 2.0), 14)
    squares, other = (np.zeros(model.weights.shape[:2], np.float32) for _ in range(2))
    for lo in range(0, len(toks), M.STEP):
        hi = min(len(toks), lo + M.STEP)
        token, digit, at, digits = plain._paths(plain.leaves(toks[lo:hi])[0], M.features(toks, rows, lo, hi))
        share = np.exp(plain._scores(at, digits))
        grad = -share / share.sum(1, keepdims=True)
        grad[np.arange(len(token)), digit] += 1
        for table, sums, x in zip(plain.weights, other, at, strict=True):
            total = np.zeros((1 << 14, M.BRANCH))
            np.add.at(total, x, grad)
            sums += (total**2).mean(1)
            table += M.RATE * total / np.sqrt(sums + 1)[:, None]
    given = []

    class Counted:
        def __getattr__(self, name):
            return getattr(np, name)

        class add:
            reduce = np.add.reduce

            @staticmethod
            def reduceat(values, starts, axis):
                given.append(np.diff(starts, append=len(values)).min())
                return np.add.reduceat(values, starts, axis)

    monkeypatch.setattr(M, "np", Counted())
    model.train(toks, rows, squares)
    assert min(given) >= 2
    assert np.allclose(model.weights, plain.weights, atol=1e-3)
