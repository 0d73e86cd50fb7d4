import numpy as np
import pyarrow as pa
import pytest
from llm_data import prose

from stratalake.llm import common


@pytest.mark.parametrize("most", [1, 64, 10**9])
def test_slices_and_words(most):
    texts = [None, "", " a  B\tc", prose(1, 200), "é\x0bZ\u00a0q", "one"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
    got = []
    for part, values in common.text_slices(batch, "t", most):
        words, rows = common.word_hashes(values)
        got += [words[rows[i] : rows[i + 1]].tolist() for i in range(len(values))]
    whole, counts = {}, []
    for t, hashes in zip(texts, got, strict=True):
        own = (t or "").encode().lower().split()
        assert len(own) == len(hashes)
        for w, h in zip(own, hashes, strict=True):
            assert whole.setdefault(w, h) == h
        counts.append(len(own))
    assert len(set(whole.values())) == len(whole) and counts[2] == 3


def test_long_text_in_pieces(monkeypatch):
    text = pa.array([prose(2, 4000) + " " + "w" * 100_000 + " end"])
    whole = common.word_hashes(text)[0]
    monkeypatch.setattr(common, "SLICE_BYTES", 1000)
    assert np.array_equal(common.word_hashes(text)[0], whole)


def test_written_lies_in_the_shared_folder(spark):
    df = common.written(spark.range(3).withColumnRenamed("id", "x"), "t")
    assert df.count() == 3 and df.columns == ["x"]
    assert all(common.scratch(spark).split("://")[-1] in f for f in df.inputFiles())


def test_runs_hold_whole_groups():
    rng = np.random.default_rng(2)
    for _ in range(60):
        keys = np.repeat(np.arange(40), rng.integers(0, 9, 40))
        table = pa.table({"a": keys // 7, "b": keys, "x": np.arange(len(keys))})
        cuts = np.unique(rng.integers(0, len(keys) + 1, 8))
        batches = [b for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True) for b in table.slice(lo, hi - lo).combine_chunks().to_batches()]
        got = list(common.runs(batches, ("a", "b")))
        assert [x for b in got for x in b.column("x").to_pylist()] == list(range(len(keys)))
        where = [set(b.column("b").to_pylist()) for b in got]
        assert all(not (p & q) for i, p in enumerate(where) for q in where[:i])
    assert list(common.runs([], ("a",))) == []


def test_discard_deletes_what_was_written(spark):
    df = common.written(spark.range(5), "gone")
    assert df.count() == 5
    common.discard(df)
    with pytest.raises(Exception, match="(?i)not.*exist|not found"):
        spark.read.parquet(df._stored_at).count()
