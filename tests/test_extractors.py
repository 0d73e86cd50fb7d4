import hashlib
import inspect
import json
from datetime import datetime

import pytest

from stratalake.plans import model, recipes
from stratalake.sources import extractors
from stratalake.sources.store import TableStore


def test_replay_isolates_failures(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/t")
    recipes.create_tables(spark, store, model)
    from stratalake.sources.landing import FILE

    store.create("file_manifest", spark.createDataFrame([], FILE).schema)
    content = {"a.wav": b"one", "b.wav": b"two", "c.wav": b"three"}
    for n, c in content.items():
        (tmp_path / n).write_bytes(c)
    rows = [(n, "OP", "h", f"file:{tmp_path}/{n}", "audio/wav", "AUDIO", 3, None, None, None, datetime(2024, 1, 1)) for n in content]
    store.append("file_manifest", spark.createDataFrame(rows, FILE))
    sha = lambda c: hashlib.sha256(c).hexdigest()
    recorded = {sha(b"one"): json.dumps({"texto": "um"}), sha(b"two"): "not json"}
    assert extractors.extract(spark, store, "AUDIO", extractors.replay(recorded), "speech", "v1", "small") == {"OK": 1, "FAILED": 2}
    recorded[sha(b"two")] = "{}"
    assert extractors.extract(spark, store, "AUDIO", extractors.replay(recorded), "speech", "v1", "small") == {"OK": 1, "FAILED": 1}
    assert store.read("extraction").where("status_code = 'OK' and is_inferred = 'Y'").count() == 2
    assert store.read("extraction_setting").count() == 1
    with pytest.raises(recipes.RevisionError):
        extractors.extract(spark, store, "AUDIO", extractors.replay(recorded), "speech", "v1", "small", prompt="other")


def test_receipts_and_readings(spark, tmp_path):
    from stratalake.sources.landing import FILE, RECEIPT

    store = TableStore(spark, f"file://{tmp_path}/t")
    recipes.create_tables(spark, store, model)
    for name, schema in (("file_manifest", FILE), ("raw_receipt", RECEIPT)):
        store.create(name, spark.createDataFrame([], schema).schema)
    (tmp_path / "a.wav").write_bytes(b"one")
    store.append("file_manifest", spark.createDataFrame([("f1", "OP", "h", f"file:{tmp_path}/a.wav", "audio/wav", "AUDIO", 3, None, None, None, datetime(2024, 1, 1))], FILE))
    store.append("raw_receipt", spark.createDataFrame([(f"r{i}", "C2_B", "OP", "TEXT", json.dumps({"n": i}), "h", "u", None, datetime(2024, 1, 1)) for i in range(5)], RECEIPT))
    echo = lambda content: json.dumps({"read": content.decode()})
    assert extractors.extract(spark, store, "TEXT", echo, "llm", "t1", "m", of="receipts", batch=2) == {"OK": 5, "FAILED": 0}
    assert extractors.extract(spark, store, "TEXT", echo, "llm", "t1", "m", of="receipts") == {"OK": 0, "FAILED": 0}
    assert extractors.extract(spark, store, "AUDIO", echo, "speech", "s1", "ear") == {"OK": 1, "FAILED": 0}
    assert extractors.extract(spark, store, "AUDIO", echo, "llm", "i1", "m", of="readings", of_setting="s1") == {"OK": 1, "FAILED": 0}
    assert extractors.extract(spark, store, "AUDIO", echo, "llm", "i1", "m", of="readings", of_setting="s1") == {"OK": 0, "FAILED": 0}
    got = {r.setting_code: r for r in store.read("extraction").collect()}
    assert got["i1"].origin_extraction_id == got["s1"].extraction_id and got["i1"].file_id == "f1" and json.loads(json.loads(got["i1"].output_json)["read"]) == {"read": "one"}
    assert {r.receipt_id for r in store.read("extraction").where("setting_code = 't1'").collect()} == {f"r{i}" for i in range(5)}
    with pytest.raises(ValueError):
        extractors.extract(spark, store, "AUDIO", echo, "llm", "z", of="elsewhere")


def test_a_broken_run_is_taken_up(spark, tmp_path, monkeypatch):
    from stratalake.sources.landing import FILE, RECEIPT

    store = TableStore(spark, f"file://{tmp_path}/t")
    recipes.create_tables(spark, store, model)
    for name, schema in (("file_manifest", FILE), ("raw_receipt", RECEIPT)):
        store.create(name, spark.createDataFrame([], schema).schema)
    receipts = [(f"r{i}", "C2_B", "OP", "TEXT", json.dumps({"n": i}), "h", "u", None, datetime(2024, 1, 1)) for i in range(12)]
    store.append("raw_receipt", spark.createDataFrame(receipts, RECEIPT).coalesce(1))
    calls = tmp_path / "calls"
    calls.mkdir()

    def reader(content):
        n = json.loads(content)["n"]
        with open(calls / f"{n}", "a") as f:
            f.write("x")
        return "{}" if n != 5 else "no JSON"

    whole, done = TableStore.append, []

    def broken(self, table, df, part=None):
        if table == "extraction":
            if len(done) == 2:
                raise RuntimeError("the cluster went away")
            done.append(part)
        return whole(self, table, df, part)

    monkeypatch.setattr(TableStore, "append", broken)
    with pytest.raises(Exception, match="went away"):
        extractors.extract(spark, store, "TEXT", reader, "llm", "t1", of="receipts", batch=2, files=1)
    monkeypatch.setattr(TableStore, "append", whole)
    assert store.read("extraction").count() == 4
    assert sum(extractors.extract(spark, store, "TEXT", reader, "llm", "t1", of="receipts", batch=2, files=1).values()) == 8
    rows = store.read("extraction").collect()
    assert sorted(r.receipt_id for r in rows) == sorted(f"r{i}" for i in range(12)) and [r.receipt_id for r in rows if r.status_code == "FAILED"] == ["r5"]
    # What was done before is not read again; what had failed is, by the next run.
    assert all((calls / f"{i}").read_text() == "x" for i in range(12))
    assert extractors.extract(spark, store, "TEXT", reader, "llm", "t1", of="receipts") == {"OK": 0, "FAILED": 1}


def test_no_input_goes_through_the_driver():
    source = inspect.getsource(extractors)
    assert "toLocalIterator" not in source and "createDataFrame(rows" not in source and source.count(".collect()") == 2


def test_spans(spark):
    cells = spark.createDataFrame([("t", 0, 0, 1, 2, "a"), ("t", 1, 0, 2, 1, "b"), ("t", 1, 1, None, None, "c")], "`table` string, row int, column int, row_span int, column_span int, text string")
    assert sorted(map(tuple, extractors.expand_spans(cells).collect())) == [("t", 0, 0, "a"), ("t", 0, 1, "a"), ("t", 1, 0, "b"), ("t", 1, 1, "c"), ("t", 2, 0, "b")]
