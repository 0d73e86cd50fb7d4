"""JSON files cut where records end, against the same files opened whole."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalake.plans import model
from stratalake.sources import arrays, landing
from stratalake.sources.store import TableStore

OPEN = landing.open_json


def record(i, rng):
    signs = ['{', '}', '[', ']', '"', "\\", "\\\"", "\n", ",", "é", "😀", "} , {", '"}]', ""]
    text = lambda: "".join(rng.choices(signs, k=rng.randrange(6)))
    return {"n": i, text(): text(), "operation": rng.choice(["Op x", None]), "deep": [{"a": [text(), {}]}, [[]], text()], "z": 1.50}


def contents():
    rng = random.Random(5)
    rows = [record(i, rng) for i in range(60)]
    text = json.dumps(rows, ensure_ascii=False)
    wide = "\ufeff\n [ " + " ,\n\n ".join(json.dumps(r, indent=1) for r in rows) + "\n]\n \n"
    good = {"plain": text, "wide": wide, "object": json.dumps({"all": rows}), "object_end": json.dumps({"all": rows}) + "\n\n", "hollow": "[" + " " * 500 + "]", "one": json.dumps([{"x": "}" * 400}]), "bom_object": "\ufeff" + json.dumps({"all": rows[:20]})}
    bad = {"cut": text[: len(text) // 2], "no_end": text[:-1], "no_brace": text[:-2], "comma": text.replace("}, {", "},, {", 1), "tail": text + "x", "twice": text + text, "number": "[1, " + text[1:], "last_number": text[:-1] + ", 1]", "objects": json.dumps({"all": rows}) * 2, "escape": text[:-1] + ', {"a": "\\}"}]', "nothing": "x" * 500, "hollow_open": "[" + " " * 500, "quote": text[:-1] + ', {"a": "}]', "inner": text.replace('"n": 30', '"n": nope', 1), "object_cut": json.dumps({"all": rows})[:-1]}
    return good, bad


@pytest.fixture(scope="module")
def land(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("arrays") / "in"
    (root / "op" / "c2b").mkdir(parents=True)
    good, bad = contents()
    for name, text in {**good, **bad}.items():
        (root / "op" / "c2b" / f"{name}.json").write_bytes(text.encode())
    (root / "op" / "c2b" / "bytes.json").write_bytes(b'[{"a": "' + b"\xff" * 300 + b'"}]')
    (root / "op" / "c2b" / "small.json").write_bytes(b'[{"a": 1}]')
    return root


@pytest.fixture
def tiny_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "900", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_cut_files_equal_whole_ones(spark, land, tiny_ranges):
    good, bad = contents()
    files = landing.scan(spark, f"file://{land}", model.SOURCES, 200)
    assert arrays.pieces(spark, f"file://{land}", 200).select("path", "start").distinct().groupBy("path").count().agg(F.max("count")).first()[0] > 5
    rows = landing.look_large(spark, f"file://{land}", files, 200).collect()
    name = lambda r: r.path.rpartition("/")[2].removesuffix(".json")
    found = {}
    for r in rows:
        found.setdefault(name(r), []).append((r.operation_code, r.content_json, r.content_hash, r.detail))
    for n, text in good.items():
        assert sorted(x[1:3] for x in found.get(n, [])) == sorted(x[1:] for x in OPEN(text.encode(), "OP")), n
        assert all(x[3] is None for x in found.get(n, [])), n
        assert {x[:2] for x in found.get(n, [])} == {x[:2] for x in OPEN(text.encode(), "OP")}
    for n, text in bad.items():
        with pytest.raises(ValueError):
            OPEN(text.encode(), "OP")
        assert len(found[n]) == 1 and found[n][0][1] is None and found[n][0][3], (n, found[n])
    assert len(found["bytes"]) == 1 and found["bytes"][0][3] and "small" not in found


def test_ingest_takes_large_files_apart(spark, land, tmp_path):
    store, other = TableStore(spark, f"file://{tmp_path}/a"), TableStore(spark, f"file://{tmp_path}/b")
    apart, whole = landing.ingest(spark, store, f"file://{land}", model.SOURCES, whole=200), landing.ingest(spark, other, f"file://{land}", model.SOURCES)
    counts = ("n_seen", "n_recorded", "n_duplicate", "n_lost", "n_new_files", "n_new_receipts", "n_rejected")
    assert {k: apart[k] for k in counts} == {k: whole[k] for k in counts}
    columns = ["receipt_id", "source_code", "operation_code", "modality_code", "content_json", "content_hash"]
    both = [s.read("raw_receipt").select(columns) for s in (store, other)]
    assert both[0].count() and both[0].exceptAll(both[1]).isEmpty() and both[1].exceptAll(both[0]).isEmpty()
    assert landing.ingest(spark, store, f"file://{land}", model.SOURCES, whole=200)["n_new_receipts"] == 0


def test_no_large_files(spark, tmp_path):
    (tmp_path / "op" / "c2b").mkdir(parents=True)
    (tmp_path / "op" / "c2b" / "empty.json").write_bytes(b"")
    assert arrays.records(arrays.pieces(spark, f"file://{tmp_path}")).collect() == []


def test_records_stay_in_the_block_that_holds_them(spark, tmp_path, monkeypatch):
    rng, kept, real = random.Random(6), [], arrays.stored
    rows = [record(i, rng) for i in range(15_000)]
    rows[7000] = {"long": 'x}{"' * 500_000}  # over several blocks
    (tmp_path / "big.json").write_text(json.dumps(rows, ensure_ascii=False))
    monkeypatch.setattr(arrays, "stored", lambda df, name: kept.append(real(df, name)) or kept[-1])
    found = {r.record: json.loads(bytes(r.text).lstrip(b" ,[\n")) for r in arrays.records(arrays.pieces(spark, f"file://{tmp_path}")).where("is_closed").collect()}
    assert [found[i] for i in range(len(rows))] == rows and len(found) == len(rows)
    assert sum(k.count() for k in kept) < 100  # not a row for each piece of a text


def test_blocks_add_up(monkeypatch):
    raw = json.dumps([record(i, random.Random(i)) for i in range(300)], ensure_ascii=False).encode()
    cut = raw.split(b"}")
    columns = lambda lo, hi: [["f"] * (hi - lo), [0] * (hi - lo), list(range(lo, hi)), [len(raw)] * (hi - lo), cut[lo:hi]]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in columns(lo, min(lo + 7, len(cut)))], names=["path", "start", "at", "size", "piece"]) for lo in range(0, len(cut), 7)]
    (whole,) = [b.to_pylist()[0] for b in arrays._blocks(iter(batches))]
    monkeypatch.setattr(arrays, "BLOCK_BYTES", 400)
    blocks = [b.to_pylist()[0] for b in arrays._blocks(iter(batches))]
    assert len(blocks) > 20 and b"".join(b["text"] for b in blocks) == whole["text"] == raw + b"}"
    assert sum(b["quotes"] for b in blocks) == whole["quotes"]
    depth, inside, ends = 0, 0, []
    for b in blocks:
        ends += [depth + d for d in b[f"d{inside}"]]
        depth, inside = depth + b[f"t{inside}"], (inside + b["quotes"]) % 2
    assert ends == whole["d0"] and depth == whole["t0"]
