import corpus_pipeline
import __spark_entry__
from llm_data import prose

from stratalake.llm import registry


def test_stages_in_order(spark, frame, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontaminate", "bpe"]
    passage, item = prose(900, 70), prose(901, 30)
    rows = [(i, prose(i, 80), "en") for i in range(60)]
    rows += [(100, rows[3][1], "en"), (101, rows[4][1].replace("the", "THE"), "en"), (102, "12 34 !!", "en"), (103, None, "en"), (104, prose(70, 40) + " " + passage, "en"), (105, prose(71, 40) + " " + passage + " " + prose(72, 30), "en"), (106, prose(73, 50) + " " + item + " " + prose(74, 10), "en"), (None, prose(950, 60), "en"), (107, "", "en")]
    sf = folder(documents=frame(rows), benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    docs, names = spark.read.parquet(f"{sf}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        names = names or docs.columns
        assert docs.columns == names
    left = {r.doc_id: r.text for r in docs.collect()}
    assert set(left) == {i for i, _, _ in rows} - {100, 101, 102, 103, 106, 107}
    assert all(left[i] == t for i, t, _ in rows if i in left and i != 105) and passage not in left[105]
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(out) == set(left) and all(len(r.ids) == r.n_tokens for r in out.values())


def test_text_ids_and_clashing_columns(spark, folder):
    passage, item = prose(900, 70), prose(901, 30)
    rows = [(f"d{i:03d}", prose(i, 80), "en", i, "x") for i in range(30)]
    rows += [("d100", rows[3][1], "en", 1, "x"), ("d101", prose(70, 40) + " " + passage, "en", 2, "x"), ("d102", prose(71, 40) + " " + passage, "en", 3, "x"), ("d103", prose(73, 50) + " " + item, "en", 4, "x"), (None, prose(950, 60), "en", 5, "x")]
    docs = spark.createDataFrame(rows + rows[5:6], "doc_id string, text string, lang string, id long, component string")
    sf = folder(documents=docs, benchmark=spark.createDataFrame([("q", item)], "item_id string, text string"))
    out = [r.doc_id for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(out, key=str) == sorted([None, "d101", "d102", *(f"d{i:03d}" for i in range(30))], key=str)


def test_empty(spark, frame, folder):
    sf = folder(documents=frame([]), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_registered():
    names = set(__spark_entry__.queries())
    assert set(registry.QUERIES) | {"pipeline"} <= names and {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(__spark_entry__.oracle_sql()) <= names
