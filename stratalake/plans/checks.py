"""The declared data-quality tests of a store, accuracy measures, profiles and lineage events."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.functions import geo
from stratalake.operators import quality
from stratalake.plans import recipes
from stratalake.plans.views import Views
from stratalake.sources.store import TableStore


def photo_mismatch(store: TableStore, most_m: float = 1000) -> DataFrame:
    """Photos without a position of their own, or farther than most_m from the one typed in their record."""
    rows = store.read("raw_receipt").join(store.read("file_manifest").where("modality_code = 'IMAGE'").select("file_id", "captured_wkt"), "file_id")
    typed = geo.dms_point(F.coalesce(F.get_json_object("content_json", "$.localizacao_informada"), F.lit("")))
    out = rows.select("receipt_id", "file_id", "captured_wkt", typed.alias("typed_wkt")).withColumn("apart_m", geo.wkt_distance_m(F.col("captured_wkt"), F.col("typed_wkt")))
    return out.where(F.col("captured_wkt").isNull() | (F.col("apart_m") > most_m))


def declared(store: TableStore, model, views: Views | None = None) -> dict:
    """name -> function that returns the offending rows. The view of data problems is built once, and kept by `views`."""
    views, built = views or Views(store, model), []

    def event():
        return store.read("event")

    def problems(kind):
        def rows():
            if not built:
                built.append(views.keep(views.data_problems()))
            return built[0].where(F.col("problem_kind") == kind)

        return rows

    return {
        "event_has_operation": lambda: quality.not_null(event(), "operation_code"),
        "event_has_time": lambda: quality.not_null(event(), "occurred_at"),
        "event_type_known": lambda: quality.in_set(event(), "type_code", list(model.VOCABULARIES["event_type"])),
        "event_id_unique": lambda: quality.unique(event(), ["event_id"]),
        "file_id_unique": lambda: quality.unique(store.read("file_manifest"), ["file_id"]),
        "photo_where_it_says": lambda: photo_mismatch(store),
        "event_has_receipt": lambda: quality.orphans(event(), "receipt_id", store.read("raw_receipt"), "receipt_id"),
        "direct_reading_has_no_model": lambda: store.read("extraction").where("is_inferred = 'N' and model_name is not null"),
        "file_has_record": problems("FILE_WITHOUT_RECORD"),
        "record_has_file": problems("RECORD_WITHOUT_FILE"),
        "shift_received": problems("NOT_RECEIVED"),
        "all_units_reported": problems("INCOMPLETE"),
        "reject_was_resent": problems("BROKEN"),
        "nothing_lost_in_landing": lambda: store.read("ingest_run").where("n_lost > 0"),
    }


def run(spark: SparkSession, store: TableStore, model) -> DataFrame:
    views = Views(store, model)
    try:
        return quality.run(spark, declared(store, model, views))
    finally:
        for df in views.kept:
            df.unpersist()


def cell_accuracy(read: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """For each column, cells compared between twin readings (keys and a map `cells`), equal ones and their Wilson interval."""
    a = read.select(*keys, F.explode("cells").alias("column", "got"))
    b = truth.select(*keys, F.explode("cells").alias("column", "want"))
    counts = b.join(a, [*keys, "column"], "left").groupBy("column").agg(F.count("*").alias("n"), F.count_if(F.col("got").eqNullSafe(F.col("want"))).alias("hits"))
    w = quality.wilson(F.col("hits"), F.col("n"))
    return counts.select("column", "n", "hits", (F.col("hits") / F.col("n")).alias("rate"), w["lo"].alias("lo"), w["hi"].alias("hi"))


def word_error_rate(pairs: DataFrame) -> DataFrame:
    """id, errors, words and rate of pairs (id, read, truth) of transcripts."""
    words = F.size(F.filter(F.split(F.lower("truth"), r"\s+"), lambda w: w != ""))
    out = pairs.select("id", quality.word_errors(F.col("read"), F.col("truth")).alias("errors"), words.alias("words"))
    return out.withColumn("rate", F.when(F.col("words") > 0, F.col("errors") / F.col("words")))


def preservation(store: TableStore) -> DataFrame:
    """By source: receipts, those with an event, and their share."""
    receipts = store.read("raw_receipt").select("source_code", "receipt_id")
    kept = receipts.join(store.read("event").select("receipt_id").distinct(), "receipt_id", "left_semi").groupBy("source_code").agg(F.count("*").alias("kept"))
    return receipts.groupBy("source_code").agg(F.count("*").alias("receipts")).join(kept, "source_code", "left").select("source_code", "receipts", F.coalesce("kept", F.lit(0)).alias("kept"), (F.coalesce("kept", F.lit(0)) / F.col("receipts")).alias("rate"))


def latency(store: TableStore) -> DataFrame:
    """By source: events and mean, median, 90 % and 99 % of the seconds from occurrence to arrival."""
    p = lambda q: F.percentile("latency_seconds", q)
    return store.read("event").groupBy("source_code").agg(F.count("latency_seconds").alias("n"), F.avg("latency_seconds").alias("mean"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"))


def footprint(store: TableStore) -> dict[str, int]:
    """Bytes of each table."""
    return {t: store.size_bytes(t) for t in store.tables()}


def profile(store: TableStore, table: str, rows: int = 50) -> tuple[DataFrame, DataFrame]:
    """(summary of the columns, a sample of the rows) of a table."""
    df = store.read(table)
    plain = [f.name for f in df.schema if f.dataType.simpleString() in ("string", "int", "bigint", "double")]
    return df.select(*plain).summary("count", "min", "max", "mean"), df.limit(rows)


def lineage_event(recipe_name: str, model, inputs: list[str], outputs: list[str], at: datetime | None = None, store: TableStore | None = None) -> str:
    """A JSON lineage event of a recipe's run: inputs, outputs, and for each column what it is made from; with a store also the fingerprint of the recipe."""
    recipe = recipes.validate(model)[recipe_name]
    return json.dumps({
        "event_type": "COMPLETE", "event_time": (at or datetime.now(timezone.utc)).isoformat(), "run_id": str(uuid.uuid4()), "job": recipe_name, "inputs": inputs, "outputs": outputs,
        "columns": recipes.columns_of(recipe, model), "recipe_hash": recipes.fingerprint(store, recipe, model) if store else None,
    }, ensure_ascii=False)
