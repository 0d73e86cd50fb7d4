"""Readers of files whose content isn't structured (speech, scans, language models), as an interface.

The engine never calls a service: a reader is a function from bytes to JSON text that a deployment brings along, or the replay of recorded
outputs. Each file stands for itself: a reading that fails, or that isn't JSON, is a row with status FAILED, and the next run tries it again.

A run is a stream: what is pending is written as a queue of small files by the executors, and read as micro-batches of so many files each until there are no
more. The stream's checkpoint remembers which batches are done, so a run that breaks off is taken up where it stood by the next call; a batch that
was cut short is read again and takes the place of what it had left.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.plans.recipes import lock_setting, pending_extractions
from stratalake.sources.store import TableStore

Reader = Callable[[bytes], str]


def replay(recorded: dict[str, str]) -> Reader:
    """A reader that returns what was recorded for the digest of the bytes."""

    def read(content: bytes) -> str:
        digest = hashlib.sha256(content).hexdigest()
        if digest not in recorded:
            raise KeyError(f"nothing recorded for {digest[:16]}")
        return recorded[digest]

    return read


BATCH = 1000  # inputs in a file of the queue
FILES = 16  # of the queue in a micro-batch
READ = "extraction_id string, file_id string, receipt_id string, origin_extraction_id string, output_json string, seconds double, status_code string, run_at timestamp"


def _read(reader: Reader, tool: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                began, output, status = time.time(), None, "OK"
                try:
                    output = reader(bytes(r.content))
                    json.loads(output)
                except Exception as e:  # one input's failure is a row, not the job's
                    output, status = f"{type(e).__name__}: {e}"[:400], "FAILED"
                now = datetime.now(timezone.utc).replace(tzinfo=None)
                key = "ext_" + hashlib.sha256(f"{r.origin_extraction_id or r.receipt_id or r.file_id}{tool}{now.isoformat()}".encode()).hexdigest()[:16]
                rows.append((key, r.file_id, r.receipt_id, r.origin_extraction_id, output, time.time() - began, status, now))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")])

    return run


def _queue(store: TableStore, key: str, todo: DataFrame, batch: int) -> str | None:
    """The folder of the run to go on with: one that has broken off, else a new one with a queue of what is pending; None if nothing is."""
    runs = store.folders("_runs", key)
    if runs and store.has("_runs", key, runs[-1], "queue", "_SUCCESS") and not store.has("_runs", key, runs[-1], "done"):
        return f"_runs/{key}/{runs[-1]}"
    if todo.isEmpty():
        return None
    name = f"_runs/{key}/{len(runs):06d}"
    todo.write.mode("overwrite").option("maxRecordsPerFile", batch).parquet(f"{store.root}/{name}/queue")
    return name


def extract(
    spark: SparkSession, store: TableStore, modality: str, reader: Reader, tool: str, setting: str, model_name: str | None = None, parameters: str = "{}", prompt: str = "", partitions: int | None = None, of: str = "files", of_setting: str | None = None, batch: int = BATCH, files: int = FILES
) -> dict[str, int]:
    """Reads what this setting hasn't read, on the executors, and appends a row for each; returns how many are OK and FAILED.

    Inputs are the files of a modality (of="files"), the texts of its receipts ("receipts"), or the outputs of another setting on its files ("readings", of_setting): a
    reading of a reading, which names its origin. A micro-batch has `files` files of the queue, of `batch` inputs each at most; of these the driver gets the addresses of
    files to read, which any scan plans with, and neither contents nor outputs. The setting is locked first: the same code with other parameters or prompt is refused."""
    digest, new = lock_setting(store.read("extraction_setting"), setting, tool, parameters, prompt)
    if new:
        row = spark.createDataFrame([(setting, tool, parameters, prompt, digest, datetime.now(timezone.utc).replace(tzinfo=None))], store.read("extraction_setting").schema)
        store.append("extraction_setting", row)
    counts = {"OK": 0, "FAILED": 0}
    todo = pending_extractions(store, modality, setting, of, of_setting)
    run = _queue(store, hashlib.sha256(f"{setting}|{modality}|{of}|{of_setting}".encode()).hexdigest()[:16], todo, batch)
    if run is None:
        return counts

    def step(own: DataFrame, number: int) -> None:
        if of == "files":
            uris = [r.uri for r in own.select("uri").distinct().collect()]
            found = own.sparkSession.read.format("binaryFile").load(uris).select(F.col("path").alias("uri"), F.col("content").alias("found"))
            own = own.join(found, "uri").withColumn("content", F.col("found"))
        own = own.select("file_id", "receipt_id", "origin_extraction_id", F.col("content").cast("binary").alias("content"))
        read = (own.repartition(partitions) if partitions else own).mapInPandas(_read(reader, tool), READ)
        out = read.select("extraction_id", "file_id", "receipt_id", "origin_extraction_id", F.lit("Y" if model_name else "N").alias("is_inferred"), F.lit(tool).alias("tool_name"), F.lit(model_name).cast("string").alias("model_name"), F.lit(setting).alias("setting_code"), "output_json", "seconds", "status_code", "run_at")
        part = f"part-{run.replace('/', '-')}-{number:06d}"
        store.append("extraction", out, part)
        for r in store.read_part("extraction", part).groupBy("status_code").count().collect():
            counts[r["status_code"]] = counts.get(r["status_code"], 0) + r["count"]

    queue = spark.readStream.schema(todo.schema).option("maxFilesPerTrigger", files).parquet(f"{store.root}/{run}/queue")
    stream = queue.writeStream.foreachBatch(step).option("checkpointLocation", f"{store.root}/{run}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    store.mark(run, "done")
    return counts


def expand_spans(cells: DataFrame) -> DataFrame:
    """(table, row, column, text) of cells (table, row, column, row_span, column_span, text): merged cells repeat their text in all places that they cover."""
    rows = F.explode(F.sequence(F.col("row"), F.col("row") + F.greatest(F.coalesce("row_span", F.lit(1)), F.lit(1)) - 1))
    columns = F.explode(F.sequence(F.col("column"), F.col("column") + F.greatest(F.coalesce("column_span", F.lit(1)), F.lit(1)) - 1))
    return cells.withColumn("_r", rows).withColumn("_c", columns).select("table", F.col("_r").alias("row"), F.col("_c").alias("column"), "text")
