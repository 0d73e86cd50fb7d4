"""The landing area: files by operation and source, opened once into receipts, file rows and rejects.

Every file stands for itself: one that can't be opened becomes a reject, and the others go on. Identities are digests of content, so files that
arrive again add nothing. Contents are read in one pass (look); JSON files above a size are cut where records end, so that several tasks open one
(arrays). Only JSON files, and photos for their EXIF block, go through Python, for the digest of a record is that of its compact text with keys in their own order.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.operators import stages
from stratalake.sources import arrays
from stratalake.sources.store import TableStore

MIME = {"json": "application/json", "pdf": "application/pdf", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "wav": "audio/wav", "mp3": "audio/mpeg", "txt": "text/plain"}
MODALITY = {"pdf": "PDF", "xlsx": "SHEET", "jpg": "IMAGE", "jpeg": "IMAGE", "png": "IMAGE", "wav": "AUDIO", "mp3": "AUDIO", "txt": "TEXT"}
RECEIPT = "receipt_id string, source_code string, operation_code string, modality_code string, content_json string, content_hash string, origin_uri string, file_id string, received_at timestamp"
FILE = "file_id string, operation_code string, content_hash string, file_uri string, mime_type string, modality_code string, size_bytes long, captured_at timestamp, captured_wkt string, is_scanned string, received_at timestamp"
REJECT = "reject_id string, origin_uri string, reason_code string, detail string, content_hash string, size_bytes long, received_at timestamp"
WHOLE = 8 << 20  # bytes of a JSON file that one task opens; larger ones are cut where records end
BATCH_FILES = 32
RUN = "run_id string, landing_uri string, n_seen long, n_recorded long, n_duplicate long, n_lost long, n_new_files long, n_new_receipts long, n_rejected long, seconds double, run_at timestamp"


def _chosen(key: Column, values: dict[str, str], default: str | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(default)) if default else F.try_element_at(table, key)


def scan(spark: SparkSession, landing: str, sources: dict[str, str], whole: int = WHOLE) -> DataFrame:
    """The files below landing: path, rel, operation_code, source_code (null if the folders name none), ext, stem, is_json, size_bytes, content, content_hash.
    The last two are null for JSON files of more than `whole` bytes, whose contents aren't read here."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(landing)
    # By these columns alone, so that Spark leaves such files out when it lists them.
    large = (F.col("_metadata.file_size") > whole) & F.col("_metadata.file_name").endswith(".json")
    files = files.where(~large).select("path", "length", "content").unionByName(files.where(large).select("path", "length"), allowMissingColumns=True)
    root = F.lit(landing.rstrip("/").split("://")[-1] + "/")
    rel = F.expr("substring(path, instr(path, _root) + length(_root))")
    out = files.withColumn("_root", root).withColumn("rel", rel)
    steps = F.split("rel", "/")
    inside = F.size(steps) >= 3
    out = out.withColumn("operation_code", F.when(inside, F.upper(F.get(steps, F.lit(0))))).withColumn("source_code", F.when(inside, _chosen(F.get(steps, F.lit(1)), sources)))
    return out.select("path", "rel", "operation_code", "source_code", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("ext"), F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"), F.col("path").endswith(".json").alias("is_json"), F.col("length").alias("size_bytes"), "content", F.sha2("content", 256).alias("content_hash"))


def exif(content: bytes) -> tuple[datetime | None, str | None]:
    """(capture time, POINT) of a JPEG's EXIF block; what isn't there, or can't be read, is None. Times are taken at -03:00."""
    at = content.find(b"Exif\x00\x00")
    if content[:2] != b"\xff\xd8" or at < 0:
        return None, None
    tiff = content[at + 6 :]
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order:
        return None, None
    unpack = lambda f, o: struct.unpack_from(order + f, tiff, o)

    def tags(offset: int) -> dict[int, tuple[int, int, int]]:
        (n,) = unpack("H", offset)
        return {t: (kind, count, offset + 10 + 12 * i) for i in range(n) for t, kind, count in [unpack("HHI", offset + 2 + 12 * i)]}

    def text(entry) -> str:
        _, count, place = entry
        start = unpack("I", place)[0] if count > 4 else place
        return tiff[start : start + count].split(b"\x00")[0].decode("ascii", "replace")

    def rationals(entry) -> list[float]:
        start = unpack("I", entry[2])[0]
        pairs = [unpack("II", start + 8 * i) for i in range(entry[1])]
        return [a / b for a, b in pairs]

    taken = point = None
    try:
        first = tags(unpack("I", 4)[0])
        if 0x8769 in first:
            own = tags(unpack("I", first[0x8769][2])[0])
            if 0x9003 in own:
                taken = datetime.strptime(text(own[0x9003]) + "-0300", "%Y:%m:%d %H:%M:%S%z").astimezone(timezone.utc).replace(tzinfo=None)
    except (struct.error, ValueError):
        pass
    try:
        first = tags(unpack("I", 4)[0])
        if 0x8825 in first:
            gps = tags(unpack("I", first[0x8825][2])[0])
            degrees = lambda tag, ref, minus: sum(v / 60**i for i, v in enumerate(rationals(gps[tag]))) * (-1 if text(gps[ref]) == minus else 1)
            point = f"POINT({degrees(4, 3, 'W'):.6f} {degrees(2, 1, 'S'):.6f})"
    except (struct.error, ValueError, KeyError, ZeroDivisionError):
        pass
    return taken, point


def file_rows(files: DataFrame, now: Column) -> DataFrame:
    """The manifest rows of those of `files` (see look) that aren't JSON and lie in a known folder."""
    rows = files.where(~F.col("is_json") & F.col("source_code").isNotNull())
    return rows.select(_file_id().alias("file_id"), "operation_code", "content_hash", F.col("path").alias("file_uri"), _chosen(F.col("ext"), MIME, "application/octet-stream").alias("mime_type"), "modality_code", "size_bytes", "captured_at", "captured_wkt", "is_scanned", now.alias("received_at"))


def _file_id() -> Column:
    return F.concat(F.lit("arq_"), F.substring("content_hash", 1, 16))


def operation_of(record: dict, folder: str | None) -> str | None:
    """The operation that a record names, upper-case with `_` for blanks and its year appended; else the folder's."""
    named = record.get("operacao") or record.get("operation")
    if not named:
        return folder
    year = record.get("ano") or record.get("year")
    code = str(named).strip().upper().replace(" ", "_")
    return f"{code}_{year}" if year else code


def one_record(record, folder: str | None) -> tuple[str | None, str, str]:
    """(operation, compact text, digest) of a record; ValueError if it isn't an object."""
    if not isinstance(record, dict):
        raise ValueError("a record is not an object")
    text = json.dumps(record, ensure_ascii=False, separators=(",", ":"))
    return operation_of(record, folder), text, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def open_json(content: bytes, folder: str | None) -> list[tuple]:
    """(operation, text, hash) of the records of one file; ValueError if it is broken."""
    loaded = json.loads(content.decode("utf-8-sig"))
    return [one_record(r, folder) for r in (loaded if isinstance(loaded, list) else [loaded])]


LOOKED = "path string, rel string, operation_code string, source_code string, ext string, stem string, is_json boolean, size_bytes long, content_hash string, modality_code string, is_scanned string, captured_at timestamp, captured_wkt string, records array<struct<operation_code:string,content_json:string,content_hash:string>>, detail string"


def _look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ("operation_code", "content_json", "content_hash")
    for pdf in frames:
        taken, points, opened, details = [], [], [], []
        for r in pdf.itertuples(index=False):
            at = where = found = detail = None
            if r.content is not None and r.is_json:
                try:
                    found = [dict(zip(names, x, strict=True)) for x in open_json(bytes(r.content), r.operation_code)]
                except (ValueError, RecursionError) as e:
                    detail = str(e)[:400]
            elif r.content is not None:
                at, where = exif(bytes(r.content))
            taken.append(at), points.append(where), opened.append(found), details.append(detail)
        yield pdf.drop(columns="content").assign(captured_at=pd.to_datetime(pd.Series(taken, index=pdf.index)), captured_wkt=points, records=opened, detail=details)


def look(files: DataFrame) -> DataFrame:
    """All that contents are read for, in one pass: digest, place and time of photos, whether a PDF is scanned, and the records of JSON files or why there
    are none (detail). Only contents of JSON files in known folders and of photos go to Python."""
    modality = _chosen(F.col("ext"), MODALITY, "BINARY")
    scanned = F.when(F.col("ext") == "pdf", F.when(F.locate("/Font", F.decode("content", "ISO-8859-1")) > 0, "N").otherwise("Y"))
    needed = F.when(F.col("source_code").isNotNull() & (F.col("is_json") | (modality == "IMAGE")), F.col("content"))
    rows = files.select("path", "rel", "operation_code", "source_code", "ext", "stem", "is_json", "size_bytes", "content_hash", modality.alias("modality_code"), scanned.alias("is_scanned"), needed.alias("content"))
    return rows.mapInPandas(_look, LOOKED)


def _open_cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for r in pdf.itertuples(index=False):
            got, detail = (None, None, None), None
            try:
                text = arrays.body(bytes(r.text).decode("utf-8"), r.record, r.is_array, r.is_closed)
                if text is not None:
                    got = one_record(json.loads(text), r.operation_code)
            except (ValueError, RecursionError) as e:
                detail = str(e)[:400]
            rows.append((r.path, r.record, *got, detail, hashlib.sha256(bytes(r.text)).hexdigest()))
        yield pd.DataFrame(rows, columns=["path", "record", "operation_code", "content_json", "content_hash", "detail", "digest"])


def look_large(spark: SparkSession, landing: str, files: DataFrame, whole: int = WHOLE) -> DataFrame:
    """path, operation_code, content_json, content_hash of the records of the JSON files in `files` with more than `whole` bytes. A file in which anything is
    broken has one row instead, with the first fault as detail and a digest (over those of its records) as content_hash."""
    named = files.where("is_json and source_code is not null").where(F.col("size_bytes") > whole).select("path", "operation_code")
    # Addresses come as URLs from one reader and as paths from the other.
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
    found = arrays.records(arrays.pieces(spark, landing, whole)).withColumn("_p", plain(F.col("path"))).drop("path").join(named.withColumn("_p", plain(F.col("path"))), "_p")
    cut = stages.stored(found.select("path", "record", "text", "is_array", "is_closed", "operation_code").mapInPandas(_open_cut, "path string, record long, operation_code string, content_json string, content_hash string, detail string, digest string").join(found.select("path", "is_array").distinct(), "path"), "cut")
    part = F.conv(F.substring("digest", 1, 15), 16, 10).cast("decimal(38,0)")
    state = cut.groupBy("path").agg(F.min_by("detail", F.when(F.col("detail").isNotNull(), F.col("record"))).alias("detail"), F.count_if(F.col("content_json").isNull() & F.col("detail").isNull()).alias("n_ends"), F.first("is_array").alias("is_array"), F.sha2(F.concat_ws("|", F.count("*"), F.sum(part * (F.col("record") % 1_000_003 + 1))), 256).alias("digest"))
    broken = state.withColumn("detail", F.when(F.col("detail").isNull() & F.col("is_array") & (F.col("n_ends") != 1), F.lit("the array does not end")).otherwise(F.col("detail"))).where("detail is not null")
    good = cut.where("content_json is not null").join(broken, "path", "left_anti").select("path", "operation_code", "content_json", "content_hash", F.lit(None).cast("string").alias("detail"))
    return good.unionByName(broken.join(named, "path").select("path", "operation_code", F.lit(None).cast("string").alias("content_json"), F.col("digest").alias("content_hash"), "detail"))


def ingest(spark: SparkSession, store: TableStore, landing: str, sources: dict[str, str], at: datetime | None = None, whole: int = WHOLE) -> dict:
    """Opens the landing area into raw_receipt, file_manifest and reject, and adds a row to ingest_run. Running it again adds nothing but that row."""
    began = time.time()
    for name, schema in (("raw_receipt", RECEIPT), ("file_manifest", FILE), ("reject", REJECT), ("ingest_run", RUN)):
        store.create(name, spark.createDataFrame([], schema).schema)
    now = F.lit(at or datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp")
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_FILES)}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return _ingest(spark, store, landing, sources, at, now, began, whole)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _ingest(spark, store, landing, sources, at, now, began, whole) -> dict:
    looked = stages.stored(look(scan(spark, landing, sources, whole)), "looked")  # contents are read here and nowhere else, but for large JSON files
    seen = looked.drop("records", "detail")
    new_files = store.append_new("file_manifest", file_rows(seen, now), ["file_id"], ["file_uri"])
    # A record's file is the one beside it with the same name; of several with that name, the first by path.
    beside = seen.where(~F.col("is_json") & F.col("source_code").isNotNull()).groupBy("stem").agg(F.min(F.struct("path", _file_id().alias("file_id"), "modality_code")).alias("f"))
    records = looked.where("records is not null").select("path", F.explode("records").alias("r")).select("path", "r.operation_code", "r.content_json", "r.content_hash", F.lit(None).cast("string").alias("detail"))
    faults = looked.where("detail is not null").select("path", "operation_code", F.lit(None).cast("string").alias("content_json"), "content_hash", "detail")
    opened = records.unionByName(faults)
    if not seen.where("is_json and source_code is not null").where(F.col("size_bytes") > whole).isEmpty():
        opened = stages.stored(opened.unionByName(look_large(spark, landing, seen, whole)), "opened")
    files = seen.select("path", "source_code", "stem", "size_bytes").join(beside, "stem", "left").select("path", "source_code", "size_bytes", F.col("f.file_id").alias("file_id"), F.coalesce("f.modality_code", F.lit("JSON")).alias("modality_code"))
    opened = opened.join(files, "path")
    short = lambda *parts: F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
    receipt_id = F.concat(F.lit("rcp_"), short("source_code", "content_hash", F.coalesce("file_id", F.lit(""))))
    receipts = opened.where("content_json is not null").select(receipt_id.alias("receipt_id"), "source_code", "operation_code", "modality_code", "content_json", "content_hash", F.col("path").alias("origin_uri"), "file_id", now.alias("received_at"))
    new_receipts = store.append_new("raw_receipt", receipts, ["receipt_id"], ["origin_uri"])
    broken = opened.where("content_json is null").select(F.concat(F.lit("rej_"), short("path", "content_hash")).alias("reject_id"), F.col("path").alias("origin_uri"), F.lit("JSON_INVALID").alias("reason_code"), "detail", "content_hash", "size_bytes", now.alias("received_at"))
    lost_path = seen.where("source_code is null")
    astray = lost_path.select(F.concat(F.lit("rej_"), F.substring(F.sha2(F.concat_ws("|", "path", "content_hash"), 256), 1, 16)).alias("reject_id"), F.col("path").alias("origin_uri"), F.lit("PATH_INVALID").alias("reason_code"), F.substring(F.concat(F.lit("no known folders: "), F.col("rel")), 1, 400).alias("detail"), "content_hash", "size_bytes", now.alias("received_at"))
    rejected = store.append_new("reject", broken.unionByName(astray), ["reject_id"], ["origin_uri"])
    counts = reconcile(seen, opened, store).first()
    run = ("ing_" + hashlib.sha256(f"{datetime.now(timezone.utc).isoformat()}|{landing}|{uuid.uuid4()}".encode()).hexdigest()[:16], landing, counts["n_seen"], counts["n_recorded"], counts["n_duplicate"], counts["n_lost"], new_files, new_receipts, rejected, time.time() - began, at or datetime.now(timezone.utc).replace(tzinfo=None))
    store.append("ingest_run", spark.createDataFrame([run], RUN))
    return dict(zip([c.split()[0] for c in RUN.split(", ")], run, strict=True))


def reconcile(seen: DataFrame, opened: DataFrame, store: TableStore) -> DataFrame:
    """One row: files seen, with a row under their own address, duplicates (all of their content known from elsewhere) and lost ones."""
    owned = store.read("raw_receipt").select(F.col("origin_uri").alias("path")).unionByName(store.read("file_manifest").select(F.col("file_uri").alias("path"))).unionByName(store.read("reject").select(F.col("origin_uri").alias("path"))).distinct().withColumn("owned", F.lit(True))
    known = store.read("raw_receipt").select("content_hash").unionByName(store.read("file_manifest").select("content_hash")).distinct().withColumn("known", F.lit(True))
    parts = opened.where("content_json is not null").select("path", "content_hash").unionByName(seen.where(~F.col("is_json")).select("path", "content_hash"))
    held = parts.join(known, "content_hash", "left").groupBy("path").agg(F.min(F.coalesce("known", F.lit(False))).alias("all_known"))
    state = seen.select("path").join(owned, "path", "left").join(held, "path", "left")
    recorded = F.coalesce("owned", F.lit(False))
    duplicate = ~recorded & F.coalesce("all_known", F.lit(False))
    return state.agg(F.count("*").alias("n_seen"), F.count_if(recorded).alias("n_recorded"), F.count_if(duplicate).alias("n_duplicate"), F.count_if(~recorded & ~duplicate).alias("n_lost"))


def pending_paths(seen: DataFrame, store: TableStore) -> DataFrame:
    """Files whose address and whose content are both unknown: what a run would add."""
    addresses = store.read("raw_receipt").select(F.col("origin_uri").alias("path")).unionByName(store.read("file_manifest").select(F.col("file_uri").alias("path"))).unionByName(store.read("reject").select(F.col("origin_uri").alias("path")))
    return seen.select("path", "content_hash").join(addresses.distinct(), "path", "left_anti").join(store.read("file_manifest").select("content_hash").distinct(), "content_hash", "left_anti")
