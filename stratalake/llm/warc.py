"""WARC archives: writing them, and reading them back by boundary-chain verification.

Writing. A record is one row of text whose line separator is the blank lines that end a record, so Spark's own writer, with its commit
protocol, makes the archives; they may be compressed.

Reading. Archives are cut at every version line, wherever it stands, and each cut is a candidate record whose header names its
successor. Offsets of the cuts are sums of lengths: within a split by the task that reads it, over the splits of a file by a window over
(file, split) totals. Candidates form chains within blocks of BLOCK bytes; pointer jumping then finds, from the start of each file,
the block entries that can be reached, and from these the records. A version line inside a payload begins no reachable record,
because the record around it points beyond it. Only offsets and digests travel, never payloads.

Defined cases: a null html is an empty payload; of rows with the same payload and the same largest page_id one is the response, the others revisit
it; a null page_id counts as the least; an empty table gives no archive and no row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalake.llm.common import bounded, run_folder, table, written

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
BLOCK = 8 << 20
EMPTY_DIGEST = base64.b32encode(hashlib.sha1(b"").digest()).decode()
CANDIDATE = "file string, split long, rel long, succ_rel long, head long, length long, page_id long, record_type string, refers_to long, claimed string, digest string"


# ------------------------------------------------------------------ writing


def _base32(hexes: pd.Series) -> pd.Series:
    return hexes.map(lambda x: base64.b32encode(bytes.fromhex(x)).decode())


def write_archives(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """Writes a record for each row of pages (page_id, url, html) under path. Rows are shuffled once, as digests; a row that repeats a
    payload, and only such a row, becomes a revisit record without its payload.

    pages must give the same rows in the same partitions when read twice, as files do."""
    base32 = F.pandas_udf(_base32, "string")
    own = pages.select(F.monotonically_increasing_id().alias("uid"), F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    first = own.groupBy("sha").agg(F.max(F.struct("page_id", "uid")).alias("best"), F.count("*").alias("n")).where("n > 1").select(F.col("sha").alias("s"), "best")
    revisits = written(own.select("uid", "page_id", "sha").join(first, F.col("sha") == F.col("s")).where(F.col("best.uid") != F.col("uid")).select("uid", F.col("best.page_id").alias("refers_to")), "revisits")
    one = F.lit(1)
    marked = own.join(revisits.withColumn("revisit", one), "uid", "left").withColumn("digest", base32("sha"))
    name = lambda c: F.concat(F.lit("<urn:stratalake:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x], F.lit("\r\n"))
    is_revisit = F.col("revisit").isNotNull()
    body = F.when(is_revisit, F.lit("")).otherwise(F.col("html"))
    record = F.concat(
        F.lit(VERSION),
        line("WARC-Type: ", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID: ", name(F.col("page_id"))),
        line("WARC-Target-URI: ", F.translate("url", "\r\n", "")),
        line("WARC-Payload-Digest: sha1:", F.col("digest")),
        line("X-Payload-Length: ", F.octet_length("html").cast("string")),
        F.when(is_revisit, line("WARC-Refers-To: ", name(F.col("refers_to")))).otherwise(F.lit("")),
        F.when(is_revisit, line("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")).otherwise(F.lit("")),
        line("Content-Type: text/html; charset=utf-8"),
        line("Content-Length: ", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )
    marked.select(record.alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


# ------------------------------------------------------------------ reading


HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")
_PAGE = re.compile(rb"<urn:stratalake:page:(-?\d+)>")


def parse_head(fragment: bytes) -> tuple[int, dict[bytes, bytes]] | None:
    """(length of the header with its blank line, its fields) of what follows a version line, or None if that is no header."""
    at, fields = 0, {}
    while True:
        if fragment.startswith(b"\r\n", at):
            return (at + 2, fields) if fields.get(b"content-length", b"").isdigit() else None
        m = HEADER.match(fragment, at)
        if not m:
            return None
        fields[m.group(1).strip().lower()] = m.group(2)
        at = m.end()


class _Open:
    """A candidate whose payload is still being read."""

    def __init__(self, row: list, missing: int):
        self.row, self.missing, self.sha = row, missing, hashlib.sha1()

    def feed(self, data: bytes) -> bool:
        data = data[: self.missing]
        self.sha.update(data)
        self.missing -= len(data)
        return self.missing == 0


def scan(fragments: Iterator[tuple[str, int, bytes]]) -> Iterator[list]:
    """Candidates and split totals of fragments (file, split, bytes between version lines) in reading order.

    A candidate is [file, split, rel, succ_rel, head, length, page_id, type, refers_to, claimed digest, digest], offsets relative to the first byte
    that the split read; its digest is null if its payload went on beyond the split. A total has rel -1 and the split's length in succ_rel."""
    magic = VERSION.encode()
    now, at, waiting, first = None, 0, [], True

    def feed(data: bytes) -> list[list]:
        nonlocal waiting
        done = [o for o in waiting if o.feed(data)]
        waiting = [o for o in waiting if o.missing]
        return [[*o.row, base64.b32encode(o.sha.digest()).decode()] for o in done]

    for file, split, data in fragments:
        if (file, split) != now:
            if now:
                yield from ([*o.row, None] for o in waiting)
                yield [*now, -1, at, *[None] * 7]
            # A later split's line reader swallowed the version line before its first fragment.
            now, at, waiting, first = (file, split), len(magic) if split > 0 else 0, [], True
        if not first:
            yield from feed(magic)
        yield from feed(data)
        # No version line stands before the first fragment of a file.
        head = parse_head(data) if split > 0 or not first else None
        first = False
        if head:
            size, fields = head
            length = int(fields[b"content-length"])
            payload = fields.get(b"x-payload-length", b"")
            page, refers = (_PAGE.search(fields.get(k, b"")) for k in (b"warc-record-id", b"warc-refers-to"))
            row = [file, split, at - len(magic), at + size + length + 4, size, int(payload) if payload.isdigit() else length, int(page.group(1)) if page else None, fields.get(b"warc-type", b"").decode("ascii", "replace"), int(refers.group(1)) if refers else None, fields.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha1:")]
            one = _Open(row, length)
            if one.feed(data[size:]):
                yield [*row, base64.b32encode(one.sha.digest()).decode()]
            else:
                waiting.append(one)
        at += len(data) + len(magic)
    if now:
        yield from ([*o.row, None] for o in waiting)
        yield [*now, -1, at, *[None] * 7]


def _columns(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64()}[t]) for n, t in (x.strip().split(" ") for x in CANDIDATE.split(","))])


def _scan_batches(batches):
    def fragments():
        for batch in batches:
            files, splits = batch.column("file").to_pylist(), batch.column("split").to_pylist()
            for i, data in enumerate(batch.column("data")):
                yield files[i], splits[i], data.as_py()

    rows = []
    for row in scan(fragments()):
        rows.append(row)
        if len(rows) >= 5000:
            yield _columns(rows, _SCHEMA)
            rows = []
    yield _columns(rows, _SCHEMA)


def fragments_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, data): the bytes between version lines, in reading order within each split of each archive."""
    return spark.read.option("lineSep", VERSION).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("data"))


def follow(offs: np.ndarray, succs: np.ndarray, entry: int) -> list[int]:
    """Indices of the candidates on the chain that begins at offset entry; offs ascending."""
    found, at = [], entry
    while True:
        i = int(np.searchsorted(offs, at))
        if i >= len(offs) or offs[i] != at:
            return found
        found.append(i)
        at = int(succs[i])
        if at <= offs[i]:
            return found


def exits(offs: np.ndarray, succs: np.ndarray, block_end: int) -> np.ndarray:
    """For each candidate of a block, the first offset at or beyond the block's end, or off the candidates, that its chain leads to: pointer
    jumping over the block."""
    to = succs.copy()
    for _ in range(max(1, int(len(offs)).bit_length())):
        i = np.searchsorted(offs, to)
        i = np.minimum(i, len(offs) - 1)
        inside = (offs[i] == to) & (to < block_end)
        if not inside.any():
            break
        to = np.where(inside, to[i], to)
    return to


def _block_exits(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("off")
    return pd.DataFrame({"file": key[0], "off": pdf["off"].to_numpy(), "exit": exits(pdf["off"].to_numpy(), pdf["succ"].to_numpy(), (int(key[1]) + 1) * BLOCK)})


def _block_chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    entries = pdf.loc[pdf["entry"].notna(), "entry"]
    if entries.empty:
        return pd.DataFrame({"file": pd.Series([], dtype=str), "off": pd.Series([], dtype="int64")})
    pdf = pdf[pdf["off"].notna()].sort_values("off")
    offs = pdf["off"].to_numpy().astype(np.int64)
    found = follow(offs, pdf["succ"].to_numpy().astype(np.int64), int(entries.iloc[0]))
    return pd.DataFrame({"file": key[0], "off": offs[found]})


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, off) of the candidates (file, off, succ) that the chain from offset 0 of their file passes."""
    block = F.floor(F.col("off") / BLOCK).cast("long")
    nodes = candidates.select("file", "off", "succ").withColumn("block", block)
    jumps = written(nodes.groupBy("file", "block").applyInPandas(_block_exits, "file string, off long, exit long"), "exits")
    # Entries of blocks: those that some candidate's chain leads to, and the start.
    targets = jumps.select("file", F.col("exit").alias("off")).distinct()
    step = jumps.join(targets, ["file", "off"], "left_semi").unionByName(jumps.where("off = 0")).distinct()
    step = written(step, "step0")
    found = written(jumps.where("off = 0").select("file", "off").distinct(), "reach0")
    count = found.count()
    for turn in range(1, 63):
        more = found.join(step, ["file", "off"]).select("file", F.col("exit").alias("off")).join(step.select("file", "off"), ["file", "off"], "left_semi")
        found = written(found.unionByName(more).distinct(), f"reach{turn}")
        now = found.count()
        if now == count:
            break
        count = now
        ahead = step.select(F.col("file").alias("f"), F.col("off").alias("exit"), F.col("exit").alias("far"))
        step = written(step.join(ahead, (F.col("file") == F.col("f")) & (step["exit"] == ahead["exit"]), "left").select("file", "off", F.coalesce("far", step["exit"]).alias("exit")), f"step{turn}")
    entries = found.select("file", F.col("off").alias("entry"), F.floor(F.col("off") / BLOCK).cast("long").alias("block"), F.lit(None).cast("long").alias("off"), F.lit(None).cast("long").alias("succ"))
    both = nodes.withColumn("entry", F.lit(None).cast("long")).select("file", "entry", "block", "off", "succ").unionByName(entries)
    return both.groupBy("file", "block").applyInPandas(_block_chain, "file string, off long")


def _join_pieces(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The digest of a payload whose fragments lie in several splits."""
    pdf = pdf.sort_values("at")
    start, length = int(pdf["payload_at"].iloc[0]), int(pdf["stored"].iloc[0])
    sha, at = hashlib.sha1(), start
    for piece_at, data in zip(pdf["at"], pdf["data"], strict=True):
        data = bytes(data) + VERSION.encode()
        lo = at - int(piece_at)
        piece = data[max(0, lo) : max(0, start + length - int(piece_at))]
        sha.update(piece)
        at += len(piece)
    return pd.DataFrame({"file": [key[0]], "off": [key[1]], "digest2": [base64.b32encode(sha.digest()).decode()]})


def _offset_fragments(batches):
    magic, now, at = len(VERSION), None, 0
    for batch in batches:
        rel = []
        for file, split, data in zip(batch.column("file").to_pylist(), batch.column("split").to_pylist(), batch.column("data"), strict=True):
            if (file, split) != now:
                now, at = (file, split), magic if split > 0 else 0
            rel.append(at)
            at += len(data.as_py()) + magic
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("split"), pa.array(rel, pa.int64()), batch.column("data")], names=["file", "split", "rel", "data"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path: file, off, page_id, record_type, refers_to, payload_bytes, payload_digest (bare base32 SHA-1), stored
    (whether it was computed from a stored payload) and sound (whether it equals the digest that the header claims)."""
    rows = written(fragments_of(spark, path).mapInArrow(_scan_batches, CANDIDATE), "candidates")
    # A split's first byte: the lengths of the splits before it in its file, plus the version line that the reader took between them.
    totals = rows.where("rel = -1").select("file", "split", F.col("succ_rel").alias("total"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file", "split", F.coalesce(F.sum(F.col("total") - F.lit(len(VERSION))).over(before), F.lit(0)).alias("start"))
    starts = written(starts, "starts")
    candidates = rows.where("rel >= 0").join(starts, ["file", "split"]).select("*", (F.col("start") + F.col("rel")).alias("off"), (F.col("start") + F.col("succ_rel")).alias("succ"))
    candidates = written(candidates.drop("split", "rel", "succ_rel", "start"), "offsets")
    records = candidates.join(reachable(candidates), ["file", "off"], "left_semi")
    broken = records.where("digest is null").select("file", F.col("off"), (F.col("off") + len(VERSION) + F.col("head")).alias("payload_at"), (F.col("succ") - 4).alias("ends"))
    broken = written(broken, "crossing")
    if not broken.isEmpty():
        pieces = fragments_of(spark, path).mapInArrow(_offset_fragments, "file string, split long, rel long, data binary").join(starts, ["file", "split"]).select("file", (F.col("start") + F.col("rel")).alias("at"), "data")
        # At most one record crosses the end of a split; its file and offsets pick the few fragments that it needs.
        needed = pieces.join(broken, "file").where("at < ends and at + length(data) + 10 > payload_at").select("file", "off", "payload_at", (F.col("ends") - F.col("payload_at")).alias("stored"), "at", "data")
        mended = needed.groupBy("file", "off").applyInPandas(_join_pieces, "file string, off long, digest2 string")
        records = records.join(mended, ["file", "off"], "left").withColumn("digest", F.coalesce("digest", "digest2")).drop("digest2")
    stored = F.col("record_type") != "revisit"
    digest = F.when(stored, F.col("digest")).otherwise(F.col("claimed"))
    return records.select("file", "off", "page_id", "record_type", "refers_to", F.col("length").alias("payload_bytes"), digest.alias("payload_digest"), stored.alias("stored"), (~stored | (F.col("digest") == F.col("claimed"))).alias("sound"))


@bounded
def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}-warc"
    write_archives(table(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS h, row_number() OVER () AS uid FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST, uid) AS place, max(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
 CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN first_id END AS refers_to FROM r
"""
