"""Records of JSON files of any size, cut where records end, so that several tasks read one file.

Spark's text reader gives a file in ranges of bytes and each range in pieces that end with a closing brace. Runs of them, in the order of the reader, are
stored as blocks. Whether a block begins inside a string depends on the quotes before it, and how deep it lies on the brackets before it; each is a sum,
so blocks are summed under both beginnings at once, the few blocks of a file one after the other, and what holds in each follows. Where the depth is back
at that of the array, a record ends. Records travel between tasks only where they go over the end of a block.

A file whose first sign is `[` is taken for an array of objects, any other for one object. Texts come as they stand, with what separates records
before them; whether they are JSON is for the reader to say (`body`). A record must fit into a task, a file need not. A byte-order mark is left
out. An empty file has no pieces, thus no rows.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalake.operators.sized import small
from stratalake.operators.stages import folder, stored

_FIRST, _NEXT, _END, _EMPTY = (re.compile(p) for p in (r"[ \t\n\r]*\[[ \t\n\r]*(?=\{)", r"[ \t\n\r]*,[ \t\n\r]*(?=\{)", r"[ \t\n\r]*\][ \t\n\r]*\Z", r"[ \t\n\r]*\[[ \t\n\r]*\][ \t\n\r]*\Z"))
_BLANK = re.compile(rb"[ \t\n\r\xef\xbb\xbf]*")
_SIGNS, _DEEPER = np.zeros(256, bool), np.zeros(256, np.int64)
_SIGNS[list(b'"\\{}[]')] = True
_DEEPER[list(b"{[")], _DEEPER[list(b"}]")] = 1, -1

BLOCK_BYTES = 1 << 20
_BLOCK = pa.schema(
    [("path", pa.string()), ("start", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("text", pa.binary()), ("quotes", pa.int64()), ("sign", pa.string())]
    + [(f"{c}{k}", t) for k in (0, 1) for c, t in (("t", pa.int64()), ("e", pa.list_(pa.int32())), ("d", pa.list_(pa.int32())), ("n", pa.map_(pa.int32(), pa.int64())))]
)
_BLOCK_DDL = "path string, start long, at long, size long, text binary, quotes long, sign string, " + ", ".join(f"t{k} long, e{k} array<int>, d{k} array<int>, n{k} map<int,long>" for k in (0, 1))


def pieces(spark: SparkSession, landing: str, over: int = -1, glob: str = "*.json") -> DataFrame:
    """path, start (of the range), at (order within it), size (of the file), piece (without its closing brace), of files with more than `over` bytes."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "}").text(landing)
    return read.where(F.col("_metadata.file_size") > over).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("piece"))


def _signs(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the quotes and brackets of a text that no backslash takes the meaning from; a closing brace always counts, as pieces end there."""
    at = np.flatnonzero(_SIGNS[text])
    sign = text[at]
    slash = sign == 92
    if not slash.any():
        return at, sign
    index = np.arange(len(at))
    follows = np.zeros(len(at), bool)
    follows[1:] = slash[:-1] & (at[1:] == at[:-1] + 1)
    before = index - np.maximum.accumulate(np.where(follows, 0, index))  # backslashes right before
    kept = ~slash & ((before % 2 == 0) | (sign == 125))
    return at[kept], sign[kept]


def _block(parts: list[bytes | memoryview]) -> dict:
    """What a run of pieces holds, if it begins outside of a string (0) or inside (1): its quotes, by how much it ends deeper, the places of closing braces
    outside of strings and how deep it is after each, and how many there are of each depth."""
    raw = b"}".join(parts) + b"}"
    text = np.frombuffer(raw, np.uint8)
    at, sign = _signs(text)
    inside = np.cumsum(sign == 34) % 2
    deeper = _DEEPER[sign]
    found = {"text": raw, "quotes": int((sign == 34).sum()), "sign": raw[_BLANK.match(raw).end() :][:1].decode("latin-1")}
    for begins in (0, 1):
        depth = np.cumsum(deeper * (inside == begins))
        ends = (sign == 125) & (inside == begins)
        levels, counts = np.unique(depth[ends], return_counts=True)
        found |= {f"t{begins}": int(depth[-1]), f"e{begins}": at[ends].astype(np.int32), f"d{begins}": depth[ends].astype(np.int32), f"n{begins}": list(zip(levels.tolist(), counts.tolist(), strict=True))}
    return found


def _blocks(batches):
    """Pieces as they come from a reader, those of a range together and in order, as blocks of about BLOCK_BYTES."""
    key, parts, size = None, [], 0

    def block():
        row = {"path": key[0], "start": key[1], "at": key[3], "size": key[2]} | _block(parts)
        return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _BLOCK], schema=_BLOCK)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        paths, starts, ats, sizes, texts = (batch.column(c) for c in ("path", "start", "at", "size", "piece"))
        new = pc.or_(pc.not_equal(paths.slice(1), paths.slice(0, n - 1)), pc.not_equal(starts.slice(1), starts.slice(0, n - 1))).to_numpy(zero_copy_only=False)
        runs = np.concatenate([[0], np.flatnonzero(new) + 1, [n]]).tolist()
        for lo, hi in zip(runs[:-1], runs[1:], strict=True):
            own = (paths[lo].as_py(), starts[lo].as_py(), sizes[lo].as_py())
            if parts and (key[:3] != own or size >= BLOCK_BYTES):
                yield block()
                parts, size = [], 0
            if not parts:
                key = (*own, ats[lo].as_py())
            more = texts.slice(lo, hi - lo).to_pylist()
            parts += more
            size += sum(map(len, more)) + len(more)
    if parts:
        yield block()


def _stretches(batches):
    """(block, its text, where stretches of it begin and end, whether each is closed, whether each is a whole record) of blocks with the places where records
    end. What follows the last of these is a stretch, too. A stretch is a whole record, but for one that other blocks hold a part of."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            text = row["text"].as_buffer()
            row = {k: v.as_py() for k, v in row.items() if k not in ("text", "ends")}
            size = text.size - row["is_bare"]
            ends = batch.column("ends")[i].values.to_numpy().astype(np.int64) + 1
            marks = np.concatenate([[0], ends[ends <= size], [size]])
            closed = np.arange(len(marks) - 1) < len(marks) - 2
            whole = closed.copy()
            whole[0] &= row["is_new"]
            yield row, text, marks, closed, whole


def _whole(batches):
    for row, text, marks, _, whole in _stretches(batches):
        found = np.flatnonzero(whole)
        n = len(found)
        if n:  # they follow each other without a gap
            texts = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(marks[found[0] : found[-1] + 2].astype(np.int32)), text])
            yield pa.RecordBatch.from_arrays([pa.repeat(row["path"], n), pa.array(row["done"] + found), texts, pa.repeat(row["is_array"], n), pa.repeat(True, n)], names=["path", "record", "text", "is_array", "is_closed"])


def _parts(batches):
    for row, text, marks, closed, whole in _stretches(batches):
        found = np.flatnonzero(~whole & (marks[1:] > marks[:-1]))
        n = len(found)
        if n:
            texts = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(marks[found + 1] - marks[found])]).astype(np.int32)), pa.py_buffer(b"".join(memoryview(text)[marks[k] : marks[k + 1]] for k in found))])
            yield pa.RecordBatch.from_arrays([pa.repeat(row["path"], n), pa.array(row["done"] + found), texts, pa.repeat(row["is_array"], n), pa.array(closed[found]), pa.repeat(row["start"], n), pa.repeat(row["at"], n)], names=["path", "record", "text", "is_array", "is_closed", "start", "at"])


def records(cut: DataFrame) -> DataFrame:
    """path, record (from 0), text (binary, as it stands), is_array, is_closed (false for what follows the last record) of the files in `cut`: pieces() as it
    is, or filtered, since those of a range must stand together and in order."""
    blocks = stored(cut.select("path", "start", "at", "size", F.col("piece").cast("binary").alias("piece")).mapInArrow(_blocks, _BLOCK_DDL), "blocks")
    before, all_of = Window.partitionBy("path").orderBy("start", "at").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("path")
    order = F.struct("start", "at")
    begun = blocks.select("path", "start", "at", "size", F.octet_length("text").alias("bytes"), "quotes", "sign", "t0", "t1", "n0", "n1").withColumn("begins", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    begun = begun.withColumn("base", F.coalesce(F.sum(F.when(F.col("begins") == 1, F.col("t1")).otherwise(F.col("t0"))).over(before), F.lit(0)))
    # Each piece stands for one brace more than it holds, but the last one of a file that doesn't end with one (a byte-order mark is left out, too).
    spare = F.first("size").over(all_of) - F.sum("bytes").over(all_of)
    begun = begun.withColumn("is_array", F.min_by("sign", order).over(all_of) != "{").withColumn("is_bare", spare.isin(-1, 2) & (order == F.max(order).over(all_of)))
    begun = begun.withColumn("level", F.col("is_array").cast("int") - F.col("base"))  # how deep from its start on a block is where records end
    ends = F.coalesce(F.try_element_at(F.when(F.col("begins") == 1, F.col("n1")).otherwise(F.col("n0")), F.col("level").cast("int")), F.lit(0))
    begun = begun.withColumn("done", F.coalesce(F.sum(ends).over(before), F.lit(0))).withColumn("is_new", (order == F.min(order).over(all_of)) | ((F.col("begins") == 0) & (F.col("level") == 0)))
    placed = blocks.select("path", "start", "at", "text", "e0", "d0", "e1", "d1").join(small(begun.select("path", "start", "at", "begins", "level", "is_array", "is_bare", "done", "is_new")), ["path", "start", "at"])
    placed = placed.select("path", "start", "at", "text", F.when(F.col("begins") == 1, F.filter("e1", lambda e, i: F.get("d1", i) == F.col("level"))).otherwise(F.filter("e0", lambda e, i: F.get("d0", i) == F.col("level"))).alias("ends"), "is_array", "is_bare", "done", "is_new")
    whole = placed.mapInArrow(_whole, "path string, record long, text binary, is_array boolean, is_closed boolean")
    parts = placed.mapInArrow(_parts, "path string, record long, text string, is_array boolean, is_closed boolean, start long, at long")
    parts = parts.groupBy("path", "record").agg(F.sort_array(F.collect_list(F.struct("start", "at", "text"))).alias("_p"), F.first("is_array").alias("is_array"), F.max("is_closed").alias("is_closed"))
    return whole.unionByName(parts.select("path", "record", F.array_join(F.transform("_p", lambda p: p["text"]), "").cast("binary").alias("text"), "is_array", "is_closed"))


def whole_arrays(rows: DataFrame, text: Column, part: Column, name: str) -> str:
    """Writes the JSON texts of `rows` as one array file for each value of `part`, whose rows a task must hold; the folder."""
    path = f"{folder(rows.sparkSession)}/{uuid.uuid4().hex}-{name}"
    lines = rows.groupBy(part.alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(text), ",\n"), F.lit("]")).alias("value"))
    lines.write.partitionBy("part").text(path)
    return path


def objects(found: DataFrame) -> DataFrame:
    """path, record, text (string) of the records of arrays that are known to be whole; what other files hold is for `body` to judge."""
    return found.where("is_closed").select("path", "record", F.regexp_replace(F.col("text").cast("string"), r"^[ \t\n\r,\[]+", "").alias("text"))


def body(text: str, record: int, is_array: bool, is_closed: bool) -> str | None:
    """The JSON text of a row of records(), None for the end of a file; ValueError if what surrounds it isn't that of an array or one object."""
    if is_closed:
        if not is_array:
            if record:
                raise ValueError("text after the object")
            return text
        lead = (_NEXT if record else _FIRST).match(text)
        if not lead:
            raise ValueError(f"record {record}: no object where one is due")
        return text[lead.end() :]
    if is_array and (_END if record else _EMPTY).match(text):
        return None
    if not is_array and record and not text.strip(" \t\n\r"):
        return None
    raise ValueError(f"record {record}: the text breaks off, or goes on after its end")
