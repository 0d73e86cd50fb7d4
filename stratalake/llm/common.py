"""What the operators share: written intermediates, vectorised words and shingles, components."""

from __future__ import annotations

import atexit
import functools
import gc
import os
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 512 * 1024
BATCH_ROWS = 2048
U64 = np.uint64


# ------------------------------------------------------------------ written intermediates


def scratch(spark: SparkSession) -> str:
    """The folder for intermediates: spark.checkpoint.dir; where unset, the warehouse on a cluster and a
    temporary folder in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    made = tempfile.mkdtemp(prefix="stratalake-")
    atexit.register(shutil.rmtree, made, True)
    spark.conf.set("spark.checkpoint.dir", "file://" + made)
    return "file://" + made


def run_folder(spark: SparkSession) -> str:
    """Where this application's intermediates lie; clear_scratch() deletes it."""
    return f"{scratch(spark)}/stratalake/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet under scratch() and reads it back: lineage ends there, lost executors cost nothing before it."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes written frames, once all that was made from them is written itself. The driver's JVM is asked to collect its garbage, as Spark
    frees the shuffle files of finished jobs only then."""
    for df in frames:
        _delete(df.sparkSession, df._stored_at)
    gc.collect()
    frames[0].sparkSession._jvm.System.gc()


def clear_scratch(spark: SparkSession) -> bool:
    """Deletes all intermediates of this application, once no frame made from them is needed any more; whether there were any."""
    return _delete(spark, run_folder(spark))


def bounded(entry):
    """Decorates an operator's query or stage (spark, ...): batches to and from Python workers have BATCH_ROWS rows at most. Spark's default of 10,000
    makes buffers of tens of megabytes of text, outside the heap, for each task. The setting stays, as results are computed later."""

    @functools.wraps(entry)
    def run(spark, *args):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return entry(spark, *args)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id, modulus: int, remainder: int = 2):
    """crc32 of doc_id as text, mod modulus, equals remainder; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def whole_numbers(docs: DataFrame, column: str = "doc_id") -> bool:
    return isinstance(docs.schema[column].dataType, IntegralType)


def partitions_for(spark: SparkSession, rows: int | None, each: int) -> int:
    """The session's number of shuffle partitions, or more where each would get over `each` of so many rows (or bytes)."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows or 0) // each))


# ------------------------------------------------------------------ batches


def runs(batches, columns: tuple[str, ...]):
    """Batches of whole groups: rows that are equal in `columns`, which come together, lie in one batch. A group is held until it ends."""
    held: list = []
    whole = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches() if sum(p.num_rows for p in parts) else []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
        goes_on = held and all(held[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in columns)
        cut = int(new[-1]) + 1 if len(new) else 0
        if goes_on and cut == 0:
            held.append(batch)
            continue
        # What is held, with what of this batch belongs to complete groups; the last group may go on.
        yield from whole([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield from whole(held)


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Cuts a batch into runs of rows with at most `most` bytes of text, one row at least; nulls become empty."""
    texts = batch.column(column)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    lo, n = 0, len(sizes)
    while lo < n:
        base = ends[lo] - sizes[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(lo, hi - lo), texts.slice(lo, hi - lo)
        lo = hi


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string or binary array without nulls."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower-cases A-Z and nothing else."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and how many words lie before each row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _hash_block(data: np.ndarray, offsets: np.ndarray, tag=None) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, U64), rows
    lengths = ends - starts
    # Place of each byte in its word: the bytes of all words, laid end to end.
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    powers = np.ones(int(lengths.max()), U64)
    powers[1:] = U64(0x9E3779B97F4A7C15)
    powers = np.multiply.accumulate(powers)
    values = (data[place + np.repeat(starts, lengths)].astype(U64) + U64(1)) * powers[place]
    hashes = mix64(np.add.reduceat(values, first))
    return hashes if tag is None else (hashes & ~U64(15)) | tag(data, starts, ends), rows


def word_hashes(texts: pa.Array, tag=None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words of the rows, and row offsets into them. A text far longer than a slice is
    hashed in pieces cut at white space, so the working memory follows the longest word, not the text. tag, a function of (bytes,
    starts, ends), gives a number below 16 to put in the last four bits of each word's hash."""
    data, offsets = raw_bytes(texts)
    if len(data) <= 4 * SLICE_BYTES or len(texts) > 1:
        return _hash_block(lowered(data), offsets, tag)
    found, lo, n = [], 0, len(data)
    while lo < n:
        hi = min(n, lo + SLICE_BYTES)
        while hi < n:
            tail = data[hi : hi + 65536]
            gaps = np.flatnonzero((tail == 32) | ((tail >= 9) & (tail <= 13)))
            if len(gaps):
                hi += int(gaps[0])
                break
            hi += len(tail)
        piece = lowered(data[lo:hi])
        found.append(_hash_block(piece, np.array([0, len(piece)]), tag)[0])
        lo = hi
    words = np.concatenate(found)
    return words, np.array([0, len(words)])


_ODD = [U64((0xD1342543DE82EF95 * (2 * i + 3) + 0x2545F4914F6CDD1D * i) % 2**64 | 1) for i in range(16)]


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the `width`-word shingles of one text in order; of fewer words, one hash of the whole sequence; none of none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, U64)
    if n < width:
        out = np.array([0x1234567 + n], U64)
        for i in range(n):
            out = mix64(out * _ODD[15] + words[i : i + 1])
        return out
    total = words[: n - width + 1] * _ODD[0]
    for i in range(1, width):
        total = total + words[i : n - width + 1 + i] * _ODD[i]
    return mix64(total)


# ------------------------------------------------------------------ connected components


def components(links: DataFrame, name: str) -> DataFrame:
    """(id, component) for the ends of links (a, b): component is the smallest id reachable.

    Contraction: each vertex hooks to its least neighbour, edges are relabelled by the hooks, and equal or repeated edges go;
    the edges at least halve their vertices a round, so rounds grow with the logarithm of the longest chain. Every
    round is written to the shared folder. Hot vertices meet partial aggregates and joins that AQE can split only.
    Null ends and self-links are ignored; an empty table gives an empty one.
    """
    pair = lambda a, b: [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]
    edges = written(links.select(*pair(F.col("a"), F.col("b"))).where("a is not null and b is not null and a <> b").distinct(), name + "-e0")
    labels = written(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("component")), name + "-l0")
    for turn in range(1, 64):
        if edges.isEmpty():
            return labels
        hooks = written(edges.groupBy("a").agg(F.min("b").alias("to")), f"{name}-h{turn}")
        twice = hooks.alias("x").join(hooks.alias("y"), F.col("x.to") == F.col("y.a"), "left").select(F.col("x.a").alias("v"), F.coalesce("y.to", "x.to").alias("to"))
        twice = written(twice, f"{name}-t{turn}")
        up = lambda e, c: e.join(twice, F.col(c) == F.col("v"), "left").withColumn(c, F.coalesce("to", c)).drop("v", "to")
        edges = written(up(up(edges, "a"), "b").where("a <> b").select(*pair(F.col("a"), F.col("b"))).distinct(), f"{name}-e{turn}")
        labels = written(up(labels, "component"), f"{name}-l{turn}")
    raise RuntimeError("components did not settle in 63 rounds")


def shielded(docs: DataFrame, needed: list[str]):
    """(docs with every column but those needed under a name of ours, function that gives a frame with these columns back its own
    names and order), so that no column of the input clashes with an operator's."""
    inside = [c if c in needed else f"_shield{i}" for i, c in enumerate(docs.columns)]
    outside = docs.columns
    return docs.toDF(*inside), lambda df: df.select(*inside).toDF(*outside)


def extended(path: str) -> str:
    """A local path without its file: scheme, for libraries that open files themselves (tokenizer files on the image)."""
    return os.path.abspath(path.removeprefix("file://"))
