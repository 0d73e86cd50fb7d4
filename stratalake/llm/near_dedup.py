"""MinHash near-deduplication with sequential Bayesian verification.

Distinct shingle sets (copies collapse by a digest of the full set) get signatures; bands of the signatures put sets into buckets.
Candidate pairs are compared a batch of hashes at a time and dropped as soon as the posterior probability that their
similarity reaches the threshold falls below the chosen miss probability; survivors are confirmed on their full sets.

Which pairs are compared. First each set with the least one of each of its buckets: as many pairs as bucket rows, whatever the size of
the bucket. Links between sets already connected can't change a component, so what remains are the buckets that
still hold several components, and in these all pairs across components are compared, in blocks of BLOCK x BLOCK within tasks, full
sets included; only links leave a task. No pair of a bucket that could join two components is left out.

Sets have ids of their own, so rows that share a doc_id but not a text are told apart, and a doc_id may be of any type that has an order.

Defined cases: null or empty texts, and those without words, have no shingle, link with nothing and are their own component; a text with
fewer words than a shingle has its whole sequence as its one shingle; repeated rows and copies share a component; a row with a
null doc_id is linked with nothing, has a null component and is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.llm.common import U64, bounded, components, mix64, partitions_for, shingles, table, text_slices, whole_numbers, word_hashes, written

BLOCK = 256
BROADCAST_IDS = 500_000  # ids are broadcast up to this number (8 MB)
BROADCAST_BYTES = 16_000_000  # and these bytes as text, joined by a shuffle beyond either
CROSS_ROWS = 20_000  # rows with full sets that a task compares, about


@dataclass(frozen=True)
class Plan:
    """Shingle width, similarity threshold in percent, bands x rows of the signature, hashes a comparison step, miss probability a step.

    A pair at the threshold shares no band with probability (1 - s^rows)^bands, under 1e-4 in both plans below."""

    width: int
    percent: int
    bands: int
    rows: int
    step: int
    miss: float

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


CONTRACT = Plan(3, 85, 20, 6, 20, 1e-6)
DEFAULT = Plan(5, 80, 24, 5, 20, 1e-6)


def least_matches(plan: Plan) -> list[tuple[int, int]]:
    """(hashes compared, least matches to go on): with a uniform prior the posterior of the similarity after m matches in n is
    Beta(m + 1, n - m + 1), and it lies above the threshold with probability P(Binomial(n + 1, threshold) <= m)."""
    t, out = plan.percent / 100, []
    for n in range(plan.step, plan.hashes + 1, plan.step):
        total, m = 0.0, -1
        while total < plan.miss:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def set_of(words: np.ndarray, width: int) -> np.ndarray:
    return np.unique(shingles(words, width))


def digest_of(values: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(hashlib.md5(values.tobytes()).digest(), np.int64)
    return int(d[0]), int(d[1])


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """MinHash signatures (sets x hashes, uint32) of non-empty sets."""
    x = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    seeds = mix64(np.arange(1, 2 * hashes + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    out = np.empty((hashes, len(sets)), np.uint32)
    for i in range(hashes):
        out[i] = np.minimum.reduceat(((x * (seeds[2 * i] | U64(1)) + seeds[2 * i + 1]) >> U64(32)).astype(np.uint32), starts)
    return out.T


def _features(plan: Plan):
    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                words, rows = word_hashes(texts)
                sets = [set_of(words[rows[i] : rows[i + 1]], plan.width) for i in range(len(texts))]
                full = [s for s in sets if len(s)]
                sigs = iter(np.ascontiguousarray(signatures(full, plan.hashes))) if full else iter(())
                marks = [digest_of(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array([next(sigs).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "n", "fp1", "fp2", "sig"],
                )

    return run


def _matrix(column: pa.Array, hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), hashes)


def band_keys(sigs: np.ndarray, plan: Plan) -> np.ndarray:
    """Bucket keys, bands x signatures."""
    sigs, out = sigs.astype(U64), []
    for b in range(plan.bands):
        key = np.full(len(sigs), U64(b + 1))
        for r in range(plan.rows):
            key = mix64(key * U64(0x9E3779B97F4A7C15) + sigs[:, b * plan.rows + r])
        out.append(key.view(np.int64))
    return np.stack(out)


def _bands(plan: Plan):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                keys = band_keys(_matrix(part.column("sig"), plan.hashes), plan)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.concat_arrays([part.column("id")] * plan.bands) if n else part.column("id")], names=["key", "id"])

    return run


def alike(a: np.ndarray, b: np.ndarray, least: list[tuple[int, int]], step: int) -> np.ndarray:
    """Indices of the rows of a that can still reach the threshold with the rows of b, compared a step of hashes at a time."""
    live, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for n, m in least:
        if not len(live):
            break
        matches = matches + (a[live, n - step : n] == b[live, n - step : n]).sum(axis=1, dtype=np.int32)
        good = matches >= m
        live, matches = live[good], matches[good]
    return live


def _prune(plan: Plan):
    least = least_matches(plan)

    def run(batches):
        for batch in batches:
            live = pa.array(alike(_matrix(batch.column("sig_a"), plan.hashes), _matrix(batch.column("sig_b"), plan.hashes), least, plan.step))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(live), batch.column("b").take(live)], names=["a", "b"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = 0 if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)) else len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                words, rows = word_hashes(texts)
                sets = [set_of(words[rows[i] : rows[i + 1]], width) for i in range(len(texts))]
                marks = [digest_of(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "fp1", "fp2", "values"])

    return run


def with_ids(docs: DataFrame, column: str, ids: DataFrame, how: str) -> DataFrame:
    """docs joined (left_semi or left_anti) with the column `id` of ids, which is broadcast where it is small enough."""
    ids = ids.select(F.col("id").alias("_with_id"))
    n, size = ids.limit(BROADCAST_IDS + 1).agg(F.count("*"), F.sum(F.octet_length(F.col("_with_id").cast("string")))).first()
    few = n <= BROADCAST_IDS and (size or 0) <= BROADCAST_BYTES
    return docs.join(F.broadcast(ids) if few else ids, F.col(column) == F.col("_with_id"), how)


def full_sets(ids: DataFrame, docs: DataFrame, unique: DataFrame, plan: Plan, name: str) -> DataFrame:
    """(id, values) of the sets with the given ids, made again from the texts of the documents that carry them."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    involved = written(ids.join(unique.select("id", "doc", "fp1", "fp2"), "id"), name + "-involved")
    sets = with_ids(docs.select("doc_id", "text"), "doc_id", involved.select(F.col("doc").alias("id")).distinct(), "left_semi").mapInArrow(_sets(plan.width), f"doc_id {id_type}, fp1 long, fp2 long, values binary")
    sets = sets.withColumnRenamed("doc_id", "doc").join(involved, ["doc", "fp1", "fp2"]).select("id", "values")
    return written(sets.dropDuplicates(["id"]), name + "-sets")


def confirm(pairs: DataFrame, docs: DataFrame, unique: DataFrame, plan: Plan, name: str) -> DataFrame:
    """The pairs (a, b) of set ids whose full sets reach the threshold."""
    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), docs, unique, plan, name)
    left, right = sets.select(F.col("id").alias("a"), F.col("values").alias("set_a")), sets.select(F.col("id").alias("b"), F.col("values").alias("set_b"))
    return written(pairs.join(left, "a").join(right, "b").mapInArrow(_verify(plan.percent), "a long, b long"), name + "-links")


def _cross(plan: Plan):
    """Links across components among the rows of each (key, i, j), confirmed on full sets; rows come sorted by these. A pair that shares
    several buckets is compared in that of its first band; components that a link joins count as one from then on."""
    least = least_matches(plan)

    def links(rows):
        key, ids, comps, blocks, sigs, sets = rows
        comps = comps.copy()
        firsts, seconds = np.flatnonzero(blocks[:, 0] == blocks[:, 2]), np.flatnonzero(blocks[:, 1] == blocks[:, 2])
        same = blocks[0, 0] == blocks[0, 1]
        for x in firsts:
            others = seconds[seconds > x] if same else seconds
            others = others[comps[others] != comps[x]]
            if len(others):
                others = others[alike(np.broadcast_to(sigs[x], (len(others), plan.hashes)), sigs[others], least, plan.step)]
            if not len(others):
                continue
            band = (sigs[others] == sigs[x]).reshape(len(others), plan.bands, plan.rows).all(axis=2).argmax(axis=1)
            others = others[band_keys(sigs[x : x + 1], plan)[band, 0] == key]
            if not len(others):
                continue
            values, sizes = np.concatenate([sets[y] for y in others]), np.array([len(sets[y]) for y in others])
            at = np.minimum(np.searchsorted(sets[x], values), len(sets[x]) - 1)
            both = np.add.reduceat((sets[x][at] == values).astype(np.int64), np.cumsum(sizes) - sizes)
            for y in others[100 * both >= plan.percent * (len(sets[x]) + sizes - both)]:
                if comps[y] != comps[x]:
                    comps[comps == comps[y]] = comps[x]
                    yield int(max(ids[x], ids[y])), int(min(ids[x], ids[y]))

    def out(found):
        cols = list(zip(*found, strict=True)) or [[], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    def run(batches):
        held, last = [], None  # rows of one (key, i, j), gathered until the next begins
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j")), strict=True))
            lo = 0
            while lo < len(keys):
                hi = lo
                while hi < len(keys) and keys[hi] == keys[lo]:
                    hi += 1
                if keys[lo] != last:
                    if held:
                        yield out(links(group(last, held)))
                    held, last = [], keys[lo]
                held.append(batch.slice(lo, hi - lo))
                lo = hi
        if held:
            yield out(links(group(last, held)))

    def group(key, parts):
        num = lambda c: np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts])
        sigs = np.concatenate([_matrix(p.column("sig"), plan.hashes) for p in parts])
        sets = [np.frombuffer(x.as_buffer(), U64) for p in parts for x in p.column("values")]
        return np.int64(key[0]), num("id"), num("component"), np.stack([num("i"), num("j"), num("block")], axis=1), sigs, sets

    return run


def classes(docs: DataFrame, plan: Plan = DEFAULT) -> DataFrame:
    """doc_id, n (size of its shingle set), fp1, fp2 (digest of the set) and component (least doc_id reachable) of every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id") if whole_numbers(docs) else "doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    features = written(docs.mapInArrow(_features(plan), f"doc_id {id_type}, n long, fp1 long, fp2 long, sig binary"), "features")
    unique = written(features.where("n > 0 and doc_id is not null").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig")).withColumn("id", F.monotonically_increasing_id()), "unique")
    bands = written(unique.select("id", "sig").mapInArrow(_bands(plan), "key long, id long"), "bands")
    buckets = bands.groupBy("key").agg(F.min("id").alias("b"), F.max("id").alias("most")).where("b < most").select("key", "b")
    stars = written(bands.join(buckets, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct(), "stars")
    sigs = unique.select("id", "sig")
    left, right = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))
    likely = written(stars.join(left, "a").join(right, "b").mapInArrow(_prune(plan), "a long, b long"), "likely")
    links = confirm(likely, docs, unique, plan, "star")
    labels = components(links, "star")
    # Buckets that still hold several components.
    members = bands.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = written(members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("key", "size"), "mixed")
    if not mixed.isEmpty():
        part = F.ceil(F.col("size") / BLOCK).cast("int")
        spread = members.join(mixed, "key").withColumn("parts", part).withColumn("block", F.pmod(F.xxhash64("id"), part).cast("int"))
        spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        spread = spread.select("key", "id", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        sets = full_sets(members.join(mixed, "key", "left_semi").select("id").distinct(), docs, unique, plan, "rest")
        n = partitions_for(docs.sparkSession, mixed.agg(F.sum(F.col("size") * F.ceil(F.col("size") / BLOCK))).first()[0], CROSS_ROWS)
        spread = spread.join(sigs.join(sets, "id"), "id").repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
        rest = written(spread.mapInArrow(_cross(plan), "a long, b long").distinct(), "rest")
        if not rest.isEmpty():
            labels = components(links.unionByName(rest), "all")
    linked = unique.select("id", "doc").join(labels, "id")
    least = linked.join(linked.groupBy("component").agg(F.min("doc").alias("least")), "component").select("id", "least")
    named = unique.select("fp1", "fp2", "id", "doc").join(least, "id", "left").select("fp1", "fp2", F.coalesce("least", "doc").alias("component"))
    out = features.select("doc_id", "n", "fp1", "fp2").join(named, ["fp1", "fp2"], "left")
    return out.select("doc_id", "n", "fp1", "fp2", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component"))


@bounded
def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"), CONTRACT)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


@bounded
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the least doc_id; of repeated rows of it, one."""
    found = written(classes(docs, DEFAULT), "classes")
    out = with_ids(docs, "doc_id", found.where("doc_id <> component").select(F.col("doc_id").alias("id")).distinct(), "left_anti")
    repeated = written(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("id")), "repeated")
    if repeated.isEmpty():
        return out
    return with_ids(out, "doc_id", repeated, "left_anti").unionByName(with_ids(out, "doc_id", repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS reached FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.reached = e.a),
m AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id IS NOT DISTINCT FROM m.component_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.id = d.doc_id
"""
