"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams by language are summed over the cluster; each language has one column of log probabilities. Columns are broadcast, a block of
languages at a time, and batches of texts are scored as sparse products in numpy: the rows of the matrix that their n-grams name, summed by text. Blocks
beyond the first go on from what the one before has found, so no number of languages is too large.

The classifier is fitted on a bounded sample: of each language the LANGUAGE_ROWS rows with the least hashes of doc_id, about, the same whatever the
partitioning.

Defined cases: null text, or text without a letter, is `und` with score 0; equal posteriors go to the language that sorts
first; rows with a null language are not learned from but are predicted; with no labelled row at all every text is `und`;
repeated rows are scored alike; an empty table gives an empty result; columns of the input other than those named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.llm.common import U64, bounded, held_out, mix64, shielded, table, text_slices

N_BUCKETS = 1 << 15
LANGUAGE_ROWS = 5_000  # bound on the labelled rows of a language that the classifier is fitted on
BLOCK_LANGUAGES = 256  # of a broadcast matrix: 64 MB of doubles at most
TAKEN = 1 << 21  # log probabilities taken from the matrix at once: 16 MB, whatever the number of languages
PIECE = 1 << 18  # code points scored at a time
NGRAMS = (1, 2, 3)

_LETTERS: dict = {}


def _letters() -> np.ndarray:
    """is-a-letter by code point."""
    if "table" not in _LETTERS:
        _LETTERS["table"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS["table"]


def _pieces(texts: list[str]):
    """Cuts texts into lists of (row, piece, whether it begins and ends the text) of about PIECE code points; a piece of a longer text begins with the
    last code points of the one before."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(len(text), 1), PIECE):
            held.append((row, text[at : at + PIECE], at == 0, at + PIECE >= len(text)))
            size += len(held[-1][1]) + 2
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def grams(texts: list[str], n_buckets: int = N_BUCKETS):
    """Yields (buckets, rows) of the n-grams of texts, by row within each yield, and at last (None, whether each text has a letter).

    Texts are lower-cased, every run of characters that aren't letters becomes one space, and one space stands at either end; n-grams
    of spaces only don't count.
    """
    letters, space = _letters(), np.array([32], np.uint32)
    has, carry = np.zeros(len(texts), bool), space
    for held in _pieces(texts):
        codes, owner, done = [], [], []
        for row, piece, begins, ends in held:
            own = np.frombuffer(piece.lower().encode("utf-32-le", "replace"), np.uint32)
            good = letters[own]
            has[row] |= bool(good.any())
            own = np.concatenate([space if begins else carry, np.where(good, own, np.uint32(32)), space[: int(ends)]])
            blank = own == 32
            keep = np.ones(len(own), bool)
            keep[1:] = ~(blank[1:] & blank[:-1])
            codes.append(own[keep])
            owner.append(np.full(len(codes[-1]), row))
            done.append(0 if begins else min(len(carry), len(codes[-1])))
            carry = codes[-1][-(max(NGRAMS) - 1) :]
        rows, starts = np.concatenate(owner), np.cumsum([0] + [len(c) for c in codes])
        codes = np.concatenate(codes)
        x, solid = codes.astype(U64) + U64(1), codes != 32
        piece = np.repeat(np.arange(len(done)), np.diff(starts))
        place = np.arange(len(x)) - starts[piece]
        done = np.array(done)[piece]
        for n in NGRAMS:
            m = len(x) - n + 1
            if m < 1:
                continue
            key, any_solid = x[:m].copy(), solid[:m].copy()
            for i in range(1, n):
                key = key * U64(0x100000001B3) + x[i : m + i]
                any_solid |= solid[i : m + i]
            # Not across texts, and not once more where they ended in what was carried over.
            good = any_solid & (piece[:m] == piece[n - 1 :]) & (place[:m] + n > done[:m])
            yield (mix64(key[good] + U64(n << 56)) & U64(n_buckets - 1)).astype(np.int64), rows[:m][good]
    yield None, has


def _count_grams(n_buckets: int):
    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                langs, own = np.unique(np.array(part.column("lang").to_pylist(), object), return_inverse=True)
                for buckets, rows in grams(texts.to_pylist(), n_buckets):
                    if buckets is None:
                        continue
                    got = np.bincount(own[rows] * n_buckets + buckets, minlength=len(langs) * n_buckets).reshape(len(langs), n_buckets)
                    for lang, total in zip(langs, got, strict=True):
                        totals[lang] = totals.get(lang, 0) + total
        for lang, total in totals.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(total[seen])], names=["lang", "bucket", "n"])

    return count


def _column(n_buckets: int):
    """The log probabilities of a language's n-grams, with half a count added to each."""

    def made(group: pa.Table) -> pa.Table:
        total = np.full(n_buckets, 0.5)
        total[group.column("bucket").to_numpy()] += group.column("n").to_numpy()
        return pa.table([group.column("lang").slice(0, 1), pa.array([(np.log(total) - np.log(total.sum())).tobytes()], pa.binary())], names=["lang", "logp"])

    return made


def sample_of(labelled: DataFrame, sizes: list[tuple[str, int]], most: int) -> DataFrame:
    """Of each language about `most` rows at most, those with the least hashes of doc_id. sizes: (language, its rows)."""
    place = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    limits = {lang: most * 2**64 // n - 2**63 for lang, n in sizes if n > most}
    if not limits:
        return labelled
    limit = F.create_map(*[x for lang, to in limits.items() for x in (F.lit(lang), F.lit(to).cast("long"))])
    return labelled.where(place <= F.coalesce(limit[F.col("lang")], F.lit(2**63 - 1)))


def fit(labelled: DataFrame, language_rows: int = LANGUAGE_ROWS, n_buckets: int = N_BUCKETS) -> dict:
    """Fits on (doc_id, text, lang) rows with a language. Returns {"langs": sorted list, "logp": buckets x languages}.
    The prior is uniform: which language a corpus holds most of says nothing about a text."""
    labelled = labelled.where("lang is not null")
    sizes = [(r["lang"], r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()]
    counts = sample_of(labelled, sizes, language_rows).where("text is not null").select("lang", "text").mapInArrow(_count_grams(n_buckets), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    columns = {r["lang"]: np.frombuffer(bytes(r["logp"])) for r in counts.groupBy("lang").applyInArrow(_column(n_buckets), "lang string, logp binary").collect()} if sizes else {}
    flat = np.full(n_buckets, -np.log(n_buckets))
    langs = sorted(lang for lang, _ in sizes)
    return {"langs": langs, "logp": np.stack([columns.get(x, flat) for x in langs], axis=1) if langs else np.zeros((n_buckets, 0))}


def totals_of(texts: list[str], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts x languages log likelihoods, n-grams of each text, whether it has a letter)."""
    total, many = np.zeros((len(texts), logp.shape[1])), np.zeros(len(texts), np.int64)
    for buckets, rows in grams(texts, len(logp)):
        if buckets is None:
            return total, many, rows
        step = max(1, TAKEN // max(1, logp.shape[1]))
        for lo in range(0, len(rows), step):
            of, own = buckets[lo : lo + step], rows[lo : lo + step]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            total[own[first]] += np.add.reduceat(logp.take(of, axis=0), first, axis=0)
        if len(rows):
            many += np.bincount(rows, minlength=len(texts))
    raise AssertionError


def predict(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with lang_pred, score (the posterior probability of lang_pred, 0 for und) and fit (mean log probability of its n-grams,
    above that of n-grams drawn evenly)."""
    spark = docs.sparkSession
    kept = docs.select(*keep)
    names = [f"_k{i}" for i in range(len(keep))]
    found = [T.StructField("_lang", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("_best", "_rest", "_grams"))]
    schema = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(names, kept.schema, strict=True)), T.StructField("_text", T.StringType()), *found])
    none = [F.lit(None).cast("string").alias("_lang"), *(F.lit(x).cast("double").alias(c) for c, x in (("_best", 0.0), ("_rest", 0.0), ("_grams", 0.0)))]
    out = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col("text").alias("_text"), *none)

    def scored(shared, last):
        def run(batches):
            langs, logp = shared.value
            for batch in batches:
                for part, texts in text_slices(batch, "_text"):
                    total, many, letter = totals_of(texts.to_pylist(), logp)
                    own = np.argmax(total, axis=1)
                    top = total[np.arange(len(total)), own]
                    rest = np.exp(total - top[:, None]).sum(axis=1)
                    # Against the best of the blocks before: log likelihood, and the sum of all relative to it.
                    before, best, sums = (part.column(c).to_pylist() if c == "_lang" else part.column(c).to_numpy(zero_copy_only=False) for c in ("_lang", "_best", "_rest"))
                    had = np.array([x is not None for x in before], bool)
                    stays = had & (best >= top)
                    high = np.where(stays, best, top)
                    rest = np.where(had, sums * np.exp(np.minimum(0, best - high)), 0) + rest * np.exp(top - high)
                    names_now = [x if s else (langs[k] if ok else None) for x, s, k, ok in zip(before, stays, own, letter, strict=True)]
                    text = pa.nulls(len(names_now), pa.string()) if last else part.column("_text")
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), text, pa.array(names_now, pa.string()), pa.array(high), pa.array(rest), pa.array(many.astype(float))], names=[*names, "_text", "_lang", "_best", "_rest", "_grams"])

        return run

    blocks = range(0, len(model["langs"]), BLOCK_LANGUAGES)
    for lo in blocks:
        shared = spark.sparkContext.broadcast((model["langs"][lo : lo + BLOCK_LANGUAGES], np.ascontiguousarray(model["logp"][:, lo : lo + BLOCK_LANGUAGES])))
        out = out.mapInArrow(scored(shared, lo == blocks[-1]), schema)
    known = F.col("_lang").isNotNull()
    return out.select(
        *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)],
        F.coalesce("_lang", F.lit("und")).alias("lang_pred"),
        F.when(known, 1 / F.col("_rest")).otherwise(0.0).alias("score"),
        F.when(known, F.col("_best") / F.col("_grams") + float(np.log(len(model["logp"])))).otherwise(0.0).alias("fit"),
    )


@bounded
def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"), 4)))
    marked = docs.withColumn("held_out", held_out(F.col("doc_id"), 4))
    return predict(marked, model, ["doc_id", "held_out"])


@bounded
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised: those that are `und`, or whose n-grams are less likely in the best language than if drawn
    evenly, go. The columns stay as they are, but a null lang is filled with the prediction."""
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"), 4)))
    plain, restored = shielded(docs, ["doc_id", "text", "lang"])
    out = predict(plain, model, plain.columns).where((F.col("lang_pred") != "und") & (F.col("fit") > 0))
    return restored(out.withColumn("lang", F.coalesce("lang", "lang_pred")))
