"""Quality rules as weak supervision, in DataFrame operations only.

Each rule votes good (+1), votes bad (-1) or abstains (0). A two-class model with two accuracies per rule is fitted by
expectation-maximisation on the histogram of vote patterns, which has at most 3^rules rows whatever the corpus, so it may be
collected; each document then gets the posterior probability of its pattern.

Defined cases: null and empty texts have no word, all counts 0, and fail the base rule; repeated rows count as often as they occur;
a posterior equal to the threshold is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.llm.common import SPACES, table, written

SYMBOLS = "#*$%&|<>"
KEEP_AT = 0.5
ROUNDS = 30
PRIOR_GOOD = 0.8  # starting share of good documents
BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, the base counts and what only the rules use, from each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(F.translate(F.col("_t"), "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")
    n = F.col("n_words")
    w, lines = F.col("_w"), F.col("_lines")
    at = lambda i: F.get(w, i)
    # The windows as (hash, place) sorted by hash: those whose hash stands beside them as well occur twice or more.
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)).cast("int")), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))).otherwise(F.expr("array()").cast("array<bigint>"))
    hashes, pairs = F.col("_h"), F.col("_p")
    paired = F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.expr("cast(array() as array<struct<h:bigint,i:int>>)")).otherwise(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i")))))
    none = F.lit(None).cast("bigint")
    beside = lambda p, i: (p["h"].eqNullSafe(F.get(pairs, i + 1)["h"])) | F.coalesce(p["h"] == F.when(i > 0, F.get(pairs, i - 1)["h"]).otherwise(none), F.lit(False))
    places = F.sort_array(F.transform(F.filter(pairs, beside), lambda p: p["i"]))
    # A repeated window covers the words up to the next repeated one, three at most.
    covered = F.when(F.size("_i") == 0, F.lit(0)).otherwise(F.lit(3) + F.aggregate(F.transform(F.slice("_i", 2, F.greatest(F.size("_i") - 1, F.lit(0))), lambda x, k: F.least(F.lit(3), x - F.get(F.col("_i"), k))), F.lit(0), lambda a, x: a + x))
    return (
        docs.select(*keep, text.alias("_t"))
        .select(*keep, "_t", words.alias("_w"), F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_lines"))
        .withColumn("n_words", F.size(w).cast("long"))
        .withColumn("_h", windows)
        .withColumn("_p", paired)
        .withColumn("_i", places)
        .select(
            *keep,
            "n_words",
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            covered.cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
            (F.length("_t") - F.length(F.translate("_t", ".!?,", ""))).cast("long").alias("n_stops"),
            (F.length("_t") - F.length(F.translate("_t", "0123456789", ""))).cast("long").alias("n_digits"),
            sum((F.instr("_t", c) > 0).cast("int") for c in SYMBOLS).alias("n_symbol_kinds"),
        )
        .withColumn("base_failed", (n < 50) | (100 * F.col("n_repeat_words") > 50 * n))
    )


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


#: name -> vote of a row of measures(): bad below or above one bound, good beyond another, no opinion between.
RULES: dict[str, Callable[[], Column]] = {
    "length": lambda: vote(F.col("n_words") < 20, F.col("n_words") >= 80),
    "word_length": lambda: vote((F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words")), F.col("word_chars").between(3 * F.col("n_words"), 9 * F.col("n_words"))),
    "symbols": lambda: vote(100 * F.col("n_symbols") > 10 * F.col("n_words"), 100 * F.col("n_symbols") <= F.col("n_words")),
    "symbol_share": lambda: vote(100 * F.col("n_symbols") > 5 * F.col("word_chars"), 200 * F.col("n_symbols") <= F.col("word_chars")),
    "symbol_kinds": lambda: vote(F.col("n_symbol_kinds") >= 4, F.col("n_symbol_kinds") <= 1),
    # One line said twice in a short text is no evidence, so a bad vote takes three.
    "lines": lambda: vote((F.col("n_dup_lines") >= 3) & (100 * F.col("n_dup_lines") > 30 * F.col("n_lines")), F.col("n_dup_lines") == 0),
    "repeats": lambda: vote(100 * F.col("n_repeat_words") > 35 * F.col("n_words"), 100 * F.col("n_repeat_words") <= 10 * F.col("n_words")),
    "variety": lambda: vote(100 * F.col("n_distinct_words") < 20 * F.col("n_words"), 100 * F.col("n_distinct_words") >= 35 * F.col("n_words")),
    "stops": lambda: vote(100 * F.col("n_stops") < F.col("n_words"), 100 * F.col("n_stops") >= 5 * F.col("n_words")),
    "digits": lambda: vote(F.col("n_digits") > F.col("n_words"), 10 * F.col("n_digits") <= F.col("n_words")),
}


def posteriors(histogram: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[list[float], list[tuple[float, float]], float]:
    """Expectation-maximisation over (votes, count): (posterior of good for each pattern, rule accuracies, share of good).

    A rule that votes is right with one accuracy on good documents and another on bad ones, so a rule that says good of
    nearly everything weighs little when it does. Their sum is held above 1: rules are taken to be better than chance, which
    also fixes which of the two classes is the good one. Abstaining says nothing. The start takes a document without a bad vote as
    likely good.
    """
    n_rules = len(histogram[0][0]) if histogram else 0
    good = [0.95 if min(v) >= 0 else 0.3 for v, _ in histogram]
    accuracy, share = [(0.8, 0.5)] * n_rules, PRIOR_GOOD
    for _ in range(rounds):
        total = sum(c for _, c in histogram)
        share = min(0.99, max(0.01, sum(g * c for g, (_, c) in zip(good, histogram, strict=True)) / total)) if total else share
        for r in range(n_rules):
            cells = {(k, v): 0.0 for k in (0, 1) for v in (-1, 1)}
            for g, (votes, c) in zip(good, histogram, strict=True):
                if votes[r]:
                    cells[1, votes[r]] += g * c
                    cells[0, votes[r]] += (1 - g) * c
            of_good = (cells[1, 1] + 4) / (cells[1, 1] + cells[1, -1] + 5)
            of_bad = (cells[0, -1] + 1) / (cells[0, 1] + cells[0, -1] + 2)
            of_good = min(0.999, max(0.02, of_good))
            accuracy[r] = (of_good, min(0.999, max(1.02 - of_good, of_bad)))
        good = []
        for votes, _ in histogram:
            odds = math.log(share / (1 - share))
            for v, (g, b) in zip(votes, accuracy, strict=True):
                odds += math.log(g / (1 - b)) if v > 0 else math.log((1 - g) / b) if v < 0 else 0.0
            good.append(1 / (1 + math.exp(-max(-700.0, min(700.0, odds)))))
    return good, accuracy, share


def supervise(measured: DataFrame) -> DataFrame:
    """Adds quality, the posterior probability of good, to written measures; base columns pass through."""
    spark = measured.sparkSession
    names = [f"vote_{r}" for r in RULES]
    voted = measured.select("*", *[rule().alias(n) for rule, n in zip(RULES.values(), names, strict=True)])
    histogram = [(tuple(r[n] for n in names), r["n"]) for r in voted.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()]
    good, _, _ = posteriors(histogram)
    if not histogram:
        return voted.withColumn("quality", F.lit(0.0)).drop(*names)
    patterns = spark.createDataFrame([(*v, g) for (v, _), g in zip(histogram, good, strict=True)], ", ".join(f"{n} int" for n in names) + ", quality double")
    return voted.join(F.broadcast(patterns), names, "left").drop(*names)


def rate(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, the base columns, quality and kept for every row of docs."""
    rated = supervise(written(measures(docs, keep), "measures"))
    return rated.select(*keep, *BASE_COLUMNS, "quality", (~F.col("base_failed") & (F.col("quality") >= KEEP_AT)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rate(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
