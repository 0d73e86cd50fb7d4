"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be found with up to k = m // CHARS_PER_ERROR edits. It is split into k + 1 pieces, one of which must
occur unchanged in any such occurrence; an Aho-Corasick automaton finds the pieces in whole documents, and
Myers' bit-parallel distance verifies the text around each hit. Texts and items are compared lower-cased, with each run of white
space as one space.

Items are the stated query set: they are taken in blocks of a bounded size, each broadcast in turn and run over all documents.

Items with fewer than 2 * CHARS_PER_ERROR characters would match by chance with an edit or inside words: they are found without an edit, where no letter or
digit stands directly before or behind.

Defined cases: a null or empty text holds no item, and a null or empty item, or one of white space, is held by no text; equal items under several ids are
each reported; repeated document rows are each reported; an empty table on either side gives no row; columns other than doc_id, text and
item_id, text are ignored; ids may be of any type that Arrow has.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stratalake.llm.common import bounded, table, text_slices

CHARS_PER_ERROR = 20
BLOCK_CHARS = 4_000_000  # characters of items broadcast at once


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length, with their offsets."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern_masks: dict[str, int], m: int, text: str, budget: int) -> tuple[int, int]:
    """(least distance, first end with it) of the pattern over all substrings of text; (budget + 1, -1) if none is within the budget."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = budget + 1, -1
    for i, ch in enumerate(text):
        eq = pattern_masks.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        if mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


class Matcher:
    """The automaton over the pieces of (item_id, normalised text) items."""

    def __init__(self, items: list[tuple[int, str]], chars_per_error: int = CHARS_PER_ERROR):
        import ahocorasick

        self.items, self.short = items, 2 * chars_per_error
        self.budget = [len(t) // chars_per_error if len(t) >= self.short else 0 for _, t in items]
        self.masks: dict[int, dict[str, int]] = {}
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(items):
            for offset, piece in pieces(text, self.budget[n]):
                places.setdefault(piece, []).append((n, offset))
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def _masks(self, n: int) -> dict[str, int]:
        if n not in self.masks:
            found: dict[str, int] = {}
            for i, ch in enumerate(self.items[n][1]):
                found[ch] = found.get(ch, 0) | 1 << i
            self.masks[n] = found
        return self.masks[n]

    def find(self, text: str, first_only: bool = False) -> list[tuple[int, int, int]]:
        """(item number, least distance, end of that place in the normalised text) of the items that text holds."""
        if not self.items:
            return []
        text = normalised(text)
        starts: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, offset in where:
                starts.setdefault(n, set()).add(end - size + 1 - offset)
        found = []
        for n in sorted(starts):
            item, budget = self.items[n][1], self.budget[n]
            m, best, at, done = len(item), budget + 1, -1, -1
            for s in sorted(starts[n]):
                if s >= 0 and text.startswith(item, s):
                    if m < self.short and (text[s - 1 : s].isalnum() and item[0].isalnum() or text[s + m : s + m + 1].isalnum() and item[-1].isalnum()):
                        continue
                    best, at = 0, s + m
                    break
                if not budget:
                    continue
                lo, hi = max(0, s - budget), min(len(text), s + m + budget)
                if hi <= done or hi - lo < m - budget:
                    continue
                # A window that overlaps the one before starts where an occurrence can still be new.
                distance, end = myers(self._masks(n), m, text[lo:hi], budget)
                done = hi if distance > budget else done
                if distance < best:
                    best, at = distance, lo + end
            if best <= budget:
                found.append((n, best, at))
                if first_only:
                    return found
        return found


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS):
    """Yields lists of (item_id, normalised text), each of about block_chars characters."""
    items = items.select("item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars) or 1
    for i in range(n):
        block = [(r["item_id"], normalised(r["text"])) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()]
        yield sorted((x for x in block if x[1]), key=lambda x: (str(x[0]), x[1]))


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, distance (least number of edits), budget (edits allowed),
    end_char (where that place ends in the normalised text)."""
    spark = docs.sparkSession
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType
    arrow_item = to_arrow_type(item_type)
    out = None
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            matcher = None
            for batch in batches:
                matcher = matcher or Matcher(shared.value)
                for part, texts in text_slices(batch, "text"):
                    hits = [(i, *h) for i, t in enumerate(texts.to_pylist()) for h in matcher.find(t)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array([h[0] for h in hits], pa.int64())), pa.array([matcher.items[h[1]][0] for h in hits], arrow_item), pa.array([h[2] for h in hits], pa.int32()), pa.array([matcher.budget[h[1]] for h in hits], pa.int32()), pa.array([h[3] for h in hits], pa.int64())],
                        names=["doc_id", "item_id", "distance", "budget", "end_char"],
                    )

        part = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, item_id {item_type.simpleString()}, distance int, budget int, end_char long")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no item."""
    spark, schema = docs.sparkSession, docs.schema
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            matcher = None
            for batch in batches:
                matcher = matcher or Matcher(shared.value)
                for part, texts in text_slices(batch, names[at]):
                    yield part.filter(pa.array([not matcher.find(t, first_only=True) for t in texts.to_pylist()], pa.bool_()))

        plain = docs.toDF(*names)
        docs = plain.mapInArrow(run, plain.schema).toDF(*schema.names)
    return docs


@bounded
def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@bounded
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; the others stay as they are."""
    return clean(docs, table(spark, sf_dir, "benchmark"))
