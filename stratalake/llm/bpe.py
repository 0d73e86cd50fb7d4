"""BPE encoding and decoding, with tree concatenation for long unsplit text.

The tokenizers library encodes ordinary texts. A stretch that the pre-tokenizer leaves whole and that is longer than LONG bytes
(one endless word, a run of spaces) is cut into leaves; the leaves are encoded in parallel and joined pairwise up a tree. A join holds when
the two tokens at it, put together, encode to themselves; otherwise a window around it is encoded anew and grows until it agrees
with the tokens on both sides. A token sequence whose neighbours all pass that test is the one that encoding the whole gives, so the
result is exact.

Ordinary texts go through a second, faster implementation of the same merges where it provably gives the same ids: see same_merges()
and SAME_SPLIT. All others go through the tokenizers library itself.

Defined cases: null text is empty: no tokens, the digest of nothing; repeated rows are encoded alike; an empty table
gives an empty result; a null doc_id is returned as it is; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.llm.common import bounded, extended, table, text_slices

LONG = 4096  # bytes of an unsplit stretch from which the tree is used
LEAF = 2048


#: Characters that both libraries' pre-tokenizers class alike (a test goes through them all).
SAME_SPLIT = re.compile("[^\x00-\u024f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u2010-\u2027\u2030-\u203a\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable bytes stand for themselves, the others for U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def same_merges(json_text: str) -> bool:
    """Whether merging neighbours by the rank of what they make gives the ids of the merge list: merges must come in the order of their
    results' ids, and each token's text must encode to that token alone. Then two neighbours that make a token by another merge than the
    listed one can't come about, for encoding the token's text would have stopped at them."""
    from tokenizers import Tokenizer

    spec = json.loads(json_text)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return False
    made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
    tok, added = Tokenizer.from_str(json_text), {t["id"] for t in spec.get("added_tokens", [])}
    return made == sorted(set(made)) and all([t.id for t in tok.model.tokenize(x)] == [i] for x, i in model["vocab"].items() if i not in added)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Codec:
    """A byte-level BPE tokenizer from the JSON text of a tokenizer file; truncation and padding are off."""

    def __init__(self, json_text: str, long: int = LONG, leaf: int = LEAF, fast: bool = False):
        from tokenizers import Tokenizer

        self.tok, self.long, self.leaf = Tokenizer.from_str(json_text), long, leaf
        self.tok.no_truncation()
        self.tok.no_padding()
        self.names = [self.tok.id_to_token(i) for i in range(self.tok.get_vocab_size())]
        self.numbers = [str(i) for i in range(len(self.names))]
        added = self.tok.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.fast = None
        if fast:
            import tiktoken

            alphabet = byte_alphabet()
            ranks = {bytes(alphabet[c] for c in x): i for i, x in enumerate(self.names) if x not in self.added}
            self.fast = tiktoken.Encoding("fast", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.wide_gap = re.compile(r"\s{%d}" % max(1, long // 4))

    def _bpe(self, symbols: str) -> list[int]:
        return [t.id for t in self.tok.model.tokenize(symbols)]

    def _stands(self, a: int, b: int) -> bool:
        return self._bpe(self.names[a] + self.names[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded neighbours put together."""
        if not left or not right:
            return left + right
        if self._stands(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            window = self._bpe("".join(self.names[i] for i in left[-width:] + right[:width]))
            before, after = left[:-width], right[width:]
            if (not before or self._stands(before[-1], window[0])) and (not after or self._stands(window[-1], after[0])):
                return before + window + after
            if not before and not after:
                return window
            width *= 2

    def tree(self, symbols: str) -> list[int]:
        """Encodes one stretch, given in the byte alphabet, by leaves and joins."""
        leaves = [symbols[i : i + self.leaf] for i in range(0, len(symbols), self.leaf)]
        with ThreadPoolExecutor(max_workers=2) as pool:
            level = list(pool.map(self._bpe, leaves))
            while len(level) > 1:
                odd = [level[-1]] if len(level) % 2 else []
                level = list(pool.map(self.join, level[0 : len(level) - 1 : 2], level[1::2])) + odd
        return level[0]

    def has_long(self, text: str) -> bool:
        return len(text) * 4 >= self.long and (max(map(len, text.split()), default=0) * 4 >= self.long or self.wide_gap.search(text) is not None)

    def encode_with_tree(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.added:
                ids.append(self.added[part])
                continue
            for symbols, _ in self.tok.pre_tokenizer.pre_tokenize_str(part) if part else []:
                ids += self.tree(symbols) if len(symbols) >= self.long else self._bpe(symbols)
        return ids

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if self.has_long(text):
                out[i] = self.encode_with_tree(text)
            elif self.fast and (text.isascii() or not SAME_SPLIT.search(text)) and not (self.cut and self.cut.search(text)):
                out[i] = self.fast.encode_ordinary(text)
            else:
                plain.append(i)
        for i, e in zip(plain, self.tok.encode_batch_fast([texts[i] for i in plain], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def decode_many(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)


@functools.lru_cache(maxsize=4)
def _agrees(json_text: str) -> bool:
    return same_merges(json_text)


def _json_text(path: str | None) -> str:
    with open(extended(path or default_path()), encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str | None = None, digests: bool = False) -> DataFrame:
    """doc_id and n_tokens with ids (array<int>), or with ids_sha256 and decoded_sha256 where digests are asked for."""
    json_text = _json_text(path)
    shared = docs.sparkSession.sparkContext.broadcast((json_text, _agrees(json_text)))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>")

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        codec = None
        for batch in batches:
            codec = codec or Codec(shared.value[0], fast=shared.value[1])
            for part, texts in text_slices(batch, "text"):
                ids = codec.encode_many(texts.to_pylist())
                counts = pa.array([len(x) for x in ids], pa.int64())
                if digests:
                    number = codec.numbers
                    coded = [hashlib.sha256(",".join([number[i] for i in x]).encode()).hexdigest() for x in ids]
                    plain = [hashlib.sha256(x.encode()).hexdigest() for x in codec.decode_many(ids)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), counts, pa.array(coded, pa.string()), pa.array(plain, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), counts, pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids are an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(_json_text(path))
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        codec = None
        for batch in batches:
            codec = codec or Codec(shared.value)
            texts = codec.decode_many([x or [] for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids")).mapInArrow(run, f"doc_id {id_type}, text string")


@bounded
def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digests=True)


@bounded
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: each document's token ids."""
    return encode(docs)
