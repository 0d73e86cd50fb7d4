import hashlib
import random

import pytest
from llm_data import prose
from tokenizers import Tokenizer

from stratalake.llm import bpe

JSON = bpe._json_text(None)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_str(JSON)
    t.no_truncation()
    t.no_padding()
    return t


def ids(library, texts):
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_tree_equals_whole(library):
    codec = bpe.Codec(JSON, long=64, leaf=16)
    r = random.Random(1)
    texts = []
    for n in range(800):
        parts = r.choice([["ab"], list("abcdefgh é"), ["a", " "], [" ", "\n", "\t"], list("!?'sx") + ["<|endoftext|>"], ["the", "ing", "zz", "日本", "🙂"]])
        texts.append("".join(r.choice(parts) for _ in range(r.randint(0, 300))))
    texts += ["the" * 2000, " " * 5000, "=" * 3001, "aaaaab" * 999, "é" * 3000, "x" * 9000 + " y"]
    assert [codec.encode_with_tree(t) for t in texts] == ids(library, texts)


def test_fast_way_is_the_same(library):
    assert bpe.same_merges(JSON)
    codec = bpe.Codec(JSON, fast=True)
    alike = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000 and not bpe.SAME_SPLIT.search(chr(i))]
    texts = [f"a{c}b {c} {c}{c}1{c}\n{c} 's{c}" for c in alike]
    assert codec.encode_many(texts) == ids(library, texts)
    r = random.Random(5)
    texts = ["".join(r.choice(["a", "aa", "b", " ", "  ", "\n", "=", "-", "1", "é", "ñ", "th", "ing", "'s", "A", "\t", "!", "<|endoftext|>", "🙂", " "]) for _ in range(r.randint(0, 300))) for _ in range(2000)]
    assert codec.encode_many(texts) == ids(library, texts)


def test_other_merges_are_refused():
    assert not bpe.same_merges('{"model": {"type": "WordPiece"}}')


def test_query(spark, frame, folder, library):
    given = [(1, prose(1, 200), "en"), (2, None, "en"), (3, "", "en"), (4, "q" * 200_000, "en"), (5, "\n" * 30_000 + "é日本🙂 <|endoftext|>", "en"), (6, "same", "en"), (6, "same", "en"), (None, "x", "en"), (7, prose(2, 100_000), "en")]
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.query(spark, folder(documents=frame(given))).collect()}
    want = set()
    for (i, t, _), e in zip(given, ids(library, [t or "" for _, t, _ in given]), strict=True):
        back = library.decode(e, skip_special_tokens=False)
        assert back == (t or "")
        want.add((i, len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == want and bpe.query(spark, folder(documents=frame([]))).count() == 0


def test_round_trip(spark, frame):
    docs = frame([(1, prose(1, 50) + " é🙂", "en"), (2, "", "en"), (3, None, "en")])
    assert {r.doc_id: r.text for r in bpe.decode(bpe.stage(spark, docs, "")).collect()} == {1: prose(1, 50) + " é🙂", 2: "", 3: ""}
