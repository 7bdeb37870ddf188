import hashlib
import random
import tracemalloc
import unicodedata
from array import array

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.normalizers import NFC

from corpusloom.llm import bpe
from corpusloom.llm.common import slices
from tests.llm.texts import awkward, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pair():
    return bpe.Vocabulary(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)


def same(pair, text):
    vocab, library = pair
    ids = vocab.encode(text)
    decoded = vocab.decode(ids)
    want = library.encode(text, add_special_tokens=False).ids
    assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == want
    assert decoded == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "it's we'll I'D don't", "ΣΑΣ ΟΔΟΣ İstanbul ǅ ẞ", "a<|endoftext|>b <|startoftext|><|endoftext|>", "é ẛ̣ ﬁ", "x" * 5000, "!?" * 3000, "\x1c\x1d a\x85b\xa0c　d​e", "12345 ½ ٣ 中文字 한글", "\U0001f600\U0001f469‍\U0001f4bb tab\there", "<|endoftext|", "a\x00b"])
def test_like_the_library(pair, text):
    same(pair, text)


def test_random_words(pair):
    rng = random.Random(5)
    for _ in range(200):
        same(pair, " ".join("".join(rng.choice("aeithnorsßéç'.,!#A1") for _ in range(rng.randint(1, 25))) for _ in range(20)))


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_any_text(pair, text):
    same(pair, text)


def test_every_code_point(pair):
    vocab, library = pair
    texts = ["a" + chr(c) + "b" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(texts), 50_000):
        part = texts[at : at + 50_000]
        want = [x.ids for x in library.encode_batch(part, add_special_tokens=False)]
        assert [t for t, ids in zip(part, want) if array("I", vocab.encode(t)).tolist() != ids] == []


def test_random_strings(pair):
    """Characters near each other, so that marks meet letters of their script; half of the strings are of marks."""
    rng = random.Random(11)
    marks = [chr(c) for c in range(0x20000) if unicodedata.combining(chr(c))]
    for k in range(10_000):
        at = rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0xA000, 0xD700), rng.randrange(0xF900, 0x2FA20)])
        near = [chr(at + rng.randrange(64)) for _ in range(12)]
        if k % 2:
            near = [c + "".join(rng.choices(marks, k=rng.randrange(4))) for c in near]
        same(pair, "".join(near))


def test_rows(spark, pair):
    docs = awkward(spark)
    got = bpe.encode(docs, PATH)
    rows = got.collect()
    library = pair[1]
    want = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()]
    pack = lambda ids: b"".join(i.to_bytes(4, "little") for i in ids)
    assert sorted(str((r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest())) for r in rows) == sorted(str((d, len(i), hashlib.sha256(pack(i)).hexdigest())) for d, i in want)
    assert bpe.decode(got.drop("decoded"), PATH).exceptAll(got).count() == 0
    assert bpe.encode(empty(spark), PATH).collect() == []


def test_little_is_held_at_once():
    """Neither a list of all characters nor a second copy of a batch's texts."""
    rows = pa.RecordBatch.from_arrays([pa.array([b"x" * 2000] * 5000, pa.binary())], ["body"])
    tracemalloc.start()
    try:
        assert sum(part.num_rows for part in slices(iter([rows]), 1 << 20)) == 5000
        assert tracemalloc.get_traced_memory()[1] < 2 << 20
        assert len(bpe.disputed(NFC().normalize_str)) > 0
        assert tracemalloc.get_traced_memory()[1] < 8 << 20
    finally:
        tracemalloc.stop()
