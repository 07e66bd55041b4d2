import hashlib
import struct
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkdesk.llm import bpe
from tests.conftest import SMALL
from tests.llm.helpers import odd_documents

PATH = bpe.vocabulary_path()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(Path(PATH).read_bytes())


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


TEXTS = st.one_of(
    st.text(max_size=60),
    st.text("etainorsh '\n\t.,1", max_size=80),
    st.lists(st.sampled_from(["<|endoftext|>", " ", "  ", "\n ", "the", "'ll", "😀", "é", "<|endof"])).map("".join),
)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=5))
def test_ids_and_text_equal_the_library(tokenizer, encoder, texts):
    for text, packed in zip(texts, encoder.encode_batch(texts)):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids_of(packed) == want
        got = encoder.decode(np.frombuffer(packed, "<u4")).decode()
        assert got == tokenizer.decode(want, skip_special_tokens=False) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=12))
def test_decode_any_ids(tokenizer, encoder, ids):
    got = encoder.decode(np.array(ids, "<u4")).decode()
    assert got == tokenizer.decode(ids, skip_special_tokens=False)


def test_long_words(tokenizer, encoder):
    for text in ("a" * 3000, " " * 2000, "=-" * 1500, "ab" * 999 + "é" * 500):
        assert ids_of(encoder.encode_batch([text])[0]) == tokenizer.encode(text, add_special_tokens=False).ids


def test_forgetting_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    small = bpe.Encoder(Path(PATH).read_bytes())
    texts = [f"word{i} and thing{i % 5}, other" for i in range(40)]
    for at in range(0, 40, 7):
        for text, packed in zip(texts[at : at + 7], small.encode_batch(texts[at : at + 7])):
            assert ids_of(packed) == tokenizer.encode(text, add_special_tokens=False).ids


def digests(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    packed = struct.pack(f"<{len(ids)}I", *ids)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_query(spark, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r[0]: tuple(r)[1:] for r in bpe.op1_bpe(spark, SMALL).collect()}
    assert got == {i: digests(tokenizer, t) for i, t in docs.items()}


def test_odd_cases(spark, tokenizer):
    docs = odd_documents(spark)
    got = sorted(map(repr, bpe.digests(docs).collect()))
    assert len(got) == docs.count()
    rows = [(r.doc_id, *digests(tokenizer, r.text)) for r in docs.collect()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in bpe.digests(docs).collect())
    assert bpe.digests(docs.limit(0)).count() == 0
    again = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted(repr(r.text) for r in again) == sorted(repr(r.text or "") for r in docs.collect())
    unknown = spark.createDataFrame([(1, bytearray(struct.pack("<2I", 64, 4_000_000))), (2, None)], "id long, ids binary")
    assert [r.text for r in bpe.decode(unknown, PATH).orderBy("id").collect()] == ["a", ""]
