"""Against the library that the vocabulary file is made for."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from arbitra.llm.token_counts import TokenCounter, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(PATH)


def expected(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_hard_texts(library, counter):
    texts = ["", " ", "a" * 3000, "ab" * 500, "aaab" * 99, "hahaha" * 40, "<|endoftext|>", "x<|startoftext|>y <|endoftext|><|endoftext|>", "<|nothing|>", "it's we'll don't", "１２３ ½ ②", "ΣΟΣ ΣΑΣ", "İstanbul", "é é", "한국어 텍스트", "😀👍🏽", "a\x00b\x1cc\x85d​e", "%%%***&&&"]
    assert counter(texts) == expected(library, texts)


def test_overlapping_pairs(library, counter):
    r = random.Random(4)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(1, 40))) for _ in range(1500)] + ["".join(r.choice("aeh ") for _ in range(60)) for _ in range(500)]
    assert counter(texts) == expected(library, texts)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(min_codepoint=0, max_codepoint=0x2FF), max_size=60))
def test_any_text(text):
    assert TestAny.counter([text]) == expected(TestAny.library, [text])


class TestAny:
    counter = TokenCounter(PATH)
    library = Tokenizer.from_file(PATH)


def test_query(odd, none, library):
    rows = sorted(map(tuple, token_counts(odd).collect()))
    texts = {(r["doc_id"], r["text"]): r["text"] or "" for r in odd.collect()}
    want = sorted((k[0], len(t.encode()), n, n > 2048) for (k, t), n in zip(texts.items(), expected(library, list(texts.values())), strict=True))
    assert sorted(set(rows)) == sorted(set(want)) and len(rows) == odd.count()
    assert token_counts(none).count() == 0
