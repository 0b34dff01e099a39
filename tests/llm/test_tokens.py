"""Token ids of many texts at once against the tokenizers library, text by text."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quernstone.llm import _bytes as B
from quernstone.llm.tokens import Encoder

KINDS = [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaced")]
#: Letters whose bytes change when normalised or lower-cased, marks that combine, spaces of all kinds, added tokens.
PARTS = [
    *"abcXYZ019 .,!?'-_", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x1f", "\x00", "\x7f",
    "\u0085", " ", " ", " ", " ", " ", " ", "　", "﻿", "‍", "​",
    "İ", "ı", "ß", "ẞ", "Σ", "ς", "ﬁ", "Å", "Ǆ", "é", "é", "́", "̣", "ộ",
    "ᄀ", "ᅡ", "ᆨ", "각", "中", "あ゙", "\U0001f600", "\U0001f469‍\U0001f4bb", "²", "½", "٣",
    "'s", "'ll", "don't", "hello", "World", "naïve", "Straße", "<|endoftext|>", "<|startoftext|>", "<|endoftext", "|>", "1İ café", "2İ é",
]


def column(texts):
    return B.column_bytes(pa.array(texts, pa.string()))


def ids_of(coder, texts):
    ids, at = coder.encode(*column(texts))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


@pytest.mark.parametrize("name, breaks", KINDS)
def test_same_ids_as_the_library(name, breaks):
    import public_tokenizers

    path = public_tokenizers.path(name)
    plain, coder, rng = Tokenizer.from_file(path), Encoder(path, breaks), random.Random(5)
    for _ in range(12):  # one encoder throughout, so later batches meet a warm store
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.choice((0, 1, 2, 5, 30, 120)))) for _ in range(250)]
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        got = ids_of(coder, texts)
        wrong = [(t, g, w) for t, g, w in zip(texts, got, want) if g != w]
        assert not wrong, min(wrong, key=lambda x: len(x[0]))


@pytest.mark.parametrize("name, breaks", KINDS)
def test_changes_of_length_that_cancel(name, breaks):
    import public_tokenizers

    path = public_tokenizers.path(name)
    plain, coder = Tokenizer.from_file(path), Encoder(path, breaks)
    for texts in (["2İ é"], ["é", "2İ"], ["1İ café 3İstanbul é", "a 2İ é b"], ["<|endoftext|>", "x <|startoftext|>y"]):
        assert ids_of(coder, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_store_starts_anew(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(Encoder, "HELD", 50)
    plain, coder = Tokenizer.from_file(path), Encoder(path, "words")
    texts = [" ".join(f"w{i * k % 97}" for i in range(40)) for k in range(20)]
    for t in texts:
        assert ids_of(coder, [t]) == [plain.encode(t, add_special_tokens=False).ids]
    assert np.array_equal(coder.hashes, np.sort(coder.hashes))
