"""Encoding part by part gives the ids of encoding whole texts, for any characters and any tokenizer file."""

from functools import lru_cache

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from shardloom.llm.token_output import _Encoder

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD_LETTERS = "İıſßÅñ़̇́ਖਖ਼གགྷྷਖ਼ཛྷΣσÉé漢ａ  '’<|>.,!?;:#'=_  \n\tabTHs1"


@lru_cache
def loaded(path):
    return Tokenizer.from_file(path), _Encoder(path)


def same(path, texts):
    whole, parts = loaded(path)
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [e.tolist() for e in parts.encode(texts)] == want


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_words_that_end_in_a_combining_mark(path):
    same(path, ["THİ!", "Åñİ,", "ਖ਼.", "ཛྷ?", "ਖ਼.", "གྷ?", "end İ. i̇! É́; <|endoftext|>. a<|endoftext|>?", "", " ", "it's, we'll: 'Tis!", "one### Two'' 'ré(\") x_ \u00e9\u0338= a<| b|> c\u0301# <|startoftext|>#"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=ODD_LETTERS, max_size=24), max_size=4))
def test_odd_letters(texts):
    same(WORD, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_all_of_unicode(texts):
    for path in (WORD, BYTE):
        same(path, texts)


def test_tokenizer_with_prefix_blanks(tmp_path):
    other = Tokenizer.from_file(BYTE)
    other.pre_tokenizer = ByteLevel(add_prefix_space=True)
    other.save(str(tmp_path / "t.json"))
    same(str(tmp_path / "t.json"), ["Hello there.", " two  blanks ", "İ!"])


def test_which_are_encoded_by_parts():
    assert _Encoder(WORD).parts is not None and _Encoder(BYTE).parts is None


def test_every_letter_below_0250_in_words_of_each_case():
    letters = [chr(i) for i in range(0x250) if chr(i).isalpha()]
    same(WORD, [f"{a}{b} {a}x{b}. X{b}" for a, b in zip(letters, letters[7:] + letters[:7])])


def test_little_memory_gives_the_same_ids():
    whole, few = Tokenizer.from_file(WORD), _Encoder(WORD, 3)
    texts = ["One, two; THREE four! Été 5th's one two", "", "one Two. été six seven eight One,"] * 3
    assert [e.tolist() for e in few.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(few.parts) <= 3 and len(few.parts.older) <= 3
