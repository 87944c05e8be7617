"""The merger looks for one special token, not for the empty one at every character; ids are the library's, also where a text holds that token."""

from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

from factloom.llm.packing import encoder


def test_merger_has_a_token_to_look_for_that_texts_may_hold():
    path = public_tokenizers.path("byte_bpe_50k.json")
    e, library = encoder(path), Tokenizer.from_file(path)
    assert e.merger.special_tokens_set and "" not in e.merger.special_tokens_set
    for text in ["", "a word, and\n\nmore", "\0", *e.merger.special_tokens_set, "so " + " is ".join([*e.merger.special_tokens_set] * 3) + "1234 über"]:
        assert e.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
