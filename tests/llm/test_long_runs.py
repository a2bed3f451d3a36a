"""Texts of very long runs of one kind of character, against the tokenizers library."""

import pytest

from duoscope.llm.tokens import encoder, public


@pytest.mark.parametrize("text", [" " * 2_000_000 + "a", "\n" * 2_000_000 + "b c", "x " + " \n" * 600_000 + "é", "a" + "　" * 1_200_000, " " * 100_001 + "<|endoftext|> a", "\t" * 100_000 + "a"], ids=range(6))
def test_white_space(text):
    from tokenizers import Tokenizer

    path = public("byte_bpe_50k.json")
    assert encoder(path)([text, "a b"])[0].tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
