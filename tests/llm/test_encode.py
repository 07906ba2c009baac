"""The chunk cache gives the library's own ids, whatever the white space."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumenark.llm.encode import Encoder

PIECES = ["the", "Word", "éÉcole", "ß", "don't", "it's", "x'Ll", " ", "  ", "\n", "\n\n", " \n", "\t", "\xa0", " ", "123", "4a5", "...", "!?", "<|endoftext|>", "<|startoftext|>",
          "é", "́", "İ", "日本", "🙂", "a|b", "\r\n", "\x1c", "#x", "www.a-b.com/q=1", "K", "ſ", "", "_", "Ǆ", "ﬁ"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_equals_the_library(name):
    path = public_tokenizers.path(name)
    plain, enc, rng = Tokenizer.from_file(path), Encoder(path, room=64), random.Random(5)
    for _ in range(3000):
        text = rng.choice(["", " "]).join(rng.choice(PIECES) for _ in range(rng.randrange(0, 12)))
        assert np.frombuffer(enc.encode(text), dtype="<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    assert enc.encode(None) == b"" == enc.encode("")
