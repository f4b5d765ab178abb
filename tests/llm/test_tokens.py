from __future__ import annotations

import random

import numpy as np
import pytest

from keepstone.llm import queries, tokens


@pytest.mark.parametrize("slots", [1 << 12, 1 << 16])
def test_words_equal_the_library(slots):
    rng = random.Random(0)
    alphabet = list("abcXYZ'’.,!?<|>09 \n\té—İſΣς́ͅß“”×÷  漢ｱ་") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "n't ", "The ", "the. ", "été, ", "z" * 70]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(6000)]
    e = tokens.WordEncoder(queries.tokenizer_path(), slots)
    got = []
    for i in range(0, len(texts), 300):
        got += e.encode_batch([t.encode() for t in texts[i : i + 300]])
    expected = [[*x.ids, 1] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == expected
    assert e.encode_batch([None, b"", b" \n"]) == [tokens.END_BYTES] * 3


@pytest.mark.parametrize("count", [100, 513, 1025, 5000])
def test_more_distinct_words_than_slots(count):
    words = [f"w{i:x}q" if i % 3 else "abcdefgh"[i % 8] * (1 + i % 5) + "klm" for i in range(count)] + ["y" * 70, "the"]
    text = " ".join(words + words[:50])
    e = tokens.WordEncoder(queries.tokenizer_path(), 1 << 10)
    for _ in range(2):
        got = e.encode_batch([b"the w1q", text.encode(), None])
        expected = [[*x.ids, 1] for x in e.tokenizer.encode_batch(["the w1q", text, ""], add_special_tokens=False)]
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == expected
        assert 2 * e.table.used <= e.table.slots
