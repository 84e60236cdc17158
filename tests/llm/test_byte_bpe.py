"""The byte-level encoder against the library where pairs are merged by arrays, and what its cache keeps."""

from __future__ import annotations

import random

import pytest
from tokenizers import Tokenizer

from tallyhall.llm import byte_bpe
from tallyhall.llm.tokens import default_path

PATH = default_path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(3))
def test_many_places_of_a_pair(seed):
    r = random.Random(seed)
    parts = ["a", "b", "th", "er", "ing", "é", "ß", "ª", "ɏ", "ɐ", "你", "🙂", "٣", "½", "'s", "’", ".", "#*", "--", " ", "  ", "\n", "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["ab" * 700, "=" * 999, "th" * 300 + ".,"]
    t, b = Tokenizer.from_file(PATH), byte_bpe.ByteBPE(PATH)
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert b.encode(texts) == want
    assert [b.decode(x) for x in want] == [t.decode(x, skip_special_tokens=False) for x in want]


def test_a_full_cache_keeps_what_recurs(monkeypatch):
    merged, merge_all = [], byte_bpe.merge_all
    monkeypatch.setattr(byte_bpe, "merge_all", lambda words, *rest: merged.append(len(words)) or merge_all(words, *rest))
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 2)
    b = byte_bpe.ByteBPE(PATH)
    first, second = b.encode(["the house of thorns", "a house of horns"])
    assert b.encode(["the house of thorns", "my house"])[0] == first and b.encode(["a house of horns"]) == [second]
    assert merged == [6, 1, 2]  # "my" alone is new; then "a" and " horns", which the batch before lacked
