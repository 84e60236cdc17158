"""The cached word encoder against the library, on words that lower or normalize to more than themselves."""

from __future__ import annotations

import random

import pytest

from tallyhall.llm.tokens import WordEncoder, default_path


@pytest.mark.parametrize("text", ["YENİ.", "İ,", "SÖYLENDİ, dedi", "İ", "क़.", "ẞ! ß.", "ſ. ŉ,", "É! é|", "É.", "Dž. Å, Å,", ".", "..", "a.b.", "ΣΑΣ. ΑΣ, Σ!"])
def test_words_that_change_under_the_normalizer(text):
    e = WordEncoder(default_path("word_bpe_49k.json"))
    assert e.encode([text]) == e._whole([text])


def test_random_strings():
    r = random.Random(17)
    chars = "#$%&?;:aAbZeéÉíİıßſŉÀàØøÑñΣσςДя中क़́̇̈̃̕1２٣½.,|!.,|!'s't-_*  \t\n \xa0​ \x85\x1f😀"
    texts = ["".join(r.choice(chars) for _ in range(r.randint(1, 14))) for _ in range(30_000)]
    e = WordEncoder(default_path("word_bpe_49k.json"))
    wrong = [t for t, a, b in zip(texts, e.encode(texts), e._whole(texts), strict=True) if a != b]
    assert not wrong, wrong[:5]
