"""Insults however they are written: marks at the ends, few letters, spaced out."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from tallyhall.llm import toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def chars(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(0, "the idiot is a stupid loser, the clown is scum, we hate a whore, an asshole, an ass, kill " * 200)], "doc_id long, text string")
    return toxicity.language_model(toxicity.corpus_counts(df.unionByName(more)))


@pytest.mark.parametrize(
    "written,word",
    [("$tupid", "stupid"), ("!diot", "idiot"), ("|oser", "loser"), ("(lown", "clown"), ("$cum", "scum"), ("@$$hole", "asshole"), ("105er", "loser"), ("4$$", "ass"), ("hat3", "hate"), ("whor3", "whore"), ("idio7", "idiot"), ("idio+", "idiot"), ('"$tupid!"', "stupid"), ("($tupid)", "stupid")],
)
def test_marks_at_the_ends_are_read(chars, written, word):
    d = toxicity.Decoder(chars)
    assert word in toxicity.readings(written, d).split()
    assert word in toxicity.restore(f"you {written} there", d).split()
    weights = np.zeros(toxicity.SPACE, np.float32)
    weights[toxicity.features(word)[0]] = 5.0
    scorer = toxicity.Scorer(toxicity.Model(weights, (-2.0, 1.0, 0.0)), chars)
    assert scorer.score(f"you {written} there") == scorer.score(f"you {word} there") > scorer.score("you there")


@pytest.mark.parametrize("written", ["dog!", "(see", "1995", "3.14", "the"])
def test_plain_words_stay(chars, written):
    assert written.strip("!(") in toxicity.readings(written, toxicity.Decoder(chars)).split()


@pytest.mark.parametrize(
    "written,word",
    [("x" * 600 + " you s t u p i d man", "stupid"), ('they are "s c u m"', "scum"), ("such s c u m. go away", "scum"), ("just d i e now", "die"), ('"$ t u p i d"', "stupid")],
)
def test_spaced_words_are_read(chars, written, word):
    d = toxicity.Decoder(chars)
    assert word in toxicity.restore(written, d).split()
    weights = np.zeros(toxicity.SPACE, np.float32)
    weights[toxicity.features(word)[0]] = 5.0
    scorer = toxicity.Scorer(toxicity.Model(weights, (-2.0, 1.0, 0.0)), chars)
    assert scorer.score(written) > scorer.score("they are there")


def every_reading(token, model, spaced):
    """The best reading by trying them all: options per run of equal characters, word edges between."""
    T, code = toxicity, lambda c: int(toxicity._CODE[ord(c)]) if ord(c) < len(toxicity._CODE) else 0
    runs = [(k, len(list(g))) for k, g in itertools.groupby(token)]
    options = []
    for at, (c, n) in enumerate(runs):
        letter, sides = code(c) > 0, [x for x, _ in runs]
        own = {}
        if letter:
            own[c] = T.DOUBLE if n == 2 else T.REPEATED * (n - 1) if n > 2 else 0.0
            if n > 1:
                own[c * 2] = T.REPEATED * (n - 2)
        else:
            own[c * n] = T.UNREAD
            if not spaced and (all(x in T._EDGES for x in sides[: at + 1]) or all(x in T._EDGES for x in sides[at:])):
                own[""] = T.TRIMMED
            for r in T.READINGS.get(c, ""):
                own[r] = T.REPLACED + (T.REPEATED if n > 1 else 0.0)
                if n > 1:
                    own[r * 2] = 2 * T.REPLACED
        options.append(own)
    best = None
    for picked in itertools.product(*[list(o.items()) for o in options]):
        for edges in itertools.product((False, True), repeat=len(runs) - 1) if spaced else [()]:
            text, cost = "", 0.0
            for k, (out, c) in enumerate(picked):
                if k and edges and edges[k - 1] and text:
                    text, cost = text + " ", cost + T.EDGE
                text, cost = text + out, cost + c
            codes = [0, 0, *map(code, text), 0]
            score = sum(model[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)) - cost
            if best is None or score > best[0] + 1e-9:
                best = score, text
    return best


@pytest.mark.parametrize("token", ["1d10t", "$tup1d", "stuupid", "a$$", "h@t3!", "l00ser", "(l0wn)", "idiiiot", "x9z", "!!", "b@d", "no", "k1ll!", "*ss"])
@pytest.mark.parametrize("spaced", [False, True])
def test_decoding_finds_the_best_of_all_readings(chars, token, spaced):
    d = toxicity.Decoder(chars)
    score, text = every_reading(token, chars.tolist(), spaced)
    read = d.decode(token, spaced=spaced)
    assert read == text and score > -1e9


@pytest.mark.parametrize("written,word", [("ki11", "kill"), ("idio7", "idiot"), ("stuupid", "stupid"), ("iddiot", "idiot"), ("a$$", "ass"), ("lo$er", "loser"), ("c1own", "clown")])
def test_no_token_passes_unread(chars, written, word):
    assert word in toxicity.readings(written, toxicity.Decoder(chars)).split()


@pytest.mark.parametrize("written", ["455", "1,995", "$100", "555-9311", "85.254.214.250", "3.14!"])
def test_numbers_are_themselves(chars, written):
    assert any(c.isdigit() for c in toxicity.readings(written, toxicity.Decoder(chars)))
    assert toxicity.is_number(written)


@pytest.mark.parametrize("token", ["the", "haus", "anderen", "weiß"])
def test_plain_tokens_have_one_path(chars, token):
    d = toxicity.Decoder(chars)
    assert all(len(o) == 1 for o in d.lattice(token)) and d.decode(token) == token == toxicity.restore_token(token, d)


def test_training_and_scoring_read_alike(chars):
    """Both go through one reader; it gives the words that the whole restored text has."""
    d = toxicity.Decoder(chars)
    text = "You $tupid iddiot, you are a s c u m 455 and (lown!! they h@te 105ers " + "x" * 600
    read = set(" ".join(toxicity.Reader(d, str).values(text)).split())
    assert {w.strip(toxicity._EDGES) for w in toxicity.restore(text, d).split()} <= {w.strip(toxicity._EDGES) for w in read}
