"""Toxicity of text that may hide its words, by noisy-channel restoration.

A written token is taken as a noisy copy of a word: letters replaced by digits
or marks, letters spaced out or joined by marks, letters repeated. Each written
character opens a lattice of what it may stand for; Viterbi decoding picks the
reading that is likeliest under a character trigram model of the whole corpus
and the channel's costs. Every token goes through it, in training and scoring
alike; that of a token without digits, marks or doubled letters has one path,
the token itself. The restored text is scored by word and word-stem weights
learnt from a bounded labelled sample.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhall.llm.common import texts_of, tuned
from tallyhall.llm.labelled import held_out, sample

FOLDS, FOLD, THRESHOLD = 3, 1, 0.7
#: Labelled documents of each class that the weights are learnt from, at most.
AT_MOST = {0: 6000, 1: 3000}
SPACE = 1 << 20
STEMS = (4, 5, 6, 7)
#: Documents of a class that must have a feature before it gets a weight.
LEAST = 5
_EDGES = ".,!?;:%&*$#|\"'()[]{}<>-_~`"
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
ALPHABET = len(_LETTERS) + 1  # 0: not a letter, a word's edge

# What a written character may stand for besides itself.
READINGS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou"}
# Channel costs (natural log): a replaced letter, a dropped repeat, a word edge
# between spaced letters, a mark left as it is, a double letter read as one, a
# mark at a word's end that is only punctuation.
REPLACED, REPEATED, EDGE, UNREAD, DOUBLE, TRIMMED = 0.7, 0.3, 2.5, 6.0, 5.0, 4.0
#: Edges that can't be letters.
_PLAIN = "".join(c for c in _EDGES if c not in READINGS)

_CODE = np.zeros(0x180, np.int64)
for _k, _c in enumerate(_LETTERS):
    _CODE[ord(_c)] = _k + 1
_CHOICE = re.compile(r"[0-9@$!|+(€£*]|([^\W\d_])\1")  # more than one path through the lattice
_RUN = re.compile(r"([^\W\d_])\1\1")
_PAIR = re.compile(r"([0-9@$!|+(€£*])\1(?!\1)")
_JOINED = re.compile(r"^(?:[\w@$!|+(€£][.\-_*~]){2,}[\w@$!|+(€£]$")


def trigrams(text: str) -> np.ndarray:
    """Codes of a text's character trigrams (letters; anything else is an edge)."""
    u = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(u < len(_CODE), _CODE[np.minimum(u, len(_CODE) - 1)], 0)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    c = np.concatenate([[0], c])
    keep = (c[2:] != 0) | (c[1:-1] != 0)  # runs of non-letters say nothing
    return ((c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:])[keep]


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), trigrams smoothed by bigrams and those by a uniform share."""
    t = counts.reshape(ALPHABET, ALPHABET, ALPHABET).astype(np.float64)
    two = t.sum(0)
    p2 = (two + 0.5) / (two.sum(1, keepdims=True) + 0.5 * ALPHABET)
    return np.log((t + 8.0 * p2[None]) / (t.sum(2, keepdims=True) + 8.0)).astype(np.float32)


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts of all texts: partial counts per task, summed by Spark; at most ALPHABET cubed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(ALPHABET**3, np.int64)
        for batch in batches:
            grams = [trigrams(t) for t in texts_of(batch[0])]
            own += np.bincount(np.concatenate([np.zeros(0, np.int64), *grams]), minlength=len(own))
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at])], ["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(ALPHABET**3, np.int64)
    out[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return out


class Decoder:
    """Viterbi decoding of written tokens under a character model."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model.tolist()
        self.known: dict[tuple, list[tuple[str, float, tuple[int, ...]]]] = {}

    def _options(self, c: str, run: int, spaced: bool, pairs: bool, at_end: bool) -> list[tuple[str, float, tuple[int, ...]]]:
        """(reading, cost, codes) of a character written ``run`` times."""
        key = c, run, spaced, pairs, at_end
        if key not in self.known:
            own = _CODE[ord(c)] if ord(c) < len(_CODE) else 0
            options: list[tuple[str, float]] = []
            if own:
                options.append((c, (run > 1) * REPEATED * (run - 1) if run > 2 else (run == 2) * DOUBLE))
                if run > 1:
                    options.append((c + c, REPEATED * (run - 2)))
            for r in READINGS.get(c, ""):
                if run != 2 or not pairs:
                    options.append((r, REPLACED + (run > 1) * REPEATED))
                if run > 1:
                    options.append((r + r, 2 * REPLACED))
            if not own:
                options.append((c * run, UNREAD))
                if not spaced and at_end and not (pairs and run == 2 and c in READINGS):
                    options.append(("", TRIMMED))
            made = [(text, cost, tuple(int(_CODE[ord(x)]) if ord(x) < len(_CODE) else 0 for x in text)) for text, cost in options]
            if run > 64:
                return made
            self.known[key] = made
        return self.known[key]

    def lattice(self, token: str, spaced: bool = False, pairs: bool = False) -> list[list[tuple[str, float, tuple[int, ...]]]]:
        """What each run of equal characters may stand for.

        Marks at the ends may be letters or punctuation, which is left out.
        With ``pairs`` a mark that is written twice stands for two letters.
        """
        first, last = len(token) - len(token.lstrip(_EDGES)), len(token.rstrip(_EDGES))
        out, k = [], 0
        while k < len(token):
            c, lo = token[k], k
            while k < len(token) and token[k] == c:
                k += 1
            out.append(self._options(c, k - lo, spaced, pairs, lo < first or lo >= last))
        return out

    def decode(self, token: str, spaced: bool = False, pairs: bool = False) -> str:
        """The likeliest reading; with ``spaced`` word edges may be put between letters."""
        m = self.model
        states = [(0, 0, 0.0, "")]  # last but one, last, score, text
        for options in self.lattice(token, spaced, pairs):
            if len(options) == 1 and len(states) == 1 and not spaced:
                x, y, s, text = states[0]
                out, cost, codes = options[0]
                for z in codes:
                    s += m[x][y][z]
                    x, y = y, z
                states = [(x, y, s - cost, text + out)]
                continue
            nxt: dict[tuple[int, int], tuple[int, int, float, str]] = {}
            for a, b, score, text in states:
                for out, cost, codes in options:
                    for lead in ("", " ") if spaced and text else ("",):
                        x, y, s = a, b, score - cost
                        if lead:
                            s += m[x][y][0] - EDGE
                            x, y = y, 0
                        for z in codes:
                            s += m[x][y][z]
                            x, y = y, z
                        old = nxt.get((x, y))
                        if old is None or s > old[2]:
                            nxt[x, y] = x, y, s, text + lead + out
            states = list(nxt.values())
        return max((s + m[a][b][0], t) for a, b, s, t in states)[1]


def is_number(token: str) -> bool:
    """Whether a token has no letters and more digits than marks that may be letters."""
    if not token[:1] or any(c.isalpha() for c in token):
        return False
    digits = sum("0" <= c <= "9" for c in token)
    return digits > sum(c in READINGS for c in token) - digits


def restore_token(token: str, decoder: Decoder) -> str:
    """A token as read; a number is itself; letters written once or twice are also read as they are."""
    if _JOINED.match(token) and not is_number(token):
        return decoder.decode(re.sub(r"[.\-_*~]", "", token), spaced=True)
    if not _CHOICE.search(token) or is_number(token):
        return token  # one path
    read = [decoder.decode(token)]
    if token.isalpha() and not _RUN.search(token):
        read.insert(0, token)
    elif _PAIR.search(token):
        read.append(decoder.decode(token, pairs=True))
    return " ".join(dict.fromkeys(read))


def readings(written: str, decoder: Decoder) -> str:
    """A written word as read without the marks at its ends, and with those that may be letters if that differs."""
    inner = written.strip(_EDGES) or written
    read = restore_token(inner, decoder)
    if inner != written and (outer := written.strip(_PLAIN) or written) != inner:
        read = " ".join(dict.fromkeys([read, restore_token(outer, decoder)]))
    return read


def bare(written: str) -> str:
    """A word without the marks at its ends; of marks alone, those that may be letters."""
    return written.strip(_EDGES) or written.strip(_PLAIN) or written


def spaced_runs(words: list[str]) -> list[tuple[int, int]]:
    """(lo, hi) of runs of three or more one-character words that aren't all alike."""
    out, lo = [], None
    for k, w in enumerate([*words, ""]):
        if len(w) == 1 and not w.isspace():
            lo = k if lo is None else lo
        else:
            if lo is not None and k - lo >= 3 and len(set(words[lo:k])) > 1:
                out.append((lo, k))
            lo = None
    return out


def restore(text: str, decoder: Decoder) -> str:
    """A whole text, lower-cased, with its hidden words restored."""
    written = text.lower().split()
    words = [bare(w) for w in written]
    out, at = [], 0
    for lo, hi in spaced_runs(words):
        out += [readings(w, decoder) for w in written[at:lo]]
        out.append(decoder.decode("".join(words[lo:hi]), spaced=True))
        at = hi
    return " ".join([*out, *(readings(w, decoder) for w in written[at:])])


class Reader:
    """What the readings of a text's words and spaced-out words are worth; each written word is read once."""

    def __init__(self, decoder: Decoder, worth) -> None:
        self.decoder, self.worth = decoder, worth
        self.cache: dict[str, object] = {}
        self.single: dict[str, str] = {}  # of the written words in the cache, those of one character

    def values(self, text: str) -> list:
        words = text.lower().split()
        own, cache, single = set(words), self.cache, self.single
        if len(cache) > 400_000:
            cache.clear()
            single.clear()
        for w in own.difference(cache):
            cache[w] = self.worth(readings(w, self.decoder))
            if len(c := bare(w)) == 1:
                single[w] = c
        found = list(map(cache.__getitem__, own))
        if sum(map(single.__contains__, words)) >= 3:
            chars = [single.get(w, "") for w in words]
            found += [self.worth(self.decoder.decode("".join(chars[lo:hi]), spaced=True)) for lo, hi in spaced_runs(chars)]
        return found


_WORD, _STEM = zlib.crc32(b"w"), zlib.crc32(b"p")


def features(word: str) -> list[int]:
    """Places of a restored word: itself and its stems."""
    word = word.strip(_EDGES)
    if not word:
        return []
    raw, n = word.encode("utf-8", "surrogatepass"), len(word)
    cuts = [k if len(raw) == n else len(word[:k].encode("utf-8", "surrogatepass")) for k in STEMS if n > k]
    return [zlib.crc32(raw, _WORD) % SPACE, *[zlib.crc32(raw[:k], _STEM) % SPACE for k in cuts]]


@dataclass
class Model:
    weights: np.ndarray
    bias: tuple[float, float, float]  # intercept, of the largest weight, of log(1 + strong words)

    def score(self, largest: float, strong: int) -> float:
        z = self.bias[0] + self.bias[1] * largest + self.bias[2] * math.log1p(strong)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


STRONG = 3.0


def word_weights(places: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log ratio of the classes' shares of documents with a feature; 0 where it is rare or speaks for label 0."""
    n = [max(1, int((labels == k).sum())) for k in (0, 1)]
    c = [np.bincount(np.concatenate([np.zeros(0, np.int64), *[p for p, y in zip(places, labels, strict=True) if y == k]]).astype(np.int64), minlength=SPACE) for k in (0, 1)]
    w = np.log((c[1] + 0.5) / (n[1] + 1)) - np.log((c[0] + 0.5) / (n[0] + 1))
    return np.where(c[1] >= LEAST, np.maximum(w, 0), 0).astype(np.float32)


def fit(places: list[np.ndarray], labels: np.ndarray) -> Model:
    """Word weights, and a logistic fit of the largest and of how many are strong.

    The logistic fit sees each half of the sample through weights from the other
    half, so it isn't misled by words that only one document has; both classes
    count alike in it.
    """
    half = np.arange(len(places)) % 2
    x, y = [], []
    for k in (0, 1):
        w = word_weights([p for p, h in zip(places, half, strict=True) if h != k], labels[half != k])
        for p in (p for p, h in zip(places, half, strict=True) if h == k):
            x.append((1.0, w[p].max() if len(p) else 0.0, np.log1p((w[p] > STRONG).sum()) if len(p) else 0.0))
        y.append(labels[half == k])
    x, y = np.array(x), np.concatenate(y).astype(np.float64)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    b = np.zeros(3)
    for _ in range(25):  # Newton steps
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b += np.linalg.solve(x.T @ (x * (share * q * (1 - q))[:, None]) + 0.05 * np.eye(3), x.T @ (share * (y - q)) - 0.05 * b)
    return Model(word_weights(places, labels), tuple(b))


def train(docs: DataFrame, labels: DataFrame, model: np.ndarray, at_most: dict[int, int] | None = None) -> Model | None:
    lm = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Decoder(lm.value), lambda read: [f for w in read.split() for f in features(w)])
        for batch in batches:
            places = [np.array(sorted(set(chain.from_iterable(reader.values(t)))), np.int32).tobytes() for t in texts_of(batch[1])]
            yield pa.RecordBatch.from_arrays([batch[0], batch[2].cast(pa.int32()), pa.array(places, pa.binary())], ["doc_id", "label", "places"])

    rows = sample(docs, labels, "toxic", FOLDS, FOLD, at_most or AT_MOST).mapInArrow(run, "doc_id long, label int, places binary").toArrow()
    if not rows.num_rows:
        return None
    rows = rows.sort_by("doc_id")
    return fit([np.frombuffer(b, np.int32) for b in rows["places"].to_pylist()], rows["label"].to_numpy())


class Scorer:
    """Scores texts by their words' largest weights."""

    def __init__(self, model: Model, lm: np.ndarray) -> None:
        self.model, self.weights = model, model.weights.tolist()
        self.reader = Reader(Decoder(lm), self.weight)

    def weight(self, read: str) -> float:
        return max((self.weights[f] for w in read.split() for f in features(w)), default=0.0)

    def score(self, text: str) -> float:
        found = [v for v in self.reader.values(text) if v > 0]
        return self.model.score(max(found, default=0.0), sum(v > STRONG for v in found))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Null texts are empty; empty texts have the score of a text without any
    weighted word. Without labels all scores are 0. A null id isn't held out.
    Repeated rows stay; other columns are ignored; ties don't arise.
    """
    spark = tuned(docs.sparkSession)
    lm = language_model(corpus_counts(docs))
    shared = spark.sparkContext.broadcast((train(docs, labels, lm), lm))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, chars = shared.value
        scorer = Scorer(model, chars) if model else None
        for batch in batches:
            s = np.array([scorer.score(t) if scorer else 0.0 for t in texts_of(batch[2])], np.float64)
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", FOLDS, FOLD).alias("held_out"), "text")
    return src.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
