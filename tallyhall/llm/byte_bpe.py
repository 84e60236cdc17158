"""Byte-level BPE by a pair occurrence index.

The distinct pre-tokens of a batch lie one after another in one symbol list.
An index maps each adjacent pair to all its places. Ranks that are present are
taken in ascending order; every place of a rank's pair is merged, from left to
right or, where there are many that can't overlap, all at once by arrays, and
the lists of the neighbouring pairs are updated. A merge only makes
pairs of a higher rank than its own, so one ascending sweep gives every
pre-token the result of merging it alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhall.llm.common import texts_of, tuned
from tallyhall.llm.symbols import byte_symbols
from tallyhall.llm.tokens import default_path

# The pre-token pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's cache before it keeps only what the batch at hand has in common with it, and the longest piece kept.
CACHE_PIECES, CACHED_LENGTH = 800_000, 48
#: Bytes of pre-tokens in one index (a longer pre-token has its own), and places of a pair that are merged by arrays.
INDEX_BYTES, MANY = 1 << 20, 48
#: Marks after a word's letters; no contraction starts with one.
_MARKS = ".,|!?;:#*$%&"
_LED = re.compile(r" (?=[^\S ])")  # a space before other white space


WALL = (1 << 17) - 1  # stands between sequences; no rule has it


class Merges:
    """Merge rules: the rank of a pair (``left << 17 | right``), each rank's sides and result, and each symbol's partners."""

    def __init__(self, left: list[int], right: list[int], made: list[int], start: list[int]) -> None:
        self.left, self.right, self.made = left, right, made
        self.rank = {a << 17 | b: r for r, (a, b) in enumerate(zip(left, right, strict=True))}
        self.start = np.array(start, dtype=np.int32)
        self.start[255] = WALL  # no UTF-8 text has this byte
        byte_of = {x: i for i, x in enumerate(start) if i != 255}
        self.first = np.full((256, 256), -1, dtype=np.int32)
        after, before = defaultdict(list), defaultdict(list)
        for r, (a, b) in enumerate(zip(left, right, strict=True)):
            if self.rank[a << 17 | b] != r:
                continue
            after[a].append((b, r))
            before[b].append((a, r))
            if a in byte_of and b in byte_of:
                self.first[byte_of[a], byte_of[b]] = r
        self.after, self.before = ({x: np.array(v, dtype=np.int32).T for x, v in d.items()} for d in (after, before))


def merge_all(words: list[bytes], rules: Merges, kind: str) -> list[bytes]:
    """Merge every sequence of bytes by one index from each pair's rank to its places; symbols come back as arrays of ``kind``."""
    raw = np.frombuffer(b"\xff" + b"\xff".join(words) + b"\xff", dtype=np.uint8)
    n = len(raw)
    sym, after, before = array("i", rules.start[raw].tobytes()), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
    syms, afters, befores = (np.frombuffer(x, dtype=np.int32) for x in (sym, after, before))
    known = np.full(WALL + 1, -1, dtype=np.int32)
    places: defaultdict[int, list[int]] = defaultdict(list)
    rank, push = rules.rank.get, heapq.heappush

    def enter(ranks: np.ndarray, at: np.ndarray) -> list[int]:
        """Put places into the index under their pairs' ranks, -1 for none; the ranks that it lacked."""
        hit = np.flatnonzero(ranks >= 0)
        ranks, at = ranks[hit], at[hit]
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order].tolist()
        ends = [*(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)] if at else []
        lo, fresh = 0, []
        for q, hi in zip(ranks[[e - 1 for e in ends]].tolist() if at else (), ends, strict=True):
            if q not in places:
                fresh.append(q)
            places[q] += at[lo:hi]
            lo = hi
        return fresh

    active = enter(rules.first[raw[:-1], raw[1:]], np.arange(n - 1))
    heapq.heapify(active)
    while active:
        r = heapq.heappop(active)
        a, b, new = rules.left[r], rules.right[r], rules.made[r]
        at = places.pop(r)
        if a != b and len(at) >= MANY:  # such places can't overlap, so all are merged at once
            i = np.array(at, dtype=np.int32)
            i = i[syms[i] == a]
            j = afters[i]
            both = syms[j] == b
            i, j = i[both], j[both]
            k = afters[j]
            syms[i], syms[j], afters[i], befores[k] = new, -1, k, i
            h = befores[i]
            for partners, beside, where in ((rules.after.get(new), k, i), (rules.before.get(new), h, h)):
                if partners is not None:
                    known[partners[0]] = partners[1]
                    for q in enter(known[syms[beside]], where):
                        push(active, q)
                    known[partners[0]] = -1
            continue
        if a == b:
            at.sort()
        high = new << 17
        for i in at:
            if sym[i] != a:
                continue
            j = after[i]
            if sym[j] != b:
                continue
            sym[i], sym[j] = new, -1
            after[i] = k = after[j]
            before[k] = i  # a wall stands at both ends, so there is a place before and after
            q = rank(high | sym[k])
            if q is not None:
                if q not in places:
                    push(active, q)
                places[q].append(i)
            h = before[i]
            q = rank(sym[h] << 17 | new)
            if q is not None:
                if q not in places:
                    push(active, q)
                places[q].append(h)
    left = syms[syms >= 0]
    walls = np.flatnonzero(left == WALL)
    size, flat = np.dtype(kind).itemsize, left.astype(kind).tobytes()
    ends = (walls * size).tolist()
    return [flat[lo + size : hi] for lo, hi in zip(ends, ends[1:])]


class ByteBPE:
    """Encoder and decoder of one vocabulary file."""

    _made: dict[str, ByteBPE] = {}

    @classmethod
    def get(cls, path: str) -> ByteBPE:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("only files that normalize nothing and cut at byte level are read")
        names = byte_symbols()
        byte_of = {c: b for b, c in enumerate(names)}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        rules = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = [vocab[a] for a, _ in rules], [vocab[b] for _, b in rules]
        self.rules = Merges(left, right, [vocab[a + b] for a, b in rules], [vocab[c] for c in names])
        self.bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in vocab.items():
            if t not in self.special:
                self.bytes[i] = bytes(byte_of[c] for c in t)
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.kind = "H" if len(self.bytes) <= 1 << 16 else "I"
        self.decimal = [str(i) for i in range(len(self.bytes))]
        self.words = regex.compile(PATTERN)
        self.marks = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) or "(?!)")
        self.cache: dict[str, bytes] = {}

    def _pieces(self, text: str) -> list[str]:
        """Cut before every space that a non-space follows: pre-tokens never cross such a place."""
        pieces = text.split(" ")
        if "" in pieces or _LED.search(text):
            return regex.split(r"(?= \S)", text, flags=regex.V1)
        return [pieces[0], *[" " + p for p in pieces[1:]]]

    def _cut(self, piece: str) -> list[str]:
        """Pre-tokens of a piece. Letters of the Latin blocks, and marks after them, need no pattern."""
        stem = piece.rstrip(_MARKS)
        word = stem[1:] if stem[:1] == " " else stem
        if word.isalpha() and (word.isascii() or max(word) < "ɐ"):
            return [piece] if len(stem) == len(piece) else [stem, piece[len(stem) :]]
        return self.words.findall(piece)

    def _learn(self, wanted: set[str]) -> None:
        """Encode the pieces that aren't known, all their unknown pre-tokens in one index."""
        if len(self.cache) > CACHE_PIECES:
            self.cache = {p: self.cache[p] for p in wanted.intersection(self.cache)}
        cache = self.cache
        cuts = {p: self._cut(p) for p in wanted.difference(cache)}
        tokens = list({t for c in cuts.values() for t in c}.difference(cache))
        some, held = [], 0
        for at, t in enumerate(tokens, 1):
            some.append(t.encode())
            held += len(some[-1])
            if held >= INDEX_BYTES or at == len(tokens):
                cache.update(zip(tokens[at - len(some) : at], merge_all(some, self.rules, self.kind), strict=True))
                some, held = [], 0
        for p, c in cuts.items():
            if len(c) != 1:
                cache[p] = b"".join(map(cache.__getitem__, c))
        self.long = [p for p in [*cuts, *tokens] if len(p) > CACHED_LENGTH]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, special tokens in it included."""
        parts = []
        for t in texts:
            at, own = 0, []
            for m in self.marks.finditer(t) if self.special else ():
                own += [self._pieces(t[at : m.start()]) if m.start() > at else [], self.special[m[0]]]
                at = m.end()
            own.append(self._pieces(t[at:]) if at < len(t) else [])
            parts.append(own)
        self._learn(set().union(*(x for own in parts for x in own if isinstance(x, list))))
        get, out = self.cache.__getitem__, []
        for own in parts:
            ids: list[int] = []
            for x in own:
                if isinstance(x, list):
                    ids += array(self.kind, b"".join(map(get, x)))
                else:
                    ids.append(x)
            out.append(ids)
        for p in self.long:
            self.cache.pop(p, None)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def encode_decode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each whole text (null: empty) and decode its ids again.

    Columns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, with
    ``with_ids``, ``ids`` and ``decoded``. Each row stands alone: repeated rows
    and ids give repeated results, an empty table an empty one.
    """
    tuned(df.sparkSession)
    path = path or default_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.get(path)
        for batch in batches:
            rows: list[tuple] = []
            for ids in bpe.encode(texts_of(batch[1])):
                text = bpe.decode(ids)
                row = len(ids), hashlib.sha256(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
                rows.append((*row, ids, text) if with_ids else row)
            cols = list(zip(*rows, strict=True)) or [()] * (5 if with_ids else 3)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch[0], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
