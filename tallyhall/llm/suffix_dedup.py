"""Removal of byte strings that start at more than one place, by distributed prefix doubling.

A place is a byte offset in a text. Its rank at length L names the L bytes that
start there. Spark sorts places by the pair (rank at p, rank at p + L); pairs
that occur once drop out, the others name the ranks of length 2L; the last
length is the threshold (200).

Ranking every byte of a corpus would move each byte dozens of times, so places
are first settled many at a time. Of the ``FIRST``-byte strings inside a
200-byte window, the leftmost with the least hash is the window's anchor. Equal
windows have equal anchors at equal places in them. The windows of one anchor
are consecutive and cover its stretch. Each step gives consecutive windows an
inner name, of bytes that each of them has, and an outer name, of all bytes
they have together (``settled``): where the inner name is unique, so is every
window; where the outer name repeats, so does every window; otherwise one of
each outer name goes on. Steps:

1. An anchor's windows: its 50 bytes (rank at length 50), its whole stretch.
2. Of the stretches that go on, runs of ``RUN`` windows at equal distances from
   the anchor.
3. Of the runs that go on, single places by prefix doubling: pairs of ranks 50
   apart, then 100 apart.

All three are the same plain aggregations and joins at any size. Counts are
combined before the shuffle and joined to the rows in a plan of their own, so
that Spark can split a rank of any frequency over many tasks; nothing is
gathered by rank.

Ranks are 64-bit fingerprints. Two strings are taken as equal only where two of
them agree (the inner and the outer name; both ranks of the last pair), so a
place is taken wrongly with a chance of about its rank's frequency in 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhall.llm.common import discard, stash, tuned

THRESHOLD, FIRST = 200, 50
#: Windows of a run.
RUN = 16
#: Windows of one text worked on at once, and rows handed on at once.
_SEGMENT, _ROWS = 1 << 18, 1 << 16
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = h ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Prints:
    """Fingerprints of any substrings of some bytes."""

    def __init__(self, data: np.ndarray) -> None:
        self.up, self.down = _pow(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * self.up[: len(data)], out=self.sums[1:])

    def at(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * self.down[lo]

    def all(self, length: int) -> np.ndarray:
        """Of every substring of a length."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    m = len(v) - w + 1
    rows = np.pad(v, (0, -len(v) % w), constant_values=np.iinfo(v.dtype).max).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:m], ahead[w - 1 : w - 1 + m])


def anchors(data: bytes, threshold: int = THRESHOLD, first: int = FIRST) -> Iterator[tuple[np.ndarray, ...]]:
    """(place, rank, name of the stretch) of a text's anchors, piece by piece.

    A place is an anchor's offset and how far before it its first and its last
    window start (32, 16 and 16 bits).
    """
    for s in range(0, max(0, len(data) - threshold + 1), _SEGMENT):
        p = Prints(np.frombuffer(data, np.uint8)[s : s + _SEGMENT + threshold - 1])
        h = _mix(p.all(first), 0)
        low = np.uint64((1 << 24) - 1)
        placed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        x = (_least(placed, threshold - first + 1) & low).astype(np.int64)
        cut = np.flatnonzero(np.diff(x)) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(x)]]) - 1
        x = x[lo]
        shape = (x - lo) << 16 | (x - hi)
        yield (x + s) << 32 | shape, _mix(h[x], 1), _mix(p.at(lo, hi + threshold) + _mix(shape.astype(np.uint64), 3), 2)


def _binary(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.view(np.int64)) for c in columns], names)


_NAMED = "t long, u long, own long, place long, inner long, outer long"
_NAMES = [x.split()[0] for x in _NAMED.split(", ")]


def _anchor_rows(threshold: int, first: int):
    """Of ``t, u, own, text``: every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows = [], 0

            def done(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                which = pa.array(np.repeat([i for i, _ in held], [len(f[0]) for _, f in held]), pa.int64())
                cols = [np.concatenate([f[k] for _, f in held]) if held else np.zeros(0, np.int64) for k in range(3)]
                return _batch([*(batch[k].take(which) for k in range(3)), *cols], _NAMES)

            for i, text in enumerate(_binary(batch[3])):
                for found in anchors(text, threshold, first):
                    held.append((i, found))
                    rows += len(found[0])
                    if rows >= _ROWS:
                        yield done()
                        held, rows = [], 0
            yield done()

    return run


_CUT = "t long, u long, own long, data binary"


def _cut_stretches(threshold: int):
    """Of ``t, u, text, places``: each place's bytes, from its first window to its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, own, data = [], [], []
            for i, (text, places) in enumerate(zip(_binary(batch[2]), batch[3].to_pylist(), strict=True)):
                for p in places:
                    which.append(i)
                    own.append(p)
                    data.append(text[(p >> 32) - (p >> 16 & 0xFFFF) : (p >> 32) - (p & 0xFFFF) + threshold])
            w = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([batch[0].take(w), batch[1].take(w), pa.array(own, pa.int64()), pa.array(data, pa.binary())], [x.split()[0] for x in _CUT.split(", ")])

    return run


def _opened(own: np.ndarray, data: list[bytes]) -> tuple[Prints, np.ndarray]:
    """Fingerprints of all stretches' bytes, and where each stretch's anchor is in them."""
    starts = np.cumsum([0, *map(len, data)])[:-1]
    return Prints(np.frombuffer(b"".join(data), np.uint8)), starts + (own >> 16 & 0xFFFF)


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, value) of every value of some ranges."""
    n = last - first + 1
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]


def _run_rows(threshold: int, size: int):
    """Of ``t, u, own, data``: the runs of a stretch's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch[2].to_numpy()
            p, anchor = _opened(own, batch[3].to_pylist())
            far, near = own >> 16 & 0xFFFF, own & 0xFFFF
            which, k = _spread(near // size, far // size)
            x, a, b = anchor[which], np.minimum(far[which], k * size + size - 1), np.maximum(near[which], k * size)
            shape = a << 16 | b
            inner = _mix(p.at(x - k * size, x - k * size - size + 1 + threshold) + _mix(k.astype(np.uint64), 5), 4)
            outer = _mix(p.at(x - a, x - b + threshold) + _mix(shape.astype(np.uint64), 3), 6)
            w = pa.array(which)
            yield _batch([*(batch[k].take(w) for k in range(3)), own[which] >> 32 << 32 | shape, inner, outer], _NAMES)

    return run


def _place_rows(threshold: int, first: int):
    """Of ``t, u, own, data, places``: the ranks of the first length over each window of some runs."""
    names = ["t", "u", "place", *(f"r{k}" for k in range(threshold // first))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, places = batch[2].to_numpy(), batch[4].to_pylist()
            p, anchor = _opened(own, batch[3].to_pylist())
            of = np.repeat(np.arange(len(own)), [len(x) for x in places])
            place = np.array([y for x in places for y in x], np.int64)
            which, back = _spread(place & 0xFFFF, place >> 16 & 0xFFFF)
            at = anchor[of[which]] - back
            ranks = [_mix(p.at(at + d, at + d + first), 0) for d in range(0, threshold, first)]
            w = pa.array(of[which])
            yield _batch([batch[0].take(w), batch[1].take(w), place[which] >> 32 << 32 | back << 16 | back, *ranks], names)

    return run


def settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``t, u, place`` whose windows all repeat, ``t, u, own, place`` that go on) of a stashed table of names.

    ``rows`` is discarded. Of those that go on there is one for each outer name.
    """
    shared = stash(rows.groupBy("inner").agg(F.count("*").alias("n"), (F.min("outer") != F.max("outer")).alias("several")).filter("n > 1").select("inner", "several"), "names")
    some = stash(rows.join(shared, "inner"), "named")
    discard(rows)
    discard(shared)
    one = [F.first(c).alias(c) for c in ("several", "t", "u", "own", "place")]  # all of one row
    classes = stash(some.groupBy("inner", "outer").agg(F.count("*").alias("n"), *one), "classes")
    whole = stash(some.join(classes.filter("n > 1").select("inner", "outer"), ["inner", "outer"]).select("t", "u", "place").distinct(), "whole")
    discard(some)
    reps = stash(classes.filter("several").groupBy("t", "u", "own").agg(F.collect_list("place").alias("places")), "reps")
    discard(classes)
    return whole, reps


def doubled(places: DataFrame, ranks: int) -> DataFrame:
    """``t, u, place`` (and a rank) of the places whose bytes repeat, by pairs of ranks at growing offsets.

    ``places`` (stashed, discarded) has ``r0, r1, ...``: the ranks of one length
    that many bytes apart. A round sorts places by the pair at p, drops pairs
    that occur once and names the others' ranks of twice the length.
    """
    while ranks > 1:
        pairs = stash(places.groupBy("r0", "r1").agg(F.count("*").alias("n")).filter("n > 1").select("r0", "r1"), "pairs")
        longer = [F.xxhash64(f"r{k}", f"r{k + 1}").alias(f"r{k // 2}") for k in range(0, ranks, 2)]
        alive = stash(places.join(pairs, ["r0", "r1"]).select("t", "u", "place", *longer), "places")
        discard(places)
        discard(pairs)
        places, ranks = alive, ranks // 2
    return places


def repeated_spans(docs: DataFrame, threshold: int = THRESHOLD, first: int = FIRST, size: int = RUN) -> DataFrame:
    """``t, u, spans`` of each text (two hashes) that has repeats; spans may overlap.

    docs: ``t, u, own, text``, own being the document's id. Copies of a text are
    documents of their own: each repeats the other.
    """
    ranks = threshold // first
    if first * ranks != threshold or ranks & (ranks - 1):
        raise ValueError("the threshold must be the first length, doubled some times")
    size = min(size, first)
    whole, reps = settled(stash(docs.mapInArrow(_anchor_rows(threshold, first), _NAMED), "anchors"))
    # One stretch of each name: its bytes, cut from the text.
    key = reps.withColumnsRenamed({"t": "_t", "u": "_u", "own": "_own"})
    at = (F.col("t") == F.col("_t")) & (F.col("u") == F.col("_u")) & F.col("own").eqNullSafe(F.col("_own"))
    cuts = stash(docs.join(key, at).select("t", "u", "text", "places").mapInArrow(_cut_stretches(threshold), _CUT), "cuts")
    discard(reps)
    runs, open_ = settled(stash(cuts.mapInArrow(_run_rows(threshold, size), _NAMED), "runs"))
    kinds = "t long, u long, place long, " + ", ".join(f"r{k} long" for k in range(ranks))
    places = stash(cuts.join(open_, ["t", "u", "own"]).select("t", "u", "own", "data", "places").mapInArrow(_place_rows(threshold, first), kinds), "places")
    discard(cuts)
    discard(open_)
    single = doubled(places, ranks)
    x = F.shiftright("place", 32)
    lo = (x - F.shiftright("place", 16).bitwiseAND(F.lit(0xFFFF))).cast("int").alias("lo")
    hi = (x - F.col("place").bitwiseAND(F.lit(0xFFFF)) + threshold).cast("int").alias("hi")
    found = whole.unionByName(runs).unionByName(single.select("t", "u", "place"))
    spans = stash(found.groupBy("t", "u").agg(F.collect_set(F.struct(lo, hi)).alias("spans")), "spans")
    for done in (whole, runs, single):
        discard(done)
    return spans


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans in order, overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for s in sorted((x["lo"], x["hi"]) for x in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], s[1])
        else:
            out.append(s)
    return out


def _hashes(text) -> tuple:
    """A text's two hashes."""
    return F.xxhash64(text).alias("t"), F.xxhash64(F.lit(1), text).alias("u")


def remove_repeats(df: DataFrame, threshold: int = THRESHOLD, first: int = FIRST, text_col: str = "text", size: int = RUN) -> DataFrame:
    """Every row, with ``kept`` (binary: what is left of its text) and ``removed`` (array of lo, hi in bytes).

    Null texts are empty; texts under ``threshold`` bytes lose nothing; repeated
    rows lose everything that is long enough. ``doc_id`` may be null or repeat;
    ties don't matter, as every place of a repeated string goes. An empty table
    gives an empty one. Other columns are kept as they are.
    """
    tuned(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = repeated_spans(df.select(*_hashes(text), F.col("doc_id").cast("long").alias("own"), text.alias("text")), threshold, first, size)
    rows = df.select(F.struct(*df.columns).alias("_row"), *_hashes(text), text.alias("_text"))
    joined = rows.join(spans, ["t", "u"], "left").select("_row", "_text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for data, own in zip(_binary(batch[1]), batch[2].to_pylist(), strict=True):
                runs, last, left = merged(own), 0, []
                for lo, hi in runs:
                    left.append(data[last:lo])
                    last = hi
                kept.append(b"".join([*left, data[last:]]))
                removed.append([{"lo": lo, "hi": hi} for lo, hi in runs])
            pairs = pa.array(removed, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(kept, pa.binary()), pairs], ["_row", "kept", "removed"])

    kind = f"_row {df.select(F.struct(*df.columns).alias('r')).schema['r'].dataType.simpleString()}, kept binary, removed array<struct<lo:int,hi:int>>"
    return joined.mapInArrow(cut, kind).select("_row.*", "kept", "removed")


def digest(df: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    out = remove_repeats(df.select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + (x["hi"] - x["lo"]))
    left = F.octet_length("kept").cast("long")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), (left + removed).alias("n_bytes"), removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
