"""Packing documents into fixed-length sequences by a grouping genetic algorithm.

An individual is a list of bins. Crossover injects whole well-filled bins of
one parent into the other, removes the bins that now hold a piece twice and
best-fits the pieces this displaces. Pieces are dealt into blocks of bounded
size; each block is worked on by several islands, which exchange their elite
between rounds until one meets the lower bound. What little a block can't fill
(its poorest bins) is released and packed again together with the leftovers of
other blocks, level by level, until one block remains; so waste doesn't add up
over blocks and no task ever holds more than one block.
"""

from __future__ import annotations

import random
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhall.llm.common import discard, stash, texts_of, tuned
from tallyhall.llm.tokens import WordEncoder, default_path

CAPACITY = 4096
END_ID = 1
#: Pieces of a block, islands that work on each, rounds between which elites migrate.
BLOCK_PIECES, ISLANDS, ROUNDS = 8192, 2, 3
#: Individuals of an island, generations in a round, and how far down a first order's noise takes a size.
POPULATION, GENERATIONS, NOISE = 4, 8, 0.8
#: Share of a block's bins, poorest first, that is packed again with other blocks' leftovers.
RELEASED = 0.02

_PIECE = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize, append ``end_id`` and cut documents longer than ``capacity``. Null texts are empty."""
    path = path or default_path("word_bpe_49k.json")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, uid = WordEncoder.get(path), TaskContext.get().partitionId() << 36
        for batch in batches:
            rows = []
            for doc, ids in zip(batch[0].to_pylist(), encoder.encode(texts_of(batch[1])), strict=True):
                ids += end
                for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo : lo + 4 * capacity]
                    rows.append((uid, doc, k, lo // 4, len(part) // 4, zlib.crc32(part)))
                    uid += 1
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _PIECE.split(", ")])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _PIECE)


class Bins:
    """Open bins by the room they have left; the tightest that fits is found in a bit mask."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.by_gap, self.mask, self.all = capacity, {}, 0, []

    def add(self, items: list[int], fill: int) -> None:
        self.all.append(items)
        self._shelve(items, self.capacity - fill)

    def _shelve(self, items: list[int], gap: int) -> None:
        if gap:
            self.by_gap.setdefault(gap, []).append(items)
            self.mask |= 1 << gap

    def best_fit(self, item: int, size: int) -> None:
        room = self.mask >> size
        if not room:
            return self.add([item], size)
        gap = size + (room & -room).bit_length() - 1
        shelf = self.by_gap[gap]
        items = shelf.pop()
        if not shelf:
            self.mask &= ~(1 << gap)
        items.append(item)
        self._shelve(items, gap - size)


def fitness(bins: list[list[int]], size: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the more unevenly filled, which leaves the more room to close one."""
    return len(bins), -sum((sum(size[i] for i in b) / capacity) ** 2 for b in bins)


def fit_all(order: list[int], size: list[int], capacity: int) -> list[list[int]]:
    bins = Bins(capacity)
    for i in order:
        bins.best_fit(i, size[i])
    return bins.all


def crossover(a: list[list[int]], b: list[list[int]], size: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Inject well-filled bins of ``b`` into ``a``; best-fit what that displaces, largest first."""
    full = [x for x in b if sum(size[i] for i in x) >= capacity - 1]
    injected = [x for x in full if rng.random() < 0.5]
    taken = {i for x in injected for i in x}
    bins, displaced = Bins(capacity), []
    for x in injected:
        bins.add(list(x), sum(size[i] for i in x))
    poor = sorted(range(len(a)), key=lambda k: sum(size[i] for i in a[k]))[: max(2, int(len(a) * rng.random()))]
    opened = set(poor)  # mutation: some of the bins, poorest first, are dissolved too
    for k, x in enumerate(a):
        if k in opened or not taken.isdisjoint(x):
            displaced += [i for i in x if i not in taken]
        else:
            bins.add(list(x), sum(size[i] for i in x))
    displaced.sort(key=lambda i: -size[i])
    for i in displaced:
        bins.best_fit(i, size[i])
    return bins.all


def evolve(size: list[int], capacity: int, seed: int, elite: list[list[list[int]]] = (), population: int = POPULATION, generations: int = GENERATIONS) -> tuple[list[list[int]], int]:
    """One island's best grouping and how many crossovers it took.

    The first individuals fit their pieces in noisy orders, which leaves waste;
    crossover has to close it. At least one generation is bred; then an island
    stops as soon as no grouping can have fewer bins.
    """
    bound, rng, bred = -(-sum(size) // capacity), random.Random(seed), 0
    people = [list(map(list, e)) for e in elite]
    while len(people) < population:
        noisy = sorted(range(len(size)), key=lambda i: -size[i] * rng.uniform(NOISE, 1.0))
        people.append(fit_all(noisy, size, capacity))
    key = lambda p: fitness(p, size, capacity)
    people.sort(key=key)
    for turn in range(generations):
        if turn and len(people[0]) <= bound:
            break
        half = people[: max(2, len(people) // 2)]
        while len(half) < population:
            x, y = rng.sample(range(len(half)), 2)
            half.append(crossover(half[x], half[y], size, capacity, rng))
            bred += 1
        people = sorted(half, key=key)
    return people[0], bred


def _island(keys: tuple, frame: pd.DataFrame, capacity: int, seed: int) -> pd.DataFrame:
    """Evolve one island. A piece comes once per elite that the island starts from (``bin`` null: none yet)."""
    frame = frame.sort_values(["origin", "uid"], kind="stable")
    own = frame.drop_duplicates("uid").reset_index(drop=True)
    at = {u: i for i, u in enumerate(own["uid"])}
    elite = []
    for _, sol in frame[frame["bin"] >= 0].groupby("origin"):
        grouped: dict[int, list[int]] = {}
        for u, b in zip(sol["uid"], sol["bin"], strict=True):
            grouped.setdefault(b, []).append(at[u])
        elite.append(list(grouped.values()))
    size = own["length"].tolist()
    best, bred = evolve(size, capacity, seed * 1_000_003 + int(keys[0]) * 31 + int(keys[1]), elite)
    bins = np.empty(len(size), np.int64)
    for k, x in enumerate(best):
        bins[x] = k
    own["bin"], own["island"], own["origin"] = bins, int(keys[1]), 0
    own["bins"], own["bound"], own["crossovers"] = len(best), -(-sum(size) // capacity), int(frame["crossovers"].max()) + bred
    return own


def _placed(keys: tuple, frame: pd.DataFrame, capacity: int, level: int, last: bool) -> pd.DataFrame:
    """The best island's bins: gapless offsets, and which bins are released to the next level."""
    best = frame.sort_values(["bins", "island"], kind="stable")["island"].iloc[0]
    own = frame[frame["island"] == best].sort_values(["bin", "uid"], kind="stable").reset_index(drop=True)
    own["offset"] = own.groupby("bin")["length"].cumsum() - own["length"]
    own["sequence_id"] = (level << 58) + (int(keys[0]) << 16) + own["bin"]
    fill = own.groupby("bin")["length"].sum()
    poor = fill[fill < capacity].sort_values(kind="stable").index[: max(2, int(len(fill) * RELEASED))]
    own["released"] = False if last else own["bin"].isin(poor)
    return own


def _grouped(fn, *args):
    """A (key, frame) function with its other arguments bound."""

    def run(keys, frame):
        return fn(keys, frame, *args)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES, islands: int = ISLANDS, rounds: int = ROUNDS) -> DataFrame:
    """Place pieces (``cut_pieces``) in sequences of ``capacity`` tokens: adds ``sequence_id``, ``offset`` and the ``crossovers`` that the island which placed a piece took."""
    spark = tuned(pieces.sparkSession)
    cols = [F.col(x.split()[0]) for x in _PIECE.split(", ")]
    done = [pieces.filter(F.col("length") >= capacity).select(*cols, (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("crossovers"))]
    left, level = pieces.filter(F.col("length") < capacity).select(*cols), 0
    island_schema = _PIECE + ", block long, island int, origin int, bin long, crossovers long, bins long, bound long"
    placed_schema = island_schema + ", offset long, sequence_id long, released boolean"
    while n := left.count():
        blocks = -(-n // block_pieces)
        home = F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks)).alias("block")
        start = left.select(*cols, home, F.lit(0).alias("origin"), F.lit(-1).cast("long").alias("bin"), F.lit(0).cast("long").alias("crossovers"))
        todo = start.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
        solved, islands_ = [], []
        for turn in range(rounds):
            out = stash(todo.groupBy("block", "island").applyInPandas(_grouped(_island, capacity, turn), island_schema), "islands")
            islands_.append(out)
            hit = F.col("bins") <= F.col("bound")
            least = out.groupBy("block").agg(F.min("bins").alias("least"))
            if turn == rounds - 1 or not (open_ := out.join(least, "block").filter(F.col("least") > F.col("bound"))).limit(1).count():
                solved.append(out)
                break
            solved.append(out.join(least, "block").filter(F.col("least") <= F.col("bound")).filter(hit).drop("least"))
            elite = open_.drop("least")  # each island starts again from its own elite and its neighbour's
            guests = elite.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands))).withColumn("origin", F.lit(1))
            todo = elite.unionByName(guests).drop("bins", "bound")
        every = solved[0]
        for s in solved[1:]:
            every = every.unionByName(s)
        placed = stash(every.groupBy("block").applyInPandas(_grouped(_placed, capacity, level, blocks == 1), placed_schema), "placed")
        for s in islands_:
            discard(s)
        done.append(placed.filter(~F.col("released")).select(*cols, "sequence_id", "offset", "crossovers"))
        left, level = placed.filter("released").select(*cols), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(df: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack a table of documents.

    Null texts are empty (one end id); an empty table gives an empty result;
    repeated rows and ids are packed as documents of their own; of groupings
    with equally many bins any may win; other columns are ignored.
    """
    tuned(df.sparkSession)
    pieces = stash(cut_pieces(df, path, capacity=capacity), "pieces")
    return pack(pieces, capacity).drop("uid")
