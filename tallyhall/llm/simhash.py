"""SimHash fingerprints and their classes within a Hamming radius, by BK-trees.

Fingerprints are deduplicated first, so copies cost one row. Two fingerprints
that differ in at most ``RADIUS`` (3) of 64 bits agree in one of four 16-bit
blocks, and of the 48 other bits in one of four 12-bit blocks: each
fingerprint therefore goes to the 16 shards named by such a pair of block
values, and every link is found in at least one shard. A shard is a BK-tree
whose children are keyed by their Hamming distance to the parent; a search
follows only the edges within the radius. Shards are dealt in chunks of at
most ``TREE`` fingerprints: each chunk becomes a tree, and the tree is handed
to the queries of its own and of every later chunk of the shard. So what is
broadcast to a search has a proven bound however many fingerprints share a
shard. A search gives spanning links (one per query and tree group it
touches), not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhall.llm.common import discard, stash, texts_of, tuned
from tallyhall.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Fingerprints of one tree.
TREE = 2048
_BATCH_SHINGLES = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text; no words (or null): 0; fewer words than a shingle: the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and [\x20\x09-\x0D] only
    if not words:
        return 0
    counts, total, h = np.zeros(64, np.int64), 0, xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    for lo in range(0, n, _BATCH_SHINGLES):
        part = words[lo : lo + _BATCH_SHINGLES + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.array([h(g, SEED) for g in grams], "<u8")
        for k in range(0, len(hashes), 1 << 14):
            bits = np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(0, dtype=np.int64)
        total += len(hashes)
    return sum(1 << b for b in range(64) if 2 * counts[b] > total)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (signed 64-bit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, int] = {}
            out = []
            for t in texts_of(batch[1]):
                if t not in known:
                    known[t] = fingerprint(t)
                out.append(known[t])
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Integers by Hamming distance; children are keyed by their distance to the parent."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = [int(v) for v in values]
        self.children: list[dict[int, int]] = [{} for _ in self.values]
        for i in range(1, len(self.values)):
            v, at = self.values[i], 0
            while True:
                d = (v ^ self.values[at]).bit_count()
                child = self.children[at].get(d)
                if child is None:
                    self.children[at][d] = i
                    break
                at = child

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, places of the queries within the radius) for nodes that have any.

        All queries go down the tree together; along each edge go those whose
        distance to the parent is within the radius of the edge's key.
        """
        if not self.values or not len(queries):
            return
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, at = todo.pop()
            d = np.bitwise_count(queries[at] ^ np.uint64(self.values[node]))
            near = at[d <= radius]
            if len(near):
                yield node, near
            for key, child in self.children[node].items():
                go = at[(d >= max(0, key - radius)) & (d <= key + radius)]
                if len(go):
                    todo.append((child, go))


def _spanning(tree: BKTree, queries: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect exactly what all pairs within the radius connect."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    links = []
    for node, near in tree.search(queries, radius):
        v = tree.values[node]
        for q in queries[near].tolist():
            a, b = find(v), find(q)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((v, q))
    return links


def shard_keys(radius: int = RADIUS) -> list:
    """The 16 (block, block) keys of a fingerprint: any two within the radius share one."""
    if radius > 3:
        raise ValueError("shards of four by four blocks hold links of up to 3 bits")
    fp, keys = F.col("fp"), []
    for i in range(4):
        first = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
        low = fp.bitwiseAND(F.lit((1 << (16 * i)) - 1))
        high = F.shiftleft(F.shiftrightunsigned(fp, 16 * (i + 1)), 16 * i) if i < 3 else F.lit(0).cast("long")
        rest = low.bitwiseOR(high)  # the 48 other bits
        for j in range(4):
            second = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(F.lit(0xFFF))
            keys.append(F.shiftleft(first, 16).bitwiseOR(F.shiftleft(second, 4)).bitwiseOR(F.lit(4 * i + j)))
    return keys


def links(distinct: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """``src, dst``: spanning links between distinct fingerprints within the radius."""
    dealt = distinct.select("fp", F.explode(F.array(*shard_keys(radius))).alias("shard"))
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
    many = stash(dealt.join(sizes, "shard"), "shards")
    # Small shards: whole shards meet in a task, many in each.
    small = many.filter(F.col("n") <= tree).select("shard", "fp")
    near = small.repartition("shard").sortWithinPartitions("shard").mapInArrow(_search_shards(radius), "src long, dst long")
    # Large shards: chunks by a hash; each chunk's tree meets the queries of every chunk of its shard.
    large = many.filter(F.col("n") > tree).select("shard", "fp", F.ceil(F.col("n") / (tree // 2)).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    own = large.withColumn("chunk", chunk)
    trees = own.withColumns({"other": F.explode(F.expr("sequence(0, chunks - 1)")), "is_tree": F.lit(True)})
    asks = own.withColumns({"other": F.col("chunk"), "is_tree": F.lit(False)}).withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
    pairs = trees.unionByName(asks).filter("chunk <= other")

    def search(keys, frame):
        import pandas as pd

        a = frame.loc[frame["is_tree"], "fp"].to_numpy().view(np.uint64)
        b = frame.loc[~frame["is_tree"], "fp"].to_numpy().view(np.uint64)
        found = np.array(_spanning(BKTree(a), b, radius), np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"src": found[:, 0], "dst": found[:, 1]})

    far = pairs.groupBy("shard", "chunk", "other").applyInPandas(search, "src long, dst long")
    out = near.unionByName(far).distinct()
    out._shards = many
    return out


def _search_shards(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0, np.uint64)

        def done(out: list, values: np.ndarray) -> None:
            if len(values) == 2:
                if (int(values[0]) ^ int(values[1])).bit_count() <= radius:
                    out.append((int(values[0]), int(values[1])))
            elif len(values) > 2:
                out += _spanning(BKTree(values), values, radius)

        def pack(out: list) -> pa.RecordBatch:
            a = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            shard, fp = batch[0].to_numpy(), batch[1].to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.diff(shard)) + 1
            parts, out = np.split(fp, cuts), []
            firsts = shard[np.concatenate([[0], cuts])]
            if last is not None and firsts[0] == last:
                parts[0] = np.concatenate([held, parts[0]])
            elif last is not None:
                done(out, held)
            for p in parts[:-1]:
                done(out, p)
            last, held = firsts[-1], parts[-1]
            yield pack(out)
        if last is not None:
            out = []
            done(out, held)
            yield pack(out)

    return run


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Rows link if their fingerprints differ in ``radius`` bits or fewer;
    ``component_id`` is the least doc_id reachable. Texts without words (null,
    empty) have fingerprint 0 and link like any other. Repeated rows stay.
    Rows whose doc_id is null belong to their component like others; it is null
    only if no member has an id. Other columns are ignored.
    """
    tuned(df.sparkSession)
    prints = stash(fingerprints(df, id_col, text_col), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = links(least.select("fp"), radius)
    found = components(linked)
    discard(linked._shards)
    named = found.join(least.withColumnRenamed("fp", "node"), "node")
    roots = named.groupBy("component").agg(F.min("least").alias("root"))
    of = least.join(found.withColumnRenamed("node", "fp"), "fp", "left").join(roots, "component", "left")
    classes = of.select("fp", F.coalesce("root", "least").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
