"""Token-ID files as directly addressable codes.

An id is cut into chunks of ``BITS`` bits, lowest first. Level ``k`` holds the
``k``-th chunk of every id that has one, and a bitmap that tells which of those
ids go on at level ``k + 1``. A rank directory (bits set before each block of
``BLOCK`` bits) turns a place at one level into the place at the next, so any
token is read in as many steps as it has chunks and no block is decoded first.

File: ``MAGIC``, length of a JSON header (uint32, little endian), the header,
then the sections it lists (name, dtype, offset from the end of the header,
count). Sections: per level ``chunks``, ``bits``, ``ranks``; per document
``doc_id`` (int64), ``doc_null`` (uint8) and ``first`` (uint64, one more than
documents: its first token's place in the file, then the file's length).
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhall.llm.common import fresh_dir, open_fs, stash, texts_of, tuned
from tallyhall.llm.tokens import WordEncoder, default_path

MAGIC = b"DACIDS01"
BITS = 8
BLOCK = 512
#: Ids in one file at most, besides one document's.
FILE_IDS = 4_000_000
END_ID = 1


class Codes:
    """Directly addressable codes of an array of ids."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.levels = levels

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        rest, levels = np.asarray(ids, np.uint32), []
        while True:
            chunks = (rest & ((1 << BITS) - 1)).astype(np.uint8)
            rest = rest >> BITS
            more = rest > 0
            bits = np.packbits(more, bitorder="little")
            pad = -len(bits) % (BLOCK // 8)
            per = np.bitwise_count(np.pad(bits, (0, pad))).reshape(-1, BLOCK // 8).sum(1)
            ranks = np.concatenate([[0], np.cumsum(per)]).astype(np.uint64)
            levels.append((chunks, bits, ranks))
            rest = rest[more]
            if not len(rest):
                return cls(levels)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def rank(self, level: int, place: int) -> int:
        """Bits set before a place of a level's bitmap."""
        _, bits, ranks = self.levels[level]
        block, byte = place // BLOCK, place // 8
        n = int(ranks[block]) + int(np.bitwise_count(bits[block * (BLOCK // 8) : byte]).sum())
        if place % 8:
            n += (int(bits[byte]) & ((1 << place % 8) - 1)).bit_count()
        return n

    def __getitem__(self, place: int) -> int:
        """One id, without reading its neighbours."""
        if not 0 <= place < len(self):
            raise IndexError(place)
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[place]) << (BITS * level)
            if not bits[place // 8] >> (place % 8) & 1:
                return value
            place = self.rank(level, place)
        return value

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """Ids from place lo to before hi."""
        out = np.zeros(hi - lo, np.uint32)
        at = np.arange(hi - lo)
        for level, (chunks, bits, _) in enumerate(self.levels):
            if hi <= lo:
                break
            out[at] |= chunks[lo:hi].astype(np.uint32) << np.uint32(BITS * level)
            more = np.unpackbits(bits[lo // 8 : (hi + 7) // 8], bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)
            at = at[more]
            lo, hi = self.rank(level, lo), self.rank(level, hi)
        return out


def dump(doc_ids: list[int | None], firsts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file's bytes."""
    sections = [
        ("doc_id", np.array([x or 0 for x in doc_ids], np.int64)),
        ("doc_null", np.array([x is None for x in doc_ids], np.uint8)),
        ("first", np.asarray(firsts, np.uint64)),
    ]
    for k, (chunks, bits, ranks) in enumerate(Codes.of(ids).levels):
        sections += [(f"chunks{k}", chunks), (f"bits{k}", bits), (f"ranks{k}", ranks)]
    listed, offset = [], 0
    for name, a in sections:
        listed.append([name, a.dtype.str, offset, len(a)])
        offset += a.nbytes
    header = json.dumps({"bits": BITS, "block": BLOCK, "sections": listed}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *(a.tobytes() for _, a in sections)])


class TokenFile:
    """A file read back: ``doc_ids``, ``first`` and the ids by place."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token-ID file")
        size = struct.unpack_from("<I", data, 8)[0]
        header, base = json.loads(data[12 : 12 + size]), 12 + size
        if (header["bits"], header["block"]) != (BITS, BLOCK):
            raise ValueError("chunk or block size of another writer")
        a = {name: np.frombuffer(data, np.dtype(kind), count, base + offset) for name, kind, offset, count in header["sections"]}
        self.doc_ids = [None if null else int(x) for x, null in zip(a["doc_id"], a["doc_null"], strict=True)]
        self.first = a["first"]
        self.codes = Codes([(a[f"chunks{k}"], a[f"bits{k}"], a[f"ranks{k}"]) for k in range((len(a) - 3) // 3)])

    @classmethod
    def open(cls, url: str) -> TokenFile:
        fs, path = open_fs(url)
        with fs.open_input_file(path) as f:
            return cls(f.read())


def write_tokens(df: DataFrame, path: str | None = None, out_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode every text and write ids in ascending order of ``id_col`` (nulls first, equal ids by text hash).

    Null texts are empty and still get ``end_id``. Returns the manifest:
    ``part, seq, path, n_docs, n_ids``; only files it names belong to the
    store, so what a lost or repeated task wrote is never read.
    """
    spark = tuned(df.sparkSession)
    path, out_dir = path or default_path("word_bpe_49k.json"), out_dir or fresh_dir(spark, "dac")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = WordEncoder.get(path), TaskContext.get().partitionId()
        fs, root = open_fs(out_dir)
        fs.create_dir(root, recursive=True)
        end = struct.pack("<I", end_id)
        seq, ids, docs, firsts, held = 0, [], [], [0], 0

        def flush() -> pa.RecordBatch:
            name = f"{root}/part-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.dac"
            with fs.open_output_stream(name) as f:
                f.write(dump(docs, np.array(firsts, np.uint64), np.frombuffer(b"".join(ids), "<u4")))
            row = [part], [seq], [f"{out_dir}/{name.rpartition('/')[2]}"], [len(docs)], [held]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "seq", "path", "n_docs", "n_ids"])

        for batch in batches:
            for doc, b in zip(batch[0].to_pylist(), encoder.encode(texts_of(batch[1])), strict=True):
                ids.append(b + end)
                held += len(b) // 4 + 1
                docs.append(doc)
                firsts.append(held)
                if held >= FILE_IDS:
                    yield flush()
                    seq, ids, docs, firsts, held = seq + 1, [], [], [0], 0
        if docs:
            yield flush()

    src = df.select(F.col(id_col).cast("long").alias("_d"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    # The text's hash is part of the range key, so that rows without an id, or of one id, are dealt over many tasks.
    order = [F.col("_d").asc_nulls_first(), F.xxhash64("_t").asc()]
    dealt = src.repartitionByRange(*order).sortWithinPartitions(*order)
    return stash(dealt.mapInArrow(write, "part int, seq int, path string, n_docs long, n_ids long"), "dac-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files.

    Documents come as they were written: nulls first, equal ids in the order of
    their texts' hashes, repeated rows each on its own, empty texts as one end
    id; an empty manifest gives no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, base in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                f = TokenFile.open(url)
                first = f.first.astype(np.int64)
                crcs = np.empty(len(f.doc_ids), np.int64)
                for lo in range(0, len(f.doc_ids), 4096):  # a block of documents by random access
                    hi = min(lo + 4096, len(f.doc_ids))
                    ids = f.codes.slice(int(first[lo]), int(first[hi])).astype("<u4")
                    for i in range(lo, hi):
                        crcs[i] = zlib.crc32(ids[first[i] - first[lo] : first[i + 1] - first[lo]])
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, pa.int64()), pa.array(base + first[:-1]), pa.array(np.diff(first)), pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # Sums per part come first: only one row for each part meets in one task, not one for each file.
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", earlier(Window.orderBy("part")).alias("_parts"))
    within = manifest.withColumn("_files", earlier(Window.partitionBy("part").orderBy("seq")))
    files = within.join(parts, "part").select("path", (F.col("_parts") + F.col("_files")).alias("base"))
    n = manifest.count()
    return files.repartition(max(1, n)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
