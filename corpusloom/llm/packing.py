"""Packing along a space-filling curve.

Each document's token counts are hashed to a vector of ``HASHED`` coordinates and projected to ``DIMS``
dimensions; the cell it falls into has a key on the Hilbert curve. Documents are
range-sorted by that key, and neighbours along the curve fill sequences of
``SEQUENCE`` ids without gaps: a document is cut where a sequence is full. Ranges are
balanced by ids, not by documents: a row holds at most ``CHUNK`` ids, so a long document is many rows, and the number of
ranges follows the number of all ids. What is
left at the end of a range is cut into sequences whose lengths are powers of
two, which need no padding.

Defined cases: null and empty texts hold just the end id; copies share a key and
are dealt by doc_id, so a large group of them still spreads over ranges; rows
with the same doc_id stay separate; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import write_table
from corpusloom.llm.tokens import encoder

SEQUENCE, DIMS, DEPTH = 1024, 4, 12
#: Hashed coordinates (a power of two), ids of a row, ids of a range.
HASHED, CHUNK, RANGE_IDS = 1 << 14, 1024, 1 << 22


def hilbert_key(cells: np.ndarray, depth: int) -> np.ndarray:
    """Place on the Hilbert curve of integer cells (rows, dims) with coordinates below 2 ** depth (Skilling's transform)."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    for level in range(depth - 1, 0, -1):
        bit = np.int64(1 << level)
        below = bit - 1
        for i in range(n):
            flip = (x[:, i] & bit) != 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, i]) & below)
            x[:, 0] ^= np.where(flip, below, swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    for level in range(depth - 1, 0, -1):
        turn ^= np.where(x[:, n - 1] & np.int64(1 << level), np.int64((1 << level) - 1), 0)
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(depth - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> level) & 1)
    return key


def projections(hashed: int = HASHED, dims: int = DIMS, seed: int = 5) -> np.ndarray:
    """A fixed random direction for each hashed coordinate."""
    return np.random.default_rng(seed).standard_normal((hashed, dims)).astype(np.float32)


def coordinates(ids: np.ndarray, hashed: int) -> np.ndarray:
    """The hashed coordinate of each token id: the upper bits of a multiplicative hash."""
    return (ids.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(33 - hashed.bit_length())


def cell(ids: np.ndarray, table: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Cell of a document: projected square-root counts, each coordinate spread evenly by the normal distribution."""
    if not len(ids):
        return np.zeros(table.shape[1], np.int64)
    place, times = np.unique(coordinates(ids, len(table)), return_counts=True)
    weight = np.sqrt(times)
    v = weight @ table[place] / np.linalg.norm(weight)
    return np.array([min((1 << depth) - 1, int((1 << depth) * 0.5 * math.erfc(-z / math.sqrt(2)))) for z in v], np.int64)


def encode(docs: DataFrame, vocabulary_path: str, word_ends: bool = False, end_id: int = 0) -> DataFrame:
    """Written table (doc_id, key, tie, start, ids, doc_tokens): rows of at most ``CHUNK`` ids of a document, the end id included,
    as little-endian unsigned 32-bit integers; ``tie`` tells the texts of one doc_id apart."""

    def run(batches):
        tokens, table = encoder(vocabulary_path, word_ends), projections()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                ids = tokens.many(piece.column(2).to_pylist())
                key = hilbert_key(np.stack([cell(x, table) for x in ids]), DEPTH)
                row, start, data, total = [], [], [], []
                for i, x in enumerate(ids):
                    x = np.append(x, np.uint32(end_id)).astype("<u4")
                    some = range(0, len(x), CHUNK)
                    row += [i] * len(some)
                    start += some
                    data += [x[j : j + CHUNK].tobytes() for j in some]
                    total += [len(x)] * len(some)
                row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column(0).take(row), pa.array(key).take(row), piece.column(1).take(row), pa.array(start, pa.int64()), pa.array(data, pa.binary()), pa.array(total, pa.int64())], ["doc_id", "key", "tie", "start", "ids", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return write_table(rows.mapInArrow(run, "doc_id long, key long, tie long, start long, ids binary, doc_tokens long"), "packing-ids")


def _powers(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def pack(encoded: DataFrame, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for)."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "local_sequence", "offset", *["ids"] * with_ids, "part"]
    kinds = [*[pa.int64()] * 7, *[pa.binary()] * with_ids, pa.int32()]

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        open_pieces: list[tuple] = []  # of the sequence that isn't full: doc_id, start, ids, doc_tokens
        filled = 0

        def close(pieces, number):
            at = 0
            for doc_id, start, ids, total in pieces:
                data = ids.tobytes()
                rows.append((doc_id, start, len(ids), zlib.crc32(data), total, number, at, *[data] * with_ids, part))
                at += len(ids)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for doc_id, start, data, total in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), batch.column(3).to_pylist(), strict=True):
                ids = np.frombuffer(data.as_py(), "<u4")
                at = 0
                while at < len(ids):
                    take = ids[at : at + sequence - filled]
                    last = open_pieces[-1] if open_pieces else None
                    if last and last[0] == doc_id and last[1] + len(last[2]) == start + at and last[3] == total:  # goes on where the last row ended
                        open_pieces[-1] = (doc_id, last[1], np.concatenate([last[2], take]), total)
                    else:
                        open_pieces.append((doc_id, start + at, take, total))
                    at, filled = at + len(take), filled + len(take)
                    if filled == sequence:
                        close(open_pieces, n)
                        open_pieces, filled, n = [], 0, n + 1
                if len(rows) >= 4096:
                    yield batch_of(rows)
                    rows = []
        for size in _powers(filled):
            some, room = [], size
            while room:
                doc_id, start, ids, total = open_pieces[0]
                some.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    open_pieces[0] = (doc_id, start + room, ids[room:], total)
                else:
                    open_pieces.pop(0)
                room -= len(some[-1][2])
            close(some, n)
            n += 1
        if rows:
            yield batch_of(rows)

    size = encoded.agg(F.sum(F.length("ids"))).first()[0] or 0
    ranges = max(1, -(-size // (4 * RANGE_IDS)))
    order = ["key", "doc_id", "tie", "start"]
    ordered = encoded.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "start", "ids", "doc_tokens")
    schema = ", ".join(f"{name} {'binary' if k == pa.binary() else 'int' if k == pa.int32() else 'long'}" for name, k in zip(names, kinds, strict=True))
    pieces = write_table(ordered.mapInArrow(run, schema), "packed-pieces")
    totals = pieces.groupBy("part").agg((F.max("local_sequence") + 1).alias("total"))
    before = F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = totals.select("part", before.cast("long").alias("base"))  # a row for each range of keys
    placed = pieces.join(F.broadcast(base), "part").withColumn("sequence_id", F.col("base") + F.col("local_sequence"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
