"""Token ids in files of patched frame-of-reference blocks.

A segment holds the ids of consecutive documents, cut into blocks of ``BLOCK``
ids. A block stores its smallest id, the bit width that covers ``COVERED`` of
the differences to it, the differences packed at that width, and a list of
exceptions (position and whole difference) for the others. A segment starts with
the ids and lengths of its documents and the byte at which every block starts, so
a reader can decode any document without the blocks before it. Layout, little-endian:

    b"PFB1", n_docs u32, n_ids u64, n_blocks u32
    doc ids i64 * n_docs (smallest i64: null), lengths u64 * n_docs, block starts u64 * (n_blocks + 1)
    per block: smallest u32, width u8, n_exceptions u8,
               packed differences 16 * width bytes, positions u8 * n, differences u32 * n

Segments are rows of a table that Spark writes, so any store that Spark reaches
holds them. Documents are dealt by ranges of doc_id and sorted inside; a segment's
place among all ids is the total of the ranges before plus that of its own range.

Defined cases: null and empty texts hold just the end id; rows with the same
doc_id, which may spread over ranges, stand in the order of a hash of their texts; null ids come first; an empty table
gives no rows. A document lies in one segment, whatever its length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import write_table
from corpusloom.llm.tokens import encoder, portions

BLOCK, COVERED, SEGMENT_IDS = 128, 0.9, 1 << 17
#: Blocks packed or decoded in one go.
TOGETHER = 2048
_HEAD = np.dtype([("magic", "S4"), ("docs", "<u4"), ("ids", "<u8"), ("blocks", "<u4")])
_BLOCK_HEAD = 6
_NULL = np.iinfo(np.int64).min


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit lengths of unsigned integers below 2 ** 52."""
    return np.where(x == 0, 0, np.frexp(x.astype(np.float64))[1]).astype(np.int64)


def _pack_blocks(flat: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of the blocks of ``flat`` and the size of each."""
    n_blocks = -(-len(flat) // BLOCK)
    grid = np.concatenate([flat, np.full(n_blocks * BLOCK - len(flat), flat[-1], np.uint32)]).reshape(n_blocks, BLOCK)
    low = grid.min(1)
    diff = grid - low[:, None]
    rank = int(np.ceil(COVERED * BLOCK)) - 1
    width = _bits(np.partition(diff, rank, axis=1)[:, rank])
    outlier = diff > (np.uint64(1) << width.astype(np.uint64))[:, None] - np.uint64(1)
    exceptions = outlier.sum(1)
    size = _BLOCK_HEAD + BLOCK // 8 * width + 5 * exceptions
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[at[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[at + 4], out[at + 5] = width, exceptions
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        bits = np.unpackbits(diff[rows].astype("<u4").view(np.uint8), axis=1, bitorder="little").reshape(len(rows), BLOCK, 32)
        packed = np.packbits(bits[:, :, :w].reshape(len(rows), -1), axis=1, bitorder="little")
        out[at[rows][:, None] + _BLOCK_HEAD + np.arange(packed.shape[1])] = packed
    row, column = np.nonzero(outlier)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    tail = at + _BLOCK_HEAD + BLOCK // 8 * width
    out[tail[row] + nth] = column
    out[(tail[row] + exceptions[row] + 4 * nth)[:, None] + np.arange(4)] = diff[row, column].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), size


def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One segment from documents' ids. Blocks are packed ``TOGETHER`` at a time, so bits of a long document are never expanded at once."""
    lengths = np.array([len(x) for x in ids], "<u8")
    flat = np.concatenate(ids).astype(np.uint32) if ids else np.empty(0, np.uint32)
    n_blocks = -(-len(flat) // BLOCK)
    head = np.array([(b"PFB1", len(ids), len(flat), n_blocks)], _HEAD).tobytes()
    named = np.array([_NULL if x is None else x for x in doc_ids], "<i8").tobytes()
    parts = [_pack_blocks(flat[at : at + TOGETHER * BLOCK]) for at in range(0, len(flat), TOGETHER * BLOCK)]
    starts = np.cumsum(np.concatenate([[0], *(size for _, size in parts)])).astype("<u8")
    return b"".join([head, named, lengths.tobytes(), starts.tobytes(), *(data for data, _ in parts)])


class Segment:
    """Reads a segment; ``ids(i)`` decodes only the blocks that document ``i`` reaches into."""

    def __init__(self, data: bytes):
        head = np.frombuffer(data, _HEAD, 1)[0]
        if head["magic"] != b"PFB1":
            raise ValueError("not a segment of token ids")
        n, blocks, at = int(head["docs"]), int(head["blocks"]), _HEAD.itemsize
        self.doc_ids = [None if x == _NULL else int(x) for x in np.frombuffer(data, "<i8", n, at)]
        self.lengths = np.frombuffer(data, "<u8", n, at + 8 * n).astype(np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])
        self.starts = np.frombuffer(data, "<u8", blocks + 1, at + 16 * n).astype(np.int64)
        self.body = np.frombuffer(data, np.uint8, offset=at + 16 * n + 8 * (blocks + 1))

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of the blocks first..last-1, ``TOGETHER`` blocks at a time."""
        parts = [self._decode(at, min(at + TOGETHER, last)) for at in range(first, last, TOGETHER)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.empty(0, np.uint32)])

    def _decode(self, first: int, last: int) -> np.ndarray:
        at = self.starts[first:last]
        out = np.zeros((len(at), BLOCK), np.uint32)
        low = self.body[at[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        width, exceptions = self.body[at + 4].astype(np.int64), self.body[at + 5].astype(np.int64)
        for w in np.unique(width[width > 0]):
            rows = np.flatnonzero(width == w)
            packed = self.body[at[rows][:, None] + _BLOCK_HEAD + np.arange(BLOCK // 8 * w)]
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
            value = np.zeros((len(rows), BLOCK), np.uint32)
            for k in range(w):
                value |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
            out[rows] = value
        row = np.repeat(np.arange(len(at)), exceptions)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        tail = at + _BLOCK_HEAD + BLOCK // 8 * width
        out[row, self.body[tail[row] + nth]] = self.body[(tail[row] + exceptions[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0] if len(row) else 0
        return (out + low[:, None]).reshape(-1)

    def ids(self, i: int) -> np.ndarray:
        begin, end = int(self.begins[i]), int(self.begins[i + 1])
        first, last = begin // BLOCK, -(-end // BLOCK)
        return self.blocks(first, last)[begin - first * BLOCK : end - first * BLOCK]

    def all_ids(self) -> list[np.ndarray]:
        flat = self.blocks(0, len(self.starts) - 1)
        return [flat[a:b] for a, b in zip(self.begins[:-1], self.begins[1:], strict=True)]


def write_tokens(docs: DataFrame, vocabulary_path: str, word_ends: bool = True, end_id: int = 1) -> DataFrame:
    """Writes all texts' ids in ascending doc_id order. Returns the written table (part, local_start, n_ids, data)."""

    def run(batches):
        encode = encoder(vocabulary_path, word_ends)
        part, done, size = TaskContext.get().partitionId(), 0, 0
        names: list = []
        held: list[np.ndarray] = []

        def segment():
            row = [[part], [done], [size], [pack(names, held)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "local_start", "n_ids", "data"])

        for batch in batches:
            for piece in portions(batch, 1):
                for name, text_ids in zip(piece.column(0).to_pylist(), encode.column(piece.column(1)), strict=True):
                    ids = np.append(text_ids, np.uint32(end_id))
                    names.append(name), held.append(ids)
                    size += len(ids)
                    if size >= SEGMENT_IDS:
                        yield segment()
                        names, held, done, size = [], [], done + size, 0
        if names:
            yield segment()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_tie"), "text")
    ordered = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").select("doc_id", "text")
    return write_table(ordered.mapInArrow(run, "part int, local_start long, n_ids long, data binary"), "token-segments", "uncompressed")


def read_tokens(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the written segments."""
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = totals.select("part", before.cast("long").alias("base"))  # a row for each range of ids

    def run(batches):
        for batch in batches:
            for data, start in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                s = Segment(data.as_py())
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in s.all_ids()]
                columns = (pa.array(s.doc_ids, pa.int64()), pa.array(s.begins[:-1] + start), pa.array(s.lengths), pa.array(crc, pa.int64()))
                yield pa.RecordBatch.from_arrays(list(columns), ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = segments.join(F.broadcast(base), "part").select("data", (F.col("base") + F.col("local_start")).alias("start"))
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
