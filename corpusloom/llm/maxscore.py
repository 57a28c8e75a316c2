"""Ranked lexical search by Block-Max MaxScore over an index in shards of documents.

``build`` cuts each task's documents into shards of bounded words. A shard gives one
row for each of its terms: postings in blocks of ``BLOCK`` documents, packed into one, two or four
bytes a number, and for each block its last document, its bytes' end and its impacts: the pairs
(occurrences, document's terms) that no other pair of the block beats in both. Scores rise with the
first and fall with the second, so a block's exact maximum follows from them for any statistics.
One more row of the shard holds its documents.

``search`` takes the items in blocks, reads the rows of their terms and brings those of a
shard together. There each item is searched in windows of documents: lists whose bounds together can't
reach the heap's least score are non-essential; documents of essential lists are candidates;
a candidate whose sum and non-essential block maxima stay below that score is rejected before any of these blocks
is unpacked. Each shard gives its best ``k``, which are merged.

Only statistics, packed postings of asked terms and heaps move between tasks. An item's terms are on
the driver in blocks of at most ``ITEM_TERMS`` terms (or one item), never documents.

Defined cases: null texts and texts without terms rank nowhere and don't count; items without terms, or whose terms occur nowhere, get no rows;
rows of either table with the same id are separate rows; documents with a null id
come last among equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import write_table

BLOCK, WINDOW = 128, 4096
#: Words after which a shard is closed.
SHARD_WORDS = 4_000_000
ITEM_TERMS = 100_000
B = 75

# A-Z become a-z; digits, letters and all bytes of other characters stay; the rest ends a term.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

INDEX = "shard string, term binary, df long, words long, heads binary, impacts binary, body binary"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERMS).split()


class _Ids(dict):
    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def _runs(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive groups of these sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _column(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary cell for each end (in bytes) in ``data``."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


def _packed(shard: str, known: _Ids, ids: list[np.ndarray], doc_ids: list[int | None]) -> Iterator[pa.RecordBatch]:
    """The rows of a shard whose document i has the terms ``ids[i]``."""
    names = pa.array(list(known), pa.binary())
    lengths = np.array([len(x) for x in ids], np.int64)
    pairs, tf = np.unique(np.concatenate(ids).astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    term, doc = np.divmod(pairs, len(ids))
    df = np.bincount(term, minlength=len(known))
    # blocks: of postings, then of terms
    place = _runs(df)
    blocks_of = -(-df // BLOCK)
    first = np.flatnonzero(place % BLOCK == 0)
    size = np.diff(np.append(first, len(doc)))
    block = np.repeat(np.arange(len(first)), size)
    gap = doc - np.where(place == 0, 0, np.append(0, doc[:-1]))
    most = np.maximum(np.maximum.reduceat(gap, first), np.maximum.reduceat(tf, first))
    width = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))
    begins = np.cumsum(2 * width * size) - 2 * width * size
    body = np.zeros(int((2 * width * size).sum()), np.uint8)
    inside = _runs(size)
    for w in (1, 2, 4):
        mine = width[block] == w
        if mine.any():
            at = begins[block[mine]] + inside[mine] * w
            for values, shift in ((gap[mine], 0), (tf[mine], size[block[mine]] * w)):
                body[(at + shift)[:, None] + np.arange(w)] = values.astype(f"<u{w}").view(np.uint8).reshape(-1, w)
    # impacts: by falling occurrences, those with fewer terms than all before
    n = lengths[doc]
    order = np.lexsort((n, -tf, block))
    lowest = np.minimum.accumulate((n - block * (lengths.max() + 1))[order])
    kept = order[np.append(True, lowest[1:] < lowest[:-1])]
    counts = np.bincount(block[kept], minlength=len(first))
    ends_of_term = np.cumsum(blocks_of)
    term_begin = np.repeat(np.append(0, ends_of_term[:-1]), blocks_of)
    impact_ends, byte_ends = np.cumsum(counts), begins + 2 * width * size
    base = np.append(0, impact_ends), np.append(0, byte_ends)
    heads = np.stack([doc[first + size - 1], size, width, byte_ends - base[1][term_begin], impact_ends - base[0][term_begin]], 1).astype("<i4")
    impacts = np.stack([tf[kept], n[kept]], 1).astype("<i8")
    per_term = ends_of_term - 1
    full = pa.RecordBatch.from_arrays(
        [pa.array([shard] * len(known)), names, pa.array(df), pa.nulls(len(known), pa.int64()), _column(heads, ends_of_term * 20), _column(impacts, impact_ends[per_term] * 16), _column(body, byte_ends[per_term])],
        names=["shard", "term", "df", "words", "heads", "impacts", "body"],
    )
    for at in range(0, len(full), 20_000):
        yield full.slice(at, 20_000)
    missing = np.array([x is None for x in doc_ids], np.uint8).tobytes()
    numbers = np.array([x or 0 for x in doc_ids], "<i8").tobytes()
    row = {"shard": [shard], "term": [None], "df": [len(ids)], "words": [int(lengths.sum())], "heads": [missing], "impacts": [lengths.astype("<i8").tobytes()], "body": [numbers]}
    yield pa.RecordBatch.from_pydict(row, schema=full.schema)


def _indexed(batches: Iterator[pa.RecordBatch], most: int = SHARD_WORDS) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    known, ids, doc_ids, words = _Ids(), [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = terms_of(text.as_py())
            if not found:
                continue
            ids.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
            doc_ids.append(doc_id)
            words += len(found)
            if words >= most:
                yield from _packed(f"{part}-{n}", known, ids, doc_ids)
                known, ids, doc_ids, words, n = _Ids(), [], [], 0, n + 1
    if ids:
        yield from _packed(f"{part}-{n}", known, ids, doc_ids)


def build(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The index of ``docs`` (doc_id, text), written into the shared folder; one row for each term of a shard and one for its documents."""
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return write_table(raw.mapInArrow(lambda batches: _indexed(batches, shard_words), INDEX), "index")


class _Query(NamedTuple):
    number: int
    terms: list[bytes]
    weights: np.ndarray


def part_scores(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class _List:
    """Postings of one term in a shard. Blocks are unpacked when they are asked for."""

    def __init__(self, row, m_of) -> None:
        self.heads = np.frombuffer(row.heads, "<i4").reshape(-1, 5).astype(np.int64)
        pairs = np.frombuffer(row.impacts, "<i8").reshape(-1, 2)
        ends = self.heads[:, 4]
        self.most = np.maximum.reduceat(part_scores(pairs[:, 0], m_of(pairs[:, 1])), np.append(0, ends[:-1]))
        self.last, self.body, self.bound = self.heads[:, 0], row.body, int(self.most.max())
        self.done: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of block ``i`` and their part of a score."""
        if i not in self.done:
            _, size, width, end, _ = (int(x) for x in self.heads[i])
            values = np.frombuffer(self.body, f"<u{width}", 2 * size, end - 2 * size * width).astype(np.int64)
            docs = np.cumsum(values[:size]) + (int(self.last[i - 1]) if i else 0)
            self.done[i] = docs, part_scores(values[size:], m[docs])
        return self.done[i]

    def window(self, low: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All documents from ``low`` on in a window, counted from there, and their parts."""
        if low not in self.windows:
            a, b = np.searchsorted(self.last, (low, low + WINDOW - 1))
            parts = [self.block(i, m) for i in range(int(a), min(int(b) + 1, len(self.last)))]
            docs, part = (np.concatenate([p[j] for p in parts]) if parts else np.empty(0, np.int64) for j in (0, 1))
            inside = slice(*np.searchsorted(docs, (low, low + WINDOW)))
            self.windows[low] = docs[inside] - low, part[inside]
        return self.windows[low]


def _search(query: _Query, lists: dict[bytes, _List], m: np.ndarray, rank: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The ``k`` best (score, document) of a shard; ``rank`` settles equal scores."""
    mine = sorted(((int(w) * lists[t].bound, int(w), lists[t]) for t, w in zip(query.terms, query.weights, strict=True) if t in lists and w > 0), key=lambda x: x[0])
    if not mine:
        return []
    bounds = np.cumsum([x[0] for x in mine])
    best_docs, best = np.empty(0, np.int64), np.empty(0, np.int64)
    for low in range(0, len(m), WINDOW):
        high = min(low + WINDOW, len(m))
        least = int(best[k - 1]) if len(best) >= k else 1
        split = int(np.searchsorted(bounds, least))  # lists before it can't reach the heap together
        if split == len(mine):
            break
        sums = np.zeros(high - low, np.int64)
        for _, w, postings in mine[split:]:
            docs, part = postings.window(low, m)
            sums[docs] += w * part
        found = np.flatnonzero(sums)
        if split and len(found):
            # the most that lists which aren't essential can add, by the block a candidate would be in
            maxima = np.stack([w * np.append(p.most, 0)[np.searchsorted(p.last, found + low)] for _, w, p in mine[:split]])
            left = maxima.sum(0)
            for j in range(split - 1, -1, -1):
                alive = sums[found] + left >= least
                found, left, maxima = found[alive], left[alive], maxima[:, alive]
                if not len(found):
                    break
                left = left - maxima[j]
                _, w, postings = mine[j]
                where = np.searchsorted(postings.last, found + low)
                for i in np.unique(where[where < len(postings.last)]).tolist():
                    docs, part = postings.block(i, m)
                    asked = found[where == i]
                    at = np.searchsorted(docs, asked + low)
                    sums[asked] += np.where(docs[at] == asked + low, w * part[at], 0)
        if len(found):
            docs = np.concatenate((best_docs, found + low))
            scores = np.concatenate((best, sums[found]))
            order = np.lexsort((rank[docs], -scores))[:k]
            best_docs, best = docs[order], scores[order]
    return list(zip(best.tolist(), best_docs.tolist(), strict=True))


def _searched(rows: pd.DataFrame, queries: list[_Query], n: int, total: int, k: int) -> pd.DataFrame:
    own = rows["term"].isna()
    out: list[tuple] = []
    if not own.all():
        held = rows[own].iloc[0]
        doc_ids, missing, lengths = np.frombuffer(held["body"], "<i8"), np.frombuffer(held["heads"], np.uint8), np.frombuffer(held["impacts"], "<i8")
        m_of = lambda x: 100 - B + B * x * n // total
        m = m_of(lengths)
        rank = np.empty(len(m), np.int64)
        rank[np.lexsort((doc_ids, missing))] = np.arange(len(m))
        lists = {bytes(r.term): _List(r, m_of) for r in rows[~own].itertuples()}
        for q in queries:
            out += [(q.number, None if missing[d] else int(doc_ids[d]), s) for s, d in _search(q, lists, m, rank, k)]
    numbers, ids, scores = zip(*out, strict=True) if out else ((), (), ())
    return pd.DataFrame({"number": pd.array(numbers, "int64"), "doc_id": pd.array(ids, "Int64"), "score": pd.array(scores, "int64")})


def _in_shard(sent: Broadcast, n: int, total: int, k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _searched(rows, sent.value, n, total, k)

    return run


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int, bytes]]]:
    block, size = [], 0
    for row in items.toLocalIterator():
        if block and size + row.size > most:
            yield block
            block, size = [], 0
        block.append((row.number, bytes(row.text)))
        size += row.size
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, k: int = 10, item_terms: int = ITEM_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each row of ``items`` (item_id, text).

    A term t weighs floor(1000 ln((2 N + 2) / (2 df + 1))); its part of a score is 10^9 tf div (1000 tf + 8 m) with
    m = 25 + 75 n N div L. All else is integer arithmetic, so results are the same however documents are dealt.
    """
    spark = index.sparkSession
    items = write_table(items.select(F.monotonically_increasing_id().alias("number"), "item_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")), "items")
    n, total = index.filter("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    found = None
    for block in _blocks(items.filter("size > 0").select("number", "text", "size"), 8 * item_terms):
        if not n:
            break
        bags = [(number, *np.unique(np.array(terms_of(text), object), return_counts=True)) for number, text in block]
        asked = spark.createDataFrame([(t,) for t in {t for _, terms, _ in bags for t in terms}] or [(b"",)], "term binary")
        rows = index.filter("term is not null").join(asked, "term", "left_semi")
        df = {bytes(r.term): r.df for r in rows.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # at most the terms of a block
        queries = []
        for number, terms, counts in bags:
            known = [(t, int(c)) for t, c in zip(terms, counts, strict=True) if t in df]
            weights = np.array([c * int(np.floor(1000 * np.log((2 * n + 2) / (2 * df[t] + 1)))) for t, c in known], np.int64)
            queries.append(_Query(number, [t for t, _ in known], weights))
        sent = spark.sparkContext.broadcast(queries)

        in_shard = _in_shard(sent, n, total, k)
        best = rows.unionByName(index.filter("term is null")).groupBy("shard").applyInPandas(in_shard, "number long, doc_id long, score long")
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "number long, doc_id long, score long")
    place = F.row_number().over(W.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    best = found.withColumn("rank", place).filter(F.col("rank") <= k)
    return best.join(items.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")
