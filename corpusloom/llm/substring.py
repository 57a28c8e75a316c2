"""Substring dedup: matching statistics of documents on suffix automata of repeated passages.

A passage is repeated where a window of ``window`` words also starts in a
document with a smaller id. All words of such windows go.

1. Every document gives winnowed fingerprints: of each window the smallest hash of
   its runs of ``RUN`` words. Equal windows give the same one, so a
   window that occurs in two documents holds a fingerprint of both.
2. Documents with such a fingerprint give the hashes of the windows around it; the
   first document of each window that two documents have owns it. Consecutive windows
   of one owner form its passages, so the passages hold each repeated window
   once.
3. Passages are dealt into shards of bounded size. A suffix automaton of each shard is
   built where it is needed, and every document that holds a window of a
   shard's owner streams through it: the length of the longest match ending at each
   word. Maximal spans of at least ``window`` matched words that a smaller
   document owns are removed.

The hashes of steps 1 and 2 only choose what is compared; what is removed is what the
automaton matches word by word. A shard's documents are dealt into bounded parts, so a passage that a
third of all documents hold is streamed by many tasks.

Defined cases: null and empty texts have no words; rows with a null id are left
whole and own nothing; rows that repeat an id with other texts aren't
compared with each other; exact repeats of a row are treated alike; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import WordHashes, drop_table, free_names, over_rows, release, utf8, windows, write_table

RUN = 20
SHARD_WORDS, PART_ROWS = 20_000, 512


def _rolling_min(x: np.ndarray, k: int) -> np.ndarray:
    size = 1
    while size * 2 <= k:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (k - size)], x[k - size :]) if k > size else x


def fingerprints(h: np.ndarray, window: int) -> np.ndarray:
    """Distinct winnowed fingerprints of a document from its words' hashes."""
    if len(h) < window:
        return np.empty(0, np.uint64)
    run = min(RUN, window)
    return np.unique(_rolling_min(windows(h, run), window - run + 1))


def near_fingerprints(h: np.ndarray, marks: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that hold a run whose hash is in ``marks``."""
    run = min(RUN, window)
    at = np.flatnonzero(np.isin(windows(h, run), marks))
    n = len(h) - window + 1
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.maximum(at - (window - run), 0), 1)
    np.add.at(edge, np.minimum(at + 1, n), -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


class SuffixAutomaton:
    """Of several word sequences; each state knows an owner of its sequences."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [0]

    def add(self, words: list[bytes], owner: int) -> None:
        nexts, link, length, owners = self.next, self.link, self.length, self.owner
        last = 0
        for c in words:
            q = nexts[last].get(c)
            if q is not None:  # a sequence that an earlier passage holds already
                last = q if length[q] == length[last] + 1 else self._clone(last, q, c)
                continue
            new = len(nexts)
            nexts.append({}), length.append(length[last] + 1), link.append(0), owners.append(owner)
            p = last
            while p != -1 and c not in nexts[p]:
                nexts[p][c] = new
                p = link[p]
            if p != -1:
                q = nexts[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = new

    def _clone(self, p: int, q: int, c: bytes) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q])), self.length.append(self.length[p] + 1), self.link.append(self.link[q]), self.owner.append(self.owner[q])
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def spans(self, words: list[bytes], least: int, below: int) -> list[tuple[int, int]]:
        """Maximal spans of words covered by matches of ``least`` words whose owner is smaller than ``below``."""
        nexts, link, length, owners = self.next, self.link, self.length, self.owner
        out: list[tuple[int, int]] = []
        state = matched = 0
        for j, c in enumerate(words):
            while state and c not in nexts[state]:
                state = link[state]
                matched = length[state]
            to = nexts[state].get(c)
            if to is None:
                matched = 0
                continue
            state, matched = to, matched + 1
            if matched >= least:
                s = state
                # the state of the last `least` words: its occurrences lie in one owner's passages
                while length[link[s]] >= least:
                    s = link[s]
                if owners[s] < below:
                    begin = j + 1 - least
                    if out and begin <= out[-1][1]:
                        out[-1] = (out[-1][0], j + 1)
                    else:
                        out.append((begin, j + 1))
        return out


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def repeated_spans(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, held, spans): ``profiles`` has a row (doc_id, text_key, n_words, digest, marks) for each document, ``held``
    the texts with a shared fingerprint, and ``spans`` (doc_id, text_key, spans) what repeats in them."""

    def profile():
        hashes = WordHashes()

        def row(doc_id, text_key, text):
            words = utf8(text).split()
            marks = fingerprints(hashes.of(words), window) if doc_id is not None else np.empty(0, np.uint64)
            return doc_id, text_key, len(words), hashlib.sha256(b" ".join(words)).hexdigest(), _signed(marks)

        return row

    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    profiles = write_table(over_rows(keyed, profile, "doc_id long, text_key long, n_words long, digest string, marks array<bigint>"), "profiles")

    # equal word sequences are indexed once, by their smallest and largest id; each of them is streamed
    marked = profiles.filter("size(marks) > 0")
    texts = marked.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    leaders = marked.join(texts, "digest").filter("doc_id = first").dropDuplicates(["doc_id", "digest"])
    marks = leaders.select("digest", "first", "last", F.explode("marks").alias("mark"))
    shared = marks.groupBy("mark").agg(F.min("first").alias("low"), F.max("last").alias("high")).filter("low < high").select("mark")
    candidates = marks.join(shared, "mark").groupBy("digest", "first", "last").agg(F.collect_set("mark").alias("marks"))
    members = marked.select("doc_id", "text_key", "digest").distinct().join(candidates, "digest")
    members = members.select("doc_id", "text_key", "first", "last", F.when(F.col("doc_id") == F.col("first"), F.col("marks")).alias("marks"))
    held = write_table(keyed.join(members, ["doc_id", "text_key"]), "held-texts")
    release(spark)

    def window_hashes(batches):
        hashes = WordHashes()
        for batch in batches:
            for first, last, text, marks in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                h = hashes.of(utf8(text).split())
                at = near_fingerprints(h, marks.values.to_numpy().view(np.uint64), window)
                w = np.unique(windows(h, window)[at])
                yield pa.RecordBatch.from_arrays([pa.array(_signed(w)), *(pa.array(np.full(len(w), x, np.int64)) for x in (first, last))], ["hash", "first", "last"])

    found = held.filter("marks is not null").select("first", "last", "text", "marks").mapInArrow(window_hashes, "hash long, first long, last long")
    found = write_table(found, "windows")
    owned = found.groupBy("hash").agg(F.min("first").alias("owner"), F.max("last").alias("last")).filter("owner < last").select("hash", "owner")
    owned = write_table(owned, "owned")
    release(spark)

    # the owners' passages: runs of windows that they own
    def passages(batches):
        hashes = WordHashes()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = utf8(text).split()
                sent = 0
                at = np.flatnonzero(np.isin(windows(hashes.of(words), window), own.values.to_numpy().view(np.uint64)))
                for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                    # a long passage goes in parts that overlap by a window less one word
                    for i in range(0, len(run), SHARD_WORDS // 4):
                        part = run[i : i + SHARD_WORDS // 4]
                        if len(part):
                            some = words[part[0] : part[-1] + window]
                            out[0].append(doc_id), out[1].append(b" ".join(some)), out[2].append(len(some)), out[3].append(sent // SHARD_WORDS)
                            sent += len(some)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["owner", "passage", "n", "batch"])

    own = owned.groupBy(F.col("owner").alias("doc_id")).agg(F.collect_list("hash").alias("own"))
    reference = write_table(held.filter("marks is not null").select("doc_id", "text").join(own, "doc_id").mapInArrow(passages, "owner long, passage binary, n long, batch long"), "passages")
    total = reference.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    # an owner's passages stay together, but for owners with more words than a shard has
    reference = reference.withColumn("shard", F.pmod(F.xxhash64("owner", "batch"), F.lit(shards)))
    where = write_table(reference.groupBy("owner").agg(F.collect_set("shard").alias("shards")), "owner-shards")

    # which documents go to which shards: those with a window that a smaller document in it owns
    sources = found.join(owned, "hash").select("first", "owner").distinct()
    visits = sources.join(where, "owner").select("first", F.explode("shards").alias("shard"), (F.col("owner") == F.col("first")).alias("own"))
    visits = visits.groupBy("first", "shard").agg(F.bool_and("own").alias("own"))
    copies = held.groupBy("first").agg(F.count("*").alias("copies"))
    visits = write_table(visits.join(copies, "first"), "visits")
    for done in (found, owned):
        drop_table(done)
    release(spark)
    count = visits.groupBy("shard").agg(F.ceil(F.sum("copies") / PART_ROWS).cast("int").alias("parts"))
    # what a document owns itself matters to its copies alone
    parted = visits.join(count, "shard").select("first", "shard", "own", "parts")
    routed = held.select("doc_id", "text_key", "text", "first").join(parted, "first").filter("not (own and doc_id = first)")
    routed = routed.select("doc_id", "text_key", "text", "shard", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"))
    dealt = reference.join(count, "shard").select("shard", "owner", "passage", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def stream(key, texts: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        automaton = SuffixAutomaton()
        for owner, passage in sorted(zip(shard["owner"], shard["passage"], strict=True)):
            automaton.add(passage.split(), owner)
        out = []
        for doc_id, text_key, text in zip(texts["doc_id"], texts["text_key"], texts["text"], strict=True):
            out += [(doc_id, text_key, a, b) for a, b in automaton.spans(utf8(text).split(), window, doc_id)]
        return pd.DataFrame(out, columns=["doc_id", "text_key", "begin", "end"])

    streamed = routed.groupBy("shard", "part").cogroup(dealt.groupBy("shard", "part")).applyInPandas(stream, "doc_id long, text_key long, begin long, end long")
    spans = write_table(streamed.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "spans")
    release(spark)
    return profiles, held, spans


def _kept(words: list[bytes], spans: list) -> list[bytes]:
    covered = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        covered[s["begin"]] += 1
        covered[s["end"]] -= 1
    keep = np.cumsum(covered[:-1]) == 0
    return [w for w, k in zip(words, keep, strict=True) if k]


def dedup_digest(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    profiles, held, spans = repeated_spans(docs, window)

    def make():
        def row(doc_id, text_key, text, spans):
            words = utf8(text).split()
            kept = _kept(words, spans)
            return doc_id, text_key, len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

        return row

    cut = over_rows(held.select("doc_id", "text_key", "text").dropDuplicates(["doc_id", "text_key"]).join(spans, ["doc_id", "text_key"]), make, "doc_id long, text_key long, n_removed long, kept_sha256 string")
    both = profiles.select("doc_id", "text_key", "n_words", "digest").join(cut, ["doc_id", "text_key"], "left")
    return both.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "digest").alias("kept_sha256"))


def dedup_texts(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` without repeated passages: the text of a document that loses words is its kept words joined by spaces
    (n_chars, where there is such a column, follows); documents that lose all their words go."""
    _, held, spans = repeated_spans(docs, window)

    def make():
        def row(doc_id, text_key, text, spans):
            return doc_id, text_key, b" ".join(_kept(utf8(text).split(), spans)).decode("utf-8", "surrogatepass")

        return row

    of, key, left = free_names(docs.columns, "_id", "_key", "_text")
    cut = over_rows(held.select("doc_id", "text_key", "text").dropDuplicates(["doc_id", "text_key"]).join(spans, ["doc_id", "text_key"]), make, f"{of} long, {key} long, {left} string")
    out = docs.join(cut, (F.col("doc_id") == F.col(of)) & (F.xxhash64("text") == F.col(key)), "left").filter(F.col(left).isNull() | (F.col(left) != ""))
    columns = {"text": F.coalesce(left, "text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col(left).isNull(), F.col("n_chars")).otherwise(F.length(left)).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(columns).select(*docs.columns)
