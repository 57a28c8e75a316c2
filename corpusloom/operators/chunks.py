"""Documents to chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import base_name

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def line_chunks(docs: DataFrame) -> DataFrame:
    """(source, chunk_id, chunk_index, text): one chunk for each line that isn't blank, numbered from 0 in its source.

    ``docs`` has (source, text). Numbering happens inside the row, so nothing is shuffled.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return (
        docs.select("source", F.posexplode(lines).alias("chunk_index", "text"))
        .withColumn("chunk_id", F.concat_ws(":", base_name(F.col("source")), F.concat(F.lit("c"), F.col("chunk_index"))))
        .select("source", "chunk_id", "chunk_index", "text")
    )


def _cut(text: str, separators: tuple[str, ...], size: int) -> list[str]:
    """Pieces of at most ``size`` characters at the coarsest separator that occurs; each keeps the separator at its front."""
    if len(text) <= size:
        return [text]
    here = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, finer = separators[here], separators[here + 1 :]
    if mark == "":
        return [text[i : i + size] for i in range(0, len(text), size)]
    first, *rest = text.split(mark)
    out: list[str] = []
    for piece in [first, *(mark + x for x in rest)]:
        if piece:
            out += _cut(piece, finer, size) if len(piece) > size and finer else [piece]
    return out


def split_text(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(start, chunk) of chunks of at most ``size`` characters that share up to ``overlap`` with the one before."""
    pieces, at = [], 0
    for p in _cut(text, SEPARATORS, size):
        pieces.append((at, p))
        at += len(p)
    out: list[tuple[int, str]] = []
    held: list[tuple[int, str]] = []
    total = 0

    def emit() -> None:
        joined = "".join(p for _, p in held)
        kept = joined.strip()
        if kept:
            out.append((held[0][0] + len(joined) - len(joined.lstrip()), kept))

    for start, piece in pieces:
        if held and total + len(piece) > size:
            emit()
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0)[1])
        held.append((start, piece))
        total += len(piece)
    if held:
        emit()
    return out


def recursive_chunks(docs: DataFrame, size: int = 700, overlap: int = 120) -> DataFrame:
    """(source, chunk_id, chunk_index, start_index, text) by recursive splitting; ``docs`` has (source, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, i, at, chunk) for s, t in zip(batch["source"], batch["text"], strict=True) if t for i, (at, chunk) in enumerate(split_text(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["source", "chunk_index", "start_index", "text"])

    cut = docs.select("source", "text").mapInPandas(run, "source string, chunk_index int, start_index int, text string")
    return cut.withColumn("chunk_id", F.concat_ws(":", base_name(F.col("source")), F.concat(F.lit("c"), F.col("chunk_index")))).select("source", "chunk_id", "chunk_index", "start_index", "text")


def summarize_chunks(chunks: DataFrame) -> DataFrame:
    """One row: count, shortest, longest and average length, distinct sources; zeros when there are none."""
    n = F.length("text")
    return chunks.agg(
        F.count("*").alias("chunk_count"),
        F.coalesce(F.min(n), F.lit(0)).cast("long").alias("min_chars"),
        F.coalesce(F.max(n), F.lit(0)).cast("long").alias("max_chars"),
        F.coalesce(F.round(F.avg(n), 1), F.lit(0.0)).alias("avg_chars"),
        F.countDistinct("source").alias("sources"),
    )
