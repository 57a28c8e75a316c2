"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is ``window`` consecutive words of an item, or all words of a shorter item. Of every
``window`` words of a text the smallest hash of its runs of ``GRAM`` words is kept,
so a window that text and item share leaves the same fingerprint in both: no shared
window is missed.

1. Documents and items give their fingerprints; an item shorter than a window gives the hash of all its
   words, and documents the hashes of all runs of the lengths that such items have.
2. Documents' fingerprints are joined to the items'. Texts without any go no further.
3. In the texts that are left, each hit is extended to the windows around it, and those are compared with the items' windows word by word.

Equal texts have equal results, so each different text is extended once, however many copies there are. Items meet
documents by hash and by window; Spark broadcasts the items' side where its size is below the session's threshold and
shuffles otherwise.

Defined cases: null and empty texts have no words and hit nothing; an item without words has no window; an item with a
null id contaminates but isn't counted or listed; items with the same id count once; rows of
``documents`` with the same or no id are separate rows; empty tables give no rows, or rows without hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import write_table

WINDOW, GRAM = 10, 4
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """Only A-Z become small letters; where a text is all ASCII, ``lower`` does that, and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _doubled(df: DataFrame, column: str, span: int, f: Callable[[Column, Column], Column]) -> DataFrame:
    """Entry i becomes ``f`` over ``span`` entries from i on, by doubling. ``f`` may see entries twice unless span is a power of two; the last span - 1 entries are void."""
    size, other = 1, [c for c in df.columns if c != column]
    while size < span:
        by = size if 2 * size <= span else span - size
        df = df.select(*other, F.zip_with(column, F.slice(column, by + 1, F.greatest(F.size(column) - by, F.lit(0))), f).alias(column))
        size += by
    return df


def _grams(df: DataFrame) -> DataFrame:
    """Adds ``grams`` to rows with words ``w``: a hash of the run of GRAM words at each place."""
    return _doubled(df.withColumn("grams", F.transform("w", lambda x: F.xxhash64(x))), "grams", GRAM, lambda a, b: F.xxhash64(a, b))


def _runs(m: int) -> Column:
    """A hash of the run of exactly ``m`` words at each place of ``w``."""
    return F.when(F.size("w") >= m, F.transform(F.sequence(F.lit(1), F.size("w") - (m - 1)), lambda i: F.xxhash64(F.lit(m), F.slice("w", i, m)))).otherwise(F.array().cast("array<bigint>"))


def _tagged(hashes: Column, m: int) -> Column:
    """Hashes with their places, as those of windows of ``m`` words."""
    return F.transform(hashes, lambda h, i: F.struct(F.lit(m).alias("m"), (i + 1).alias("at"), h.alias("print")))


def _winnowed(df: DataFrame, window: int) -> DataFrame:
    """Adds ``prints`` to rows with words ``w``: the distinct smallest hashes of all windows."""
    held = _doubled(_grams(df), "grams", window - GRAM + 1, lambda a, b: F.least(a, b))
    whole = F.slice("grams", 1, F.greatest(F.size("w") - (window - 1), F.lit(0)))
    return held.withColumn("prints", F.array_distinct(whole)).drop("grams")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of ``documents`` (doc_id, text) against ``benchmark`` (item_id, text).

    n_hit counts the words inside any window that occurs in the text; items_sha256 is of the ids of
    the items these windows belong to, sorted as strings and joined by commas.
    """
    if window < GRAM:
        raise ValueError(f"a window has at least {GRAM} words")
    items = _winnowed(benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0), window)
    items = items.withColumn("m", F.least(F.size("w"), F.lit(window)))
    items = write_table(items.withColumn("prints", F.when(F.size("w") >= window, F.col("prints")).otherwise(F.array(F.xxhash64(F.size("w"), "w")))), "winnow-items")
    marks = write_table(items.select(F.explode("prints").alias("print")).distinct(), "winnow-marks")
    starts = F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)
    item_windows = items.select("item_id", "m", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.col("m")), " "))).alias("passage")).distinct()
    item_windows = write_table(item_windows, "winnow-windows")
    short = [r.m for r in items.filter(F.col("m") < window).select("m").distinct().collect()]  # at most window - 1 numbers

    # texts -> fingerprints. Written before they are exploded, else each filter on them would repeat their making
    text = documents.select("doc_id", F.md5("text").alias("key"), words(F.col("text")).alias("w"))
    scanned = _winnowed(text, window).withColumn("prints", F.concat("prints", *[F.array_distinct(_runs(m)) for m in short]))
    scanned = write_table(scanned.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), "prints"), "winnow-scanned")
    touched = write_table(scanned.select("key", F.explode("prints").alias("print")).join(marks, "print", "left_semi").select("key").distinct(), "winnow-touched")

    # hits -> the windows around them -> windows of items
    held = documents.select(F.md5("text").alias("key"), "text").join(touched, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    held = _grams(held.select("key", words(F.col("text")).alias("w")))
    whole = F.slice("grams", 1, F.greatest(F.size("w") - (GRAM - 1), F.lit(0)))
    tagged = [_tagged(whole, window), *[_tagged(_runs(m), m) for m in short]]
    held = write_table(held.select("key", "w", F.concat(*tagged).alias("grams")), "winnow-held")
    hits = held.select("key", F.size("w").alias("n"), F.explode("grams").alias("g")).select("key", "n", "g.*").join(marks, "print", "left_semi")
    first = F.when(F.col("m") == window, F.greatest(F.col("at") - (window - GRAM), F.lit(1))).otherwise(F.col("at"))
    last = F.when(F.col("m") == window, F.least("at", F.col("n") - (window - 1))).otherwise(F.col("at"))
    # a gram counts only where a whole window lies around it
    around = hits.filter(F.col("n") >= F.col("m")).groupBy("key", "m").agg(F.collect_list(F.struct(first.alias("a"), last.alias("b"))).alias("spans"))
    around = around.select("key", "m", F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["a"], s["b"])))).alias("starts"))
    cut = held.select("key", "w").join(around, "key").select("key", "m", F.explode(F.transform("starts", lambda i: F.struct(i.alias("start"), F.array_join(F.slice("w", i, F.col("m")), " ").alias("passage")))).alias("x"))
    found = write_table(cut.select("key", "m", "x.*").join(item_windows.select("m", "passage").distinct(), ["m", "passage"], "left_semi"), "winnow-found")

    covered = found.groupBy("key").agg(F.collect_list(F.struct("start", "m")).alias("spans"))
    covered = covered.select("key", F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["m"] - 1))))).cast("long").alias("n_hit"))
    owners = found.select("key", "m", "passage").distinct().join(item_windows.filter("item_id is not null"), ["m", "passage"]).select("key", F.col("item_id").cast("string").alias("item")).distinct()
    owners = owners.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    per_text = write_table(covered.join(owners, "key", "left"), "winnow-texts")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return scanned.join(per_text, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
