"""Spelling variants by asymmetric q-chunks.

Two words are near if one inserted, deleted or replaced code point makes them equal.
Of such a pair the shorter word (either, if they are as long) contributes two disjoint chunks,
its first and its second half. One edit leaves one of them whole, and the other word holds it as a
positional gram at most one place off: a first half at the same place, a second half
shifted by the difference of the lengths. So words meet by (lengths, chunk's place, chunk).
Of all positional grams only those can join, so only those are written.

A chunk that many words share is not paired out: there the edit lies in the rest of the words, and the rest is cut into
two disjoint chunks again, one of which is whole. Words of a crowded group meet by both chunks
then, down to single places. At the end a group holds words that agree but for one place,
so the pairs made stay in proportion to words and to near pairs. Pairs are verified by the edit distance of
what lies between the shared parts.

Defined cases: null and empty texts have no words; rows with a null id count as id "null"; rows that repeat an id
and a text count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import write_table

LEAST_LENGTH, LEAST_COUNT, TYPO, RATIO = 6, 5, 199, 5
#: Words a group holds at most before it is cut again.
CROWD = 24
#: Different words a task counts before it passes them on.
HELD = 400_000

# Latin-1 bytes: A-Z become a-z, letters stay, all else ends a word.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"word": pa.array([w.decode("latin-1") for w in total], pa.string()), "n": pa.array(total.values(), pa.int64())})
        total.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not text.is_valid:
                continue
            base = zlib.crc32(f"{doc_id}:".encode())
            # letters outside of Latin-1 become "?", which ends a word as they do
            for w, n in Counter(text.as_py().encode("latin-1", "replace").translate(_LETTERS).split()).items():
                if len(w) < LEAST_LENGTH:
                    continue
                h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), base)
                if h % TYPO == 0:
                    at = h % len(w)
                    w = w[:at] + w[at + 1 :]
                    if len(w) < LEAST_LENGTH:
                        continue
                total[w] += n
            if len(total) > HELD:
                yield flush()
    if total:
        yield flush()


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text): counted per task before the shuffle."""
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return docs.select(ids.alias("doc_id"), "text").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _part(word: Column, begin: Column, length: Column) -> Column:
    return F.substring(word, begin + 1, length)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row's open span cut into two chunks: one row for the edit in the second, one for the edit in the first.

    ``head`` and ``tail`` are the parts shared so far, ``span`` is the chunk word's open length and ``more`` 1 on rows of a longer word's grams.
    """
    h = F.floor(F.col("span") / 2).cast("int")
    # before or behind a chunk of one place
    k = F.when((F.col("longer") == 1) & (F.col("span") == 1), F.lit(1)).otherwise(h)
    middle, n = F.col("middle"), F.length("middle")
    right = F.struct(F.concat("head", F.substring(middle, F.lit(1), k)).alias("head"), F.col("tail").alias("tail"), _part(middle, k, n - k).alias("middle"), (F.col("span") - k).alias("span"))
    left = F.struct(F.col("head").alias("head"), F.concat(_part(middle, h + F.col("more"), n - h - F.col("more")), "tail").alias("tail"), F.substring(middle, F.lit(1), h + F.col("more")).alias("middle"), h.alias("span"))
    return rows.select("word", "n", "longer", "more", F.explode(F.array(right, left)).alias("x")).select("word", "n", "longer", "more", "x.*")


def near_pairs(vocab: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, an, b, bn): the pairs of words of ``vocab`` (word, n) whose edit distance is exactly 1, each once, with their counts.

    ``longer`` is the difference of lengths a row is made for (0 or 1), ``more`` tells which side it stands on. Each round cuts crowded groups
    once more; a span halves each time, so rounds grow with the logarithm of the longest word.
    """
    length = F.length("word")
    made = vocab.select("word", "n", F.explode(F.array(
        F.struct(F.lit(0).alias("longer"), F.lit(0).alias("more"), length.alias("span")),
        F.struct(F.lit(1).alias("longer"), F.lit(0).alias("more"), length.alias("span")),
        F.struct(F.lit(1).alias("longer"), F.lit(1).alias("more"), (length - 1).alias("span")),
    )).alias("x")).select("word", "n", "x.*", F.lit("").alias("head"), F.lit("").alias("tail"), F.col("word").alias("middle"))
    rows, parts = made, []
    group = ["longer", "span", "head", "tail"]
    while True:
        rows = write_table(_halves(rows), "chunks")
        sizes = rows.groupBy(*group).agg(F.count_if(F.col("more") == 0).alias("chunked"), F.count_if((F.col("more") == 1) | (F.col("longer") == 0)).alias("grams"))
        alive = sizes.filter((F.col("chunked") > 0) & (F.col("grams") > 0) & ((F.col("longer") == 1) | (F.col("chunked") > 1)))
        # a span of one place (none, for a longer word's) can't be cut: such a group's pairs are near
        crowded = (F.col("chunked") + F.col("grams") > 2 * crowd) & (F.col("span") + F.col("longer") > 1)
        alive = write_table(alive.select(*group, crowded.alias("crowded")), "groups")
        here = rows.join(alive.filter("not crowded").drop("crowded"), group)
        chunked = here.filter("more = 0").select(*group, F.col("word").alias("a"), F.col("n").alias("an"), F.col("middle").alias("am"))
        grams = here.filter("more = 1 or longer = 0").select(*group, F.col("word").alias("b"), F.col("n").alias("bn"), F.col("middle").alias("bm"))
        close = F.levenshtein("am", "bm", 1) == 1
        parts.append(write_table(chunked.join(grams, group).filter(((F.col("longer") == 1) | (F.col("a") < F.col("b"))) & close).select("a", "an", "b", "bn"), "near"))
        if alive.filter("crowded").isEmpty():
            break
        rows = rows.join(alive.filter("crowded").drop("crowded"), group)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()  # an insertion into a run of one letter has several places


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms are followed to the last by doubling the distance in each round.

    A form is at least ``RATIO`` times as frequent as its word, so chains are short and have no cycles.
    """
    links = write_table(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = links.select(F.col("word").alias("_w"), F.col("root").alias("_to"))
        stepped = links.join(on, F.col("root") == F.col("_w"), "left")
        new = write_table(stepped.select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_moved")), "forms")
        links = new.select("word", "root")
        if new.filter("_moved").isEmpty():
            return links


def group_variants(docs: DataFrame, ratio: int = RATIO, least_count: int = LEAST_COUNT, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each frequent word of ``docs`` (doc_id, text).

    ``form`` is the most frequent near word, the first in code-point order of several, where it is at least ``ratio`` times as frequent.
    """
    vocab = write_table(vocabulary(docs, least_count), "vocabulary")
    pairs = near_pairs(vocab, crowd)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("bn").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("an").alias("m")))).alias("x")).select("x.*")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    found = vocab.join(near, "word", "left").withColumn("strong", -F.col("best.m") >= F.lit(ratio) * F.col("n"))
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("strong"), F.col("best.other")).alias("form"), F.when(F.col("strong"), -F.col("best.m")).alias("form_n"))
    found = write_table(found, "variants")
    last = roots(found.filter("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
