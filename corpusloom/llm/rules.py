"""Quality rules combined by weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0) on a document. Expectation-
maximisation over the table of vote patterns estimates how accurate each rule is
without labels, and a document is kept where the posterior probability of good
quality reaches one half. That replaces keeping only what passes every rule.

Defined cases: null and empty texts have no words and fail the base rules; the
table of patterns has at most 3 ** rules rows whatever the input, so it may
reach the driver; an empty table gives no rows; repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import WordHashes, over_rows, utf8, windows, write_table

MIN_WORDS = 50
#: Weight of the starting rates, in documents: it keeps rates off zero and vanishes beside any corpus.
PSEUDO = 1.0
SYMBOLS = "#*$%&|<>"

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_end_lines long, n_alpha_words long, n_upper long"


def text_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Counts over the whole text of each document; ``keep`` are columns carried along, ``text`` is read."""

    def make():
        hashes, n_keep = WordHashes(), len(keep)

        def row(*values):
            text = values[n_keep] or ""
            words = utf8(text).split()
            n = len(words)
            spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
            repeat = 0
            if n >= 4:
                w = windows(hashes.of(words), 3)
                _, back, times = np.unique(w, return_inverse=True, return_counts=True)
                twice = times[back] > 1
                hit = np.zeros(n, bool)
                for j in range(3):
                    hit[j : n - 2 + j] |= twice
                repeat = int(hit.sum())
            lines = [x for x in text.split("\n") if x.encode("utf-8", "surrogatepass").strip()]
            ended = sum(1 for x in lines if x.rstrip()[-1:] in ".!?\"':;")
            alpha = sum(1 for w in text.split() if w.strip(".,;:!?\"'()").isalpha())
            upper = sum(1 for w in words if len(w) > 1 and w.isupper())
            return (*values[:n_keep], n, len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, len(lines), ended, alpha, upper)

        return row

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return over_rows(docs.select(*keep, "text"), make, f"{schema}, {FEATURES}")


def vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("int")


def votes() -> dict[str, Column]:
    """The labelling functions over the counts of ``text_features``; ratios are compared as products, so zero words divide nothing."""
    words, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    return {
        "length": vote((words >= 80) & (words <= 100_000), words < MIN_WORDS),
        "word_length": vote((chars >= 3 * words) & (chars <= 9 * words), (chars > 12 * words) | (chars < 2 * words)),
        "symbols": vote(100 * F.col("n_symbols") <= chars, 10 * F.col("n_symbols") > chars),
        "duplicate_lines": vote(F.col("n_dup_lines") * 20 <= lines, F.col("n_dup_lines") * 3 > lines),
        "repetition": vote(10 * F.col("n_repeat_words") <= words, 10 * F.col("n_repeat_words") > 3 * words),
        "line_ends": vote(10 * F.col("n_end_lines") >= 7 * lines, 10 * F.col("n_end_lines") < 3 * lines),
        "letters": vote(10 * F.col("n_alpha_words") >= 8 * words, 10 * F.col("n_alpha_words") < 6 * words),
        "capitals": vote(20 * F.col("n_upper") <= words, 10 * F.col("n_upper") > 3 * words),
    }


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, prior: float = 0.7, pseudo: float = PSEUDO) -> tuple[np.ndarray, np.ndarray, float]:
    """EM for rules that are independent given the quality. Returns (posterior of each pattern, accuracy of each rule, prior).

    Each class has its own rate of each vote of each rule. They start where a rule seldom objects to good text and
    misses more than half of the bad; that tells the classes apart and weighs no more than ``pseudo`` documents, so
    the votes of the corpus decide the rates.
    """
    p = len(counts)
    if p == 0:
        return np.empty(0), np.full(patterns.shape[1] if patterns.ndim == 2 else 0, 0.8), prior
    total = counts.sum()
    share = counts / total
    is_vote = np.stack([patterns == v for v in (-1, 0, 1)]).astype(float)  # vote, pattern, rule
    mean = np.einsum("p,vpr->vr", share, is_vote)
    spoken = 1 - mean[1]
    rate = np.empty((2, 3, patterns.shape[1]))  # class, vote, rule
    rate[1] = np.stack([0.02 * spoken, mean[1], 0.98 * spoken])
    rate[0] = np.stack([0.4 * spoken, mean[1], 0.6 * spoken])
    rate = np.maximum(rate, 1e-6)  # a vote that never occurs
    start = rate / rate.sum(1, keepdims=True)
    rate = start
    good = np.full(p, prior)
    for _ in range(rounds):
        logs = np.log(rate)
        score = np.log(prior / (1 - prior)) + np.einsum("vpr,vr->p", is_vote, logs[1] - logs[0])
        new = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        done = np.abs(new - good).max() < 1e-10
        good = new
        mass = np.stack([share * (1 - good), share * good])
        rate = np.einsum("cp,vpr->cvr", mass, is_vote) + pseudo / total * start
        rate /= rate.sum(1, keepdims=True)
        prior = float(np.clip(mass[1].sum(), 0.001, 0.999))
        if done:
            break
    right = np.einsum("p,pr->r", share * good, patterns == 1) + np.einsum("p,pr->r", share * (1 - good), patterns == -1)
    spoke = np.einsum("p,pr->r", share, patterns != 0)
    return good, np.where(spoke > 0, right / np.maximum(spoke, 1e-12), 0.5), prior


def weak_quality(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, kept, quality): ``quality`` is the posterior probability of good quality."""
    spark = docs.sparkSession
    names = list(votes())
    counted = write_table(text_features(docs, ["doc_id"]), "rule-counts")
    voted = counted.select("*", *[c.alias(f"vote_{n}") for n, c in votes().items()])
    code = F.lit(0)
    for n in names:
        code = code * 3 + F.col(f"vote_{n}") + 1
    voted = voted.withColumn("pattern", code.cast("int"))
    table = voted.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3 ** 8 rows
    patterns = np.array([[(r["pattern"] // 3 ** (len(names) - 1 - i)) % 3 - 1 for i in range(len(names))] for r in table], int).reshape(len(table), len(names))
    good, _, _ = label_model(patterns, np.array([r["count"] for r in table], float))
    posterior = spark.createDataFrame([(int(r["pattern"]), float(g)) for r, g in zip(table, good, strict=True)], "pattern int, quality double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        voted.join(F.broadcast(posterior), "pattern", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce("quality", F.lit(0.0)) >= 0.5))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
    )
