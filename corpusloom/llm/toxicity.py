"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A hashed n-gram's scale is the log ratio of its smoothed document frequencies
in toxic and other training texts. N-grams whose frequencies differ by less
than chance could explain (a z-score below ``LEAST_Z``) get scale 0, and so do those beyond the
``FEATURES`` highest z-scores, which bounds the model. Logistic regression weighs the scaled
presence features. It learns from a bounded, documented sample
of labelled rows (``PER_CLASS`` of each class); scoring reads every whole text.

Defined cases: null and empty texts get the score of a text without features;
without training texts of both classes every score is the share of toxic ones (1 or 0; 0 if there
is none); repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import over_rows
from corpusloom.llm.labelled import held_out, labelled_texts

#: Training texts of each class, about; n-gram lengths; hash bits; features kept and their least z-score.
PER_CLASS, LENGTHS, BITS, FEATURES, LEAST_Z = 4000, (4, 5, 6), 18, 3000, 5.0
_CHUNK = 1 << 20


def ngram_hashes(text: str, bits: int = BITS):
    """Yields arrays of hashed character n-grams; long texts come in pieces, so memory stays bounded."""
    reach = max(LENGTHS) - 1
    for at in range(0, max(len(text), 1), _CHUNK):
        piece = f"{' ' if at == 0 else ''}{text[at : at + _CHUNK + reach]} ".lower()
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        h = codes
        for n in range(2, max(LENGTHS) + 1):
            if len(codes) < n:
                break
            h = h[:-1] * np.uint32(0x01000193) ^ codes[n - 1 :]
            if n in LENGTHS:
                yield (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def present(text: str | None, slot: np.ndarray) -> np.ndarray:
    """The distinct selected features of a text; ``slot`` maps a hash to its feature or -1."""
    found = [s[s >= 0] for s in (slot[h] for h in ngram_hashes(text or ""))]
    return np.unique(np.concatenate(found)) if found else np.empty(0, slot.dtype)


def _document_counts(sample: DataFrame) -> DataFrame:
    """(gram, toxic, other): in how many sampled texts of each class a hash occurs. Each task adds up its own first."""

    def count(batches):
        import pyarrow as pa

        seen = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mark = np.zeros(1 << BITS, bool)
                for h in ngram_hashes(text or ""):
                    mark[h] = True
                seen[label] += mark
        gram = np.flatnonzero(seen.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int32)), pa.array(seen[1][gram]), pa.array(seen[0][gram])], ["gram", "toxic", "other"])

    parts = sample.select("text", "label").mapInArrow(count, "gram int, toxic int, other int")
    return parts.groupBy("gram").agg(F.sum("toxic").cast("int").alias("toxic"), F.sum("other").cast("int").alias("other"))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 2e-3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by accelerated gradient descent with the step that the data's norm allows."""
    total = weight.sum()
    share = (weight / total).astype(x.dtype)
    v = np.full(x.shape[1], 1 / np.sqrt(max(x.shape[1], 1)), x.dtype)
    for _ in range(20):
        v = x.T @ (share * (x @ v))
        size = float(np.linalg.norm(v)) or 1.0
        v /= size
    step = 1 / (0.25 * (size + 1) + l2)
    w, b, pw, pb = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    for k in range(rounds):
        m = k / (k + 3)
        zw, zb = w + m * (w - pw), b + m * (b - pb)
        pw, pb = w, b
        g = weight * (1 / (1 + np.exp(-np.clip(x @ zw.astype(x.dtype) + zb, -60, 60))) - y) / total
        w = zw - step * (x.T @ g.astype(x.dtype) + l2 * zw)
        b = zb - step * float(g.sum())
    return w, b


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(slot by hash, weight by slot, bias). Fits on the driver over at most FEATURES columns of the bounded sample."""
    sample = labelled_texts(docs, labels, "toxic", per_class, seed)
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    slot = np.full(1 << BITS, -1, np.int32)
    if not n1 or not n0:
        share = n1 / max(n1 + n0, 1)
        return slot, np.empty(0), np.inf if share == 1 else -np.inf  # the score is the share itself
    share = n1 / (n1 + n0)
    both = F.col("toxic") + F.col("other")
    z = F.abs(F.col("toxic") - both * share) / F.sqrt(both * share * (1 - share))
    best = _document_counts(sample).withColumn("z", z).filter((F.col("z") >= LEAST_Z) & (both >= 5)).orderBy(F.desc("z"), "gram").limit(FEATURES).collect()
    if not best:
        return slot, np.empty(0), float(np.log(share / (1 - share)))
    slot[[r["gram"] for r in best]] = np.arange(len(best))
    ratio = np.array([np.log((r["toxic"] + 1) / (n1 + 2)) - np.log((r["other"] + 1) / (n0 + 2)) for r in best])
    def features(text, label):
        return label, present(text, slot).astype(np.uint16).tobytes()

    found = over_rows(sample.select("text", "label"), lambda: features, "label int, features binary").orderBy("label", "features").toArrow()
    x, y = np.zeros((found.num_rows, len(best)), np.float32), found.column("label").to_numpy().astype(float)
    for i, some in enumerate(found.column("features")):
        x[i, np.frombuffer(some.as_py(), np.uint16)] = 1
    del found
    x *= ratio.astype(np.float32)
    # the sample balances the classes; weights bring back their shares
    known = {r["toxic"]: r["count"] for r in labels.filter(~held_out()).groupBy("toxic").count().collect()}
    weight = np.where(y == 1, known.get(1, n1) / n1, known.get(0, n0) / n0)
    w, b = logistic(x, y, weight)
    return slot, w * ratio, float(b)


def _probability(s: float) -> float:
    return float(s > 0) if math.isinf(s) else 1 / (1 + math.exp(-min(max(s, -60.0), 60.0)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` columns and ``name`` (0 to 1) of every row by its whole text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2 ** BITS slots: a fixed size

    def make():
        slot, w, b = shared.value
        n = len(keep)

        def row(*values):
            s = b + (float(w[present(values[n], slot)].sum()) if len(w) else 0.0)
            return (*values[:n], _probability(s))

        return row

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return over_rows(docs.select(*keep, "text"), make, f"{schema}, `{name}` double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs, train(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
