"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are training texts labelled good; unlabelled texts are a
sample of all documents, whatever their labels. With the class prior p the risk

    p E+[loss(f)] + max(0, E[loss(-f)] - p E+[loss(-f)])

needs no negative examples. The prior is estimated from the same two samples: a
classifier of positives against unlabelled texts is cross-fitted on two halves, and
the share of unlabelled texts over the share of positives at the top scores bounds the
prior from above; the threshold with the least upper confidence bound decides. Features are
shapes of words (runs of upper case, lower case, digits; other characters as
they are) and of neighbouring words, and counts over the whole text.

Both samples are bounded (``PER_SIDE``); scoring reads every whole text.
Defined cases: null and empty texts are scored as texts without words; without
positives, or without the text of any, every score is 0; repeated rows are scored
alike; a word of any length counts whole; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import WordHashes, over_rows, spread, utf8, windows, write_table
from corpusloom.llm.labelled import held_out, labelled_texts

#: Texts of each side of the sample, about; hashed shape features of words and of pairs.
PER_SIDE, ONES, PAIRS = 4000, 192, 192
_RUN = re.compile(r"(.)\1+", re.S)


class Shapes(dict):
    """word -> number of its shape; remembers frequent words up to a fixed room."""

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        shape = _RUN.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in text))
        n = zlib.crc32(shape.encode("utf-8", "replace"))
        if len(self) < 300_000 and len(word) < 64:
            self[word] = n
        return n


def features(text: str | None, shapes: Shapes, hashes: WordHashes) -> np.ndarray:
    text = text or ""
    words = utf8(text).split()
    n = len(words)
    out = np.zeros(ONES + PAIRS + 10, np.float32)
    if n:
        s = np.fromiter(map(shapes.__getitem__, words), np.uint32, n)
        out[:ONES] = np.sqrt(np.bincount(s % ONES, minlength=ONES) / n)
        if n > 1:
            pair = (s[:-1] * np.uint32(0x9E3779B1) ^ s[1:]) * np.uint32(0x85EBCA6B) >> np.uint32(8)
            out[ONES : ONES + PAIRS] = np.sqrt(np.bincount(pair % PAIRS, minlength=PAIRS) / (n - 1))
    lines = [x for x in text.split("\n") if x.strip()]
    three = windows(hashes.of(words), 3) if n >= 3 else np.empty(0)
    letters = sum(map(len, words))
    out[-10:] = (
        np.log1p(n) / 8,
        n < 50,
        n < 15,
        1 - len(np.unique(three)) / len(three) if len(three) else 0,
        1 - len(set(lines)) / len(lines) if lines else 0,
        letters / n / 10 if n else 0,
        sum(map(text.count, "#*$%&|<>")) / letters * 5 if letters else 0,
        sum(x.rstrip()[-1:] in ".!?" for x in lines) / len(lines) if lines else 0,
        np.log1p(n / len(lines)) / 5 if lines else 0,
        len(set(words)) / n if n else 0,
    )
    return out


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 600, l2: float = 1e-4, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Linear scorer by full-batch Adam on the non-negative risk with the logistic loss.

    Where the estimated risk on negatives falls below zero, the step goes up that
    part instead, which is what keeps the estimator from fitting it away.
    """
    d = positive.shape[1]
    w, b = np.zeros(d), 0.0
    m, v = np.zeros(d + 1), np.zeros(d + 1)

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    for k in range(1, rounds + 1):
        sp, su = positive @ w + b, unlabelled @ w + b
        negative_risk = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
        up = -prior * sigmoid(-sp) / len(sp)  # gradient of the positive part
        down_p, down_u = -prior * sigmoid(sp) / len(sp), sigmoid(su) / len(su)
        gp, gu = (up + down_p, down_u) if negative_risk >= 0 else (-down_p, -down_u)
        g = np.append(positive.T @ gp + unlabelled.T @ gu + l2 * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    return w, b


def contrast(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 200, l2: float = 1e-3, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Linear logistic scorer of positives against unlabelled rows, both sides weighing the same."""
    x = np.concatenate([positive, unlabelled])
    y = np.r_[np.ones(len(positive)), np.zeros(len(unlabelled))]
    weight = np.r_[np.full(len(positive), 0.5 / len(positive)), np.full(len(unlabelled), 0.5 / len(unlabelled))]
    w = np.zeros(x.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        g = weight * (1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -60, 60))) - y)
        g = np.append(x.T @ g + l2 * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w[:-1], float(w[-1])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among unlabelled rows: the best bin of a cross-fitted contrast.

    At a threshold that q_p of the positives and q_u of the unlabelled rows
    reach, q_u / q_p is at least the prior, and near it where hardly a
    negative scores as high. The threshold with the least bound q_u / q_p + slack / q_p is
    taken, slack being the deviation that both shares may have with probability ``delta``.
    """
    sp, su = np.empty(len(positive)), np.empty(len(unlabelled))
    for side in (0, 1):
        train_p, train_u = positive[side::2], unlabelled[side::2]
        if not len(train_p) or not len(train_u):  # one row: nothing to cross-fit
            train_p, train_u = positive, unlabelled
        w, b = contrast(train_p, train_u)
        sp[1 - side :: 2], su[1 - side :: 2] = positive[1 - side :: 2] @ w + b, unlabelled[1 - side :: 2] @ w + b
    # q at every positive's score, from the highest down
    at = np.sort(sp)[::-1]
    q_p = np.arange(1, len(at) + 1) / len(at)
    q_u = 1 - np.searchsorted(np.sort(su), at, "left") / len(su)
    slack = 1.01 * (np.sqrt(np.log(4 / delta) / 2 / len(su)) + np.sqrt(np.log(4 / delta) / 2 / len(sp)))
    best = np.argmin((q_u + slack) / q_p)
    return float(np.clip(q_u[best] / q_p[best], 0.01, 0.99))


def train(docs: DataFrame, labels: DataFrame, per_side: int = PER_SIDE, seed: int = 11) -> tuple[np.ndarray, float] | None:
    """(weights, bias), or None without positives. Fits on the driver over two bounded samples."""
    positives = labelled_texts(docs, labels.filter("quality = 1"), "quality", per_side, seed).select("text", F.lit(1).alias("side"))
    share = min(1.0, per_side / max(docs.count(), 1))
    unlabelled = write_table(docs.filter(F.when(F.col("doc_id").isNull(), spread("text", seed + 1)).otherwise(spread("doc_id", seed + 1)) < share).select("text", F.lit(0).alias("side")), "unlabelled")  # rows without an id by their text

    def make():
        shapes, hashes = Shapes(), WordHashes()
        return lambda text, side: (side, features(text, shapes, hashes).tobytes())

    rows = over_rows(positives.unionByName(unlabelled), make, "side int, x binary").orderBy("side", "x").collect()
    parts = [[np.frombuffer(r["x"], np.float32) for r in rows if r["side"] == k] for k in (1, 0)]
    if not all(parts):
        return None
    # sorted features would make the halves of a cross-fit alike; a fixed shuffle doesn't
    rng = np.random.default_rng(seed)
    positive, whole = (rng.permutation(np.stack(x).astype(float)) for x in parts)
    return fit(positive, whole, class_prior(positive, whole))


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred numbers

    def make():
        shapes, hashes, n = Shapes(), WordHashes(), len(keep)

        def row(*values):
            if shared.value is None:
                return (*values[:n], 0.0)
            w, b = shared.value
            return (*values[:n], float(1 / (1 + np.exp(-np.clip(features(values[n], shapes, hashes) @ w + b, -60, 60)))))

        return row

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return over_rows(docs.select(*keep, "text"), make, f"{schema}, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs, train(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
