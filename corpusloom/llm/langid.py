"""Language identification by unigrams over pieces, summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary. A
word's probability in a language is the sum over all ways to cut it into
pieces, which the forward algorithm adds up; characters that no piece covers
count alike in all languages. Piece probabilities come from expectation-
maximisation over the words of the training texts. A text's score is the
posterior of its best language.

Defined cases: null texts and texts without a letter are ``und`` with score 0,
as are all texts when nothing was learned; repeated rows are scored alike; an
empty table gives no rows; runs of characters without white space are scored
whole, whatever their length, in steps of ``STEP`` characters; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import id_hash, over_rows, spread, write_table

#: Training texts of each language, about; EM rounds.
PER_LANGUAGE, ROUNDS = 300, 3
FOLDS, HELD = 3, 1
_MARK, _LONGEST = "▁", 16
_LETTER = regex.compile(r"\p{L}")
#: A word is a run without white space and marks, or one mark: without marks attached, words recur more often.
_WORD = regex.compile(r"""[^\s.,;:!?"()\[\]{}|#$%&*<>/\\=+~^_`]+|[.,;:!?"()\[\]{}|#$%&*<>/\\=+~^_`]""")
#: Words of more characters are scored in steps; training cuts them into parts, all of which count.
_LONG, _PART = 64, 30
_OTHER = 1e-7  # probability of a character that only bytes could spell


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model that spell text, lower case, in order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return list(dict.fromkeys(p.lower() for p in pieces if len(p) <= _LONGEST))


class Lattice:
    """The segmentations of many words at once, for all languages. ``table`` holds a row of probabilities for each piece.

    Probabilities are scaled by ``SCALE`` for each character, so the sums of
    words of up to ``SHORT`` characters stay within the range of doubles; longer
    ones are cut into steps of ``SHORT`` ends whose sums are rescaled.
    """

    SCALE, SHORT, STEP = 30.0, 32, 4096

    def __init__(self, pieces: list[str], table: np.ndarray):
        # piece -> row; -1 for what only begins a piece
        self.at = dict.fromkeys((p[:i] for p in pieces for i in range(1, len(p))), -1) | {p: i for i, p in enumerate(pieces)}
        if len(pieces) >= 1 << 16:
            raise ValueError("the pieces of a larger vocabulary don't fit into the number of an arc")
        lengths = np.array([len(p) for p in pieces] + [1])
        # the last row stands for a character that no piece spells
        self.table = np.vstack([table, np.full((1, table.shape[1]), _OTHER)]) * self.SCALE ** lengths[:, None]

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end, piece) of every piece in every word, ordered by end, and the words' lengths."""
        # one number for an arc, in the order wanted: end, word, length (16 at most), piece
        codes, size = [], np.empty(len(words), int)
        at, unknown, add = self.at.get, len(self.table) - 1, codes.append
        for w, text in enumerate(words):
            text = _MARK + text
            n = size[w] = len(text)
            for i in range(n):
                if at(text[i], -1) < 0:
                    add(i + 1 << 36 | w << 21 | 1 << 16 | unknown)
                for j in range(i + 1, n + 1):
                    k = at(text[i:j])
                    if k is None:
                        break
                    if k >= 0:
                        add(j << 36 | w << 21 | j - i << 16 | k)
        arcs = np.sort(np.array(codes, np.int64))
        end = arcs >> 36
        return arcs >> 21 & 0x7FFF, end - (arcs >> 16 & 31), end, arcs & 0xFFFF, size

    def forward(self, arcs) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the segmentations of each prefix (word, end, language), and the logarithms taken out of each word."""
        word, start, end, piece, size = arcs
        sums = np.zeros((len(size), int(size.max(initial=0)) + 1, self.table.shape[1]))
        out = np.zeros(len(size))
        sums[:, 0] = 1
        cuts = np.searchsorted(end, np.arange(sums.shape[1] + 1))
        for j in range(1, sums.shape[1]):
            part = slice(cuts[j], cuts[j + 1])
            w = word[part]
            if len(w):
                value = sums[w, start[part]] * self.table[piece[part]]
                first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                sums[w[first], j] = np.maximum(np.add.reduceat(value, first, axis=0), 1e-290)
            if j % self.SHORT == 0:
                more = np.flatnonzero(size > j)
                most = sums[more, j].max(1)
                live = slice(max(0, j - _LONGEST), j + 1)
                sums[more, live] = sums[more, live] / most[:, None, None]
                out[more] += np.log(most)
        return sums, out

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        arcs = self.arcs(words)
        sums, out = self.forward(arcs)
        size = arcs[4]
        return np.log(sums[np.arange(len(size)), size]) + (out - size * math.log(self.SCALE))[:, None]

    def log_probability(self, word: str, step: int = STEP) -> np.ndarray:
        """As ``log_probabilities`` of one long word: the sums of ``step`` ends at a time, the last of which begin the next step."""
        text = _MARK + word
        at, unknown = self.at.get, len(self.table) - 1
        # sums of the ends up to where a step begins; the last is the empty prefix at first
        before, out = np.zeros((_LONGEST, self.table.shape[1])), np.zeros(self.table.shape[1])
        before[-1] = 1
        for begin in range(0, len(text), step):
            end = min(begin + step, len(text))
            arcs: list[list[tuple[int, int]]] = [[] for _ in range(begin, end)]  # (start, piece) by end
            for i in range(max(0, begin - _LONGEST + 1), end):
                if i >= begin and at(text[i], -1) < 0:
                    arcs[i - begin].append((i, unknown))
                for j in range(i + 1, min(end, i + _LONGEST) + 1):
                    k = at(text[i:j])
                    if k is None:
                        break
                    if k >= 0 and j > begin:
                        arcs[j - 1 - begin].append((i, k))
            sums = np.concatenate([before, np.zeros((end - begin, self.table.shape[1]))])
            shift = _LONGEST - 1 - begin
            for j, some in enumerate(arcs, _LONGEST):
                for i, k in some:
                    sums[j] += sums[i + shift] * self.table[k]
                sums[j] = np.maximum(sums[j], 1e-290)
                if j % self.SHORT == 0 or j == len(sums) - 1:
                    most = sums[j].copy()
                    sums[j - _LONGEST + 1 : j + 1] /= most
                    out += np.log(most)
            before = sums[-_LONGEST:]
        return np.log(before[-1]) + out - len(text) * math.log(self.SCALE)

    def expected(self, words: list[str], weight: np.ndarray) -> np.ndarray:
        """Expected number of each piece over the segmentations of short words; ``weight`` (word, language) counts the words."""
        arcs = word, start, end, piece, size = self.arcs(words)
        sums, _ = self.forward(arcs)
        back = np.zeros_like(sums)
        back[np.arange(len(size)), size] = 1
        by_start = np.lexsort((word, start))
        cuts = np.searchsorted(start[by_start], np.arange(sums.shape[1] + 1))
        for i in range(sums.shape[1] - 1, -1, -1):
            part = by_start[cuts[i] : cuts[i + 1]]
            w = word[part]
            if len(w):
                first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                back[w[first], i] += np.add.reduceat(back[w, end[part]] * self.table[piece[part]], first, axis=0)
        whole = sums[np.arange(len(size)), size]
        share = sums[word, start] * self.table[piece] * back[word, end] / whole[word] * weight[word]
        return np.stack([np.bincount(piece, share[:, k], len(self.table))[:-1] for k in range(share.shape[1])], 1)


def normal_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def parts(word: str) -> list[str]:
    return [word[i : i + _PART] for i in range(0, len(word), _PART)]


def train(docs: DataFrame, pieces: list[str], per_language: int = PER_LANGUAGE, seed: int = 3) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, piece probabilities, log priors) from rows that are not held out and have a language."""
    known = docs.filter(F.col("lang").isNotNull() & F.coalesce(id_hash("doc_id", FOLDS) != HELD, F.lit(False)))
    rates = write_table(known.groupBy("lang").count(), "languages")
    counts = sorted((r["lang"], r["count"]) for r in rates.collect())  # a row for each language
    languages = [c[0] for c in counts]
    if not languages:
        return [], np.empty((0, 0)), np.empty(0)
    # rates meet rows by language, however many there are; the written table's size lets Spark broadcast it where it is small
    sample = known.select("doc_id", "lang", "text").join(rates, "lang").filter(spread("doc_id", seed) < F.lit(float(per_language)) / F.col("count")).select("lang", "text")
    words = over_rows(sample, lambda: lambda lang, text: [(lang, p) for w in set(normal_words(text)) for p in parts(w)], "lang string, word string", many=True)
    rows = write_table(words.groupBy("word", "lang").count(), "language-words").collect()  # of the bounded sample
    place = {k: i for i, k in enumerate(languages)}
    by_word: dict[str, np.ndarray] = {}
    for r in sorted(rows):
        by_word.setdefault(r["word"], np.zeros(len(languages)))[place[r["lang"]]] += r["count"]
    spelled, weights = list(by_word), np.array(list(by_word.values())).reshape(len(by_word), len(languages))
    table = np.full((len(pieces), len(languages)), 1.0 / max(len(pieces), 1))
    for _ in range(ROUNDS):
        lattice, seen = Lattice(pieces, table), np.zeros_like(table)
        for at in range(0, len(spelled), 4096):
            seen += lattice.expected(spelled[at : at + 4096], weights[at : at + 4096])
        table = (seen + 0.01) / (seen.sum(0) + 0.01 * len(pieces))
    share = np.array([c[1] for c in counts], float)
    return languages, table, np.log(share / share.sum())


#: What this Python worker knows of the latest model: it serves the worker's next tasks too.
_WORKER: dict[str, tuple] = {}


def worker_memory() -> dict[str, tuple]:
    """Tasks reach the worker's own dictionary through this function; a closure would carry a copy."""
    return _WORKER


def identify(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document by its whole text."""
    pieces = vocabulary(vocabulary_path)
    languages, table, prior = train(docs, pieces)
    shared = docs.sparkSession.sparkContext.broadcast((pieces, languages, table, prior))  # vocabulary times languages

    model = uuid.uuid4().hex

    def run(batches):
        pieces, languages, table, prior = shared.value
        room = min(600_000, 20_000_000 // max(len(languages), 1))  # words to remember: their rows take 160 MB at most
        memory = worker_memory()
        if model not in memory:
            memory.clear()
            memory[model] = (Lattice(pieces, table) if languages else None, {}, np.empty((0, len(languages))))
        lattice, known, held = memory[model]
        for batch in batches:
            ids = batch.column(0)
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(1).slice(at, 256).to_pylist()
                words = [normal_words(t) if languages and t is not None and _LETTER.search(t) else None for t in texts]
                long = [[w for w in some if len(w) > _LONG] if some else [] for some in words]
                words = [[w for w in some if len(w) <= _LONG] if extra else some for some, extra in zip(words, long, strict=True)]
                new = list({w: None for some in words if some for w in some if w not in known})
                if len(known) + len(new) > room:  # forget, rather than grow with the vocabulary
                    known, held = {}, held[:0]
                    new = list({w: None for some in words if some for w in some})
                known |= {w: len(held) + i for i, w in enumerate(new)}
                held = np.concatenate([held, *(lattice.log_probabilities(new[j : j + 2048]) for j in range(0, len(new), 2048))])
                memory[model] = (lattice, known, held)
                best, score = [], []
                for some, extra in zip(words, long, strict=True):
                    if some is None:
                        best.append("und"), score.append(0.0)
                        continue
                    total = prior + held[np.fromiter(map(known.__getitem__, some), int, len(some))].sum(0)
                    for w in extra:
                        total = total + lattice.log_probability(w)
                    k = int(np.argmax(total))
                    best.append(languages[k]), score.append(float(1 / np.exp(total - total[k]).sum()))
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(id_hash("doc_id", FOLDS) == HELD, F.lit(False)).alias("held_out"), "lang_pred", "score")
