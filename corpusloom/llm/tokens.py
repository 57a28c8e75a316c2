"""Token ids of whole texts with the tokenizers library, remembering what frequent words encode to."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of the Unicode property, which the byte-level vocabulary splits at.
_WS = "\t-\r \x85\xa0  -     　"
#: Plain letters, and marks that often follow them up to the next white space: every vocabulary here cuts between the two.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", "!#$%&*,.:;?"
# possessive: giving back a letter or a mark never makes the rest match
_TAIL = f"[{_MARKS}]++(?=[{_WS}]|$)"
_WORDS = re.compile(f"[{_LETTERS}]++(?={_TAIL})|{_TAIL}|[^{_WS}]++")
#: The same with the one space before a run; then white space up to the last one before such a run, or the rest.
_BYTE_LEVEL = re.compile(f" ?[{_LETTERS}]++(?={_TAIL})|{_TAIL}| ?[^{_WS}]++|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_PLAIN = re.compile(f" ?[{_LETTERS}]++")
_IS_MARK = np.isin(np.arange(256), list(_MARKS.encode()))
_IS_LETTER = np.isin(np.arange(256), [b for b in range(128) if chr(b).isalpha()])
#: Marks at a word's end to look for; a word with more stays whole.
_MOST_MARKS = 8
#: Bytes of texts to encode in one go.
PORTION = 1 << 21
#: The space of the byte-level alphabet and the bytes of UTF-8 in it: what prints in Latin-1 stands for itself, the rest follows from U+0100 on.
_SYMBOLS = dict(zip([b for b in range(256) if b < 33 or 127 <= b <= 160 or b == 173], map(chr, range(256, 512)), strict=False))


@lru_cache(maxsize=2)
def encoder(path: str, word_ends: bool) -> Encoder:
    """One for each Python worker: what it knows serves the worker's next tasks too."""
    return Encoder(path, word_ends)


class Encoder:
    """text -> ids, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    A vocabulary never joins characters across the pieces that its pre-tokenizer
    cuts, so a text's ids are those of its pieces in turn. ``word_ends``:
    pieces are what stands between white space; else the byte-level pieces. A text that holds the
    string of an added token, in any case, goes to the library whole. A new word of plain letters is one piece for
    the library too and goes straight to its model, in the symbols of its byte-level alphabet; other new pieces are encoded
    many at a time, as one text in which a separator of one known id stands between them.
    """

    #: Pieces to remember, and how many of them stay when there are more: the first ones, as frequent pieces come early.
    ROOM, KEPT, TOGETHER = 500_000, 250_000, 2048

    def __init__(self, path: str, word_ends: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)), re.I).search if added else lambda text: None
        #: what all of them begin with, up to the first letter: rarer and quicker to look for
        self.hint = re.match(r"[^\w]*", os.path.commonprefix(added))[0]
        self.split: Callable[[str], list[str]] = (_WORDS if word_ends else _BYTE_LEVEL).findall
        # byte-level pieces without white space inside them stay apart at a line's end, words at a bar between spaces
        self.mark, self.apart = ("|", " | ") if word_ends else ("\n", "\n")
        self.mark_id = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.space = re.compile(f"[{_WS}]")
        self.lower = word_ends
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}

    def _alone(self, pieces: list[str]) -> None:
        encoded = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        self.known.update((p, array("I", e.ids).tobytes()) for p, e in zip(pieces, encoded, strict=True))

    def _words(self, words: list[str]) -> None:
        """Ids of words of plain letters, from the model itself."""
        known, ids_of, number = self.known, self.model.tokenize, attrgetter("id")
        for word in words:
            symbols = word.lower() if self.lower else word
            if not symbols.isascii():
                symbols = symbols.encode().decode("latin-1").translate(_SYMBOLS)
            elif symbols[0] == " ":
                symbols = _SYMBOLS[32] + symbols[1:]
            known[word] = array("I", map(number, ids_of(symbols))).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Encodes new pieces; what holds the mark or inner white space goes alone."""
        plain = _PLAIN.fullmatch
        self._words([p for p in pieces if plain(p)])
        pieces = [p for p in pieces if p not in self.known]
        inner = self.space.search
        easy = [p for p in pieces if self.mark not in p and p != " " and not inner(p, 1) and not (p[0] != " " and inner(p[0]))]
        if len(self.mark_id) != 1:
            easy = []
        for at in range(0, len(easy), self.TOGETHER):
            some = easy[at : at + self.TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([self.apart.join([*some, ""])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(ids == self.mark_id[0])
            if len(ends) != len(some):
                self._alone(some)
                continue
            data, begin = ids.tobytes(), 0
            for p, end in zip(some, (4 * ends).tolist(), strict=True):
                self.known[p] = data[begin:end]
                begin = end + 4
        rest = [p for p in pieces if p not in self.known]
        if rest:
            self._alone(rest)

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        whole = {i for i, t in enumerate(texts) if t and self.hint in t and self.special(t)}
        cut = [self.split(t) if t and i not in whole else [] for i, t in enumerate(texts)]
        new = list(set().union(*cut).difference(self.known)) if self.known else list(set().union(*cut))
        if len(self.known) + len(new) > self.ROOM and self.known:
            self.known = dict(islice(self.known.items(), self.KEPT))
            new = list(set().union(*cut).difference(self.known))
        if new:
            self._learn(new)
        get = self.known.__getitem__
        alone = {i: np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32) for i in whole}
        return [alone[i] if i in whole else np.frombuffer(b"".join(map(get, pieces)), np.uint32) for i, pieces in enumerate(cut)]

    def column(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a column. With ``word_ends`` a word that many of the texts hold is looked up once."""
        if not self.lower:
            return self.many(texts.to_pylist())
        texts = pc.fill_null(texts.cast(pa.string()), "")
        hinted = np.flatnonzero(pc.match_substring(texts, self.hint).to_numpy(zero_copy_only=False)).tolist()
        whole = {i: t for i in hinted if self.special(t := texts[i].as_py())}
        if whole:
            texts = pc.if_else(np.isin(np.arange(len(texts)), list(whole)), "", texts)
        words, ends = _split_words(texts)
        coded = words.dictionary_encode()
        found = self._found(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        flat = np.frombuffer(ids.buffers()[2] or b"", np.uint32)
        at = (np.frombuffer(ids.buffers()[1], np.int64)[ends] // 4).tolist() if len(ids) else [0] * len(texts)
        out = [flat[a:b] for a, b in zip([0, *at], at, strict=False)]
        for i, text in whole.items():
            out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return out

    def _found(self, words: list[str]) -> list[bytes]:
        """Ids of different words without ASCII white space inside; the empty one has none."""
        found = list(map(self.known.get, words))
        new = [i for i, x in enumerate(found) if x is None and words[i]]
        if len(self.known) + len(new) > self.ROOM:
            self.known = dict(islice(self.known.items(), self.KEPT))
        self._learn([words[i] for i in new])
        for i in new:
            found[i] = self.known[words[i]]
        return [x or b"" for x in found]

    def __call__(self, text: str | None) -> np.ndarray:
        return self.many([text])[0]


def _split_words(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """What stands between ASCII white space, with the marks after a last letter apart, and the number of words up to each text's end.

    A-Z are lower-cased, as the vocabulary does, but where a character that may combine with the letter follows.
    """
    lists = pc.ascii_split_whitespace(texts)
    words, ends = lists.flatten(), lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
    if not pc.any(pc.greater(pc.binary_length(words), 0)).as_py():
        return words, ends
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy()
    offsets = offsets - offsets[0]
    capital = (data >= 65) & (data <= 90)
    capital[:-1] &= data[1:] < 0xCC  # combining characters begin with U+0300
    data[capital] |= 32
    begin, cut, marked = offsets[:-1], offsets[1:].copy(), np.arange(len(words))
    for _ in range(_MOST_MARKS):
        marked = marked[cut[marked] > begin[marked]]
        marked = marked[_IS_MARK[data[cut[marked] - 1]]]
        cut[marked] -= 1
    apart = np.flatnonzero((cut < offsets[1:]) & (cut > begin))
    last = cut[apart] - 1
    byte = data[last]
    # U+00C0 to U+00FF are C3 80 to C3 BF; after C3 stands its second byte, so the two lie in one word
    apart = apart[_IS_LETTER[byte] | ((data[last - 1] == 0xC3) & (byte >= 0x80) & (byte != 0x97) & (byte != 0xB7))]
    offsets = np.insert(offsets, apart + 1, cut[apart])
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data)), ends + np.searchsorted(apart, ends)


def portions(batch: pa.RecordBatch, texts: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``PORTION`` bytes of the texts in column ``texts``, one long text with the next short ones."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begins = [0, *(np.flatnonzero(np.diff(upto // PORTION)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(begins[:-1], begins[1:], strict=True) if a < b)
