"""Tokenizers as columns: count, truncate and what is left of a budget."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Codec(ABC):
    """Counts and cuts texts exactly by a tokenizer; null is an empty text."""

    @abstractmethod
    def count(self, text: Column) -> Column:
        """Tokens of a text, bigint."""

    @abstractmethod
    def truncate(self, text: Column, most: int) -> Column:
        """The text itself if it has at most ``most`` tokens, else its first ones, right-trimmed, counted again and shortened until they fit."""

    @abstractmethod
    def counter(self) -> Callable[[str], int]:
        """``count`` of one string, for folds over a short list inside a task."""

    def remaining(self, used: Column, most: Column) -> Column:
        """most - used; an error at run time for a budget below 1, a negative use or one beyond the budget."""
        bad = F.when(used < 0, F.lit("used tokens are negative")).when(most <= 0, F.lit("a budget must be positive")).when(used > most, F.format_string("%d tokens are used of %d", used.cast("long"), most.cast("long")))
        return F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(most - used).cast("long")


class Words(Codec):
    """A token is a run without white space. Columns stay on the JVM."""

    _RUN = r"[^\s]+"

    def count(self, text: Column) -> Column:
        return F.coalesce(F.regexp_count(text, F.lit(self._RUN)), F.lit(0)).cast("long")

    def truncate(self, text: Column, most: int) -> Column:
        if most < 0:
            raise ValueError("most must not be negative")
        cut = F.regexp_extract(text, rf"^(?:\s*{self._RUN}){{{most}}}", 0) if most else F.lit("")
        return F.when(self.count(text) <= most, F.coalesce(text, F.lit(""))).otherwise(cut)

    def counter(self) -> Callable[[str], int]:
        return lambda text: len(text.split())


class Encoded(Codec):
    """By any tokenizer: ``make`` runs once in a task and returns (encode, decode). Texts travel in Arrow batches."""

    def __init__(self, make: Callable[[], tuple[Callable[[str], Sequence[int]], Callable[[Sequence[int]], str]]]) -> None:
        self.make = make

    @staticmethod
    def of_file(path: str) -> Encoded:
        """By a file of the tokenizers library, without special tokens; ``path`` is readable where tasks run."""

        def make():
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            return (lambda text: t.encode(text, add_special_tokens=False).ids), (lambda ids: t.decode(list(ids), skip_special_tokens=True))

        return Encoded(make)

    def count(self, text: Column) -> Column:
        make = self.make

        @F.pandas_udf("long")
        def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode, _ = make()
            for part in parts:
                yield part.map(lambda t: len(encode(t)) if t else 0)

        return counted(text)

    def truncate(self, text: Column, most: int) -> Column:
        if most < 0:
            raise ValueError("most must not be negative")
        make = self.make

        @F.pandas_udf("string")
        def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode, decode = make()
            for part in parts:
                yield part.map(lambda t: shortened(t or "", most, encode, decode))

        return cut(text)

    def counter(self) -> Callable[[str], int]:
        held: list = []

        def count(text: str) -> int:
            if not held:
                held.append(self.make()[0])
            return len(held[0](text))

        return count


def shortened(text: str, most: int, encode: Callable[[str], Sequence[int]], decode: Callable[[Sequence[int]], str]) -> str:
    """``text`` within ``most`` tokens. Decoded and trimmed text can have more tokens than the ids it came from, so it is counted again."""
    ids = list(encode(text))
    if len(ids) <= most:
        return text
    for n in range(most, 0, -1):
        found = decode(ids[:n]).rstrip()
        if len(encode(found)) <= most:
            return found
    return ""
