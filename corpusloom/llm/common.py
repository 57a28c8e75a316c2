"""Helpers the operators of this subpackage share: tables in the shared folder, words, hashes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from weakref import WeakKeyDictionary
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that ends a word, and the pattern of a word.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_OWN_FOLDERS: dict[str, str] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets an own one (tests); on a cluster that is an error, since
    executors on other machines couldn't read what is written there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:
        _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="spark-")
    return _OWN_FOLDERS[app]


def write_table(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back: the lineage ends at files that outlive an executor."""
    spark = df.sparkSession
    path = f"{_app_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def _app_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/corpusloom/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clean_up(spark: SparkSession) -> None:
    """Deletes all tables this application wrote into the shared folder. For the end of a job: results that are still to be read need them."""
    _delete(spark, _app_folder(spark))


def release(spark: SparkSession) -> None:
    """Lets the cleaner delete the shuffle files of finished steps now, not when the driver's heap happens to fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_table(df: DataFrame) -> None:
    """Deletes the files behind a frame of ``write_table`` once nothing reads them any more."""
    _delete(df.sparkSession, _PATHS.pop(df))


def over_rows(df: DataFrame, make: Callable[[], Callable[..., list | None]], schema: str, many: bool = False) -> DataFrame:
    """Applies a function row by row inside Arrow batches.

    ``make`` runs once per task and returns ``f(*columns) -> row`` (or, with
    ``many``, an iterable of rows). Output batches are cut so that a task never
    holds more than a few thousand rows.
    """
    out = T.StructType.fromDDL(schema)
    arrow = _arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        rows: list = []
        for batch in batches:
            columns = [c.to_pylist() if not pa.types.is_binary(c.type) else [None if x is None else x for x in c.to_pylist()] for c in batch.columns]
            for values in zip(*columns, strict=True):
                if many:
                    rows.extend(f(*values))
                else:
                    rows.append(f(*values))
                if len(rows) >= 4096:
                    yield _batch(rows, arrow)
                    rows = []
        if rows:
            yield _batch(rows, arrow)

    return df.mapInArrow(run, out)


def _batch(rows: list, arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class WordHashes(dict):
    """64-bit hashes of words, remembered for the frequent ones. Bounded: it forgets nothing but stops learning when full."""

    ROOM = 300_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < self.ROOM and len(word) < 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (a bijection)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` consecutive entries of ``h``; doubling, so it takes log2(k) passes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, step, size = h, _ODD, 1
    total, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                part = power[done : done + n]
                total = part.copy() if total is None else total * step + part
                done += size
            size *= 2
            if size > k:
                return mixed(total)
            power = power[: len(power) - size // 2] * step + power[size // 2 :]
            step = step * step


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """Names for temporary columns that none of ``columns`` has in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8(text: str | None) -> bytes:
    """UTF-8, empty for null."""
    return (text or "").encode("utf-8", "surrogatepass")


def id_hash(column: Column | str, modulus: int) -> Column:
    """The fold of a row: crc32 of the id as text, modulo ``modulus`` (null ids: null)."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % modulus


def spread(column: str, seed: int) -> Column:
    """A seeded uniform number in [0, 1) that depends on the value alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(1 << 30)) / float(1 << 30)
