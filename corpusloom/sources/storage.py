"""Tables in the folder that driver and executors share, and logs of their versions."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDERS: dict[str, str] = {}

#: Changes when tables of ``stored`` are laid out anew.
FORMAT = 2


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


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of this application in the shared folder: what reads it twice sees the same rows, and a lost executor doesn't cost what came before."""
    path = f"{shared_folder(df.sparkSession)}/corpusloom/{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables of at most so many rows are broadcast by ``few``.
FEW = 50_000


def few(df: DataFrame, name: str) -> DataFrame:
    """``written``, to be broadcast where it has few rows, so that a large table that it is joined with stays where it is; else Spark chooses the join."""
    out = written(df, name)
    return F.broadcast(out) if out.count() <= FEW else out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def version(spark: SparkSession, *paths: str) -> str:
    """Changes with the files behind the paths: their names, sizes and times are read, not their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h"))
    n, total = files.agg(F.count("*"), F.sum("h")).first()
    return f"{n}-{int(total or 0) % (1 << 64):016x}"


def table_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def publish(spark: SparkSession, log: str, entry: dict, schema: str) -> None:
    """Adds one row to a log. It is one file that the committer renames into place, so readers see all of it or nothing."""
    spark.createDataFrame([Row(**entry)], schema).coalesce(1).write.mode("append").parquet(log)


def published(spark: SparkSession, log: str, schema: str) -> list[Row]:
    """The rows of a log, a row for each version."""
    found = table_or_none(spark, log, schema)
    return found.collect() if found is not None else []


_STORED = "key string, folder string, at double"


def stored(spark: SparkSession, name: str, key: str, build: Callable[[], DataFrame], parameters: object = ()) -> DataFrame:
    """The table ``name`` of version ``key`` made with ``parameters``: written by the first who asks, read by all others.

    Every writer has a folder of its own and publishes it when it is whole. Of several writers of one version all readers take the one that was published
    first, so nobody deletes or replaces files that others read, and a writer that dies leaves nothing that is read.
    """
    base = f"{shared_folder(spark)}/corpusloom/stored/{name}"
    key = f"{key}-{FORMAT}-{uuid.uuid5(uuid.NAMESPACE_OID, repr(parameters)).hex}"

    def first() -> str | None:
        return min(((r.at, r.folder) for r in published(spark, f"{base}/log", _STORED) if r.key == key), default=(0, None))[1]

    if (folder := first()) is None:
        folder = f"{base}/{uuid.uuid4().hex}"
        build().write.parquet(folder)
        publish(spark, f"{base}/log", {"key": key, "folder": folder, "at": time.time()}, _STORED)
        folder = first()
    return spark.read.parquet(folder)


def prune(spark: SparkSession, name: str) -> int:
    """Deletes the tables of ``stored`` under ``name`` but for the newest; for a time when nobody reads older ones. Returns how many went."""
    base = f"{shared_folder(spark)}/corpusloom/stored/{name}"
    entries = sorted(published(spark, f"{base}/log", _STORED), key=lambda r: (r.at, r.folder))
    if not entries:
        return 0
    kept = min((r for r in entries if r.key == entries[-1].key), key=lambda r: (r.at, r.folder))
    gone = {r.folder for r in entries} - {kept.folder}
    delete(spark, f"{base}/log")
    publish(spark, f"{base}/log", kept.asDict(), _STORED)
    for folder in gone:
        delete(spark, folder)
    return len(gone)
