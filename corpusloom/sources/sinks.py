"""Reports, traces and copies of collections, written by Spark into folders of any store."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_versioned_csv(rows: DataFrame, folder: str, name: str, most: int = 1000) -> str:
    """Writes ``name`` or, where that exists, ``name-v2``, ``name-v3`` and so on; nothing that exists is touched. Returns the path."""
    for n in range(1, most + 1):
        path = f"{folder}/{name}" if n == 1 else f"{folder}/{name}-v{n}"
        try:
            rows.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
        else:
            return path
    raise FileExistsError(f"{most} versions of {name} exist")


def write_results(rows: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with exactly these columns in this order; what a row set lacks is blank."""
    cells = [F.col(c).cast("string").alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns]
    rows.select(*cells).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_json_lines(events: DataFrame, path: str) -> None:
    """Appends rows as JSON lines: whole, or not at all if the job fails. Serves ``foreachBatch`` too."""
    events.write.mode("append").json(path)


def write_checkpoint(rows: DataFrame, path: str) -> None:
    """Appends (key, ordinal, row) as JSON lines, ``row`` being the JSON of a finished question; ``read_checkpoint`` reads them."""
    rows.select("key", F.col("ordinal").cast("long").alias("ordinal"), "row").write.mode("append").json(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Question traces from files that hold a JSON list each, or JSON lines."""
    return spark.read.option("multiLine", True).json(path)


#: Older reports name their columns differently: column -> names, the first one that a file has counts.
ALIASES = {"question": ("question", "query"), "answer": ("answer", "response"), "status": ("status", "answer_status"), "latency": ("latency", "total_latency", "latency_seconds")}


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """The CSV reports under ``path`` with their columns under one name each; missing ones are null."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    cells = []
    for name, names in ALIASES.items():
        found = [F.nullif(F.trim(n), F.lit("")) for n in names if n in rows.columns]
        cells.append(F.coalesce(*found, F.lit(None)).cast("string").alias(name))
    return rows.select(*cells).withColumn("latency", F.col("latency").try_cast("double"))


def copy_collection(spark: SparkSession, source: str, target: str, dry_run: bool = False, force: bool = False) -> tuple[int, int]:
    """Copies a table of points as it is, ids included, and compares the counts: (points of the source, points of the target).

    A target that exists is an error unless forced; a dry run only counts; a copy of another size raises.
    """
    points = spark.read.parquet(source)
    n = points.count()
    if dry_run:
        return n, 0
    points.write.mode("overwrite" if force else "errorifexists").parquet(target)
    copied = spark.read.parquet(target).count()
    if copied != n:
        raise RuntimeError(f"{copied} of {n} points were copied")
    return n, copied
