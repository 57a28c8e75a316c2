"""Format registry: which files are read, how, and a readiness report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import base_name, suffix

# Fixed values that results depend on: category, label, status, extensions, special file names.
NOW, OCR, LATER, UNSUPPORTED = "supported_now", "ocr_supported", "recognized_future_support", "unsupported"
REGISTRY = (
    ("Core Enterprise Documents", "PDF", NOW, "pdf", ""),
    ("Core Enterprise Documents", "Word", NOW, "docx doc", ""),
    ("Core Enterprise Documents", "Excel", NOW, "xlsx xls", ""),
    ("Core Enterprise Documents", "CSV", NOW, "csv", ""),
    ("Core Enterprise Documents", "PowerPoint", NOW, "pptx ppt", ""),
    ("Core Enterprise Documents", "Text", NOW, "txt", ""),
    ("Technical Documentation", "Markdown", NOW, "md markdown", ""),
    ("Technical Documentation", "HTML", NOW, "html htm", ""),
    ("Technical Documentation", "JSON", NOW, "json", ""),
    ("Technical Documentation", "XML", NOW, "xml", ""),
    ("Technical Documentation", "YAML", NOW, "yaml yml", ""),
    ("Images with OCR", "PNG", OCR, "png", ""),
    ("Images with OCR", "JPG/JPEG", OCR, "jpg jpeg", ""),
    ("Images with OCR", "TIFF", OCR, "tiff tif", ""),
    ("Email / Communication", "Email", LATER, "eml msg pst mbox", ""),
    ("Archives", "Archives", LATER, "zip rar 7z tar gz", ""),
    ("Source Code", "Source Code", LATER, "py js ts tsx jsx java cpp c cs go rs php swift kt rb sql", ""),
    ("Configuration / DevOps", "Configuration Files", LATER, "toml ini env", "Dockerfile docker-compose.yml package.json requirements.txt"),
    ("Multimedia", "Audio", LATER, "mp3 wav aac", ""),
    ("Multimedia", "Video", LATER, "mp4 mov avi mkv", ""),
    ("Engineering / CAD", "CAD / Engineering", LATER, "dwg dxf step stp iges sldprt sldasm", ""),
)


def registry(spark: SparkSession) -> DataFrame:
    """(kind, key, category, label, status): one row for each extension and each special file name, in lower case."""
    rows = [(kind, k.lower(), c, n, s) for c, n, s, extensions, names in REGISTRY for kind, keys in (("extension", extensions), ("name", names)) for k in keys.split()]
    return spark.createDataFrame(rows, "kind string, key string, category string, label string, status string")


def lookup(paths: DataFrame, column: str = "path") -> DataFrame:
    """Adds category, label, status and action; a special file name counts before the extension. The registry is a fixed table, so it is broadcast."""
    known = registry(paths.sparkSession)
    by_name = known.filter("kind = 'name'").select(F.col("key").alias("_name"), F.struct("category", "label", "status").alias("_by_name"))
    by_suffix = known.filter("kind = 'extension'").select(F.col("key").alias("_suffix"), F.struct("category", "label", "status").alias("_by_suffix"))
    name, end = F.lower(base_name(F.col(column))), suffix(F.col(column))
    joined = paths.join(F.broadcast(by_name), name == F.col("_name"), "left").join(F.broadcast(by_suffix), end == F.col("_suffix"), "left")
    found = F.coalesce("_by_name", "_by_suffix")
    status = F.coalesce(found["status"], F.lit(UNSUPPORTED))
    return joined.select(
        *paths.columns,
        F.coalesce(found["category"], F.lit("Unknown")).alias("category"),
        F.coalesce(found["label"], F.lit("Unknown")).alias("label"),
        status.alias("status"),
        action(status).alias("action"),
    )


def action(status: Column) -> Column:
    return F.when(status == NOW, "process").when(status == OCR, "ocr_then_process").when(status == LATER, "skip_with_warning").otherwise("reject")


def readiness(paths: DataFrame, column: str = "path", samples: int = 5) -> DataFrame:
    """(extension, category, status, files, examples): counts and a few first paths in order.

    Each group keeps ``samples`` paths while it is aggregated, never all of them.
    """
    named = lookup(paths, column).withColumn("extension", suffix(F.col(column)))
    counts = named.groupBy("extension", "category", "status").agg(F.count("*").alias("files"))
    from pyspark.sql import Window as W

    first = named.withColumn("n", F.row_number().over(W.partitionBy("extension", "category", "status").orderBy(column))).filter(F.col("n") <= samples)
    shown = first.groupBy("extension", "category", "status").agg(F.array_join(F.array_sort(F.collect_list(column)), ", ").alias("examples"))
    return counts.join(shown, ["extension", "category", "status"])
