"""Canonical result records, their links, classes and completeness."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import base_name, number, suffix

MODALITIES = ("text", "table", "image", "chart", "diagram", "ocr", "audio", "video")


def normalized(rows: DataFrame) -> DataFrame:
    """(id, text, score, source_path, source, page_number, chunk_id) from open records (id, text, score string, source, file_name, page_number, chunk_id); blanks count as missing."""
    def given(c: str) -> Column:
        return F.nullif(F.trim(F.col(c)), F.lit(""))

    path = F.coalesce(given("source"), given("file_name"), F.lit(""))
    return rows.select(
        "id", F.coalesce("text", F.lit("")).alias("text"), F.col("score").try_cast("double").alias("score"), path.alias("source_path"),
        F.coalesce(base_name(given("file_name")), base_name(given("source")), F.lit("")).alias("source"), F.col("page_number").cast("string").alias("page_number"), "chunk_id",
    )


def retrieval_class(sources: Column) -> Column:
    """both, dense, bm25, or what else the list of retrievers amounts to."""
    dense, lexical = F.array_contains(sources, "dense"), F.array_contains(sources, "bm25")
    return F.when(dense & lexical, "both").when(dense, "dense").when(lexical, "bm25").when(F.size(sources) > 0, "fallback").otherwise("unknown")


def completeness(rows: DataFrame) -> DataFrame:
    """Adds complete (source, page and chunk) and citable (source and chunk)."""
    def there(c: str) -> Column:
        return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""
    return rows.withColumn("complete", there("source") & there("page_number") & there("chunk_id")).withColumn("citable", there("source") & there("chunk_id"))


def citation_quality(citations: DataFrame) -> DataFrame:
    """(..., metadata_complete): whether document, page_number, chunk_id, score and source_path are all given; an empty string isn't."""
    given = [F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in ("document", "page_number", "chunk_id", "score", "source_path")]
    return citations.withColumn("metadata_complete", reduce(and_, given))


def page_fragment(page: Column) -> Column:
    """Number of the first page of a page label, if it is above 0."""
    n = F.trim(F.element_at(F.split(page, ","), 1)).try_cast("int")
    return F.when(n > 0, n)


def citation_link(path: Column, page: Column, base_url: str | None = None) -> Column:
    """Link to a PDF: a file URI for an absolute path, or the quoted name under ``base_url``; null for other files."""
    quoted = F.replace(F.url_encode(base_name(path) if base_url else path), F.lit("+"), F.lit("%20"))
    target = F.concat(F.lit(base_url.rstrip("/") + "/"), quoted) if base_url else F.concat(F.lit("file://"), F.replace(quoted, F.lit("%2F"), F.lit("/")))
    n = page_fragment(page)
    link = F.concat(target, F.when(n.isNotNull(), F.concat(F.lit("#page="), n.cast("string"))).otherwise(F.lit("")))
    return F.when((suffix(path) == "pdf") & (F.lit(bool(base_url)) | F.startswith(path, F.lit("/"))), link)


def safe_href(url: Column) -> Column:
    """The address if its scheme may be rendered, else null."""
    scheme = F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(scheme.isin("http", "https", "file"), F.trim(url))


def modality_mix(evidence: DataFrame) -> DataFrame:
    """(modality, rows) for each known modality, also those without rows."""
    known = evidence.sparkSession.createDataFrame([(m,) for m in MODALITIES], "modality string")
    counts = evidence.groupBy("modality").agg(F.count("*").alias("n"))
    return F.broadcast(known).join(counts, "modality", "left").select("modality", F.coalesce("n", F.lit(0)).cast("long").alias("rows"))


def merged_counts(rows: DataFrame, column: str) -> DataFrame:
    """(name, total): the sums of the entries of a map column over all rows."""
    return rows.select(F.explode(column).alias("name", "n")).groupBy("name").agg(F.sum("n").cast("long").alias("total"))


def spread_by(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, least, q1, median, q3, most), exact, six digits."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy(by).agg(F.round(F.min(value), 6).alias("least"), q.alias("q"), F.round(F.max(value), 6).alias("most"))
    return out.select(by, "least", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q1", "median", "q3"))], "most")


def numeric(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as numbers, 0 where they hold none."""
    return rows.withColumns({c: number(F.col(c)) for c in columns})
