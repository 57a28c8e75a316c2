"""Diagnostic tables over rankings, chunks and answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def retrieval_comparison(results: DataFrame) -> DataFrame:
    """Per mode: rows returned, distinct chunks and sources, mean and largest score. ``results`` has (mode, chunk_id, source, score)."""
    return results.groupBy("mode").agg(
        F.count("*").alias("returned"),
        F.countDistinct("chunk_id").alias("distinct_chunks"),
        F.countDistinct("source").alias("distinct_sources"),
        F.round(F.avg("score"), 4).alias("mean_score"),
        F.round(F.max("score"), 4).alias("max_score"),
    )


def duplicate_frequency(results: DataFrame, duplicates_only: bool = False) -> DataFrame:
    """How often each chunk was retrieved and by which techniques: (source, chunk_id, frequency, max_score, techniques)."""
    out = results.groupBy("source", "chunk_id").agg(
        F.count("*").alias("frequency"), F.round(F.max("score"), 6).alias("max_score"), F.array_join(F.array_sort(F.collect_set("technique")), ",").alias("techniques")
    )
    return out.filter("frequency > 1") if duplicates_only else out


def variant_contribution(results: DataFrame) -> DataFrame:
    """Per technique: occurrences, distinct chunks and sources, mean score, chunks that no other technique found."""
    alone = results.groupBy("query_id", "chunk_id").agg(F.min("technique").alias("technique"), F.max("technique").alias("other")).filter("technique = other")
    only = alone.groupBy("technique").agg(F.count("*").alias("exclusive"))
    out = results.groupBy("technique").agg(
        F.count("*").alias("occurrences"), F.countDistinct("chunk_id").alias("unique_chunks"), F.countDistinct("source").alias("unique_sources"), F.round(F.avg("score"), 4).alias("mean_score")
    )
    return out.join(only, "technique", "left").withColumn("exclusive", F.coalesce("exclusive", F.lit(0)).cast("long"))


def top_sources(results: DataFrame, n: int = 10) -> DataFrame:
    """The sources with most retrieved chunks: (source, chunks, mean_score, max_score)."""
    out = results.groupBy("source").agg(F.countDistinct("chunk_id").alias("chunks"), F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.max("score"), 4).alias("max_score"))
    return out.orderBy(F.desc("chunks"), F.desc("max_score"), "source").limit(n)


def low_scores(results: DataFrame, threshold: float, n: int = 20) -> DataFrame:
    return results.filter(F.col("score") < threshold).orderBy("score", "query_id", "chunk_id", "technique").limit(n)


def histogram(rows: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, rows): equal widths between the least and the largest value; all in bin 1 if they are the same."""
    ends = rows.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    place = F.when(F.col("_high") == F.col("_low"), F.lit(1)).otherwise(F.least(F.floor((F.col(value) - F.col("_low")) / width) + 1, F.lit(bins)))
    return (
        rows.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends))  # one row
        .groupBy(place.cast("long").alias("bin"))
        .agg(F.count("*").alias("rows"), F.round(F.min(value), 6).alias("low"), F.round(F.max(value), 6).alias("high"))
    )


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("Unknown")).alias("value")).agg(F.count("*").alias("rows"))


def slowest(rows: DataFrame, latency: str, key: str, n: int = 10) -> DataFrame:
    return rows.filter(F.col(latency).isNotNull()).orderBy(F.desc(latency), key).limit(n)


def funnel(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage_order, stage, rows): the size of each stage's result."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(i).cast("long").alias("stage_order"), F.lit(name).alias("stage"), "rows") for i, (name, df) in enumerate(stages.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def token_efficiency(before: Column, after: Column) -> Column:
    """Reduction in percent, two digits, never below 0."""
    return F.greatest(F.coalesce(F.round(100 * (1 - F.try_divide(after, before)), 2), F.lit(0.0)), F.lit(0.0))


def always(rows: DataFrame, passed: bool) -> DataFrame:
    """Questions that pass (or fail) under every experiment: (question_id, experiments)."""
    n = rows.select("experiment_id").distinct().agg(F.count("*").alias("_n"))
    per = rows.groupBy("question_id").agg(F.countDistinct("experiment_id").alias("experiments"), F.bool_and(F.col("passed") == passed).alias("_all"))
    return per.crossJoin(F.broadcast(n)).filter("_all and experiments = _n").select("question_id", "experiments")


def benefit(rows: DataFrame, setting: str) -> DataFrame:
    """Questions that fail at the least value of a setting and pass at the largest."""
    per = rows.groupBy("question_id").agg(F.min_by("passed", setting).alias("first"), F.max_by("passed", setting).alias("last"))
    return per.filter("not first and last").select("question_id")


def latency_table(events: DataFrame, by: str, value: str) -> DataFrame:
    """(by, events, mean, median, least, most), six digits; the median is exact."""
    return events.filter(F.col(value).isNotNull()).groupBy(by).agg(
        F.count("*").alias("events"),
        F.round(F.avg(value), 6).alias("mean"),
        F.round(F.percentile(value, 0.5), 6).alias("median"),
        F.round(F.min(value), 6).alias("least"),
        F.round(F.max(value), 6).alias("most"),
    )


def retrieval_diagnostics(rows: DataFrame) -> DataFrame:
    """(query_id, finding) from (query_id, utilisation, bm25_only, overlap_ratio, generation, retrieval, sources)."""
    rules = [
        ("context_nearly_full", F.col("utilisation") > 95),
        ("lexical_only", F.col("bm25_only")),
        ("low_overlap", F.col("overlap_ratio") < 0.25),
        ("generation_dominates", F.col("generation") > F.greatest(F.lit(0.001), 2 * F.col("retrieval"))),
        ("single_source", F.col("sources") <= 1),
    ]
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    return rows.select("query_id", F.explode(found).alias("finding"))


def selection_diagnostics(rows: DataFrame) -> DataFrame:
    """(query_id, finding) from (query_id, selected, reduction, tokens, answered, zero_scores, mean_score, redundant, generation, reranking, total, sources)."""
    rules = [
        ("starved", F.col("selected") < 3),
        ("over_reduced", F.col("reduction") > 90),
        ("well_reduced", (F.col("reduction") >= 40) & (F.col("reduction") <= 90)),
        ("thin_context", F.col("answered") & (F.col("tokens") < 500)),
        ("zero_score", F.col("zero_scores") > 0),
        ("weak_mean", F.col("mean_score") < 0.35),
        ("redundant_pool", F.col("redundant") >= 2),
        ("generation_dominates", F.col("generation") * 2 > F.col("total")),
        ("reranking_dominates", F.col("reranking") * 2 > F.col("total")),
        ("single_source", F.col("sources") <= 1),
    ]
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    return rows.select("query_id", F.explode(found).alias("finding"))


def summarize_documents(docs: DataFrame, by: str) -> DataFrame:
    return docs.groupBy(by).agg(F.count("*").alias("documents"), F.sum(F.length("text")).cast("long").alias("chars"), F.round(F.avg(F.length("text")), 1).alias("avg_chars"))


def document_report(docs: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """(dimension, value, documents, chars, avg_chars, sources): all documents, and those of each value of each dimension, in one aggregate by grouping sets.

    ``docs`` has (text, source) and the dimensions; a null value is "unknown", null text has no characters. Sources are the different ones.
    """
    base = docs.select(F.length(F.coalesce("text", F.lit(""))).alias("_n"), F.col("source").alias("_s"), *[F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias(f"_{d}") for d in dimensions])
    names = [f"_{d}" for d in dimensions]
    out = base.groupingSets([[], *[[n] for n in names]], *names).agg(
        *[F.grouping(n).alias(f"_of{n}") for n in names], F.count("*").alias("documents"), F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("chars"), F.coalesce(F.round(F.avg("_n"), 1), F.lit(0.0)).alias("avg_chars"), F.countDistinct("_s").alias("sources")
    )
    dimension = F.coalesce(*[F.when(F.col(f"_of_{d}") == 0, d) for d in dimensions], F.lit("all"))
    value = F.coalesce(*[F.when(F.col(f"_of_{d}") == 0, F.col(f"_{d}")) for d in dimensions], F.lit("all"))
    return out.select(dimension.alias("dimension"), value.alias("value"), "documents", "chars", "avg_chars", "sources")


def final_sections(results: DataFrame, sections: DataFrame) -> DataFrame:
    """(technique, final_sections): in how many final sections (query_id, section, chunk_ids) each technique's finds ended up, 0 included."""
    held = sections.select("query_id", "section", F.explode("chunk_ids").alias("chunk_id"))
    counts = results.select("query_id", "chunk_id", "technique").distinct().join(held, ["query_id", "chunk_id"]).groupBy("technique").agg(F.countDistinct("query_id", "section").alias("n"))
    return results.select("technique").distinct().join(counts, "technique", "left").select("technique", F.coalesce("n", F.lit(0)).alias("final_sections"))


def page_distribution(results: DataFrame, n: int = 20) -> DataFrame:
    out = results.groupBy("source", F.coalesce(F.col("page").cast("string"), F.lit("none")).alias("page")).agg(F.count("*").alias("rows"))
    return out.orderBy(F.desc("rows"), "source", "page").limit(n)


def ranked_within(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*order)))


def ocr_summary(documents: DataFrame, *by: str) -> DataFrame:
    """What recognition did with the documents that need it: (processed, succeeded, failed, rate, mean_ms, chars, words), of each ``by``.

    ``documents`` has (requires_ocr, ocr_status, extraction_ms, chars, words), one row for each scanned file, read or not.
    """
    needed, read = F.coalesce("requires_ocr", F.lit(False)), F.col("ocr_status").isNotNull()
    done = F.count_if(needed & (F.col("ocr_status") == "OCR_SUCCESS"))
    total = F.count_if(needed)
    return documents.groupBy(*by).agg(
        F.count_if(needed & read).alias("processed"), done.alias("succeeded"), F.greatest(total - done, F.lit(0)).alias("failed"),
        F.coalesce(F.round(F.try_divide(done, total), 6), F.lit(0.0)).alias("rate"),
        F.coalesce(F.round(F.avg(F.when(needed & read, F.coalesce("extraction_ms", F.lit(0.0)))), 6), F.lit(0.0)).alias("mean_ms"),
        F.coalesce(F.sum(F.when(needed & read, F.col("chars"))), F.lit(0)).cast("long").alias("chars"),
        F.coalesce(F.sum(F.when(needed & read, F.col("words"))), F.lit(0)).cast("long").alias("words"),
    )


def chart_totals(traces: DataFrame, *by: str) -> DataFrame:
    """(by..., questions, tokens, seconds, strong, weak, sources): sums for the charts of a report over (tokens, seconds, strength, source)."""
    return traces.groupBy(*by).agg(
        F.count("*").alias("questions"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"), F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)), 4).alias("seconds"),
        F.count_if(F.col("strength") == "strong").alias("strong"), F.count_if(F.col("strength") == "weak").alias("weak"), F.countDistinct("source").alias("sources"),
    )


def timing_table(timings: DataFrame, steps: list[str]) -> DataFrame:
    """(run_id, step_order, step, seconds): the timings (run_id, step, seconds) of the named steps that a run has, summed, in the given order."""
    order = F.array_position(F.array(*map(F.lit, steps)), F.col("step"))
    out = timings.filter(F.col("step").isin(steps) & F.col("seconds").isNotNull()).groupBy("run_id", "step").agg(F.round(F.sum("seconds"), 6).alias("seconds"))
    return out.select("run_id", order.cast("long").alias("step_order"), "step", "seconds")


def mode_limit(questions: DataFrame, mode: str, order: str, cap: int | None = None) -> DataFrame:
    """The questions of a run mode: the first three of a smoke run, as many as asked for of a manual one, all of a benchmark."""
    n = 3 if mode == "smoke" else cap if mode == "manual" else None
    return questions.orderBy(order).limit(n) if n is not None else questions


CELLS = 200


def heatmap(rows: DataFrame, x: str, y: str, value: str, values: Sequence[str]) -> DataFrame:
    """(y, one column for each of ``values``): the mean of ``value`` for each pair, 0 where there is none, six digits.

    ``values`` states the columns, so nothing is scanned to find them and a new value can't widen the table; null is its own row.
    """
    if not 0 < len(values) <= CELLS or len(set(values)) < len(values):
        raise ValueError(f"state 1 to {CELLS} different values of {x}")
    out = rows.groupBy(y).pivot(x, list(values)).agg(F.round(F.avg(F.col(value).cast("double")), 6))
    return out.select(y, *[F.coalesce(F.col(f"`{v}`"), F.lit(0.0)).alias(str(v)) for v in values])
