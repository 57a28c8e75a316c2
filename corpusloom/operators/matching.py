"""Citations, markers and evidence brought together, each inside one question's capped lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_key(source: Column) -> Column:
    """The name a source goes by: the last part of its path, lower case, without the ending .pdf; empty if null."""
    return F.regexp_replace(F.lower(F.element_at(F.split(F.coalesce(source, F.lit("")), "[/\\\\]"), -1)), r"\.pdf$", "")


def _folded(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def _named(rows: DataFrame, number: str, prefix: str) -> DataFrame:
    keys = [source_key(F.col("source")).alias(f"{prefix}source"), _folded(F.col("chunk_id")).alias(f"{prefix}chunk"), _folded(F.col("page")).alias(f"{prefix}page")]
    return rows.select("query_id", F.col(number).alias(f"{prefix}n"), F.col("chunk_id").alias(f"{prefix}id"), *keys)


def citation_match(citations: DataFrame, records: DataFrame) -> DataFrame:
    """(query_id, citation, chunk_id): the first record of the question, by rank, that each citation means; null if none.

    ``citations`` has (query_id, citation, source, chunk_id, page), ``records`` (query_id, rank, source, chunk_id, page). Sources
    agree unless both are given and differ. With a chunk on both sides one has to hold the other; else pages decide, a missing page
    agreeing with any, if the citation names a source or a page.
    """
    both = _named(citations, "citation", "c_").join(_named(records, "rank", "r_"), "query_id", "left")
    c, blank = F.col, lambda x: F.col(x) == ""
    chunked = ~blank("c_chunk") & ~blank("r_chunk")
    same_source = blank("c_source") | blank("r_source") | (c("c_source") == c("r_source"))
    same_page = (~blank("c_source") | ~blank("c_page")) & (blank("c_page") | blank("r_page") | (c("c_page") == c("r_page")))
    meant = same_source & F.when(chunked, F.contains("r_chunk", "c_chunk") | F.contains("c_chunk", "r_chunk")).otherwise(same_page)
    hit = F.when(F.coalesce(meant, F.lit(False)), F.struct("r_n", "r_id"))
    return both.groupBy("query_id", F.col("c_n").alias("citation")).agg(F.min(hit)["r_id"].alias("chunk_id"))


def evidence_match(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, citation, chunk_id): the first evidence with the citation's chunk where both have one, else with its source and page."""
    both = _named(citations, "citation", "c_").join(_named(evidence, "rank", "r_"), "query_id", "left")
    c = F.col
    chunked = (c("c_chunk") != "") & (c("r_chunk") != "")
    meant = F.when(chunked, c("c_chunk") == c("r_chunk")).otherwise((c("c_source") == c("r_source")) & (c("c_page") == c("r_page")))
    hit = F.when(F.coalesce(meant, F.lit(False)), F.struct("r_n", "r_id"))
    return both.groupBy("query_id", F.col("c_n").alias("citation")).agg(F.min(hit)["r_id"].alias("chunk_id"))


def marker_parts(marker: Column) -> list[Column]:
    """number, source, page and chunk that a citation marker names; a marker is a number or parts between bars."""
    clean = F.trim(marker)
    part = lambda name: F.trim(F.regexp_extract(clean, rf"(?i)\b{name}\s*:?\s*([^|]+)", 1))
    first = F.regexp_replace(F.trim(F.split(clean, r"\|")[0]), r"(?i)^source\s*:?\s*", "")
    number = F.when(clean.rlike(r"^\d{1,9}$"), clean.cast("long"))
    return [number.alias("number"), source_key(F.trim(first)).alias("m_source"), F.lower(part("page")).alias("m_page"), F.lower(part("chunk")).alias("m_chunk")]


def marker_resolve(markers: DataFrame, citations: DataFrame) -> DataFrame:
    """(query_id, place, marker, citation): the citation each marker of (query_id, place, marker) means, null unless it is exactly one.

    A number means the citation of that number. Parts mean the one whose source holds the named one or the other way round, whose page is equal
    and whose chunk ends in the named one; page or chunk has to be named.
    """
    asked = markers.select("query_id", "place", "marker", *marker_parts(F.col("marker")))
    both = asked.join(_named(citations, "citation", "c_"), "query_id", "left")
    c = F.col
    source = (c("m_source") == "") | ((c("c_source") != "") & (F.contains("c_source", "m_source") | F.contains("m_source", "c_source")))
    parts = F.contains("marker", F.lit("|")) & ((c("m_page") != "") | (c("m_chunk") != ""))
    named = parts & source & ((c("m_page") == "") | (c("m_page") == c("c_page"))) & ((c("m_chunk") == "") | F.endswith("c_chunk", "m_chunk"))
    hit = F.coalesce(F.when(c("number").isNotNull(), c("number") == c("c_n")).otherwise(named), F.lit(False))
    out = both.groupBy("query_id", "place", "marker").agg(F.count_if(hit).alias("n"), F.min(F.when(hit, c("c_n"))).alias("found"))
    return out.select("query_id", "place", "marker", F.when(c("n") == 1, c("found")).alias("citation"))


def final_context_inclusion(pool: DataFrame, used: DataFrame) -> DataFrame:
    """Adds ``included`` to a pool: whether its (query_id, chunk_id) is among the chunks the context was made of."""
    return pool.join(used.select("query_id", "chunk_id").distinct().withColumn("included", F.lit(True)), ["query_id", "chunk_id"], "left").fillna({"included": False})


def fallback_sufficient(selected: DataFrame, least: float, weak_override: bool = False) -> DataFrame:
    """(query_id, sufficient): whether the selected evidence carries an extractive answer.

    ``selected`` has (query_id, score, selection_reason, weak, confidence), one row for each piece. The best and the mean score
    have to reach ``least``, the confidence to be strong or mixed, and neither may all pieces be fallbacks nor all be weak; the override lets weak
    confidence pass.
    """
    score = F.coalesce("score", F.lit(0.0))
    override = (F.first("confidence") == "weak") & F.lit(weak_override)
    sound = ~F.bool_and(F.coalesce("selection_reason", F.lit("")) == "adaptive_fallback") & ~F.bool_and("weak")
    ok = (F.max(score) >= least) & (F.round(F.avg(score), 9) >= least) & (F.first("confidence").isin("strong", "mixed") | override) & (sound | override)
    return selected.groupBy("query_id").agg(ok.alias("sufficient"))


def question_traces(questions: DataFrame, variants: DataFrame, results: DataFrame, evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row for each question with its variants, ranked results, judged evidence and context sections, each an ordered array of structs.

    A question's lists are capped by the retrieval that made them. Questions that found nothing keep empty arrays.
    """
    def held(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    out = questions
    for part in (
        held(variants, "variants", "variant_order", "technique", "query"), held(results, "results", "variant_order", "rank", "chunk_id", "score"),
        held(evidence, "evidence", "rank", "chunk_id", "selected", "selection_reason", "discard_reason"), held(blocks, "sections", "section", "block", "truncated"),
    ):
        name = part.columns[1]
        out = out.join(part, "query_id", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return out
