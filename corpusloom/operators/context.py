"""Evidence to context: neighbours, merged sections, budgets."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import base_name
from corpusloom.operators.fusion import deduplicate
from corpusloom.sources import storage

OVERLAP = 250


def neighbor_expand(seeds: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """(query_id, source, chunk_index, chunk_id, text, score, is_neighbor): seeds and the chunks up to ``window`` places away.

    ``seeds`` has (query_id, source, chunk_index, chunk_id, text, score, place).
    A neighbour inherits its seed's score. The band join is an equi-join on
    exploded places. Of rows for the same chunk the highest score stays, the
    first in the order of seeds on ties. Seeds without an index stay alone.
    """
    at = F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("offset")
    wanted = seeds.filter("chunk_index is not null").select("query_id", "source", "score", "place", F.col("chunk_index").alias("seed_index"), at).filter("offset != 0")
    wanted = wanted.withColumn("chunk_index", F.col("seed_index") + F.col("offset"))
    near = wanted.join(chunks.select("source", "chunk_index", "chunk_id", "text"), ["source", "chunk_index"]).withColumn("is_neighbor", F.lit(True))
    own = seeds.select("query_id", "source", "chunk_index", "chunk_id", "text", "score", "place", F.lit(0).alias("offset"), F.lit(False).alias("is_neighbor"))
    # a seed comes before its neighbours, those from the lowest place up
    order = F.struct(F.col("place"), F.when(F.col("offset") == 0, -window - 1).otherwise(F.col("offset")).alias("offset"))
    both = own.unionByName(near.select(own.columns)).withColumn("order", order)
    first = W.partitionBy("query_id", "source", "chunk_id").orderBy(F.desc_nulls_last("score"), "order")
    return both.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "order", "offset", "place")


def islands(rows: DataFrame) -> DataFrame:
    """Adds ``island``: a new one wherever chunk_index isn't the previous one plus 1 in its (query_id, source); unindexed rows stand alone."""
    w = W.partitionBy("query_id", "source", F.col("chunk_index").isNull()).orderBy("chunk_index", "chunk_id")
    breaks = F.when(F.col("chunk_index").isNull() | (F.coalesce(F.col("chunk_index") - F.lag("chunk_index").over(w), F.lit(0)) != 1), 1).otherwise(0)
    return rows.withColumn("_break", breaks).withColumn("island", F.sum("_break").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_break")


def join_without_overlap(left: Column, right: Column, most: int = OVERLAP) -> Column:
    """Right appended to left without the longest text (up to ``most`` characters) that ends one and begins the other."""
    a, b = F.rtrim(left), F.ltrim(right)
    limit = F.least(F.length(a), F.length(b), F.lit(most))
    sizes = F.when(limit > 0, F.sequence(limit, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    shared = F.coalesce(F.try_element_at(F.filter(sizes, lambda n: F.right(a, n) == F.left(b, n)), F.lit(1)), F.lit(0))
    return F.when(shared > 0, F.concat(a, F.substr(b, shared + 1))).otherwise(F.concat(a, F.lit("\n"), b))


def merge_overlapping(rows: DataFrame) -> DataFrame:
    """(query_id, source, island, chunk_ids, first_index, last_index, score, merged_chunk_count, text): consecutive chunks as one section."""
    held = islands(rows).groupBy("query_id", "source", F.col("chunk_index").isNull().alias("alone"), "island").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text"))).alias("parts"), F.max("score").alias("score")
    )
    text = F.aggregate(F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))), F.col("parts")[0]["text"], lambda a, p: join_without_overlap(a, p["text"]))
    return held.select(
        "query_id", "source", "island",
        F.col("parts.chunk_id").alias("chunk_ids"),
        F.array_min("parts.chunk_index").alias("first_index"),
        F.array_max("parts.chunk_index").alias("last_index"),
        "score",
        F.size("parts").cast("long").alias("merged_chunk_count"),
        text.alias("text"),
    )


def header(rank: Column, source: Column, chunk: Column, score: Column) -> Column:
    shown = F.when(score.isNull(), F.lit("Not scored")).otherwise(F.format_string("%.3f", score))
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), source, F.lit(" | chunk "), chunk, F.lit(" | score "), shown, F.lit("\n"))


def full_header(rank: Column, source: Column, page: Column, chunk: Column, score: Column, fused: Column) -> Column:
    """The five lines before a section; ``fused`` tells whether its score comes from fused rankings."""
    given = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("Not provided"))
    shown = F.when(score.isNull(), F.lit("Not scored")).otherwise(F.format_string("%.3f", score))
    label = F.when(fused, "RRF Score: ").otherwise("Similarity Score: ")
    return F.concat(
        F.lit("["), rank.cast("string"), F.lit("]\nDocument: "), source, F.lit("\nPage: "), given(page), F.lit("\nChunk ID: "), given(chunk), F.lit("\n"), label, shown, F.lit("\n")
    )


def section_details(rows: DataFrame) -> DataFrame:
    """What the chunks of each section carry together: (query_id, source, first_index, chunk, page, score, rrf_score, techniques, ranks, scores).

    ``rows`` has (query_id, source, chunk_index, chunk_id, page, score, rrf_score, techniques, ranks, scores): an array of techniques, maps from a
    retriever to a rank and to a score, all of which may be null. Pages and techniques keep the order in which they first occur; scores are the
    largest, ranks the least of each retriever.
    """
    kept = ("chunk_index", "chunk_id", "page", "score", "rrf_score", "techniques", "ranks", "scores")
    held = islands(rows).groupBy("query_id", "source", F.col("chunk_index").isNull().alias("alone"), "island").agg(
        F.sort_array(F.collect_list(F.struct(*kept[:2], F.struct(*kept[2:5]).alias("page_score"), "techniques", F.map_entries("ranks").alias("ranks"), F.map_entries("scores").alias("scores")))).alias("parts")
    )
    ids = F.filter("parts.chunk_id", lambda x: F.coalesce(x, F.lit("")) != "")
    pages = F.array_distinct(F.filter(F.transform("parts.page_score", lambda x: x["page"].cast("string")), lambda x: x.isNotNull()))

    def each(name: str, best) -> Column:
        pairs = F.flatten(F.filter(F.col(f"parts.{name}"), lambda x: x.isNotNull()))
        keys = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["key"])))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: best(F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["value"]))))

    return held.select(
        "query_id", "source", F.array_min("parts.chunk_index").alias("first_index"),
        F.when(F.size(ids) > 1, F.concat(ids[0], F.lit(" .. "), F.element_at(ids, -1))).otherwise(F.coalesce(F.get(ids, 0), F.lit(""))).alias("chunk"),
        F.array_join(pages, ", ").alias("page"),
        F.array_max(F.transform("parts.page_score", lambda x: x["score"])).alias("score"),
        F.array_max(F.transform("parts.page_score", lambda x: x["rrf_score"])).alias("rrf_score"),
        F.array_distinct(F.flatten(F.filter(F.col("parts.techniques"), lambda x: x.isNotNull()))).alias("techniques"),
        each("ranks", F.array_min).alias("ranks"), each("scores", F.array_max).alias("scores"),
    )


def compress(sections: DataFrame, budget: int) -> DataFrame:
    """(query_id, section, block, truncated): sections in rank order until the budget of characters is used.

    ``sections`` has (query_id, section, source, chunk, text, score), section being the rank from 1. A
    block takes its length and two more; the one that doesn't fit is cut and right-trimmed. Blocks are folded
    in order inside a query's row, which holds the ranked list of one question.
    """
    named = sections.withColumn("head", header(F.col("section"), F.col("source"), F.col("chunk"), F.col("score")))
    return _budgeted(named, budget, F.rtrim)


def _budgeted(named: DataFrame, budget: int, end: Callable[[Column], Column]) -> DataFrame:
    """(query_id, section, block, truncated) of (query_id, section, head, text): heads and texts in order until the budget is used; ``end`` finishes a text that was cut."""
    held = named.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("section", "head", "text"))).alias("all"))
    empty = F.array().cast("array<struct<section:bigint,block:string,truncated:boolean>>")
    start = F.struct(F.lit(0).cast("int").alias("used"), F.lit(False).alias("full"), empty.alias("out"))

    def step(s: Column, x: Column) -> Column:
        room = F.lit(budget) - s["used"] - F.length(x["head"])
        cut = F.length(x["text"]) > room
        body = F.when(cut, end(F.left(x["text"], F.greatest(room, F.lit(0))))).otherwise(x["text"])
        block = F.concat(x["head"], body)
        used = (s["used"] + F.length(block) + 2).cast("int")
        added = F.struct(used.alias("used"), (used >= budget).alias("full"), F.concat(s["out"], F.array(F.struct(x["section"].cast("bigint").alias("section"), block.alias("block"), cut.alias("truncated")))).alias("out"))
        stop = F.struct(s["used"].alias("used"), F.lit(True).alias("full"), s["out"].alias("out"))
        return F.when(s["full"] | (room <= 0), stop).otherwise(added)

    return held.select("query_id", F.explode(F.aggregate("all", start, step)["out"]).alias("x")).select("query_id", "x.*")


def simple_context(results: DataFrame, budget: int) -> DataFrame:
    """(query_id, context, sections): the plain context of ranked results (query_id, rank, source, page, chunk_id, score, text) within a budget of characters.

    Each text is trimmed and stands under one line: its rank, its file's name, page, chunk and score. The one that doesn't fit is cut where the budget ends. A null source is "unknown", a null page or
    chunk "n/a", a null score 0. Ranks are from 1 without ties; a question whose budget holds no line has no row.
    """
    if budget <= 0:
        raise ValueError("budget must be positive")
    page = F.coalesce(F.concat(F.lit("p. "), F.col("page").cast("string")), F.lit("page n/a"))
    head = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] "), base_name(F.coalesce("source", F.lit("unknown"))), F.lit(" | "), page, F.lit(" | chunk "), F.coalesce("chunk_id", F.lit("n/a")),
        F.lit(" | score "), F.format_string("%.3f", F.coalesce(F.col("score").cast("double"), F.lit(0.0))), F.lit("\n"),
    )
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    named = results.select("query_id", F.col("rank").cast("long").alias("section"), head.alias("head"), body.alias("text"))
    return contexts(_budgeted(named, budget, lambda c: c))


def expansion_roles(expanded: DataFrame, seeds: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``expanded`` with ``role``: retrieved_seed where its question's ``seeds`` hold the chunk, also if it was reached as a neighbour of another one, else added_adjacent_chunk."""
    own = seeds.select("query_id", key).distinct().withColumn("_seed", F.lit(True))
    role = F.when(F.col("_seed"), "retrieved_seed").otherwise("added_adjacent_chunk")
    return expanded.join(own, ["query_id", key], "left").withColumn("role", role).drop("_seed")


def compress_tokens(sections: DataFrame, budget: int, count: Callable[[str], int]) -> DataFrame:
    """(query_id, context, used, truncated_sections, omitted_sections): as ``compress``, by the tokens of the joined text.

    Tokens of joined texts aren't sums of tokens of parts, so each query's ranked list is
    walked in Python with the given counter; the last section is shortened until the whole fits.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("section")
        text, cut, left = "", 0, 0
        for body in rows["block"]:
            joined = f"{text}\n\n{body}" if text else body
            if left or cut:
                left += 1
                continue
            if count(joined) <= budget:
                text = joined
                continue
            low, high = 0, len(body)
            while low < high:
                mid = (low + high + 1) // 2
                tried = body[:mid].rstrip()
                if count(f"{text}\n\n{tried}" if text else tried) <= budget:
                    low = mid
                else:
                    high = mid - 1
            part = body[:low].rstrip()
            if part:
                text, cut = (f"{text}\n\n{part}" if text else part), 1
            else:
                left += 1
        return pd.DataFrame([(rows["query_id"].iloc[0], text, count(text), cut, left)], columns=["query_id", "context", "used", "truncated_sections", "omitted_sections"])

    kind = sections.schema["query_id"].dataType.simpleString()
    return sections.select("query_id", "section", "block").groupBy("query_id").applyInPandas(walk, f"query_id {kind}, context string, used long, truncated_sections long, omitted_sections long")


def contexts(blocks: DataFrame) -> DataFrame:
    """(query_id, context, sections): blocks joined by blank lines."""
    held = blocks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("section", "block"))).alias("all"))
    return held.select("query_id", F.array_join("all.block", "\n\n").alias("context"), F.size("all").cast("long").alias("sections"))


def compression(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, merged_chars, final_chars, retained, percent): the text of all sections under their headers against what the budget left."""
    whole = F.length(header(F.col("section"), F.col("source"), F.col("chunk"), F.col("score"))) + F.length("text")
    before = sections.groupBy("query_id").agg((F.sum(whole) + 2 * (F.count("*") - 1)).cast("long").alias("merged_chars"))
    after = blocks.groupBy("query_id").agg((F.sum(F.length("block")) + 2 * (F.count("*") - 1)).cast("long").alias("final_chars"))
    out = before.join(after, "query_id", "left").fillna({"final_chars": 0})
    ratio = F.coalesce(F.try_divide("final_chars", "merged_chars"), F.lit(0.0))
    return out.withColumn("retained", F.round(ratio, 6)).withColumn("percent", F.round(100 * (1 - ratio), 4))


def section_lengths(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, section, chars, included, truncated): every section, and what the budget did to it."""
    kept = blocks.select("query_id", "section", "truncated", F.lit(True).alias("included"))
    out = sections.select("query_id", "section", F.length("text").cast("long").alias("chars")).join(kept, ["query_id", "section"], "left")
    return out.fillna({"included": False, "truncated": False}).select("query_id", "section", "chars", "included", "truncated")


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """One row for each question of any stage: how many rows it has in each."""
    parts = [df.select("query_id", F.lit(name).alias("stage")) for name, df in stages.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("query_id").agg(*[F.count_if(F.col("stage") == name).alias(name) for name in stages])


def build_context(results: DataFrame, chunks: DataFrame, window: int = 1, budget: int = 3000, dedup: bool = True, expand: bool = True, merge: bool = True, shorten: bool = True, k: int = 3) -> dict[str, DataFrame]:
    """The stages from (query_id, chunk_id, score, technique, pos, source, chunk_index, text) to blocks, by name; a stage switched off passes its rows on.

    The first ``k`` results of a question are seeds. Without a budget blocks are whole. Ranked, expanded and merged rows are written where they are made, so that
    counting or reading a stage doesn't run those before it again.
    """
    by_place = W.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    if dedup:
        carried = results.select("chunk_id", "source", "chunk_index", "text").dropDuplicates(["chunk_id"])
        ranked = deduplicate(results).join(carried, "chunk_id")
    else:
        ranked = results.withColumn("place", F.row_number().over(by_place))
    ranked = storage.written(ranked, "ranked")
    seeds = ranked.filter(F.col("place") <= k)
    wide = neighbor_expand(seeds, chunks, window) if expand else seeds.select("query_id", "source", "chunk_index", "chunk_id", "text", "score")
    wide = storage.written(wide, "expanded")
    if merge:
        sections = merge_overlapping(wide).withColumn("chunk", F.array_join("chunk_ids", " .. "))
    else:
        sections = wide.withColumn("first_index", F.col("chunk_index")).withColumn("chunk", F.col("chunk_id"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "source", "first_index", "chunk")
    sections = sections.withColumn("section", F.row_number().over(order).cast("long")).select("query_id", "section", "source", "chunk", "score", "text")
    sections = storage.written(sections, "merged")
    blocks = compress(sections, budget if shorten else 2**31 - 1)
    return {"retrieved": results, "deduplicated": ranked, "expanded": wide, "merged": sections, "included": blocks}
