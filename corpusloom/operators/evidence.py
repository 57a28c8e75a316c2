"""Reranking, constrained selection and quality of evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import jaccard, term_set, word_tokens


def lexical_score(question: Column, text: Column) -> Column:
    """Deterministic stand-in for a cross-encoder: the share of the question's terms that the text holds, 6 digits."""
    q, t = term_set(question), term_set(text)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(q, t)) / F.size(q), 6))


def rerank(candidates: DataFrame, score: Column | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds reranker_score and reranked_rank. ``candidates`` has (query_id, question, text, rank); ties keep the rank.

    ``score`` is a column, a function that adds ``reranker_score`` (a model in a pandas UDF), or the lexical score.
    """
    rows = score(candidates) if callable(score) else candidates.withColumn("reranker_score", lexical_score(F.col("question"), F.col("text")) if score is None else score)
    place = W.partitionBy("query_id").orderBy(F.desc("reranker_score"), "rank")
    return rows.withColumn("reranked_rank", F.row_number().over(place))


def table_rerank(candidates: DataFrame, scores: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Reranked by given scores (key, given); 0 where there is none."""
    rows = candidates.join(scores.select(key, "given"), key, "left").withColumn("reranker_score", F.coalesce("given", F.lit(0.0))).drop("given")
    return rerank(rows, F.col("reranker_score"))


def passthrough_rerank(candidates: DataFrame) -> DataFrame:
    """reranker_score is the fused score, else the score, else 0; a zero counts as none."""
    fused = F.coalesce(F.nullif("rrf_score", F.lit(0.0)), F.nullif("score", F.lit(0.0)), F.lit(0.0))
    return rerank(candidates, fused)


def word_count(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, r"\s+")))


def select_evidence(
    pool: DataFrame,
    *,
    threshold: float = -4.0,
    budget: int = 2400,
    most: int = 8,
    least: int = 3,
    per_source: int = 2,
    redundancy: float = 0.85,
    target: tuple[int, int] = (800, 1500),
    fallback: int = 3,
    strategies: tuple[str, ...] = ("top_k", "score_threshold", "token_budget", "source_diversity", "redundancy_reduction"),
    count: Callable[[Column], Column] = word_count,
    weak_below: float = 0.35,
) -> DataFrame:
    """Adds evidence_token_count, selected, selection_reason, discard_reason and weak_evidence to a ranked pool
    (query_id, rank, chunk_id, source, text, score).

    A question's pool, which is capped upstream, is one sorted array, and the greedy choice three folds over it whose
    state is what was chosen so far and its tokens. The first takes rows over the threshold under all limits; the
    second fills up to the least number or the token target without the threshold, and without the token limits while the least number
    isn't reached; the third fills up to the least number without the limits on likeness and sources.
    ``weak_evidence``: rows were chosen, all of them with scores under ``weak_below``.
    """
    low, high = target
    body = F.trim(F.coalesce("text", F.lit("")))
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    score = F.when(F.isnan(score), F.lit(0.0)).otherwise(score)
    fields = {
        "rank": F.col("rank"), "id": F.col("chunk_id"), "source": F.col("source"), "tokens": count(body).cast("int"), "terms": term_set(body),
        "usable": body != "", "passing": score >= threshold if "score_threshold" in strategies else F.lit(True), "weak": score < weak_below, "row": F.struct(*pool.columns),
    }
    rows = pool.select("query_id", F.struct(*[c.alias(n) for n, c in fields.items()]).alias("x")).groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("rows"))
    # places tell equal rows apart
    rows = rows.withColumn("rows", F.transform("rows", lambda x, i: x.withField("at", i)))
    usable = F.size(F.filter("rows", lambda x: x["usable"]))
    floor = F.least(F.lit(least), usable, F.lit(most))
    raised = F.least(F.greatest(floor, F.lit(fallback)), usable, F.lit(most))
    nothing = ~F.exists("rows", lambda x: x["usable"] & x["passing"])
    rows = rows.withColumn("floor", F.when(nothing & (usable > 0), raised).otherwise(floor) if fallback else floor)

    def alike(x: Column, s: Column) -> Column:
        same = F.exists(s["chosen"], lambda y: y["id"].eqNullSafe(x["id"]))
        return same | F.exists(s["chosen"], lambda y: jaccard(y["terms"], x["terms"]) >= redundancy) if "redundancy_reduction" in strategies else same

    def crowded(x: Column, s: Column) -> Column:
        return F.size(F.filter(s["chosen"], lambda y: y["source"].eqNullSafe(x["source"]))) >= per_source if "source_diversity" in strategies else F.lit(False)

    def over_budget(x: Column, s: Column) -> Column:
        return s["used"] + x["tokens"] > budget if "token_budget" in strategies else F.lit(False)

    def over_target(x: Column, s: Column) -> Column:
        return s["used"] + x["tokens"] > high if high > 0 else F.lit(False)

    def enough(s: Column) -> Column:
        return (F.size(s["chosen"]) >= F.col("floor")) & (s["used"] >= low if low > 0 else F.lit(False))

    def reached(s: Column) -> Column:
        return F.size(s["chosen"]) >= F.col("floor")

    def folded(state: Column, take: Callable[[Column, Column], Column], why: str) -> Column:
        def step(s: Column, x: Column) -> Column:
            one = F.struct(x["at"].alias("at"), x["id"].alias("id"), x["source"].alias("source"), x["terms"].alias("terms"), x["weak"].alias("weak"), F.lit(why).alias("why"))
            more = F.struct(F.concat(s["chosen"], F.array(one)).alias("chosen"), (s["used"] + x["tokens"]).alias("used"))
            free = x["usable"] & (F.size(s["chosen"]) < most) & ~F.exists(s["chosen"], lambda y: y["at"] == x["at"])
            return F.when(free & take(x, s), more).otherwise(s)

        return F.aggregate("rows", state, step)

    def under_limits(x: Column, s: Column) -> Column:
        return x["passing"] & ~alike(x, s) & ~crowded(x, s) & ~over_budget(x, s) & ~enough(s) & ~(reached(s) & over_target(x, s))

    def filling(x: Column, s: Column) -> Column:
        open_ = ~reached(s) if low <= 0 else ~enough(s)
        return open_ & (~reached(s) | (~over_budget(x, s) & ~over_target(x, s)))

    kinds = {f.name: f.dataType.simpleString() for f in pool.schema}
    none = F.array().cast(f"array<struct<at:int,id:{kinds['chunk_id']},source:{kinds['source']},terms:array<string>,weak:boolean,why:string>>")
    empty = F.struct(none.alias("chosen"), F.lit(0).alias("used"))
    rows = rows.withColumn("s", folded(empty, under_limits, "threshold_pass"))
    rows = rows.withColumn("s", folded(F.col("s"), lambda x, s: filling(x, s) & ~alike(x, s) & ~crowded(x, s), "adaptive_fallback"))
    rows = rows.withColumn("s", folded(F.col("s"), lambda x, s: ~reached(s), "adaptive_fallback"))

    out = rows.select(
        F.explode("rows").alias("x"), "s", ((F.size("s.chosen") > 0) & F.forall("s.chosen", lambda y: y["weak"])).alias("weak_evidence")
    ).withColumn("why", F.get(F.filter("s.chosen", lambda y: y["at"] == F.col("x.at")), 0)["why"])
    x, s = F.col("x"), F.col("s")
    discarded = (
        F.when(F.col("why").isNotNull(), F.lit(None)).when(~x["usable"], "empty_text").when(~x["passing"], "threshold_failed").when(alike(x, s), "redundancy")
        .when(crowded(x, s), "source_diversity_limit").when(over_budget(x, s) | over_target(x, s), "token_budget").otherwise("lower_rank_fallback")
    )
    return out.select("x.row.*", x["tokens"].cast("long").alias("evidence_token_count"), F.col("why").isNotNull().alias("selected"), F.col("why").alias("selection_reason"), discarded.alias("discard_reason"), "weak_evidence")


def matched_terms(question: Column, text: Column) -> Column:
    """The index terms that a question and a text share, sorted."""
    return F.array_sort(F.array_intersect(word_tokens(question), word_tokens(text)))


def pairwise_jaccard(pool: DataFrame) -> DataFrame:
    """(query_id, a, b, jaccard) of the rows of each question's pool, whose size is capped upstream."""
    t = pool.select("query_id", "rank", term_set(F.col("text")).alias("terms"))
    a, b = t.toDF("query_id", "a", "ta"), t.toDF("query_id", "b", "tb")
    return a.join(b, "query_id").filter("a < b").select("query_id", "a", "b", F.round(jaccard(F.col("ta"), F.col("tb")), 6).alias("jaccard"))


def strength(score: Column, strong: float = 0.65, medium: float = 0.35) -> Column:
    return F.when(score >= strong, "strong").when(score >= medium, "medium").otherwise("weak")


def evidence_quality(selected: DataFrame) -> DataFrame:
    """Adds strength, has_citation and adds_source (first of its source) to (query_id, rank, chunk_id, source, score)."""
    first = F.row_number().over(W.partitionBy("query_id", "source").orderBy("rank")) == 1
    cited = (F.coalesce("source", F.lit("")) != "") & (F.coalesce("chunk_id", F.lit("")) != "")
    return selected.withColumn("strength", strength(F.coalesce("score", F.lit(0.0)))).withColumn("has_citation", cited).withColumn("adds_source", first)


def confidence(quality: DataFrame) -> DataFrame:
    """(query_id, evidence_count, mean_score, confidence): none, weak (all weak), mixed (some weak) or strong."""
    weak = F.col("strength") == "weak"
    return quality.groupBy("query_id").agg(
        F.count("*").alias("evidence_count"),
        F.round(F.avg("score"), 6).alias("mean_score"),
        F.when(F.bool_and(weak), "weak").when(F.bool_or(weak), "mixed").otherwise("strong").alias("confidence"),
    )
