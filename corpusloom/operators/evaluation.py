"""Evaluation of answers and of experiments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import collapse, fold, ratio
from corpusloom.sources import storage

# Fixed values that results depend on.
SAFE_FAILURE_MARKERS = (
    "insufficient evidence",
    "do not contain sufficient",
    "could not find enough evidence",
    "no reliable answer",
    "cannot answer from",
    "not available in the",
)
#: Passages of one or two words that are looked for together.
SHORT_PASSAGES = 1000
WEIGHTS = {"accuracy": 0.55, "citation": 0.15, "safety": 0.20, "latency": 0.10}


def text_findings(rows: DataFrame) -> DataFrame:
    """Adds what only the text tells: matched_keywords, keyword_score, forbidden_matches, has_text, marked, citation_count.

    ``rows`` has (answer, expected_keywords, forbidden_keywords). All of it is local to the row, so that joins
    and shuffles that follow needn't carry the text.
    """
    none = F.array().cast("array<string>")
    text = fold(collapse(F.coalesce("answer", F.lit(""))))

    def hits(name: str):
        return F.size(F.filter(F.coalesce(name, none), lambda k: F.contains(F.col("_text"), fold(collapse(k))))).cast("long")

    n = F.size(F.coalesce("expected_keywords", none))
    marked = reduce(lambda a, m: a | F.contains(F.col("_text"), F.lit(m)), SAFE_FAILURE_MARKERS, F.lit(False))
    out = rows.withColumn("_text", text).withColumns({"matched_keywords": hits("expected_keywords"), "forbidden_matches": hits("forbidden_keywords"), "has_text": F.col("_text") != "", "marked": marked})
    out = out.withColumn("keyword_score", F.round(F.when(n > 0, F.col("matched_keywords") / n).otherwise(F.col("has_text").cast("double")), 6))
    cited = F.size(F.array_distinct(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1))))
    return out.withColumn("citation_count", cited.cast("long")).drop("_text")


def verdicts(found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds safe_failure, passed and hallucinated to findings with (answer_status, should_answer)."""
    status = F.replace(fold(collapse(F.coalesce("answer_status", F.lit("")))), F.lit(" "), F.lit("_"))
    out = found.withColumn("safe_failure", status.isin("insufficient_evidence", "safe_failure") | F.col("marked"))
    answered = F.col("has_text") & ~F.col("safe_failure")
    return out.withColumns({
        "passed": F.when(F.col("should_answer"), answered & (F.col("keyword_score") >= threshold)).otherwise(F.col("safe_failure") & (F.col("forbidden_matches") == 0)),
        "hallucinated": F.when(F.col("should_answer"), F.col("forbidden_matches") > 0).otherwise(answered),
    }).drop("has_text", "marked")


def evaluate_answers(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds matched_keywords, keyword_score, forbidden_matches, safe_failure, passed, hallucinated, citation_count.

    ``rows`` has (answer, answer_status, expected_keywords, forbidden_keywords, should_answer).
    """
    return verdicts(text_findings(rows), threshold)


def summarize_experiments(rows: DataFrame, means: Sequence[str] = ()) -> DataFrame:
    """One row per experiment_id: question_count, accuracy (all, supported, unsupported), hallucination rate, and averages of ``means``."""
    good = F.col("passed").cast("int")
    return rows.groupBy("experiment_id").agg(
        F.count("*").alias("question_count"),
        F.round(F.avg(good), 6).alias("answer_accuracy"),
        F.coalesce(F.round(F.avg(F.when(F.col("should_answer"), good)), 6), F.lit(0.0)).alias("supported_accuracy"),
        F.coalesce(F.round(F.avg(F.when(~F.col("should_answer"), good)), 6), F.lit(0.0)).alias("unsupported_accuracy"),
        F.round(F.avg(F.col("hallucinated").cast("int")), 6).alias("hallucination_rate"),
        *[F.round(F.avg(F.coalesce(F.col(m).cast("double"), F.lit(0.0))), 6).alias(f"average_{m}") for m in means],
    )


#: Means of an experiment, by the column they are taken of.
MEANS = {
    "keyword_coverage": "keyword_score", "citation_quality": "citation_quality", "average_citation_count": "citation_count", "average_latency": "total_latency", "average_retrieval_latency": "retrieval_latency",
    "average_context_construction_latency": "context_construction_latency", "average_generation_latency": "generation_latency", "average_context_size": "final_context_characters", "average_context_tokens": "context_tokens",
    "average_context_sections": "final_context_sections", "average_retrieved_chunks": "chunks_before_deduplication", "average_deduplicated_chunks": "chunks_after_deduplication",
    "average_expanded_chunks": "chunks_after_neighbor_expansion", "average_merged_sections": "merged_context_sections",
}
DIMENSIONS = {"category": "uncategorized", "difficulty": "unknown"}


def aggregate_experiment(rows: DataFrame, means: Mapping[str, str] = MEANS, dimensions: Mapping[str, str] = DIMENSIONS) -> DataFrame:
    """(experiment_id, dimension, value, question_count, accuracies, hallucination_rate, means): all questions of an experiment, and those of each category and difficulty, by grouping sets in one aggregate.

    A column of ``means`` that the rows lack, and a cell that is null or no number, counts as 0; a null dimension has its default as value; should_answer is true where it is null.
    Rates of no rows are 0. All numbers have six digits.
    """
    known = {c.lower() for c in rows.columns}
    zero = F.lit(0.0)
    numbers = {out: F.coalesce(F.col(c).try_cast("double"), zero) if c.lower() in known else zero for out, c in means.items()}
    good, asked = F.coalesce(F.col("passed"), F.lit(False)).cast("int"), F.coalesce(F.col("should_answer"), F.lit(True))
    base = rows.select(
        "experiment_id", *[F.coalesce(F.col(d).cast("string"), F.lit(default)).alias(d) for d, default in dimensions.items()], good.alias("_good"), asked.alias("_asked"),
        F.coalesce(F.col("hallucinated"), F.lit(False)).cast("int").alias("_wrong"), *[n.alias(f"_{out}") for out, n in numbers.items()],
    )
    names = list(dimensions)
    rate = lambda c: F.coalesce(F.round(F.avg(c), 6), zero)
    out = base.groupingSets([["experiment_id"], *[["experiment_id", d] for d in names]], "experiment_id", *names).agg(
        *[F.grouping(d).alias(f"_of_{d}") for d in names], F.count("*").alias("question_count"), rate("_good").alias("answer_accuracy"),
        rate(F.when(F.col("_asked"), F.col("_good"))).alias("supported_answer_accuracy"), rate(F.when(~F.col("_asked"), F.col("_good"))).alias("unsupported_question_accuracy"),
        rate("_wrong").alias("hallucination_rate"), *[rate(f"_{m}").alias(m) for m in means],
    )
    dimension = F.coalesce(*[F.when(F.col(f"_of_{d}") == 0, d) for d in names], F.lit("all"))
    value = F.coalesce(*[F.when(F.col(f"_of_{d}") == 0, F.col(d)) for d in names], F.lit("all"))
    numbers_out = [c for c in out.columns if c not in ("experiment_id", *names) and not c.startswith("_of_")]
    return out.select("experiment_id", dimension.alias("dimension"), value.alias("value"), *numbers_out)


def experiment_records(aggregated: DataFrame, dimensions: Sequence[str] = tuple(DIMENSIONS)) -> DataFrame:
    """One row per experiment of ``aggregate_experiment``: its numbers over all questions, and a map of pass rates for each dimension, keys sorted."""
    whole = aggregated.filter("dimension = 'all'").drop("dimension", "value")
    maps = aggregated.groupBy("experiment_id").agg(*[F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("dimension") == d, F.struct("value", "answer_accuracy"))))).alias(f"pass_rate_by_{d}") for d in dimensions])
    return whole.join(maps, "experiment_id")


def pass_rates(rows: DataFrame, *by: str) -> DataFrame:
    """Pass rate by experiment and by each of ``by`` alone: (experiment_id, dimension, value, questions, pass_rate). Each row is counted once for each of ``by``."""
    named = rows.select("experiment_id", F.col("passed").cast("int").alias("good"), F.explode(F.array(*[F.struct(F.lit(b).alias("dimension"), F.coalesce(F.col(b).cast("string"), F.lit("unknown")).alias("value")) for b in by])).alias("d"))
    return named.groupBy("experiment_id", "d.dimension", "d.value").agg(F.count("*").alias("questions"), F.round(F.avg("good"), 6).alias("pass_rate"))


def rank_experiments(summaries: DataFrame) -> DataFrame:
    """Adds overall_score and rank; latency counts inversely between the least and the largest. There is a row for each experiment."""
    everything = W.partitionBy(F.lit(1))
    low, high = F.min("average_latency").over(everything), F.max("average_latency").over(everything)
    speed = F.when(high == low, F.lit(1.0)).otherwise(1 - (F.col("average_latency") - low) / (high - low))
    score = WEIGHTS["accuracy"] * F.col("answer_accuracy") + WEIGHTS["citation"] * F.col("citation_quality") + WEIGHTS["safety"] * (1 - F.col("hallucination_rate")) + WEIGHTS["latency"] * speed
    place = W.orderBy(F.desc("overall_score"), "average_latency", "experiment_id")
    return summaries.withColumn("overall_score", F.round(score, 6)).withColumn("rank", F.row_number().over(place))


def recommendations(ranked: DataFrame) -> DataFrame:
    """One row: best, fastest, most accurate, safest and best cited experiment; the better rank on ties."""
    def first(order):
        return F.min_by("experiment_id", F.struct(order, F.col("rank")))
    return ranked.agg(
        first(F.col("rank").cast("double")).alias("best_overall"),
        first(F.col("average_latency")).alias("fastest"),
        first(-F.col("answer_accuracy")).alias("most_accurate"),
        first(F.col("hallucination_rate")).alias("safest"),
        first(-F.col("citation_quality")).alias("best_cited"),
    )


STAGE_LATENCIES = {"retrieval": "average_retrieval_latency", "context construction": "average_context_construction_latency", "generation": "average_generation_latency"}


def tradeoffs(ranked: DataFrame, stages: Mapping[str, str] = STAGE_LATENCIES) -> DataFrame:
    """One row: the best experiment against the fastest, and where the best one spends its time.

    (best_overall, fastest, accuracy_delta, latency_delta, bottleneck, bottleneck_seconds); latency_delta is relative, 0 where the fastest takes no time. The better
    rank, and the stage named first, win ties. ``ranked`` is what ``rank_experiments`` gives, with the mean latencies of ``stages``.
    """
    row = F.struct("experiment_id", F.coalesce("answer_accuracy", F.lit(0.0)).alias("accuracy"), F.coalesce("average_latency", F.lit(0.0)).alias("latency"), *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in stages.values()])
    both = ranked.agg(F.min_by(row, "rank").alias("b"), F.min_by(row, F.struct(F.coalesce("average_latency", F.lit(0.0)), "rank")).alias("f"))
    most = F.greatest(*[F.col(f"b.{c}") for c in stages.values()])
    name = F.coalesce(*[F.when(F.col(f"b.{c}") == most, n) for n, c in stages.items()])
    return both.filter("b is not null").select(
        F.col("b.experiment_id").alias("best_overall"), F.col("f.experiment_id").alias("fastest"), F.round(F.col("b.accuracy") - F.col("f.accuracy"), 6).alias("accuracy_delta"),
        F.coalesce(F.round(F.try_divide("b.latency", "f.latency") - 1, 6), F.lit(0.0)).alias("latency_delta"), name.alias("bottleneck"), F.round(most, 6).alias("bottleneck_seconds"),
    )


def experiment_grid(spark: SparkSession, options: Mapping[str, Sequence], prefix: str = "exp") -> DataFrame:
    """(experiment_id, one column for each option): the product of all options, in order, the last varying fastest."""
    if not all(options.values()):
        raise ValueError("every option needs at least one value")
    frames = [spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"_{n} int, {n} {_kind(values[0])}") for n, values in options.items()]
    grid = reduce(lambda a, b: a.crossJoin(b), frames)  # literals: their number is the caller's
    ordinal = reduce(lambda acc, n: acc * len(options[n]) + F.col(f"_{n}"), options, F.lit(0)) + 1
    return grid.select(F.format_string(f"{prefix}_%03d", ordinal).alias("experiment_id"), *options)


def _kind(value) -> str:
    return "boolean" if isinstance(value, bool) else "int" if isinstance(value, int) else "double" if isinstance(value, float) else "string"


def evaluation_join(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows with the benchmark entry of exactly their question; of repeated questions the last entry (by ordinal) counts, unmatched rows go."""
    last = benchmark.groupBy("question").agg(F.max_by(F.struct(*[c for c in benchmark.columns if c not in ("question", "ordinal")]), "ordinal").alias("_b"))
    return rows.join(last, "question").select(*rows.columns, "_b.*")


def run_summary(rows: DataFrame) -> DataFrame:
    """One row: questions by status, mean and total times."""
    return rows.agg(
        F.count("*").alias("questions"),
        F.count_if(F.expr("status = 'answered'")).alias("answered"),
        F.count_if(F.expr("status = 'insufficient_evidence'")).alias("insufficient"),
        F.count_if(F.expr("status not in ('answered', 'insufficient_evidence')")).alias("other"),
        F.round(F.avg("latency"), 6).alias("mean_latency"),
        F.round(F.sum("latency"), 6).alias("total_latency"),
        ratio(F.count_if(F.expr("status = 'answered'")), F.count("*")).alias("answer_rate"),
    )


def run_report(rows: DataFrame) -> DataFrame:
    """One row on a run: questions by outcome, mean latencies, chunks and tokens, and accuracy over the judged questions.

    ``rows`` has (status, answer_status, total_latency, retrieval_latency, retrieved_chunks, context_tokens, passed, hallucinated, citation_quality); the last three are null where a question
    isn't judged, and the rates are null where none is. Null numbers count as 0; answer statuses are compared without regard to case, blanks or underscores. Without rows all is 0 or null.
    """
    status = F.regexp_replace(F.lower(F.coalesce("answer_status", F.lit(""))), " ", "_")
    mean = lambda c: F.coalesce(F.round(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), 6), F.lit(0.0))
    judged = lambda c: F.round(F.avg(F.when(F.col("passed").isNotNull(), F.coalesce(F.col(c).cast("double"), F.lit(0.0)))), 6)
    names = {"answered_questions": "answered", "insufficient_evidence_questions": "insufficient_evidence", "unsupported_query_questions": "unsupported_query", "generation_failed_questions": "generation_failed"}
    good = F.coalesce(F.col("status") == "success", F.lit(False))
    return rows.agg(
        F.count("*").alias("question_count"), F.count_if(good).alias("successful_questions"), F.count_if(~good).alias("failed_questions"), *[F.count_if(status == v).alias(k) for k, v in names.items()],
        mean("total_latency").alias("average_latency_seconds"), mean("retrieval_latency").alias("average_retrieval_latency_seconds"), mean("retrieved_chunks").alias("average_retrieved_chunks"), mean("context_tokens").alias("average_context_tokens"),
        judged("passed").alias("answer_accuracy"), judged("hallucinated").alias("hallucination_rate"), judged("citation_quality").alias("citation_quality"),
    )


RERANKING_MEANS = {"average_token_reduction_percent": "token_reduction_percent", "average_reranker_score": "average_reranker_score", "average_selected_chunk_count": "selected_chunk_count", "average_discarded_chunk_count": "discarded_chunk_count", "average_selected_evidence_tokens": "selected_evidence_tokens"}
RERANKING_SUMS = ("selected_chunk_count", "discarded_chunk_count")
STRENGTHS = ("strong", "medium", "weak")


def reranking_metrics(rows: DataFrame) -> DataFrame:
    """(metric, name, value) on reranked and selected evidence: means, sums and counts (name null), and merged distributions with a row for each name.

    ``rows`` has a row for each question: the numbers of RERANKING_MEANS, weak_evidence, and the maps strengths and discard_reasons (name to count). Null numbers and maps count as none; all
    three strengths are listed, also without evidence. One aggregate gives the scalars, one explode all distributions.
    """
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    scalars = rows.agg(
        *[F.coalesce(F.round(F.avg(number(c)), 6), F.lit(0.0)).alias(m) for m, c in RERANKING_MEANS.items()], *[F.coalesce(F.sum(number(c)), F.lit(0.0)).alias(c) for c in RERANKING_SUMS],
        F.count_if(F.coalesce("weak_evidence", F.lit(False))).cast("double").alias("weak_evidence_question_count"), F.count("*").cast("double").alias("question_count"),
    )
    tall = scalars.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.lit(None).cast("string").alias("name"), F.col(c).alias("value")) for c in scalars.columns])).alias("x")).select("x.*")
    of = lambda metric, c: F.transform(F.map_entries(c), lambda e: F.struct(F.lit(metric).alias("metric"), e["key"].alias("name"), e["value"].cast("double").alias("value")))
    named = {"evidence_strength": "strengths", "discard_reason": "discard_reasons"}
    empty = F.array().cast("array<struct<metric:string,name:string,value:double>>")
    entries = rows.select(F.explode(F.concat(*[F.coalesce(of(m, c), empty) for m, c in named.items()])).alias("x")).select("x.*")
    listed = rows.sparkSession.createDataFrame([("evidence_strength", s, 0.0) for s in STRENGTHS], "metric string, name string, value double")
    return tall.unionByName(entries.unionByName(listed).groupBy("metric", "name").agg(F.sum("value").alias("value")))


def holders(documents: DataFrame, passages: DataFrame, key: str, window: int = 5) -> DataFrame:
    """(key, doc_id): the documents (doc_id, text) that hold a whole passage (key, passage) as a part of their text.

    The words inside a passage are whole words of any text that holds it, so both are joined by a hash of up to ``window`` words after
    a passage's first one, and whole passages are compared after that. Anchors are written first: where they are few, which Spark checks by their size, they are
    broadcast, and a document's windows that are none of them end where they are made. What meets is written too, so texts are compared where they are read
    unless too many meet. Of passages of one or two words, which have no word inside, a bounded block at a time is
    looked for in each text. Null and empty passages are held by nothing; a document that holds a passage twice is listed once.
    """
    spark = documents.sparkSession
    words = lambda c: F.filter(F.split(c, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    sized = passages.filter("passage != ''").select(key, "passage", words("passage").alias("_w"))
    n = F.least(F.size("_w") - 2, F.lit(window))
    asked = storage.written(sized.filter(F.size("_w") > 2).select(key, "passage", n.alias("_n"), F.xxhash64(F.slice("_w", F.lit(2), n)).alias("_anchor")), "passages")
    lengths = sorted(r[0] for r in asked.select("_n").distinct().collect())  # at most ``window`` numbers
    anchors = storage.written(asked.select("_n", "_anchor").distinct(), "anchors")
    held = documents.select("doc_id", words("text").alias("_w"))
    pairs = None
    for m in lengths:
        made = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_w") - m + 1), lambda i: F.xxhash64(F.slice("_w", i, m))))  # noqa: B023
        some = held.filter(F.size("_w") >= m).select("doc_id", F.explode(made).alias("_anchor")).join(anchors.filter(F.col("_n") == m), "_anchor").select("doc_id", "_n", "_anchor")
        pairs = some if pairs is None else pairs.unionByName(some)
    parts = []
    if pairs is not None:
        met = storage.few(pairs.join(asked, ["_n", "_anchor"]).select("doc_id", key).distinct(), "met")
        parts.append(documents.join(met, "doc_id").join(asked.select(F.col(key).alias("_key"), "passage"), F.col(key).eqNullSafe(F.col("_key"))).filter(F.contains("text", "passage")).select(key, "doc_id"))
    short = [r for r in sized.filter(F.size("_w") < 3).select(key, "passage").toLocalIterator()]
    for at in range(0, len(short), SHORT_PASSAGES):
        block = spark.createDataFrame(short[at : at + SHORT_PASSAGES], passages.select(key, "passage").schema)
        parts.append(documents.join(F.broadcast(block), F.contains("text", "passage")).select(key, "doc_id"))  # one block of given passages
    if not parts:
        return passages.select(key).crossJoin(documents.select("doc_id")).limit(0)
    return reduce(DataFrame.unionByName, parts).distinct()
