"""Answers: gates, status, citations, claims and the extractive default generator."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import collapse

# Fixed values that results depend on.
CURRENT_MARKERS = r"(?i)\b(?:now|latest|current(?:ly)?|today(?:'s)?|tomorrow(?:'s)?|live|real[- ]?time)\b"
CURRENT_DOMAINS = (
    r"(?i)\b(?:weather|forecast)\b",
    r"(?i)\b(?:share|stock)\s+price\b",
    r"(?i)\bipl\b.*\b(?:score|match|fixture|result)\b",
    r"(?i)\b(?:score|match|fixture|result)\b.*\bipl\b",
    r"(?i)\bcafeteria\b.*\bmenu\b",
    r"(?i)\bmenu\b.*\bcafeteria\b",
    r"(?i)\bnetwork\s+topology\b",
)
INSUFFICIENT_MARKERS = (
    "insufficient evidence",
    "not available in the retrieved documents",
    "retrieved documents do not contain",
    "does not contain sufficient",
    "cannot be answered",
    "based only on the indexed corpus, no reliable answer",
)
STOP_WORDS = (
    "a", "an", "and", "are", "at", "be", "do", "does", "for", "from", "how", "in", "is", "it", "me", "of", "on", "please", "show", "tell", "the", "to", "what",
    "when", "which", "who", "will", "with", "now", "latest", "current", "currently", "today", "tomorrow", "live",
)
STATUS_LABELS = {
    "answered": "Answered",
    "insufficient_evidence": "Insufficient Evidence",
    "unsupported_query": "Unsupported Query",
    "current_data_required": "Unsupported Query",
    "generation_failed": "Generation Failed",
}


def requires_current_data(question: Column) -> Column:
    found = F.rlike(question, F.lit(CURRENT_MARKERS))
    for pattern in CURRENT_DOMAINS:
        found = found | F.rlike(question, F.lit(pattern))
    return found


def support_terms(question: Column) -> Column:
    """Distinct terms of a question that evidence has to mention."""
    words = F.regexp_extract_all(F.lower(question), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS)))


def directly_supported(question: Column, evidence: Column) -> Column:
    """At least two of the question's terms (all, if fewer) occur in the evidence; a question without terms has no support."""
    terms = support_terms(question)
    hits = F.size(F.filter(terms, lambda t: F.contains(F.lower(evidence), t)))
    return (F.size(terms) > 0) & (hits >= F.least(F.lit(2), F.size(terms)))


def currently_supported(question: Column, evidence: Column, sufficient: Column) -> Column:
    """Whether evidence answers a question about the present: sufficient, mentioning its terms, and itself about the present or such a domain."""
    return F.coalesce(sufficient, F.lit(False)) & directly_supported(question, evidence) & requires_current_data(F.lower(evidence))


def answer_status(answer: Column) -> Column:
    found = F.lit(False)
    for marker in INSUFFICIENT_MARKERS:
        found = found | F.contains(F.lower(answer), F.lit(marker))
    return F.when(found, "insufficient_evidence").otherwise("answered")


def status_label(status: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(labels, status), F.initcap(F.replace(status, F.lit("_"), F.lit(" "))))


def final_status(unsupported: Column, weak: Column, refused: Column, fallback: Column, status: Column) -> Column:
    """First that holds: unsupported query, weak evidence with an answer, weak refusal, extractive fallback, the answer's own status."""
    return (
        F.when(unsupported, "unsupported_query")
        .when(weak & ~refused, "answered_with_caution")
        .when(weak & refused, "insufficient_evidence")
        .when(refused & fallback, "answered_extractive")
        .otherwise(status)
    )


def citations(evidence: DataFrame) -> DataFrame:
    """(query_id, citation, reference): numbered references of (query_id, rank, source, page, chunk_id, score)."""
    line = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.concat_ws(
            " | ", F.element_at(F.split("source", "/"), -1),
            F.when(F.coalesce(F.col("page").cast("string"), F.lit("")) != "", F.concat(F.lit("page "), F.col("page").cast("string"))),
            F.concat(F.lit("chunk "), F.col("chunk_id")),
            F.when(F.col("score").isNotNull(), F.concat(F.lit("score "), F.format_string("%.4f", F.bround("score", 4)))),
        )
    )
    return evidence.select("query_id", F.col("rank").cast("long").alias("citation"), line.alias("reference"))


def reference_list(cited: DataFrame) -> DataFrame:
    """(query_id, references): the references of a question, one a line, in order."""
    held = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("citation", "reference"))).alias("all"))
    return held.select("query_id", F.array_join("all.reference", "\n").alias("references"))


def cited_numbers(answer: Column, known: Column) -> Column:
    """Numbers of the citations that an answer gives, in order of their first use, as far as they are known; all known ones if none is."""
    used = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("long")))
    valid = F.filter(used, lambda x: F.array_contains(known, x))
    return F.when(F.size(valid) == 0, known).otherwise(valid)


def claims(answers: DataFrame) -> DataFrame:
    """(answer_id, claim_order, claim, references): sentences of four words and more of (answer_id, text)."""
    parts = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x)), lambda x: F.size(F.split(x, r"\s+")) >= 4)
    refs = F.transform(F.regexp_extract_all("claim", F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("long"))
    return answers.select("answer_id", F.posexplode(parts).alias("claim_order", "claim")).withColumn("references", refs)


def verify_claims(answers: DataFrame, evidence_count: Column | int) -> DataFrame:
    """(answer_id, claims, verified, unsupported, mismatched, rate, passed): a claim with a number outside 1..n is a mismatch."""
    n = F.lit(evidence_count) if isinstance(evidence_count, int) else evidence_count
    kind = F.when(F.exists("references", lambda r: (r < 1) | (r > n)), "mismatched").when(F.size("references") > 0, "verified").otherwise("unsupported")
    found = claims(answers).withColumn("kind", kind)
    out = answers.select("answer_id").distinct().join(found, "answer_id", "left").groupBy("answer_id").agg(
        F.count("claim").alias("claims"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("verified", "unsupported", "mismatched")]
    )
    rate = F.coalesce(F.round(F.try_divide("verified", "claims"), 4), F.lit(0.0))
    return out.withColumn("rate", rate).withColumn("passed", (F.col("claims") > 0) & (F.col("verified") == F.col("claims")))


def extractive_answer(selected: DataFrame, pieces: int = 3, most: int = 500) -> DataFrame:
    """(query_id, answer): the first texts of the selected evidence, shortened, each with its number."""
    held = selected.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("all"))
    lines = F.transform(F.slice("all", 1, pieces), lambda x, i: F.concat(F.left(collapse(x["text"]), F.lit(most)), F.lit(" ["), (i + 1).cast("string"), F.lit("]")))
    return held.select("query_id", F.array_join(lines, "\n").alias("answer"))


def prompts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """(query_id, prompt): the question and its context under our own instruction; questions without context have none."""
    text = F.concat(F.lit("Answer from the numbered evidence only and cite it as [n].\n\nEvidence:\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("question"))
    return questions.join(contexts, "query_id", "left").select("query_id", F.when(F.coalesce("context", F.lit("")) != "", text).alias("prompt"))


#: What an answer is made of, by words of its question; the first that fits. Our own.
SHAPES = (
    (r"\b(compare|difference|differences|versus|vs)\b", "a comparison, the main differences and a recommendation"),
    (r"\b(steps|procedure|process)\b", "numbered steps, who owns them and what they depend on"),
    (r"\b(risk|risks|threat|threats)\b", "the main risks, their effect and controls"),
    (r"\b(should we|prioriti[sz]e)\b", "recommended actions in order, each with its reason"),
    (r"\b(what is|define|explain)\b", "a short overview and the key concepts"),
)


def detailed_prompts(questions: DataFrame, contexts: DataFrame, shapes: Sequence[tuple[str, str]] = SHAPES, least_words: int | None = None, most_words: int | None = None) -> DataFrame:
    """(query_id, prompt): as ``prompts``, asking for a structured answer of a length, and for caution where the evidence is weak.

    ``contexts`` has (query_id, context, weak_evidence). The shape is that of the first pattern the question holds, else a direct answer with findings; the least
    number of words never exceeds the most. Questions without context have no prompt.
    """
    text = F.lower(F.col("question"))
    shape = F.coalesce(*[F.when(F.regexp_like(text, F.lit(pattern)), F.lit(s)) for pattern, s in shapes], F.lit("a direct answer and the findings behind it"))
    low = least_words if most_words is None or least_words is None else min(least_words, most_words)
    length = " ".join(x for x in (f"Write at least {low} words if the evidence carries them." if low else "", f"Write at most {most_words} words." if most_words else "") if x)
    rules = ["Use the selected evidence only, and cite every claim and recommendation as [n].", "Say why each recommendation matters, and name what the evidence leaves open.", length]
    caution = F.when(F.coalesce("weak_evidence", F.lit(False)), F.lit("\nAll of this evidence is weak: say so first, and advise a check of the sources.")).otherwise(F.lit(""))
    prompt = F.concat(F.lit("\n".join(r for r in rules if r) + "\nGive "), shape, F.lit("."), caution, F.lit("\n\nSelected evidence:\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("question"))
    return questions.join(contexts, "query_id", "left").select("query_id", F.when(F.coalesce("context", F.lit("")) != "", prompt).alias("prompt"))


def composed_prompts(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, prompt, evidence_count): status, question, plan and quality of a run, and its evidence as JSON with reference ids in order of rank.

    ``runs`` has (query_id, question, status, plan, quality), the last two as JSON or null; ``evidence`` has (query_id, rank, chunk_id, source, text, score), a capped list
    for each question. A run without evidence has an empty list.
    """
    records = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "source", "score", "text"))), lambda x, i: F.struct((i + 1).alias("reference_id"), x["chunk_id"].alias("chunk_id"), x["source"].alias("source"), x["score"].alias("score"), x["text"].alias("content")))
    held = evidence.groupBy("query_id").agg(records.alias("_all"))
    out = runs.join(held, "query_id", "left")
    shown = lambda title, c: F.concat(F.lit(f"\n\n{title}:\n"), c)
    prompt = F.concat(
        F.lit("Use the evidence below only and cite it as [n]. Keep what tables, figures and scans show. A status of unsupported_query or insufficient_evidence stands: don't force an answer."),
        shown("Status", F.coalesce("status", F.lit("unknown"))), shown("Question", F.col("question")), shown("Plan", F.coalesce("plan", F.lit("{}"))), shown("Quality", F.coalesce("quality", F.lit("{}"))),
        shown("Evidence", F.coalesce(F.to_json("_all"), F.lit("[]"))),
    )
    return out.select("query_id", prompt.alias("prompt"), F.coalesce(F.size("_all"), F.lit(0)).cast("long").alias("evidence_count"))


def generate(prompted: DataFrame, model: Callable[[str], str], attempts: int = 3) -> DataFrame:
    """(query_id, answer, failed): a model on each executor; a call that raises is tried again, retrieval never is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for query_id, prompt in zip(batch["query_id"], batch["prompt"], strict=True):
                answer, failed = None, bool(prompt)
                for _ in range(attempts if prompt else 0):
                    try:
                        answer, failed = model(prompt), False
                        break
                    except Exception:  # a model's own error of any kind
                        continue
                rows.append((query_id, answer, failed))
            yield pd.DataFrame(rows, columns=["query_id", "answer", "failed"])

    kind = prompted.schema["query_id"].dataType.simpleString()
    return prompted.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, answer string, failed boolean")
