"""Review rules over one row per run and question: consensus, recommendation, readiness."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import clamp

PRESERVED = ("unsupported_query", "insufficient_evidence", "generation_failed")


def _high(c: Column) -> Column:
    return F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda s: F.lower(s) == "high")


def consensus(rows: DataFrame) -> DataFrame:
    """Adds decision, final_status and revision_allowed to (status, critic_passed, compliance_passed, risk_passed, risk_level, verification_passed, unsupported_severities)."""
    kept = F.col("status").isin(*PRESERVED)
    risky = F.lower(F.coalesce("risk_level", F.lit(""))) == "high"
    fine = [F.coalesce(c, F.lit(False)) for c in ("critic_passed", "compliance_passed", "risk_passed", "verification_passed")]
    rejected = (risky & _high(F.col("unsupported_severities"))) | (risky & ~fine[1])
    decision = F.when(kept | rejected, "reject").when(~(fine[0] & fine[1] & fine[2] & fine[3]), "revise_once").otherwise("accept")
    return (
        rows.withColumn("decision", decision)
        .withColumn("final_status", F.when(kept, F.col("status")).when(rejected, "rejected").otherwise("answered"))
        .withColumn("revision_allowed", F.col("decision") == "revise_once")
    )


def recommendation(rows: DataFrame) -> DataFrame:
    """Adds label and kind; (final_status, decision, verification_rate, risk_level, unsupported_severities)."""
    ready = (F.col("decision") == "accept") & (F.coalesce("verification_rate", F.lit(0.0)) >= 0.85) & (F.lower(F.coalesce("risk_level", F.lit(""))) != "high")
    kind = (
        F.when(F.col("final_status") == "insufficient_evidence", "insufficient").when(F.col("final_status") == "unsupported_query", "unsupported")
        .when((F.col("decision") == "reject") | (F.col("final_status") == "rejected"), "rejected").when(ready, "ready").otherwise("caution")
    )
    labels = {"insufficient": "Insufficient evidence", "unsupported": "Unsupported query", "rejected": "Rejected by validation", "ready": "Ready for decision", "caution": "Usable with caution"}
    return rows.withColumn("kind", kind).withColumn("label", F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col("kind")))


def readiness(rows: DataFrame) -> DataFrame:
    """Adds readiness (0 to 100) from (evidence_scores, compliance_passed, risk_level, verification_rate, severity, decision)."""
    def points(c: str, default: float, fallback: str, **values: float) -> Column:
        out = F.lit(default)
        for k, v in values.items():
            out = F.when(F.coalesce(c, F.lit(fallback)) == k, F.lit(v)).otherwise(out)
        return out

    n = F.size(F.coalesce("evidence_scores", F.array().cast("array<double>")))
    mean = F.aggregate("evidence_scores", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / n
    sufficiency = F.least(F.lit(1.0), n / 3) * F.when(n > 0, clamp(mean)).otherwise(0.5)
    total = (
        sufficiency * 0.2 + F.coalesce("compliance_passed", F.lit(False)).cast("int") * 0.2 + points("risk_level", 0.3, "high", low=1.0, medium=0.6, high=0.0) * 0.15
        + F.coalesce("verification_rate", F.lit(0.0)) * 0.25 + points("severity", 0.3, "high", low=1.0, medium=0.55, high=0.0) * 0.1
        + points("decision", 0.0, "", accept=1.0, revise_once=0.5, reject=0.0) * 0.1
    )
    return rows.withColumn("readiness", F.round(F.round(clamp(total) * 100, 9)).cast("long"))


def recovered_json(c: Column) -> Column:
    """The JSON object in a model's text: the text itself, a fenced block, or what stands between the outermost braces; null if none parses."""
    def parsed(x: Column) -> Column:
        v = F.try_parse_json(x)
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.to_json(v))
    fenced = F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(parsed(c), parsed(fenced), parsed(braces))


def section_coverage(answers: DataFrame) -> DataFrame:
    """(answer_id, section, citations, sentences, coverage): citations per sentence of four words and more under each heading."""
    sections = F.split("text", r"(?m)^#+\s+")
    rows = answers.select("answer_id", F.posexplode(sections).alias("section", "body")).filter("trim(body) != ''")
    sentences = F.size(F.filter(F.split("body", r"(?<=[.!?])\s+|\n+"), lambda x: F.size(F.split(F.trim(x), r"\s+")) >= 4))
    cites = F.size(F.regexp_extract_all("body", F.lit(r"\[(\d+)\]"), F.lit(1)))
    share = cites / F.greatest(sentences, F.lit(1))
    return rows.select(
        "answer_id", F.col("section").cast("long").alias("section"), cites.cast("long").alias("citations"), sentences.cast("long").alias("sentences"),
        F.when(share >= 0.8, "dense").when(cites > 0, "weak").otherwise("uncited").alias("coverage"),
    )


def evidence_metrics(evidence: DataFrame) -> DataFrame:
    """(query_id, evidence_count, sufficiency, sources) from (query_id, source, score); without scores a third for each row."""
    n = F.count("*")
    return evidence.groupBy("query_id").agg(
        n.alias("evidence_count"), F.round(clamp(F.coalesce(F.avg("score"), n / 3)), 6).alias("sufficiency"), F.countDistinct("source").alias("sources")
    )


def agent_chain(rows: DataFrame, revise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``consensus`` with one revision: rows that may be revised go through ``revise`` and are judged once more; adds ``revised``.

    ``revise`` takes and returns rows with the columns of ``rows``. What the second pass decides stands, whatever it is.
    """
    first = consensus(rows)
    again = consensus(revise(first.filter("revision_allowed").select(*rows.columns)).select(*rows.columns))
    return first.filter(~F.col("revision_allowed")).withColumn("revised", F.lit(False)).unionByName(again.withColumn("revised", F.lit(True)))


def preserved_draft(status: Column, draft: Column) -> Column:
    """The answer of a status that generation must not touch: the draft, or a sentence of ours; null for all other statuses."""
    texts = {
        "unsupported_query": "The indexed documents don't cover this question.",
        "insufficient_evidence": "The evidence found isn't enough for an answer.",
        "generation_failed": "No answer could be generated.",
    }
    default = F.try_element_at(F.create_map(*[F.lit(x) for kv in texts.items() for x in kv]), status)
    return F.when(status.isin(*PRESERVED), F.coalesce(F.nullif(draft, F.lit("")), default))


def review_defaults(reviews: DataFrame) -> DataFrame:
    """Fills what reviewers left out of (critic_passed, severity, risk_passed, risk_level, verification_passed, grounding_score, revision_required).

    Nothing said is not passed and medium; a grounding score lies between 0 and 1; without a word on it, what didn't pass needs a revision.
    """
    passed = {c: F.coalesce(c, F.lit(False)) for c in ("critic_passed", "risk_passed", "verification_passed")}
    level = {c: F.coalesce(c, F.lit("medium")) for c in ("severity", "risk_level")}
    return reviews.withColumns({
        **passed, **level, "grounding_score": clamp(F.coalesce(F.col("grounding_score").cast("double"), F.lit(0.0))),
        "revision_required": F.coalesce("revision_required", ~F.coalesce("verification_passed", F.lit(False))),
    })


def evidence_records(rows: DataFrame) -> DataFrame:
    """(evidence_id, source, page, chunk_id, text, score, box): evidence of any retriever in one shape.

    Takes whatever of (evidence_id, source_file, source, page_number, page, chunk_id, text, page_content, reranker_score, score, bbox) there is; blank
    counts as missing. The id is composed of source, page and chunk where none is given; a box has four numbers or is null.
    """
    def first(*names: str, kind: str = "string") -> Column:
        found = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in rows.columns]
        return F.coalesce(*found, F.lit(None)).try_cast(kind)

    source, page, chunk = first("source_file", "source"), first("page_number", "page"), first("chunk_id")
    composed = F.concat_ws(":", F.coalesce(source, F.lit("unknown")), F.coalesce(page, F.lit("")), F.coalesce(chunk, F.lit("")))
    box = F.col("bbox").cast("array<double>") if "bbox" in rows.columns else F.lit(None).cast("array<double>")
    return rows.select(
        F.coalesce(first("evidence_id"), composed).alias("evidence_id"), source.alias("source"), page.alias("page"), chunk.alias("chunk_id"),
        F.coalesce(first("text", "page_content"), F.lit("")).alias("text"), first("reranker_score", "score", kind="double").alias("score"),
        F.when((F.size(box) == 4) & F.forall(box, lambda x: x.isNotNull()), box).alias("box"),
    )


def agent_latency(events: DataFrame, agents: DataFrame) -> DataFrame:
    """(agent, milliseconds, runs): the time of each agent of (agent) over the trace events (agent, latency_ms), revisions included; 0 without events."""
    spent = events.groupBy("agent").agg(F.sum("latency_ms").alias("spent"), F.count("*").alias("runs"))
    out = agents.select("agent").join(spent, "agent", "left")
    return out.select("agent", F.round(F.coalesce("spent", F.lit(0.0)), 2).alias("milliseconds"), F.coalesce("runs", F.lit(0)).cast("long").alias("runs"))


# Fixed values that results depend on: what in an issue's text speaks for a category.
CRITIC_CATEGORIES = {
    "Completeness": ("complete", "missing section"),
    "Structure": ("structure", "organization"),
    "Missing caveats": ("caveat",),
    "Repetition": ("repeat",),
    "Weak reasoning": ("reason", "priorit"),
    "Unanswered parts": ("unanswered", "not answer"),
}
RISK_CATEGORIES = ("operational", "cybersecurity", "aviation safety", "governance", "compliance")


def critic_categories(issues: DataFrame, categories: Mapping[str, Sequence[str]] = CRITIC_CATEGORIES) -> DataFrame:
    """(category, issues): how many issues name a term of each category, 0 included. ``issues`` has (issue); an issue counts in every category it speaks for, null in none."""
    text = F.lower(F.coalesce("issue", F.lit("")))
    counts = issues.agg(*[F.count_if(reduce(or_, [F.contains(text, F.lit(t)) for t in terms])).alias(f"_{i}") for i, terms in enumerate(categories.values())])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"_{i}").alias("issues")) for i, c in enumerate(categories)])).alias("x")).select("x.*")


def source_diversity(evidence: DataFrame, dimensions: Sequence[str], most: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """(by..., dimension, value, rows, place): the ``most`` values with most rows of each dimension, in one pass over the evidence; null and empty are "unknown", ties go to the smaller value."""
    named = evidence.select(*by, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.nullif(F.col(d).cast("string"), F.lit("")), F.lit("unknown")).alias("value")) for d in dimensions])).alias("x")).select(*by, "x.*")
    counts = named.groupBy(*by, "dimension", "value").agg(F.count("*").alias("rows"))
    place = F.row_number().over(W.partitionBy(*by, "dimension").orderBy(F.desc("rows"), "value"))
    return counts.withColumn("place", place).filter(F.col("place") <= most)


def risk_matrix(risks: DataFrame, by: str, categories: Sequence[str] = RISK_CATEGORIES) -> DataFrame:
    """(by, category, severity, likelihood, mitigation): the last risk (by ordinal) of each known category, for each ``by`` that has any risk.

    Categories are compared without case, an underscore as a blank; those without a risk are "not assessed" and "not specified", as are null cells. All categories are taken in one aggregate.
    """
    name = F.lower(F.replace("category", F.lit("_"), F.lit(" ")))
    last = risks.groupBy(by).agg(*[F.max_by(F.when(name == c, F.struct("severity", "likelihood", "mitigation")), F.when(name == c, F.col("ordinal"))).alias(f"_{i}") for i, c in enumerate(categories)])
    none = {"severity": "not assessed", "likelihood": "not assessed", "mitigation": "not specified"}
    cells = [F.struct(F.lit(c).alias("category"), *[F.coalesce(F.col(f"_{i}.{k}"), F.lit(v)).alias(k) for k, v in none.items()]) for i, c in enumerate(categories)]
    return last.select(by, F.explode(F.array(*cells)).alias("x")).select(by, "x.*")


def modality_counts(evidence: DataFrame, modalities: Sequence[str]) -> DataFrame:
    """(query_id, evidence_count, sufficiency, sources, one column for each modality) from (query_id, source, score, modality); null is text. As ``evidence_metrics``, with the counts of its modalities."""
    kind = F.lower(F.coalesce(F.nullif("modality", F.lit("")), F.lit("text")))
    counts = evidence.groupBy("query_id").agg(*[F.count_if(kind == m).alias(m) for m in modalities])
    return evidence_metrics(evidence).join(counts, "query_id")
