"""Query variants: rewritten, expanded and reformulated forms of each question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import collapse, fold

# Fixed values that results depend on.
POLITE = r"(?i)^(?:please\s+|could you\s+|can you\s+|would you\s+|i want to know\s+)+"
LEAD = r"(?i)^(?:tell me|explain)\s+(?:about\s+)?"
GLOSSARY = {
    "runway": ("airside", "surface inspection", "FOD", "ATC clearance"),
    "queue": ("passenger flow", "terminal operations", "holding area"),
    "electrical": ("energized panel", "PPE", "lockout-tagout", "LOTO"),
    "cyber": ("information security", "controls", "risk", "incident response"),
    "maintenance": ("inspection", "preventive maintenance", "SOP"),
    "safety": ("hazard", "control measure", "PPE", "emergency procedure"),
}
DOMAIN_LEAD = "policy, SOP, manual, controls, responsibilities, and required actions"


def rewritten(q: Column) -> Column:
    """Without conversational framing and closing punctuation, first letter upper case; the question itself if nothing is left."""
    body = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(collapse(q), POLITE, ""), LEAD, "")), r"[ ?.!]+$", "")
    return F.when(body == "", collapse(q)).otherwise(F.concat(F.upper(F.left(body, F.lit(1))), F.substr(body, F.lit(2))))


def expanded(q: Column, glossary: dict[str, tuple[str, ...]] = GLOSSARY) -> Column:
    """With the related terms of each glossary term it holds, as far as it doesn't hold them already."""
    text = collapse(q)
    low = fold(text)
    related = F.flatten(F.array(*[F.when(F.contains(low, F.lit(term)), F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>")) for term, words in glossary.items()]))
    new = F.array_distinct(F.filter(related, lambda x: ~F.contains(low, F.lower(x))))
    return F.when(F.size(new) == 0, text).otherwise(F.concat(text, F.lit(" | Related terms: "), F.array_join(new, ", ")))


def reformulated(q: Column, domain: str = "Corpus") -> Column:
    return F.concat(F.lit(f"{domain} {DOMAIN_LEAD}: "), rewritten(q))


#: technique -> form; further ones may be added.
STRATEGIES = {"original": collapse, "rewritten": rewritten, "keyword_expanded": expanded, "domain_reformulation": reformulated}


def query_variants(questions: DataFrame, techniques: tuple[str, ...] = tuple(STRATEGIES), limit: int = 4) -> DataFrame:
    """(query_id, variant_order, technique, query): the first of caselessly equal forms, at most ``limit`` of them."""
    forms = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("technique"), STRATEGIES[t](F.col("question")).alias("query")) for i, t in enumerate(techniques)])
    rows = questions.filter(collapse(F.col("question")) != "").select("query_id", F.explode(forms).alias("v")).select("query_id", "v.*")
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("query_id", fold(F.col("query"))).orderBy("i"))).filter("n = 1")
    order = F.row_number().over(W.partitionBy("query_id").orderBy("i"))
    return first.withColumn("variant_order", order.cast("long")).filter(F.col("variant_order") <= limit).select("query_id", "variant_order", "technique", "query")


def changed_from_original(variants: DataFrame) -> DataFrame:
    """Adds ``changed``: whether a variant differs from its question's first one in more than case."""
    first = F.first(fold(F.col("query"))).over(W.partitionBy("query_id").orderBy("variant_order"))
    return variants.withColumn("changed", fold(F.col("query")) != first)
