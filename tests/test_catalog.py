"""Queries against their SQL on the smallest tables, and the driver's entry points."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from corpusloom.plans import catalog, reports  # noqa: F401

SF = "/root/testdata/sf0.001"
SOME = [
    "line_chunks", "chunk_summary", "term_stats", "bm25_topk", "dense_topk", "query_forms", "query_variants", "rrf_fuse", "dedup_evidence", "merge_sections", "rerank_lexical", "citations",
    "verify_claims", "cited_numbers", "evaluate_answers", "rank_experiments", "experiment_grid", "format_readiness", "indexing_plan", "point_ids", "delete_documents", "run_progress", "event_spans",
    "event_sessions", "sliding_windows", "consensus", "readiness_scores",
    "recall_at_k", "direct_support", "context_budget", "citation_match", "evidence_match", "marker_resolve", "final_context_inclusion", "fallback_sufficient", "context_build", "compression_ratio", "section_lengths",
    "context_headers", "section_details", "question_traces", "ocr_summary", "agent_latency", "timing_table", "chart_totals", "agent_chain", "draft_preservation", "review_defaults", "evidence_records", "safe_names",
    "smoke_mode", "evaluation_join", "normalized_results", "table_rerank", "selection_diagnostics", "retrieval_diagnostics", "checked_dimension", "section_coverage", "corpus_fingerprint",
    "live_run_state", "event_throttle", "running_metrics", "incremental_postings", "incremental_terms", "corpus_tree_fingerprint", "resumed_batch", "token_codec", "token_budget_words", "experiment_aggregate", "experiment_records", "experiment_tradeoffs",
    "accuracy_heatmap", "run_report", "reranking_metrics", "critic_categories", "source_diversity", "risk_matrix", "evidence_modalities", "settled_questions", "gained_questions",
    "document_report", "variant_sections", "citation_quality", "detailed_prompts", "composed_prompts", "token_reduction", "event_times", "retrieval_modes", "simple_context", "expansion_roles", "context_token_budget", "collected_latencies", "outcome_counts",
]


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([round(v[i], 5) if isinstance(v[i], float) else v[i] for i in order]) for v in values)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = con.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
