"""Operators on small tables with expected values worked out by hand or by a few lines of Python."""

import math
import re
import uuid
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import answers, chunks, context, dense, evaluation, evidence, formats, fusion, incremental, lexical, reviews, tables, variants


def column(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


def test_tokens_equal_python(spark):
    texts = ["Straße isn't well-known", "ÉTÉ 12-34 a_b --", "", "naïve café's 日本語 x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.word_tokens(F.col("t")).alias("w"), X.term_set(F.col("t")).alias("s")).collect()
    for r in rows:
        assert r.w == re.findall(r"[\w]+(?:[-'][\w]+)*", r.t.casefold())
        assert r.s == list(dict.fromkeys(re.findall(r"\b[\w-]+\b", r.t.casefold())))


def test_uuid5(spark):
    for name in ("a|b", "", "ünï"):
        assert column(spark, X.uuid5_url, name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_small_functions(spark):
    assert column(spark, X.collapse, "  a\t\n b c ") == "a b c"
    assert column(spark, X.listed, " a, ,b ,") == ["a", "b"]
    assert [column(spark, X.truth, v) for v in ("yes", "0", "", None)] == [True, False, True, True]
    assert column(spark, X.suffix, "a/b.tar.GZ") == "gz" and column(spark, X.suffix, ".env") == ""
    assert column(spark, lambda c: X.preview(c, 5), "abcdefg") == "abcd…"
    assert column(spark, X.stable_json, {"b": 1, "a": 2}, "map<string,int>") == '{"a":2,"b":1}'


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=300), st.integers(20, 60))
def test_splitter_properties(text, size):
    out = chunks.split_text(text, size, 10)
    assert all(len(c) <= size and text[at : at + len(c)] == c for at, c in out)
    assert [at for at, _ in out] == sorted(at for at, _ in out)
    covered = {i for at, c in out for i in range(at, at + len(c))}
    assert all(text[i].isspace() or i in covered for i in range(len(text)))


def test_bm25_equals_the_formula(spark):
    corpus = {"a": "red red fox", "b": "red dog", "c": "blue fox jumps far", "d": "red"}
    got = lexical.bm25_topk(spark.createDataFrame([(1, "red fox fox zebra")], "query_id int, query string"), spark.createDataFrame(list(corpus.items()), "chunk_id string, text string"), 10).collect()
    docs = {k: v.split() for k, v in corpus.items()}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    raw = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if r < 0 else r for w, r in raw.items()}
    want = {}
    for k, d in docs.items():
        s = sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for w in "red fox fox zebra".split())
        if round(s, 6) > 0:
            want[k] = round(s, 6)
    assert {r.chunk_id: r.score for r in got} == pytest.approx(want)
    assert [r.chunk_id for r in sorted(got, key=lambda r: r["rank"])] == sorted(want, key=lambda k: (-want[k], k))


def test_dense(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    p = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0])], "point_id long, vector array<float>")
    assert [(r.point_id, r.score) for r in dense.dense_topk(q, p, 3).orderBy("rank").collect()] == [(1, 1.0), (3, 1.0), (2, 0.0)]


def test_rewriting(spark):
    assert column(spark, variants.rewritten, " Please could you  tell me about the runway?! ") == "The runway"
    assert column(spark, variants.rewritten, "please ") == "Please" or column(spark, variants.rewritten, "???") == "???"
    assert column(spark, variants.expanded, "Safety and PPE") == "Safety and PPE | Related terms: hazard, control measure, emergency procedure"
    q = spark.createDataFrame([(1, "Runway lights?"), (2, "  ")], "query_id int, question string")
    assert [r.technique for r in variants.query_variants(q).orderBy("variant_order").collect()] == ["original", "rewritten", "keyword_expanded", "domain_reformulation"]
    same = spark.createDataFrame([(1, "Lights")], "query_id int, question string")
    assert [r.technique for r in variants.query_variants(same).orderBy("variant_order").collect()] == ["original", "domain_reformulation"]


def test_rrf_tie_goes_to_the_first_seen(spark):
    rows = [(1, "dense", 0, 1, "1"), (1, "dense", 0, 2, "2"), (1, "bm25", 1, 1, "2"), (1, "bm25", 1, 2, "1")]
    got = fusion.rrf_fuse(spark.createDataFrame(rows, "query_id int, retriever string, retriever_order int, rank int, chunk_id string"), k=10).orderBy("fused_rank").collect()
    assert [r.chunk_id for r in got] == ["1", "2"] and got[0].sources == ["dense", "bm25"]
    assert got[0].rrf_score == got[1].rrf_score == round(1 / 11 + 1 / 12, 9)


def test_deduplication(spark):
    rows = [(1, f"c{i}", s + i / 1000, t, p * 100 + i) for p, (t, s) in enumerate((("original", 0.4), ("rewritten", 0.8))) for i in range(50)]
    rows += [(1, None, 0.1, "original", 900), (1, None, None, "original", 901)]
    got = fusion.deduplicate(spark.createDataFrame(rows, "query_id int, chunk_id string, score double, technique string, pos int")).orderBy("place").collect()
    assert len(got) == 52 and got[0].chunk_id == "c49" and got[0].matched_queries == ["original", "rewritten"]
    assert all(r.score >= 0.8 for r in got[:50]) and got[-1].score is None


CHUNKS = [("f", i, f"f:c{i}", f"text {i}") for i in range(4)]


@pytest.mark.parametrize("seed,window,want", [(0, 1, [0, 1]), (3, 1, [2, 3]), (2, 0, [2]), (99, 1, [99]), (1, 2, [0, 1, 2, 3])])
def test_neighbours(spark, seed, window, want):
    corpus = spark.createDataFrame(CHUNKS, "source string, chunk_index int, chunk_id string, text string")
    seeds = spark.createDataFrame([(1, "f", seed, f"f:c{seed}", "t", 0.5, 1)], "query_id int, source string, chunk_index int, chunk_id string, text string, score double, place int")
    out = context.neighbor_expand(seeds, corpus, window).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in out] == want and all(r.score == 0.5 for r in out)


def test_sections_break_on_equal_and_missing_indexes(spark):
    rows = [(1, "f", i, f"c{n}", t, 0.1 * n) for n, (i, t) in enumerate([(4, "a b c"), (4, "x"), (6, "y"), (None, "n1"), (None, "n2"), (1, "one two"), (2, "two three")])]
    out = context.merge_overlapping(spark.createDataFrame(rows, "query_id int, source string, chunk_index int, chunk_id string, text string, score double"))
    got = {tuple(r.chunk_ids): r.text for r in out.collect()}
    assert got == {("c0",): "a b c", ("c1",): "x", ("c2",): "y", ("c3",): "n1", ("c4",): "n2", ("c5", "c6"): "one two three"}


@pytest.mark.parametrize("budget", [40, 80, 100, 200, 5000])
def test_budget_is_kept(spark, budget):
    rows = [(1, i, f"s/{i}", f"c{i}", "word " * (5 * i), 0.5) for i in range(1, 8)]
    sections = spark.createDataFrame(rows, "query_id int, section long, source string, chunk string, text string, score double")
    blocks = context.compress(sections, budget)
    got = context.contexts(blocks).first()
    assert got is None or len(got.context) <= budget
    used, want = 0, 0
    for r in rows:
        head = f"[{r[1]}] {r[2]} | chunk {r[3]} | score 0.500\n"
        room = budget - used - len(head)
        if room <= 0:
            break
        body = r[4] if len(r[4]) <= room else r[4][:room].rstrip()
        used, want = used + len(head) + len(body) + 2, want + 1
        if used >= budget:
            break
    assert (got.sections if got else 0) == want


def test_token_budget_with_one_token_a_character(spark):
    rows = [(1, i, "abcdefghij") for i in range(1, 5)]
    got = context.compress_tokens(spark.createDataFrame(rows, "query_id int, section long, block string"), 30, len).first()
    assert (got.context, got.used, got.truncated_sections, got.omitted_sections) == ("abcdefghij\n\nabcdefghij\n\nabcdef", 30, 1, 1)


def pool(rows):
    return rows, "query_id int, rank int, chunk_id string, source string, text string, score double"


def test_selection_reasons(spark):
    rows = [(1, 1, "a", "A", "alpha beta gamma", 0.95), (1, 2, "b", "B", "alpha beta gamma", 0.9), (1, 3, "c", "A", "other words", 0.85), (1, 4, "d", "D", "weak text", 0.1), (1, 5, "e", "E", "long evidence text", 0.8)]
    out = evidence.select_evidence(spark.createDataFrame(*pool(rows)), threshold=0.5, budget=28, most=3, least=0, per_source=1, redundancy=0.8, target=(0, 0), count=F.length).collect()
    got = {r.chunk_id: r.selection_reason or r.discard_reason for r in out}
    assert got == {"a": "threshold_pass", "b": "redundancy", "c": "source_diversity_limit", "d": "threshold_failed", "e": "token_budget"}


def test_selection_cap_floor_and_empty(spark):
    rows = [(1, i, f"c{i}", f"s{i}", f"text number {i} " * 20, 0.9) for i in range(1, 5)]
    capped = evidence.select_evidence(spark.createDataFrame(*pool(rows)), most=2, least=0, target=(0, 0), strategies=("top_k",)).collect()
    assert [r.selected for r in sorted(capped, key=lambda r: r["rank"])] == [True, True, False, False] and capped[3].discard_reason == "lower_rank_fallback"
    weak = [(1, i, f"c{i}", f"s{i}", " ".join(f"w{i}x{j}" for j in range(200)), 0.01) for i in range(1, 6)]
    filled = [r for r in evidence.select_evidence(spark.createDataFrame(*pool(weak)), threshold=0.5, least=3, target=(500, 900)).collect() if r.selected]
    assert len(filled) >= 3 and 500 <= sum(r.evidence_token_count for r in filled) <= 900 and {r.selection_reason for r in filled} == {"adaptive_fallback"}
    none = evidence.select_evidence(spark.createDataFrame(*pool([(1, 1, "a", "A", "  ", 0.9)]))).collect()
    assert not none[0].selected and none[0].discard_reason == "empty_text" and not none[0].weak_evidence


def test_selection_near_the_token_target_and_repeated_rows(spark):
    long = [(1, i, f"c{i}", f"s{i}", " ".join(f"w{i}x{j}" for j in range(51)), 0.9) for i in range(1, 4)]
    out = {r.chunk_id: r for r in evidence.select_evidence(spark.createDataFrame(*pool(long)), threshold=0.5, least=1, budget=1000, target=(60, 100)).collect()}
    assert [out[f"c{i}"].selected for i in (1, 2, 3)] == [True, False, False] and {out[c].discard_reason for c in ("c2", "c3")} == {"token_budget"}
    twice = [(1, 1, "a", "A", "alpha beta", 0.01), (1, 2, "a", "A", "alpha beta", 0.01)]
    rows = evidence.select_evidence(spark.createDataFrame(*pool(twice)), threshold=0.0, least=2).collect()
    assert all(r.selected and r.weak_evidence for r in rows) and [r.selection_reason for r in sorted(rows, key=lambda r: r["rank"])] == ["threshold_pass", "adaptive_fallback"]


def test_change_capture(spark):
    def f(rows):
        return spark.createDataFrame(rows, "relative_path string, sha256 string")

    old, new = f([("first.pdf", "1"), ("deleted.pdf", "2"), ("same.pdf", "3")]), f([("first.pdf", "9"), ("new.pdf", "4"), ("same.pdf", "3")])
    assert {tuple(r) for r in incremental.indexing_plan(old, new).collect()} == {("first.pdf", "changed"), ("deleted.pdf", "deleted"), ("new.pdf", "new"), ("same.pdf", "unchanged")}
    assert Counter(r.change_type for r in incremental.indexing_plan(old, new, rebuild=True).collect()) == {"new": 3, "deleted": 3}


def test_completed_needs_a_row(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "key string, ordinal int, row string")
    assert incremental.completed(spark.createDataFrame([("a",)], "key string"), rows).first().row == "y"
    with pytest.raises(Exception, match="no row for completed key b"):
        incremental.completed(spark.createDataFrame([("b",)], "key string"), rows).collect()


def test_formats(spark):
    paths = [("a/b.PDF",), ("x.png",), ("y.zip",), ("z.unknown",), ("d/Dockerfile",), ("package.json",), ("k.json",)]
    got = {r.path: (r.status, r.action) for r in formats.lookup(spark.createDataFrame(paths, "path string")).collect()}
    assert got["a/b.PDF"] == ("supported_now", "process") and got["x.png"][1] == "ocr_then_process" and got["y.zip"][1] == "skip_with_warning"
    assert got["z.unknown"] == ("unsupported", "reject") and got["d/Dockerfile"][0] == got["package.json"][0] == "recognized_future_support" and got["k.json"][1] == "process"


def test_evaluation(spark):
    rows = [("Runway checks [1] [2]", "answered", ["runway", "checks"], [], True), ("insufficient evidence", "answered", [], ["x"], False), ("made up", "answered", [], [], False), ("", "answered", [], [], True), (None, "Insufficient Evidence", ["a"], [], False)]
    out = evaluation.evaluate_answers(spark.createDataFrame(rows, "answer string, answer_status string, expected_keywords array<string>, forbidden_keywords array<string>, should_answer boolean")).collect()
    assert [(r.passed, r.hallucinated) for r in out] == [(True, False), (True, False), (False, True), (False, False), (True, False)]
    assert out[0].keyword_score == 1.0 and out[0].citation_count == 2


def test_grid_and_ranking(spark):
    grid = evaluation.experiment_grid(spark, {"k": [1, 2], "expand": [True, False, True]}).orderBy("experiment_id").collect()
    assert [(r.experiment_id, r.k, r.expand) for r in grid][:4] == [("exp_001", 1, True), ("exp_002", 1, False), ("exp_003", 1, True), ("exp_004", 2, True)]
    with pytest.raises(ValueError):
        evaluation.experiment_grid(spark, {"k": []})
    rows = [("a", 0.5, 1.0, 0.0, 2.0), ("b", 0.9, 0.5, 0.1, 4.0)]
    ranked = evaluation.rank_experiments(spark.createDataFrame(rows, "experiment_id string, answer_accuracy double, citation_quality double, hallucination_rate double, average_latency double")).orderBy("rank").collect()
    assert [(r.experiment_id, r.overall_score) for r in ranked] == [("b", round(0.495 + 0.075 + 0.18, 6)), ("a", round(0.275 + 0.15 + 0.2 + 0.1, 6))]


def test_claims_and_citations(spark):
    rows = [("x", "One two three four [1]. Two words.\nNo number in this claim. Bad number is given here [9]!"), ("y", "short")]
    got = {r.answer_id: r for r in answers.verify_claims(spark.createDataFrame(rows, "answer_id string, text string"), 3).collect()}
    assert (got["x"].claims, got["x"].verified, got["x"].unsupported, got["x"].mismatched, got["x"].passed) == (3, 1, 1, 1, False) and got["y"].claims == 0
    known = F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])
    assert column(spark, lambda c: answers.cited_numbers(c, known), "a [3] b [1] [3] [7]") == [3, 1]
    assert column(spark, lambda c: answers.cited_numbers(c, known), "none") == [1, 2, 3]


def test_generation_retries_without_losing_rows(spark):
    def flaky(prompt, calls=[]):  # noqa: B006 - counts the calls of one task
        calls.append(prompt)
        if len(calls) % 2:
            raise RuntimeError
        return prompt.upper()

    rows = spark.createDataFrame([(1, "a"), (2, None)], "query_id int, prompt string").coalesce(1)
    assert {(r.query_id, r.answer, r.failed) for r in answers.generate(rows, flaky).collect()} == {(1, "A", False), (2, None, False)}


def test_current_data(spark):
    for q, want in (("What is the latest policy?", True), ("cafeteria has a menu", True), ("who owns runway safety", False), ("share  price", True), ("knowledge", False)):
        assert column(spark, answers.requires_current_data, q) is want


CONSENSUS = "status string, critic_passed boolean, compliance_passed boolean, risk_passed boolean, risk_level string, verification_passed boolean, unsupported_severities array<string>"


@pytest.mark.parametrize("row,want", [
    (("insufficient_evidence", True, True, True, "low", True, []), ("reject", "insufficient_evidence", False)),
    (("answered", True, True, True, "High", True, ["high"]), ("reject", "rejected", False)),
    (("answered", True, False, True, "high", True, []), ("reject", "rejected", False)),
    (("answered", True, True, True, "low", None, []), ("revise_once", "answered", True)),
    (("answered", True, True, True, "low", True, None), ("accept", "answered", False)),
])
def test_consensus(spark, row, want):
    r = reviews.consensus(spark.createDataFrame([row], CONSENSUS)).first()
    assert (r.decision, r.final_status, r.revision_allowed) == want


def test_recovered_json(spark):
    assert column(spark, reviews.recovered_json, 'text ```json\n{"a": 1}\n``` more') == '{"a":1}'
    assert column(spark, reviews.recovered_json, 'so {"b": [1]} it is') == '{"b":[1]}'
    assert column(spark, reviews.recovered_json, "[1, 2]") is None and column(spark, reviews.recovered_json, "none") is None


def test_tables(spark):
    rows = spark.createDataFrame([("q1", "e1", 1, False), ("q1", "e2", 2, True), ("q2", "e1", 1, False), ("q2", "e2", 2, False)], "question_id string, experiment_id string, k int, passed boolean")
    assert [r.question_id for r in tables.always(rows, False).collect()] == ["q2"] and [r.question_id for r in tables.benefit(rows, "k").collect()] == ["q1"]
    d = spark.createDataFrame([(1, 96.0, False, 0.1, 1.0, 0.1, 3)], "query_id int, utilisation double, bm25_only boolean, overlap_ratio double, generation double, retrieval double, sources int")
    assert {r.finding for r in tables.retrieval_diagnostics(d).collect()} == {"context_nearly_full", "low_overlap", "generation_dominates"}


def test_modes(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, chunk_id string, rank int")
    held = {"dense": lambda: a, "bm25": lambda: b}
    assert [r.chunk_id for r in fusion.retrieve("hybrid", held, 2).orderBy("rank").collect()] == ["y", "x"]
    assert [r.chunk_id for r in fusion.retrieve("bm25", held, 1).collect()] == ["y"]
    with pytest.raises(ValueError, match="dense, bm25, hybrid"):
        fusion.retrieve("other", held, 1)
    weighted = fusion.hybrid({"dense": a, "bm25": b}, 3, weights={"bm25": 3.0}).orderBy("fused_rank").collect()
    assert [r.chunk_id for r in weighted] == ["y", "z", "x"] and weighted[0].ranks == {"dense": 2, "bm25": 1}
