"""More of the catalogue: live state, the incremental index, resumable batches, experiment and review reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.codec import Words
from corpusloom.operators import answers, context, evaluation, evidence, incremental, records, reviews, tables, variants
from corpusloom.plans import catalog
from corpusloom.plans import sql as S
from corpusloom.plans.catalog import lines, query, table
from corpusloom.sources import resume, segments, storage
from corpusloom.streaming import live

# --- live views ----------------------------------------------------------------------------------

AGENTS = ("plan", "search", "write")

LIVE = """le as (select user_id % 5 as run_id, event_id as seq, case when event_type = 'signup' and event_id % 40 = 0 then 'run_started' when event_type = 'error' and event_id % 30 = 0 then 'run_failed' when event_type = 'purchase' and event_id % 30 = 0 then 'run_completed'
when event_type = 'view' then 'agent_started' when event_type = 'click' then 'agent_completed' when event_type = 'error' then 'agent_failed' else event_type end as event_type,
case when event_id % 50 < 3 then ['plan', 'search', 'write'][event_id % 3 + 1] else 'other' end as agent, case when event_type = 'purchase' then 'part ' || event_id % 7 end as stage, case when event_id % 3 = 0 then value end as progress from events)"""


def live_events(spark, d) -> DataFrame:
    kind, n = F.col("event_type"), F.col("event_id")
    mapped = (
        F.when((kind == "signup") & (n % 40 == 0), "run_started").when((kind == "error") & (n % 30 == 0), "run_failed").when((kind == "purchase") & (n % 30 == 0), "run_completed")
        .when(kind == "view", "agent_started").when(kind == "click", "agent_completed").when(kind == "error", "agent_failed").otherwise(kind)
    )
    agent = F.when(n % 50 < 3, F.element_at(F.array(*map(F.lit, AGENTS)), (n % 3 + 1).cast("int"))).otherwise("other")
    stage = F.when(kind == "purchase", F.concat(F.lit("part "), (n % 7).cast("string")))
    return table(spark, d, "events").select((F.col("user_id") % 5).alias("run_id"), n.alias("seq"), mapped.alias("event_type"), agent.alias("agent"), stage.alias("stage"), F.when(n % 3 == 0, F.col("value")).alias("progress"))


_agents = " || ',' || ".join(f"'{a}=' || coalesce(arg_max(case event_type when 'agent_started' then 'running' when 'agent_completed' then 'completed' else 'failed' end, seq) filter (event_type like 'agent%' and agent = '{a}'), case when bool_or(event_type = 'run_failed') then 'skipped' else 'pending' end)" for a in AGENTS)


@query(f"""with {LIVE}, lf as (select run_id, max(seq) filter (event_type = 'run_started') as f from le group by 1), lv as (select le.* from le join lf using (run_id) where f is null or seq >= f),
le2 as (select *, case event_type when 'run_completed' then 'Completed' when 'run_failed' then 'Failed' else coalesce(stage, case event_type when 'run_started' then 'Starting' end) end as shown from lv),
ring as (select run_id, string_agg(seq || ':' || event_type || ':' || agent, ' ' order by seq) as events from (select * from lv qualify row_number() over (partition by run_id order by seq desc) <= 250) group by 1)
select run_id, coalesce(arg_max(case event_type when 'run_started' then 'running' when 'run_completed' then 'completed' else 'failed' end, seq) filter (event_type like 'run%'), 'idle') as run_status, coalesce(arg_max(shown, seq) filter (shown is not null), 'Waiting') as stage,
coalesce(arg_max(case when event_type = 'agent_started' then agent else '' end, seq) filter (event_type like 'agent%'), '') as current_agent, coalesce(arg_max(progress, seq) filter (progress is not null), 0.0) as progress, {_agents} as agents, any_value(events) as events
from le2 join ring using (run_id) group by run_id""")
def live_run_state(spark, d):
    s = live.run_states(live_events(spark, d), AGENTS)
    agents = F.array_join(F.transform("agents", lambda a: F.concat_ws("=", a["agent"], a["status"])), ",")
    events = F.array_join(F.transform("events", lambda e: F.concat_ws(":", e["seq"].cast("string"), e["event_type"], e["agent"])), " ")
    return s.select("run_id", "run_status", "stage", "current_agent", "progress", agents.alias("agents"), events.alias("events"))


@query("select user_id, count(*) as events, round(avg(value), 6) as mean, round(min(value), 6) as least, round(max(value), 6) as most, round(quantile_disc(value, 0.5), 6) as median, round(quantile_disc(value, 0.95), 6) as p95 from events where value is not null group by 1")
def running_metrics(spark, d):
    """Exact here, as no user has more events than a sketch holds."""
    return live.running_metrics(table(spark, d, "events"), "user_id", "value")


def finished_events(spark, d) -> DataFrame:
    """Steps of runs: what an event is about, its time and a second latency in its metrics."""
    kinds = F.create_map(*[F.lit(x) for kv in {"view": "retrieval_completed", "click": "agent_completed", "purchase": "question_completed", "error": "question_failed", "signup": "consensus_decided"}.items() for x in kv])
    n = F.col("event_id")
    metrics = F.when(n % 4 == 0, F.map_from_arrays(F.array(F.lit("queue_seconds"), F.lit("tokens")), F.array((F.col("value") / 2).cast("string"), F.lit("7"))))
    return table(spark, d, "events").select(
        kinds[F.col("event_type")].alias("event_type"), F.col("value").alias("elapsed_seconds"), metrics.alias("metrics"), F.when(n % 5 == 0, "late").alias("status"),
        F.when(n % 3 == 0, "answered").when(n % 3 == 1, "").alias("answer_status"), F.when(n % 2 == 0, "accept").alias("decision"),
    )


FINISHED = """fe as (select case event_type when 'view' then 'retrieval' when 'click' then 'agent' when 'purchase' then 'total_question' when 'error' then 'total_question' end as category, value, event_id, event_type from events),
lat as (select category, value as seconds from fe where category is not null and value is not null union all select 'queue', value / 2 from fe where event_id % 4 = 0 and value is not null)"""


@query(f"with {FINISHED} select category, count(*) as events, round(avg(seconds), 6) as mean, round(min(seconds), 6) as least, round(max(seconds), 6) as most from lat group by 1")
def collected_latencies(spark, d):
    """Without the quantiles, which are estimates where a category has more rows than a sketch."""
    return live.running_metrics(live.latencies(finished_events(spark, d)), "category", "seconds").drop("median", "p95")


@query("""select kind, name, count(*) as events from (select 'error' as kind, 'all' as name from events where event_type = 'error'
union all select 'answer_status', case when event_id % 3 = 0 then 'answered' when event_id % 5 = 0 then 'late' else 'unknown' end from events where event_type in ('purchase', 'error')
union all select 'decision', case when event_id % 2 = 0 then 'accept' else 'unknown' end from events where event_type = 'signup') group by all""")
def outcome_counts(spark, d):
    return live.outcome_counts(finished_events(spark, d))


# --- incremental index, fingerprint, resumable batch ---------------------------------------------

_NEW = "o as (select source || '/' || doc_id as relative_path, text from documents where doc_id % 13 <> 0)"


def followed_index(spark, d):
    """A store that followed the corpus from an older state to the present one by changes alone."""
    path = f"{storage.shared_folder(spark)}/corpusloom/{spark.sparkContext.applicationId}/follow-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("relative_path"), "text")
    old = docs.filter("doc_id % 10 <> 0").withColumn("text", F.when(F.col("doc_id") % 17 == 0, "an old text").otherwise(F.col("text")))
    for scan in (old, docs.filter("doc_id % 13 <> 0")):
        segments.apply(path, scan.select("relative_path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), "text"))
    segments.check(spark, path)
    return segments.read(spark, path)


@query(f"with {_NEW}, t as (select relative_path, {S.tokens('text')} as l from o), u as (select relative_path, len(l) as length, unnest(l) as term from t) select relative_path, term, count(*) as tf, length from u group by all")
def incremental_postings(spark, d):
    return followed_index(spark, d).postings


@query(f"with {_NEW}, {S.index('select relative_path as k, text from o')} select term, df, round(idf, 6) as idf from terms")
def incremental_terms(spark, d):
    return followed_index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def _levels(n: int) -> str:
    return ", ".join(f"t{i + 1} as (select n // 1024 as n, sha256(string_agg(h, '' order by n)) as h from t{i} group by 1)" for i in range(n))


@query(f"""with {S.LINES}, t0 as (select row_number() over (order by source, chunk_index) - 1 as n, sha256(source || chr(0) || chunk_id || chr(0) || text || chr(0)) as h from lines), {_levels(4)}
select (select count(*) from lines) as rows, sha256((select count(*) from lines)::varchar || ':' || coalesce((select max(h) from t4), '')) as fingerprint""")
def corpus_tree_fingerprint(spark, d):
    return incremental.tree_fingerprint(lines(spark, d), ["source", "chunk_index"], ["source", "chunk_id", "text"])


@query(f"with q as (select text, row_number() over (order by conv_id, turn) as i from conversations where role = 'user'), f as ({S.forms('(select i, text as question from q)', 'i')}) select i as index, rewritten as answer from f")
def resumed_batch(spark, d):
    """Questions of all conversations answered in micro-batches, each once."""
    path = f"{storage.shared_folder(spark)}/corpusloom/{spark.sparkContext.applicationId}/batch-{uuid.uuid4().hex}"
    asked = incremental.numbered(table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")), ["conv_id", "turn"])
    resume.begin(path, asked.select((F.col("number") + 1).alias("index"), "question"))
    resume.run(spark, path, lambda batch: batch.select("key", variants.rewritten(F.col("question")).alias("answer")), files_per_batch=4)
    return resume.finished(spark, path).select("index", "answer")


# --- token codec ---------------------------------------------------------------------------------


@query(r"""with w as (select conv_id, turn, text, len(regexp_extract_all(text, '\S+')) as tokens from conversations)
select conv_id, turn, tokens, case when tokens <= 12 then text else regexp_extract(text, '^(?:\s*\S+){12}') end as cut, 100000 - tokens as remaining from w""")
def token_codec(spark, d):
    codec, c = Words(), F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", codec.count(c).alias("tokens"), codec.truncate(c, 12).alias("cut"), codec.remaining(codec.count(c), F.lit(100000)).alias("remaining"))


@query(rf"""with {S.DEDUP}, {S.SEEDS}, {S.EXPANDED}, {S.SECTIONS}, {S.BLOCKS}, n as (select query_id, section, head || text as block, len(regexp_extract_all(head || text, '\S+')) as tokens from heads),
s as (select *, coalesce(sum(tokens) over (partition by query_id order by section rows between unbounded preceding and 1 preceding), 0) as before from n),
k as (select *, case when before + tokens <= 400 then 'whole' when before < 400 then 'cut' else 'out' end as kind from s)
select query_id, string_agg(case kind when 'whole' then block else regexp_extract(block, '^(?:\s*\S+){{' || (400 - before) || '}}') end, chr(10) || chr(10) order by section) filter (kind <> 'out') as context,
least(sum(tokens), 400)::bigint as used, count(*) filter (kind = 'cut') as truncated_sections, count(*) filter (kind = 'out') as omitted_sections from k group by query_id""")
def token_budget_words(spark, d):
    s = catalog.ranked_sections(spark, d)
    blocks = s.withColumn("block", F.concat(context.header(F.col("section"), F.col("source"), F.col("chunk"), F.col("score")), F.col("text")))
    return context.compress_tokens(blocks, 400, Words().counter())


# --- plain contexts, roles -----------------------------------------------------------------------


@query(rf"""with {S.RANKINGS}, h as (select query_id, rank, '[' || rank || '] ' || string_split(source, '/')[-1] || ' | page n/a | chunk ' || chunk_id || ' | score ' || round(score::decimal(18, 6), 3)::varchar || chr(10) as head, regexp_replace(text, '^\s+|\s+$', '', 'g') as text from rankings where technique = 'original'),
r as (select *, coalesce(sum(length(head) + length(text) + 2) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0)::bigint as before from h)
select query_id, string_agg(head || left(text, 1500 - before - length(head)), chr(10) || chr(10) order by rank) as context, count(*) as sections from r where before < 1500 and before + length(head) < 1500 group by query_id""")
def simple_context(spark, d):
    rows = catalog.variant_rankings(spark, d).filter("technique = 'original'").withColumn("page", F.lit(None).cast("int"))
    return context.simple_context(rows, 1500)


@query(f"with {S.DEDUP}, {S.SEEDS}, {S.EXPANDED} select e.query_id, e.chunk_id, e.score, case when s.chunk_id is null then 'added_adjacent_chunk' else 'retrieved_seed' end as role from expanded e left join seeds s on s.query_id = e.query_id and s.chunk_id = e.chunk_id")
def expansion_roles(spark, d):
    s = catalog.seeds(spark, d)
    return context.expansion_roles(catalog.expanded(spark, d, s), s).select("query_id", "chunk_id", "score", "role")


# --- experiments ---------------------------------------------------------------------------------


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


def measured(spark, d) -> DataFrame:
    """Judged answers with what their text measures; latencies are in proportion to sizes."""
    m = table(spark, d, "documents").select(
        F.col("doc_id").alias("_id"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("context_tokens"), F.size(_lines(F.col("text"))).alias("chunks_before_deduplication"),
        F.size(F.array_distinct(_lines(F.col("text")))).alias("chunks_after_deduplication"), F.col("n_chars").alias("final_context_characters"),
    )
    j = catalog.judged(spark, d)
    return j.join(m, F.col("doc_id") == F.col("_id")).withColumns({
        "total_latency": F.col("final_context_characters") / 1000.0, "retrieval_latency": F.col("context_tokens") / 1000.0, "context_construction_latency": F.col("chunks_before_deduplication") / 4.0,
        "generation_latency": F.col("final_context_characters") / 2000.0, "final_context_sections": F.col("chunks_after_deduplication"), "citation_quality": F.col("keyword_score"),
    })


MEASURED = rf"""{S.JUDGED}, sized as (select doc_id, n_chars, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as parts, len(list_distinct(regexp_extract_all(text, '\[(\d+)\]', 1))) as citations from documents),
measured as (select j.*, n_chars as chars, words, len(parts) as raw, len(list_distinct(parts)) as deduplicated, citations from judged j join sized using (doc_id))"""
_MEANS = """round(avg(keyword_score), 6) as keyword_coverage, round(avg(keyword_score), 6) as citation_quality, round(avg(citations), 6) as average_citation_count, round(avg(chars / 1000.0::double), 6) as average_latency, round(avg(words / 1000.0::double), 6) as average_retrieval_latency,
round(avg(raw / 4.0::double), 6) as average_context_construction_latency, round(avg(chars / 2000.0::double), 6) as average_generation_latency, round(avg(chars), 6) as average_context_size, round(avg(words), 6) as average_context_tokens, round(avg(deduplicated), 6) as average_context_sections,
round(avg(raw), 6) as average_retrieved_chunks, round(avg(deduplicated), 6) as average_deduplicated_chunks, 0.0::double as average_expanded_chunks, 0.0::double as average_merged_sections"""
AGGREGATED = f"""{MEASURED}, aggregated as (select experiment_id, case when grouping(category) = 0 then 'category' when grouping(difficulty) = 0 then 'difficulty' else 'all' end as dimension, coalesce(category, difficulty, 'all') as value, count(*) as question_count,
round(avg(passed::int), 6) as answer_accuracy, coalesce(round(avg(passed::int) filter (should_answer), 6), 0.0) as supported_answer_accuracy, coalesce(round(avg(passed::int) filter (not should_answer), 6), 0.0) as unsupported_question_accuracy, round(avg(hallucinated::int), 6) as hallucination_rate, {_MEANS}
from (select * replace (coalesce(category, 'uncategorized') as category) from measured) group by grouping sets ((experiment_id), (experiment_id, category), (experiment_id, difficulty)))"""


@query(f"with {AGGREGATED} select * from aggregated")
def experiment_aggregate(spark, d):
    return evaluation.aggregate_experiment(measured(spark, d))


@query(f"with {AGGREGATED} select experiment_id, max(question_count) filter (dimension = 'all') as question_count, max(average_latency) filter (dimension = 'all') as average_latency, string_agg(value || '=' || answer_accuracy::decimal(10, 6)::varchar, ',' order by value) filter (dimension = 'category') as by_category, string_agg(value || '=' || answer_accuracy::decimal(10, 6)::varchar, ',' order by value) filter (dimension = 'difficulty') as by_difficulty from aggregated group by 1")
def experiment_records(spark, d):
    shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"].cast("decimal(10,6)").cast("string"))), ",")
    return evaluation.experiment_records(evaluation.aggregate_experiment(measured(spark, d))).select("experiment_id", "question_count", "average_latency", shown("pass_rate_by_category").alias("by_category"), shown("pass_rate_by_difficulty").alias("by_difficulty"))


@query(f"""with {AGGREGATED}, summaries as (select * from aggregated where dimension = 'all'), {S.RANKED}, b as (select * from ranked_experiments order by rank limit 1), f as (select * from ranked_experiments order by average_latency, rank limit 1)
select b.experiment_id as best_overall, f.experiment_id as fastest, round(b.answer_accuracy - f.answer_accuracy, 6) as accuracy_delta, coalesce(round(b.average_latency / nullif(f.average_latency, 0) - 1, 6), 0.0) as latency_delta,
case greatest(b.average_retrieval_latency, b.average_context_construction_latency, b.average_generation_latency) when b.average_retrieval_latency then 'retrieval' when b.average_context_construction_latency then 'context construction' else 'generation' end as bottleneck,
round(greatest(b.average_retrieval_latency, b.average_context_construction_latency, b.average_generation_latency), 6) as bottleneck_seconds from b, f""")
def experiment_tradeoffs(spark, d):
    whole = evaluation.aggregate_experiment(measured(spark, d)).filter("dimension = 'all'")
    return evaluation.tradeoffs(evaluation.rank_experiments(whole))


@query(f"with {S.JUDGED} select category, round(coalesce(avg(passed::int) filter (difficulty = 'easy'), 0), 6) as easy, round(coalesce(avg(passed::int) filter (difficulty = 'hard'), 0), 6) as hard from judged group by 1")
def accuracy_heatmap(spark, d):
    return tables.heatmap(catalog.judged(spark, d).withColumn("good", F.col("passed").cast("int")), "difficulty", "category", "good", ["easy", "hard"])


@query(f"""with {MEASURED}, r as (select *, case when doc_id % 5 = 0 then 'Insufficient Evidence' when doc_id % 7 = 0 then 'Unsupported Query' when doc_id % 11 = 0 then 'generation failed' else 'Answered' end as answer_status, doc_id % 9 <> 0 as good from measured)
select count(*) as question_count, count(*) filter (good) as successful_questions, count(*) filter (not good) as failed_questions, count(*) filter (answer_status = 'Answered') as answered_questions, count(*) filter (answer_status = 'Insufficient Evidence') as insufficient_evidence_questions,
count(*) filter (answer_status = 'Unsupported Query') as unsupported_query_questions, count(*) filter (answer_status = 'generation failed') as generation_failed_questions, round(avg(chars / 1000.0::double), 6) as average_latency_seconds, round(avg(words / 1000.0::double), 6) as average_retrieval_latency_seconds,
round(avg(raw), 6) as average_retrieved_chunks, round(avg(words), 6) as average_context_tokens, round(avg(passed::int) filter (good), 6) as answer_accuracy, round(avg(hallucinated::int) filter (good), 6) as hallucination_rate, round(avg(keyword_score) filter (good), 6) as citation_quality from r""")
def run_report(spark, d):
    """Outcomes by id, as the tables hold none; only finished questions are judged."""
    n = F.col("doc_id")
    status = F.when(n % 5 == 0, "Insufficient Evidence").when(n % 7 == 0, "Unsupported Query").when(n % 11 == 0, "generation failed").otherwise("Answered")
    good = n % 9 != 0
    rows = measured(spark, d).withColumns({"answer_status": status, "status": F.when(good, "success").otherwise("failed"), "retrieved_chunks": F.col("chunks_before_deduplication"), "passed": F.when(good, F.col("passed"))})
    return evaluation.run_report(rows)


_OF_QUESTION = f"""{S.POOL}, {S.RERANKED}, {S.QUALITY}, {S.SELECTED}"""


@query(f"""with recursive {_OF_QUESTION}, p as (select query_id, count(*) filter (selected) as chosen, count(*) filter (not selected) as discarded, coalesce(sum(evidence_token_count) filter (selected), 0) as kept_tokens, sum(evidence_token_count) as all_tokens, bool_or(weak_evidence) as weak from selected group by 1),
s as (select query_id, avg(score) as score from quality group by 1), q as (select *, greatest(coalesce(round(100 * (1 - kept_tokens / nullif(all_tokens, 0)), 2), 0.0), 0.0) as reduction from p join s using (query_id))
select 'average_token_reduction_percent' as metric, null as name, round(avg(reduction), 6) as value from q union all select 'average_reranker_score', null, round(avg(score), 6) from q union all select 'average_selected_chunk_count', null, round(avg(chosen), 6) from q
union all select 'average_discarded_chunk_count', null, round(avg(discarded), 6) from q union all select 'average_selected_evidence_tokens', null, round(avg(kept_tokens), 6) from q union all select 'selected_chunk_count', null, sum(chosen) from q
union all select 'discarded_chunk_count', null, sum(discarded) from q union all select 'weak_evidence_question_count', null, count(*) filter (weak) from q union all select 'question_count', null, count(*) from q
union all select 'discard_reason', discard_reason, count(*) from selected where discard_reason is not null group by 2
union all select 'evidence_strength', x, (select count(*) from quality where strength = x) from (values ('strong'), ('medium'), ('weak')) v(x)""")
def reranking_metrics(spark, d):
    chosen = storage.written(catalog.select_evidence(spark, d), "chosen")
    judged = storage.written(evidence.evidence_quality(catalog.top_evidence(spark, d)).select("query_id", "strength", "score"), "judged")

    def counted(df: DataFrame, column: str, name: str) -> DataFrame:
        counts = df.filter(F.col(column).isNotNull()).groupBy("query_id", column).agg(F.count("*").alias("n"))
        return counts.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct(column, "n"))).alias(name))

    kept = F.coalesce(F.sum(F.when(F.col("selected"), F.col("evidence_token_count"))), F.lit(0))
    rows = chosen.groupBy("query_id").agg(
        F.count_if("selected").alias("selected_chunk_count"), F.count_if(~F.col("selected")).alias("discarded_chunk_count"), kept.alias("selected_evidence_tokens"),
        tables.token_efficiency(F.sum("evidence_token_count"), kept).alias("token_reduction_percent"), F.bool_or("weak_evidence").alias("weak_evidence"),
    )
    rows = rows.join(judged.groupBy("query_id").agg(F.avg("score").alias("average_reranker_score")), "query_id").join(counted(judged, "strength", "strengths"), "query_id", "left").join(counted(chosen, "discard_reason", "discard_reasons"), "query_id", "left")
    return evaluation.reranking_metrics(rows)


# --- reviews -------------------------------------------------------------------------------------

TOPICS = {"the": ("the ", "and"), "der": ("der ", "die "), "que": ("que", "de la"), "none": ("no such text at all",)}


@query("select category, issues from (select count(*) filter (contains(lower(text), 'the ') or contains(lower(text), 'and')) as a, count(*) filter (contains(lower(text), 'der ') or contains(lower(text), 'die ')) as b, count(*) filter (contains(lower(text), 'que') or contains(lower(text), 'de la')) as c, 0::bigint as e from conversations) t, lateral (values ('the', a), ('der', b), ('que', c), ('none', e)) v(category, issues)")
def critic_categories(spark, d):
    return reviews.critic_categories(table(spark, d, "conversations").select(F.col("text").alias("issue")), TOPICS)


@query("""with e as (select unnest(['lang', 'source', 'length', 'first', 'path']) as dimension, unnest([coalesce(lang, 'unknown'), coalesce(source, 'unknown'), (n_chars // 1000)::varchar, coalesce(nullif(left(text, 1), ''), 'unknown'), source || '/' || doc_id]) as value from documents),
c as (select dimension, coalesce(value, 'unknown') as value, count(*) as rows from e group by all) select dimension, value, rows, row_number() over (partition by dimension order by rows desc, value) as place from c qualify place <= 8""")
def source_diversity(spark, d):
    docs = table(spark, d, "documents").select("lang", "source", F.floor(F.col("n_chars") / 1000).alias("length"), F.left("text", F.lit(1)).alias("first"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    return reviews.source_diversity(docs, ["lang", "source", "length", "first", "path"]).withColumn("place", F.col("place").cast("long"))


_RISK = ("Operational", "cybersecurity", "Aviation_Safety", "other", "compliance")


@query(f"""with r as (select user_id, event_id, replace(lower([{', '.join(map(S.q, _RISK))}][(event_id * 7 + user_id) % 5 + 1]), '_', ' ') as category, case when value > 60 then 'high' when value > 20 then 'medium' end as severity, event_type as likelihood from events),
l as (select user_id, category, max(event_id) as event_id from r group by all), u as (select distinct user_id from events)
select u.user_id, c.category, coalesce(severity, 'not assessed') as severity, coalesce(likelihood, 'not assessed') as likelihood, 'not specified' as mitigation
from u, (values {', '.join(f"('{c}')" for c in reviews.RISK_CATEGORIES)}) c(category) left join l on l.user_id = u.user_id and l.category = c.category left join r on r.event_id = l.event_id""")
def risk_matrix(spark, d):
    n = F.element_at(F.array(*map(F.lit, _RISK)), ((F.col("event_id") * 7 + F.col("user_id")) % 5 + 1).cast("int"))
    severity = F.when(F.col("value") > 60, "high").when(F.col("value") > 20, "medium")
    risks = table(spark, d, "events").select("user_id", F.col("event_id").alias("ordinal"), n.alias("category"), severity.alias("severity"), F.col("event_type").alias("likelihood"), F.lit(None).cast("string").alias("mitigation"))
    return reviews.risk_matrix(risks, "user_id")


_modalities = ", ".join(f"count(*) filter (kind = {S.q(m)}) as {S.q(m)[1:-1]}" for m in records.MODALITIES)


@query(f"with {S.POOL}, {S.RERANKED}, t as (select query_id, source, reranker_score, case when contains(text, '|') then 'table' when reranked_rank = 1 then 'figure' else 'text' end as kind from reranked where reranked_rank <= 8) select query_id, count(*) as evidence_count, round(least(greatest(avg(reranker_score), 0), 1), 4) as sufficiency, count(distinct source) as sources, {_modalities} from t group by query_id")
def evidence_modalities(spark, d):
    kind = F.when(F.contains("text", F.lit("|")), "Table").when(F.col("rank") == 1, "figure")
    return reviews.modality_counts(catalog.top_evidence(spark, d).withColumn("modality", kind), records.MODALITIES).withColumn("sufficiency", F.round("sufficiency", 4))


# --- documents, variants, citations, prompts -----------------------------------------------------


@query("""with d as (select length(coalesce(text, '')) as n, source, coalesce(lang, 'unknown') as lang, coalesce((n_chars // 1000)::varchar, 'unknown') as size from documents)
select case when grouping(lang) = 0 then 'lang' when grouping(size) = 0 then 'size' else 'all' end as dimension, coalesce(lang, size, 'all') as value, count(*) as documents, coalesce(sum(n), 0)::bigint as chars, coalesce(round(avg(n), 1), 0.0) as avg_chars, count(distinct source) as sources
from d group by grouping sets ((), (lang), (size))""")
def document_report(spark, d):
    return tables.document_report(table(spark, d, "documents").withColumn("size", F.floor(F.col("n_chars") / 1000)), ["lang", "size"])


@query(f"with {S.DEDUP}, {S.SEEDS}, {S.EXPANDED}, {S.SECTIONS}, t as (select distinct query_id, chunk_id, technique from rankings) select technique, count(distinct (query_id, source, island)) filter (island is not null) as final_sections from t left join isl using (query_id, chunk_id) group by technique")
def variant_sections(spark, d):
    return tables.final_sections(catalog.variant_rankings(spark, d), catalog.ranked_sections(spark, d))


@query("select page_id, html is not null and html <> '' and page_id % 3 <> 0 and page_id % 5 <> 0 and page_id % 7 <> 0 and url is not null and url <> '' as metadata_complete from pages")
def citation_quality(spark, d):
    n = F.col("page_id")
    rows = table(spark, d, "pages").select("page_id", F.col("html").alias("document"), F.when(n % 3 != 0, n % 9).alias("page_number"), F.when(n % 5 == 0, "").otherwise(n.cast("string")).alias("chunk_id"), F.when(n % 7 != 0, n / 10).alias("score"), F.col("url").alias("source_path"))
    return records.citation_quality(rows).select("page_id", "metadata_complete")


_shapes = " ".join(f"when regexp_matches(lower(text), {S.q(p)}) then {S.q(s)}" for p, s in answers.SHAPES)


@query(f"""with {S.POOL}, {S.RERANKED}, e as (select query_id, any_value(question) as text, string_agg('[' || reranked_rank || '] ' || text, chr(10) order by reranked_rank) as context, bool_and(reranker_score < 0.35) as weak from reranked where reranked_rank <= 8 group by 1)
select query_id, 'Use the selected evidence only, and cite every claim and recommendation as [n].' || chr(10) || 'Say why each recommendation matters, and name what the evidence leaves open.' || chr(10) || 'Write at least 120 words if the evidence carries them. Write at most 400 words.' || chr(10) || 'Give '
|| case {_shapes} else 'a direct answer and the findings behind it' end || '.' || case when weak then chr(10) || 'All of this evidence is weak: say so first, and advise a check of the sources.' else '' end || chr(10) || chr(10) || 'Selected evidence:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || text as prompt from e""")
def detailed_prompts(spark, d):
    top = catalog.top_evidence(spark, d)
    lines_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["text"])), "\n")
    held = top.groupBy("query_id").agg(lines_.alias("context"), F.bool_and(F.col("score") < 0.35).alias("weak_evidence"))
    return answers.detailed_prompts(catalog.questions(spark, d), held, least_words=120, most_words=400).filter("prompt is not null")


@query(f"""with {S.POOL}, {S.RERANKED}, e as (select query_id, count(*) as evidence_count, sum(length(text)) as chars, string_agg(chunk_id, ',' order by reranked_rank) as chunks from reranked where reranked_rank <= 8 group by 1)
select item_id as query_id, coalesce(evidence_count, 0) as evidence_count, chunks from benchmark left join e on e.query_id = item_id""")
def composed_prompts(spark, d):
    """The evidence that a prompt's JSON holds, read back from it."""
    top = catalog.top_evidence(spark, d)
    runs = catalog.questions(spark, d).select("query_id", "question", F.lit("answered").alias("status"), F.lit(None).cast("string").alias("plan"), F.lit(None).cast("string").alias("quality"))
    out = answers.composed_prompts(runs, top)
    held = F.from_json(F.regexp_extract("prompt", r"(?s)\nEvidence:\n(.*)$", 1), "array<struct<reference_id:int,chunk_id:string>>")
    return out.select("query_id", "evidence_count", F.nullif(F.array_join(held["chunk_id"], ","), F.lit("")).alias("chunks"))


@query(rf"""with recursive {_OF_QUESTION}, c as (select query_id, sum(len(regexp_extract_all('[' || rank || '] ' || source || ' ' || text, '\S+'))) as candidate_tokens, count(*) as candidates from pool group by 1),
f as (select s.query_id, sum(len(regexp_extract_all('[' || p.rank || '] ' || p.source || ' ' || p.text, '\S+'))) filter (selected) as final_tokens, count(*) filter (selected) as chosen from selected s join pool p on p.query_id = s.query_id and p.chunk_id = s.chunk_id group by 1)
select query_id, candidate_tokens, coalesce(final_tokens, 0)::bigint as final_tokens, round(100.0::double * greatest(candidate_tokens - coalesce(final_tokens, 0), 0) / candidate_tokens, 2) as reduction from c join f using (query_id)""")
def token_reduction(spark, d):
    """Tokens of the contexts that all candidates and the chosen ones make."""
    codec = Words()
    shown = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("source"), F.lit(" "), F.col("text"))
    rows = catalog.pool(spark, d).select("query_id", "chunk_id", codec.count(shown).alias("tokens")).join(catalog.select_evidence(spark, d).select("query_id", "chunk_id", "selected"), ["query_id", "chunk_id"])
    out = rows.groupBy("query_id").agg(F.sum("tokens").alias("candidate_tokens"), F.coalesce(F.sum(F.when(F.col("selected"), F.col("tokens"))), F.lit(0)).alias("final_tokens"))
    return out.withColumn("reduction", tables.token_efficiency(F.col("candidate_tokens"), F.col("final_tokens")))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' as shown, ts as parsed, round((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1000000.0, 6) as elapsed from events")
def event_times(spark, d):
    rows = table(spark, d, "events").select("event_id", X.iso_time(F.col("ts").cast("timestamp")).alias("shown"))
    at = X.parsed_time(F.col("shown"))
    return rows.select("event_id", "shown", at.cast("timestamp_ntz").alias("parsed"), X.elapsed_seconds(X.parsed_time(F.lit("2024-01-01")), at).alias("elapsed"))


# --- questions over all experiments --------------------------------------------------------------

_OUTCOMES = "o as (select o_custkey as question_id, o_orderpriority as experiment_id, avg(o_totalprice) > 150000 as passed from orders group by all)"


def outcomes(spark, d) -> DataFrame:
    """Customers as questions, order priorities as experiments, which an average price decides."""
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("question_id"), F.col("o_orderpriority").alias("experiment_id")).agg((F.avg("o_totalprice") > 150000).alias("passed"))


@query(f"with {_OUTCOMES}, n as (select count(distinct experiment_id) as n from o), q as (select question_id, count(distinct experiment_id) as experiments, bool_and(passed) as good, not bool_or(passed) as bad from o group by 1) select question_id, experiments, good as passes from q, n where experiments = n and (good or bad)")
def settled_questions(spark, d):
    both = [tables.always(outcomes(spark, d), passed=p).withColumn("passes", F.lit(p)) for p in (True, False)]
    return both[0].unionByName(both[1])


@query("select o_custkey as question_id from (select o_custkey, arg_min(o_totalprice > 150000, o_orderkey) as first, arg_max(o_totalprice > 150000, o_orderkey) as last from orders group by 1) where not first and last")
def gained_questions(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("question_id"), (F.col("o_totalprice") > 150000).alias("passed"), "o_orderkey")
    return tables.benefit(rows, "o_orderkey")


# the token budget of the catalogue counts words, as ``token_budget_words`` does
catalog.ORACLES["context_token_budget"] = catalog.ORACLES["token_budget_words"]
