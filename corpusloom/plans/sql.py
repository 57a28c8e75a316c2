"""Pieces of the SQL that checks the catalogue, in the dialect of the checking engine."""

from __future__ import annotations

from corpusloom.operators.answers import CURRENT_DOMAINS, CURRENT_MARKERS, INSUFFICIENT_MARKERS, STOP_WORDS
from corpusloom.operators.evaluation import SAFE_FAILURE_MARKERS
from corpusloom.operators.formats import LATER, NOW, OCR, REGISTRY, UNSUPPORTED
from corpusloom.operators.variants import DOMAIN_LEAD, GLOSSARY, LEAD, POLITE

_W = r"[\p{L}\p{N}\p{M}_]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, {q(f"{_W}+(?:[-']{_W}+)*")})"


def ordered_distinct(x: str) -> str:
    """DuckDB's list_distinct has no order; keep first occurrences."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def terms(x: str) -> str:
    return f"list_distinct(regexp_extract_all({fold(x)}, {q(f'{_W}(?:[\\p{{L}}\\p{{N}}\\p{{M}}_-]*{_W})?')}))"


LINES = """l as (select source || '/' || doc_id as source, doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as all_lines from documents),
lines as (select source, doc_id || ':c' || chunk_index as chunk_id, chunk_index, text from (select source, doc_id, unnest(all_lines) as text, unnest(range(len(all_lines))) as chunk_index from l))"""


def index(corpus: str) -> str:
    """Common tables corpus(k, text), tok, post, stats and terms of a lexical index."""
    return f"""corpus as ({corpus}), tok as (select k, {tokens('text')} as l from corpus), post as (select k, term, count(*) as tf, length from (select k, len(l) as length, unnest(l) as term from tok) group by all),
stats as (select count(*) as n, avg(len(l)) as avgdl from tok), raw as (select term, count(*) as df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as r from post, stats group by term),
terms as (select term, df, case when r < 0 then 0.25 * (select avg(r) from raw) else r end as idf from raw)"""


def bm25(queries: str, by: list[str]) -> str:
    """Common table ranked(by..., k, score, rank) after ``index``."""
    b = ", ".join(by)
    return f"""asked as (select {b}, term, count(*) as qtf from (select {b}, unnest({tokens('query')}) as term from ({queries})) group by all),
scored as (select {b}, k, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))), 6) as score from asked join terms using (term) join post using (term), stats group by {b}, k having score > 0),
ranked as (select *, row_number() over (partition by {b} order by score desc, k) as rank from scored)"""


_clean = collapse("question")
_body = rf"regexp_replace(trim(regexp_replace(regexp_replace({_clean}, {q(POLITE)}, ''), {q(LEAD)}, '')), '[ ?.!]+$', '')"
_rewritten = f"case when {_body} = '' then {_clean} else upper(left({_body}, 1)) || substr({_body}, 2) end"
_related = "list_concat(" + ", ".join(f"case when contains({fold(_clean)}, {q(t)}) then [{', '.join(map(q, words))}] else [] end" for t, words in GLOSSARY.items()) + ")"


def forms(source: str, keys: str) -> str:
    return f"""select {keys}, original, rewritten, case when len(new) = 0 then original else original || ' | Related terms: ' || array_to_string(new, ', ') end as expanded, {q(f'Corpus {DOMAIN_LEAD}: ')} || rewritten as reformulated
from (select *, {ordered_distinct('related')} as new from (select {keys}, {_clean} as original, {_rewritten} as rewritten, list_filter({_related}, lambda w: not contains({fold(_clean)}, lower(w))) as related from {source}))"""


VARIANTS = f"""qs as (select item_id as query_id, text as question from benchmark), fs as ({forms('qs', 'query_id')}),
vs as (select query_id, unnest(['original', 'rewritten', 'keyword_expanded', 'domain_reformulation']) as technique, unnest([original, rewritten, expanded, reformulated]) as query, unnest([0, 1, 2, 3]) as i from fs),
variants as (select query_id, row_number() over (partition by query_id order by i) as variant_order, technique, query from (select * from vs qualify row_number() over (partition by query_id, {fold('query')} order by i) = 1))"""

RANKINGS = f"""{LINES}, {VARIANTS}, {index('select chunk_id as k, text from lines')}, {bm25('select * from variants', ['query_id', 'variant_order', 'technique'])},
rankings as (select r.query_id, r.variant_order, r.technique, r.k as chunk_id, r.score, r.rank, l.source, l.chunk_index, l.text from ranked r join lines l on l.chunk_id = r.k where r.rank <= 10)"""

DEDUP = f"""{RANKINGS}, dd as (select query_id, chunk_id, max(score) as score, min(variant_order * 1000 + rank) as seen, list(technique order by variant_order * 1000 + rank) as techniques from rankings group by 1, 2),
dedup as (select *, row_number() over (partition by query_id order by score desc, seen) as place from dd)"""

SEEDS = "seeds as (select d.query_id, d.score, d.place, l.* from dedup d join lines l using (chunk_id) where place <= 3)"

EXPANDED = """near as (select s.query_id, s.source, l.chunk_index, l.chunk_id, l.text, s.score, s.place, o as offs, true as is_neighbor from seeds s, (values (-1), (1)) w(o) join lines l on l.source = s.source and l.chunk_index = s.chunk_index + o),
expanded as (select * from (select query_id, source, chunk_index, chunk_id, text, score, place, -2 as offs, false as is_neighbor from seeds union all select * from near) qualify row_number() over (partition by query_id, source, chunk_id order by score desc, place, offs) = 1)"""

SECTIONS = """isl as (select *, chunk_index - row_number() over (partition by query_id, source order by chunk_index) as island from expanded),
sections as (select query_id, source, island, string_agg(chunk_id, ' .. ' order by chunk_index) as chunk, min(chunk_index)::int as first_index, max(chunk_index)::int as last_index, max(score) as score, count(*) as merged_chunk_count,
list_reduce(list(text order by chunk_index), lambda a, b: case when len(list_filter(range(least(length(rtrim(a)), length(ltrim(b)), 250), 0, -1), lambda n: right(rtrim(a), n) = left(ltrim(b), n))) > 0
then rtrim(a) || substr(ltrim(b), list_filter(range(least(length(rtrim(a)), length(ltrim(b)), 250), 0, -1), lambda n: right(rtrim(a), n) = left(ltrim(b), n))[1] + 1) else rtrim(a) || chr(10) || ltrim(b) end) as text
from isl group by query_id, source, island)"""

#: Sections in order under their headers, and what a budget of 3000 characters leaves of them.
BLOCKS = """heads as (select *, '[' || section || '] ' || source || ' | chunk ' || chunk || ' | score ' || round(score::decimal(18, 6), 3)::varchar || chr(10) as head from (select *, row_number() over (partition by query_id order by score desc, source, first_index) as section from sections)),
rooms as (select *, coalesce(sum(length(head) + length(text) + 2) over (partition by query_id order by section rows between unbounded preceding and 1 preceding), 0) as before from heads),
blocks as (select query_id, source, island, section, length(text) > 3000 - before - length(head) as truncated, head || case when length(text) > 3000 - before - length(head) then rtrim(left(text, (3000 - before - length(head))::bigint)) else text end as block
from rooms qualify bool_and(before < 3000 and before + length(head) < 3000) over (partition by query_id order by section rows between unbounded preceding and current row))"""

POOL = f"{DEDUP}, pool as (select d.query_id, d.score, d.place as rank, l.*, b.text as question from dedup d join lines l using (chunk_id) join benchmark b on b.item_id = d.query_id where place <= 30)"

RERANKED = f"""rr as (select *, {terms('question')} as qt, {terms('text')} as tt from pool), rs as (select *, case when len(qt) = 0 then 0.0 else round(len(list_intersect(qt, tt)) / len(qt), 6) end as reranker_score from rr),
reranked as (select *, row_number() over (partition by query_id order by reranker_score desc, rank) as reranked_rank from rs)"""

QUALITY = """quality as (select query_id, chunk_id, reranker_score as score, case when reranker_score >= 0.65 then 'strong' when reranker_score >= 0.35 then 'medium' else 'weak' end as strength, true as has_citation,
row_number() over (partition by query_id, source order by reranked_rank) = 1 as adds_source from reranked where reranked_rank <= 8)"""

CITED = """cited as (select query_id, reranked_rank as citation, '[' || reranked_rank || '] ' || string_split(source, '/')[-1] || ' | chunk ' || chunk_id || ' | score ' || printf('%.4f', reranker_score) as reference from reranked where reranked_rank <= 8)"""

CURRENT = "(" + " or ".join(f"regexp_matches(text, {q(p)})" for p in (CURRENT_MARKERS, *CURRENT_DOMAINS)) + ")"
STATUS = "(case when " + " or ".join(f"contains(lower(text), {q(m)})" for m in INSUFFICIENT_MARKERS) + " then 'insufficient_evidence' else 'answered' end)"


def support(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) > 1 and not list_contains([{', '.join(map(q, STOP_WORDS))}], w)))"


ANSWERS = r"answers as (select conv_id || '-' || turn as answer_id, regexp_replace(text, '(?m)\.$', ' [' || (turn % 7) || '].', 'g') as text from conversations where role = 'assistant')"

CLAIMS = rf"""{ANSWERS}, parts as (select answer_id, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: len(regexp_split_to_array(x, '\s+')) >= 4)) as claim from answers),
kinds as (select answer_id, case when len(list_filter(r, lambda x: x::bigint not between 1 and 5)) > 0 then 'mismatched' when len(r) > 0 then 'verified' else 'unsupported' end as kind from (select answer_id, regexp_extract_all(claim, '\[(\d{{1,9}})\]', 1) as r from parts)),
verified_claims as (select a.answer_id, count(kind) as claims, count(*) filter (kind = 'verified') as verified, count(*) filter (kind = 'unsupported') as unsupported, count(*) filter (kind = 'mismatched') as mismatched,
coalesce(round(count(*) filter (kind = 'verified') / nullif(count(kind), 0), 4), 0.0) as rate from answers a left join kinds k using (answer_id) group by 1)"""

_safe = " or ".join(f"contains(t, {q(m)})" for m in SAFE_FAILURE_MARKERS)
JUDGED = f"""jb as (select doc_id, source as experiment_id, lang as category, case when n_chars < 1000 then 'easy' else 'hard' end as difficulty, {fold(collapse('text'))} as t, doc_id % 5 = 0 as failed, quality = 1 as should_answer, n_chars / 1000.0::double as latency from documents join labels using (doc_id)),
jk as (select *, contains(t, 'the')::bigint + contains(t, 'der')::bigint + contains(t, 'de la')::bigint + contains(t, 'que')::bigint as matched_keywords, contains(t, 'idiot')::bigint + contains(t, 'stupid')::bigint as forbidden_matches, failed or {_safe} as safe_failure from jb),
judged as (select *, round(matched_keywords / 4, 6) as keyword_score, case when should_answer then t <> '' and not safe_failure and matched_keywords >= 2 else safe_failure and forbidden_matches = 0 end as passed, case when should_answer then forbidden_matches > 0 else t <> '' and not safe_failure end as hallucinated from jk)"""

SUMMARIES = """summaries as (select experiment_id, count(*) as question_count, round(avg(passed::int), 6) as answer_accuracy, coalesce(round(avg(passed::int) filter (should_answer), 6), 0.0) as supported_accuracy, coalesce(round(avg(passed::int) filter (not should_answer), 6), 0.0) as unsupported_accuracy,
round(avg(hallucinated::int), 6) as hallucination_rate, round(avg(latency), 6) as average_latency, round(avg(keyword_score), 6) as average_keyword_score, round(avg(keyword_score), 6) as citation_quality from judged group by 1)"""

RANKED = """sp as (select *, case when max(average_latency) over () = min(average_latency) over () then 1.0 else 1 - (average_latency - min(average_latency) over ()) / (max(average_latency) over () - min(average_latency) over ()) end as speed from summaries),
so as (select *, round(0.55 * answer_accuracy + 0.15 * citation_quality + 0.20 * (1 - hallucination_rate) + 0.10 * speed, 6) as overall_score from sp), ranked_experiments as (select *, row_number() over (order by overall_score desc, average_latency, experiment_id) as rank from so)"""

EVENT_STATUS = "select case when event_type in ('view', 'click') then 'answered' when event_type = 'error' then 'insufficient_evidence' else 'other' end as status, value as latency from events"
RUN_EVENTS = "run_events as (select user_id as run_id, event_id as seq, ts, case event_type when 'purchase' then 'question_completed' when 'error' then 'question_failed' when 'signup' then 'run_started' else event_type end as event_type, value as elapsed_seconds from events)"

_formats = ", ".join(f"({q(kind)}, {q(k.lower())}, {q(c)}, {q(s)})" for c, _, s, ends, names in REGISTRY for kind, keys in (("e", ends), ("n", names)) for k in keys.split())
PAGE_FORMATS = f"""paths as (select page_id, case when page_id % 11 = 0 then 'web/' || page_id || '/Dockerfile' else 'web/' || page_id || '.' || ['html', 'PDF', 'png', 'zip', 'xyz', 'md', 'tar.gz'][page_id % 7 + 1] end as path from pages),
ends as (select *, lower(string_split(path, '/')[-1]) as name, lower(regexp_extract(string_split(path, '/')[-1], '^.+\\.([^.]+)$', 1)) as extension from paths), reg(kind, key, category, status) as (values {_formats}),
pf as (select p.page_id, p.path, p.extension, coalesce(n.category, e.category, 'Unknown') as category, coalesce(n.status, e.status, '{UNSUPPORTED}') as status from ends p left join reg n on n.kind = 'n' and n.key = p.name left join reg e on e.kind = 'e' and e.key = p.extension),
page_formats as (select *, case status when '{NOW}' then 'process' when '{OCR}' then 'ocr_then_process' when '{LATER}' then 'skip_with_warning' else 'reject' end as action from pf)"""

REVIEWS = """rv as (select doc_id, case when doc_id % 11 = 0 then 'unsupported_query' else 'answered' end as status, quality = 1 as critic_passed, doc_id % 4 <> 0 as compliance_passed, toxic = 0 as risk_passed, ['low', 'medium', 'High'][doc_id % 3 + 1] as risk_level, lower(['low', 'medium', 'High'][doc_id % 3 + 1]) as level,
doc_id % 5 <> 0 as verification_passed, doc_id % 21 / 20.0 as verification_rate, doc_id % 7 = 0 as high_claim from labels),
decided as (select *, case when status = 'unsupported_query' or (level = 'high' and (high_claim or not compliance_passed)) then 'reject' when not (critic_passed and compliance_passed and risk_passed and verification_passed) then 'revise_once' else 'accept' end as decision,
case when status = 'unsupported_query' then status when level = 'high' and (high_claim or not compliance_passed) then 'rejected' else 'answered' end as final_status from rv)"""

_PAIR = "(case when len(list_distinct(list_concat(y.terms, i.terms))) = 0 then 1.0 else len(list_intersect(y.terms, i.terms)) / len(list_distinct(list_concat(y.terms, i.terms))) end >= 0.85)"


def _alike(s: str) -> str:
    return f"len(list_filter({s}.chosen, lambda y: y.id = i.chunk_id or {_PAIR})) > 0"


def _crowded(s: str) -> str:
    return f"len(list_filter({s}.chosen, lambda y: y.source = i.source)) >= 2"


#: The choice walked row by row, three times over each pool: steps 0..n-1, n..2n-1 and 2n..3n-1.
SELECTED = f"""items as (select query_id, chunk_id, source, reranked_rank as rank, row_number() over (partition by query_id order by reranked_rank) - 1 as nth, trim(text) as body, reranker_score >= 0.3 as passing, reranker_score < 0.35 as weak from reranked),
item as (select *, case when body = '' then 0 else len(regexp_split_to_array(body, '\\s+')) end as tokens, {terms('body')} as terms, count(*) over (partition by query_id) as n from items),
floors as (select query_id, any_value(n) as n, case when count(*) filter (body <> '' and passing) = 0 then least(3, count(*) filter (body <> ''), 8) else least(3, count(*) filter (body <> ''), 8) end as floor from item group by 1),
walk as (select query_id, n, floor, 0::bigint as step, []::struct(nth bigint, id varchar, source varchar, terms varchar[], weak boolean, why varchar)[] as chosen, 0::bigint as used from floors
union all
select s.query_id, s.n, s.floor, s.step + 1,
case when i.take then list_append(s.chosen, {{'nth': i.nth, 'id': i.chunk_id, 'source': i.source, 'terms': i.terms, 'weak': i.weak, 'why': case when s.step < s.n then 'threshold_pass' else 'adaptive_fallback' end}}) else s.chosen end,
case when i.take then s.used + i.tokens else s.used end
from walk s join lateral (select i.*, i.body <> '' and len(s.chosen) < 8 and len(list_filter(s.chosen, lambda y: y.nth = i.nth)) = 0 and case s.step // s.n
when 0 then i.passing and not ({_alike('s')}) and not ({_crowded('s')}) and s.used + i.tokens <= 2400 and not (len(s.chosen) >= s.floor and (s.used >= 800 or s.used + i.tokens > 1500))
when 1 then not (len(s.chosen) >= s.floor and s.used >= 800) and (len(s.chosen) < s.floor or (s.used + i.tokens <= 2400 and s.used + i.tokens <= 1500)) and not ({_alike('s')}) and not ({_crowded('s')})
else len(s.chosen) < s.floor end as take from item i where i.query_id = s.query_id and i.nth = s.step % s.n) i on true where s.step < 3 * s.n),
final as (select * from walk where step = 3 * n),
selected as (select i.query_id, i.chunk_id, i.rank, i.tokens as evidence_token_count, w.why is not null as selected, w.why as selection_reason, case when w.why is not null then null when body = '' then 'empty_text' when not passing then 'threshold_failed'
when {_alike('s')} then 'redundancy' when {_crowded('s')} then 'source_diversity_limit' when s.used + i.tokens > 1500 then 'token_budget' else 'lower_rank_fallback' end as discard_reason,
len(s.chosen) > 0 and len(list_filter(s.chosen, lambda y: not y.weak)) = 0 as weak_evidence
from item i join final s on s.query_id = i.query_id left join (select query_id, unnest(chosen) as c from final) u on u.query_id = i.query_id and u.c.nth = i.nth, lateral (select u.c.why as why) w)"""
