"""SQL for the operators that SQL can express, in the dialect of the checking engine."""

WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP4 = rf"""
with d as (select doc_id, {WORDS.format("coalesce(text, '')")} as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as s from d, unnest(range(1, len(w) - 48)) r(i)),
hit as (select doc_id, i from win qualify min(doc_id) over (partition by s) < doc_id),
word as (select doc_id, i, w[i] as x from d, unnest(range(1, len(w) + 1)) r(i)),
mark as (select word.doc_id, word.i, x, max(case when hit.i is not null then word.i end) over (partition by word.doc_id order by word.i rows between 49 preceding and current row) is not null as gone
from word left join hit on hit.doc_id = word.doc_id and hit.i = word.i)
select d.doc_id, len(w)::bigint as n_words, count(*) filter (gone)::bigint as n_removed, sha256(coalesce(string_agg(x, ' ' order by i) filter (not gone), '')) as kept_sha256
from d left join mark on mark.doc_id = d.doc_id group by d.doc_id, w
"""

OP5 = rf"""
with recursive d as (select doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') as x from d, unnest(range(1, greatest(len(w) - 1, 2))) r(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by 1),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
link as (select a, b from pair join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 85 * (p.n + q.n - c)),
reach(a, b) as (select doc_id, doc_id from d union select r.a, l.b from reach r join link l on l.a = r.b)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.b) as component_id, d.doc_id = min(r.b) as kept from d left join n on n.doc_id = d.doc_id join reach r on r.a = d.doc_id group by d.doc_id, n.n
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
q as (select item_id, term, count(*) as qtf from (select item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
c as (select count(*)::bigint as nn, sum(len(w))::bigint as ll from d where len(w) > 0),
p as (select doc_id, n, term, count(*)::bigint as tf from (select doc_id, len(w)::bigint as n, unnest(w) as term from d) group by all),
t as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)))::bigint as weight from p, c group by term, nn),
s as (select item_id, doc_id, sum(qtf * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nn) // ll)))))::bigint as score from q join p using (term) join t using (term), c group by all)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from s where score > 0 qualify rank <= 10
"""

OP12 = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, w, least(len(w), 10) as m from (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark) where len(w) > 0),
pass as (select distinct item_id, m, array_to_string(w[i:i + m - 1], ' ') as s from b, unnest(range(1, len(w) - m + 2)) r(i)),
win as (select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') as s from d, (select distinct m from b), unnest(range(1, len(w) - m + 2)) r(i)),
hit as (select doc_id, win.m, i, item_id from win join pass on pass.m = win.m and pass.s = win.s),
word as (select doc_id, count(distinct j)::bigint as n_hit from (select distinct doc_id, m, i from hit), unnest(range(i, i + m)) r(j) group by doc_id),
item as (select doc_id, list_sort(list(distinct item_id::varchar)) as items from hit group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(items), 0)::bigint as n_items, sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join word on word.doc_id = d.doc_id left join item on item.doc_id = d.doc_id
"""

OP13 = r"""
with recursive crc as (select list(list_reduce(list_concat([i], range(8)), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) order by i) as t from range(256) r(i)),
runs as (select doc_id, w, count(*) as n from (select doc_id, unnest(regexp_extract_all({lower}, '[a-z\x{C0}-\x{FF}]+')) as w from documents) where length(w) >= 6 group by all),
hashed as (select w, n, hex(encode(coalesce(doc_id::varchar, 'null') || ':' || w)) as x from runs),
summed as (select w, n, xor(list_reduce(list_concat([4294967295], list_transform(range(0, length(x), 2), lambda i: ('0x' || substr(x, i + 1, 2))::bigint)), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) as h from hashed, crc),
counted as (select case when h % 199 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, sum(n)::bigint as n from summed group by 1),
v as (select * from counted where length(word) >= 6 and n >= 5),
cut as (select word, n, unnest(list_concat([word], list_transform(range(length(word)), lambda i: substr(word, 1, i::int) || substr(word, i::int + 2)))) as part from v),
near as (select distinct a.word, a.n, b.word as other, b.n as m from cut a join cut b on a.part = b.part and a.word <> b.word where case when length(a.word) = length(b.word) then len(list_filter(range(1, length(a.word) + 1), lambda i: substr(a.word, i::int, 1) <> substr(b.word, i::int, 1))) = 1
else length(a.part) = least(length(a.word), length(b.word)) and abs(length(a.word) - length(b.word)) = 1 end),
best as (select word, count(*) as n_near, arg_min(other, (-m, other)) as other, max(m) as m from near group by 1),
f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when m >= 5 * v.n then other end as form, case when m >= 5 * v.n then m end as form_n from v left join best using (word)),
chain(word, root, next) as (select word, word, form from f union all select chain.word, f.word, f.form from chain join f on f.word = chain.next)
select f.word, form, root, n, n_near, form_n from f join chain on chain.word = f.word and chain.next is null
""".replace("{lower}", _LOWER)
