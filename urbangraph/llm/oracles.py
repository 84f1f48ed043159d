"""The numbered operators in SQL, where SQL expresses them."""

#: Conversation -7 and the template's marks (14 characters a turn) are those of chat.py; each control string in a text gets one character more.
OP11_SQL = r"""
with every as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as r, text as t from conversations
  union all select -7, turn, role, text, role, text from (values (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]')) v(turn, role, text)),
numbered as (select *, row_number() over (partition by conv_id order by turn asc nulls first, r asc nulls first, t asc nulls first) as k,
  length(regexp_replace(role, '<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]', '\0+', 'g')) + length(regexp_replace(text, '<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]', '\0+', 'g')) + 14 as n from every)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256, cast(sum(n) as bigint) as formatted_chars
from numbered group by conv_id
"""

DISTANCE = """d{i} as (select v.id, v.vec_id, v.v, c.number, cast(list_sum(list_transform(range(1, 65), lambda j: (v.v[j] - c.c[j]) * (v.v[j] - c.c[j]))) as bigint) as d from v, c{i} c),
a{i} as (select id, min(vec_id) as vec_id, min(v) as v, min({{'d': d, 'n': number}}) as best from d{i} group by id),
"""
MOVE = """m{i} as (select best.n as number, count(*) as n, {sums} from a{i} group by 1),
c{j} as materialized (select c.number, coalesce([{means}], c.c) as c from c{i} c left join m{i} m on c.number = m.number),
"""
PLACES = range(1, 65)
SUMS = ", ".join(f"sum(v[{k}]) as s{k}" for k in PLACES)
MEANS = ", ".join(f"cast((s{k} - (s{k} % n + n) % n) // n as bigint)" for k in PLACES)
OP12_SQL = """with v as materialized (select row_number() over () as id, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select row_number() over (order by sha256('1:' || coalesce(cast(vec_id as varchar), 'null')), v) - 1 as number, v as c from v qualify number < 16),
"""
OP12_SQL += "".join(DISTANCE.format(i=i) + MOVE.format(i=i, j=i + 1, sums=SUMS, means=MEANS) for i in range(3)) + DISTANCE.format(i=3).rstrip(",\n")
OP12_SQL += """
select vec_id, cast(best.n as int) as cluster, best.d as distance, cast(sum(best.d) over (partition by best.n) as bigint) as cluster_inertia, cast(sum(best.d) over () as bigint) as inertia,
  sha256(array_to_string(c.c, ',')) as centroid_sha256 from a3 join c3 c on c.number = best.n"""

#: CRC-32 by a table of 256 entries, made by the rule.
OP13_SQL = r"""
with crcs(i, c) as (select i, list_reduce(list_prepend(i, [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) from (select unnest(range(256)) as i)),
crc_table as (select list(c order by i) as t from crcs),
texts as (select 0 as target, row_number() over () as id, doc_id, text from documents union all select 1, -row_number() over (), null, text from benchmark),
worded as (select target, id, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from texts),
features as (select target, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from worded),
counted as (select target, id, f, count(*) as n from features group by all),
bytes as (select f, hex(encode(f)) as h from (select distinct f from counted)),
hashed as (select f, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
  lambda c, b: xor(c // 256, t[cast(xor(c % 256, b) as bigint) + 1])), 4294967295) % 10000 as bucket from bytes, crc_table),
totals as (select bucket, sum(n) filter (target = 0) as s, sum(n) filter (target = 1) as t from counted join hashed using (f) group by bucket),
gains as (select bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1)::double * (sum(s) over () + 10000)::double / ((coalesce(s, 0) + 1)::double * (coalesce(sum(t) over (), 0) + 10000)::double))) as bigint) as gain from totals),
weighed as (select id, sum(n)::bigint as n_features, cast(floor(sum(n * gain) / sum(n)) as bigint) as weight from counted join hashed using (f) join gains using (bucket) where target = 0 group by id),
scored as (select id, doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(cast(doc_id as varchar), 'null')), 1, 8))::bigint + 0.5::double) / 4294967296::double))) as bigint) as score
  from worded left join weighed using (id) where target = 0),
placed as (select id, row_number() over (order by score desc, doc_id asc nulls last, n_features, weight) as place, count(*) over () as able from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when place <= 25 * able // 100 then place end as rank from scored left join placed using (id)
"""
