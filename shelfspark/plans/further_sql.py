"""SQL of the further queries, for DuckDB: the same results by other means."""

from __future__ import annotations

from shelfspark.operators.passages import BACK_MATTER
from shelfspark.plans.sql import _EVAL, _SPREAD, _STATE, ASKED, CURRENT, CUT, DOCS, DOCUMENTS, HEAD, INDEX, LF, LINES, MODE, PAGES, QUESTIONS, WS, best, bm25, chunk_rows, escaped, has, joined, label, q, rr, strip

#: The place of a word among 384, from its md5; 2 to the 32 is 256 modulo 384.
_PLACE = "(((cast('0x' || substr(md5(w), 1, 8) as bigint) % 384 * 256 + cast('0x' || substr(md5(w), 9, 8) as bigint)) % 384 * 256 + cast('0x' || substr(md5(w), 17, 8) as bigint)) % 384 * 256 + cast('0x' || substr(md5(w), 25, 8) as bigint)) % 384"


def _bag(name: str, key: str, text: str, source: str) -> str:
    return f"""{name} as (select {key}, {_PLACE} as place, count(*)::double as n from (select {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) as w from {source}) group by all),
{name}_norm as (select {key}, sqrt(sum(n * n)) as norm from {name} group by {key})"""


_TITLE = r"translate(regexp_replace(coalesce(name, ''), '([^.])\.[^.]*$', '\1'), '_-', '  ')"
_EMBEDDED = f"case when coalesce(section, '') <> '' then {_TITLE} || ' — ' || section else {_TITLE} end || {LF} || coalesce(text, '')"

HYBRID = f"""{DOCS}, {QUESTIONS}, {INDEX}, {_bag('dbag', 'chunk_id', _EMBEDDED, 'docs')}, {_bag('qbag', 'query_id', 'text', 'questions')},
dots as (select query_id, chunk_id, sum(a.n * b.n) as dot from qbag a join dbag b using (place) group by all),
near as (select a.query_id, b.chunk_id, round(coalesce(d.dot, 0) / (a.norm * b.norm), 12) as score from qbag_norm a cross join dbag_norm b left join dots d on d.query_id = a.query_id and d.chunk_id = b.chunk_id),
va as ({best('select * from near', 50)}), vb as ({best(bm25(ASKED), 50)}),
fused as (select query_id, chunk_id, va.rank as ra, vb.rank as rb, coalesce(1.0::double / (60 + va.rank), 0) + coalesce(1.0::double / (60 + vb.rank), 0) as fused from va full join vb using (query_id, chunk_id)),
pool as (select query_id, chunk_id, row_number() over (partition by query_id order by round(fused, 12) desc, ra nulls last, rb nulls last) as place from fused qualify place <= 30),
scored as (select p.query_id, p.chunk_id, p.place, 4.0::double * len(list_intersect(list_distinct(regexp_extract_all(lower(z.text), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(case when coalesce(d.section, '') <> '' then d.section || {LF} || d.text else d.text end), '[a-z0-9]+')))) - 8.0 as score from pool p join questions z using (query_id) join docs d using (chunk_id)),
top_hits as (select query_id, chunk_id, score, round(1 / (1 + exp(-score)), 6) as relevance, cast(row_number() over (partition by query_id order by round(score, 4) desc, place) as integer) as rank from scored qualify rank <= 6)"""

_OPENING = f"""named as (select file_id, min({{name: name, ordinal: ordinal, chunk_id: chunk_id}}) as first from docs group by file_id order by first limit 10),
flagged as (select d.*, coalesce({has('section', BACK_MATTER)}, false) as back from docs d join named using (file_id)),
opening as (select chunk_id, row_number() over (order by first, ordinal, chunk_id) as n from (select f.*, n.first from (select *, bool_and(back) over (partition by file_id) as only_back from flagged) f join named n using (file_id) where not back or only_back qualify row_number() over (partition by file_id order by ordinal, chunk_id) = 1))"""

# the file with the best hit answers a question for pages
_PAGED = f"""asked as (select z.query_id, d.file_id, {PAGES} as wanted from (select query_id, lower(text) as u from questions) z join top_hits t on t.query_id = z.query_id and t.rank = 1 join docs d using (chunk_id)),
target as (select a.query_id, f.file_id, f.num_pages, a.wanted, list_sort(list_distinct(list_transform(wanted, lambda p: case when p > 0 then p else num_pages + 1 + p end))) as resolved from asked a join current_files f using (file_id) where wanted is not null),
placed as (select *, list_filter(resolved, lambda p: p between 1 and num_pages) as there, num_pages is null and (list_max(wanted) < 0 or list_distinct(wanted) = [1]) as edge from target),
on_page as (select p.query_id, count(*) as n from placed p join docs c using (file_id) where len(list_filter(p.there, lambda x: x between c.page_start and c.page_end)) > 0 group by p.query_id),
at_edge as (select p.query_id, least(count(*), 3) as n from placed p join docs c using (file_id) where edge group by p.query_id),
paged as (select p.query_id, case when num_pages is null then not edge else len(there) = 0 or o.n is null end as message, coalesce(least(o.n, 12), e.n, 0) as n from placed p left join on_page o using (query_id) left join at_edge e using (query_id))"""

_ANSWERS = f"""with {HYBRID}, {_OPENING}, {_PAGED},
modes as (select query_id, {MODE.replace('content', 'text').replace('case when (' + PAGES + ') is not null then ' + q('pages') + ' ', 'case ')} as other from (select query_id, text, lower(text) as u from questions)),
found as (select query_id, count(*) as n from top_hits group by query_id),
matched as (select query_id, chunk_id from top_hits where rank <= 4 and relevance >= 0.1),
wide as (select m.query_id, count(*) as n from (select query_id, chunk_id from matched union select o.query_id, p.chunk_id from modes o cross join opening p) m join modes o on o.query_id = m.query_id and o.other = 'overview' group by m.query_id),
judged as (select m.query_id, case when p.query_id is not null then 'pages' else other end as mode, p.message, case when p.query_id is not null then p.n when other = 'overview' then w.n when other = 'search' then f.n else 0 end as n
  from modes m left join paged p using (query_id) left join wide w using (query_id) left join found f using (query_id))
select query_id, mode, case when mode = 'inventory' or coalesce(message, false) then 'answered' when coalesce(n, 0) > 0 then 'no_llm' else 'not_found' end as status,
  cast(case when mode = 'inventory' or coalesce(message, false) then 0 else coalesce(n, 0) end as integer) as n_citations from judged"""

_STORED = f"""{CURRENT}, {chunk_rows('ordinal', 'text')}, left_ as (select * from current_files where coalesce(size % 5 <> 0, true)),
kept as (select f.path_key, c.ordinal, c.text from left_ f join chunk_rows c using (file_id) where not coalesce(f.size % 3 = 0, false) or c.ordinal < 2)"""

_SESSIONS = "s as (select distinct session_id, title, username, coalesce(mode, 'folder') as mode, folder, file_path, created_at, coalesce(updated_at, created_at) as updated_at from sessions), one as (select * from s qualify row_number() over (partition by session_id order by updated_at desc nulls last, title desc nulls last, username desc nulls last, mode desc, folder desc nulls last, file_path desc nulls last, created_at desc nulls last) = 1)"

_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"

# page by page: without margin lines and lines that are only a number
def _page_segments(scanned: bool) -> str:
    """scanned: lines come without blank ones, and hyphens at line ends go before small letters."""
    lines = f"list_filter(list_transform(string_split(text, {LF}), lambda x: {strip('x')}), lambda x: x <> '')" if scanned else f"string_split(text, {LF})"
    shown = "md5(text) as digest, true as ocr" if scanned else "text"
    return f"""with {chunk_rows('text')}, pages_ as (select file_id, chunk_id as doc_id, {lines} as l from chunk_rows where text is not null),
edges as (select distinct file_id, doc_id, {strip('e')} as line from (select file_id, doc_id, unnest(list_concat(l[1:2], l[-2:])) as e from pages_)), total as (select file_id, count(*) as pages from pages_ group by file_id having count(*) >= 3),
margins as (select file_id, line from edges join total using (file_id) where line <> '' group by file_id, line, pages having count(*) >= greatest(3, pages // 2)),
raw as (select file_id, doc_id, unnest(l) as line, generate_subscripts(l, 1) as n from pages_),
kept_lines as (select r.* from raw r left join margins m on m.file_id = r.file_id and m.line = {strip('r.line')} where {strip('r.line')} = '' or m.line is null and not {has(strip('r.line'), r'^\p{Nd}+$')}),
documents_ as (select null::bigint as doc_id, '' as text limit 0), {LINES.partition('raw_lines as')[2].partition('stripped as')[2].join(['stripped as', '']).replace('from raw_lines', 'from kept_lines')},
marked_ as (select file_id, doc_id, string_agg(case when s = '' then {CUT} when heading then {CUT} || {HEAD} || line || {CUT} else line end, {LF} order by n) as marked from lines group by file_id, doc_id),
parts as (select file_id, doc_id, unnest(l) as p, generate_subscripts(l, 1) as k from (select file_id, doc_id, string_split(marked, {CUT}) as l from marked_)),
segs as (select file_id, doc_id, k, starts_with(p, {HEAD}) as is_heading, case when starts_with(p, {HEAD}) then {strip('substr(p, 2)')} else {joined(f'string_split(p, {LF})', scanned)} end as text from parts)
select file_id, cast(row_number() over (partition by file_id order by doc_id, k) - 1 as integer) as n, cast(doc_id as integer) as page, is_heading, {shown} from segs where text <> ''"""


# chunks: units, then a walk over their places, all documents at once
_CHUNKS = f"""with recursive {LINES}, marked_ as (select doc_id, string_agg(case when s = '' then {CUT} when heading then {CUT} || {HEAD} || line || {CUT} else line end, {LF} order by n) as marked from lines group by doc_id),
parts as (select doc_id, unnest(l) as p, generate_subscripts(l, 1) as k from (select doc_id, string_split(marked, {CUT}) as l from marked_)),
segs as (select doc_id, k, starts_with(p, {HEAD}) as h, case when starts_with(p, {HEAD}) then {strip('substr(p, 2)')} else {joined(f'string_split(p, {LF})')} end as text from parts),
cut as (select doc_id, k, h, unnest(l) as u, generate_subscripts(l, 1) as j from (select doc_id, k, h, case when h then [text] else string_split(regexp_replace(text, {q(rf'([.!?]){WS}+(["' + "'" + r'(\[]?[A-Z0-9])')}, '\\1' || {CUT} || '\\2', 'g'), {CUT}) end as l from segs where text <> '')),
sents as (select row_number() over (order by doc_id, k, j) as sid, doc_id, k, j, h, case when h then u else {strip('u')} end as u from cut where h or {strip('u')} <> ''),
toks as (select sid, w, row_number() over (partition by sid order by a, b) as i from (select sid, a, unnest(list_transform(range(0, greatest(1, (length(w) + 849) // 850)), lambda x: substr(w, x * 850 + 1, 850))) as w, unnest(range(0, greatest(1, (length(w) + 849) // 850))) as b from
  (select sid, unnest(l) as w, generate_subscripts(l, 1) as a from (select sid, list_filter(string_split({rr('u', WS + '+', ' ')}, ' '), lambda x: x <> '') as l from sents where not h and length(u) > 850)))),
ends as (select *, sum(length(w) + 1) over (partition by sid order by i) as e from toks),
packs as (select sid, 1 as a, (select max(i) from ends x where x.sid = s.sid and x.e <= 851) as z, 1 as n from (select distinct sid from toks) s
  union all select p.sid, p.z + 1, (select max(x.i) from ends x where x.sid = p.sid and x.e <= 851 + (select y.e from ends y where y.sid = p.sid and y.i = p.z)), p.n + 1 from packs p where p.z < (select max(i) from ends x where x.sid = p.sid)),
fit as (select p.sid, p.n, string_agg(e.w, ' ' order by e.i) as u from packs p join ends e on e.sid = p.sid and e.i between p.a and p.z group by p.sid, p.n),
units as (select doc_id, cast(row_number() over (partition by doc_id order by sid, n) - 1 as bigint) as i, h, u from (select s.doc_id, s.sid, s.h, coalesce(f.u, s.u) as u, coalesce(f.n, 0) as n from sents s left join fit f using (sid))),
sums as (select *, sum(length(u) + 1) over w as after, sum(length(u) + 1) over w - length(u) - 1 as before, max(case when h then i end) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as last_head, max(case when h then i end) over (partition by doc_id order by i) as own_head from units window w as (partition by doc_id order by i)),
back as (select a.doc_id, a.i, min(b.i) as tail from sums a join sums b on b.doc_id = a.doc_id and b.i < a.i and b.before >= a.before - 151 group by a.doc_id, a.i),
steps as (select s.*, coalesce(greatest(coalesce(s.last_head + 1, 0), coalesce(b.tail, s.i)), s.i) as tail from sums s left join back b using (doc_id, i)),
walk as (select doc_id, -1::bigint as i, 0::bigint as first, 0::bigint as fresh, -1::bigint as done_first, -1::bigint as done_last from (select distinct doc_id from units)
  union all select doc_id, i, case when starts or drops then i when over_ then greatest(first, tail) else first end, case when starts or drops or over_ then i else fresh end, case when starts or over_ and not drops then first else -1 end, i - 1
  from (select w.doc_id, s.i, w.first, w.fresh, s.tail, s.h and s.before - f.before >= 300 as starts, s.h and w.first < s.i and s.i = w.fresh as drops, w.first < s.i and s.after - f.before > 1000 as over_
    from walk w join steps s on s.doc_id = w.doc_id and s.i = w.i + 1 join steps f on f.doc_id = w.doc_id and f.i = w.first)),
runs as (select doc_id, done_first as a, done_last as z from walk where done_first >= 0 union all select doc_id, first, i from walk qualify row_number() over (partition by doc_id order by i desc) = 1),
pieces as (select r.doc_id, r.a, r.z, {strip("string_agg(case when s.h then chr(10) || s.u || chr(10) when s.i = r.a or prev_h then s.u else ' ' || s.u end, '' order by s.i)")} as text,
  coalesce(arg_max(substr(s.u, 1, 200), s.i) filter (s.h), arg_min(sec, s.i) filter (sec is not null)) as section
  from runs r join (select x.*, lag(x.h) over (partition by x.doc_id order by x.i) as prev_h, y.u[1:200] as sec from steps x left join steps y on y.doc_id = x.doc_id and y.i = x.own_head) s on s.doc_id = r.doc_id and s.i between r.a and r.z
  group by r.doc_id, r.a, r.z having not bool_and(s.h))
select doc_id as file_id, cast(row_number() over (partition by doc_id order by a, z) - 1 as integer) as ordinal, text, section, null::integer as page_start, null::integer as page_end, false as ocr from pieces"""

# longest common subsequence: rows of the table, each the running maximum of what the row above offers
_ROUGE = f"""with recursive m as (select distinct id, session_id, content from messages where content is not null and session_id is not null),
n as (select *, row_number() over (partition by session_id order by id // 4096, id, content) as n from m),
p as (select b.session_id, b.n, {_TOKENS.format('b.content')} as x, {_TOKENS.format('a.content')} as y from n a join n b on b.session_id = a.session_id and b.n = a.n + 1),
t as (select session_id, n, 0 as k, list_transform(y, lambda e: 0) as l from p where len(x) > 0 and len(y) > 0
  union all select t.session_id, t.n, t.k + 1, list_transform(range(1, len(p.y) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: case when p.y[i] = p.x[t.k + 1] then case when i = 1 then 0 else t.l[i - 1] end + 1 else t.l[i] end)))
  from t join p on p.session_id = t.session_id and p.n = t.n where t.k < len(p.x)),
lcs as (select session_id, n, l[-1] as c from t qualify row_number() over (partition by session_id, n order by k desc) = 1)
select p.session_id, cast(p.n as integer) as n, case when coalesce(c, 0) = 0 then 0.0::double else round_even(2 * (c::double / len(x)) * (c::double / len(y)) / (c::double / len(x) + c::double / len(y)), 4) end as score from p left join lcs on lcs.session_id = p.session_id and lcs.n = p.n"""

ORACLE: dict[str, str] = {
    "hybrid_search": f"with {HYBRID} select query_id, chunk_id, score, relevance, rank from top_hits",
    "question_answers": _ANSWERS,
    "store_files": f"with {_STORED} select f.path_key, f.status, cast(count(k.ordinal) as integer) as num_chunks from left_ f left join kept k using (path_key) group by f.path_key, f.status",
    "store_chunks": f"with {_STORED} select path_key, ordinal, md5(text) as digest, true as in_order from kept",
    "store_cleared": "select 'true,false,true' as emptied, 'kept' as note, 'two' as fingerprint, 0::bigint as n_files, 0::bigint as n_chunks, count(distinct path_key) as n_folders from folders",
    "store_folders": "select path_key, strftime(coalesce(max(synced_at), timestamp '2024-01-01 00:00:00'), '%Y-%m-%d %H:%M:%S') as synced_at from folders group by path_key",
    "sessions_deleted": f"with {_SESSIONS}, gone as (select session_id from one where mode = 'file' and username is not null) select 'sessions' as kind, session_id as key from one where session_id not in (select session_id from gone where session_id is not null) or session_id is null union all select 'messages', cast(id as varchar) from (select distinct id, session_id from messages) where session_id is null or session_id not in (select session_id from gone)",
    "exchanges_added": f"with {_SESSIONS}, e as (select *, row_number() over (order by session_id) - 1 as k from one where mode = 'file') select cast(1000000000 + 2 * k as bigint) as id, session_id, 'user' as role, title as content, null::varchar as citations from e union all select cast(1000000001 + 2 * k as bigint), session_id, 'ai', 'yes', '[]' from e",
    "sessions_used": f"with {_SESSIONS} select session_id, case when mode = 'file' then '2030-01-01 00:00:00' else strftime(updated_at, '%Y-%m-%d %H:%M:%S') end as updated_at from one",
    "sessions_changed": f"with {_SESSIONS} select session_id, title, mode, case when mode = 'folder' then '/elsewhere' else folder end as folder from one union all select 'n-' || session_id, 'new', mode, folder from one where not starts_with(session_id, 'a')",
    "unanswerable_relevance": f"with {DOCS}, {QUESTIONS}, {INDEX}, p as ({best(bm25(ASKED), 30)}) select round(1 / (1 + exp(-max(4.0::double * len(list_intersect(list_distinct(regexp_extract_all(lower(z.text), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(case when coalesce(d.section, '') <> '' then d.section || {LF} || d.text else d.text end), '[a-z0-9]+')))) - 8.0))), 6) as max_relevance from p join questions z using (query_id) join docs d using (chunk_id)",
    "metrics_json": f"with {_EVAL} select * from metrics",
    "overview_chunks": f"with {DOCS}, {_OPENING} select chunk_id, cast(n as integer) as n from opening",
    "excerpts": f"""with {DOCS}, {QUESTIONS}, {INDEX}, p as ({best(bm25(ASKED), 6)}) select query_id, cast(rank as integer) as ref, md5('[' || rank || '] ' || concat_ws(' — ', nullif(name, ''), nullif({label('page_start', 'page_end')}, ''), nullif(section, ''), case when ocr then 'scanned text (OCR)' end) || {LF} || coalesce(text, '')) as digest from p join docs using (chunk_id)""",
    "file_texts": f"with {CURRENT} select path_key, 'This chat is about one file: **' || {escaped('name')} || '**' || case when {_STATE} <> '' then ' (' || {_STATE} || ')' else '' end || ', in `' || regexp_replace(path, '/[^/]*$', '') || '`.' as text from current_files",
    "page_segments": _page_segments(False),
    "scanned_pages": _page_segments(True),
    # words in two columns: with six or more the columns are told apart, the left one is read first
    "layout_lines": f"""with {DOCUMENTS}, w as (select doc_id, list_filter(string_split({rr('text', WS + '+', ' ')}, ' '), lambda x: x <> '') as l from documents_),
      e as (select doc_id, len(l) as n, unnest(l) as word, generate_subscripts(l, 1) - 1 as i from w),
      two as (select doc_id, case when i % 2 = 0 then i // 2 else (n + 1) // 2 + 1 + i // 2 end as k, word as line from e where n >= 6 union all select doc_id, (len(l) + 1) // 2, '' from w where len(l) >= 6
        union all select doc_id, i // 2, string_agg(word, ' ' order by i) from e where n < 6 group by doc_id, i // 2)
      select doc_id as file_id, 1 as page, cast(k + 1 as integer) as line_no, line from two""",
    "chunk_documents": _CHUNKS,
    "rouge_l": _ROUGE,
}
