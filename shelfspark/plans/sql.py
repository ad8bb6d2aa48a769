"""SQL of the library's queries, for DuckDB: the same results by other means."""

from __future__ import annotations

from shelfspark.config import Settings
from shelfspark.functions import questions as ask
from shelfspark.functions.text import KNOWN_SECTIONS, MARKED, NUMBERED, STOPWORDS, UNMARKED, WS
from shelfspark.operators.library import STATE_LABELS
from shelfspark.operators.metrics import STOP
from shelfspark.operators.passages import BACK_MATTER

S = Settings()


def q(s: str) -> str:
    """A string as a literal."""
    return "'" + s.replace("'", "''") + "'"


def rr(e: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({e}, {q(pattern)}, {q(by)}, 'g')"


def has(e: str, pattern: str) -> str:
    return f"regexp_matches({e}, {q(pattern)})"


def strip(e: str) -> str:
    return rr(e, f"^{WS}+|{WS}+$")


def words(e: str) -> str:
    return f"length({rr(rr(e, f'[^{WS[1:-1]}]+', 'x'), f'{WS}+')})"


def some(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


LF, CUT, HEAD = "chr(10)", "chr(1)", "chr(2)"


def tidy(e: str) -> str:
    e = f"replace(replace({e}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return rr(rr(e, rf"\x02{WS}*\n{WS}*"), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{fffe}\x{ffff}]")


def joined(lines: str, scanned: bool = False) -> str:
    text = f"array_to_string(list_filter(list_transform({lines}, lambda x: {strip('x')}), lambda x: x <> ''), {LF})"
    text = rr(text, r"-\n(\p{Ll})", r"\1") if scanned else text
    return rr(rr(text, r"-\n(\p{L})", r"-\1"), r"\n", " ")


DOCUMENTS = f"documents_ as (select doc_id, {tidy('text')} as text from documents where text is not null)"

#: Lines with what decides whether they are headings.
LINES = f"""{DOCUMENTS},
raw_lines as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as n from (select doc_id, string_split(text, {LF}) as l from documents_)),
stripped as (select *, {strip('line')} as s from raw_lines),
measured as (select *, length({rr('s', r'[^\p{L}]')}) as letters, length({rr('s', r'[^\p{Lu}]')}) as capitals, length({rr('s', WS)}) as solid, {rr('s', NUMBERED)} as core, {words('s')} as n_words from stripped),
lines as (select *, length(s) between 3 and 90 and letters >= 3 and n_words <= 12 and not {has('s', '[.,;]$')} and letters >= 0.5 * solid and (
  {rr('lower(core)', ':+$')} in {some(KNOWN_SECTIONS)} or letters >= 4 and {words('core')} >= 2 and letters >= 0.7 * solid and capitals > 0.9 * letters
  or {has('s', NUMBERED)} and {has('core', r'^\p{Lu}')} and {words('core')} <= 8) as heading from measured)"""

SEGMENTED = f"""parts as (select doc_id, unnest(l) as p, generate_subscripts(l, 1) as k from (select doc_id, string_split(marked, {CUT}) as l from marked_)),
segments as (select doc_id, k, starts_with(p, {HEAD}) as is_heading, case when starts_with(p, {HEAD}) then {strip('substr(p, 2)')} else {joined(f'string_split(p, {LF})')} end as text from parts)
select doc_id, row_number() over (partition by doc_id order by k) as seg_no, md5(text) as digest, is_heading from segments where text <> ''"""

_MD = r"^\s{0,3}#{1,6}\s+(.*?)\s*#*\s*$"

CURRENT = """current_files as (select * from files where path_key is not null qualify row_number() over (partition by path_key order by indexed_at desc nulls last, file_id desc nulls last, path desc nulls last, name desc nulls last, ext desc nulls last, size desc nulls last, mtime desc nulls last, status desc nulls last, error desc nulls last, num_pages desc nulls last, num_chunks desc nulls last, ocr_pages desc nulls last) = 1)"""


def chunk_rows(*columns: str) -> str:
    return f"chunk_rows as (select distinct {', '.join(('chunk_id', 'file_id', *columns))} from chunks where chunk_id is not null and file_id is not null)"


DOCS = f"""{CURRENT}, {chunk_rows('ordinal', 'text', 'section', 'page_start', 'page_end', 'ocr')},
docs as (select c.*, f.path_key, f.path, f.name, f.num_pages from chunk_rows c join current_files f using (file_id))"""

ANCESTORS = """(select path_key, unnest(list_transform(range(2, len(p)), lambda n: array_to_string(p[1:n], '/'))) as folder_key from (select *, string_split(path_key, '/') as p from current_files))"""

_WORD = r"[\p{L}\p{N}_]+"


def tokens(e: str) -> str:
    plain = rr(f"lower(coalesce({e}, ''))", r"\p{Mn}")
    return f"regexp_extract_all(translate({plain}, {q(MARKED)}, {q(UNMARKED)}), {q(r'[\p{L}\p{N}]+')})"


def terms(source: str, key: str, text: str, most: str = " qualify row_number() over (partition by {key} order by n) <= 32") -> str:
    """Rows (key, term) of the search terms of a text, at most 32, or all."""
    return f"""(select {key}, w as term, n from (select {key}, w, min(n) as n from (select {key}, unnest(l) as w, generate_subscripts(l, 1) as n from (select {key}, regexp_extract_all(lower({text}), {q(_WORD)}) as l from {source}))
  where length(w) > 1 and w not in {some(STOPWORDS)} group by {key}, w){most.format(key=key)})"""


QUESTIONS = "questions as (select distinct id as query_id, content as text from messages where id % 50 = 0 and content is not null)"

INDEX = f"""fields as (select chunk_id, unnest({tokens('text')}) as term, 1.0::double as w from docs union all select chunk_id, unnest({tokens('section')}), 0.6 from docs union all select chunk_id, unnest({tokens('name')}), 0.3 from docs),
hits as (select term, chunk_id, sum(w) as f from fields group by term, chunk_id),
sizes as (select chunk_id, len({tokens('text')}) + len({tokens('section')}) + len({tokens('name')}) as len from docs),
corpus as (select count(*) as n_docs, avg(len) as avg_len from sizes),
df as (select term, count(*) as n from hits group by term)"""


def bm25(asked: str, where: str = "true") -> str:
    """Scores of (query_id, term) rows."""
    return f"""select a.query_id, h.chunk_id, sum(case when ln((c.n_docs - d.n + 0.5) / (d.n + 0.5)) <= 0 then 1e-6 else ln((c.n_docs - d.n + 0.5) / (d.n + 0.5)) end
  * h.f * {S.k1 + 1} / (h.f + {S.k1} * (1 - {S.b} + {S.b} * s.len / c.avg_len))) as score
  from {asked} a join hits h using (term) join df d using (term) join sizes s on s.chunk_id = h.chunk_id cross join corpus c where {where} group by a.query_id, h.chunk_id"""


def best(scored: str, k: int, digits: int = 9) -> str:
    return f"select query_id, chunk_id, score, row_number() over (partition by query_id order by round(score, {digits}) desc, chunk_id) as rank from ({scored}) qualify rank <= {k}"


def shown(ranked: str) -> str:
    return f"select query_id, chunk_id, round(score, 6) as score, cast(rank as integer) as rank from ({ranked})"


ASKED = terms("questions", "query_id", "text")


def label(first: str, last: str) -> str:
    return f"case when {first} is null then '' when coalesce({last}, 0) <> 0 and {last} <> {first} then 'pp. ' || {first} || '–' || {last} else 'p. ' || {first} end"


# page references: Java's patterns, with the sign of a word's edge as DuckDB has it
def _num(t: str) -> str:
    pairs = " ".join(f"when '{word}' then {n}" for word, n in ask.NUMBERS.items())
    return f"case {t} {pairs} else try_cast({rr(t, chr(92) + 'D')} as integer) end"


def _get(name: str, group: int = 1) -> str:
    return _num(f"regexp_extract(u, {q(ask.PAGES[name])}, {group})")


_LOW, _HIGH = (f"{f}({_get('from to')}, {_get('from to', 2)})" for f in ("least", "greatest"))
_FOUND = {
    "last n": f"range(-least({_get('last n')}, 10), 0)",
    "first n": f"range(1, least({_get('first n')}, 10) + 1)",
    "from to": f"range({_LOW}, least({_HIGH}, {_LOW} + 9) + 1)",
    "two": f"list_sort(list_distinct([{_get('two')}, {_get('two', 2)}]))",
    "last but one": "[-2]",
    "last": "[-1]",
    "front": "[1]",
    "nth": f"[{_get('nth')}]",
    "number": f"[{_get('number')}]",
}
PAGES = "case " + " ".join(f"when {has('u', ask.PAGES[name])} then {found}" for name, found in _FOUND.items()) + " end"

MODE = f"""case when ({PAGES}) is not null then 'pages' when {has('content', '(?i)' + ask.OVERVIEW)} then 'overview'
  when {has('content', '(?i)' + ask.INVENTORY)} and not {has('content', '(?i)' + ask.ABOUT_CONTENT)} then 'inventory' else 'search' end"""

_STATE = "case when status is null then 'not indexed yet' when status = 'indexed' then concat_ws(', ', case when coalesce(num_pages, 0) <> 0 then num_pages || case when num_pages = 1 then ' page' else ' pages' end end, case when coalesce(ocr_pages, 0) <> 0 then case when ocr_pages is not distinct from num_pages then 'read with OCR' else 'partly read with OCR' end end) " + " ".join(f"when status = {q(k)} then {q(v)}" for k, v in STATE_LABELS.items()) + " else status end"


def escaped(e: str) -> str:
    return rr(e, r"([\\`*_\[\]<>#|])", r"\\\1")


def key_terms(e: str) -> str:
    found = f"list_filter(regexp_extract_all(lower({e}), {q(r'[a-z0-9]+(?:\.[0-9]+)?')}), lambda w: (length(w) >= 3 or {has('w', '^[0-9]')}) and w not in {some(STOP)})"
    return f"list_distinct(list_transform({found}, lambda w: case when {has('w', '^[0-9]')} then w else {rr('w', '(ing|ed|es|s)$')} end))"


def _eval(asked: str) -> str:
    return f"""{DOCS}, {INDEX},
truth as (select c.chunk_id as query_id, f.path_key, c.text as reference from (select distinct chunk_id, file_id, text from chunks where chunk_id % 50 = 0 and file_id is not null and text is not null) c join current_files f using (file_id)),
found as (select r.*, d.path_key as p, d.text from ({best(bm25(asked), 6)}) r join docs d using (chunk_id)),
per as (select f.query_id, min(case when f.p = t.path_key then rank end) as first, count(*) as n, count(case when f.p = t.path_key then 1 end) as n_right, list_distinct(flatten(list({key_terms('f.text')}))) as found from found f join truth t using (query_id) group by f.query_id),
metrics as (select t.query_id, p.first is not null as file_hit, round(coalesce(1.0::double / p.first, 0), 4) as mrr, round(coalesce(p.n_right::double / greatest(p.n, 1), 0), 4) as precision,
  round(coalesce(len(list_intersect({key_terms('t.reference')}, coalesce(p.found, []))), 0)::double / greatest(len({key_terms('t.reference')}), 1), 4) as ctx_recall from truth t left join per p using (query_id))"""


_EVAL, _EVAL_WHOLE = _eval(terms("truth", "query_id", "reference")), _eval(terms("truth", "query_id", "reference", ""))

_SPREAD = f"""{chunk_rows('ordinal', 'section')},
flagged as (select *, coalesce({has('section', BACK_MATTER)}, false) as back from chunk_rows),
body as (select *, row_number() over w - 1 as i, lag(section) over w as above, row_number() over w > 1 as has from (select *, bool_and(back) over (partition by file_id) as only_back from flagged) where not back or only_back window w as (partition by file_id order by ordinal // 1024, ordinal, chunk_id)),
starts_ as (select *, has and section is distinct from above as starts from body),
sized as (select *, count(*) over (partition by file_id) as n, count(*) filter (starts) over (partition by file_id) as n_starts, sum(starts::int) over (partition by file_id order by i) - 1 as s from starts_),
first_pick as (select *, i = 0 or starts and (n_starts <= 9 or s in (select unnest(list_transform(range(0, 9), lambda j: cast(round_even(j * (n_starts - 1) / 8.0, 0) as bigint))))) as chosen from sized where n > 10),
counted as (select *, count(*) filter (chosen) over (partition by file_id) as got, sum((not chosen)::int) over (partition by file_id order by i) - 1 as r from first_pick),
filled as (select *, 10 - got as want, n - got as rest from counted),
final as (select file_id, chunk_id, ordinal from sized where n <= 10 union all select file_id, chunk_id, ordinal from filled where chosen or want >= rest or want = 1 and r = 0 or want > 1 and list_contains(list_transform(range(0, want), lambda j: cast(round_even(j * (rest - 1) / (want - 1)::double, 0) as bigint)), r))"""

_DOT = "list_dot_product(list_transform({a}, lambda x: x::double), list_transform({b}, lambda x: x::double))"


def cosine(a: str, b: str) -> str:
    return f"{_DOT.format(a=a, b=b)} / sqrt({_DOT.format(a=a, b=a)}) / sqrt({_DOT.format(a=b, b=b)})"


_SESSION_ROWS = "s as (select distinct session_id, title, username, coalesce(mode, 'folder') as mode, folder, file_path, created_at, coalesce(updated_at, created_at) as updated_at, updated_at as u, mode as m from sessions)"
_RECENT = """recent as (select session_id, row_number() over (partition by session_id order by back desc) as n, id, case when role in ('ai', 'assistant') then 'assistant' else 'user' end as role, content from (
  select *, row_number() over (partition by session_id order by id desc, role desc nulls last, content desc nulls last) as back from (select distinct id, session_id, role, content from messages where session_id is not null and id is not null)) where back <= 6)"""

_LAST_RUN = """found as (select path_key, size, mtime from (select * from scan_entries where run_id = (select max(run_id) from sync_runs where state = 'done') and path_key is not null qualify row_number() over (partition by path_key order by seen_at desc nulls last, entry_id desc nulls last) = 1) where size is not null and mtime is not null),
plan as (select coalesce(f.path_key, k.path_key) as path_key, case when f.path_key is null then 'gone' when k.path_key is null then 'new' when not coalesce(f.size = k.size and abs(f.mtime - k.mtime) <= 0.001, false) then 'changed' when k.status = 'needs_ocr' then 'retry' else 'unchanged' end as action from found f full join current_files k on f.path_key = k.path_key)"""

_OF_FOLDERS = f"of as (select a.folder_key, f.* from {ANCESTORS} a join current_files f using (path_key) join (select distinct path_key as folder_key from folders) using (folder_key))"

_AREA = "(b.x1 - b.x0) * (b.y1 - b.y0) / (612.0 * 792.0)"

ORACLE: dict[str, str] = {
    "tidy_text": f"select doc_id, md5({tidy('text')}) as digest from documents",
    "search_terms": f"with m as (select distinct id, content from messages), t as {terms('m', 'id', 'content')} select m.id, case when m.content is null then null else coalesce(string_agg(t.term, ' ' order by t.n), '') end as terms from m left join t on t.id = m.id group by m.id, m.content",
    "token_counts": f"with {DOCUMENTS} select doc_id, len(l) as n_tokens, len(list_distinct(l)) as n_distinct from (select doc_id, regexp_extract_all(lower(text), {q(_WORD)}) as l from documents_)",
    "heading_lines": f"with {LINES} select doc_id, n as line_no, s as heading from lines where heading",
    "line_segments": f"with {LINES}, marked_ as (select doc_id, string_agg(case when s = '' then {CUT} when heading then {CUT} || {HEAD} || line || {CUT} else line end, {LF} order by n) as marked from lines group by doc_id), {SEGMENTED}",
    "block_segments": f"""with {LINES}, cuts as (select *, sum((s = '')::int) over (partition by doc_id order by n) as block from lines),
      blocks as (select doc_id, block, count(*) as k, bool_and(heading) as head, string_agg(line, {LF} order by n) as t from cuts where s <> '' group by doc_id, block),
      segments as (select doc_id, block, k = 1 and head as is_heading, case when k = 1 and head then {strip('t')} else {joined(f'string_split(t, {LF})')} end as text from blocks)
      select doc_id, row_number() over (partition by doc_id order by block) as seg_no, md5(text) as digest, is_heading from segments where text <> ''""",
    "markdown_segments": f"with {LINES}, marked_ as (select doc_id, string_agg(case when s = '' then {CUT} when {has('line', _MD)} then {CUT} || {HEAD} || regexp_extract(line, {q(_MD)}, 1) || {CUT} else line end, {LF} order by n) as marked from lines group by doc_id), {SEGMENTED}",
    "simple_sentences": f"""with {DOCUMENTS}, parts as (select doc_id, unnest(l) as p, generate_subscripts(l, 1) as k from (select doc_id, string_split(regexp_replace(text, {q(rf'([.!?]){WS}+(["' + "'" + r'(\[]?[A-Z0-9])')}, '\\1' || {CUT} || '\\2', 'g'), {CUT}) as l from documents_)),
      kept as (select doc_id, k, {strip('p')} as s from parts) select doc_id, row_number() over (partition by doc_id order by k) as n, length(s) as n_chars, md5(s) as digest from kept where s <> ''""",
    "margin_lines": f"""with {chunk_rows('text')}, pages as (select file_id, chunk_id, string_split(text, {LF}) as l from chunk_rows where text is not null),
      edges as (select distinct file_id, chunk_id, {strip('e')} as line from (select file_id, chunk_id, unnest(list_concat(l[1:2], l[-2:])) as e from pages)), total as (select file_id, count(*) as pages from pages group by file_id having count(*) >= 3),
      n as (select file_id, line, count(*) as n from edges where line <> '' group by all) select n.file_id, n.line, n.n from n join total t using (file_id) where n.n >= greatest(3, t.pages // 2)""",
    "embedding_texts": rf"""with {DOCS}, t as (select *, translate(regexp_replace(name, '([^.])\.[^.]*$', '\1'), '_-', '  ') as title from docs where text is not null)
      select chunk_id, md5(case when coalesce(section, '') <> '' then title || ' — ' || section else title end || {LF} || text) as digest, md5(case when coalesce(section, '') <> '' then section || {LF} || text else text end) as passage_digest from t""",
    "page_labels": f"with {chunk_rows('page_start', 'page_end')} select chunk_id, {label('page_start', 'page_end')} as label from chunk_rows",
    "escaped_names": f"with {CURRENT} select path_key, {escaped('name')} as escaped from current_files",
    "cited_refs": rf"""select id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace(content, '【(\d+)(?:†[^】]*)?】', '[\1]', 'g'), '\[(\d{{1,9}})\]', 1), lambda x: x::integer))), ',') as refs from (select distinct id, content from messages where content is not null)""",
    "clean_queries": f"""with a as (select id, regexp_extract({strip('content')}, {q(r'^([^\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]*)')}, 1) as l from (select distinct id, content from messages where content is not null)),
      b as (select id, {strip(rr(rr(strip('l'), '^"+|"+$'), "^'+|'+$"))} as l from a) select id, case when l = '' then '?' else substr(l, 1, 300) end as query from b""",
    "page_references": f"select id, array_to_string(pages, ',') as pages from (select id, {PAGES} as pages from (select distinct id, content, lower(content) as u from messages where content is not null)) where pages is not null",
    "question_modes": f"select id, {MODE} as mode from (select distinct id, content, lower(content) as u from messages where content is not null)",
    "term_statistics": f"with {DOCS}, {INDEX} select term, n from df",
    "bm25_search": f"with {DOCS}, {QUESTIONS}, {INDEX} {shown(best(bm25(ASKED), 10))}",
    "bm25_scoped": f"with {DOCS}, {QUESTIONS}, {INDEX} {shown(best(bm25(ASKED, 'h.chunk_id in (select chunk_id from docs where starts_with(path_key, ' + q('/library/scans/') + '))'), 10))}",
    "vector_topk": f"select query_id, chunk_id, round(score, 6) as score, cast(row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as integer) as rank from (select a.vec_id as query_id, b.vec_id as chunk_id, {cosine('a.embedding', 'b.embedding')} as score from embeddings a, embeddings b where a.vec_id % 50 = 0) qualify rank <= 10",
    "vector_topk_scoped": f"select query_id, chunk_id, round(score, 6) as score, cast(row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as integer) as rank from (select a.vec_id as query_id, b.vec_id as chunk_id, {cosine('a.embedding', 'b.embedding')} as score from embeddings a, embeddings b where a.vec_id % 50 = 0 and b.label = 3) qualify rank <= 10",
    "unit_vectors": "select vec_id, round(v[1]::double / norm, 6) as first, round(list_sum(list_transform(v, lambda x: x::double)) / norm, 6) as total from (select vec_id, embedding as v, sqrt(list_dot_product(list_transform(embedding, lambda x: x::double), list_transform(embedding, lambda x: x::double))) as norm from embeddings)",
    "hashed_words": """with w as (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from (select distinct item_id, text from benchmark where text is not null)),
      c as (select item_id, cast((((p1 % 384 * 256 + p2) % 384 * 256 + p3) % 384 * 256 + p4) % 384 as integer) as place, count(*)::double as n from
        (select item_id, cast('0x' || substr(h, 1, 8) as bigint) as p1, cast('0x' || substr(h, 9, 8) as bigint) as p2, cast('0x' || substr(h, 17, 8) as bigint) as p3, cast('0x' || substr(h, 25, 8) as bigint) as p4 from (select item_id, md5(w) as h from w)) group by all),
      norm as (select item_id, sqrt(sum(n * n)) as norm from c group by item_id) select c.item_id, c.place, round(c.n / norm.norm, 6) as value from c join norm using (item_id)""",
    "fused_ranks": f"""with {DOCS}, {QUESTIONS}, {INDEX}, b as ({best(bm25(ASKED), 50)}),
      a as ({best(f"select t.query_id, h.chunk_id, count(*)::double as score from {ASKED} t join (select distinct chunk_id, term from fields where w = 1.0) h using (term) group by all", 50)}),
      f as (select query_id, chunk_id, a.rank as ra, b.rank as rb, coalesce(1.0::double / (60 + a.rank), 0) + coalesce(1.0::double / (60 + b.rank), 0) as fused from a full join b using (query_id, chunk_id))
      select query_id, chunk_id, round(fused, 9) as fused, cast(row_number() over (partition by query_id order by round(fused, 12) desc, ra nulls last, rb nulls last) as integer) as place from f qualify place <= 30""",
    "rerank_scores": f"""with {DOCS}, {QUESTIONS}, {INDEX}, p as ({best(bm25(ASKED), 30)}),
      s as (select p.query_id, p.chunk_id, p.rank as place, 4.0::double * len(list_intersect(list_distinct(regexp_extract_all(lower(z.text), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(case when coalesce(d.section, '') <> '' then d.section || {LF} || d.text else d.text end), '[a-z0-9]+')))) - 8.0 as score from p join questions z using (query_id) join docs d using (chunk_id))
      select query_id, chunk_id, score, round(1 / (1 + exp(-score)), 6) as relevance, cast(row_number() over (partition by query_id order by round(score, 4) desc, place) as integer) as rank from s qualify rank <= 6""",
    "scope_files": f"with {CURRENT}, x as (select distinct path_key as folder_key from folders) select x.folder_key, f.path_key from x join current_files f on starts_with(f.path_key, x.folder_key || '/')",
    "chunks_on_pages": f"""with {CURRENT}, {chunk_rows('ordinal', 'page_start', 'page_end')} select f.file_id as query_id, c.chunk_id, cast(row_number() over (partition by f.file_id order by c.ordinal, c.chunk_id) as integer) as n from current_files f join chunk_rows c using (file_id)
      where 1 between page_start and page_end or f.num_pages between page_start and page_end or f.num_pages // 2 between page_start and page_end qualify n <= 12""",
    "edge_chunks": f"""with {chunk_rows('ordinal')} select file_id, chunk_id, 'first' as edge from chunk_rows qualify row_number() over (partition by file_id order by ordinal nulls first, chunk_id) <= 3
      union all select file_id, chunk_id, 'last' from chunk_rows qualify row_number() over (partition by file_id order by ordinal desc nulls last, chunk_id desc) <= 3""",
    "page_answers": f"""with {CURRENT}, z as (select m.id as query_id, f.*, {PAGES} as wanted from (select distinct id, content, lower(content) as u from messages where content is not null) m join current_files f on f.file_id = m.id % (select max(file_id) from current_files) + 1),
      r as (select *, list_sort(list_distinct(list_transform(wanted, lambda p: case when p > 0 then p else num_pages + 1 + p end))) as resolved from z where len(wanted) > 0),
      t as (select *, list_filter(resolved, lambda p: p between 1 and num_pages) as there, case when num_pages is null and (list_max(wanted) < 0 or list_distinct(wanted) = [1]) then case when wanted[1] < 0 then 'last' else 'first' end end as edge from r)
      select query_id, file_id, case when num_pages is not null then array_to_string(there, ',') end as pages, edge, case when num_pages is null then case when edge is null then name || ' has no page numbers (only PDFs and multi-page images do).' end
      when len(there) = 0 then name || ' has ' || num_pages || case when num_pages = 1 then ' page' else ' pages' end || ', so there is no page ' || array_to_string(resolved, ', ') || '.' end as message from t""",
    "overview_spread": f"with {_SPREAD} select file_id, chunk_id, ordinal from final",
    "sync_plan": f"with {CURRENT}, {_LAST_RUN} select path_key, action from plan",
    "sync_report": f"with {CURRENT}, {_LAST_RUN} select count(*) filter (action <> 'gone') as files_found, count(*) filter (action in ('new', 'changed', 'retry')) as to_index, count(*) filter (action = 'gone') as removed, count(*) filter (action = 'unchanged') as unchanged from plan",
    "folder_summary": f"""with {CURRENT}, x as (select path_key, max(synced_at) as synced_at from folders group by path_key) select x.path_key, x.synced_at, count(*) filter (f.status = 'indexed') as files_indexed, count(f.status) as files_total, cast(coalesce(sum(f.num_chunks), 0) as bigint) as chunks,
      count(*) filter (f.status = 'indexed' and f.ocr_pages > 0) as files_ocr from x left join current_files f on starts_with(f.path_key, x.path_key || '/') group by x.path_key, x.synced_at""",
    "folder_issues": f"with {CURRENT}, {_OF_FOLDERS} select folder_key, cast(row_number() over (partition by folder_key order by name nulls first, path_key) as integer) as n, path, status, error from of where status <> 'indexed' qualify n <= 50",
    "folder_inventory": f"""with {CURRENT}, a as (select * from {ANCESTORS}), own as (select path_key, max(length(folder_key)) as l from a group by path_key),
      d as (select a.folder_key, count(*) as n_docs, count(*) filter (length(a.folder_key) = own.l) as n_own from a join own using (path_key) group by a.folder_key), f as (select distinct folder_key from a)
      select d.folder_key, n_docs, n_own, (select count(*) from f where starts_with(f.folder_key, d.folder_key || '/')) as n_dirs from d""",
    "folder_listing": f"with {CURRENT}, {_OF_FOLDERS} select folder_key, cast(row_number() over (partition by folder_key order by lower(name) nulls first, path_key) as integer) as n, '- ' || {escaped('name')} || case when {_STATE} <> '' then ' — ' || {_STATE} else '' end as line from of qualify n <= 80",
    "file_states": f"""with {CURRENT}, {chunk_rows()}, c as (select file_id, count(*) as n from chunk_rows group by file_id), t as (select f.file_id, f.size, case when status = 'error' then error end as error, ocr_pages, case when status = 'needs_ocr' then 1 else 0 end as needed, coalesce(c.n, 0) as n from current_files f left join c using (file_id)),
      s as (select *, case when size > 50 * 1024 * 1024 then 'too_large' when error is not null then 'error' when n = 0 and needed > 0 then 'needs_ocr' when n = 0 then 'no_text' else 'indexed' end as status from t)
      select file_id, status, case status when 'too_large' then 'Larger than 50 MB' when 'error' then error when 'needs_ocr' then 'Scanned, no text layer: OCR is turned off' when 'no_text' then case when coalesce(ocr_pages, 0) > 0 then 'No readable text found, even with OCR' else 'No extractable text' end
      else case when needed > 0 then needed || ' scanned page(s) skipped: OCR is turned off' end end as note, n as num_chunks from s""",
    "session_list": f"with {_SESSION_ROWS} select username, cast(row_number() over (partition by username order by updated_at desc nulls last, session_id) as integer) as n, session_id, mode from s",
    "messages_view": "with v as (select distinct id, session_id, role, content, created_at, citations from messages) select id, case when role in ('ai', 'assistant') then 'assistant' else 'user' end as role, cast(max(case when json_valid(citations) then json_array_length(citations) else 0 end) as bigint) as n_citations from v group by 1, 2",
    "recent_turns": f"with {_RECENT} select session_id, cast(n as integer) as n, id, role from recent",
    "history_text": f"with {_RECENT} select session_id, md5(string_agg(case role when 'user' then 'User: ' else 'Assistant: ' end || substr(coalesce(content, ''), 1, 600) || case when length(content) > 600 then '…' else '' end, {LF} order by n)) as digest from recent group by session_id",
    "session_titles": r"select session_id, case when length(c) <= 60 then c else substr(c, 1, 57) || '…' end as title from (select session_id, first(content order by id, content) as c from messages where coalesce(role, '') not in ('ai', 'assistant') and session_id is not null and regexp_matches(content, '[^\s\p{Z}\x{85}\x{1c}-\x{1f}\x{200B}\x{FEFF}]') group by session_id)",
    "retrieval_metrics": f"with {_EVAL_WHOLE} select * from metrics",
    "retrieval_totals": f"with {_EVAL} select count(*) as queries, round(avg(file_hit::int), 4) as file_hit, round(avg(mrr), 4) as mrr, round(avg(precision), 4) as precision, round(avg(ctx_recall), 4) as ctx_recall from metrics",
    "ocr_plan": f"""with {chunk_rows('text')}, p as (select chunk_id, length(text) as chars, case when chunk_id % 10 < 2 then [] else [{{x0: 0.0::double, y0: 50.0::double, x1: least(100 + 60 * (chunk_id % 10), 612)::double, y1: 500.0::double}}, {{x0: 50.0::double, y0: 700.0::double, x1: 120.0::double, y1: 792.0::double}}] end as boxes from chunk_rows where text is not null),
      c as (select *, least(1, coalesce(list_sum(list_transform(boxes, lambda b: {_AREA})), 0)) as covered from p)
      select chunk_id, case when len(boxes) > 0 then case when chars < 25 or chars < 250 and covered >= 0.3 then 'full' when covered >= 0.3 and chunk_id % 7 <> 0 and len(list_filter(boxes, lambda b: {_AREA} >= 0.08)) > 0 then 'regions' end end as plan from c""",
}
