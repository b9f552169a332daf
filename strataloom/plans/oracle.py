"""SQL twins of plans.queries, in DuckDB's dialect. They share fragments but no code with the DataFrame plans."""

from __future__ import annotations

_NOISE = "('icindekiler','sekiller listesi','tablolar listesi','sekil listesi','tablo listesi')"
_TOKENS = r"regexp_extract_all(lower(strip_accents({})), '[\p{{L}}\p{{N}}_]+')"
_WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> ''))"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_SENTENCES = r"string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def _strip(x: str) -> str:
    return _STRIP.format(x)


_MARKDOWN = """
md0 as (select doc_id as document_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents where text is not null),
md as (
  select document_id, string_agg(
    case when i % 5 = 0 then '<!-- Page ' || (i // 5 + 1) || ' -->' || chr(10) else '' end
    || case when i % 3 = 0 then repeat('#', [1, 2, 3, 2, 4][(i // 3) % 5 + 1]) || ' ' || case when i % 15 = 12 then 'İçindekiler' else 'Part ' || i end || chr(10) else '' end
    || x, chr(10) order by i) as text
  from md0 group by document_id)"""

_SECTIONS = (
    _MARKDOWN
    + r""",
ln0 as (select document_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as no from md),
ln1 as (select *, """
    + _strip("raw")
    + r""" as line from ln0),
ln2 as (select *, regexp_extract(line, '^<!-- Page (\d+) -->', 1) as marker from ln1),
ln3 as (select *, marker = '' and regexp_matches(line, '^(#{1,5})\s+(.+)$') as is_head from ln2),
ln4 as (select *, coalesce(last_value(case when marker <> '' then marker::int end ignore nulls) over (partition by document_id order by no rows unbounded preceding), 1) as page,
    sum(is_head::int) over (partition by document_id order by no rows unbounded preceding) as seq from ln3),
sec as (
  select document_id, seq, max(case when is_head then length(regexp_extract(line, '^(#{1,5})\s+(.+)$', 1)) end) as level,
    max(case when is_head then """
    + _strip(r"regexp_extract(line, '^(#{1,5})\s+(.+)$', 2)")
    + r""" end) as heading,
    """
    + _strip("coalesce(string_agg(raw, chr(10) order by no) filter (where not is_head and marker = ''), '')")
    + r""" as content,
    max(case when is_head then no end) as start_line, max(no) as end_line, max(case when is_head then page end) as start_page, max(page) as end_page
  from ln4 where seq > 0 group by document_id, seq),
nod as (select document_id, seq::int as node_id, level, heading, content, start_line, end_line, start_page, end_page,
    (select max(b.seq)::int from sec b where b.document_id = a.document_id and b.seq < a.seq and b.level < a.level) as parent_id from sec a)"""
)

_TREE = (
    _SECTIONS
    + f""",
kept as (select * from nod where {_strip("lower(strip_accents(heading))")} not in {_NOISE}),
par as (select k.* replace (case when p.node_id is null then null else k.parent_id end as parent_id) from kept k left join kept p on p.document_id = k.document_id and p.node_id = k.parent_id),
tree as (select p.*, case when exists (select 1 from par c where c.document_id = p.document_id and c.parent_id = p.node_id) then 0 else 1 end as is_leaf from par p)"""
)

_UP = """,
up as (select document_id, node_id, node_id as a from tree union all select u.document_id, u.node_id, t.parent_id from up u join tree t on t.document_id = u.document_id and t.node_id = u.a where t.parent_id is not null)"""

_FOLDED = (
    _SECTIONS
    + f""",
kept as (select * from nod where {_strip("lower(strip_accents(heading))")} not in {_NOISE}),
par as (select k.* replace (case when p.node_id is null then null else k.parent_id end as parent_id) from kept k left join kept p on p.document_id = k.document_id and p.node_id = k.parent_id),
climb as (select document_id, node_id, node_id as a, level as l, parent_id as p from par
  union all select c.document_id, c.node_id, t.node_id, t.level, t.parent_id from climb c join par t on t.document_id = c.document_id and t.node_id = c.p where c.l > 2),
home as (select document_id, node_id, a as home from climb where l <= 2),
fold as (select h.document_id, h.home as node_id, string_agg(regexp_replace(chr(10) || chr(10) || repeat('#', k.level) || ' ' || k.heading || chr(10) || k.content, '\\s+$', ''), '' order by k.node_id) as t,
    arg_max(k.end_page, k.node_id) as e from par k join home h on h.document_id = k.document_id and h.node_id = k.node_id where k.level > 2 group by 1, 2),
top as (select * from par where level <= 2)
select t.document_id, t.node_id, t.level, t.parent_id, case when exists (select 1 from top c where c.document_id = t.document_id and c.parent_id = t.node_id) then 0 else 1 end as is_leaf,
  coalesce(f.e, t.end_page) as end_page, md5(case when f.t is null then t.content else {_strip("t.content || f.t")} end) as content_md5
from top t left join fold f on f.document_id = t.document_id and f.node_id = t.node_id"""
)


def _chunks(source: str, keys: str) -> str:
    """source: rows with the keys and clean prose c. The fold walks the sentences of each row."""
    return f"""
snt as (select {keys}, {_SENTENCES.format("c")} as s from ({source}) where c <> ''),
walk as (select {keys}, s, 1 as k, s[1] as cur, []::varchar[] as done from snt
  union all
  select {keys}, s, k + 1,
    case when cur <> '' and length(cur) + length(s[k + 1]) + 1 > 700 then {_strip("right(cur, 150)")} || ' ' || s[k + 1] else {_strip("cur || ' ' || s[k + 1]")} end,
    case when cur <> '' and length(cur) + length(s[k + 1]) + 1 > 700 then list_append(done, {_strip("cur")}) else done end
  from walk where k < len(s)),
fin as (select {keys}, case when {_strip("cur")} <> '' then list_append(done, {_strip("cur")}) else done end as done from walk where k = len(s)),
chk as (select {keys}, unnest(done) as content, generate_subscripts(done, 1) - 1 as p_idx, len(done) as n from fin)"""


_PROSE = _strip(r"regexp_replace(regexp_replace({}, '-\s*\n\s*', '', 'g'), '\s+', ' ', 'g')")

_VECTORS = """
v as (select vec_id, label, label % {n} as document_id, embedding::double[] as e from embeddings),
sim as (select q.vec_id as query_id, p.vec_id as chunk_id, p.label as node_id, greatest(0, round(list_dot_product(p.e, q.e) / (sqrt(list_dot_product(p.e, p.e)) * sqrt(list_dot_product(q.e, q.e))), 4)) as similarity
  from v q join v p on q.document_id = p.document_id where q.vec_id % 20 = 0)"""

_HITS = f"""
q as (select item_id as query_id, 'src' || (item_id % 20) as source, text as query, list_distinct({_TOKENS.format("text")}) as w from benchmark where text is not null),
l0 as (select source, doc_id as node_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) - 1 as p from documents where text is not null),
l as (select source, node_id, format('{{:010d}}-{{:06d}}', node_id, p) as chunk_id, content, {_TOKENS.format("content")} as t from l0 where trim(content) <> ''),
lw as (select source, chunk_id, len(list_distinct(t)) as nd, unnest(list_distinct(t)) as w from l),
qw as (select query_id, source, len(w) as nq, unnest(w) as w from q),
sh as (select qw.query_id, lw.source, lw.chunk_id, round(count(*) / sqrt(any_value(nq)::double * any_value(nd)), 4) as similarity from lw join qw on lw.source = qw.source and lw.w = qw.w group by 1, 2, 3),
cand0 as (select *, row_number() over (partition by query_id order by similarity desc, chunk_id) as rank from sh),
cand as (select c.query_id, c.source, c.chunk_id, c.similarity, l.node_id, l.content, l.t, q.query, q.w from cand0 c join l on l.source = c.source and l.chunk_id = c.chunk_id join q on q.query_id = c.query_id where c.rank <= 30),
stat as (select query_id, count(*) as n, case when avg(len(t)) = 0 then 1.0 else avg(len(t)) end as avgdl from cand group by 1),
tf as (select query_id, chunk_id, greatest(len(t), 1) as dl, unnest(w) as term, t from cand),
tf2 as (select query_id, chunk_id, dl, term, len(list_filter(t, lambda x: x = term)) as f from tf),
df as (select query_id, term, count(*) as df from tf2 where f > 0 group by 1, 2),
bm as (select t.query_id, t.chunk_id, sum(case when f = 0 then 0.0::double else ln(1 + (s.n - d.df + 0.5::double) / (d.df + 0.5::double)) * f * 2.5::double / (f + 1.5::double * (0.25::double + 0.75::double * dl / s.avgdl)) end) as bm25
  from tf2 t join stat s on s.query_id = t.query_id left join df d on d.query_id = t.query_id and d.term = t.term group by 1, 2),
gr as (select *, regexp_replace({_strip("lower(strip_accents(query))")}, '\\s+', ' ', 'g') as qn, regexp_replace({_strip("lower(strip_accents(content))")}, '\\s+', ' ', 'g') as cn from cand),
gr2 as (select * exclude (qn, cn), list_distinct([substr(qn, i, 3) for i in range(1, length(qn) - 1)]) as qg, list_distinct([substr(cn, i, 3) for i in range(1, length(cn) - 1)]) as cg from gr),
lex as (select g.query_id, g.source, g.chunk_id, g.node_id, g.content, g.similarity, b.bm25,
   0.6::double * case when max(b.bm25) over (partition by g.query_id) > 0 then b.bm25 / max(b.bm25) over (partition by g.query_id) else 0 end
   + 0.4::double * case when len(qg) = 0 or len(cg) = 0 then 0 else len(list_intersect(qg, cg))::double / len(qg) end as lexical
  from gr2 g join bm b on b.query_id = g.query_id and b.chunk_id = g.chunk_id),
hyb as (select *, round(0.6::double * similarity + 0.4::double * lexical, 4) as hybrid_score from lex),
hit as (select *, row_number() over (partition by query_id order by hybrid_score desc, similarity desc, chunk_id) as hybrid_rank from hyb),
heat as (select query_id, node_id, round(max(hybrid_score) * (1 + 0.1::double * log2(count(*))), 4) as heat, min(hybrid_rank) as first_rank from hit group by 1, 2),
blk as (select query_id, hybrid_rank as ord, '(' || source || ' > ' || node_id || case when node_id % 7 = 0 then '' else ', s.' || (node_id % 7) end || ') ---' || chr(10) || content as tail from hit)"""

_CLASS = "case when heat >= 0.7 then 'high' when heat >= 0.5 then 'medium' when heat > 0 then 'low' end"

_SPANS = r"""
sp0 as (select doc_id as document_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 as p from documents where text is not null),
sp as (select document_id, (p // 10 + 1)::int as page_no, (p % 10)::int as block_no,
   case when p % 7 = 3 then '2.' || p || ' ' || regexp_replace(raw, '[.!?,:;]+\s*$', '') else raw end as text,
   case when p % 4 = 1 then 16.0 when p % 9 = 5 then 12.0 else 10.0 end::double as size, p % 2 = 0 as bold, (p % 10) * 40.0 as y0 from sp0)"""

_LAYOUT = (
    _SPANS
    + r""",
pg as (select document_id, max(page_no) as n from sp group by 1),
samp as (select sp.* from sp join pg using (document_id) where n <= 5 or (page_no - 1 >= greatest(1, n // 10) and (page_no - 1 - greatest(1, n // 10)) % greatest(1, (n - greatest(1, n // 10)) // 10) = 0 and (page_no - 1 - greatest(1, n // 10)) / greatest(1, (n - greatest(1, n // 10)) // 10) < 10)),
body as (select document_id, arg_min(size, (-c, m)) as body from (select document_id, size, count(*) as c, min(page_no * 100 + block_no) as m from samp group by 1, 2) group by 1),
pbody as (select document_id, page_no, arg_min(size, (-c, m)) as page_body from (select document_id, page_no, size, count(*) as c, min(block_no) as m from sp where regexp_matches(text, '\S') group by 1, 2, 3) group by 1, 2),
li as (select sp.document_id, sp.page_no, block_no, size, bold, coalesce(body, 10.0) as body, coalesce(page_body, body, 10.0) as page_body, """
    + _strip(r"regexp_replace(text, '\s+', ' ', 'g')")
    + r""" as text from sp left join body using (document_id) left join pbody using (document_id, page_no) where regexp_matches(text, '\S')),
lj as (select *, regexp_matches(text, '^[1-9]\d{0,2}\.\d+(\.\d+){0,3}\.?\s+\S') or regexp_matches(text, '^\d+\s+[A-ZÇĞİÖŞÜ]') as num, size / page_body as ratio from li where not regexp_matches(text, '\.{4,}\s*\d+\s*$'))
select document_id, page_no, block_no, text,
  case when num then least(5, greatest(1, length(string_split(text, ' ')[1]) - length(replace(string_split(text, ' ')[1], '.', '')) + 1))
  else least(case when size - body >= 6 then 1 when size - body >= 4 then 2 when size - body >= 2 then 3 when size - body >= 0.5 then 4 else 5 end, case when ratio >= 1.6 then 1 when ratio >= 1.4 then 2 when ratio >= 1.25 then 3 when ratio >= 1.18 then 4 else 5 end) end as level
from lj where len(regexp_split_to_array(text, '\s+')) <= 18 and length(text) <= 140 and right(text, 1) not in ('.', '!', '?', ',', ':', ';')
  and (num or size > body + 1.5 or (size > body + 0.5 and bold) or ratio >= 1.18)"""
)

SQL: dict[str, str] = {
    "text_features": f"select doc_id, md5(lower(strip_accents(text))) as folded, len({_TOKENS.format('text')}) as n_tokens, floor({_WORDS.format('text')} * 1.35::double)::int as approx_tokens, {_WORDS.format('text')} as n_words from documents where text is not null",
    "ngram_counts": f"with t as (select item_id, regexp_replace({_strip('lower(strip_accents(text))')}, '\\s+', ' ', 'g') as x from benchmark) select item_id, len(list_distinct([substr(x, i, 3) for i in range(1, length(x) - 1)])) as n_grams from t",
    "summaries": f"select doc_id, case when {_strip('text')} = '' then source else array_to_string({_SENTENCES.format(_strip('text'))}[1:3], ' ') end as summary from documents where text is not null",
    "chunks": "with recursive " + _chunks("select doc_id, " + _PROSE.format(r"regexp_replace(text, '(?m)^\s*\|', '-', 'g')") + " as c from documents where text is not null", "doc_id") + " select doc_id, p_idx, content from chk",
    "table_chunks": """with recursive r as (select string_split(p_type, ' ')[1] as kind, p_partkey, '| ' || p_partkey || ' | ' || p_name || ' |' as row from part where p_name is not null),
g as (select kind, list(row order by p_partkey) as rows, sum(length(row)) + 14 + 9 + len(list(row)) + 1 as whole from r group by 1),
walk as (select kind, rows, 1 as k, [rows[1]] as cur, 23 + length(rows[1]) as n, []::varchar[] as done from g where whole > 700
  union all select kind, rows, k + 1, case when n + length(rows[k + 1]) > 700 then [rows[k + 1]] else list_append(cur, rows[k + 1]) end,
   case when n + length(rows[k + 1]) > 700 then 23 else n end + length(rows[k + 1]), case when n + length(rows[k + 1]) > 700 then list_append(done, array_to_string(cur, chr(10))) else done end from walk where k < len(rows)),
f as (select kind, list_append(done, array_to_string(cur, chr(10))) as done from walk where k = len(rows) union all select kind, [array_to_string(rows, chr(10))] from g where whole <= 700)
select kind, generate_subscripts(done, 1) - 1 as p_idx, '| key | name |' || chr(10) || '|---|---|' || chr(10) || unnest(done) as content from f""",
    "markdown_sections": "with recursive " + _SECTIONS + """,
pth as (select document_id, node_id, heading as path from nod where parent_id is null union all select n.document_id, n.node_id, p.path || ' > ' || n.heading from nod n join pth p on p.document_id = n.document_id and p.node_id = n.parent_id)
select n.document_id, n.node_id, level, heading, parent_id, path, start_line, end_line, start_page, end_page, md5(content) as content_md5 from nod n join pth p on p.document_id = n.document_id and p.node_id = n.node_id""",
    "folded_tree": "with recursive " + _FOLDED,
    "tree_stats": "with recursive " + _TREE + " select level, count(*) as n, count(*) filter (where is_leaf = 1) as leaves from tree group by level",
    "subtree_sizes": "with recursive " + _TREE + _UP + " select document_id, a as node_id, count(*) as n_below from up group by 1, 2",
    "tree_intervals": "with recursive " + _TREE + """,
pre as (select document_id, node_id, [node_id] as trail from tree where parent_id is null union all select t.document_id, t.node_id, list_append(p.trail, t.node_id) from pre p join tree t on t.document_id = p.document_id and t.parent_id = p.node_id),
num as (select *, row_number() over (partition by document_id order by trail) as first from pre)
select a.document_id, a.node_id, a.first, max(b.first) as last from num a join num b on b.document_id = a.document_id and list_contains(b.trail, a.node_id) group by all""",
    "descent_gate": "with recursive " + _TREE + " select document_id from tree group by 1 having count(*) >= 25",
    "node_chunks": "with recursive " + _TREE + "," + _chunks("select document_id, node_id, start_page as sp, end_page as ep, " + _PROSE.format("content") + r" as c from tree where not regexp_matches(content, '(?m)^\s*\|')", "document_id, node_id, sp, ep") + """
select 'doc_' || document_id || '_node_' || node_id || '_p_' || p_idx as chunk_id, document_id, node_id, p_idx,
  case when coalesce(sp, 0) = 0 then -1 when n <= 1 or ep <= sp then sp else sp + round_even(p_idx::double * (ep - sp) / (n - 1), 0)::int end as start_page, length(content) as n_chars from chk""",
    "knn": "with " + _VECTORS.format(n=1) + ", r as (select *, row_number() over (partition by query_id order by similarity desc, chunk_id) as rank from sim) select * from r where rank <= 30",
    "knn_index_exact": "with " + _VECTORS.format(n=1) + ", r as (select *, row_number() over (partition by query_id order by similarity desc, chunk_id) as rank from sim) select * from r where rank <= 10",
    "store_versions": """select doc_id as document_id, source as filename, len(string_split(text, chr(10))) as n_lines, md5(case when doc_id % 3 = 0 then array_to_string(list_transform(string_split(text, chr(10)), lambda x: '> ' || x), chr(10)) else text end) as text_md5,
  case when doc_id % 3 = 0 then 5 else length(text) end as n_chars from documents where text is not null and doc_id % 7 <> 0""",
    "knn_scoped": "with " + _VECTORS.format(n=2) + ", r as (select *, row_number() over (partition by query_id order by similarity desc, chunk_id) as rank from sim where query_id % 3 = 0 or node_id % 5 = query_id % 5) select * from r where rank <= 10",
    "label_heat": f"with {_VECTORS.format(n=1)}, r as (select *, row_number() over (partition by query_id order by similarity desc, chunk_id) as rank from sim), h as (select query_id, node_id, round(max(similarity) * (1 + 0.1::double * log2(count(*))), 4) as heat from r where rank <= 30 group by 1, 2) select *, {_CLASS} as heat_class from h",
    "rank_passages": f"with {_HITS} select query_id, chunk_id, node_id, similarity, round(bm25, 4) as bm25, round(lexical, 4) as lexical, hybrid_score, hybrid_rank from hit where hybrid_rank <= 10",
    "passage_heat": f"with {_HITS} select query_id, node_id, heat, {_CLASS} as heat_class from heat",
    "hottest_nodes": f"with {_HITS}, r as (select *, row_number() over (partition by query_id order by heat desc, first_rank, node_id) as heat_rank from heat) select query_id, node_id, heat, heat_rank from r where heat_rank <= 3",
    "flat_context": f"with {_HITS}, b as (select query_id, ord, '--- Pasaj #' || ord || ' ' || tail as block from blk where ord <= 10), s as (select *, sum(floor({_WORDS.format('block')} * 1.35::double)::int) over (partition by query_id order by ord) as total from b) select * from s where total <= 300",
    "fitting_blocks": f"""with recursive {_HITS}, b as (select query_id, ord, '--- Pasaj ' || tail as block, floor({_WORDS.format("'--- Pasaj ' || tail")} * 1.35::double)::int as n from blk),
w as (select query_id, 0::bigint as ord, 0 as used, []::varchar[] as blocks from (select distinct query_id from b)
  union all select b.query_id, b.ord, case when used + n <= 200 then used + n else used end, case when used + n <= 200 then list_append(blocks, block) else blocks end from w join b on b.query_id = w.query_id and b.ord = w.ord + 1),
e as (select query_id, arg_max(used, ord) as used, arg_max(blocks, ord) as blocks from w group by 1)
select query_id, len(blocks) as n_blocks, used, md5(array_to_string(blocks, chr(10))) as blocks_md5 from e""",
    "chain_sizes": "select o_custkey as document_id, o_orderkey as node_id, count(*) over (partition by o_custkey order by o_orderkey desc) as n_below from orders",
    "chain_heat": "select o_custkey as document_id, o_orderkey as node_id, max(o_totalprice) over (partition by o_custkey order by o_orderkey desc) as heat from orders",
    "raw_tree": """with recursive n as (select l_orderkey as document_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as node_id, greatest(1, l_quantity::int) as level, 'Line ' || l_linenumber as heading from lineitem),
p as (select a.document_id, a.node_id, a.level, any_value(a.heading) as heading, max(b.node_id) as parent_id from n a left join n b on b.document_id = a.document_id and b.node_id < a.node_id and b.level < a.level group by 1, 2, 3),
t as (select document_id, node_id, heading as path from p where parent_id is null union all select p.document_id, p.node_id, t.path || ' > ' || p.heading from p join t on t.document_id = p.document_id and t.node_id = p.parent_id)
select p.document_id, p.node_id, p.level, p.parent_id, t.path, case when exists (select 1 from p c where c.document_id = p.document_id and c.parent_id = p.node_id) then 0 else 1 end as is_leaf from p join t on t.document_id = p.document_id and t.node_id = p.node_id""",
    "ancestor_heat": """with h as (select l_orderkey, max(l_extendedprice) as heat from lineitem group by 1),
c as (select c_custkey, c_nationkey, max(heat) as heat from customer left join orders on o_custkey = c_custkey left join h on l_orderkey = o_orderkey group by 1, 2),
n as (select n_nationkey, n_regionkey, max(heat) as heat from nation left join c on c_nationkey = n_nationkey group by 1, 2),
r as (select r_regionkey, max(heat) as heat from region left join n on n_regionkey = r_regionkey group by 1)
select 'c' || c_custkey as node_id, coalesce(heat, 0.0) as heat from c union all select 'n' || n_nationkey, coalesce(heat, 0.0) from n union all select 'r' || r_regionkey, coalesce(heat, 0.0) from r""",
    "frontier": "with r as (select o_custkey as query_id, o_orderkey as node_id, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders) select query_id, node_id from r where k <= 8",
    "replies": """with k as (select event_id, event_type, json_extract_string(props, '$.k') as k from events) select event_id, '{"select": [' || k || ', "7", "x", 2.5], "confidence": "' || event_type || '"}' as repaired, event_type as confidence, case when k::int between 0 and 50 then k || ',7' else '7' end as ids from k where k is not null""",
    "bookmarks": f"""with m as (select conv_id as document_id, (turn * 3 + conv_id % 3)::int as page, turn from conversations where role <> 'system' and {_strip("text")} <> ''),
g as (select document_id, coalesce(lead(page) over (partition by document_id order by page, turn), 25) - page as gap from m)
select document_id, count(*) as n, round(max(gap) / 24.0::double, 4) as share, count(*) >= 3 and max(gap) / 24.0::double <= 0.25 as usable from g group by 1""",
    "bookmark_tree": f"""with t as (select conv_id as document_id, turn, role, text from conversations where text is not null),
m as (select document_id, turn as seq, (turn + 1)::int as page from t where role = 'user'),
g as (select *, coalesce(lead(page) over (partition by document_id order by page, seq), 9) - page as gap from m),
u as (select document_id from g group by 1 having count(*) >= 3 and max(gap) / 8.0::double <= 0.25),
n as (select m.*, coalesce(lead(page) over (partition by m.document_id order by seq), 9) as nxt from m join u on u.document_id = m.document_id)
select n.document_id, seq, 'Turn ' || seq as heading, greatest(1, page) as start_page, greatest(greatest(1, page), least(8, nxt - 1)) as end_page,
  md5({_strip("coalesce((select string_agg(t.text, chr(10) order by t.turn) from t where t.document_id = n.document_id and t.turn + 1 between greatest(1, page) and least(8, nxt - 1)), '')")}) as content_md5 from n""",
    "descent": "with recursive " + _TREE + _UP + """,
big as (select document_id from tree group by 1 having count(*) >= 3),
hot as (select u.document_id, u.a as node_id, max(round(length(t.content) % 100 / 100.0::double, 4)) as heat from up u join tree t on t.document_id = u.document_id and t.node_id = u.node_id group by 1, 2),
nd as (select t.document_id, t.node_id, t.parent_id, t.is_leaf, h.heat from tree t join hot h on h.document_id = t.document_id and h.node_id = t.node_id join big b on b.document_id = t.document_id where h.heat >= 0.6),
go as (select document_id, node_id, is_leaf from nd where parent_id is null union all select n.document_id, n.node_id, n.is_leaf from nd n join go g on g.document_id = n.document_id and g.node_id = n.parent_id)
select document_id as query_id, node_id, case when is_leaf = 1 then 'target' else 'opened' end as kind from go""",
    "layout_headings": "with " + _LAYOUT,
    "boxes_outside": "with " + _SPANS + " select document_id, page_no, count(*) as n from sp where not (y0 >= 78 and y0 + 20 <= 182) group by 1, 2",
    "renumbered": """select p_partkey, case when p_size % 3 = 0 then '### ' || p_size || '.' || (p_size % 7) || '.1 ' when p_size % 3 = 1 then '# ' || p_size || ' ' else '# ' end || p_type || chr(10) || 'body # no' as markdown from part""",
    "golden": f"""with c as (select m.mode, i.text as t, i.item_id, d.doc_id, d.text as a from benchmark i, (values ('full', 0), ('flat', 3)) m(mode, shift), documents d where i.text is not null and d.text is not null and d.doc_id = i.item_id * 5 + m.shift),
j as (select *, contains({_strip("regexp_replace(lower(a), '\\s+', ' ', 'g')")}, {_strip("regexp_replace(lower(t), '\\s+', ' ', 'g')")}) and not contains(lower(a), 'zzzz') as passed, item_id % 4 = doc_id % 3 as routed from c)
select mode, count(*) as n, count(*) filter (where passed) as n_passed, round(count(*) filter (where passed) / count(*)::double, 6) as pass_rate, count(*) filter (where routed) as n_routed, count(*) as n_routable, 1.0::double as mean_latency from j group by 1""",
}
