"""DuckDB SQL for the queries, written from the rules and not from the plans."""

from __future__ import annotations

from ..functions.scalars import CUT_MARK
from ..functions.sections import METHOD, NOISE
from ..operators.hierarchy import BUDGET
from .queries import DEPTH, NOW_S, TITLES

_LIST = "[" + ", ".join(f"'{t}'" for t in TITLES) + "]"
_NOISE = "|".join(NOISE)
_METHOD = f"(^| )({'|'.join(k for k in METHOD if k.isascii())})( |$)|{'|'.join(k for k in METHOD if not k.isascii())}"
_WORDS = "regexp_extract_all(lower(coalesce({}, '')), '[\\x{{4e00}}-\\x{{9fff}}]|[a-zA-Z0-9_]+')"


def _title(n: str) -> str:
    return f"{_LIST}[({n}) % {len(TITLES)} + 1]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _normal(x: str) -> str:
    bare = rf"regexp_replace(lower({_strip(f"coalesce({x}, '')")}), '^\s*[\divx]+[.):\- ]+', '')"
    return rf"trim(regexp_replace({bare}, '\s+', ' ', 'g'), ' .:-_()[]{{}}【】（）')"


_SCORE = "CASE WHEN distance > 0 THEN 1 / (distance + 1e-8) ELSE 1.0 END"
_GOOD = "SELECT doc_id FROM labels WHERE quality = 1"


def _near(asked: str, among: str = "true") -> str:
    return f"""SELECT qid, id, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank
FROM (SELECT q.vec_id AS qid, v.vec_id AS id, round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS distance
FROM embeddings q, embeddings v WHERE {asked} AND {among})"""


def _sparse(docs: str = "documents") -> str:
    return f"""w AS (SELECT doc_id AS id, {_WORDS.format("text")} AS words FROM {docs}),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(words) AS dl, unnest(words) AS term FROM w) GROUP BY ALL),
idf AS (SELECT term, ln((SELECT count(*) FROM w) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf GROUP BY term),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({_WORDS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
qw AS (SELECT qid, term, qtf * CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf) ELSE idf END AS wt FROM qt JOIN idf USING (term)),
ss AS (SELECT qid, id, round(sum(wt * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(len(words)) FROM w)))), 6) AS score FROM tf JOIN qw USING (term) GROUP BY qid, id),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ss) WHERE rank <= {DEPTH} AND score > 0)"""


_SPARSE = _sparse()
_RRF = f"""{_SPARSE}, near AS (SELECT *, {_SCORE} AS s FROM ({_near("q.vec_id IN (SELECT item_id FROM benchmark)")}) WHERE rank <= {DEPTH}),
dense AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM near),
fs AS (SELECT qid, id, round(sum(p), 6) AS score FROM (SELECT qid, id, 100.0::DOUBLE / (60 + rank) AS p FROM dense UNION ALL SELECT qid, id, 1.2::DOUBLE * 100.0::DOUBLE / (60 + rank) FROM sparse) GROUP BY qid, id),
rrf AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fs)"""


def _promoted(support: float, count: float) -> str:
    return f"""{_RRF}, pp AS (SELECT qid, source AS parent_id, round(max(greatest(score, 0)) + {support}::DOUBLE * avg(greatest(score, 0)) + {count}::DOUBLE * (count(*) - 1), 6) AS score,
count(*) AS n_children, round(sum(score), 6) AS child_sum, round(max(greatest(score, 0)), 6) AS best FROM rrf JOIN documents ON id = doc_id WHERE source IS NOT NULL GROUP BY ALL),
parents AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, parent_id) AS rank FROM pp)"""


def _near_best(rows: str, ratio: float, key: str) -> str:
    """Rows near the best of their query, ranked anew."""
    return f"SELECT qid, {key}, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, {key}) AS rank FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM {rows}) WHERE score >= top * {ratio} OR rank = 1"


_CHUNKS = f"""lines AS (SELECT md5(CAST(doc_id AS VARCHAR)) AS doc_hash, generate_subscripts(l, 1) - 1 AS chunk_index, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
named AS (SELECT doc_hash, chunk_index, {_strip("t")} AS text, {_title("chunk_index // 3")} AS section_hierarchy, chunk_index // 10 + 1 AS page FROM lines),
chunks AS (SELECT *, string_split(section_hierarchy, ' > ')[-1] AS section_title, len(list_filter(string_split(section_hierarchy, ' > '), lambda p: regexp_matches({_normal("p")}, '{_NOISE}'))) > 0 AS noise,
len(list_filter(string_split(section_hierarchy, ' > '), lambda p: regexp_matches({_normal("p")}, '{_METHOD}'))) > 0 AS method FROM named WHERE text <> '')"""
_ELEMENTS = f"""{_CHUNKS}, marked AS (SELECT *, max(page) OVER (PARTITION BY doc_hash) AS page_count, bool_and(noise) OVER (PARTITION BY doc_hash) AS only_noise FROM chunks),
body AS (SELECT *, min(chunk_index) OVER (PARTITION BY doc_hash, section_hierarchy) AS first_index FROM marked WHERE NOT noise OR only_noise),
placed AS (SELECT *, dense_rank() OVER (PARTITION BY doc_hash ORDER BY first_index) - 1 AS ordinal, row_number() OVER (PARTITION BY doc_hash, section_hierarchy ORDER BY chunk_index) AS position FROM body),
elements AS (SELECT *, doc_hash || '_paper' AS paper_id, doc_hash || '_paper_sec_' || ordinal AS section_id, doc_hash || '_paper_sec_' || ordinal || '_elem_' || (position - 1) AS element_id FROM placed)"""
_SECTIONS = f"""{_ELEMENTS}, sections AS (SELECT 'section' AS level, section_id, paper_id AS parent_id, paper_id, section_title, section_hierarchy, CAST(ordinal + 1 AS VARCHAR) AS section_number,
min(page) AS start_page, max(page) AS end_page, count(*) AS chunk_count, doc_hash, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS document, bool_or(noise) AS noise, bool_or(method) AS method
FROM elements GROUP BY section_id, paper_id, section_title, section_hierarchy, ordinal, doc_hash)"""
_KEPT = f"""{_SECTIONS}, kept AS (SELECT *, row_number() OVER (PARTITION BY doc_hash ORDER BY CAST(section_number AS INT), start_page, section_title, section_id) AS place FROM sections WHERE NOT noise AND NOT method)"""
_PAPERS = """papers AS (SELECT 'paper' AS level, paper_id, doc_hash AS title, doc_hash, max(ordinal) + 1 AS section_count, count(*) AS chunk_count, max(page_count) AS page_count, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS document FROM elements GROUP BY ALL),
leaves AS (SELECT paper_id, string_agg(section_title, ' | ' ORDER BY ordinal) AS section_titles FROM (SELECT DISTINCT paper_id, ordinal, section_title FROM elements) GROUP BY paper_id)"""
_PAGES = "CASE WHEN start_page = end_page THEN '第' || start_page || '页' ELSE '第' || start_page || '-' || end_page || '页' END"
_FLAT = rf"regexp_replace(regexp_replace({_strip("coalesce({x}, '')")}, '[ \t]+', ' ', 'g'), '\n{{{{3,}}}}', chr(10) || chr(10), 'g')"


def _shortened(x: str, n: int) -> str:
    flat = _FLAT.format(x=x)
    return rf"CASE WHEN length({flat}) <= {n} THEN {flat} ELSE regexp_replace(left({flat}, {n}), '\s+$', '') || '...' END"


_PAIRS = """said AS (SELECT *, lead(role) OVER o AS next_role, lead(text) OVER o AS next_text FROM conversations WHERE role IN ('user', 'assistant') WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role DESC, text NULLS FIRST)),
asked AS (SELECT conv_id, turn, coalesce(text, '') AS question, coalesce(CASE WHEN next_role = 'assistant' THEN next_text END, '') AS answer FROM said WHERE role = 'user'),
pairs AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, question, answer) - 1 AS pair FROM asked)"""
_BACK = f"WITH {_PAIRS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pair DESC) AS back FROM pairs)"
_MARK = CUT_MARK.replace("\n", "' || chr(10) || '")
_TOKENS = r"greatest(len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) + len(regexp_extract_all(text, '\b[a-zA-Z]+\b')), 1)"
# words of Latin letters with no letter, digit or underscore of any script beside them
_LATIN = r"len(list_filter(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z]+')))"

ORACLE_SQL = {
    "dense_topk": f"SELECT *, round({_SCORE}, 4) AS score FROM ({_near('q.vec_id % 20 = 0')}) WHERE rank <= 10",
    "dense_topk_filtered": f"SELECT *, round({_SCORE}, 4) AS score FROM ({_near('q.vec_id % 20 = 0', f'v.vec_id IN ({_GOOD})')}) WHERE rank <= 10 AND {_title('id')} NOT IN ('References', 'Results > Preference Study')",
    "bm25_topk": f"WITH {_SPARSE} SELECT * FROM sparse",
    "bm25_topk_filtered": f"WITH {_sparse(f'(SELECT * FROM documents WHERE doc_id IN ({_GOOD}))')} SELECT * FROM sparse WHERE {_title('id')} NOT IN ('References', 'Results > Preference Study')",
    "rrf_hybrid": f"WITH {_RRF} SELECT * FROM rrf",
    "parent_promote": f"WITH {_promoted(0.3, 0.1)} SELECT * FROM parents",
    "parent_prescreen": f"WITH {_promoted(0.18, 0.08)}, screened AS ({_near_best('parents', 0.55, 'parent_id')}) {_near_best('screened', 0.78, 'parent_id')}",
    "child_percent_keep": f"WITH {_RRF}, part AS (SELECT qid, id, score, rank FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM rrf) WHERE rank <= greatest(1, ceil(n * 0.5))) {_near_best('part', 0.7, 'id')}",
    "cross_query_rrf": f"""WITH {_SPARSE}, c AS (SELECT qid // 3 AS question, id, round(sum(100.0::DOUBLE / (60 + rank)), 6) AS score, min(qid) AS first_qid FROM sparse GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS rank FROM c""",
    "multi_query_fuse": f"""WITH {_SPARSE}, m AS (SELECT qid // 3 AS question, id AS key, count(DISTINCT qid) AS hit_count, max(score) AS best, min((qid, rank)) AS first FROM sparse WHERE rank <= 5 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY first, key) AS first_order, count(*) OVER (PARTITION BY question) AS n, round(best * (1 + 0.15::DOUBLE * hit_count), 8) AS score FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY CASE WHEN n <= 4 THEN 0 ELSE -score END, first_order) AS rank FROM o)
SELECT question, key, hit_count, score, first_order, rank FROM r WHERE rank <= 4""",
    "dynamic_select": f"WITH {_RRF} SELECT qid, id, score, rank FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM rrf) WHERE rank <= 6 AND (score >= top * 0.7 OR rank <= 1)",
    "rank_percent": f"WITH {_SPARSE} SELECT qid, id, score, rank FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM sparse) WHERE rank <= greatest(1, ceil(n * 0.5))",
    "rank_fusion": f"""WITH {_SPARSE}, r AS (SELECT qid, id, score, n_chars, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank_original,
row_number() OVER (PARTITION BY qid ORDER BY n_chars DESC, id) AS rank_model FROM sparse JOIN documents ON id = doc_id)
SELECT *, round((0.45::DOUBLE / (rank_original + 60) + 0.55::DOUBLE / (rank_model + 60)) * 100, 6) AS fused_score FROM r""",
    "min_max_scores": f"""WITH {_SPARSE}, m AS (SELECT *, min(score) OVER (PARTITION BY qid) AS lo, max(score) OVER (PARTITION BY qid) AS hi FROM sparse)
SELECT qid, id, score, rank, round(CASE WHEN hi - lo > 1e-8 THEN (score - lo) / (hi - lo) ELSE 0.5 END, 6) AS normal FROM m""",
    "hier_chunks": f"WITH {_CHUNKS} SELECT doc_hash, chunk_index, text, section_hierarchy AS section_key, page, noise, method FROM chunks",
    "noise_filter": f"WITH {_ELEMENTS} SELECT doc_hash, chunk_index, page_count FROM body",
    "hier_elements": f"WITH {_ELEMENTS} SELECT 'element' AS level, element_id, section_id AS parent_id, paper_id, section_id, section_title, section_hierarchy, 'text' AS element_type, position, page, chunk_index, doc_hash, text AS text_content FROM elements",
    "hier_sections": f"WITH {_SECTIONS} SELECT * EXCLUDE (noise, method) FROM sections",
    "hier_papers": f"WITH {_ELEMENTS}, {_PAPERS} SELECT papers.*, left(document, 1000) AS abstract, section_titles FROM papers JOIN leaves USING (paper_id)",
    "overview_sections": f"WITH {_KEPT} SELECT section_id, section_title, start_page, place FROM kept",
    "overview_elements": f"WITH {_KEPT} SELECT element_id, section_id, row_number() OVER (PARTITION BY section_id ORDER BY position, chunk_index) AS place FROM elements WHERE section_id IN (SELECT section_id FROM kept)",
    "overview_packet": f"""WITH {_KEPT}, {_PAPERS}, fulls AS (SELECT section_id, string_agg(text, chr(10) ORDER BY position) AS full_text FROM elements GROUP BY section_id),
listed AS (SELECT doc_hash, string_agg(place || '. ' || section_hierarchy || '（' || {_PAGES} || '，' || chunk_count || '块）', chr(10) ORDER BY place) AS list_text,
string_agg(chr(10) || '### ' || place || '. ' || section_hierarchy || chr(10) || '页码: ' || {_PAGES} || chr(10) || full_text, chr(10) ORDER BY place) AS block_text FROM kept JOIN fulls USING (section_id) GROUP BY doc_hash)
SELECT doc_hash, {_strip(f"concat_ws(chr(10), '【文档级概述资料包】', '标题: ' || title, '文档ID: ' || paper_id, 'doc_hash: ' || doc_hash, '页数: ' || page_count, '正文块数: ' || chunk_count, chr(10) || '【摘要】' || chr(10) || {_shortened('left(document, 1000)', 1200)}, chr(10) || '【章节结构】', list_text, chr(10) || '【各章节全部内容】', block_text)")} AS packet FROM papers LEFT JOIN listed USING (doc_hash)""",
    "neighbor_context": f"""WITH {_ELEMENTS}, n AS (SELECT a.element_id, left(b.text, 200) AS t, b.position AS p, row_number() OVER (PARTITION BY a.element_id ORDER BY b.position) AS k FROM elements a JOIN elements b ON a.section_id = b.section_id AND abs(a.position - b.position) <= 2 AND a.text <> b.text)
SELECT e.element_id, coalesce(string_agg(t, chr(10) || '...' || chr(10) ORDER BY p), '') AS context FROM elements e LEFT JOIN (SELECT * FROM n WHERE k <= 2) n USING (element_id) GROUP BY e.element_id""",
    "level_counts": f"WITH {_ELEMENTS} SELECT count(DISTINCT paper_id) AS papers, CAST(count(DISTINCT section_id) AS BIGINT) AS sections, CAST(count(*) AS BIGINT) AS elements FROM elements",
    "structured_rollup": f"""WITH {_RRF}, h AS (SELECT qid, rank, id, source AS paper_id, {_title("id")} AS title, score, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, rank) AS k FROM rrf JOIN documents ON id = doc_id WHERE coalesce(source, '') <> ''),
g AS (SELECT qid, paper_id, max(score) AS score, min_by(title, rank) AS title, string_agg(CAST(id AS VARCHAR), ',' ORDER BY k) FILTER (WHERE k <= 10) AS elements, min(rank) AS first FROM h GROUP BY qid, paper_id)
SELECT qid, paper_id, score, title, elements, row_number() OVER (PARTITION BY qid ORDER BY first) AS rank FROM g""",
    "citations": f"""WITH {_RRF}, c AS (SELECT qid, id, rank, coalesce(nullif(source, ''), '未知文献') || ' - ' || {_title("id")} || CASE WHEN id % 4 = 0 THEN '' ELSE ' (第 ' || id % 4 || ' 页)' END AS source, coalesce(text, '') AS text FROM rrf JOIN documents ON id = doc_id WHERE rank <= 6)
SELECT qid, id, '[' || rank || '] (来源: ' || source || ')' || chr(10) || '"' || text || '"' AS reference, source FROM c""",
    "budget_pack": f"""WITH RECURSIVE b AS (SELECT conv_id, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) AS k FROM conversations),
s AS (SELECT conv_id, k, {BUDGET} - total AS room, n, acc, total, t FROM (SELECT conv_id, 1 AS k, 0 AS n, CAST('' AS VARCHAR) AS acc, 0 AS total, t FROM b WHERE k = 1)
UNION ALL SELECT x.conv_id, x.k + 1, {BUDGET} - x.total2, x.n2, x.acc2, x.total2, b.t FROM (SELECT conv_id, k, CASE WHEN v IS NULL THEN n ELSE n + 1 END AS n2, CASE WHEN v IS NULL THEN acc WHEN n = 0 THEN v ELSE acc || '|' || v END AS acc2, total + coalesce(length(v), 0) AS total2
FROM (SELECT *, CASE WHEN room <= 0 THEN NULL WHEN length(t) <= room THEN t WHEN n = 0 THEN regexp_replace(left(t, room - {len(CUT_MARK)}), '\\s+$', '') || '{_MARK}' END AS v FROM s)) x LEFT JOIN b ON b.conv_id = x.conv_id AND b.k = x.k + 1 WHERE x.k <= (SELECT max(k) FROM b c WHERE c.conv_id = x.conv_id))
SELECT conv_id, n AS n_blocks, md5(acc) AS hash, total AS total_length FROM s WHERE k = (SELECT max(k) + 1 FROM b WHERE b.conv_id = s.conv_id)""",
    "section_titles": f"WITH t AS (SELECT doc_id, {_normal('text')} AS title FROM documents) SELECT doc_id, title, regexp_matches(title, '{_NOISE}') AS noise, regexp_matches(title, '{_METHOD}') AS method FROM t",
    "text_scalars": rf"""WITH c AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[\x{{4e00}}-\x{{9fff}}]')) AS zh, len(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]')) AS en FROM documents)
SELECT doc_id, round(CASE WHEN zh + en > 0 THEN zh / (zh + en) ELSE 0.0 END, 6) AS chinese, len({_WORDS.format("text")}) AS n_tokens, coalesce(zh + {_LATIN}, 0) AS n_words, {_shortened("text", 120)} AS short FROM c""",
    "query_parse": r"""WITH s AS (SELECT item_id, left(text, 40) AS q, list_transform(regexp_split_to_array('1. ' || replace(text, ' ', chr(10) || '- ') || chr(10) || '第一：x' || chr(10) || upper(text), '[\n\r;；]+'), lambda x: regexp_replace(regexp_replace(trim(regexp_replace(x, '^(\d+[.)]|[-*•])\s*', ''), ' ' || chr(9) || '"''“”‘’'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS l FROM benchmark),
f AS (SELECT item_id, q, list_filter(l, lambda x: length(x) >= 2 AND length(x) <= 120 AND NOT (contains(x, '：') AND length(split_part(x, '：', 1)) <= 6)) AS l FROM s),
d AS (SELECT item_id, q, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i) AS l FROM f),
p AS (SELECT item_id, (CASE WHEN list_contains(list_transform(l, lambda y: lower(y)), lower(q)) THEN l ELSE list_concat([q], l) END)[1:3] AS l FROM d) SELECT item_id, len(l) AS n, array_to_string(l, '|') AS queries FROM p""",
    "intent_parse": "SELECT item_id, ['fact_qa', 'document_overview', NULL, 'general_overview'][item_id % 4 + 1] AS intent FROM benchmark",
    "clamp_params": """WITH q AS (SELECT *, CAST(l_quantity AS INT) AS n FROM lineitem), w AS (SELECT *, greatest(n * 16, 16) AS c, greatest(n * n, 1) AS t FROM q), m AS (SELECT *, least(t, greatest(c - 8, 1)) AS made FROM w)
SELECT l_orderkey, l_linenumber, CAST(greatest(64, least(CASE WHEN n % 7 = 0 THEN 512 ELSE n % 7 * 100 END, 450)) AS INT) AS length, round(greatest(0.0, least(CAST(l_discount AS DOUBLE) * 30, 2.0)), 6) AS temperature, made, greatest(c - made - 8, 1) AS room FROM m""",
    "session_last2": f"{_BACK} WHERE back <= 2",
    "session_prior5": f"{_BACK} WHERE back > 2 AND back <= 7",
    "session_list": f"WITH {_PAIRS} SELECT conv_id, left(min_by(question, pair), 24) AS title, 2 * count(*) AS message_count, max(turn) AS updated_at FROM pairs GROUP BY conv_id",
    "session_messages": f"WITH {_PAIRS} SELECT conv_id, 2 * pair AS seq, 'user' AS role, question AS content FROM pairs UNION ALL SELECT conv_id, 2 * pair + 1, 'assistant', answer FROM pairs",
    "session_expiry": f"""WITH c AS (SELECT DISTINCT conv_id, ({NOW_S} - conv_id * 43200) * CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 1000 END AS made FROM conversations)
SELECT conv_id, made <> 0 AND {NOW_S} - CASE WHEN made > {NOW_S}::BIGINT * 1000 THEN made // 1000 ELSE made END > 30 * 86400 AS expired FROM c""",
    "history_cas": f"WITH {_PAIRS} SELECT conv_id AS id, CAST(CASE WHEN count(*) % 2 = 0 OR count(*) = 1 THEN least(count(*), 2) ELSE count(*) END AS INT) AS n, CASE WHEN count(*) % 2 = 0 OR count(*) = 1 THEN 'new' ELSE 'old' END AS summary FROM pairs GROUP BY conv_id",
    "new_contents": """SELECT md5(text) AS hash, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL AND coalesce(source, '') <> 'src0'
AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE source = 'src0' AND text IS NOT NULL) GROUP BY md5(text)""",
    "upload_check": """WITH f AS (SELECT doc_id, doc_id % 5 AS k, octet_length(encode(CASE WHEN doc_id % 5 = 3 THEN '' ELSE '%PDF-' END || coalesce(text, ''))) AS size FROM documents)
SELECT doc_id, 'paper ' || doc_id || CASE WHEN k = 2 THEN '.txt' ELSE '.PDF' END AS plain, CASE WHEN k IN (1, 2) THEN 'type' WHEN size * 8192 > 20 * 1048576 THEN 'size' WHEN k = 3 THEN 'type' ELSE '' END AS reason FROM f""",
    "anti_join_indexed": f"SELECT doc_id, source FROM documents WHERE doc_id NOT IN ({_GOOD})",
    "upsert": "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 500) UNION ALL SELECT doc_id, 9 FROM documents WHERE n_chars > 500",
    "token_chunks": rf"""WITH l AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS k, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
c AS (SELECT doc_id, k, {_strip("t")} AS text FROM l), n AS (SELECT *, greatest(len(regexp_extract_all(text, '[\x{{4e00}}-\x{{9fff}}]')) + {_LATIN}, 1) AS n FROM c WHERE text <> ''),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n), m AS (SELECT *, max(before) OVER (PARTITION BY doc_id) AS last FROM b),
d AS (SELECT doc_id, before // 256 AS chunk, k, n, text FROM m UNION ALL SELECT doc_id, before // 256 + 1, k, n, text FROM m WHERE before >= (before // 256 + 1) * 256 - 30 AND last >= (before // 256 + 1) * 256)
SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, CAST(sum(n) AS BIGINT) AS n_tokens, md5(string_agg(text, chr(10) ORDER BY k)) AS hash FROM d GROUP BY doc_id, chunk""",
    "distance_scores": f"""SELECT id, distance, round({_SCORE}, 4) AS score, round(CASE WHEN 1 - distance < 0 THEN 1 / (1 - (1 - distance) + 1e-8) ELSE 1 - distance END, 6) AS positive
FROM (SELECT a.vec_id AS id, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)""",
}
