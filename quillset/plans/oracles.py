"""DuckDB statements giving the expected result of each registered query, over whole tables.

Written from the operators' definitions: recursive statements replay sequential rules literally, similarities are computed
for every pair. They are a check, not an engine.
"""

from __future__ import annotations

from quillset.operators import requests as rq
from quillset.operators import responses as rs
from quillset.operators.quality import (
    FLAG_LOW_INFORMATION,
    FLAG_LOW_OVERLAP,
    FLAG_NO_EVIDENCE,
    FLAG_TOO_LONG,
    FLAG_TOO_SHORT,
    FLAG_VAGUE,
)
from quillset.plans import relations as rel
from quillset.plans.registry import HAN_SEARCH_TEXT, SEARCH_TEXT

W = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
HAN = r"\x{3400}-\x{9fff}"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(e: str) -> str:
    return f"regexp_replace({e}, '^{W}+|{W}+$', '', 'g')"


def sub(e: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({e}, {lit(pattern)}, {lit(by)}, 'g')"


def half_up(e: str, digits: int = 3) -> str:
    return f"floor(({e}) * {10**digits}.0::DOUBLE + 0.5::DOUBLE) / {10**digits}.0::DOUBLE"


def clamp(e: str) -> str:
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {e}))"


def pick(words: tuple[str, ...], index: str) -> str:
    return f"([{', '.join(lit(w) for w in words)}])[({index}) % {len(words)} + 1]"


def grams(e: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, length({e}) - {n - 2}), lambda i: substr({e}, i, {n})))"


def chars(e: str) -> str:
    return f"CASE WHEN {e} = '' THEN []::VARCHAR[] ELSE list_distinct(string_split({e}, '')) END"


def pair_set(e: str) -> str:
    return f"CASE WHEN length({e}) < 2 THEN {chars(e)} ELSE {grams(e, 2)} END"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END"


def share(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len({a}) END"


def quality_norm(e: str) -> str:
    return f"trim(regexp_replace(lower({e}), '[^a-z0-9{HAN}._+\\-]+', ' ', 'g'))"


def dedup_norm(e: str) -> str:
    return f"regexp_replace(lower({e}), '[^a-z0-9{HAN}]+', '', 'g')"


def canonical(e: str) -> str:
    return sub(sub(sub(dedup_norm(e), "设置|设定|调整", "配置"), "怎样|怎么", "如何"), "请问|如何|方法|步骤|流程|需要|应该|要|的|是")


def trigram_norm(e: str) -> str:
    return f"regexp_replace(lower({e}), '[^A-Za-z0-9_\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')"


def base36_hash(e: str) -> str:
    h = (
        f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({e}, ''), lambda c: unicode(c)::BIGINT)), "
        "lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
    )
    powers = "[2176782336, 60466176, 1679616, 46656, 1296, 36, 1]"
    digit = f"substr('0123456789abcdefghijklmnopqrstuvwxyz', (({h} // p) % 36)::INT + 1, 1)"
    return f"ltrim(array_to_string(list_transform({powers}, lambda p: {digit}), ''), '0')"


# --- derived relations --------------------------------------------------------------------------------------------

CONV_QA = """conv_qa AS (
  SELECT conv_id, turn, conv_id * 1000 + turn AS pos, text AS instruction, '' AS input, next_text AS output
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""

HAN_QA = f"""{CONV_QA}, han_qa AS (
  SELECT conv_id, turn, pos,
    {pick(rel.HAN_PREFIXES, 'conv_id + turn')} || instruction AS instruction,
    CASE WHEN conv_id % 11 = 0 THEN output ELSE '' END AS input,
    {pick(rel.HAN_ANSWERS, 'conv_id + turn')} || output AS output
  FROM conv_qa)"""

PAGES_TEXT_EXPR = "html"
for _pattern, _by in (
    (r"(?is)<script[^>]*>.*?</script>", ""),
    *[(rf"(?i)<h{n}[^>]*>", "#" * n + " ") for n in range(1, 7)],
    (r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/td|/th)[^>]*>", "\n"),
    (r"(?is)<style[^>]*>.*?</style>", ""),
    (r"<[^>]+>", " "),
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
    (r"[ \t]+", " "),
    (r"\n{3,}", "\n\n"),
):
    PAGES_TEXT_EXPR = sub(PAGES_TEXT_EXPR, _pattern, _by)
CLEAN_T = trim(sub("array_to_string(list_transform(string_split(t, chr(10)), lambda s: " + trim("s") + "), chr(10))", r"{NL}{3,}".replace("{NL}", chr(92) + "n"), chr(10) * 2))
PAGES_TEXT = f"""pages_raw AS (SELECT page_id, {trim(PAGES_TEXT_EXPR)} AS t FROM pages),
pages_text AS (SELECT page_id, {CLEAN_T} AS text FROM pages_raw)"""

DOC_TXT = "doc_txt AS (SELECT doc_id, source, n_chars, source || '/' || doc_id || '.txt' AS source_name, 'txt' AS file_type, text FROM documents)"



def qa_of(relation: str, out: str, variant: str) -> str:
    """CTE adding question and answer to a relation with ``text``."""
    return f"""{out}_s AS (
  SELECT *, list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]'), lambda s: {trim('s')}), lambda s: s <> '') AS s FROM {relation}),
{out}_a AS (
  SELECT *, coalesce(list_sort(list_transform(s[2:], lambda x, i: {{'k': -length(x), 'i': i, 's': x}}))[1].s, s[1]) AS a FROM {out}_s WHERE len(s) > 0),
{out} AS (
  SELECT * EXCLUDE (s, a, text), s[1] AS instruction, '' AS input,
    CASE {variant} % 3 WHEN 1 THEN replace(a, ' ', '  ') WHEN 2 THEN md5(a) ELSE a END AS output, text AS chunk_text
  FROM {out}_a)"""


DOC_QA = f"""{DOC_TXT}, {qa_of("(SELECT *, 'd_' || doc_id AS document_id FROM doc_txt)", 'doc_qa', 'doc_id')}"""


def evidence_of(relation: str, out: str = "located") -> str:
    """CTEs adding e_text, e_start, e_end, e_ok to a relation with chunk_text and output."""
    window = f"regexp_replace(lower(substr(chunk_text, w + 1, 800)), '[^a-z0-9{HAN}]+', '', 'g')"
    return f"""ev_probe AS (
  SELECT *, row_number() OVER () AS ev_id, length(chunk_text) AS n, list_sort(list_transform(list_filter(list_transform(
      regexp_split_to_array(output, '[。！？.!?\\n]'), lambda s: {trim('s')}), lambda s: length(s) >= 6),
      lambda x, i: {{'k': -length(x), 'i': i, 'p': substr(x, 1, 80)}})) AS probes, {dedup_norm('output')} AS a_norm
  FROM {relation}),
ev_anchor AS (
  SELECT *, list_filter(list_transform(probes, lambda r: instr(chunk_text, r.p)), lambda x: x > 0)[1] - 1 AS verbatim,
    {pair_set('a_norm')} AS a_units FROM ev_probe),
ev_rows AS (SELECT ev_id, chunk_text, a_units, unnest(range(0, n, 240)) AS w FROM ev_anchor WHERE n > 800 AND verbatim IS NULL),
ev_norm AS (SELECT ev_id, w, a_units, {window} AS wn FROM ev_rows),
ev_units AS (SELECT ev_id, w, a_units, {pair_set('wn')} AS wu FROM ev_norm),
ev_best AS (SELECT ev_id, arg_max({{'share': s, 'key': -w}}, {{'share': s, 'key': -w}}) AS best FROM (SELECT ev_id, w, {share('a_units', 'wu')} AS s FROM ev_units) GROUP BY 1),
ev_window AS (SELECT a.*, b.best FROM ev_anchor a LEFT JOIN ev_best b USING (ev_id)),
ev_start AS (
  SELECT *, CASE WHEN n <= 800 THEN 0 ELSE greatest(0, least(n - 800,
      coalesce(verbatim, CASE WHEN best.share >= 0.12 THEN -best.key + 400 END) - 280)) END AS at0,
    (n <= 800 OR verbatim IS NOT NULL OR coalesce(best.share, 0) >= 0.12) AS e_ok FROM ev_window),
{out} AS (
  SELECT *, CASE WHEN n <= 800 THEN chunk_text WHEN e_ok THEN
      (CASE WHEN at0 > 0 THEN '…' ELSE '' END) || substr(chunk_text, at0 + 1, 800) || (CASE WHEN at0 + 800 < n THEN '…' ELSE '' END) ELSE '' END AS e_text,
    CASE WHEN e_ok THEN at0 ELSE 0 END AS e_start,
    CASE WHEN e_ok AND n > 800 THEN least(n, at0 + 800) ELSE n END AS e_end FROM ev_start)"""


def quality_of(relation: str, out: str = "scored") -> str:
    """CTEs adding the five scores and flags to a relation with instruction, input, output, e_text, e_ok (trimmed texts)."""
    han = lambda e: f"regexp_replace({e}, '[a-z0-9._+\\- ]+', '', 'g')"
    units = lambda e, h: (
        f"list_distinct(list_concat(regexp_extract_all({e}, '[a-z0-9][a-z0-9._+\\-]*'), "
        f"CASE WHEN length({h}) = 1 THEN [{h}] ELSE {grams(h, 2)} END))"
    )
    return f"""q_norm AS (
  SELECT *, {quality_norm('instruction')} AS nq, {quality_norm('output')} AS na, {quality_norm('e_text')} AS ne FROM {relation}),
q_han AS (SELECT *, {han('nq')} AS hq, {han('na')} AS ha, {han('ne')} AS he FROM q_norm),
q_units AS (SELECT *, {units('nq', 'hq')} AS uq, {units('na', 'ha')} AS ua, {units('ne', 'he')} AS ue FROM q_han),
q_parts AS (
  SELECT *, CASE WHEN e_ok THEN {share('ua', 'ue')} ELSE 0.0::DOUBLE END AS g,
    CASE WHEN length(na) < 8 THEN 0.25::DOUBLE WHEN length(na) < 20 THEN 0.62::DOUBLE WHEN length(na) > 1800 THEN 0.7::DOUBLE ELSE 0.92::DOUBLE END AS co,
    {clamp(f"(CASE WHEN length(nq) BETWEEN 5 AND 160 THEN 0.94::DOUBLE ELSE 0.55::DOUBLE END) - (CASE WHEN regexp_matches(instruction, '^(这|那|它|其|上述|以下|文中|该内容|这个)') AND {trim('input')} = '' THEN 0.28::DOUBLE ELSE 0.0::DOUBLE END)")} AS cl,
    {clamp(f"greatest({share('uq', 'ue')}, {share('uq', 'ua')}) * 0.55::DOUBLE + 0.42::DOUBLE")} AS r
  FROM q_units),
{out} AS (
  SELECT *, {half_up('g')} AS groundedness, {half_up('co')} AS completeness, {half_up('cl')} AS clarity, {half_up('r')} AS relevance,
    {half_up(clamp("CASE WHEN e_ok THEN g * 0.42::DOUBLE + co * 0.2::DOUBLE + cl * 0.2::DOUBLE + r * 0.18::DOUBLE ELSE co * 0.34::DOUBLE + cl * 0.34::DOUBLE + r * 0.32::DOUBLE END"))} AS overall,
    list_filter([CASE WHEN NOT e_ok THEN {lit(FLAG_NO_EVIDENCE)} WHEN g < 0.45 THEN {lit(FLAG_LOW_OVERLAP)} END,
      CASE WHEN co < 0.5 THEN {lit(FLAG_TOO_SHORT)} END, CASE WHEN cl < 0.7 THEN {lit(FLAG_VAGUE)} END,
      CASE WHEN regexp_matches(output, '详见|如上|略|无法回答') THEN {lit(FLAG_LOW_INFORMATION)} END,
      CASE WHEN length(instruction) > 500 OR length(output) > 4000 THEN {lit(FLAG_TOO_LONG)} END], lambda f: f IS NOT NULL) AS flags
  FROM q_parts)"""


SCORES = "groundedness, completeness, clarity, relevance, overall"
TASK = (
    f"CASE WHEN {trim('input')} <> '' THEN 'reading_comprehension' WHEN regexp_matches(instruction, '提取|列出|找出|抽取') THEN 'extraction' "
    "WHEN regexp_matches(instruction, '分析|比较|为什么|原因|影响') THEN 'analysis' ELSE 'closed_book_qa' END"
)
STATUS_WORDS = ("pending", "accepted", "rejected", "needs_revision", "accepted")


def conv_records(base: str = "conv_qa") -> str:
    start = HAN_QA if base == "han_qa" else CONV_QA
    return f"""{start}, c_trim AS (
  SELECT conv_id, turn, pos, {trim('instruction')} AS instruction, {trim('input')} AS input, {trim('output')} AS output,
    'conv_' || (conv_id // 16) AS document_id, 'conv_' || (conv_id // 16) || '.txt' AS file_name, 'chunk_' || conv_id AS chunk_id,
    '' AS e_text, false AS e_ok FROM {base}),
{quality_of('c_trim', 'c_scored')},
recs AS (SELECT *, 'qa_' || {base36_hash("document_id || '|' || chunk_id || '|' || instruction || '|' || output")} AS id, {TASK} AS task_type,
  pos AS created_at, {pick(STATUS_WORDS, 'conv_id')} AS review_status FROM c_scored)"""


DOC_RECORDS = f"""{DOC_QA}, {evidence_of('doc_qa')},
d_trim AS (SELECT * REPLACE ({trim('instruction')} AS instruction, {trim('output')} AS output) FROM located),
{quality_of('d_trim', 'd_scored')},
drecs AS (SELECT s.*, {TASK} AS task_type,
  CASE WHEN l.toxic = 1 THEN 'rejected' WHEN l.quality = 1 THEN 'accepted' WHEN l.quality = 0 THEN 'needs_revision' ELSE 'pending' END AS review_status
  FROM d_scored s LEFT JOIN labels l USING (doc_id))"""

HEADING = (
    rf"(?m)^(?:#{{1,6}}{W}+[^\n\r\x{{2028}}\x{{2029}}]+|={{3,}}{W}*第{W}*[0-9]+{W}*页{W}*={{3,}}"
    rf"|第[一二三四五六七八九十百千万0-9]+[章节篇部]{W}*[^\n]*)$"
)
SHORT_HEADING = rf"(?m)^#{{1,3}}{W}+[^\n\r\x{{2028}}\x{{2029}}]+$"


def sections_of(relation: str, key: str) -> str:
    """CTE ``sec`` (key, no, s, e, heading, text) of a relation with (key, text)."""
    title = trim(f"regexp_replace(regexp_replace(regexp_replace(regexp_extract(piece, {lit(HEADING)}), '^#{{1,6}}{W}+', ''), '^#+{W}*', ''), '^=+|=+$', '', 'g')")
    return f"""sec_marked AS (
  SELECT {key}, string_split(regexp_replace(text, {lit(HEADING)}, chr(1) || '\\0', 'g'), chr(1)) AS pieces FROM {relation} WHERE {trim('text')} <> ''),
sec_rows AS (SELECT {key}, len(pieces) AS k, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM sec_marked),
sec_placed AS (SELECT *, sum(length(piece)) OVER (PARTITION BY {key} ORDER BY i) AS e FROM sec_rows),
sec AS MATERIALIZED (
  SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) AS no, (e - length(piece))::BIGINT AS s, e::BIGINT AS e,
    CASE WHEN i > 1 THEN {title} WHEN k > 1 THEN '前言' END AS heading, piece AS text
  FROM sec_placed WHERE i > 1 OR k = 1 OR {trim('piece')} <> '')"""


def chunks_of(key: str, limit: int, overlap: int) -> str:
    """CTE ``chunk`` over ``sec``: the cursor loop as a recursion."""

    def end(cur: str) -> str:
        pe = f"least({cur} + {limit}, n)"
        low = f"{cur} + floor(({pe} - {cur}) * 0.45::DOUBLE)::BIGINT"
        hit = f"length(regexp_extract(substr(text, {low} + 1, {pe} - ({low})), '(?s)^.*[\\n。！？]'))"
        return f"CASE WHEN {pe} < n THEN greatest({cur} + 1, CASE WHEN {hit} > 0 THEN {low} + {hit} ELSE {pe} END) ELSE n END"

    return f"""walk AS (
  SELECT {key}, no, text, length(text) AS n, 0::BIGINT AS a, ({end('0::BIGINT')})::BIGINT AS b FROM (SELECT *, length(text) AS n FROM sec)
  UNION ALL
  SELECT {key}, no, text, n, a, ({end('a')})::BIGINT FROM (SELECT {key}, no, text, n, greatest(a + 1, b - {overlap}) AS a FROM walk WHERE b < n)),
chunk AS (
  SELECT w.{key}, 'chunk_' || lpad(i::VARCHAR, greatest(3, length(i::VARCHAR))::INT, '0') AS chunk_id, i AS chunk_index, total AS chunk_total,
    heading, s0 + a AS start_offset, s0 + b AS end_offset, substr(text, a + 1, b - a) AS text
  FROM (SELECT walk.*, sec.heading, sec.s AS s0, row_number() OVER (PARTITION BY walk.{key} ORDER BY walk.no, a) AS i,
          count(*) OVER (PARTITION BY walk.{key}) AS total FROM walk JOIN sec ON sec.{key} = walk.{key} AND sec.no = walk.no) w)"""


def short_chunks_of(relation: str, key: str, limit: int, overlap: int) -> str:
    def end(cur: str) -> str:
        window = f"substr(text, {cur} + 1, {limit})"
        para = f"(length(regexp_extract({window}, '(?s)^.*\\n\\n')) - 2)"
        sent = f"(length(regexp_extract({window}, '(?s)^.*[\\n。！？]')) - 1)"
        cut = f"CASE WHEN {para} > {limit} * 0.3::DOUBLE THEN {cur} + {para} WHEN {sent} > {limit} * 0.3::DOUBLE THEN {cur} + {sent} + 1 ELSE {cur} + {limit} END"
        return f"CASE WHEN {cur} + {limit} >= n THEN n ELSE {cut} END"

    title = trim(f"regexp_replace(regexp_extract(piece, {lit(SHORT_HEADING)}), '^#{{1,3}}{W}+', '')")
    return f"""ss_marked AS (
  SELECT {key}, text AS full_text, string_split(regexp_replace(text, {lit(SHORT_HEADING)}, chr(1) || '\\0', 'g'), chr(1)) AS pieces FROM {relation} WHERE {trim('text')} <> ''),
ss_rows AS (SELECT {key}, full_text, len(pieces) AS k, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS no FROM ss_marked),
ss AS MATERIALIZED (
  SELECT {key}, no, full_text, CASE WHEN k > 1 THEN {title} END AS heading, CASE WHEN k > 1 THEN {trim('piece')} ELSE piece END AS text
  FROM ss_rows WHERE k = 1 OR (no > 1 AND {trim('piece')} <> '')),
sw AS (
  SELECT {key}, no, text, length(text) AS n, 0::BIGINT AS a, ({end('0::BIGINT')})::BIGINT AS b FROM (SELECT *, length(text) AS n FROM ss) WHERE n > {limit}
  UNION ALL
  SELECT {key}, no, text, n, a, ({end('a')})::BIGINT FROM (SELECT {key}, no, text, n, greatest(b - {overlap}, a + 1) AS a FROM sw WHERE b < n)),
sp AS (
  SELECT {key}, no, 0 AS a, text AS piece FROM ss WHERE length(text) <= {limit}
  UNION ALL SELECT {key}, no, a, {trim('substr(text, a + 1, b - a)')} FROM sw),
sp_at AS (
  SELECT sp.*, ss.heading, greatest(instr(ss.full_text, {trim('substr(piece, 1, 50)')}) - 1, 0)::BIGINT AS start_offset,
    row_number() OVER (PARTITION BY sp.{key} ORDER BY sp.no, a) AS i, count(*) OVER (PARTITION BY sp.{key}) AS total
  FROM sp JOIN ss ON ss.{key} = sp.{key} AND ss.no = sp.no),
chunk AS (
  SELECT {key}, 'chunk_' || lpad(i::VARCHAR, greatest(3, length(i::VARCHAR))::INT, '0') AS chunk_id, i AS chunk_index, total AS chunk_total,
    heading, start_offset, start_offset + length(piece) AS end_offset, piece AS text FROM sp_at)"""


TWICE = f"""{CONV_QA}, twice AS (
  SELECT *, conv_id // 16 AS book FROM conv_qa
  UNION ALL
  SELECT conv_id, turn, pos + 500000000, lower(instruction) || '!!', input,
    CASE WHEN conv_id % 2 = 0 THEN output || ' and more' ELSE substr(output, 1, length(output) - 2) END, conv_id // 16 FROM conv_qa)"""

TRI = "CASE WHEN {a}.q = {b}.q THEN 1.0::DOUBLE ELSE {j} END"


def trigram_pair(a: str, b: str, field: str = "q") -> str:
    return f"CASE WHEN {a}.{field} = {b}.{field} THEN 1.0::DOUBLE ELSE {jaccard(f'{a}.g{field}', f'{b}.g{field}')} END"


def greedy(scope: str, threshold: float) -> str:
    """CTEs ``kept`` and ``captured`` over ``recs``: the best-to-worst scan as a recursion over the rank of each scope."""
    lex = lambda f: f"CASE WHEN a.c{f} = b.c{f} THEN 1.0::DOUBLE ELSE greatest({jaccard(f'a.s{f}', f'b.s{f}')}, {jaccard(f'a.p{f}', f'b.p{f}')}) END"
    return f"""g_canon AS (
  SELECT *, {scope} AS scope, {canonical('instruction')} AS cq, {canonical('output')} AS ca FROM recs),
g_sets AS MATERIALIZED (
  SELECT *, {chars('cq')} AS sq, {pair_set('cq')} AS pq, {chars('ca')} AS sa, {pair_set('ca')} AS pa,
    row_number() OVER (PARTITION BY scope ORDER BY overall DESC, groundedness DESC, length(output) DESC, pos) AS rank FROM g_canon),
g_parts AS (
  SELECT a.scope, a.rank AS hi, b.rank AS lo, {lex('q')} AS q, {lex('a')} AS a, a.document_id = b.document_id AS same
  FROM g_sets a JOIN g_sets b ON a.scope = b.scope AND a.rank < b.rank),
g_sims AS MATERIALIZED (
  SELECT scope, hi, lo, CASE WHEN q < 0.34 THEN q ELSE least(1.0::DOUBLE, q * 0.78::DOUBLE + a * 0.22::DOUBLE + (CASE WHEN same THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END)) END AS sim FROM g_parts),
g_near AS MATERIALIZED (SELECT scope, lo, list(hi) AS his FROM g_sims WHERE sim >= {threshold}::DOUBLE GROUP BY ALL),
g_scan AS (
  SELECT scope, 1::BIGINT AS rank, [1::BIGINT] AS kept FROM g_sets WHERE rank = 1
  UNION ALL
  SELECT p.scope, p.rank + 1, CASE WHEN n.his IS NOT NULL AND list_has_any(p.kept, n.his) THEN p.kept ELSE list_append(p.kept, p.rank + 1) END
  FROM g_scan p JOIN g_sets s ON s.scope = p.scope AND s.rank = p.rank + 1 LEFT JOIN g_near n ON n.scope = p.scope AND n.lo = p.rank + 1),
g_kept AS (SELECT scope, unnest(arg_max(kept, rank)) AS rank FROM g_scan GROUP BY scope),
kept AS (SELECT s.* FROM g_sets s JOIN g_kept USING (scope, rank)),
captured AS (
  SELECT d.scope, d.pos, d.id AS duplicate_id, {dedup_norm('d.instruction')} AS norm, k.pos AS kept_pos, k.id AS kept_id, {dedup_norm('k.instruction')} AS kept_norm, m.sim
  FROM (SELECT g_sims.scope, lo, arg_max(hi, (sim, -hi)) AS hi, max(sim) AS sim FROM g_sims JOIN g_kept ON g_kept.scope = g_sims.scope AND g_kept.rank = hi
        WHERE sim >= {threshold}::DOUBLE AND NOT EXISTS (SELECT 1 FROM g_kept x WHERE x.scope = g_sims.scope AND x.rank = lo) GROUP BY ALL) m
  JOIN g_sets d ON d.scope = m.scope AND d.rank = m.lo JOIN g_sets k ON k.scope = m.scope AND k.rank = m.hi)"""


def pairwise_replay(threshold: float) -> str:
    """CTE ``survivors`` over ``twice``: the turns of each book replayed in position order."""
    return f"""l_norm AS (SELECT *, {trigram_norm('instruction')} AS q, {trigram_norm('output')} AS a, row_number() OVER (PARTITION BY book ORDER BY pos) AS rn FROM twice),
l_sets AS MATERIALIZED (SELECT *, {grams('q', 3)} AS gq, {grams('a', 3)} AS ga FROM l_norm),
l_pairs AS (
  SELECT x.book, x.rn AS i, y.rn AS j, length(y.output) > length(x.output) AS longer, {trigram_pair('x', 'y')} AS qs, {trigram_pair('x', 'y', 'a')} AS ans
  FROM l_sets x JOIN l_sets y ON x.book = y.book AND x.rn < y.rn),
l_edges AS MATERIALIZED (
  SELECT book, i, list({{'j': j, 'longer': longer}} ORDER BY j) AS nb FROM l_pairs
  WHERE (CASE WHEN qs < 0.3 THEN qs ELSE qs * 0.7::DOUBLE + ans * 0.3::DOUBLE END) >= {threshold}::DOUBLE GROUP BY book, i),
l_turns AS (
  SELECT book, 0::BIGINT AS i, []::BIGINT[] AS dead FROM l_sets WHERE rn = 1
  UNION ALL
  SELECT t.book, t.i + 1,
    CASE WHEN e.nb IS NULL OR list_contains(t.dead, t.i + 1) THEN t.dead ELSE list_concat(t.dead, list_concat(
      list_transform(list_filter(e.nb, lambda x: NOT list_contains(t.dead, x.j) AND x.j < coalesce(list_min(list_transform(list_filter(e.nb, lambda z: z.longer AND NOT list_contains(t.dead, z.j)), lambda z: z.j)), 9223372036854775807)), lambda x: x.j),
      CASE WHEN len(list_filter(e.nb, lambda z: z.longer AND NOT list_contains(t.dead, z.j))) > 0 THEN [t.i + 1] ELSE []::BIGINT[] END)) END
  FROM l_turns t JOIN l_sets s ON s.book = t.book AND s.rn = t.i + 1 LEFT JOIN l_edges e ON e.book = t.book AND e.i = t.i + 1),
l_dead AS (SELECT book, arg_max(dead, i) AS dead FROM l_turns GROUP BY book),
survivors AS (SELECT s.* FROM l_sets s JOIN l_dead d USING (book) WHERE NOT list_contains(d.dead, s.rn))"""


def synonyms(e: str) -> str:
    return sub(sub(sub(e, "设置|设定|调整", "配置"), "怎样|怎么|如何进行", "如何"), "步骤|流程|办法", "方法")


def search_norm(e: str) -> str:
    return f"trim(regexp_replace({synonyms(f'lower({e})')}, '[^a-z0-9{HAN}._+\\-]+', ' ', 'g'))"


def search_tokens(e: str) -> str:
    s = synonyms(e)
    runs = f"regexp_extract_all({s}, '[{HAN}]+')"
    inner = f"flatten(list_transform({runs}, lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))"
    return f"list_distinct(list_concat(list_concat(regexp_extract_all({s}, '[a-z0-9][a-z0-9._+\\-]*'), {runs}), {inner}))"


def search_grams(e: str) -> str:
    c = f"replace({e}, ' ', '')"
    return f"CASE WHEN {c} = '' THEN []::VARCHAR[] WHEN length({c}) <= 2 THEN [{c}] ELSE {grams(c, 2)} END"


FIELDS = {"instruction": 4.0, "input": 1.25, "output": 2.2, "heading": 1.8, "fileName": 0.75}
FIELD_SOURCE = {"heading": "''", "fileName": "file_name"}


def search_of(base: str, asked: list[tuple[str, str, str]], where: str = "true") -> str:
    """CTE ``hits`` (query_id, pos, score, overall, matched_fields)."""
    values = ", ".join(f"({lit(i)}, {lit(t)}, {lit(m)})" for i, t, m in asked)
    norms = ", ".join(f"{search_norm(FIELD_SOURCE.get(f, f))} AS n_{f}" for f in FIELDS)
    sets = ", ".join(f"{search_tokens('n_' + f)} AS t_{f}, {search_grams('n_' + f)} AS g_{f}" for f in FIELDS)
    wanted = "CASE WHEN len(list_filter(qt, lambda t: length(t) > 1)) > 0 THEN list_filter(qt, lambda t: length(t) > 1) ELSE qt END"

    def score(f: str) -> str:
        exact = f"CASE WHEN contains(n_{f}, q) THEN 1.0::DOUBLE ELSE {share('qw', 't_' + f)} END"
        fuzzy = f"CASE WHEN len(qg) = 0 OR len(g_{f}) = 0 THEN 0.0::DOUBLE ELSE 2 * len(list_intersect(qg, g_{f}))::DOUBLE / (len(qg) + len(g_{f})) END"
        return f"CASE mode WHEN 'keyword' THEN {exact} WHEN 'fuzzy' THEN {fuzzy} ELSE ({exact}) * 0.64::DOUBLE + ({fuzzy}) * 0.36::DOUBLE END"

    scores = ", ".join(f"{score(f)} AS s_{f}" for f in FIELDS)
    total = " + ".join(["0.0::DOUBLE"] + [f"s_{f} * {w}::DOUBLE" for f, w in FIELDS.items()])
    matched = "list_filter([" + ", ".join(f"CASE WHEN s_{f} > 0.06 THEN {lit(f)} END" for f in FIELDS) + "], lambda f: f IS NOT NULL)"
    return f"""{conv_records(base)},
asked AS (SELECT * FROM (VALUES {values}) v(query_id, text, mode)),
asked_n AS (SELECT query_id, mode, {search_norm('text')} AS q FROM asked),
asked_t AS (SELECT *, {search_tokens('q')} AS qt, {search_grams('q')} AS qg FROM asked_n WHERE q <> ''),
asked_w AS (SELECT *, {wanted} AS qw FROM asked_t),
s_norm AS (SELECT pos, overall, {norms} FROM recs WHERE {where}),
s_sets AS (SELECT *, {sets} FROM s_norm),
s_scores AS (SELECT query_id, pos, overall, {scores} FROM s_sets CROSS JOIN asked_w),
s_match AS (SELECT *, {matched} AS matched FROM s_scores),
hits AS (
  SELECT query_id, pos, overall, array_to_string(matched, '|') AS matched_fields,
    {half_up(f"({total}) / 10.0::DOUBLE + CASE WHEN len(matched) > 1 THEN least(0.12::DOUBLE, len(matched) * 0.025::DOUBLE) ELSE 0.0::DOUBLE END", 4)} AS score FROM s_match),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, overall DESC, pos) AS rank FROM hits WHERE score > 0.025)"""


def letters(e: str) -> str:
    return f"regexp_replace({e}, '[^A-Za-z0-9 .,]', ' ', 'g')"


def strict(e: str) -> str:
    """DuckDB accepts trailing commas; standard JSON does not."""
    return f"(json_valid({e}) AND NOT regexp_matches({e}, ',\\s*[}}\\]]'))"


def _responses() -> str:
    q, a = f"'\"instruction\":\"' || {letters('instruction')} || '\"'", f"'\"output\":\"' || {letters('output')} || '\"'"
    full = f"{q} || ',\"input\":\"\",' || {a}"
    j = lambda *parts: "(" + " || ".join(parts) + ")"
    shapes = [
        j("'{\"items\":[{'", full, "'}]}'"),
        j("'[{'", full, "'}]'"),
        j("'{\"data\":[{'", full, "'},{'", q, "'}]}'"),
        j(lit("Sure:\n```json\n{\"records\":[{"), full, lit("}]}\n```\nbye")),
        j("'{\"items\":[{'", full, "',},]}'"),
        "replace(" + j("'{\"items\":[{'", full, "'}]}'") + ", '\"', '''')",
        j("'The data is {items: [{'", full, "'}]} as asked'"),
        j("'no data '", letters("output")),
        j("'{\"items\":[{'", q, "',\"input\":null,'", a, "'},{'", q, "',\"output\":5},{\"instruction\":\" \",'", a, "'},{'", q, "','", a, "',\"input\":\"x\"}]}'"),
        j("'{'", q, "','", a, "'}'"),
        lit("  \n "),
        lit('```\n{"items": oops}\n```'),
    ]
    cases = " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(shapes))
    repaired = "CASE WHEN regexp_extract(raw, '(?s)\\{.*\\}') <> '' THEN regexp_extract(raw, '(?s)\\{.*\\}') ELSE " + trim("raw") + " END"
    repaired = f"replace({repaired}, '''', '\"')"
    for pattern, by in ((r",\s*\}", "}"), (r",\s*\]", "]"), (r"([{,]\s*)(\w+)(\s*:)", r'\1"\2"\3')):
        repaired = sub(repaired, pattern, by)
    block = trim("regexp_extract(raw, '(?s)```(?:json)?\\s*(.*?)```', 1)")
    arrays = " ".join(f"WHEN json_type(root, '$.{k}') = 'ARRAY' THEN json_extract(root, '$.{k}[*]')" for k in rs.ARRAY_KEYS)
    text = lambda f: f"json_type(item, '$.{f}') = 'VARCHAR'"
    val = lambda f: f"json_extract_string(item, '$.{f}')"
    valid = (
        f"coalesce({text('instruction')} AND {trim(val('instruction'))} <> '' AND {text('output')} AND {trim(val('output'))} <> '' "
        f"AND (json_type(item, '$.input') IS NULL OR {text('input')}), false)"
    )
    return f"""{CONV_QA},
resp AS (SELECT conv_id, turn, CASE (conv_id + turn) % 12 {cases} END AS raw FROM conv_qa),
resp_text AS (SELECT *, {trim('raw')} = '' AS is_empty, {block} AS block, {repaired} AS mended FROM resp),
resp_strategy AS (
  SELECT *, CASE WHEN is_empty THEN 'empty' WHEN {strict('raw')} THEN 'direct' WHEN block <> '' AND {strict('block')} THEN 'fenced'
    WHEN block <> '' THEN 'none' WHEN {strict('mended')} THEN 'repaired' ELSE 'none' END AS strategy FROM resp_text),
resp_root AS (SELECT *, CASE strategy WHEN 'direct' THEN raw::JSON WHEN 'fenced' THEN block::JSON WHEN 'repaired' THEN mended::JSON END AS root FROM resp_strategy),
resp_items AS (
  SELECT *, CASE WHEN json_type(root) = 'ARRAY' THEN json_extract(root, '$[*]') {arrays}
    WHEN json_type(root, '$.instruction') = 'VARCHAR' THEN [root] END AS items FROM resp_root),
resp_rows AS (SELECT conv_id, turn, strategy, unnest(items) AS item, generate_subscripts(items, 1) AS item_no FROM resp_items),
checked AS (
  SELECT conv_id, turn, strategy, item_no::BIGINT AS item_no, CASE WHEN {text('instruction')} THEN {val('instruction')} END AS instruction,
    coalesce(CASE WHEN {text('input')} THEN {val('input')} END, '') AS input, CASE WHEN {text('output')} THEN {val('output')} END AS output, {valid} AS valid
  FROM resp_rows)"""


RESPONSES = _responses()
SKIPPED = f"{lit(rs.BAD_ITEM[0])} || item_no || {lit(rs.BAD_ITEM[1])}"

ROUND_LINES = f"""{CONV_QA},
round_lines AS (
  SELECT conv_id AS session_id, turn AS line_no, CASE WHEN conv_id % 3 = 0 AND turn >= 2 AND turn < 4 THEN '{{"round": 2, "items"' ELSE
    '{{"round":' || (turn // 2 + 1) || ',"items":[{{"instruction":"' || {letters('instruction')} || '","input":"","output":"' || {letters('output')} || '"}}],"finishReason":"length"}}' END AS line
  FROM conv_qa),
bad AS (SELECT session_id, min(line_no) AS at FROM round_lines WHERE NOT json_valid(line) GROUP BY 1),
good AS (SELECT r.*, b.at IS NOT NULL AS truncated FROM round_lines r LEFT JOIN bad b USING (session_id) WHERE b.at IS NULL OR r.line_no < b.at)"""

RUNS = """runs AS (
  SELECT doc_id AS run_id, source || '.txt' AS file_name, doc_id % 997 * 3600000 AS created_at, doc_id % 997 * 3600000 + n_chars AS updated_at,
    CASE WHEN doc_id % 4 = 0 THEN 'running' ELSE 'completed' END AS status, n_chars % 50 AS item_count FROM documents)"""


def fingerprint(max_chars: int = 6000) -> str:
    return f"sha256(text || '{{\"fileType\":\"txt\",\"maxCharsPerChunk\":{max_chars},\"chunkOverlap\":240,\"schemaVersion\":1}}')"


def part_user(lead: str) -> str:
    return (
        f"{lead} || 'Name: ' || source_name || {lit(chr(10))} || 'Type: ' || {lit(rq.FILE_TYPE_NAMES['txt'])} || {lit(chr(10))} || 'Characters: ' || char_count || {lit(chr(10))} "
        f"|| CASE WHEN part_total > 1 THEN 'Part: ' || part_no || '/' || part_total || chr(10) || 'Heading: ' || coalesce(nullif(heading, ''), '(none)') || chr(10) ELSE '' END "
        f"|| {lit(chr(10) + '<source>' + chr(10))} || text || {lit(chr(10) + '</source>')}"
    )


def parts_of(relation: str, key: str, limit: int) -> str:
    """CTE ``part``: rows of a relation with ``text``, whole up to ``limit`` characters, else as their chunks."""
    return f"""long_docs AS (SELECT * FROM {relation} WHERE length(text) > {limit}), {sections_of('long_docs', key)}, {chunks_of(key, 6000, 240)},
part AS (SELECT d.* EXCLUDE (text), length(d.text) AS char_count, 1::BIGINT AS part_no, 1::BIGINT AS part_total, NULL AS heading, d.text FROM {relation} d WHERE length(d.text) <= {limit}
  UNION ALL SELECT d.* EXCLUDE (text), length(d.text), c.chunk_index, c.chunk_total, c.heading, c.text FROM long_docs d JOIN chunk c USING ({key}))"""


FILE_STATES = """states AS (
  SELECT file_name, CASE WHEN min(conv_id) // 16 % 5 = 0 THEN 'error' ELSE 'done' END AS status FROM recs GROUP BY 1),
breakdown AS (
  SELECT s.file_name, s.status, CASE WHEN status = 'done' THEN count(*) ELSE 0 END AS item_count,
    CASE WHEN status = 'done' THEN count(*) FILTER (review_status = 'accepted') ELSE 0 END AS accepted, CASE WHEN status <> 'done' THEN 'timeout' END AS error
  FROM states s JOIN recs USING (file_name) GROUP BY 1, 2)"""

NAMES = f"names AS (SELECT source || '_' || doc_id || {pick(rel.NAME_SUFFIXES, 'doc_id')} AS file_name, n_chars * 1000 AS file_size FROM documents)"
FILE_TYPE = (
    "CASE lower(string_split(file_name, '.')[-1]) WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'pptx' THEN 'pptx' WHEN 'ppt' THEN 'pptx' WHEN 'txt' THEN 'txt' "
    "WHEN 'md' THEN 'md' WHEN 'markdown' THEN 'md' WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' END"
)
DOC_SEC = f"{DOC_TXT}, {sections_of('doc_txt', 'doc_id')}"
NEW_OLD = f"""{TWICE}, n_norm AS (SELECT *, {trigram_norm('instruction')} AS q FROM twice), n_sets AS MATERIALIZED (SELECT *, {grams('q', 3)} AS gq FROM n_norm)"""
PARAGRAPHS = f"len(list_filter(regexp_split_to_array(text, '\\n{W}*\\n'), lambda p: {trim('p')} <> ''))"

ORACLES: dict[str, str] = {
    "file_type_inferred": f"WITH {NAMES} SELECT file_name, {FILE_TYPE} AS file_type FROM names",
    "upload_gate": f"WITH {NAMES} SELECT *, {FILE_TYPE} AS file_type, CASE WHEN file_size > 10485760 THEN 'too_large' WHEN {FILE_TYPE} IS NULL THEN 'unsupported_type' END AS reject_reason FROM names",
    "upload_outcomes": f"""WITH named AS (SELECT source || '_' || doc_id || {pick(rel.NAME_SUFFIXES, 'doc_id')} AS file_name, n_chars * 1000 AS file_size, text AS html FROM documents),
        typed AS (SELECT *, {FILE_TYPE} AS file_type FROM named),
        stripped AS (SELECT *, CASE WHEN file_type = 'html' THEN {trim(PAGES_TEXT_EXPR)} ELSE html END AS t FROM typed),
        cleaned AS (SELECT *, {CLEAN_T} AS text FROM stripped),
        judged AS (SELECT *, CASE WHEN file_size > 10485760 THEN 'too_large' WHEN file_type IS NULL THEN 'unsupported_type' WHEN file_type IN ('pdf', 'docx') THEN 'needs_converter'
            WHEN file_type = 'pptx' THEN 'unreadable' WHEN text = '' THEN 'empty' END AS reject_reason FROM cleaned)
        SELECT file_name AS source_name, file_type, reject_reason, CASE WHEN reject_reason IS NULL THEN text END AS text, CASE WHEN reject_reason IS NULL THEN length(text) END AS char_count FROM judged""",
    "html_to_text": f"WITH {PAGES_TEXT} SELECT page_id, text FROM pages_text",
    "page_assembly": f"""WITH b AS (SELECT doc_id // 8 AS book_id, count(*) AS page_count,
        string_agg('=== 第 ' || (doc_id % 8 + 1) || ' 页 ===' || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id % 8) AS text FROM documents GROUP BY 1)
        SELECT *, length({trim('text')}) < 20 AS maybe_scanned FROM b""",
    "doc_stats": f"SELECT doc_id, length(text) AS char_count, {PARAGRAPHS}::BIGINT AS paragraph_count FROM documents",
    "doc_id": f"WITH {DOC_TXT} SELECT doc_id, 'doc_' || {base36_hash('''source_name || '|' || file_type || '|' || length(text) || '|' || substr(text, 1, 512)''')} AS document_id FROM doc_txt",
    "empty_document_guard": "SELECT doc_id, length(text) AS char_count FROM documents WHERE doc_id % 5 <> 0",
    "sections": f"WITH {PAGES_TEXT}, {sections_of('pages_text', 'page_id')} SELECT page_id, no AS section_index, heading, s AS start_offset, e AS end_offset, text FROM sec",
    "chunks": f"WITH RECURSIVE {PAGES_TEXT}, {sections_of('pages_text', 'page_id')}, {chunks_of('page_id', 6000, 240)} SELECT * FROM chunk",
    "document_chunks": f"WITH RECURSIVE {DOC_SEC}, {chunks_of('doc_id', 1500, 240)} SELECT * FROM chunk",
    "legacy_chunks": f"WITH RECURSIVE {short_chunks_of('documents', 'doc_id', 1500, 200)} SELECT * FROM chunk",
    "legacy_page_chunks": f"WITH RECURSIVE {PAGES_TEXT}, {short_chunks_of('pages_text', 'page_id', 6000, 200)} SELECT * FROM chunk",
    "chunk_progress": f"""WITH RECURSIVE {DOC_SEC}, {chunks_of('doc_id', 6000, 240)}
        SELECT doc_id AS document_id, chunk_id, chunk_index, chunk_total, length(text) % 5 AS new_items,
          (sum(length(text) % 5) OVER (PARTITION BY doc_id ORDER BY chunk_index))::BIGINT AS total_items, chunk_index AS done FROM chunk""",
    "evidence_spans": f"WITH {DOC_QA}, {evidence_of('doc_qa')} SELECT doc_id, e_text AS evidence_text, e_start AS start_offset, e_end AS end_offset, e_ok AS available FROM located",
    "evidence_binding": f"""WITH RECURSIVE {DOC_SEC}, {chunks_of('doc_id', 1500, 240)}, {qa_of('chunk', 'chunk_qa', 'chunk_index')},
        pairs AS (SELECT 'd_' || doc_id AS document_id, d.source_name, q.* FROM chunk_qa q JOIN doc_txt d USING (doc_id)), {evidence_of('pairs')}
        SELECT document_id, chunk_id, source_name AS file_name, start_offset + e_start AS start_offset, start_offset + e_end AS end_offset, e_text AS evidence_text, e_ok AS available FROM located""",
    "quality_scores": f"WITH {DOC_RECORDS} SELECT doc_id, {SCORES}, array_to_string(flags, '|') AS flags FROM drecs",
    "quality_without_evidence": f"WITH {conv_records()} SELECT conv_id, turn, {SCORES}, array_to_string(flags, '|') AS flags FROM recs",
    "quality_flags": f"WITH {conv_records('han_qa')} SELECT conv_id, turn, unnest(flags) AS flag FROM recs",
    "quality_han": f"WITH {conv_records('han_qa')} SELECT conv_id, turn, {SCORES} FROM recs",
    "task_types": f"WITH {HAN_QA} SELECT conv_id, turn, {TASK} AS task_type FROM han_qa",
    "record_ids": f"WITH {conv_records()} SELECT conv_id, turn, id, CASE WHEN overall >= 0.8 THEN 'strong' WHEN overall >= 0.65 THEN 'medium' ELSE 'attention' END AS tone FROM recs",
    "promote_unscored": f"""WITH {CONV_QA}, c_trim AS (SELECT conv_id, turn, {trim('instruction')} AS instruction, input, {trim('output')} AS output, '' AS e_text, false AS e_ok,
          'legacy_' || lpad((pos + 1)::VARCHAR, greatest(3, length((pos + 1)::VARCHAR))::INT, '0') AS chunk_id FROM conv_qa), {quality_of('c_trim')}
        SELECT conv_id, turn, 'qa_' || {base36_hash("'legacy_dataset|' || chunk_id || '|' || instruction || '|' || output")} AS id, chunk_id, '历史数据' AS file_name,
          0::BIGINT AS created_at, 'pending' AS review_status, {SCORES} FROM scored""",
    "exact_dedup": f"WITH {TWICE}, k AS (SELECT *, row_number() OVER (PARTITION BY {trigram_norm('instruction')} ORDER BY pos) AS rn FROM twice) SELECT pos, instruction, output FROM k WHERE rn = 1",
    "legacy_dedup": f"WITH RECURSIVE {TWICE}, {pairwise_replay(0.88)} SELECT pos, instruction, output FROM survivors",
    "legacy_dedup_loose": f"WITH RECURSIVE {TWICE}, {pairwise_replay(0.35)} SELECT pos, instruction, output FROM survivors",
    "new_vs_existing": f"""WITH {NEW_OLD} SELECT pos, instruction FROM n_sets n WHERE pos % 4 = 0
        AND NOT EXISTS (SELECT 1 FROM n_sets o WHERE o.pos % 4 <> 0 AND {trigram_pair('n', 'o')} >= 0.45::DOUBLE)""",
    "round_avg_similarity": f"""WITH {NEW_OLD}, books AS (SELECT DISTINCT book FROM n_sets WHERE pos % 4 = 0),
        means AS (SELECT n.book, avg({trigram_pair('n', 'o')}) AS m FROM n_sets n JOIN n_sets o ON n.book = o.book AND o.pos % 4 <> 0 WHERE n.pos % 4 = 0 GROUP BY 1)
        SELECT book, round(coalesce(m, 0.0::DOUBLE), 6) AS avg_similarity FROM books LEFT JOIN means USING (book)""",
    "near_dedup": f"WITH RECURSIVE {conv_records()}, {greedy('document_id', 0.78)} SELECT scope AS document, pos, id FROM kept",
    "near_dedup_han": f"WITH RECURSIVE {conv_records('han_qa')}, {greedy('document_id', 0.78)} SELECT scope AS document, pos, id FROM kept",
    "near_dedup_global": f"WITH RECURSIVE {conv_records()}, {greedy('1', 0.78)} SELECT pos, id FROM kept",
    "dup_groups": f"""WITH RECURSIVE {conv_records()}, {greedy('document_id', 0.78)}
        SELECT scope AS document, 'dup_' || kept_id AS group_id, kept_id, count(*) AS duplicates, max({half_up('sim')}) AS similarity,
          CASE WHEN bool_and(norm = kept_norm) THEN 'exact' ELSE 'near_duplicate' END AS reason FROM captured GROUP BY 1, 2, 3""",
    "dup_audit": f"WITH RECURSIVE {conv_records()}, {greedy('document_id', 0.78)} SELECT pos, kept_pos, kept_id, duplicate_id, {half_up('sim')} AS similarity FROM captured",
    "restore_duplicate": f"""WITH RECURSIVE {conv_records()}, {greedy('document_id', 0.78)}
        SELECT pos, review_status AS state FROM kept UNION ALL SELECT pos, CASE WHEN pos % 3 = 0 THEN 'pending' ELSE 'absorbed' END FROM captured""",
    "search_keyword": f"WITH {search_of('conv_qa', [('a', SEARCH_TEXT, 'keyword')])} SELECT pos, score, matched_fields FROM ranked WHERE rank <= 50",
    "search_fuzzy": f"WITH {search_of('conv_qa', [('a', SEARCH_TEXT, 'fuzzy')])} SELECT pos, score, matched_fields FROM ranked WHERE rank <= 50",
    "search_hybrid": "WITH " + search_of("han_qa", [("a", HAN_SEARCH_TEXT, "hybrid")], "review_status IN ('accepted', 'pending')") + " SELECT pos, score, matched_fields FROM ranked WHERE rank <= 50",
    "search_many": "WITH "
    + search_of("han_qa", [("a", SEARCH_TEXT, "hybrid"), ("b", HAN_SEARCH_TEXT, "hybrid"), ("c", "导出格式", "keyword"), ("d", "  ", "fuzzy")])
    + """, browsed AS (SELECT 'd' AS query_id, row_number() OVER (ORDER BY overall DESC, created_at DESC, pos)::INT AS rank, pos, overall AS score FROM recs)
        SELECT query_id, rank::INT AS rank, pos, score FROM ranked WHERE rank <= 20 UNION ALL SELECT * FROM browsed WHERE rank <= 20""",
    "browse_top": f"WITH {conv_records()} SELECT pos, overall AS score FROM recs ORDER BY overall DESC, created_at DESC, pos LIMIT 25",
    "facet_filter": f"WITH {DOC_RECORDS} SELECT doc_id, review_status, overall FROM drecs WHERE review_status IN ('accepted', 'pending') AND task_type = 'closed_book_qa' AND overall BETWEEN 0.5 AND 0.9",
    "quality_bands": f"WITH {DOC_RECORDS} SELECT doc_id, CASE WHEN overall >= 0.8 THEN 'strong' WHEN overall >= 0.65 THEN 'medium' ELSE 'attention' END AS tone FROM drecs",
    "page_slice": f"WITH {conv_records()} SELECT pos, overall FROM recs ORDER BY overall DESC, pos LIMIT 50 OFFSET 50",
    "page_count": f"WITH {CONV_QA} SELECT greatest(1, ceil(count(*) / 50.0))::BIGINT AS total_pages FROM conv_qa",
    "review_summary": f"""WITH {DOC_RECORDS} SELECT source AS origin, count(*) AS total, count(*) FILTER (review_status = 'pending') AS pending, count(*) FILTER (review_status = 'accepted') AS accepted,
          count(*) FILTER (review_status = 'rejected') AS rejected, count(*) FILTER (review_status = 'needs_revision') AS needs_revision,
          count(*) FILTER (overall < 0.65) AS attention, count(*) FILTER (overall >= 0.8) AS strong, round(sum(round(overall * 1000)::BIGINT) / 1000.0::DOUBLE / count(*), 9) AS average_quality,
          floor(count(*) FILTER (review_status <> 'pending') * 100 / count(*)::DOUBLE + 0.5)::BIGINT AS coverage FROM drecs GROUP BY 1""",
    "files_in_order": f"WITH {conv_records()} SELECT file_name, min(pos) AS first_pos FROM recs GROUP BY 1",
    "file_breakdown": f"WITH {conv_records()}, {FILE_STATES} SELECT * FROM breakdown",
    "batch_summary": f"""WITH {conv_records()}, {FILE_STATES} SELECT count(*) AS total_files, count(*) FILTER (status = 'done') AS success_files, count(*) FILTER (status <> 'done') AS failed_files,
          sum(item_count)::BIGINT AS total_items, sum(accepted)::BIGINT AS accepted_items, count(*) FILTER (accepted > 0) AS exportable_files,
          floor(count(*) FILTER (status = 'done') * 100 / count(*)::DOUBLE + 0.5)::BIGINT AS success_rate FROM breakdown""",
    "review_update": f"WITH {conv_records()} SELECT conv_id, turn, CASE WHEN turn = 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'accepted' ELSE 'rejected' END ELSE review_status END AS review_status FROM recs",
    "review_edit": f"""WITH {conv_records()}, edited AS (SELECT conv_id, turn, id, instruction, input, CASE WHEN conv_id % 2 = 0 THEN '略' ELSE output END AS output, e_text, e_ok,
          CASE WHEN conv_id % 2 = 0 THEN 'needs_revision' ELSE review_status END AS review_status FROM recs), {quality_of('edited').replace('q_', 'r_')}
        SELECT conv_id, turn, id, output, review_status, {SCORES} FROM scored""",
    "alpaca_export": f"WITH {conv_records('han_qa')} SELECT instruction, input, output FROM recs WHERE review_status = 'accepted'",
    "sharegpt_export": f"""WITH {conv_records('han_qa')} SELECT pos, 'human' AS from_0, CASE WHEN input <> '' THEN instruction || chr(10) || chr(10) || input ELSE instruction END AS value_0,
          'gpt' AS from_1, output AS value_1 FROM recs WHERE review_status = 'accepted'""",
    "export_per_file": f"WITH {conv_records()} SELECT regexp_replace(file_name, '\\.[^.]+$', '') || '_alpaca.json' AS export_name, count(*) AS rows FROM recs WHERE review_status = 'accepted' GROUP BY 1",
    "parse_responses": f"WITH {RESPONSES} SELECT * FROM checked",
    "parse_counts": f"""WITH {RESPONSES}, per AS (SELECT conv_id, turn, count(*) AS total_count, count(*) FILTER (valid) AS valid_count, list({SKIPPED} ORDER BY item_no) FILTER (NOT valid) AS skipped FROM checked GROUP BY 1, 2)
        SELECT r.conv_id, r.turn, strategy, coalesce(total_count, 0) AS total_count, coalesce(valid_count, 0) AS valid_count,
          array_to_string(list_filter(list_concat([CASE WHEN strategy = 'empty' THEN {lit(rs.EMPTY_RESPONSE)} END, CASE WHEN json_type(root) = 'OBJECT' AND items IS NULL THEN {lit(rs.NO_ARRAY)} END,
            CASE WHEN strategy = 'repaired' THEN {lit(rs.REPAIRED)} END, CASE WHEN strategy = 'none' THEN CASE WHEN block <> '' THEN {lit(rs.BAD_BLOCK)} ELSE {lit(rs.UNPARSABLE)} END END],
            coalesce(skipped, []::VARCHAR[])), lambda m: m IS NOT NULL), '|') AS parse_errors
        FROM resp_items r LEFT JOIN per USING (conv_id, turn)""",
    "chunk_requests": f"""WITH RECURSIVE {DOC_SEC}, {chunks_of('doc_id', 6000, 240)} SELECT c.doc_id, c.chunk_id, {lit(rq.CHUNK_SYSTEM)} AS system,
          'Document: ' || d.source_name || chr(10) || 'Part: ' || chunk_index || '/' || chunk_total || chr(10) || 'Heading: ' || coalesce(nullif(heading, ''), '(none)') || {lit(chr(10) * 2 + '<source>' + chr(10))} || c.text || {lit(chr(10) + '</source>')} AS user,
          16384::BIGINT AS max_tokens FROM chunk c JOIN doc_txt d USING (doc_id)""",
    "continuations": f"""WITH RECURSIVE {DOC_SEC}, {chunks_of('doc_id', 6000, 240)},
        asked AS (SELECT *, regexp_split_to_array(text, '[.!?\\n]') AS a FROM chunk)
        SELECT c.doc_id, c.chunk_id, {lit(rq.CONTINUE_SYSTEM)} AS system,
          'Document: ' || d.source_name || chr(10) || 'Heading: ' || coalesce(nullif(heading, ''), '(none)') || chr(10) || 'Questions so far:' || chr(10) ||
          array_to_string(a[greatest(1, len(a) - 79):], chr(10)) || {lit(chr(10) * 2 + '<source>' + chr(10))} || c.text || {lit(chr(10) + '</source>')} AS user,
          8192::BIGINT AS max_tokens FROM asked c JOIN doc_txt d USING (doc_id)""",
    "single_requests": f"""WITH RECURSIVE {DOC_TXT}, {parts_of('doc_txt', 'doc_id', 6000)}
        SELECT doc_id, part_no, part_total, {lit(rq.SUMMARY_SYSTEM)} AS system, {part_user(lit('Build the dataset from this document.' + chr(10)))} AS user, NULL::BIGINT AS max_tokens FROM part""",
    "deep_requests": f"""WITH RECURSIVE {DOC_TXT}, {parts_of('doc_txt', 'doc_id', 6000)}
        SELECT doc_id, part_no, part_total, CASE WHEN doc_id % 3 = 0 THEN {lit(rq.DOCUMENT_SYSTEM)} ELSE {lit(rq.CONTINUE_SYSTEM)} END AS system,
          {part_user("(CASE WHEN doc_id % 3 = 0 THEN " + lit('Build the dataset from this document.' + chr(10)) + " ELSE 'Round ' || (doc_id % 3 + 1) || ': ' || (doc_id % 17) || " + lit(' items exist already; find different ones.' + chr(10)) + " END)")} AS user,
          NULL::BIGINT AS max_tokens FROM part""",
    "legacy_requests": f"""WITH RECURSIVE {DOC_TXT}, {short_chunks_of('doc_txt', 'doc_id', 6000, 200)} SELECT c.doc_id, c.chunk_id, {lit(rq.EXHAUSTIVE_SYSTEM)} AS system,
          'Document: ' || d.source_name || chr(10) || 'Type: ' || {lit(rq.FILE_TYPE_NAMES['txt'])} || chr(10) || 'Characters: ' || length(d.text) || chr(10) || 'Part: ' || chunk_index || '/' || chunk_total ||
          CASE WHEN coalesce(heading, '') <> '' THEN chr(10) || 'Heading: ' || heading ELSE '' END || {lit(chr(10) * 2 + '<source>' + chr(10))} || c.text || {lit(chr(10) + '</source>')} AS user,
          NULL::BIGINT AS max_tokens FROM chunk c JOIN doc_txt d USING (doc_id)""",
    "size_routing": "SELECT doc_id, CASE WHEN length(text) > 6000 THEN 'chunked' ELSE 'single' END AS route FROM documents",
    "fingerprints": f"SELECT doc_id, {fingerprint()} AS fingerprint FROM documents",
    "resume_pending": f"""WITH RECURSIVE {DOC_SEC}, {chunks_of('doc_id', 1500, 240)}, parts AS (SELECT c.doc_id, c.chunk_id, c.chunk_index, {fingerprint().replace('text', 'd.text')} AS fp FROM chunk c JOIN doc_txt d USING (doc_id))
        SELECT doc_id, chunk_id FROM parts p WHERE NOT EXISTS (SELECT 1 FROM parts x WHERE x.doc_id = p.doc_id AND x.fp = p.fp AND x.chunk_id = p.chunk_id AND (x.doc_id + x.chunk_index) % 2 = 0)""",
    "checkpoint_match": "SELECT doc_id AS session_id, 1::BIGINT AS schema_version FROM documents WHERE doc_id % 3 = 1",
    "valid_round_prefix": f"WITH {ROUND_LINES} SELECT session_id, line_no, (line::JSON->>'round')::BIGINT AS round, json_array_length(line::JSON, '$.items')::BIGINT AS item_count, truncated FROM good",
    "appended_rounds": f"""WITH {CONV_QA} SELECT conv_id::VARCHAR AS session_id, floor(turn / 2 + 1)::BIGINT AS round, 1::BIGINT AS item_no, instruction, input, output,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line_no, CASE WHEN turn % 4 < 2 THEN 'length' ELSE 'stop' END AS finish_reason, false AS truncated FROM conv_qa""",
    "session_progress": f"WITH {ROUND_LINES} SELECT session_id, count(*) AS total_rounds, sum(json_array_length(line::JSON, '$.items'))::BIGINT AS total_items, arg_max(line::JSON->>'finishReason', (line::JSON->>'round')::BIGINT) AS last_finish_reason FROM good GROUP BY 1",
    "session_items": f"WITH {ROUND_LINES} SELECT session_id, (line::JSON->>'round')::BIGINT AS round, 1::BIGINT AS item_no, line::JSON->'items'->0->>'instruction' AS instruction, line::JSON->'items'->0->>'input' AS input, line::JSON->'items'->0->>'output' AS output FROM good",
    "history_latest": f"WITH {RUNS} SELECT run_id, file_name, created_at, item_count FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 50",
    "expired_sessions": f"WITH {RUNS} SELECT run_id, CASE WHEN 997 * 3600000::BIGINT - updated_at > 86400000 THEN 'expired' ELSE 'kept' END AS state FROM runs",
    "pending_sessions": f"WITH {RUNS} SELECT run_id, status FROM runs WHERE status <> 'completed'",
    "progress_latest": """SELECT user_id AS run_id, count(*) AS events, floor(arg_max(value, event_id))::BIGINT AS done, 1000::BIGINT AS total, arg_max(event_id % 7, event_id) AS total_items FROM events GROUP BY 1""",
}


# --- whole runs with the rule-based generator ------------------------------------------------------------------------


def generated(relation: str, out: str) -> str:
    """CTE adding the rule-based question (heading or first sentence) and answer (longest sentence) to rows with ``text``."""
    # The generator strips with the host language's own white space class, which also covers the separators 1C-1F and NEL.
    strip = lambda e: f"regexp_replace({e}, '^[\\s\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]+|[\\s\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]+$', '', 'g')"
    return f"""{out}_s AS (
  SELECT *, list_filter(list_transform(regexp_split_to_array(text, '[.!?。！？\\n]'), lambda x: {strip('x')}), lambda x: x <> '') AS s FROM {relation}),
{out} AS (
  SELECT *, CASE WHEN regexp_replace(s[1], '^#+\\s*', '') <> '' THEN regexp_replace(s[1], '^#+\\s*', '') ELSE s[1] END AS instruction,
    list_sort(list_transform(s, lambda x, i: {{'k': -length(x), 'i': i, 's': x}}))[1].s AS output FROM {out}_s WHERE len(s) > 0)"""


PAGE_DOCS = f"""{PAGES_TEXT}, page_docs AS (
  SELECT page_id, 'page_' || page_id || '.html' AS source_name, text,
    'doc_' || {base36_hash("'page_' || page_id || '.html|html|' || length(text) || '|' || substr(text, 1, 512)")} AS document_id FROM pages_text WHERE {trim('text')} <> '')"""

PAGE_RECORDS = f"""{PAGE_DOCS}, {sections_of('page_docs', 'page_id')}, {chunks_of('page_id', 6000, 240)}, {generated('chunk', 'gen')},
gen_doc AS (SELECT g.page_id, g.chunk_id, g.chunk_index, g.heading, g.start_offset, g.text AS chunk_text, g.instruction, g.output, '' AS input, d.document_id, d.source_name
  FROM gen g JOIN page_docs d USING (page_id)),
{evidence_of('gen_doc', 'gen_ev')},
gen_trim AS (SELECT * REPLACE ({trim('instruction')} AS instruction, {trim('output')} AS output) FROM gen_ev),
{quality_of('gen_trim', 'gen_q')},
recs AS (SELECT *, 'qa_' || {base36_hash("document_id || '|' || chunk_id || '|' || instruction || '|' || output")} AS id, {TASK} AS task_type,
  chunk_index * 10000000 + 1000001 AS pos FROM gen_q),
{greedy('document_id', 0.78)}"""

ORACLES["best_page_records"] = f"""WITH RECURSIVE {PAGE_RECORDS}
  SELECT id, instruction, output, source_name AS file_name, heading, start_offset + e_start AS start_offset, start_offset + e_end AS end_offset, overall, task_type
  FROM kept ORDER BY overall DESC, id, pos LIMIT 20"""
ORACLES["deep_rounds"] = f"""WITH {PAGE_DOCS}, {generated('page_docs', 'gen')}
  SELECT source_name AS session_id, 1 AS round, 1::BIGINT AS valid_count, 'stop' AS finish_reason, 'finished' AS stop_reason, 0.0::DOUBLE AS avg_similarity FROM gen"""
# What the rounds of the stand-in with five moods must give: its questions are hashes of the part's text, so no two of them resemble each other.
_MOODY = f"""{PAGE_DOCS}, {parts_of('page_docs', 'page_id', 600)},
asked AS (SELECT page_id % 5 AS mood, source_name AS session_id, part_no, text, r::INTEGER AS round FROM part, range(1, 6) t(r)),
item AS (SELECT session_id, round, md5(CASE WHEN mood = 1 THEN text ELSE text || '|' || round || '|' || i END) AS q
  FROM asked, range(1, 3) u(i) WHERE (i = 1 OR mood = 2) AND NOT (round = 2 AND mood IN (1, 3))),
grammed AS MATERIALIZED (SELECT session_id, round, q, {grams('q', 3)} AS g FROM item),
alike AS (SELECT session_id, round, avg(CASE WHEN a.q = b.q THEN 1.0::DOUBLE ELSE {jaccard('a.g', 'b.g')} END) AS m FROM grammed a JOIN grammed b USING (session_id, round) GROUP BY 1, 2),
called AS (SELECT session_id, round, mood, count(*) AS parts FROM asked GROUP BY 1, 2, 3),
counted AS (
  SELECT c.*, coalesce(n, 0) AS valid_count, m FROM called c LEFT JOIN (SELECT session_id, round, count(*) AS n FROM item GROUP BY 1, 2) USING (session_id, round) LEFT JOIN alike USING (session_id, round)),
judged AS (
  SELECT *, CASE WHEN mood = 3 AND round = 2 THEN 'failed' WHEN valid_count = 0 THEN 'exhausted' WHEN mood = 0 THEN 'finished' WHEN round > 1 AND m > 0.9 THEN 'repeated'
    WHEN round = 5 THEN 'round_limit' END AS stop_reason FROM counted),
logged AS (
  SELECT session_id, round, valid_count, (sum(valid_count) OVER (PARTITION BY session_id ORDER BY round))::BIGINT AS total_items,
    CASE WHEN stop_reason IS NULL OR stop_reason <> 'failed' THEN CASE mood WHEN 0 THEN 'stop' ELSE 'length' END END AS finish_reason,
    CASE stop_reason WHEN 'failed' THEN 'unavailable' END AS error, stop_reason, round(m, 6) AS avg_similarity,
    CASE WHEN stop_reason IS NULL OR stop_reason <> 'failed' THEN parts END AS prompt_tokens,
    CASE WHEN stop_reason IS NULL OR stop_reason <> 'failed' THEN parts * CASE mood WHEN 2 THEN 2 ELSE 1 END END AS completion_tokens
  FROM judged QUALIFY round <= min(CASE WHEN stop_reason IS NOT NULL THEN round END) OVER (PARTITION BY session_id))"""
ORACLES["deep_stop_reasons"] = f"WITH RECURSIVE {_MOODY} SELECT * FROM logged"
ORACLES["round_events"] = f"""WITH RECURSIVE {_MOODY}
  SELECT 'round' AS type, session_id AS run_id, (2 * round - 1)::BIGINT AS seq, round::BIGINT AS round, valid_count AS new_items, total_items, finish_reason,
    CASE stop_reason WHEN 'failed' THEN 'failed' ELSE 'completed' END AS status, error AS message FROM logged
  UNION ALL SELECT 'done', session_id, (2 * round)::BIGINT, round::BIGINT, valid_count, total_items, finish_reason, stop_reason, NULL FROM logged WHERE stop_reason <> 'failed'"""

_ESCAPED = lambda e: f"length(replace(replace({e}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)))"
_USER_LENGTH = (
    "length('Document: ' || source_name || ' Part: ' || chunk_index || '/' || chunk_total || ' Heading: ' || coalesce(nullif(heading, ''), '(none)')) "
    f"+ {len(chr(10) * 2 + '<source>' + chr(10))} + length(text) + {len(chr(10) + '</source>')}"
)
_RAW_LENGTH = f"""{len('{"items": [{"instruction": "", "input": "", "output": ""}]}')} + {_ESCAPED('instruction')} + {_ESCAPED('output')}"""
ORACLES["run_totals"] = f"""WITH RECURSIVE {PAGE_RECORDS},
  tokens AS (SELECT d.document_id, sum(({_USER_LENGTH}) // 4)::BIGINT AS prompt_tokens, sum(({_RAW_LENGTH}) // 4)::BIGINT AS completion_tokens, count(*) AS total_chunks
    FROM (SELECT c.*, g.instruction, g.output, p.source_name, p.document_id FROM chunk c JOIN gen g USING (page_id, chunk_id) JOIN page_docs p USING (page_id)) d GROUP BY 1),
  before AS (SELECT document_id, count(*) AS total_before_dedup FROM recs GROUP BY 1),
  after AS (SELECT document_id, count(*) AS total_after_dedup FROM kept GROUP BY 1)
  SELECT document_id, total_chunks, total_before_dedup, total_after_dedup, 0::BIGINT AS failed_chunks, 0::BIGINT AS parse_warnings, prompt_tokens, completion_tokens,
    total_before_dedup - total_after_dedup AS dedup_removed FROM tokens JOIN before USING (document_id) JOIN after USING (document_id)"""
ORACLES["legacy_extraction"] = f"""WITH RECURSIVE {PAGE_DOCS}, {short_chunks_of('page_docs', 'page_id', 6000, 200)}, {generated('chunk', 'gen')},
  twice AS (SELECT d.document_id AS book, d.document_id, g.chunk_id, g.chunk_index AS pos, g.instruction, g.output FROM gen g JOIN page_docs d USING (page_id)),
  {pairwise_replay(0.88)} SELECT document_id, chunk_id, instruction, output FROM survivors"""
ORACLES["resumed_run"] = f"""WITH RECURSIVE {PAGE_RECORDS}
  SELECT source_name AS session_id, chunk_id, id, pos, instruction, output, overall, 1::BIGINT AS calls FROM kept"""
ORACLES["run_events"] = f"""WITH RECURSIVE {PAGE_RECORDS},
  sent AS (SELECT c.*, p.source_name FROM chunk c JOIN page_docs p USING (page_id)),
  asked AS (SELECT source_name AS session_id, chunk_id, ({_USER_LENGTH}) % 5 = 0 AS down, EXISTS (SELECT 1 FROM gen g WHERE g.page_id = sent.page_id AND g.chunk_id = sent.chunk_id) AS answered FROM sent),
  totals AS (SELECT session_id, coalesce(n, 0) AS n, coalesce(k, 0) AS k FROM (SELECT source_name AS session_id, count(*) AS n FROM recs GROUP BY 1)
    LEFT JOIN (SELECT source_name AS session_id, count(*) AS k FROM kept GROUP BY 1) USING (session_id)),
  events AS (
    SELECT 1 AS run_no, session_id, chunk_id, 'retrying' AS status, unnest([2, 3]) AS attempt, NULL AS items, NULL AS message FROM asked WHERE down
    UNION ALL SELECT 1, session_id, chunk_id, 'failed', 3, 0, 'unavailable' FROM asked WHERE down
    UNION ALL SELECT 1 + down::INTEGER, session_id, chunk_id, 'completed', 1, answered::BIGINT, NULL FROM asked
    UNION ALL SELECT 2, session_id, chunk_id, 'resumed', NULL, NULL, NULL FROM asked WHERE NOT down
    UNION ALL SELECT 2, session_id, NULL, 'dedup', 1, n - k, NULL FROM totals
    UNION ALL SELECT 2, session_id, NULL, 'done', 2, k, NULL FROM totals)
  SELECT run_no, session_id, chunk_id, status, attempt::INTEGER AS attempt, items::BIGINT AS items, message FROM events"""
