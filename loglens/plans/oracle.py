"""Oracle SQL (DuckDB dialect) for every catalogued query.

Each statement re-derives its input view from the raw driver tables with
DuckDB functions and computes the expected result in a way that does not
share logic with the Spark plan (e.g. a recursive walk where Spark uses a
closed-form window).  DuckDB's regexes are RE2 (no lookahead, ASCII ``\\s``):
the driver data only contains ASCII blanks and newlines, which keeps the
whitespace semantics equal.
"""

from __future__ import annotations

from loglens import defaults
from loglens.plans import fixtures as fx


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _case(index_sql: str, values: list) -> str:
    parts = " ".join(f"WHEN {i} THEN {q(v) if v is not None else 'NULL'}" for i, v in enumerate(values))
    return f"CASE {index_sql} {parts} END"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


# ------------------------------------------------------------------ F1 logs
F1_LOGS = f"""
base_logs AS (
  SELECT conv_id AS session_id, turn,
    CASE WHEN turn = 5 THEN 'not a date'
         ELSE '2024-01-01 ' || lpad(CAST(CAST(floor(floor(turn / 4) / 60) AS BIGINT) AS VARCHAR), 2, '0')
              || ':' || lpad(CAST(CAST(floor(turn / 4) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ':00' END AS query_timestamp,
    'u' || CAST((conv_id * 3 + turn) % 50 AS VARCHAR) AS username, text,
    {_case('turn % 2', fx.COS)} AS co,
    {_case('conv_id % 3', fx.USER_TYPES)} AS user_type,
    {_case('(conv_id + CASE WHEN turn % 4 = 0 THEN 1 ELSE 0 END) % 8', fx.DIVISIONS)} AS division
  FROM conversations WHERE role = 'user'
),
logs AS (
  SELECT session_id, turn * 10 AS seq, query_timestamp, username, text AS prompt, co, user_type, division FROM base_logs
  UNION ALL
  SELECT session_id, turn * 10 + k, query_timestamp, username, {_case(f'(turn + k) % {len(fx.SHORT_TURNS)}', fx.SHORT_TURNS)}, co, user_type, division
  FROM base_logs JOIN (SELECT unnest([1, 2]) AS k) ON k <= 1 + session_id % 2
  WHERE (session_id * 7 + turn) % 3 = 0
)"""

NORM = f"""
norm AS (
  SELECT session_id, seq, username,
    {_strip("coalesce(prompt, '')")} AS prompt,
    lower({_strip("coalesce(co, '')")}) AS co,
    lower({_strip("coalesce(user_type, '')")}) AS user_type,
    lower({_strip("coalesce(division, '')")}) AS division,
    try_cast(query_timestamp AS TIMESTAMP) AS query_timestamp
  FROM logs
),
norm2 AS (
  SELECT *, CAST(len(regexp_extract_all(prompt, '\\S+')) AS BIGINT) AS prompt_token_count,
         len(regexp_extract_all(prompt, '\\S+')) < {defaults.MIN_PROMPT_TOKENS} AS is_short_prompt
  FROM norm
)"""

# Turn-by-turn walk of the short-prompt merge (recursive CTE).
WALK = """
ord AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY query_timestamp ASC NULLS LAST, seq) AS rn
  FROM norm2 WHERE session_id IS NOT NULL
),
walk AS (
  SELECT o.session_id, o.rn,
    CASE WHEN o.is_short_prompt AND n.prompt IS NOT NULL THEN o.prompt || ' ' || n.prompt ELSE o.prompt END AS merged_prompt,
    CASE WHEN o.is_short_prompt AND n.prompt IS NOT NULL THEN 2 ELSE 1 END AS step
  FROM ord o LEFT JOIN ord n ON n.session_id = o.session_id AND n.rn = o.rn + 1
  WHERE o.rn = 1
  UNION ALL
  SELECT o.session_id, o.rn,
    CASE WHEN o.is_short_prompt AND n.prompt IS NOT NULL THEN o.prompt || ' ' || n.prompt ELSE o.prompt END,
    CASE WHEN o.is_short_prompt AND n.prompt IS NOT NULL THEN 2 ELSE 1 END
  FROM walk w JOIN ord o ON o.session_id = w.session_id AND o.rn = w.rn + w.step
  LEFT JOIN ord n ON n.session_id = o.session_id AND n.rn = o.rn + 1
)"""


def _mode(col: str) -> str:
    return f"""
m_{col} AS (
  SELECT session_id, {col} FROM (
    SELECT session_id, {col}, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, {col} ASC) AS r
    FROM ord GROUP BY session_id, {col}) WHERE r = 1
)"""


SESSIONS = f"""
{_mode('co')}, {_mode('user_type')}, {_mode('division')},
first_user AS (SELECT session_id, username FROM ord WHERE rn = 1),
prompts AS (SELECT session_id, string_agg(merged_prompt, ' | ' ORDER BY rn) AS combined_prompt FROM walk GROUP BY session_id),
counts AS (SELECT session_id, count(*) AS turn_count, min(query_timestamp) AS first_timestamp,
                  max(query_timestamp) AS last_timestamp FROM ord GROUP BY session_id),
sessions AS (
  SELECT c.session_id, f.username, mc.co, mu.user_type, md.division, p.combined_prompt, c.turn_count,
         c.first_timestamp, c.last_timestamp
  FROM counts c JOIN first_user f USING (session_id) JOIN m_co mc USING (session_id)
  JOIN m_user_type mu USING (session_id) JOIN m_division md USING (session_id) JOIN prompts p USING (session_id)
)"""


def first_match_case(text_sql: str, entries, lower: bool = False) -> str:
    probe = f"lower({text_sql})" if lower else text_sql
    whens = " ".join(
        f"WHEN contains({probe}, {q(k.lower() if lower else k)}) THEN {q(v)}" for k, v in entries
    )
    return f"CASE {whens} ELSE NULL END"


def watchlist_case(text_sql: str, words) -> tuple[str, str]:
    hit = " OR ".join(f"contains(lower({text_sql}), {q(w.lower())})" for w in words)
    reason = first_match_case(
        text_sql,
        [(w, defaults.WATCHLIST_REASON_PREFIX + w + defaults.WATCHLIST_REASON_SUFFIX) for w in words],
        lower=True,
    )
    return f"({hit})", f"coalesce({reason}, '')"


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes)


LOGS_CHAIN = (F1_LOGS, NORM, WALK)


def D(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def R4(x: str) -> str:
    """Same rounding steps as ``scoring.round4``."""
    return f"(floor(({x}) * {D('10000.0')} + {D('0.5')}) / {D('10000.0')})"


# ------------------------------------------------------------------ F2 vectors
F2 = f"""
protos0 AS (
  SELECT CASE WHEN vec_id % 6 = 0 THEN 'domain' ELSE 'intent' END AS category_type, label AS ord,
    (CASE WHEN vec_id % 6 = 0 THEN 'D' ELSE 'I' END) || lpad(CAST(label + 1 AS VARCHAR), 2, '0') AS code,
    vec_id AS proto_id, CAST(embedding AS DOUBLE[]) AS vec,
    row_number() OVER (PARTITION BY vec_id % 6 = 0, label ORDER BY vec_id) AS rnk
  FROM embeddings WHERE vec_id % 3 = 0
),
protos AS (
  SELECT *, CASE WHEN rnk = 1 THEN 'definition' WHEN rnk % 2 = 0 THEN 'keyword' ELSE 'phrase' END AS kind FROM protos0
),
svecs AS (
  SELECT vec_id AS session_id,
    CASE WHEN vec_id = 1 THEN list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * {D('0.0')})
         ELSE CAST(embedding AS DOUBLE[]) END AS vec,
    CASE WHEN vec_id % 2 = 0 THEN 'D' || lpad(CAST(vec_id % 10 + 1 AS VARCHAR), 2, '0') END AS domain_prior
  FROM embeddings WHERE vec_id % 3 <> 0
),
sims AS (
  SELECT s.session_id, s.domain_prior, p.category_type, p.code, p.ord, p.kind, p.proto_id,
    CASE WHEN list_dot_product(s.vec, s.vec) = 0 OR list_dot_product(p.vec, p.vec) = 0 THEN {D('0.0')}
         ELSE list_cosine_similarity(s.vec, p.vec) END AS cos
  FROM svecs s CROSS JOIN protos p
),
cat AS (
  SELECT session_id, domain_prior, category_type, code, ord,
    max(cos) FILTER (WHERE kind = 'phrase') AS p, max(cos) FILTER (WHERE kind = 'keyword') AS k,
    max(cos) FILTER (WHERE kind = 'definition') AS d
  FROM sims GROUP BY session_id, domain_prior, category_type, code, ord
)"""


def score_chain(cat: str, high: float, low: float) -> str:
    """scored/best/best2/routed CTEs over a (session_id, domain_prior, category_type, code, ord, p, k, d) CTE."""
    return f"""
scored AS (
  SELECT *, CASE WHEN category_type = 'domain' AND domain_prior = code
                 THEN least((p * {D(defaults.WEIGHT_PHRASE)} + k * {D(defaults.WEIGHT_KEYWORD)} + d * {D(defaults.WEIGHT_DEFINITION)}) * {D(defaults.METADATA_BOOST)}, {D('1.0')})
                 ELSE p * {D(defaults.WEIGHT_PHRASE)} + k * {D(defaults.WEIGHT_KEYWORD)} + d * {D(defaults.WEIGHT_DEFINITION)} END AS score
  FROM {cat}
),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, category_type ORDER BY score DESC, ord) AS r FROM scored)
  WHERE r = 1
),
best2 AS (
  SELECT d.session_id, d.code AS predicted_domain, {R4('d.score')} AS domain_confidence,
         i.code AS predicted_intent, {R4('i.score')} AS intent_confidence,
         {R4('(d.score + i.score) / 2')} AS combined_confidence
  FROM best d JOIN best i ON d.session_id = i.session_id AND d.category_type = 'domain' AND i.category_type = 'intent'
),
routed AS (
  SELECT *, CASE WHEN combined_confidence >= {D(high)} THEN 'semantic'
                 WHEN combined_confidence >= {D(low)} THEN 'llm_classify' ELSE 'unclassified' END AS label_source
  FROM best2
)"""



F2_CHAIN = score_chain("cat", fx.FIXTURE_HIGH, fx.FIXTURE_LOW)

TOKEN_RE = "'[\\p{L}\\p{N}]+'"

# ------------------------------------------- benchmark taxonomy (prototypes)
BENCH = f"""
bcat AS (SELECT item_id, text, item_id % {fx.N_BENCH_CATEGORIES} AS c,
                CAST(floor(item_id / {fx.N_BENCH_CATEGORIES}) AS BIGINT) AS k FROM benchmark),
bprotos AS (
  SELECT CASE WHEN c < {fx.N_BENCH_CATEGORIES // 2} THEN 'domain' ELSE 'intent' END AS category_type,
    CAST(c % {fx.N_BENCH_CATEGORIES // 2} AS INTEGER) AS ord,
    (CASE WHEN c < {fx.N_BENCH_CATEGORIES // 2} THEN 'D' ELSE 'I' END)
      || lpad(CAST(c % {fx.N_BENCH_CATEGORIES // 2} + 1 AS VARCHAR), 2, '0') AS code,
    CASE WHEN k = 0 THEN 'definition' WHEN k % 2 = 1 THEN 'keyword' ELSE 'phrase' END AS kind,
    text, item_id AS proto_id
  FROM bcat
)"""


def tf_ctes(name: str, id_col: str, text_sql: str, src: str) -> str:
    return f"""
{name}_tok AS (SELECT {id_col}, unnest(regexp_extract_all(lower({text_sql}), {TOKEN_RE})) AS token FROM {src}),
{name}_tf AS (SELECT {id_col}, token, count(*) AS tf FROM {name}_tok GROUP BY {id_col}, token),
{name}_nn AS (SELECT {id_col}, sum(tf * tf) AS nn FROM {name}_tf GROUP BY {id_col})"""


def cos_cte(name: str, a: str, a_id: str, b: str, b_id: str) -> str:
    return f"""
{name} AS (
  SELECT d.{a_id}, d.{b_id}, d.dot / (sqrt(CAST(x.nn AS DOUBLE)) * sqrt(CAST(y.nn AS DOUBLE))) AS cos
  FROM (SELECT s.{a_id}, p.{b_id}, sum(s.tf * p.tf) AS dot FROM {a}_tf s JOIN {b}_tf p ON s.token = p.token
        GROUP BY s.{a_id}, p.{b_id}) d
  JOIN {a}_nn x ON x.{a_id} = d.{a_id} JOIN {b}_nn y ON y.{b_id} = d.{b_id}
)"""


LEX_SESSIONS = f"""
sessions2 AS (SELECT *, {first_match_case('division', defaults.DEPARTMENT_DOMAIN_MAP)} AS domain_prior FROM sessions),
{tf_ctes('st', 'session_id', 'combined_prompt', 'sessions2').strip()},
{tf_ctes('pt', 'proto_id', 'text', 'bprotos').strip()},
{cos_cte('lcos', 'st', 'session_id', 'pt', 'proto_id').strip()},
grid AS (
  SELECT s.session_id, s.domain_prior, c.category_type, c.code, c.ord
  FROM sessions2 s CROSS JOIN (SELECT DISTINCT category_type, code, ord FROM bprotos) c
),
lpk AS (SELECT l.session_id, p.category_type, p.code, p.kind, max(l.cos) AS m
        FROM lcos l JOIN bprotos p ON p.proto_id = l.proto_id GROUP BY l.session_id, p.category_type, p.code, p.kind),
lcat AS (
  SELECT g.session_id, g.domain_prior, g.category_type, g.code, g.ord,
    coalesce(max(m) FILTER (WHERE kind = 'phrase'), {D('0.0')}) AS p,
    coalesce(max(m) FILTER (WHERE kind = 'keyword'), {D('0.0')}) AS k,
    coalesce(max(m) FILTER (WHERE kind = 'definition'), {D('0.0')}) AS d
  FROM grid g LEFT JOIN lpk l ON l.session_id = g.session_id AND l.category_type = g.category_type AND l.code = g.code
  GROUP BY g.session_id, g.domain_prior, g.category_type, g.code, g.ord
)"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


MATRIX_ROWS = [
    (0 if lvl == "HIGH" else 1, i, d, it, lvl, f"{lvl.lower()} risk pair {d}/{it}")
    for i, (d, it, lvl) in enumerate(fx.GOVERNANCE_PAIRS)
]
GOV = f"""
gm AS (
  SELECT domain, intent, level, reason FROM (
    SELECT *, row_number() OVER (PARTITION BY domain, intent ORDER BY list_no DESC, i DESC) AS r
    FROM (VALUES {_values(MATRIX_ROWS)}) t(list_no, i, domain, intent, level, reason)) WHERE r = 1
),
flagged AS (
  SELECT r.*, s.combined_prompt, s.username, s.co, s.user_type, s.division, s.turn_count, s.domain_prior,
         s.first_timestamp, s.last_timestamp, gm.level AS mlevel, gm.reason AS mreason,
         {{wl_hit}} AS wl_hit, {{wl_reason}} AS wl_reason
  FROM routed r JOIN sessions2 s ON s.session_id = r.session_id
  LEFT JOIN gm ON r.label_source = 'semantic' AND gm.domain = r.predicted_domain AND gm.intent = r.predicted_intent
),
gov AS (
  SELECT *, CASE WHEN wl_hit THEN 'HIGH' WHEN mlevel IS NOT NULL THEN mlevel ELSE 'NONE' END AS governance_flag,
         CASE WHEN wl_hit THEN trim(coalesce(mreason, '') || ' | ' || wl_reason, ' |') ELSE coalesce(mreason, '') END
           AS governance_reason
  FROM flagged
)"""


NL = "chr(10)"
NN = "(chr(10) || chr(10))"

# ------------------------------------------------------------- F5 documents
F5_PAGES = f"""
pages AS (
  SELECT doc_id, CAST(unnest(range(1, len(ls) + 1)) AS INTEGER) AS page_no, unnest(ls) AS text
  FROM (SELECT doc_id, string_split(text, {NL}) AS ls FROM documents)
),
dtexts AS (
  SELECT doc_id, coalesce(string_agg('[Page ' || CAST(page_no AS VARCHAR) || '] ' || text, {NN} ORDER BY page_no)
                          FILTER (WHERE {_strip('text')} <> ''), '') AS text
  FROM pages GROUP BY doc_id
)"""

F5_ORDERS = f"""
lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS li
  FROM lineitem
),
oparts AS (
  SELECT o_orderkey AS doc_id, 0 AS part_seq,
         'Order ' || CAST(o_orderkey AS VARCHAR) || ' for customer ' || CAST(o_custkey AS VARCHAR) || '.' AS text,
         false AS is_boundary FROM orders
  UNION ALL SELECT o_orderkey, 1, {NL} || 'Article IV: Urgent handling', true FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT o_orderkey, 1000, {NL} || 'FINAL NOTICE', true FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT l_orderkey, li * 10 + 1, {NL} || 'Section ' || CAST(l_linenumber AS VARCHAR) || ': Items part '
         || CAST(l_partkey AS VARCHAR) || ' qty ' || CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR), true FROM lines
  UNION ALL SELECT l_orderkey, li * 10 + 2, {NL} || '1.' || CAST(l_linenumber AS VARCHAR) || ' Terms of delivery by '
         || strftime(l_shipdate, '%Y-%m-%d'), true FROM lines
  UNION ALL SELECT l_orderkey, li * 10 + 3, {NL} || 'IV. Risk level ' || CAST(l_linenumber AS VARCHAR) || ' price '
         || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR), true FROM lines
  UNION ALL SELECT l_orderkey, li * 10 + 4, {NL} || '2.' || CAST(l_linenumber AS VARCHAR) || ' Payment schedule '
         || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR), true FROM lines
  UNION ALL SELECT l_orderkey, li * 10 + 5,
         {NN} || repeat({q(fx.NOTE_PARAGRAPH.replace(chr(10), "~"))}, {fx.NOTE_REPEAT}) || 'End of note.', false
         FROM lines WHERE l_quantity >= 45
),
oparts2 AS (
  SELECT doc_id, part_seq, replace(text, '~', {NL}) AS text, is_boundary,
         coalesce(sum(length(replace(text, '~', {NL}))) OVER (PARTITION BY doc_id ORDER BY part_seq
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
         sum(CASE WHEN is_boundary THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY part_seq
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sec
  FROM oparts
),
otexts AS (SELECT doc_id, string_agg(text, '' ORDER BY part_seq) AS text FROM oparts2 GROUP BY doc_id),
obounds AS (SELECT doc_id, 0 AS boundary FROM otexts UNION SELECT doc_id, off FROM oparts2 WHERE is_boundary),
osections AS (SELECT doc_id, sec, string_agg(text, '' ORDER BY part_seq) AS text FROM oparts2 GROUP BY doc_id, sec),
onb AS (SELECT doc_id, count(*) AS nb FROM obounds GROUP BY doc_id)"""


def pack_sql(name: str, src: str, keep_empty: bool, cs: int = defaults.CHUNK_SIZE) -> str:
    """Paragraph packing as a recursive walk over (pid, text) rows of ``src``."""
    fits = f"length(w.cur) + length(p.par) < {cs}"
    empty_filter = "" if keep_empty else "AND emit <> ''"
    return f"""
{name}_p AS (
  SELECT pid, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS par
  FROM (SELECT pid, string_split(text, {NN}) AS ps FROM {src})
),
{name}_w AS (
  SELECT pid, 0 AS i, '' AS cur, CAST(NULL AS VARCHAR) AS emit FROM {src}
  UNION ALL
  SELECT w.pid, p.i,
    CASE WHEN {fits} THEN w.cur || p.par || {NN} ELSE p.par || {NN} END,
    CASE WHEN {fits} THEN NULL ELSE w.cur END
  FROM {name}_w w JOIN {name}_p p ON p.pid = w.pid AND p.i = w.i + 1
),
{name}_last AS (SELECT pid, i, cur FROM {name}_w QUALIFY row_number() OVER (PARTITION BY pid ORDER BY i DESC) = 1),
{name} AS (
  SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY o) - 1 AS chunk_idx, chunk FROM (
    SELECT pid, i AS o, emit AS chunk FROM {name}_w WHERE emit IS NOT NULL {empty_filter}
    UNION ALL SELECT pid, i + 1, cur FROM {name}_last WHERE cur <> '')
)"""


def fill_sql(template: str, **exprs: str) -> str:
    """``template.format(...)`` as a DuckDB concatenation."""
    import re as _re

    out, pos = [], 0
    for m in _re.finditer(r"\{(\w+)\}", template):
        out.append(q(template[pos: m.start()].replace("{{", "{").replace("}}", "}")))
        out.append(f"CAST({exprs[m.group(1)]} AS VARCHAR)")
        pos = m.end()
    out.append(q(template[pos:].replace("{{", "{").replace("}}", "}")))
    return "(" + " || ".join(out) + ")"


def stub_sql(prompt: str) -> str:
    """The default completion: it depends on the whole prompt."""
    return f"({q(defaults.DIGEST_COMPLETION_PREFIX)} || CAST(length({prompt}) AS VARCHAR) || ' characters, ' || md5({prompt}))"


SUMMARY = f"""
dmeta AS (
  SELECT d.doc_id,
    coalesce(CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE 'Report ' || CAST(d.doc_id AS VARCHAR) END, {q(defaults.UNKNOWN)}) AS title,
    coalesce(d.source, {q(defaults.UNKNOWN)}) AS author,
    coalesce(CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE d.lang || ',' || d.source END, '') AS keywords,
    CAST(c.n AS INTEGER) AS page_count
  FROM documents d JOIN (SELECT doc_id, count(*) AS n FROM pages GROUP BY doc_id) c ON c.doc_id = d.doc_id
),
cprompts AS (
  SELECT k.pid AS doc_id, k.chunk_idx, m.title, m.author, m.keywords, m.page_count,
         {fill_sql(defaults.CHUNK_PROMPT_FINANCIAL, title='m.title', chunk='k.chunk')} AS prompt
  FROM dpk k JOIN dmeta m ON m.doc_id = k.pid
),
csum AS (SELECT *, {stub_sql('prompt')} AS summary FROM cprompts),
reduced AS (
  SELECT doc_id, any_value(title) AS title, any_value(author) AS author, any_value(keywords) AS keywords,
         any_value(page_count) AS page_count, CAST(count(*) AS INTEGER) AS chunk_count,
         string_agg('Section ' || CAST(chunk_idx + 1 AS VARCHAR) || ' Summary:' || {NL} || summary, {NN} ORDER BY chunk_idx) AS all_s,
         string_agg(summary, ' || ' ORDER BY chunk_idx) AS joined
  FROM csum GROUP BY doc_id
),
finals AS (
  SELECT *, {fill_sql(defaults.FINAL_PROMPT_FINANCIAL, title='title', author='author', keywords='keywords',
                      page_count='page_count', all_summaries='all_s')} AS final_prompt FROM reduced
)"""


MAILS = """
mails AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS email_no FROM orders
),
mails2 AS (
  SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY email_no) AS prev_key FROM mails
),
ok_out AS (SELECT * FROM mails WHERE NOT (o_orderkey % 17 = 0 OR o_orderkey % 19 = 0)),
mail_own AS (
  SELECT o_custkey AS thread_id, email_no,
    'From: Cust ' || CAST(o_custkey AS VARCHAR) || ' &lt;c' || CAST(o_custkey AS VARCHAR) || '@example.com&gt;'
    || chr(10) || 'Sent: ' || strftime(o_orderdate, '%Y-%m-%d')
    || chr(10) || 'To: ops' || CAST(o_orderkey % 7 AS VARCHAR) || '@example.com;desk&amp;' || o_orderstatus || '@example.com'
    || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || 'Cc: audit@example.com; legal@example.com' ELSE '' END
    || chr(10) || 'Subject: Order ' || CAST(o_orderkey AS VARCHAR) || ' ' || o_orderpriority
    || chr(10) || chr(10) || 'Please process order ' || CAST(o_orderkey AS VARCHAR) || '. Total '
    || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.' AS own
  FROM mails
),
mail_body AS (
  SELECT thread_id, email_no,
    CASE WHEN email_no % 3 = 0 AND prev IS NOT NULL THEN own || chr(10) || chr(10) || prev ELSE own END AS body
  FROM (SELECT *, lag(own) OVER (PARTITION BY thread_id ORDER BY email_no) AS prev FROM mail_own)
)"""


def _hdr(alias: str) -> str:
    return f"""'Cust ' || CAST({alias}.o_custkey AS VARCHAR) || ' <c' || CAST({alias}.o_custkey AS VARCHAR) || '@example.com>' AS from_addr,
    strftime({alias}.o_orderdate, '%Y-%m-%d') AS sent,
    'ops' || CAST({alias}.o_orderkey % 7 AS VARCHAR) || '@example.com|desk&' || {alias}.o_orderstatus || '@example.com' AS to_addrs,
    CAST(2 AS BIGINT) AS n_to,
    CASE WHEN {alias}.o_orderkey % 2 = 0 THEN 'audit@example.com| legal@example.com' ELSE '' END AS cc_addrs,
    CAST(CASE WHEN {alias}.o_orderkey % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_cc,
    'Order ' || CAST({alias}.o_orderkey AS VARCHAR) || ' ' || {alias}.o_orderpriority AS subject"""


def _list_json_sql(value_sql: str, cond: str, name: str) -> str:
    items = f"string_agg('    \"' || {value_sql} || '\"', ',' || {NL} ORDER BY email_no) FILTER (WHERE {cond})"
    return (f"'  \"{name}\": ' || CASE WHEN count(*) FILTER (WHERE {cond}) = 0 THEN '[]' "
            f"ELSE '[' || {NL} || {items} || {NL} || '  ]' END")


def _sentence_sql(h: str, v: str, stop_list: str) -> str:
    toks = f"regexp_extract_all({h} || ': ' || {v}, '\\w+|[^\\w\\s]')"
    return f"array_to_string(list_filter({toks}, lambda t: NOT list_contains({stop_list}, lower(t))), ' ')"


TABLE_CELLS = f"""
sup AS (
  SELECT CAST(1000000000 + s_nationkey * 1000000 + floor(s_suppkey / {fx.TABLE_BUCKET}) AS BIGINT) AS page_id,
         row_number() OVER (PARTITION BY s_nationkey, floor(s_suppkey / {fx.TABLE_BUCKET}) ORDER BY s_suppkey) - 1 AS row_no,
         s_name, n_name, CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) AS bal
  FROM supplier JOIN nation ON n_nationkey = s_nationkey
),
cus AS (
  SELECT CAST(2000000000 + c_nationkey * 1000000 + floor(c_custkey / {fx.TABLE_BUCKET}) AS BIGINT) AS page_id,
         row_number() OVER (PARTITION BY c_nationkey, floor(c_custkey / {fx.TABLE_BUCKET}) ORDER BY c_custkey) - 1 AS row_no,
         c_name, c_mktsegment
  FROM customer
),
cells AS (
  SELECT page_id, row_no, 0 AS col_no, {q(fx.SUPPLIER_HEADERS[0])} AS header, s_name AS value FROM sup
  UNION ALL SELECT page_id, row_no, 1, {q(fx.SUPPLIER_HEADERS[1])}, n_name FROM sup
  UNION ALL SELECT page_id, row_no, 2, {q(fx.SUPPLIER_HEADERS[2])}, bal FROM sup
  UNION ALL SELECT page_id, row_no, 0, {q(fx.CUSTOMER_HEADERS[0])}, c_name FROM cus
  UNION ALL SELECT page_id, row_no, 1, {q(fx.CUSTOMER_HEADERS[1])}, c_mktsegment FROM cus
  UNION ALL SELECT page_id, count(*), 0, {q(fx.CUSTOMER_HEADERS[0])}, 'Total' FROM cus GROUP BY page_id
)"""


def oracle_sql() -> dict[str, str]:
    wl_hit, wl_reason = watchlist_case("combined_prompt", fx.FIXTURE_WATCHLIST)
    out = {
        "log_normalise": _with(F1_LOGS, NORM) + """
SELECT session_id, seq, username, prompt, co, user_type, division, query_timestamp,
       prompt_token_count, is_short_prompt FROM norm2""",
        "merge_short_turns": _with(*LOGS_CHAIN) + """
SELECT session_id, rn, merged_prompt FROM walk""",
        "session_prompt": _with(*LOGS_CHAIN, SESSIONS) + """
SELECT session_id, combined_prompt FROM prompts""",
        "session_rollup": _with(*LOGS_CHAIN, SESSIONS) + """
SELECT session_id, username, co, user_type, division, turn_count, first_timestamp, last_timestamp FROM sessions""",
        "session_split": _with(*LOGS_CHAIN, SESSIONS) + f"""
SELECT s.session_id, s.username, s.co, s.user_type, s.division, p.combined_prompt, s.turn_count,
       {first_match_case('s.division', defaults.DEPARTMENT_DOMAIN_MAP)} AS domain_prior, s.first_timestamp, s.last_timestamp
FROM sessions s JOIN prompts p USING (session_id)""",
        "domain_prior": _with(*LOGS_CHAIN, SESSIONS) + f"""
SELECT session_id, division, {first_match_case('division', defaults.DEPARTMENT_DOMAIN_MAP)} AS domain_prior FROM sessions""",
        "watchlist_hit": _with(*LOGS_CHAIN, SESSIONS) + f"""
SELECT session_id, {wl_hit} AS watchlist_hit, {wl_reason} AS watchlist_reason FROM sessions""",
    }
    out.update({
        "cosine_topk": _with(F2, F2_CHAIN) + f"""
SELECT session_id, rank, proto_id, {R4('cos')} AS cos FROM (
  SELECT session_id, proto_id, cos, row_number() OVER (PARTITION BY session_id ORDER BY cos DESC, proto_id) AS rank
  FROM sims) WHERE rank <= 3""",
        "hybrid_scores": _with(F2, F2_CHAIN) + f"""
SELECT session_id, category_type, code, {R4('score')} AS score FROM scored""",
        "best_category": _with(F2, F2_CHAIN) + """
SELECT session_id, predicted_domain, domain_confidence, predicted_intent, intent_confidence, combined_confidence FROM best2""",
        "score_map": _with(F2, F2_CHAIN) + f"""
SELECT session_id, code, {R4('score')} AS score FROM scored""",
        "confidence_route": _with(F2, F2_CHAIN) + """
SELECT session_id, combined_confidence, label_source FROM routed""",
        "label_distribution": _with(F2, F2_CHAIN) + """
SELECT label_source, count(*) AS n FROM routed GROUP BY label_source""",
    })
    fl_hit, fl_reason = watchlist_case("s.combined_prompt", fx.FIXTURE_WATCHLIST)
    flag_chain = _with(*LOGS_CHAIN, SESSIONS, BENCH, LEX_SESSIONS,
                       score_chain("lcat", fx.FLAGSHIP_HIGH, fx.FLAGSHIP_LOW),
                       GOV.replace("{wl_hit}", fl_hit).replace("{wl_reason}", fl_reason))
    sinks = " UNION ALL ".join([
        "SELECT 'classification_logs' AS sink, session_id FROM gov",
        "SELECT 'governance_alerts', session_id FROM gov WHERE governance_flag = 'HIGH'",
        "SELECT 'governance_monitoring', session_id FROM gov WHERE governance_flag = 'MEDIUM'",
        "SELECT 'llm_classify_queue', session_id FROM gov WHERE label_source = 'llm_classify'",
        "SELECT 'unclassified', session_id FROM gov WHERE label_source = 'unclassified'",
    ])
    gov_cols = ", ".join(defaults.OUTPUT_COLUMNS)
    out.update({
        "taxonomy_flatten": _with(BENCH) + """
SELECT category_type, ord, code, 'Category ' || code AS name, kind, text FROM bprotos""",
        "governance_matrix": """
SELECT domain, intent, level, reason FROM (
  SELECT *, row_number() OVER (PARTITION BY domain, intent ORDER BY list_no DESC, i DESC) AS r FROM (
    SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END AS list_no, o_orderkey AS i,
      'D' || lpad(CAST(o_custkey % 10 + 1 AS VARCHAR), 2, '0') AS domain,
      'I' || lpad(CAST(o_orderkey % 7 + 1 AS VARCHAR), 2, '0') AS intent,
      CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HIGH' ELSE 'MEDIUM' END AS level,
      'order ' || CAST(o_orderkey AS VARCHAR) || ' ' || o_orderpriority AS reason
    FROM orders)) WHERE r = 1""",
        "lexical_scores": _with(tf_ctes('dt', 'doc_id', 'text', 'documents'), tf_ctes('bt', 'item_id', 'text', 'benchmark'),
                                cos_cte('dcos', 'dt', 'doc_id', 'bt', 'item_id')) + f"""
SELECT doc_id, item_id, {R4('cos')} AS cos FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cos DESC, item_id) AS r FROM dcos) WHERE r = 1""",
        "classify_logs": flag_chain + """
SELECT session_id, username, co, user_type, division, combined_prompt, turn_count, predicted_domain,
       domain_confidence, predicted_intent, intent_confidence, combined_confidence, label_source,
       governance_flag, governance_reason, domain_prior, first_timestamp, last_timestamp FROM gov""",
        "governance_flags": flag_chain + """
SELECT session_id, predicted_domain, predicted_intent, label_source, governance_flag, governance_reason FROM gov""",
        "llm_queue": flag_chain + f"""
SELECT session_id, combined_confidence, combined_prompt AS prompt_excerpt
FROM gov WHERE label_source = 'llm_classify'""",
        "route_outputs": flag_chain + "\n" + sinks,
        "sink_files": flag_chain + " SELECT * FROM (" + " UNION ALL ".join(
            f"SELECT '{name}' AS sink, {gov_cols} FROM gov{cond}" for name, cond in (
                ("classification_logs", ""), ("governance_alerts", " WHERE governance_flag = 'HIGH'"), ("governance_monitoring", " WHERE governance_flag = 'MEDIUM'"),
                ("llm_classify_queue", " WHERE label_source = 'llm_classify'"), ("unclassified", " WHERE label_source = 'unclassified'"))) + ")",
        "log_files": _with(*LOGS_CHAIN[:1]) + """
SELECT fmt, CAST(session_id AS VARCHAR) AS session_id, CAST(seq AS BIGINT) AS seq, query_timestamp, username, prompt, co, user_type, division
FROM logs, (SELECT unnest(['csv', 'json']) AS fmt)""",
        "run_summary": flag_chain + """,
turns AS (SELECT * FROM norm2)
SELECT 'total_sessions' AS metric, count(*) AS n FROM gov
UNION ALL SELECT 'labelled_semantic', count(*) FILTER (WHERE label_source = 'semantic') FROM gov
UNION ALL SELECT 'llm_queue', count(*) FILTER (WHERE label_source = 'llm_classify') FROM gov
UNION ALL SELECT 'unclassified', count(*) FILTER (WHERE label_source = 'unclassified') FROM gov
UNION ALL SELECT 'high_governance', count(*) FILTER (WHERE governance_flag = 'HIGH') FROM gov
UNION ALL SELECT 'medium_governance', count(*) FILTER (WHERE governance_flag = 'MEDIUM') FROM gov
UNION ALL SELECT 'short_prompts', count(*) FILTER (WHERE is_short_prompt) FROM turns
UNION ALL SELECT 'dropped_null_session', count(*) FILTER (WHERE session_id IS NULL) FROM turns
UNION ALL SELECT 'unparsed_timestamps', count(*) FILTER (WHERE query_timestamp IS NOT NULL AND try_cast(query_timestamp AS TIMESTAMP) IS NULL) FROM logs""",
    })
    lim = f"{defaults.CHUNK_SIZE} * {defaults.RESPLIT_FACTOR}"
    out.update({
        "pages_assemble": _with(F5_PAGES) + """
SELECT doc_id, text FROM dtexts""",
        "doc_metadata": _with(F5_PAGES) + f"""
SELECT d.doc_id,
  coalesce(CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE 'Report ' || CAST(d.doc_id AS VARCHAR) END, {q(defaults.UNKNOWN)}) AS title,
  coalesce(d.source, {q(defaults.UNKNOWN)}) AS author, coalesce(d.lang, '') AS subject,
  coalesce(CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE d.lang || ',' || d.source END, '') AS keywords,
  '' AS creation_date, '' AS modification_date, CAST(c.n AS INTEGER) AS page_count
FROM documents d JOIN (SELECT doc_id, count(*) AS n FROM pages GROUP BY doc_id) c ON c.doc_id = d.doc_id""",
        "section_boundaries": _with(F5_ORDERS) + """
SELECT doc_id, CAST(boundary AS BIGINT) AS boundary FROM obounds""",
        "chunk_sections": _with(F5_ORDERS) + """
SELECT doc_id, CAST(sec AS BIGINT) AS section_idx, text AS section FROM osections""",
        "section_chunks": _with(
            F5_ORDERS,
            f"""long_secs AS (SELECT s.doc_id * 1000 + s.sec AS pid, s.text FROM osections s JOIN onb USING (doc_id)
                WHERE onb.nb > 1 AND onb.nb < {defaults.MAX_SECTION_BOUNDARIES} AND length(s.text) > {lim})""",
            pack_sql("lpk", "long_secs", keep_empty=False),
            f"""whole AS (SELECT t.doc_id AS pid, t.text FROM otexts t JOIN onb USING (doc_id)
                WHERE NOT (onb.nb > 1 AND onb.nb < {defaults.MAX_SECTION_BOUNDARIES}))""",
            pack_sql("wpk", "whole", keep_empty=True),
        ) + f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec, sub) - 1 AS BIGINT) AS chunk_idx, chunk FROM (
  SELECT s.doc_id, s.sec, 0 AS sub, s.text AS chunk FROM osections s JOIN onb USING (doc_id)
  WHERE onb.nb > 1 AND onb.nb < {defaults.MAX_SECTION_BOUNDARIES} AND length(s.text) <= {lim}
  UNION ALL SELECT CAST(pid // 1000 AS BIGINT), pid % 1000, chunk_idx, chunk FROM lpk)
UNION ALL SELECT pid AS doc_id, CAST(chunk_idx AS BIGINT), chunk FROM wpk""",
        "chunk_documents": _with(F5_PAGES, "dsrc AS (SELECT doc_id AS pid, text FROM dtexts)",
                                 pack_sql("dpk", "dsrc", keep_empty=True)) + """
SELECT pid AS doc_id, CAST(chunk_idx AS BIGINT) AS chunk_idx, chunk FROM dpk""",
    })
    doc_sum = _with(F5_PAGES, "dsrc AS (SELECT doc_id AS pid, text FROM dtexts)", pack_sql("dpk", "dsrc", keep_empty=True), SUMMARY)
    out.update({
        "chunk_prompts": doc_sum + """
SELECT doc_id, CAST(chunk_idx AS BIGINT) AS chunk_idx, prompt FROM cprompts""",
        "chunk_completions": doc_sum + """
SELECT doc_id, CAST(chunk_idx AS BIGINT) AS chunk_idx,
       CASE WHEN length(prompt) % 5 = 0 THEN '[Error summarizing this section: cannot read ' || CAST(length(prompt) AS VARCHAR) || ' characters]'
            ELSE CAST(length(prompt) AS VARCHAR) || ' characters read' END AS summary
FROM cprompts""",
        "summary_reduce": doc_sum + """
SELECT doc_id, chunk_count, final_prompt FROM finals""",
        "summarise_documents": doc_sum + f"""
SELECT doc_id, title, page_count, chunk_count, joined AS section_summaries, {stub_sql('final_prompt')} AS final_summary
FROM finals""",
        "chat_assemble": """
SELECT conv_id, count(*) AS n_messages,
       string_agg('<|' || role || '|>' || text || '<|end|>', '' ORDER BY turn) || '<|assistant|>' AS prompt
FROM conversations GROUP BY conv_id""",
    })
    from loglens.operators import threads as _th

    findings_cols = {
        "commitments": ("'process order ' || CAST(o_orderkey AS VARCHAR)", "TRUE"),
        "monetary_mentions": ("CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)", "TRUE"),
        "deadlines": ("strftime(o_orderdate, '%Y-%m-%d')", "TRUE"),
        "legal_triggers": ("'breach'", "o_orderstatus = 'F'"),
        "escalation_flags": ("'urgent'", "o_orderpriority = '1-URGENT'"),
    }
    agg_cols, outer_cols = [], []
    for name, (val, cond) in findings_cols.items():
        agg_cols.append(f"coalesce(string_agg({val}, '|' ORDER BY email_no) FILTER (WHERE {cond}), '') AS {name}")
        agg_cols.append(f"count(*) FILTER (WHERE {cond}) AS n_{name}")
        outer_cols.append(f"coalesce(f.{name}, '') AS {name}")
        outer_cols.append(f"coalesce(f.n_{name}, 0) AS n_{name}")
    json_parts = f" || ',' || {NL} || ".join(_list_json_sql(v, c, n) for n, (v, c) in findings_cols.items())
    summary_sql = f"coalesce(string_agg({NL} || 'order ' || CAST(o_orderkey AS VARCHAR) || ' ' || o_orderstatus, '' ORDER BY email_no), '')"
    import json as _json

    empty_js = q(_json.dumps({n: [] for n in findings_cols}, indent=2))
    fold_const = len(_th._frame_py(defaults.SUMMARY_SYSTEM_MESSAGE, defaults.SUMMARY_USER_MESSAGE.format(summary="", email="")))
    body_sql = "len(body)"
    init = q(defaults.SUMMARY_INITIAL_STATE)
    find_const = len(_th._frame_py(defaults.FINDINGS_SYSTEM_MESSAGE, defaults.FINDINGS_USER_MESSAGE.format(summary="", email="")))
    state = """CASE WHEN n % 7 = 0 THEN summary ELSE summary || chr(10) || 'read ' || CAST(n AS VARCHAR) || ' chars' END AS summary,
    CASE WHEN n % 7 = 0 THEN deadlines ELSE list_append(deadlines, 'd' || CAST(n AS VARCHAR)) END AS deadlines,
    CASE WHEN n % 7 = 0 OR n % 2 = 0 THEN commitments ELSE list_append(commitments, CAST(n % 10 AS VARCHAR)) END AS commitments"""
    out["thread_fold_findings"] = _with(MAILS, f"""
fold AS (
  SELECT thread_id, email_no, n % 7 <> 0 AS ok, {state}
  FROM (SELECT thread_id, email_no, {find_const} + length(body) AS n, '' AS summary, CAST([] AS VARCHAR[]) AS deadlines, CAST([] AS VARCHAR[]) AS commitments
        FROM mail_body WHERE email_no = 1)
  UNION ALL
  SELECT thread_id, email_no, n % 7 <> 0, {state}
  FROM (SELECT b.thread_id, b.email_no, {find_const} + length(f.summary) + length(b.body) AS n, f.summary, f.deadlines, f.commitments
        FROM fold f JOIN mail_body b ON b.thread_id = f.thread_id AND b.email_no = f.email_no + 1)
)""") + """
SELECT thread_id, CAST(email_no AS INTEGER) AS email_no, ok, summary, array_to_string(deadlines, '|') AS deadlines,
       array_to_string(commitments, '|') AS commitments FROM fold"""
    find_frame = fill_sql(defaults.CHAT_FRAME, system=q(defaults.FINDINGS_SYSTEM_MESSAGE), user=fill_sql(defaults.FINDINGS_USER_MESSAGE, summary="state", email="body"))
    out["thread_fold_rounds_findings"] = _with(MAILS, f"""
fold AS (
  SELECT thread_id, email_no, h, CASE WHEN h < '2' THEN state ELSE state || chr(10) || 'read ' || substr(h, 1, 8) END AS state
  FROM (SELECT thread_id, email_no, state, md5({find_frame}) AS h FROM (SELECT thread_id, email_no, '' AS state, body FROM mail_body WHERE email_no = 1))
  UNION ALL
  SELECT thread_id, email_no, h, CASE WHEN h < '2' THEN state ELSE state || chr(10) || 'read ' || substr(h, 1, 8) END AS state
  FROM (SELECT thread_id, email_no, state, md5({find_frame}) AS h
        FROM (SELECT b.thread_id, b.email_no, f.state, b.body FROM fold f JOIN mail_body b ON b.thread_id = f.thread_id AND b.email_no = f.email_no + 1))
)""") + """
SELECT thread_id, CAST(email_no AS INTEGER) AS email_no, h >= '2' AS ok, CASE WHEN h >= '2' THEN 'read ' || substr(h, 1, 8) END AS update,
       CASE WHEN h >= '2' THEN 'd' || substr(h, 2, 4) ELSE '' END AS deadlines,
       CASE WHEN h >= '2' AND substr(h, 11, 1) < '8' THEN substr(h, 6, 3) || '|' || substr(h, 9, 2) ELSE '' END AS commitments
FROM fold"""
    out.update({
        "thread_fold": _with(MAILS, f"""
fold AS (
  SELECT thread_id, email_no, 'summary of ' || CAST({fold_const} + length({init}) + length(body) AS VARCHAR) || ' chars' AS summary
  FROM mail_body WHERE email_no = 1
  UNION ALL
  SELECT b.thread_id, b.email_no, 'summary of ' || CAST({fold_const} + length(f.summary) + length(b.body) AS VARCHAR) || ' chars'
  FROM fold f JOIN mail_body b ON b.thread_id = f.thread_id AND b.email_no = f.email_no + 1
)""") + """
SELECT thread_id, CAST(email_no AS INTEGER) AS email_no, summary FROM fold""",
        "email_headers": _with(MAILS) + f"""
SELECT m.o_custkey AS thread_id, CAST(m.email_no AS INTEGER) AS email_no, CAST(0 AS BIGINT) AS block_no, {_hdr('m')}
FROM mails2 m
UNION ALL
SELECT m.o_custkey, CAST(m.email_no AS INTEGER), CAST(1 AS BIGINT), {_hdr('p')}
FROM mails2 m JOIN orders p ON p.o_orderkey = m.prev_key WHERE m.email_no % 3 = 0""",
        "thread_findings": _with(MAILS) + f"""
SELECT t.thread_id, {", ".join(outer_cols)},
       coalesce(f.summary, '') AS summary
FROM (SELECT DISTINCT o_custkey AS thread_id FROM orders) t
LEFT JOIN (SELECT o_custkey AS thread_id, {", ".join(agg_cols)}, {summary_sql} AS summary FROM ok_out GROUP BY o_custkey) f
  ON f.thread_id = t.thread_id""",
        "finding_rejects": _with(MAILS) + """
SELECT o_custkey AS thread_id, CAST(email_no AS INTEGER) AS email_no,
       CASE WHEN o_orderkey % 17 = 0 THEN 'not json' ELSE '' END AS out
FROM mails WHERE o_orderkey % 17 = 0 OR o_orderkey % 19 = 0""",
        "thread_report_prompt": _with(MAILS) + f"""
SELECT t.thread_id, {fill_sql(defaults.CHAT_FRAME, system=q(defaults.FINDINGS_SYSTEM_MESSAGE),
                               user=fill_sql(defaults.FINDINGS_REPORT_MESSAGE, summary="coalesce(f.summary, '')", findings=f"coalesce(f.js, {empty_js})"))} AS report_prompt
FROM (SELECT DISTINCT o_custkey AS thread_id FROM orders) t
LEFT JOIN (SELECT o_custkey AS thread_id, {summary_sql} AS summary,
                  '{{' || {NL} || {json_parts} || {NL} || '}}' AS js FROM ok_out GROUP BY o_custkey) f
  ON f.thread_id = t.thread_id""",
    })
    stop_list = "[" + ", ".join(q(w) for w in defaults.ENGLISH_STOP_WORDS) + "]"
    li = "regexp_extract_all(html, '(?is)<li(?:\\s[^>]*)?>(.*?)</li>', 1)"
    own = ("array_to_string(list_filter(list_transform(string_split_regex(x, '<[^>]*>'), "
           "lambda f: regexp_replace(f, '^\\s+|\\s+$', '', 'g')), lambda f: f <> ''), '')")
    out.update({
        "html_lists": f"""
SELECT page_id, CAST(unnest(range(0, len(items))) AS BIGINT) AS item_no, unnest(items) AS item
FROM (SELECT page_id, list_transform({li}, lambda x: {own}) AS items FROM pages)""",
        "html_tables": _with(TABLE_CELLS) + """
SELECT page_id, CAST(0 AS BIGINT) AS table_no, CAST(row_no AS BIGINT) AS row_no, CAST(col_no AS BIGINT) AS col_no,
       header, value FROM cells""",
        "stopword_filter": _with(TABLE_CELLS) + f"""
SELECT page_id, CAST(0 AS BIGINT) AS table_no, CAST(row_no AS BIGINT) AS row_no,
       string_agg({_sentence_sql('header', 'value', stop_list)}, ', ' ORDER BY col_no) AS row_text
FROM cells GROUP BY page_id, row_no""",
        "page_body_json": "SELECT page_id, html FROM pages",
    })
    nodes = """
nodes AS (
  SELECT 's' || CAST(s_suppkey AS VARCHAR) AS module, 'src/s' || CAST(s_suppkey AS VARCHAR) || '.py' AS path FROM supplier
  UNION ALL
  SELECT 'p' || CAST(p_partkey AS VARCHAR),
         CASE WHEN p_size = 1 THEN 'old/p' ELSE 'lib/p' END || CAST(p_partkey AS VARCHAR) || '.py'
  FROM part
)"""
    out.update({
        "module_nodes": _with(nodes) + "\nSELECT module, path FROM nodes",
        "import_edges": _with(nodes) + f"""
SELECT DISTINCT 's' || CAST(l_suppkey AS VARCHAR) AS src, 'p' || CAST(l_partkey AS VARCHAR) AS dst
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
WHERE s_suppkey % {fx.BROKEN_EVERY} <> 0
UNION
SELECT 's' || CAST(s_suppkey AS VARCHAR), 's' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % {fx.BROKEN_EVERY} <> 0
UNION
SELECT 'p' || CAST(a.p_partkey AS VARCHAR), 'p' || CAST(b.p_partkey AS VARCHAR)
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_size = 1""",
    })
    replay_cte = """
rc AS (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text, lag(text) OVER w AS prev_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
),
rlog AS (
  SELECT conv_id * 100 + turn AS record_id, rc.text AS input,
         CASE WHEN next_role = 'assistant' THEN next_text END AS response,
         b.text AS expected, prev_text AS contexts
  FROM rc LEFT JOIN benchmark b ON b.item_id = rc.conv_id % (SELECT count(*) FROM benchmark) WHERE role = 'user'
)"""
    tok = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'))"
    def ratio(a, b):
        return f"CASE WHEN len({b}) > 0 THEN {R4(f'CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len({b})')} END"
    o, i, g, c = (tok.format(x) for x in ("coalesce(response, '')", "input", "expected", "contexts"))
    all_o = "len(regexp_extract_all(lower(coalesce(response, '')), '[\\p{L}\\p{N}]+'))"
    out.update({
        "replay_map": _with(replay_cte) + """
SELECT record_id, input, coalesce(response, '') AS output, input AS query_text, expected AS ground_truth, contexts FROM rlog""",
        "metric_applicability": _with(replay_cte) + """
SELECT record_id, 'correctness' AS metric FROM rlog WHERE input IS NOT NULL AND response IS NOT NULL AND expected IS NOT NULL
UNION ALL SELECT record_id, 'answer_relevance' FROM rlog WHERE input IS NOT NULL AND response IS NOT NULL
UNION ALL SELECT record_id, 'context_relevance' FROM rlog WHERE input IS NOT NULL AND contexts IS NOT NULL
UNION ALL SELECT record_id, 'groundedness' FROM rlog WHERE contexts IS NOT NULL AND response IS NOT NULL
UNION ALL SELECT record_id, 'coherence' FROM rlog WHERE response IS NOT NULL""",
        "eval_scores": _with(replay_cte) + f"""
SELECT record_id, {ratio(o, g)} AS correctness, {ratio(o, i)} AS answer_relevance, {ratio(c, i)} AS context_relevance,
       {ratio(c, o)} AS groundedness,
       CASE WHEN {all_o} > 0 THEN {R4(f'CAST(len({o}) AS DOUBLE) / {all_o}')} END AS coherence
FROM rlog""",
    })
    al_hit, al_reason = watchlist_case("prompt", fx.FIXTURE_WATCHLIST)
    out["stream_turn_alerts"] = _with(F1_LOGS, NORM) + f"""
SELECT session_id, seq, username, query_timestamp, prompt, {al_reason} AS watchlist_reason
FROM norm2 WHERE {al_hit}"""
    out["stream_thread_findings"] = out["thread_findings"]
    out["chunk_documents_split"] = out["chunk_documents"]
    out["cosine_topk_pruned"] = out["cosine_topk"]
    out["taxonomy_json"] = out["taxonomy_flatten"]
    out["encoded_scores"] = f"""
WITH t AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS turn_id, text FROM conversations WHERE role = 'user'),
tok AS (
  SELECT 't' || turn_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), {TOKEN_RE})) AS w FROM t
  UNION ALL SELECT 'b' || CAST(item_id AS VARCHAR), unnest(regexp_extract_all(lower(coalesce(text, '')), {TOKEN_RE})) FROM benchmark
),
num AS (SELECT id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS n FROM tok),
vec AS (SELECT id, n % 64 AS d, sum(CASE WHEN (n // 64) % 2 = 0 THEN 1 ELSE -1 END) AS x FROM num GROUP BY id, n % 64),
norm AS (SELECT id, sqrt(CAST(sum(x * x) AS DOUBLE)) AS s FROM vec GROUP BY id),
dots AS (SELECT a.id AS ta, b.id AS tb, CAST(sum(a.x * b.x) AS DOUBLE) AS dot FROM vec a JOIN vec b ON a.d = b.d WHERE a.id LIKE 't%' AND b.id LIKE 'b%' GROUP BY a.id, b.id),
grid AS (
  SELECT t.turn_id, CASE WHEN x.s > 0 AND y.s > 0 THEN coalesce(dot, 0) / (x.s * y.s) ELSE 0 END AS cos
  FROM t CROSS JOIN benchmark k LEFT JOIN norm x ON x.id = 't' || t.turn_id LEFT JOIN norm y ON y.id = 'b' || CAST(k.item_id AS VARCHAR)
  LEFT JOIN dots ON ta = 't' || t.turn_id AND tb = 'b' || CAST(k.item_id AS VARCHAR)
)
SELECT turn_id, {R4('max(cos)')} AS cos FROM grid GROUP BY turn_id"""
    out["stream_thread_late"] = _with(MAILS, """
fed AS (SELECT o_custkey AS thread_id, email_no, o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 AS bad, (o_custkey + email_no) % 5 = 0 AS after FROM mails),
told AS (SELECT *, after AND email_no < max(CASE WHEN NOT after THEN email_no END) OVER (PARTITION BY thread_id) AS late FROM fed)""") + """
SELECT thread_id, email_no, CASE WHEN late THEN 'late' ELSE 'rejected' END AS kind FROM told WHERE coalesce(late, FALSE) OR bad"""
    out["thread_findings_split"] = out["thread_findings"]
    out["thread_fold_rounds"] = out["thread_fold"]
    out["chat_assemble_split"] = out["chat_assemble"]
    return out
