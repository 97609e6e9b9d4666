"""DuckDB SQL for the registered queries, written from the definitions rather than
from the Spark plans: plain joins over all pairs where Spark prunes."""

from __future__ import annotations

def _num_list(text: str) -> str:
    """Numbers of a claim or its evidence, years left out."""
    return rf"""list_filter(list_transform(
        regexp_extract_all(replace({text}, ',', ''), '-?\$?\d+\.?\d*%?'),
        lambda m: TRY_CAST(replace(replace(m, '$', ''), '%', '') AS DOUBLE)),
        lambda v: v IS NOT NULL AND NOT (v BETWEEN 1900 AND 2100))"""


def _words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '\s+'), lambda w: w <> '')"


def _rank(expr: str) -> str:
    return f"CAST(row_number() OVER ({expr}) AS INTEGER)"


_BM25 = f"""
toks AS (SELECT doc_id, unnest({_words('text')}) AS token FROM documents),
dl AS (SELECT doc_id, len({_words('text')}) AS n FROM documents),
st AS (SELECT count(*) AS n_docs, avg(n) AS avg_len FROM dl),
tf AS (SELECT doc_id, token, count(*) AS tf FROM toks GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
raw AS (SELECT token, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
idf AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw)
               ELSE raw END AS idf FROM raw),
qt AS (SELECT query_id, token, count(*) AS qtf FROM
        (SELECT item_id AS query_id, unnest({_words('text')}) AS token FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5
              / (tf + 1.5 * (0.25 + 0.75 * n / avg_len))), 6) AS bm25
       FROM qt JOIN idf USING (token) JOIN tf USING (token) JOIN dl USING (doc_id), st
       GROUP BY query_id, doc_id)"""


def _features(table: str, key: str, name: str) -> str:
    return f"""
{name}_c AS (SELECT id, f, count(*) AS c FROM (SELECT {key} AS id,
    CAST(CAST('0x' || substr(md5(w), 1, 8) AS UBIGINT) % 64 AS INTEGER) AS f
    FROM (SELECT {key}, unnest({_words('text')}) AS w FROM {table})) GROUP BY ALL),
{name} AS (SELECT id, f, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS FLOAT)
    AS DOUBLE) AS x FROM {name}_c)"""


_HYBRID = f"""{_BM25},
{_features('documents', 'doc_id', 'de')},
{_features('benchmark', 'item_id', 'qe')},
dn AS (SELECT id, sqrt(sum(x * x)) AS n FROM de GROUP BY id),
qn AS (SELECT id, sqrt(sum(x * x)) AS n FROM qe GROUP BY id),
dot AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.x * d.x) AS s
        FROM qe q JOIN de d ON q.f = d.f GROUP BY ALL),
pairs AS (SELECT b.item_id AS query_id, d.doc_id,
          round(1 - coalesce(s, 0) / greatest(coalesce(qn.n * dn.n, 0), 1e-12), 6) AS dist
          FROM benchmark b CROSS JOIN documents d
          LEFT JOIN dot ON dot.query_id = b.item_id AND dot.doc_id = d.doc_id
          LEFT JOIN qn ON qn.id = b.item_id LEFT JOIN dn ON dn.id = d.doc_id),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, doc_id) AS vrank
       FROM pairs),
full_scores AS (SELECT vr.query_id, vr.doc_id, coalesce(bm25, 0) AS bm25,
    CASE WHEN vrank <= @VEC THEN dist END AS dist, CASE WHEN vrank <= @VEC THEN vrank END AS vrank
    FROM vr LEFT JOIN bm USING (query_id, doc_id)),
mx AS (SELECT query_id, max(bm25) AS top FROM full_scores GROUP BY query_id),
fused AS (SELECT query_id, doc_id, vrank, round(0.5 * coalesce(1 / (1 + dist), 0)
    + 0.5 * CASE WHEN top > 0 THEN bm25 / top ELSE 0 END, 6) AS score
    FROM full_scores JOIN mx USING (query_id)),
ranked AS (SELECT query_id, doc_id, score, {_rank('PARTITION BY query_id ORDER BY score DESC, vrank NULLS LAST, doc_id')} AS rank
    FROM fused)"""

_PROTO = """
p AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings),
proto AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM p GROUP BY ALL),
v AS (SELECT vec_id, generate_subscripts(embedding, 1) AS pos,
             CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
pn AS (SELECT label, sqrt(sum(x * x)) AS n FROM proto GROUP BY label),
vn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM v GROUP BY vec_id),
cosine AS (SELECT label, vec_id, sum(proto.x * v.x) / greatest(any_value(pn.n * vn.n), 1e-12) AS c
    FROM proto JOIN v USING (pos) JOIN pn USING (label) JOIN vn USING (vec_id)
    GROUP BY label, vec_id)"""

_DOC_TYPE = """CASE WHEN lang = 'en' THEN 'text' WHEN lang = 'fr' THEN 'table'
    ELSE 'table_summary' END"""


def _bm25_ranked(k: int) -> str:
    return f"""{_BM25},
top AS (SELECT query_id, doc_id AS doc_key, bm25 AS score,
    {_rank('PARTITION BY query_id ORDER BY bm25 DESC, doc_id')} AS rank FROM bm QUALIFY rank <= {k})"""


def _decayed(k: int) -> str:
    return f"""
base AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r
    FROM events QUALIFY r <= {k}),
aged AS (SELECT *, CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0)
    AS INTEGER) AS days_old FROM base),
dec AS (SELECT user_id AS query_id, event_id AS doc_key, event_type, days_old, r,
    exp(-0.1 * days_old / 365) AS f, round(value * exp(-0.1 * days_old / 365), 6) AS score FROM aged),
rr AS (SELECT *, {_rank('PARTITION BY query_id ORDER BY score DESC, r')} AS rank FROM dec)"""


_ANSWERS = f"""
a AS (SELECT o_orderkey AS answer_id, o_custkey AS customer, {_num_list(
    "'The total was $' || o_totalprice || ' at priority ' || o_orderpriority || '.'")} AS nums
    FROM orders),
an AS (SELECT answer_id, customer, unnest(nums) AS t FROM a),
en AS (SELECT DISTINCT o_custkey AS customer, unnest({_num_list(
    "l_quantity || ' units for $' || l_extendedprice || ', discount ' || l_discount || '.'")}) AS c
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
good AS (SELECT DISTINCT customer, t FROM (SELECT DISTINCT customer, t FROM an) JOIN en USING (customer)
    WHERE abs(t - c) < 0.01 OR (c <> 0 AND abs(t - c) / abs(c) < 0.01)),
chk AS (SELECT answer_id, count(*) AS n_numbers, count(*) FILTER (good.t IS NULL) AS n_unverified
    FROM an LEFT JOIN good ON good.customer = an.customer AND good.t = an.t GROUP BY answer_id),
res AS (SELECT o_orderkey AS answer_id, coalesce(n_numbers, 0) AS n_numbers,
    coalesce(n_unverified, 0) AS n_unverified FROM orders LEFT JOIN chk ON answer_id = o_orderkey)"""

_LINE_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _vote(key: str) -> str:
    return f"""
WITH runs AS (SELECT l_orderkey AS q,
    CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey AS s,
    'answer = ' || l_quantity AS program, floor(l_quantity / 10) + l_tax / 10000000 AS answer,
    l_returnflag <> 'R' AS ok FROM lineitem),
cand AS (SELECT q, {key} AS k, count(*) AS votes, min(s) AS seen, arg_min(answer, s) AS answer,
    arg_min(program, s) AS program FROM runs WHERE ok GROUP BY ALL),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY q ORDER BY votes DESC, seen) = 1),
n AS (SELECT q, count(*) AS n_runs, count(*) FILTER (ok) AS n_success FROM runs GROUP BY q)
SELECT q AS question_id, round(answer, 9) AS answer, program, votes, n_runs, n_success
FROM n LEFT JOIN best USING (q)"""


_PART = """
WITH part_rows AS (SELECT p_partkey, p_name, p_type, p_brand, p_size,
    CAST(p_retailprice AS VARCHAR) AS price, CAST(p_size AS VARCHAR) AS size,
    p_retailprice AS price_n FROM part)"""

_PART_MD = """'| Item | Price | Size | Price |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) ||
    '| ' || p_name || ' | $' || price || ' | ' || size || ' | n/a |' || chr(10) ||
    '| ' || p_type || ' | (' || price || ') | 5% |@PAD' || chr(10) ||
    '| ' || p_brand || ' | Revenue | ' || size || ' mm | ' || price || ' |'"""

# column "Size" holds two numbers of three, the first "Price" two of three, the last
# "Price" one of two cells in the third and first row
_PART_SUMMARY = "'Columns: Item, Price, Size, Price. 3 rows of data. Numeric columns: Price, Size'"


def _num_grid() -> str:
    return """
SELECT p_partkey, 'Size' AS metric, unnest([0, 1, 2]) AS pos,
    unnest([CAST(p_size AS DOUBLE), 5.0, CAST(p_size AS DOUBLE)]) AS value FROM part
UNION ALL SELECT p_partkey, 'Price', 0, p_retailprice FROM part"""


_ITEMS_ANNUAL = [
    (r"ITEM\s+1[^A0-9]", "Item 1 - Business"),
    (r"ITEM\s+1A", "Item 1A - Risk Factors"),
    (r"ITEM\s+1B", "Item 1B - Unresolved Staff Comments"),
    (r"ITEM\s+2[^.]", "Item 2 - Properties"),
    (r"ITEM\s+7[^A]", "Item 7 - Management's Discussion and Analysis"),
    (r"ITEM\s+8[^.]", "Item 8 - Financial Statements"),
    (r"ITEM\s+10[^.]", "Item 10 - Directors and Executive Officers"),
]
_ITEMS_QUARTERLY = [
    (r"ITEM\s+1[^A]", "Item 1 - Financial Statements"),
    (r"ITEM\s+2[^.]", "Item 2 - Management's Discussion and Analysis"),
    (r"ITEM\s+1A", "Item 1A - Risk Factors"),
]


def _hits() -> str:
    """One row per match of every heading pattern: kind, pattern number, name, start."""
    parts = []
    for kind, items in (("10-K", _ITEMS_ANNUAL), ("10-q", _ITEMS_QUARTERLY)):
        for number, (pattern, name) in enumerate(items):
            label = name.replace("'", "''")
            parts.append(f"""
    SELECT doc_id, {number} AS pat, '{label}' AS section, list_sum(list_transform(
        list_slice(pieces, 1, i), lambda p: len(p))) + 1 AS pos0 FROM (
        SELECT doc_id, pieces, unnest(range(1, len(pieces))) AS i FROM (
            SELECT doc_id, string_split(regexp_replace(content, '(?i)({pattern})',
                chr(1) || '\\1', 'g'), chr(1)) AS pieces
            FROM filing WHERE filing_type = '{kind}'))""")
    return " UNION ALL ".join(parts)


_SECTIONS = rf"""
WITH filing AS (SELECT doc_id,
    CASE WHEN lang = 'en' THEN '10-K' WHEN lang = 'de' THEN '8-K' ELSE '10-q' END AS filing_type,
    'Cover' || chr(10) || 'ITEM 1. BUSINESS' || chr(10) || text || chr(10) || 'Item 1A. RISK'
    || chr(10) || text || chr(10) || 'ITEM 2 PROPERTIES see ITEM 8.' || chr(10) || text || chr(10)
    || 'ITEM  7. REVIEW' || chr(10) || text || chr(10) || 'Item 10 DIRECTORS' || chr(10) || text
    || chr(10) || 'ITEM 1A. RISK AGAIN' || chr(10) || text AS content FROM documents),
hits AS ({_hits()}),
cut AS (SELECT h.doc_id, section, pos0, pat, regexp_replace(substring(content, CAST(pos0 AS BIGINT),
    CAST(coalesce(lead(pos0) OVER (PARTITION BY h.doc_id ORDER BY pos0, pat), len(content) + 1) - pos0 AS BIGINT)),
    '^\s+|\s+$', '', 'g') AS content FROM hits h JOIN filing f USING (doc_id)),
long AS (SELECT * FROM cut WHERE len(content) > 100),
kept AS (SELECT doc_id, section, arg_max(content, (pos0, pat)) AS content FROM long GROUP BY ALL),
secs AS (SELECT * FROM kept UNION ALL SELECT doc_id, 'full_document', content FROM filing
    WHERE doc_id NOT IN (SELECT doc_id FROM kept))"""

_IMPORTANT = """(section IN ('Item 1 - Business', 'Item 1A - Risk Factors',
    'Item 7 - Management''s Discussion and Analysis', 'Item 8 - Financial Statements',
    'Item 2 - Management''s Discussion and Analysis', 'Item 1 - Financial Statements'))"""

_CHUNKS = rf"""
WITH RECURSIVE paras AS (SELECT doc_id, i, len(list_filter(regexp_split_to_array(
        string_split(text, chr(10))[i], '\s+'), lambda w: w <> '')) AS n
    FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
          FROM documents)),
walk(doc_id, i, a, b, done_a, done_b) AS (
    SELECT doc_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT FROM documents
    UNION ALL
    SELECT w.doc_id, p.i::BIGINT,
        CASE WHEN w.b - w.a + p.n > 64 AND w.b > w.a THEN w.b - least(8, w.b - w.a) ELSE w.a END,
        w.b + p.n,
        CASE WHEN w.b - w.a + p.n > 64 AND w.b > w.a THEN w.a END,
        CASE WHEN w.b - w.a + p.n > 64 AND w.b > w.a THEN w.b END
    FROM walk w JOIN paras p ON p.doc_id = w.doc_id AND p.i = w.i + 1),
spans AS (SELECT doc_id, i, done_a AS a, done_b AS b FROM walk WHERE done_b IS NOT NULL
    UNION ALL
    SELECT doc_id, i + 1, a, b FROM walk WHERE b > a
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1),
ws AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws
    FROM documents)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, a) - 1 AS INTEGER) AS chunk_id,
    array_to_string(list_slice(ws, a + 1, b), ' ') AS content, CAST(b - a AS INTEGER) AS word_count
FROM spans JOIN ws USING (doc_id)"""

_LINES = r"string_split(text, chr(10))"
_HALF = f"(len({_LINES}) // 2)"

_QA_DOCS = rf"""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'What is ' || source || '?' AS question, lang,
    n_chars, {_LINES} AS lines, {_HALF} AS half FROM documents),
e AS (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d),
texts AS (SELECT id || CASE WHEN i <= half THEN '_pre_' || (i - 1) ELSE '_post_' || (i - 1 - half)
    END AS doc_id, lines[i] AS content, 'text' AS doc_type,
    CASE WHEN i <= half THEN 'pre_text' ELSE 'post_text' END AS section, id AS question_id,
    CAST(CASE WHEN i <= half THEN i - 1 ELSE i - 1 - half END AS INTEGER) AS idx, question,
    CAST(NULL AS VARCHAR) AS original_table_id FROM e WHERE regexp_matches(lines[i], '\S')),
tabs AS (SELECT id || '_table' AS doc_id, '| lang | chars |' || chr(10) || '| --- | --- |' || chr(10)
    || '| ' || lang || ' | ' || n_chars || ' |' AS content, 'table' AS doc_type, 'table' AS section,
    id AS question_id, CAST(NULL AS INTEGER) AS idx, question, CAST(NULL AS VARCHAR) FROM d
    WHERE lang <> 'es'),
sums AS (SELECT id || '_table_summary', 'Table with columns: lang, chars. chars: values include '
    || n_chars || '.0', 'table_summary', 'table_summary', id, CAST(NULL AS INTEGER), question,
    id || '_table' FROM d WHERE lang <> 'es')
SELECT doc_id, 'chunk_0' AS chunk_id, content, doc_type, section, question_id, idx, question,
    original_table_id FROM (SELECT * FROM texts UNION ALL SELECT * FROM tabs UNION ALL SELECT * FROM sums)"""

_CLAIMS = """
WITH t AS (SELECT o_custkey AS entity,
    CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS total,
    max(o_totalprice) AS largest, min(o_totalprice) AS smallest,
    CASE WHEN count(*) % 2 = 0 THEN 1.0005::DOUBLE ELSE 1.01::DOUBLE END AS shift
    FROM orders GROUP BY o_custkey),
c AS (SELECT entity, 'Revenue' AS metric, total AS claimed, total * shift AS fact FROM t
    UNION ALL SELECT entity, 'net income', largest, largest * shift FROM t
    UNION ALL SELECT entity, 'smallest', smallest, smallest + 0.005 FROM t
    UNION ALL SELECT entity, 'total assets', total, NULL FROM t),
m AS (SELECT *, coalesce(claimed = fact OR abs(claimed - fact) < 0.01
    OR (fact <> 0 AND abs(claimed - fact) / abs(fact) < 0.001), false) AS verified FROM c),
r AS (SELECT *, CASE WHEN fact IS NULL THEN 'Metric not found in XBRL'
    WHEN NOT verified THEN 'Value mismatch' END AS reason FROM m)"""


def _metric_row(rounding: int) -> str:
    return rf"""SELECT
    CASE WHEN l_returnflag <> 'R' THEN round(l_extendedprice, {rounding}) ELSE -999.0 END AS p,
    CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END AS g, l_returnflag <> 'R' AS ok,
    l_linestatus = 'O' AS has_e, [round(l_extendedprice, 1), l_quantity] AS e,
    [l_quantity, l_tax] AS u FROM lineitem"""


def _metric_sql(rounding: int) -> str:
    return f"""(SELECT *,
    exact_matches / total_examples AS exact_match, numerical_correct / total_examples AS numerical_accuracy,
    execution_success / total_examples AS execution_success_rate,
    hallucination_count / total_numbers AS hallucination_rate FROM (SELECT
    count(*) AS total_examples, count(*) FILTER (abs(p - g) < 1e-6) AS exact_matches,
    count(*) FILTER (abs(p - g) < 1e-3) AS numerical_correct,
    count(*) FILTER (g IS NOT NULL AND ok) AS execution_success,
    avg(CASE WHEN g IS NOT NULL AND has_e THEN CASE WHEN abs(e[1] - g) < 1e-3 OR abs(e[2] - g) < 1e-3
        THEN 1.0 ELSE 0.0 END END) AS evidence_precision,
    sum(CASE WHEN g IS NULL THEN 0 ELSE len(list_filter(u, lambda x: NOT (has_e AND
        (abs(x - e[1]) < 1e-3 OR abs(x - e[2]) < 1e-3)))) END) AS hallucination_count,
    sum(CASE WHEN g IS NULL THEN 0 ELSE 2 END) AS total_numbers,
    count(*) FILTER (g IS NULL) AS n_skipped FROM ({_metric_row(rounding)})))"""


_COMPARED = [
    ("exact_match", "Exact Match"),
    ("numerical_accuracy", "Numerical Accuracy"),
    ("execution_success_rate", "Execution Success Rate"),
    ("evidence_precision", "Evidence Precision"),
    ("hallucination_rate", "Hallucination Rate (lower is better)"),
]


def _compare_sql() -> str:
    rows = " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, '{label}' AS label, b.{m} AS baseline, p.{m} AS proposed,
        {'b.' + m + ' - p.' + m if 'halluc' in m else 'p.' + m + ' - b.' + m} AS absolute FROM b, p"""
        for m, label in _COMPARED
    )
    return f"""WITH b AS {_metric_sql(0)}, p AS {_metric_sql(1)}, r AS ({rows})
SELECT metric, label, round(baseline, 6) AS baseline, round(proposed, 6) AS proposed,
    round(absolute, 6) AS absolute,
    round(CASE WHEN baseline > 0 THEN absolute / baseline * 100 ELSE 0 END, 6) AS percentage FROM r"""


def _html_sql(header_cells: bool) -> str:
    """Both readings differ only in how cell text is cleaned."""
    head2 = "Price ($)" if header_cells else "Price\n ($)"
    mm = "Size mm" if header_cells else "Sizemm"
    head2_sql = head2.replace("\n", "' || chr(10) || '")
    return f"""{_PART},
one AS (SELECT p_partkey, 0 AS table_id, 'Price of ' || p_name AS caption,
    'Name;{head2_sql}' AS headers, p_type || ';' || price || ';{mm};' || size || ';extra' AS cells,
    2 AS num_rows, 2 AS num_cols, '| Name | {head2_sql} |' || chr(10) || '| --- | --- |' || chr(10)
    || '| ' || p_type || ' | ' || price || ' |' || chr(10) || '| {mm} | ' || size || ' |' AS markdown,
    'Table: Price of ' || p_name || '. Columns: Name, {head2_sql}. 2 rows of data. Numeric columns: {head2_sql}'
    AS summary FROM part_rows)"""


def oracle_sql() -> dict[str, str]:
    sql = {
        "bm25_topk": f"WITH {_bm25_ranked(5)} SELECT * FROM top",
        "bm25_indexed": f"WITH {_bm25_ranked(5)} SELECT * FROM top",
        "index_changes": f"""WITH left_docs AS (SELECT * FROM documents WHERE doc_id NOT IN
    (SELECT doc_id FROM labels WHERE toxic = 1)), {_BM25.replace('FROM documents', 'FROM left_docs')}
SELECT query_id, doc_id AS doc_key, bm25 AS score, {_rank(
    "PARTITION BY query_id ORDER BY bm25 DESC, coalesce(lang = 'en', false), doc_id")} AS rank
FROM bm JOIN (SELECT doc_id, lang FROM left_docs) USING (doc_id) QUALIFY rank <= 5""",
        "term_idf": f"WITH {_BM25} SELECT token, df, round(idf, 6) AS idf FROM idf",
        "vector_topk": f"""WITH {_PROTO}
SELECT label AS query_id, vec_id AS doc_key, round(1 - c, 6) AS distance,
    {_rank('PARTITION BY label ORDER BY round(1 - c, 6), vec_id')} AS rank
FROM cosine QUALIFY rank <= 10""",
        "text_embedding": f"""WITH {_features('documents', 'doc_id', 'de')}
SELECT id AS doc_key, f AS feature, round(x, 5) AS weight FROM de""",
        "hybrid_topk": f"""WITH {_HYBRID.replace('@VEC', '10')}
SELECT query_id, doc_id AS doc_key, score, rank FROM ranked WHERE rank <= 5""",
        "hybrid_rerank": f"""WITH {_HYBRID.replace('@VEC', '30')},
pool AS (SELECT * FROM ranked WHERE rank <= 15),
ov AS (SELECT query_id, r.doc_id, score, rank, len(list_intersect(list_distinct({_words('b.text')}),
    {_words('d.text')})) / len(list_distinct({_words('b.text')})) AS ce
    FROM pool r JOIN benchmark b ON item_id = query_id JOIN documents d ON d.doc_id = r.doc_id),
mm AS (SELECT query_id, min(ce) AS lo, max(ce) AS hi FROM ov GROUP BY query_id),
bl AS (SELECT query_id, doc_id, rank AS r0, round(0.7 * score + 0.3 * (ce - lo)
    / greatest(hi - lo, 1e-12), 8) AS score FROM ov JOIN mm USING (query_id))
SELECT query_id, doc_id AS doc_key, score,
    {_rank('PARTITION BY query_id ORDER BY score DESC, r0')} AS rank FROM bl QUALIFY rank <= 5""",
        "diversify_by_type": f"""WITH {_bm25_ranked(20)},
ty AS (SELECT query_id, doc_key, score, rank AS r, {_DOC_TYPE} AS doc_type
    FROM top JOIN documents ON doc_id = doc_key),
nt AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_type ORDER BY r) AS nth FROM ty),
fl AS (SELECT * FROM nt WHERE nth <= CASE doc_type WHEN 'table' THEN 2 WHEN 'text' THEN 3 ELSE 5 END)
SELECT query_id, doc_key, doc_type, score, {_rank('''PARTITION BY query_id ORDER BY
    CASE doc_type WHEN 'table' THEN 1 WHEN 'text' THEN 2 ELSE 3 END, r''')} AS rank
FROM fl QUALIFY rank <= 5""",
        "postfilter_topk": f"""WITH {_bm25_ranked(10)},
src AS (SELECT top.*, source FROM top JOIN documents ON doc_id = doc_key),
sc AS (SELECT query_id, source FROM src WHERE rank = 1)
SELECT query_id, doc_key, score, {_rank('PARTITION BY query_id ORDER BY r')} AS rank
FROM (SELECT s.query_id, doc_key, score, s.rank AS r FROM src s JOIN sc USING (query_id, source))
QUALIFY rank <= 5""",
        "prefilter_topk": f"""WITH {_bm25_ranked(1)},
sc AS (SELECT query_id, source FROM top JOIN documents ON doc_id = doc_key),
lab AS (SELECT bm.*, source FROM bm JOIN documents USING (doc_id))
SELECT query_id, doc_id AS doc_key, bm25 AS score,
    {_rank('PARTITION BY query_id ORDER BY bm25 DESC, doc_id')} AS rank
FROM lab JOIN sc USING (query_id, source) QUALIFY rank <= 5""",
        "semantic_cache_lookup": f"""WITH {_PROTO},
b AS (SELECT vec_id, label, round(c, 6) AS c FROM cosine
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(c, 6) DESC, label) = 1)
SELECT vec_id AS query_id, CASE WHEN c >= 0.25 THEN 'answer ' || label END AS value,
    c AS similarity, c >= 0.25 AS is_hit FROM b""",
        "temporal_decay_rank": f"""WITH {_decayed(20)}
SELECT query_id, doc_key, days_old, round(f, 6) AS decay_factor, score, rank FROM rr""",
        "recent_filings": f"""WITH {_decayed(20)}
SELECT query_id, doc_key, days_old, score, rank FROM rr
WHERE event_type = 'purchase' AND days_old <= 20
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 10""",
        "most_recent": f"""WITH {_decayed(2)}
SELECT query_id, doc_key, days_old, score, rank FROM rr
WHERE event_type = 'purchase' AND days_old <= 365
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 1""",
        "periods_compare": f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey
    ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 24),
ag AS (SELECT *, CAST(floor((epoch_us(TIMESTAMP '2001-08-01') - epoch_us(o_orderdate))
    / 86400000000.0) AS INTEGER) AS days FROM b),
dc AS (SELECT *, round(o_totalprice * exp(-0.1 * days / 365), 6) AS score FROM ag),
rk AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, r) AS rank FROM dc),
fl AS (SELECT *, strftime(o_orderdate, '%Y-%m') AS period FROM rk WHERE days <= 1500
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY rank) <= 12),
pb AS (SELECT * FROM fl QUALIFY row_number() OVER
    (PARTITION BY o_custkey, period ORDER BY score DESC, rank) = 1)
SELECT o_custkey AS query_id, period, {_rank('PARTITION BY o_custkey ORDER BY period DESC')}
    AS period_rank, o_orderkey AS doc_key, score FROM pb QUALIFY period_rank <= 4""",
        "extract_numbers": f"""WITH n AS (SELECT doc_id, {_num_list('text')} AS l FROM documents)
SELECT doc_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS pos, unnest(l) AS number FROM n""",
        "evidence_numbers": r"""WITH n AS (SELECT doc_id, unnest(list_filter(list_transform(
    regexp_extract_all(replace(text, ',', ''), '-?\d+\.?\d*'), lambda m: CAST(m AS DOUBLE)),
    lambda v: v < 1e10)) AS v, generate_subscripts(list_filter(list_transform(
    regexp_extract_all(replace(text, ',', ''), '-?\d+\.?\d*'), lambda m: CAST(m AS DOUBLE)),
    lambda v: v < 1e10), 1) AS i FROM documents),
f AS (SELECT doc_id, v, min(i) AS i FROM n GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos,
    v AS number FROM f""",
        "plain_numbers": r"""WITH n AS (SELECT doc_id, list_transform(
    regexp_extract_all(text, '-?\d+\.?\d*'), lambda m: CAST(m AS DOUBLE)) AS l FROM documents)
SELECT doc_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS pos, unnest(l) AS number FROM n""",
        "numeric_claims": rf"""WITH s AS (SELECT doc_id, regexp_split_to_array(text, '[.!?]+') AS l
    FROM documents),
u AS (SELECT doc_id, unnest(l) AS raw, unnest(range(0, len(l))) AS i FROM s),
k AS (SELECT doc_id, i, raw, {_num_list('raw')} AS n FROM u)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos,
    regexp_replace(raw, '^\s+|\s+$', '', 'g') AS sentence, CAST(len(n) AS INTEGER) AS n_numbers,
    list_max(n) AS largest FROM k WHERE len(n) > 0""",
        "verify_answers": f"""WITH {_ANSWERS}
SELECT answer_id, n_numbers, n_unverified, n_unverified = 0 AS verified,
    CASE WHEN n_numbers = 0 THEN 'No numbers in answer' WHEN n_unverified = 0
    THEN 'All numbers verified' ELSE n_unverified || ' numbers not found in evidence' END AS message
FROM res""",
        "hallucination_rate": f"""WITH {_ANSWERS}
SELECT CAST(sum(n_numbers) AS BIGINT) AS total_numbers,
    CAST(sum(n_unverified) AS BIGINT) AS hallucinated_numbers,
    round(sum(n_unverified) / sum(n_numbers), 6) AS hallucination_rate FROM res""",
        "program_execute": f"""WITH x AS (SELECT {_LINE_KEYS}, l_extendedprice AS p,
    l_returnflag = 'R' AS bad, l_extendedprice - l_extendedprice * l_discount + l_quantity + l_tax
    AS total FROM lineitem)
SELECT {_LINE_KEYS}, CASE WHEN NOT bad THEN round(total / p * 100, 6) END AS final_answer,
    CAST(CASE WHEN bad THEN 5 ELSE 6 END AS INTEGER) AS n_steps, round(total, 4) AS total,
    CASE WHEN bad THEN 'Error executing line ''answer = power(total, const_0)'': Unknown operation: power'
    END AS error FROM x""",
        "program_verify": f"""SELECT {_LINE_KEYS}, CASE WHEN NOT (abs(l_tax - l_extendedprice) < 1e-6
    OR abs(l_tax - l_quantity) < 1e-6 OR abs(l_tax - l_discount) < 1e-6) THEN l_tax END
    AS unknown_number FROM lineitem""",
        "program_vote": _vote("round(answer, 6)"),
        "program_vote_text": _vote("CAST(answer AS VARCHAR)"),
        "grid_markdown": f"{_PART} SELECT p_partkey, {_PART_MD.replace('@PAD', '')} AS markdown FROM part_rows",
        "table_markdown": f"{_PART} SELECT p_partkey, {_PART_MD.replace('@PAD', '  |')} AS markdown FROM part_rows",
        "grid_summary": f"""{_PART} SELECT p_partkey, 'Table with columns: Item, Price, Size, Price. '
    || 'Price: values include ' || price || '. Size: values include ' || size || '.0, 5.0'
    || '. Price: values include ' || price AS summary FROM part_rows""",
        "table_summary": f"""{_PART} SELECT p_partkey, CASE WHEN p_size > 25 THEN 'Table: Balance of '
    || p_name || '. ' ELSE '' END || {_PART_SUMMARY} AS summary FROM part_rows""",
        "numeric_columns": "SELECT p_partkey, 'Price, Size' AS columns FROM part",
        "financial_data": _num_grid(),
        "financial_filter": "SELECT p_partkey, 'Balance of ' || p_name AS caption FROM part WHERE p_size > 25",
        "markdown_tables": f"""{_PART}, m AS (SELECT *, p_name || ';$' || price || ';'
    || size || ';n/a;' || p_type || ';(' || price || ');5%;' || p_brand || ';Revenue;' || size
    || ' mm;' || price AS cells FROM part_rows)
SELECT p_partkey, 0 AS table_id, 'Item;Price;Size;Price' AS headers, cells, 3 AS num_rows,
    4 AS num_cols, {_PART_SUMMARY} AS summary FROM m
UNION ALL SELECT p_partkey, 1, 'Size', size, 1, 1,
    'Columns: Size. 1 rows of data. Numeric columns: Size' FROM m""",
        "html_tables": f"""{_html_sql(False)}
SELECT * FROM one UNION ALL SELECT p_partkey, 1, NULL, p_brand || ';' || size, '', 0, 2,
    '| ' || p_brand || ' | ' || size || ' |' || chr(10) || '| --- | --- |',
    'Columns: ' || p_brand || ', ' || size FROM part_rows""",
        "html_header_tables": f"{_html_sql(True)} SELECT * FROM one",
        "sections": f"{_SECTIONS} SELECT doc_id, section, content FROM secs",
        "important_sections": f"""{_SECTIONS},
flag AS (SELECT *, {_IMPORTANT} AS imp, bool_or({_IMPORTANT}) OVER (PARTITION BY doc_id) AS has FROM secs)
SELECT doc_id, section, content FROM flag WHERE imp OR NOT has""",
        "chunks": _CHUNKS,
        "cache_reuse": f"""WITH {_features('documents', 'doc_id', 'de')},
dn AS (SELECT id, sqrt(sum(x * x)) AS n, any_value(concat_ws('/', source, lang)) AS scope
    FROM de JOIN documents ON id = doc_id GROUP BY id),
dot AS (SELECT p.id AS a, q.id AS b, sum(p.x * q.x) AS s FROM de p JOIN dn pn ON pn.id = p.id
    JOIN de q ON p.f = q.f AND q.id < p.id JOIN dn qn ON qn.id = q.id AND pn.scope = qn.scope GROUP BY ALL),
sim AS (SELECT a, b, round(s / (p.n * q.n), 6) AS similarity FROM dot JOIN dn p ON a = p.id JOIN dn q ON b = q.id)
SELECT a AS query_id, count(*) AS n_similar, arg_min(b, (-similarity, b)) AS ord, max(similarity) AS similarity
FROM sim WHERE similarity >= 0.95 GROUP BY a""",
        "qa_documents": _QA_DOCS,
        "index_order": f"""SELECT row_number() OVER (ORDER BY CAST(question_id AS BIGINT),
    CASE section WHEN 'pre_text' THEN 0 WHEN 'post_text' THEN 1 WHEN 'table' THEN 2 ELSE 3 END, idx) - 1 AS ord,
    doc_id || '_' || chunk_id AS doc_key, doc_type FROM ({_QA_DOCS})""",
        "facts_check": f"""{_CLAIMS} SELECT entity, metric, claimed, round(fact, 8) AS fact, verified,
    reason, CASE WHEN reason = 'Value mismatch' THEN round(abs(claimed - fact), 6) END AS diff,
    CASE WHEN reason = 'Value mismatch' THEN round(abs(claimed - fact) / fact * 100, 4) END AS diff_pct
FROM r""",
        "facts_rollup": f"""{_CLAIMS}, g AS (SELECT entity,
    count(*) FILTER (reason = 'Value mismatch') AS n_discrepancies,
    count(*) FILTER (reason = 'Metric not found in XBRL') AS n_missing,
    coalesce(string_agg(CASE WHEN reason = 'Value mismatch' THEN metric END, ', ' ORDER BY metric), '')
    AS discrepancies FROM r GROUP BY entity)
SELECT entity, n_discrepancies = 0 AS verified, discrepancies, n_discrepancies, n_missing,
    CASE WHEN n_discrepancies = 0 THEN 'All values verified'
    ELSE n_discrepancies || ' discrepancies found' END AS message FROM g""",
        "qa_metrics": f"""SELECT round(exact_match, 6) AS exact_match,
    round(numerical_accuracy, 6) AS numerical_accuracy,
    round(execution_success_rate, 6) AS execution_success_rate,
    round(evidence_precision, 6) AS evidence_precision,
    round(hallucination_rate, 6) AS hallucination_rate, total_examples, exact_matches,
    numerical_correct, execution_success, CAST(hallucination_count AS BIGINT) AS hallucination_count,
    CAST(total_numbers AS BIGINT) AS total_numbers, n_skipped FROM {_metric_sql(1)}""",
        "compare_report": _compare_sql(),
    }
    return sql
