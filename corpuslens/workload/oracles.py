"""SQL counterparts of the registered queries, for DuckDB on the same tables.

The derived corpus is built by the same formulas; what the operators have to find in it
is then stated from the construction (which part key yields which declaration), or found
by other means (line lists, recursive walks) than the operators use.
"""

from __future__ import annotations

from corpuslens.operators.rollup import ASPECT_RULES, CATEGORIES, OTHER_ASPECT
from corpuslens.workload import fixtures as X

ORACLES: dict[str, str] = {}


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


# --- the derived corpus and what is in it -------------------------------------

FILES = f"files AS (SELECT {X.FILE_COLUMNS}, p_partkey AS k, p_size AS s, p_type, {X.ROLE} AS role FROM part)"
ACME = f"files AS (SELECT 'acme' AS repo, * EXCLUDE (repo) FROM (SELECT {X.FILE_COLUMNS}, p_partkey AS k, p_size AS s, p_type, {X.ROLE} AS role FROM part))"
LN = "ln AS (SELECT *, string_split(rtrim(source, chr(10)), chr(10)) AS l FROM files)"
GOOD = "good AS (SELECT * FROM ln WHERE k % 50 <> 49)"


def _pos(line: str) -> str:
    """Line number of an exact line; <k> stands for the key."""
    pieces = "(" + " || k || ".join("'" + p.replace("'", "''") + "'" for p in line.split("<k>")) + ")"
    return f"CAST(list_position(l, {pieces}) AS BIGINT)"


MODE_LINE = "    enum Mode<k> { ON, OFF; }"
INNER, PORT, MODE = "k % 3 = 0", "k % 6 = 0", "k % 8 = 0"
TYPES = f"""typ AS (
  SELECT repo, k, s, role, p_type, file_path, source, l, 0 AS idx, 'class' AS kind, 'C' || k AS class_name,
         {_pos('public class C<k> {')} AS sl, {_pos('}')} AS el FROM good
  UNION ALL
  SELECT repo, k, s, role, p_type, file_path, source, l, 1, 'class', 'Inner' || k,
         {_pos('    static class Inner<k> {')}, {_pos('    static class Inner<k> {')} + 2 FROM good WHERE {INNER}
  UNION ALL
  SELECT repo, k, s, role, p_type, file_path, source, l, 2, 'interface', 'Port' || k,
         {_pos('    interface Port<k> { void call(String s); }')}, {_pos('    interface Port<k> { void call(String s); }')}
  FROM good WHERE {PORT}
  UNION ALL
  SELECT repo, k, s, role, p_type, file_path, source, l,
         1 + CASE WHEN {INNER} THEN 1 ELSE 0 END + CASE WHEN {PORT} THEN 1 ELSE 0 END, 'enum', 'Mode' || k,
         {_pos(MODE_LINE)}, {_pos(MODE_LINE)}
  FROM good WHERE {MODE})"""
TYPE_ORD = "(k * 268435456 + idx)"
PACKAGE = "('com.acme.services.' || lower(p_type) || '.' || role)"
CLASS_TYPE = """(CASE WHEN idx = 0 AND k % 20 = 0 THEN 'controller' WHEN idx = 0 AND k % 10 = 1 THEN 'service'
  WHEN idx = 0 AND k % 30 = 9 THEN 'config' WHEN role = 'util' THEN 'other' ELSE role END)"""

A_LINE = '    public List<String> methodA(@PathVariable("id") final Long id, String[] names) {'
CTOR_LINE = "    public C<k>(Map<String, List<Integer>> m, int... n) {"


def _end_after(line: str) -> str:
    return f"{_pos(line)} + CAST(list_position(l[({_pos(line)} + 1):], '    }}') AS BIGINT)"


METHODS = f"""mth AS (
  SELECT repo, k, s, source, {TYPE_ORD} AS type_ord, class_name, 0 AS mo, class_name AS name,
         'void ' || class_name || '(Map m, int n)' AS signature, 'void' AS ret, 'Map m, int n' AS params,
         'public' AS mods, {_pos(CTOR_LINE)} AS sl, {_pos(CTOR_LINE)} + 2 AS el, 1 AS cyc,
         'C' || k || '(Map<' AS core FROM typ WHERE idx = 0
  UNION ALL
  SELECT repo, k, s, source, {TYPE_ORD}, class_name, 1, 'methodA', 'List methodA(Long id, String names)', 'List',
         'Long id, String names', 'public', {_pos(A_LINE)}, {_end_after(A_LINE)}, 1 + 2 * (s % 15),
         'List<String> methodA(' FROM typ WHERE idx = 0
  UNION ALL
  SELECT repo, k, s, source, {TYPE_ORD}, class_name, 2, 'methodB', 'void methodB()', 'void', '', '',
         {_pos('    void methodB() {')}, {_end_after('    void methodB() {')}, CASE WHEN k % 11 < 2 THEN 2 ELSE 1 END,
         'void methodB(' FROM typ WHERE idx = 0
  UNION ALL
  SELECT repo, k, s, source, {TYPE_ORD}, class_name, 0, 'get', 'int get()', 'int', '', '', sl + 1, sl + 1, 1,
         'int get(' FROM typ WHERE class_name LIKE 'Inner%'
  UNION ALL
  SELECT repo, k, s, source, {TYPE_ORD}, class_name, 0, 'call', 'void call(String s)', 'void', 'String s', '', sl, sl, 1,
         'void call(' FROM typ WHERE class_name LIKE 'Port%')"""
MEASURED = "met AS (SELECT *, el - sl + 1 AS loc, (cyc > 10 OR el - sl + 1 > 40) AS hi FROM mth)"
CORPUS = (FILES, LN, GOOD, TYPES)
CORPUS_M = (*CORPUS, METHODS, MEASURED)

IMPORTS = f"""imp AS (
  SELECT repo, {TYPE_ORD} AS type_ord, class_name, unnest(
    ['java.util.List', 'com.acme.C' || {X.IMPORT_A.replace('p_partkey', 'k')},
     'com.acme.C' || {X.IMPORT_B.replace('p_partkey', 'k')}, 'com.acme.C' || {X.IMPORT_HUB.replace('p_partkey', 'k')}]
    || CASE WHEN k % 12 = 0 THEN ['com.acme.C' || {X.IMPORT_STATIC.replace('p_partkey', 'k')}] ELSE [] END) AS import_path
  FROM typ)"""
EDGES = """edges AS (
  SELECT i.repo, min(type_ord) AS from_ord, i.class_name AS from_class, string_split(import_path, '.')[-1] AS to_class
  FROM imp i WHERE EXISTS (SELECT 1 FROM typ t WHERE t.repo = i.repo AND t.class_name = string_split(i.import_path, '.')[-1])
    AND i.class_name <> string_split(import_path, '.')[-1]
  GROUP BY 1, 3, 4)"""
COMMITS = """com AS (SELECT f.repo, f.file_path, -epoch_us(e.ts) AS commit_ord, strftime(e.ts, '%Y-%m-%d') AS date
  FROM events e JOIN files f ON f.k = e.user_id)"""
CHURN = "churn AS (SELECT repo, file_path, count(*) AS commit_count, arg_min(date, commit_ord) AS last_modified FROM com GROUP BY 1, 2)"
HEAVY = "heavy AS (SELECT type_ord, count(*) FILTER (WHERE hi) AS heavy_methods, count(*) AS n FROM met GROUP BY 1)"
HOT = f"""hot AS (SELECT * FROM (
  SELECT t.repo, {TYPE_ORD} AS type_ord, t.class_name, t.file_path, c.commit_count, c.last_modified,
         coalesce(h.heavy_methods, 0) AS heavy_methods, c.commit_count * (1 + coalesce(h.heavy_methods, 0)) AS score,
         row_number() OVER (PARTITION BY t.repo ORDER BY c.commit_count * (1 + coalesce(h.heavy_methods, 0)) DESC,
                            t.class_name, {TYPE_ORD}) AS rank
  FROM typ t JOIN churn c USING (repo, file_path) LEFT JOIN heavy h ON h.type_ord = {TYPE_ORD}) WHERE rank <= 8)"""
FINDINGS = f"""find AS (
  SELECT repo, k, {TYPE_ORD} AS type_ord, class_name, 0 AS r, 'hardcoded_secret' AS category, 'high' AS severity,
         'Hardcoded credential-like value in field ''apiToken''.' AS message,
         {_pos('    private String apiToken = "k<k>";')} AS line
  FROM typ WHERE idx = 0 AND k % 7 = 0 AND k % 21 <> 0
  UNION ALL
  SELECT repo, k, {TYPE_ORD}, class_name, 1, 'sql_injection_risk', 'medium',
         'SQL string appears to be built via concatenation rather than a parameterized query.',
         {_pos('        String sql = "SELECT * FROM t WHERE id = " + id;')}
  FROM typ WHERE idx = 0 AND k % 5 = 0
  UNION ALL
  SELECT repo, k, {TYPE_ORD}, class_name, 2, 'empty_catch_block', 'low',
         'Empty catch block silently swallows the exception.',
         {_pos('        try { run(); } catch (Exception e) { // ignored')}
  FROM typ WHERE idx = 0 AND k % 11 = 0)"""
ROUTES = f"""rts AS (
  SELECT repo, {TYPE_ORD} AS type_ord, class_name, CASE WHEN k % 20 = 0 THEN 'GET' ELSE 'POST' END AS http_method,
         '/c' || k || '/{{id}}' AS path FROM typ WHERE idx = 0 AND k % 10 = 0)"""
ASPECTS = "[" + ", ".join("'" + w + "'" for w in X.ASPECT_WORDS) + "]"
# described types: type_ord % 4 <> 1, and 268435456 is a multiple of 4
ASP = f"""asp AS (
  SELECT repo, {TYPE_ORD} AS type_ord, class_name, file_path, p.pos AS seen,
         ({ASPECTS})[CAST(CASE WHEN p.pos = 0 THEN k % 11 ELSE k % 7 END AS BIGINT) + 1] AS aspect
  FROM typ, (VALUES (0), (1)) AS p(pos) WHERE idx % 4 <> 1)"""


def _category(text: str) -> str:
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + f" THEN '{label}'"
        for label, words in ASPECT_RULES
    )
    return f"(CASE {arms} ELSE '{OTHER_ASPECT}' END)"


# --- sources -----------------------------------------------------------------

_EXCLUDE = "list_has_any(string_split(file_path, '/'), ['build', 'target', '.git', 'node_modules'])"
ORACLES["corpus_select"] = _with(FILES) + """
SELECT repo, file_path FROM files f WHERE file_path LIKE 'src/main/java/%'
   OR (file_path LIKE 'src/test/java/%' AND EXISTS (SELECT 1 FROM files g WHERE g.repo = f.repo AND g.file_path LIKE 'src/main/java/%'))
   OR NOT EXISTS (SELECT 1 FROM files g WHERE g.repo = f.repo AND g.file_path LIKE 'src/main/java/%')"""

PAGES = """pth AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS repo,
  CASE page_id % 5 WHEN 0 THEN 'build/' WHEN 1 THEN 'lib/target/' WHEN 2 THEN 'services/' ELSE '' END
  || regexp_replace(url, '^[a-z]+://[^/?#]*/?', '') || '/P' || page_id || '.java' AS file_path FROM pages)"""
ORACLES["corpus_fallback"] = _with(PAGES) + f"SELECT repo, file_path FROM pth WHERE NOT {_EXCLUDE}"

# Every file of the corpus lies below one of the two roots, and tests are asked for.
ORACLES["corpus_capped"] = _with(FILES) + """
SELECT repo, file_path FROM (SELECT repo, file_path, row_number() OVER (PARTITION BY repo
  ORDER BY file_path LIKE 'src/test/java/%', string_split(file_path, '/')) AS rn FROM files) WHERE rn <= 20"""

ORACLES["corpus_order"] = _with(FILES) + """
SELECT repo, file_path, row_number() OVER (ORDER BY repo, file_path LIKE 'src/test/java/%',
  string_split(file_path, '/')) - 1 AS file_ord FROM files"""

ORACLES["lenient_decode"] = """
SELECT doc_id, CAST(length(text) + 1 AS BIGINT) AS chars, md5(chr(65533) || text) AS digest FROM documents"""

ORACLES["commit_touches"] = """
SELECT event_type AS repo, -epoch_us(ts) AS commit_ord, strftime(ts, '%Y-%m-%d') AS date,
       unnest(['src/main/java/C' || user_id || '.java', 'docs/D' || (event_id % 97) || '.md']) AS file_path FROM events"""

ORACLES["commit_reanchor"] = """
SELECT 'web' AS repo, page_id AS commit_ord, substr(p, 4) AS file_path FROM (
  SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS p FROM pages) WHERE starts_with(p, 'en/')"""

SIDE = """side AS (SELECT 'R' || CAST(floor(s_suppkey / 4) AS BIGINT) AS repo,
  CASE s_suppkey % 4 WHEN 0 THEN 'readme.md' WHEN 1 THEN 'README.md' WHEN 2 THEN 'pom.xml' ELSE 'build.gradle' END AS file_path,
  repeat(s_name || ' ', 300) AS source FROM supplier)"""


def _excerpt(names: list[str], limit: int) -> str:
    arms = " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(names))
    inside = ", ".join(f"'{n}'" for n in names)
    return f"""SELECT repo, arg_min(file_path, CASE file_path {arms} END) AS file_path,
  substr(arg_min(source, CASE file_path {arms} END), 1, {limit}) AS excerpt
  FROM side WHERE file_path IN ({inside}) GROUP BY repo"""


README, BUILD = ["README.md", "Readme.md", "readme.md"], ["build.gradle.kts", "build.gradle", "pom.xml"]
ORACLES["excerpt_first"] = _with(SIDE) + f"""
SELECT *, 'readme' AS kind FROM ({_excerpt(README, 4000)}) UNION ALL
SELECT *, 'build' AS kind FROM ({_excerpt(BUILD, 3000)})"""

KEYED = "keyed AS (SELECT doc_id, source AS repo, text, sha256('v1:' || text) AS cache_key FROM documents)"
ORACLES["cache_upsert"] = _with(
    KEYED,
    "o AS (SELECT cache_key, 'old ' || min(doc_id) AS description FROM keyed WHERE doc_id % 3 <> 1 GROUP BY 1)",
    "n AS (SELECT cache_key, 'new ' || min(doc_id) AS description FROM keyed WHERE doc_id % 3 <> 0 GROUP BY 1)",
) + "SELECT coalesce(n.cache_key, o.cache_key) AS cache_key, coalesce(n.description, o.description) AS description FROM o FULL JOIN n USING (cache_key)"

# --- extraction --------------------------------------------------------------

ORACLES["masked_source"] = _with(FILES) + r"""
SELECT repo, file_path, CAST(length(m) AS BIGINT) AS chars, md5(m) AS digest FROM (
  SELECT repo, file_path, regexp_replace(regexp_replace(source,
    '//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|"(?:[^"\\]|\\(?s:.))*(?:"|\z)|''(?:[^''\\]|\\(?s:.))*(?:''|\z)', ' ', 'g'), '\s+', ' ', 'g') AS m
  FROM files)"""

ORACLES["type_decls"] = _with(*CORPUS) + f"""
SELECT repo, {TYPE_ORD} AS type_ord, file_path, {PACKAGE} AS package, class_name, kind, sl AS start_line, el AS end_line FROM typ"""

ORACLES["method_decls"] = _with(*CORPUS, METHODS) + """
SELECT repo, type_ord, CAST(mo AS BIGINT) AS method_ord, class_name, name, signature, ret AS return_type,
       params AS parameters, mods AS modifiers, sl AS start_line, el AS end_line FROM mth"""

ORACLES["imports"] = _with(*CORPUS, IMPORTS) + "SELECT repo, type_ord, class_name, import_path FROM imp"

ANNOT = f"""ann AS (
  SELECT repo, {TYPE_ORD} AS type_ord, -1 AS mo, 0 AS pos, 'RestController' AS name, '' AS arguments FROM typ WHERE idx = 0 AND k % 20 = 0
  UNION ALL SELECT repo, {TYPE_ORD}, -1, 1, 'RequestMapping', '/c' || k FROM typ WHERE idx = 0 AND k % 20 = 0
  UNION ALL SELECT repo, {TYPE_ORD}, -1, 0, 'RequestMapping', 'value=/c' || k || '/|produces=json' FROM typ WHERE idx = 0 AND k % 20 = 10
  UNION ALL SELECT repo, {TYPE_ORD}, -1, 0, 'Service', '' FROM typ WHERE idx = 0 AND k % 10 = 1
  UNION ALL SELECT repo, {TYPE_ORD}, -1, 0, 'Configuration', '' FROM typ WHERE idx = 0 AND k % 30 = 9
  UNION ALL SELECT repo, {TYPE_ORD}, 1, 0, 'GetMapping', '/{{id}}' FROM typ WHERE idx = 0 AND k % 20 = 0
  UNION ALL SELECT repo, {TYPE_ORD}, 1, 0, 'PostMapping', 'path={{id}}|consumes=json' FROM typ WHERE idx = 0 AND k % 20 = 10)"""
ORACLES["annotations"] = _with(*CORPUS, ANNOT) + """
SELECT repo, type_ord, CAST(mo AS BIGINT) AS method_ord, CAST(pos AS BIGINT) AS pos, name, arguments FROM ann"""

ORACLES["block_end"] = _with(
    FILES,
    LN,
    f"""decl AS (
  SELECT repo, file_path, k, len(l) AS n, {_pos('public class C<k> {')} AS sl, CAST(list_position(l, '}}') AS BIGINT) AS el FROM ln
  UNION ALL SELECT repo, file_path, k, len(l), {_pos(A_LINE)}, {_end_after(A_LINE)} FROM ln
  UNION ALL SELECT repo, file_path, k, len(l), {_pos('    void methodB() {')}, {_end_after('    void methodB() {')} FROM ln
  UNION ALL SELECT repo, file_path, k, len(l), {_pos('    static class Inner<k> {')}, {_pos('    static class Inner<k> {')} + 2 FROM ln WHERE {INNER})""",
) + "SELECT repo, file_path, sl AS start_line, CAST(coalesce(el, n) AS BIGINT) AS end_line FROM decl"

_DOC = r"""nullif(trim(regexp_replace(regexp_extract(d, '(?s)^/\*\*(.*)\*/$', 1), '(?m)^\s*\*\s?', '', 'g'), ' ' || chr(10)), '')"""
DOCS = f"""pre AS (
  SELECT repo, {TYPE_ORD} AS type_ord, -1 AS mo, substr(source, 1, strpos(source,
    kind || ' ' || class_name || ' {{') - 1) AS head FROM typ
  UNION ALL
  SELECT repo, type_ord, mo, substr(source, 1, strpos(source, core) - 1) FROM mth),
doc AS (
  SELECT repo, type_ord, mo, CASE WHEN d IS NOT NULL AND length(trim(string_split(head, '*/')[-1], ' ' || chr(10))) <= 200
    THEN {_DOC} END AS javadoc
  FROM (SELECT *, regexp_extract_all(head, '(?s)/\\*\\*.*?\\*/')[-1] AS d FROM pre))"""
ORACLES["doc_comment"] = _with(*CORPUS, METHODS, DOCS) + """
SELECT repo, type_ord, CAST(mo AS BIGINT) AS method_ord, javadoc FROM doc"""

ORACLES["type_role"] = _with(*CORPUS) + f"""
SELECT repo, {TYPE_ORD} AS type_ord, class_name, {CLASS_TYPE} AS class_type FROM typ"""

ORACLES["rest_routes"] = _with(*CORPUS, ROUTES) + "SELECT repo, type_ord, class_name, http_method, path FROM rts"

ORACLES["file_errors"] = _with(FILES) + """
SELECT repo, file_ord, file_path || ': block not closed' AS error FROM files WHERE k % 50 = 49"""

# --- metrics and scans -------------------------------------------------------

ORACLES["method_loc"] = _with(*CORPUS_M) + "SELECT repo, type_ord, CAST(mo AS BIGINT) AS method_ord, loc FROM met"
ORACLES["method_cyclomatic"] = _with(*CORPUS_M) + """
SELECT repo, type_ord, CAST(mo AS BIGINT) AS method_ord, signature, CAST(cyc AS BIGINT) AS cyclomatic FROM met"""
ORACLES["method_high_complexity"] = _with(*CORPUS_M) + """
SELECT repo, type_ord, CAST(mo AS BIGINT) AS method_ord, hi AS high_complexity FROM met"""

_W = r"[\pL\pM\pN_]"
ORACLES["scan_secrets"] = rf"""
WITH ln AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
hit AS (SELECT doc_id, source, n, unnest(regexp_extract_all(t, '(?i){_W}*(?:password|secret|apikey|api_key|token|credential){_W}*\s*=\s*"[^"]*"')) AS m FROM ln
        WHERE contains(t, '"'))
SELECT doc_id, source, 'high' AS severity,
  'Hardcoded credential-like value in field ''' || regexp_extract(m, '^{_W}+') || '''.' AS message, CAST(n AS BIGINT) AS line
FROM hit WHERE NOT regexp_matches(regexp_extract(m, '"([^"]*)"', 1), '(?i)^\s*(|changeme|xxx+|todo|placeholder|\$\{{.*\}})\s*$')"""

ORACLES["scan_sql_concat"] = _with(FILES, LN) + f"""
SELECT repo, file_path, 'medium' AS severity, {_pos('        String sql = "SELECT * FROM t WHERE id = " + id;')} AS line FROM ln WHERE k % 5 = 0"""
ORACLES["scan_empty_catch"] = _with(FILES, LN) + f"""
SELECT repo, file_path, 'low' AS severity, {_pos('        try { run(); } catch (Exception e) { // ignored')} AS line FROM ln WHERE k % 11 = 0"""

ORACLES["match_lines"] = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, CAST(len(list_filter(l[:-2], lambda x: ends_with(x, '.'))) AS BIGINT) AS matches,
  CAST(coalesce(list_sum(list_filter(list_transform(l[:-2], lambda x, i: CASE WHEN ends_with(x, '.') THEN i ELSE 0 END), lambda v: v > 0)), 0) AS BIGINT) AS line_sum
FROM d"""

_FO = "CAST(row_number() OVER (PARTITION BY type_ord ORDER BY r) - 1 AS BIGINT)"
ORACLES["findings_all"] = _with(*CORPUS, FINDINGS) + f"""
SELECT repo, type_ord, class_name, {_FO} AS finding_ord, category, severity, message, line FROM find"""
ORACLES["findings_total"] = _with(*CORPUS, FINDINGS) + "SELECT repo, severity, count(*) AS findings FROM find GROUP BY 1, 2"

# --- graph, churn ------------------------------------------------------------

GRAPH = (ACME, LN, GOOD, TYPES, IMPORTS, EDGES)
ORACLES["dep_edges"] = _with(*GRAPH) + "SELECT repo, from_ord, from_class, to_class FROM edges"
ORACLES["dep_lists"] = _with(*GRAPH) + """
SELECT repo, from_class AS class_name, string_agg(to_class, ',' ORDER BY to_class) AS depends_on FROM edges GROUP BY 1, 2"""
FAN_IN = """fan AS (SELECT * FROM (SELECT repo, class_name, fan_in, row_number() OVER (PARTITION BY repo ORDER BY fan_in DESC, class_name) AS rank
  FROM (SELECT e.repo, e.to_class AS class_name, count(*) AS fan_in FROM edges e JOIN typ t ON t.repo = e.repo AND t.class_name = e.from_class
        GROUP BY 1, 2)) WHERE rank <= 6)"""
ORACLES["dep_fan_in"] = _with(*GRAPH, FAN_IN) + "SELECT * FROM fan"
ORACLES["churn_by_file"] = _with(FILES, COMMITS, CHURN) + "SELECT * FROM churn"
ORACLES["hotspots"] = _with(*CORPUS_M, COMMITS, CHURN, HEAVY, HOT) + """
SELECT repo, rank, class_name, file_path, commit_count, heavy_methods, score FROM hot"""

# --- batching ----------------------------------------------------------------

_ANN_TEXT = """coalesce((SELECT string_agg('@' || a.name || '(' || replace(a.arguments, '|', ', ') || ') ', '' ORDER BY a.pos)
  FROM ann a WHERE a.type_ord = x.type_ord AND a.mo = x.mo), '')"""
ORACLES["render_prompt"] = _with(
    *CORPUS_M,
    DOCS,
    ANNOT,
    f"""piece AS (SELECT x.type_ord, x.mo, coalesce(chr(10) || '    /** ' || d.javadoc || ' */', '') || chr(10) || '    ' || {_ANN_TEXT}
  || x.signature || ';  // loc=' || x.loc || ', cyclomatic~=' || x.cyc || CASE WHEN x.hi THEN ' [HIGH COMPLEXITY]' ELSE '' END AS p
  FROM met x LEFT JOIN doc d ON d.type_ord = x.type_ord AND d.mo = x.mo)""",
    f"x AS (SELECT *, {TYPE_ORD} AS type_ord, -1 AS mo FROM typ)",
) + f"""
SELECT x.repo, x.type_ord, coalesce('/** ' || d.javadoc || ' */' || chr(10), '') || {_ANN_TEXT} || 'class ' || class_name
  || ' (package: ' || {PACKAGE} || ', type: ' || {CLASS_TYPE} || ', file: ' || file_path || ') {{'
  || coalesce((SELECT string_agg(p, '' ORDER BY piece.mo) FROM piece WHERE piece.type_ord = x.type_ord), '') || chr(10) || '}}' AS text
FROM x LEFT JOIN doc d ON d.type_ord = x.type_ord AND d.mo = -1"""

ORACLES["token_estimate"] = "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents"
ORACLES["batch_groups"] = _with(FILES) + """
SELECT repo, regexp_replace(file_path, '/[^/]*$', '') AS dir, count(*) AS files, min(file_ord) AS first_file FROM files GROUP BY 1, 2"""

# The sequential walk, one step per row of every directory.
WALK = """item AS (SELECT source AS dir, doc_id, greatest(1, length(text) // 4) AS cost,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
walk AS (
  SELECT dir, n, doc_id, cost, cost > 4000 AS oversized, 0 AS batch_no, doc_id AS batch_ord,
         CASE WHEN cost > 4000 THEN 0 ELSE 1 END AS len, CASE WHEN cost > 4000 THEN 0 ELSE cost END AS total FROM item WHERE n = 1
  UNION ALL
  SELECT i.dir, i.n, i.doc_id, i.cost, i.cost > 4000,
    w.batch_no + CASE WHEN i.cost > 4000 OR w.len = 0 OR w.len >= 6 OR w.total + i.cost > 4000 THEN 1 ELSE 0 END,
    CASE WHEN i.cost > 4000 OR w.len = 0 OR w.len >= 6 OR w.total + i.cost > 4000 THEN i.doc_id ELSE w.batch_ord END,
    CASE WHEN i.cost > 4000 THEN 0 WHEN w.len = 0 OR w.len >= 6 OR w.total + i.cost > 4000 THEN 1 ELSE w.len + 1 END,
    CASE WHEN i.cost > 4000 THEN 0 WHEN w.len = 0 OR w.len >= 6 OR w.total + i.cost > 4000 THEN i.cost ELSE w.total + i.cost END
  FROM walk w JOIN item i ON i.dir = w.dir AND i.n = w.n + 1)"""
ORACLES["greedy_batches"] = _with(WALK) + """
SELECT 'docs' AS repo, dir, doc_id, batch_ord, CAST(batch_no AS BIGINT) AS batch_no, oversized FROM walk"""

# head 'doc {' and tail chr(10) || '}' are 7 characters; a piece is a line and its newline
ORACLES["oversized_split"] = _with(
    """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS n
  FROM documents WHERE greatest(1, (length(text) + 8) // 4) > 500)""",
    """walk AS (
  SELECT doc_id, n, 0 AS part, length(t) + 1 AS len, length(t) + 1 AS piece FROM lines WHERE n = 1
  UNION ALL
  SELECT l.doc_id, l.n, w.part + CASE WHEN greatest(1, (7 + w.len + length(l.t) + 1) // 4) > 500 THEN 1 ELSE 0 END,
    CASE WHEN greatest(1, (7 + w.len + length(l.t) + 1) // 4) > 500 THEN length(l.t) + 1 ELSE w.len + length(l.t) + 1 END, length(l.t) + 1
  FROM walk w JOIN lines l ON l.doc_id = w.doc_id AND l.n = w.n + 1)""",
) + """
SELECT doc_id, CAST(part AS BIGINT) AS part, CAST(min(n) - 1 AS BIGINT) AS first_piece, count(*) AS n_pieces,
  CAST(7 + sum(piece) AS BIGINT) AS chars FROM walk GROUP BY 1, 2"""

ORACLES["batch_prompts"] = _with(WALK) + """
SELECT w.dir, batch_ord, count(*) AS members,
  CAST(length(string_agg(text, chr(10) || chr(10) ORDER BY w.doc_id)) AS BIGINT) AS chars,
  md5(string_agg(text, chr(10) || chr(10) ORDER BY w.doc_id)) AS digest
FROM walk w JOIN documents d USING (doc_id) WHERE NOT oversized GROUP BY 1, 2"""

# --- result reuse ------------------------------------------------------------

STORE = "store AS (SELECT cache_key, 'D' || min(doc_id) AS stored_name FROM keyed WHERE doc_id % 3 = 0 GROUP BY 1)"
ORACLES["cache_keys"] = _with(KEYED) + "SELECT doc_id, cache_key FROM keyed"
ORACLES["cache_hits"] = _with(KEYED, STORE) + "SELECT doc_id, cache_key, stored_name FROM keyed JOIN store USING (cache_key)"
ORACLES["cache_misses"] = _with(KEYED, STORE) + "SELECT doc_id, cache_key FROM keyed ANTI JOIN store USING (cache_key)"
ORACLES["cache_stats"] = _with(KEYED, STORE) + """
SELECT repo, count(stored_name) AS hits, count(*) - count(stored_name) AS misses FROM keyed LEFT JOIN store USING (cache_key) GROUP BY 1"""
ORACLES["cache_admit"] = "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 1"

# --- enrichment --------------------------------------------------------------

ORACLES["enrich_batches"] = """
SELECT doc_id, CASE WHEN length(text) % 7 <> 0 THEN length(text) // 4 END AS input_tokens,
  CAST(CASE WHEN length(text) % 7 = 0 THEN NULL WHEN length(text) % 5 = 0 THEN 2 ELSE 10 END AS BIGINT) AS output_tokens,
  (length(text) % 7 <> 0 AND length(text) % 5 <> 0 AND length(text) % 3 = 0) AS repaired,
  CASE WHEN length(text) % 7 <> 0 AND length(text) % 5 <> 0 THEN length(text) || ' characters' END AS description FROM documents"""
ORACLES["enrich_failures"] = """
SELECT doc_id, CASE WHEN length(text) % 7 = 0 THEN 'call failed: service unavailable' ELSE 'response failed schema validation' END AS error
FROM documents WHERE length(text) % 7 = 0 OR length(text) % 5 = 0"""
ORACLES["json_repair"] = """
SELECT event_id, v < 4 AS valid, CASE WHEN v < 4 THEN v > 0 END AS repaired, CASE WHEN v < 4 THEN 'see ' || props END AS description,
  CASE WHEN v < 4 THEN 'void m' || event_id || '()' END AS methods, CASE WHEN v < 4 THEN event_type || '|[x' END AS aspects
FROM (SELECT *, event_id % 6 AS v FROM events)"""
ORACLES["enrich_match"] = _with(WALK) + """
SELECT max(doc_id) AS type_ord, dir || '/' || max(doc_id) AS file_path, 'T' || (doc_id % 4) AS class_name,
  'T' || (doc_id % 4) || ' of ' || batch_ord AS description, doc_id % 4 AS pos
FROM walk WHERE NOT oversized AND doc_id % 4 < 3 GROUP BY dir, batch_ord, doc_id % 4"""

_LORD = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
ORACLES["fragment_merge"] = _with(
    f"f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LORD}) AS n, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem)",
    "a AS (SELECT l_orderkey, c, n * 3 + p AS spot, [l_returnflag, l_linestatus, l_returnflag][p] AS aspect FROM f, (VALUES (1), (2), (3)) AS v(p))",
    "u AS (SELECT l_orderkey, aspect, min(spot) AS spot FROM a GROUP BY 1, 2, CASE WHEN c = 1 THEN spot END)",
) + """
SELECT l_orderkey, 'part ' || arg_min(l_partkey, n) AS description, count(*) AS fragments, count(*) AS methods,
  (SELECT string_agg(aspect, ',' ORDER BY spot) FROM u WHERE u.l_orderkey = f.l_orderkey) AS aspects FROM f GROUP BY l_orderkey"""

ORACLES["overview_input"] = _with(
    SIDE,
    "t AS (SELECT 'R' || (p_partkey % 25) AS repo, p_partkey AS k, lower(p_type) AS ct FROM part)",
    f"rd AS ({_excerpt(README, 4000)})",
    f"bd AS ({_excerpt(BUILD, 3000)})",
    """parts AS (
  SELECT r.repo, -1 AS part, 'README:' || chr(10) || coalesce(rd.excerpt, '(none found)') || chr(10) || chr(10)
    || 'Build file (dependencies):' || chr(10) || coalesce(bd.excerpt, '(none found)') || chr(10) || chr(10) || 'Class purposes:' || chr(10) AS text
  FROM (SELECT DISTINCT repo FROM t) r LEFT JOIN rd USING (repo) LEFT JOIN bd USING (repo)
  UNION ALL
  SELECT repo, k // 1000, string_agg('- C' || k || ' (' || ct || '): about ' || k, chr(10) ORDER BY k) FROM t WHERE k % 3 <> 0 GROUP BY 1, 2)""",
) + "SELECT repo, CAST(part AS BIGINT) AS part, CAST(length(text) AS BIGINT) AS chars, md5(text) AS digest FROM parts"

ORACLES["overview_fallback"] = """
SELECT c_name AS repo, CASE WHEN c_custkey % 2 = 0 THEN 'P' || c_custkey ELSE c_name END AS name,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'Overview generation failed -- see run logs for details.' END AS description,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ',java' ELSE '' END AS tech_stack,
  CASE WHEN c_custkey % 2 = 0 THEN 'layers' ELSE '' END AS architecture_summary,
  CASE WHEN c_custkey % 2 = 0 THEN 'core' ELSE '' END AS main_modules FROM customer"""

USAGE = """us AS (SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' WHEN 2 THEN 'large' ELSE 'unlisted' END AS model,
  sum(length(text) // 4) FILTER (WHERE role <> 'assistant') AS i, coalesce(sum(length(text) // 4) FILTER (WHERE role = 'assistant'), 0) AS o
  FROM conversations GROUP BY 1)"""
ORACLES["usage_totals"] = _with(USAGE) + """
SELECT model, count(*) AS calls_made, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens FROM us WHERE i IS NOT NULL GROUP BY 1"""
ORACLES["usage_cost"] = _with(USAGE) + """
SELECT model, round(CAST(sum(i) AS DOUBLE) / 1000000 * CASE model WHEN 'medium' THEN 3.0 WHEN 'large' THEN 5.0 ELSE 1.0 END
  + CAST(sum(o) AS DOUBLE) / 1000000 * CASE model WHEN 'medium' THEN 15.0 WHEN 'large' THEN 25.0 ELSE 5.0 END, 6) AS cost_usd
FROM us WHERE i IS NOT NULL GROUP BY 1"""

# --- assembly ----------------------------------------------------------------

ORACLES["assemble_methods"] = _with(*CORPUS_M) + """
SELECT repo, type_ord, CAST(mo AS BIGINT) AS method_ord, signature,
  CASE WHEN mo <> 1 THEN 'Does ' || name ELSE 'Description unavailable.' END AS description,
  CASE WHEN mo <> 2 THEN loc ELSE 0 END AS loc, CAST(CASE WHEN mo <> 2 THEN cyc ELSE 0 END AS BIGINT) AS cyclomatic,
  CASE WHEN mo <> 2 THEN hi ELSE false END AS high_complexity FROM met"""

RUN = (*CORPUS_M, IMPORTS, EDGES, COMMITS, CHURN, FINDINGS, ROUTES, ASP, HEAVY)
ORACLES["assemble_types"] = _with(*RUN, f"t AS (SELECT *, {TYPE_ORD} AS tord FROM typ)") + f"""
SELECT t.repo, tord AS type_ord, t.class_name, {CLASS_TYPE} AS class_type,
  CASE WHEN idx % 4 <> 1 THEN 'Purpose of ' || t.class_name ELSE 'Description unavailable.' END AS description,
  coalesce(h.n, 0) AS methods,
  coalesce((SELECT r.http_method || ' ' || r.path FROM rts r WHERE r.type_ord = tord), '') AS routes,
  coalesce((SELECT string_agg(aspect, ';' ORDER BY seen) FROM asp a WHERE a.type_ord = tord), '') AS aspects,
  coalesce((SELECT string_agg(category, ',' ORDER BY r) FROM find f WHERE f.type_ord = tord), '') AS findings,
  coalesce((SELECT string_agg(to_class, ',' ORDER BY to_class) FROM edges e WHERE e.repo = t.repo AND e.from_class = t.class_name), '') AS depends_on,
  c.commit_count, c.last_modified
FROM t LEFT JOIN heavy h ON h.type_ord = tord LEFT JOIN churn c ON c.repo = t.repo AND c.file_path = t.file_path"""

META = f"""meta AS (
  SELECT r.repo, '2026-01-01T00:00:00+00:00' AS generated_at, 'small' AS model_used,
    r.n - r.bad AS total_files_parsed, r.bad AS parse_errors, coalesce(t.n, 0) AS calls_made, coalesce(t.hits, 0) AS calls_cached,
    coalesce(CAST(t.i AS BIGINT), 0) AS total_input_tokens, coalesce(CAST(t.o AS BIGINT), 0) AS total_output_tokens,
    coalesce(CAST(t.i AS DOUBLE) / 1000000 + CAST(t.o AS DOUBLE) / 1000000 * 5.0, 0) AS estimated_cost_usd,
    coalesce(f.n, 0) AS security_findings_total, coalesce(t.n, 0) AS types
  FROM (SELECT repo, count(*) AS n, count(*) FILTER (WHERE k % 50 = 49) AS bad FROM files GROUP BY 1) r
  LEFT JOIN (SELECT repo, count(*) AS n, count(*) FILTER (WHERE idx % 4 = 0) AS hits, sum(sl) AS i, sum(el) AS o FROM typ GROUP BY 1) t USING (repo)
  LEFT JOIN (SELECT repo, count(*) AS n FROM find GROUP BY 1) f USING (repo))"""
ORACLES["run_metadata"] = _with(*RUN, META) + "SELECT * EXCLUDE (types) REPLACE (round(estimated_cost_usd, 6) AS estimated_cost_usd) FROM meta"

ORACLES["analysis_doc"] = _with(*RUN, META, HOT) + f"""
SELECT repo, 'head' AS section, CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS sub, CAST(1 AS BIGINT) AS items, NULL AS payload FROM meta
UNION ALL SELECT repo, 'classes', k // 500, 0, count(*), NULL FROM typ GROUP BY 1, 3
UNION ALL SELECT repo, 'dependency_graph', (from_ord // 268435456) // 500, 0, count(*),
  '[' || string_agg('{{"from_class":"' || from_class || '","to_class":"' || to_class || '"}}', ',' ORDER BY from_ord, to_class) || ']' FROM edges GROUP BY 1, 3
UNION ALL SELECT repo, 'hotspots', 0, 0, count(*), '[' || string_agg('"' || class_name || '"', ',' ORDER BY rank) || ']' FROM hot GROUP BY 1
UNION ALL SELECT repo, 'parse_errors', k // 500, 0, count(*),
  '[' || string_agg('{{"error":"' || file_path || ': block not closed"}}', ',' ORDER BY k) || ']' FROM files WHERE k % 50 = 49 GROUP BY 1, 3"""

ORACLES["analysis_json"] = _with(*CORPUS, COMMITS, CHURN) + f"""
SELECT t.repo, {TYPE_ORD} AS type_ord, '{{"file_path":"' || file_path || '","package":"' || {PACKAGE} || '","class_name":"' || class_name
  || '","class_type":"' || {CLASS_TYPE} || '","span":{{"start_line":' || sl || ',"end_line":' || el || '}},"churn":'
  || coalesce('{{"commit_count":' || commit_count || ',"last_modified":"' || last_modified || '"}}', 'null') || '}}' AS document
FROM typ t LEFT JOIN churn USING (repo, file_path)"""

ORACLES["run_summary"] = _with(*RUN, META) + """
SELECT repo, 'Done: ' || total_files_parsed || ' file(s) parsed (' || parse_errors || ' parse error(s)), ' || types || ' class(es) analyzed, '
  || calls_made || ' LLM call(s) made / ' || calls_cached || ' served from cache, ' || total_input_tokens || ' input + ' || total_output_tokens
  || ' output tokens, ~$' || printf('%.4f', estimated_cost_usd) || ' estimated cost' AS summary FROM meta"""

# --- report roll-ups ---------------------------------------------------------

ORACLES["module_groups"] = _with(FILES, PAGES, "u AS (SELECT repo, file_path FROM files UNION ALL SELECT repo, file_path FROM pth)") + """
SELECT repo, CASE WHEN len(string_split(file_path, '/')) > 0 AND list_contains(string_split(file_path, '/'), 'services')
    THEN coalesce(string_split(file_path, '/')[list_position(string_split(file_path, '/'), 'services') + 1], 'root')
    WHEN len(string_split(file_path, '/')) > 1 THEN string_split(file_path, '/')[-2] ELSE 'root' END AS module, count(*) AS types
FROM u GROUP BY 1, 2"""

PART_ASPECTS = f"pa AS (SELECT p_brand AS repo, p_partkey AS id, p_name || ' ' || ({ASPECTS})[(p_partkey % 11) + 1] AS aspect FROM part)"
ORACLES["aspect_category"] = _with(PART_ASPECTS) + f"""
SELECT 'document' AS kind, doc_id AS id, {_category('text')} AS category FROM documents
UNION ALL SELECT 'part', id, {_category('aspect')} FROM pa"""
ORACLES["aspect_rollup"] = _with(PART_ASPECTS) + f"""
SELECT repo, {_category('aspect')} AS category, count(*) AS aspects, min(id) AS first_seen FROM pa GROUP BY 1, 2"""
ORACLES["severity_rollup"] = _with(*CORPUS, FINDINGS) + """
SELECT repo, severity, CAST(CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS BIGINT) AS severity_rank, count(*) AS findings
FROM find GROUP BY 1, 2"""
_HEAVY_TEXT = "'High-complexity method ' || signature || ' (cyclomatic~=' || cyc || ', loc=' || loc || ')'"
ORACLES["complex_methods"] = _with(*CORPUS_M) + f"""
SELECT repo, type_ord, CAST(mo AS BIGINT) AS method_ord, {_HEAVY_TEXT} AS text FROM met WHERE hi"""
_HOT_TEXT = "commit_count || ' commit(s) · last modified ' || last_modified || ' · ' || heavy_methods || ' high-complexity method(s)'"
ORACLES["hotspot_detail"] = _with(*CORPUS_M, COMMITS, CHURN, HEAVY, HOT) + f"""
SELECT repo, rank, class_name, file_path, {_HOT_TEXT} AS text FROM hot"""
_FAN_TEXT = "'Depended on by ' || fan_in || CASE WHEN fan_in = 1 THEN ' other class' ELSE ' other classes' END"
ORACLES["relied_upon_detail"] = _with(*GRAPH, FAN_IN) + f"""
SELECT fan.repo, rank, fan.class_name, file_path, {_FAN_TEXT} AS text FROM fan JOIN typ USING (repo, class_name)"""
_FIND_TEXT = "message || ' (line ' || line || ')'"
ORACLES["findings_overview"] = _with(
    *RUN, HOT, FAN_IN,
    f"""cat AS (SELECT *, {_category('aspect')} AS category FROM asp)""",
    """size AS (SELECT repo, category, row_number() OVER (PARTITION BY repo ORDER BY n DESC, t, s) AS g FROM (
  SELECT repo, category, count(*) AS n, min(type_ord) AS t, arg_min(seen, (type_ord, seen)) AS s FROM cat GROUP BY 1, 2))""",
) + f"""
SELECT f.repo, CAST(0 AS BIGINT) AS category_rank, '{CATEGORIES[0]}' AS category,
  CAST(CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS BIGINT) AS group_rank, upper(severity[1]) || severity[2:] AS subcategory,
  f.type_ord, {_FO} AS item_ord, f.class_name, t.file_path, {_FIND_TEXT} AS text FROM find f JOIN typ t USING (repo, class_name)
UNION ALL SELECT repo, 1, '{CATEGORIES[1]}', 0, '', 0, rank, class_name, file_path, {_HOT_TEXT} FROM hot
UNION ALL SELECT repo, 2, '{CATEGORIES[2]}', 0, '', 0, rank, class_name, file_path, {_FAN_TEXT} FROM fan JOIN typ USING (repo, class_name)
UNION ALL SELECT m.repo, 3, '{CATEGORIES[3]}', 0, '', m.type_ord, mo, m.class_name, t.file_path, {_HEAVY_TEXT}
  FROM met m JOIN typ t USING (repo, class_name) WHERE hi
UNION ALL SELECT repo, 4, '{CATEGORIES[4]}', g, category, type_ord, seen, class_name, file_path, aspect FROM cat JOIN size USING (repo, category)"""
ORACLES["dashboard_totals"] = _with(*RUN, META) + """
SELECT m.repo, m.types, CAST(coalesce((SELECT count(*) FROM met x WHERE x.repo = m.repo), 0) AS BIGINT) AS methods,
  CAST(coalesce((SELECT count(*) FROM rts x WHERE x.repo = m.repo), 0) AS BIGINT) AS endpoints,
  CAST(coalesce((SELECT count(*) FROM met x WHERE x.repo = m.repo AND hi), 0) AS BIGINT) AS high_complexity, security_findings_total AS findings,
  CASE WHEN calls_made + calls_cached > 0 THEN round_even(100.0 * calls_cached / (calls_made + calls_cached), 1) ELSE 0.0 END AS hit_rate_pct FROM meta m"""
ORACLES["generated_at_text"] = """
SELECT event_id, strftime(ts, '%B %d, %Y at %I:%M %p UTC') AS generated_at FROM events"""
ORACLES["endpoint_preview"] = _with(
    f"""r AS (SELECT l_orderkey, l_returnflag, CASE WHEN l_linestatus = 'O' THEN 'GET' ELSE 'POST' END || ' /p' || l_partkey || '/' || l_returnflag AS route,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LORD}) AS n FROM lineitem)""",
    """g AS (SELECT l_orderkey, string_agg(route, ', ' ORDER BY n) FILTER (WHERE n <= 4) AS routes, count(*) AS c,
  count(*) FILTER (WHERE l_returnflag = 'R') AS a FROM r GROUP BY 1)""",
) + """
SELECT o_orderkey AS type_ord, 'O' || o_orderkey AS class_name, coalesce(routes, '') AS routes,
  CASE WHEN c > 4 THEN '+' || (c - 4) || ' more' ELSE '' END AS more,
  coalesce(c, 0) || CASE WHEN c = 1 THEN ' method' ELSE ' methods' END || CASE WHEN a > 0 THEN ' · ' || a || ' notable' ELSE '' END AS footer
FROM orders LEFT JOIN g ON l_orderkey = o_orderkey"""
ORACLES["html_safe_text"] = """
SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'), '''', '&#39;') AS html FROM pages"""
ORACLES["job_summary"] = _with(*RUN, META) + """
SELECT repo, CAST(0 AS BIGINT) AS metric_ord, 'Files parsed' AS metric, CAST(total_files_parsed AS VARCHAR) AS value FROM meta
UNION ALL SELECT repo, 1, 'Parse errors', CAST(parse_errors AS VARCHAR) FROM meta
UNION ALL SELECT repo, 2, 'LLM calls made', CAST(calls_made AS VARCHAR) FROM meta
UNION ALL SELECT repo, 3, 'Served from cache', CAST(calls_cached AS VARCHAR) FROM meta
UNION ALL SELECT repo, 4, 'Tokens (in / out)', total_input_tokens || ' / ' || total_output_tokens FROM meta
UNION ALL SELECT repo, 5, 'Estimated cost', '$' || printf('%.4f', estimated_cost_usd) FROM meta"""
