"""Queries over commit history."""

from __future__ import annotations

from pyspark.sql import functions as F

from codecorpus.operators import history as h
from codecorpus.plans.registry import query
from codecorpus.sources.tables import parse_commits

_LINES = ("SELECT CASE WHEN o_orderkey % 7 = 0 THEN concat('noise ', o_orderkey) ELSE concat(md5(CAST(o_orderkey AS STRING)), '|dev', o_custkey % 40, '|2024-0', "
          "1 + o_orderkey % 9, '-1', o_orderkey % 10, ' 10:20:30 +0', o_orderkey % 3, '00|Fix ', o_orderpriority, CASE WHEN o_orderkey % 5 = 0 THEN ' | more' ELSE '' END) END AS value FROM orders")


@query("s4_parse_commits", oracle=f"""
SELECT split_part(value, '|', 1) AS hash, split_part(value, '|', 2) AS author, epoch(CAST(split_part(value, '|', 3)[1:19] AS TIMESTAMP)) - 3600 * CAST(split_part(value, '|', 3)[23:23] AS INT) AS committed_s,
  array_to_string(list_slice(string_split(value, '|'), 4, 99), '|') AS message FROM ({_LINES}) WHERE len(string_split(value, '|')) >= 4""")
def _s4(t):
    out = parse_commits(t.sql(_LINES, "orders"))
    return out.select("hash", "author", F.unix_seconds("committed_at").cast("double").alias("committed_s"), "message")


_RECENT = """
r AS (SELECT path, hash, committed_at, rn FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY committed_at DESC, hash) AS rn
  FROM (SELECT DISTINCT path, hash FROM changes) JOIN commits USING (hash)) WHERE rn <= 10),
v AS (SELECT path, hash, language, content, committed_at FROM file_versions JOIN r USING (path, hash)),
l AS (SELECT path, hash, language, committed_at, unnest(string_split(content, chr(10))) AS s, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM v)
"""
_PY, _JA = r"'^\s*(def|async def)\s+(\w+)\s*\(([^)]*)\)\s*:'", r"'^\s*(public|private|protected)?\s*(static)?\s*(\w+)\s+(\w+)\s*\(([^)]*)\)'"
_JS = [r"'^\s*function\s+(\w+)\s*\(([^)]*)\)'", r"'^\s*const\s+(\w+)\s*=\s*\(([^)]*)\)\s*=>'"]


def _g(p: str, k: int) -> str:
    return f"regexp_extract(s, {p}, {k})"


_FUNCTIONS = "f AS (" + " UNION ALL ".join(
    [f"SELECT path, language, committed_at, hash, i, {_g(_PY, 2)} AS name, {_g(_PY, 1)} || ' ' || {_g(_PY, 2)} || '(' || {_g(_PY, 3)} || ')' AS signature FROM l WHERE language = 'python' AND regexp_matches(s, {_PY})"]
    + [f"SELECT path, language, committed_at, hash, i, {_g(p, 1)}, 'function ' || {_g(p, 1)} || '(' || {_g(p, 2)} || ')' FROM l WHERE language = 'javascript' AND regexp_matches(s, {p})" for p in _JS]
    + [f"SELECT path, language, committed_at, hash, i, {_g(_JA, 4)}, coalesce(nullif({_g(_JA, 1)}, ''), 'package') || ' ' || {_g(_JA, 2)} || ' ' || {_g(_JA, 3)} || ' ' || {_g(_JA, 4)} || '(' || {_g(_JA, 5)} || ')' FROM l WHERE language = 'java' AND regexp_matches(s, {_JA})"]) + ")"


@query("h1_function_evolution", "commits", "changes", "file_versions", oracle=f"""
WITH {_RECENT}, {_FUNCTIONS}
SELECT path, name, count(*) AS versions, string_agg(signature, ';' ORDER BY committed_at DESC, hash DESC, i DESC, signature DESC) AS signatures FROM f GROUP BY path, name HAVING count(*) > 1 AND count(DISTINCT signature) > 1""")
def _h1(t):
    functions = h.version_functions(t.commits, t.changes, t.file_versions)
    return h.function_evolution(functions).select("path", "name", "versions", F.array_join("signatures", ";").alias("signatures"))


@query("h2_naming_convention", "commits", "changes", "file_versions", oracle=f"""
WITH {_RECENT}, {_FUNCTIONS},
n AS (SELECT language, name, count(*) AS k, CASE WHEN contains(name, '_') AND name = lower(name) THEN 'snake' WHEN NOT contains(name, '_') AND substr(name, 2) <> lower(substr(name, 2)) THEN 'camel' ELSE 'other' END AS style,
  CASE WHEN contains(name, '_') THEN 'snake' ELSE 'camel' END AS shape FROM f GROUP BY 1, 2),
c AS (SELECT language, sum(k) AS total, coalesce(sum(k) FILTER (style = 'snake'), 0) AS snake, coalesce(sum(k) FILTER (style = 'camel'), 0) AS camel FROM n GROUP BY 1),
p AS (SELECT *, CASE WHEN snake > camel * 2 THEN 'snake' WHEN camel > snake * 2 THEN 'camel' END AS style FROM c WHERE total > 5),
e AS (SELECT language, shape, string_agg(name, ',' ORDER BY rn) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY language, shape ORDER BY k DESC, name) AS rn FROM n) WHERE rn <= 5 GROUP BY 1, 2)
SELECT p.language, style, CAST(total AS BIGINT) AS total, least(9e-1, CAST(CASE style WHEN 'snake' THEN snake ELSE camel END AS DOUBLE) / total) AS confidence, examples FROM p LEFT JOIN e ON e.language = p.language AND e.shape = p.style WHERE style IS NOT NULL""")
def _h2(t):
    functions = h.version_functions(t.commits, t.changes, t.file_versions)
    return h.naming_convention(functions).select("language", "style", "total", "confidence", F.array_join("examples", ",").alias("examples"))


_STYLE = "CASE WHEN contains(name, '_') AND name = lower(name) THEN 'snake' WHEN NOT contains(name, '_') AND substr(name, 2) <> lower(substr(name, 2)) THEN 'camel' ELSE 'other' END"


@query("h3_file_context", "commits", "changes", "file_versions", oracle=rf"""
WITH {_RECENT}, {_FUNCTIONS},
ev AS (SELECT path, name FROM f GROUP BY 1, 2 HAVING count(*) > 1 AND count(DISTINCT signature) > 1),
el AS (SELECT path, string_agg(name, ',' ORDER BY name) AS evolved, string_agg(concat('Consider reviewing function evolution: Function ', chr(39), name, chr(39), ' has evolved across commits'), '; ' ORDER BY name) AS notes FROM ev GROUP BY 1),
hot AS (SELECT path, count(*) AS recent_changes FROM r WHERE rn <= 5 GROUP BY 1 HAVING count(*) > 3),
p AS (SELECT path, lower(regexp_extract(path, '\.[^./]*$')) AS ext, count(*) AS n_history FROM r GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY path) AS rk FROM p),
five AS (SELECT f.path, f.name FROM f JOIN r ON r.path = f.path AND r.hash = f.hash WHERE rn <= 5),
m AS (SELECT t.ext, k, name, {_STYLE} AS style FROM t JOIN five ON five.path = t.path, range(0, 21) g(k) WHERE rk <= 21 AND CASE WHEN k = 0 THEN rk <= 20 ELSE rk <> k END),
c AS (SELECT ext, k, count(*) AS total, count(*) FILTER (style = 'snake') AS snake, count(*) FILTER (style = 'camel') AS camel FROM m GROUP BY 1, 2),
nm AS (SELECT ext, k, CASE WHEN snake > camel * 2 THEN 'snake_case' WHEN camel > snake * 2 THEN 'camelCase' END AS label, greatest(snake, camel) * 1e0 / total AS share FROM c WHERE total > 5),
lg AS (SELECT DISTINCT path, language FROM file_versions)
SELECT t.path, lg.language, n_history, coalesce(evolved, '') AS evolved, recent_changes, concat_ws('; ', notes, CASE WHEN label IS NOT NULL AND share > 7e-1 THEN 'Follow naming convention: Use ' || label || ' for consistency' END,
  CASE WHEN recent_changes IS NOT NULL THEN 'File has been frequently modified - consider refactoring for stability' END) AS suggestions
FROM t LEFT JOIN lg ON lg.path = t.path LEFT JOIN el ON el.path = t.path LEFT JOIN hot ON hot.path = t.path LEFT JOIN nm ON nm.ext = t.ext AND nm.k = CASE WHEN rk <= 20 THEN rk ELSE 0 END""")
def _h3(t):
    out = h.file_context(t.commits, t.changes, t.file_versions)
    return out.select("path", "language", F.size("history").cast("bigint").alias("n_history"), F.array_join("evolved_functions", ",").alias("evolved"), "recent_changes", F.array_join("suggestions", "; ").alias("suggestions"))
