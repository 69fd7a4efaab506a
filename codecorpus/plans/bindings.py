"""Bindings of the given tables (documents, labels, orders, lineitem, events) to the library's schemas.

Each binding is one SQL text valid in both Spark and DuckDB, so a query and its oracle start from identical rows. Source code
is derived per document: a fixed skeleton per language, filled with identifiers and numbers from the document id and with the
whole document text as comment lines, so its volume grows with the table.
"""

from __future__ import annotations

import re

from codecorpus.functions.dims import PAIR_NAMES

SESSIONS = """
SELECT source AS session_id, concat(source, '.zip') AS original_filename,
  TIMESTAMP '2024-01-01 00:00:00' + CAST(substr(source, 4) AS INT) * INTERVAL '1' DAY AS created_at,
  CASE CAST(substr(source, 4) AS INT) % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'processing' ELSE 'completed' END AS status,
  CASE CAST(substr(source, 4) AS INT) % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'api' ELSE 'hybrid' END AS processing_mode,
  CASE CAST(substr(source, 4) AS INT) % 4 WHEN 0 THEN 'comprehensive' WHEN 1 THEN 'performance' WHEN 2 THEN 'readability'
    ELSE 'security' END AS refactor_type,
  CAST(substr(source, 4) AS INT) % 2 = 0 AS preserve_comments, CAST(substr(source, 4) AS INT) % 3 = 0 AS add_documentation,
  CAST(substr(source, 4) AS INT) % 5 = 0 AS follow_conventions,
  CAST(count(*) AS INT) AS total_files, CAST(count(*) - count(*) % 3 AS INT) AS processed_files
FROM documents GROUP BY source
"""

FILES = """
SELECT file_id, session_id,
  concat('src/', CASE file_id % 13 WHEN 0 THEN 'node_modules/' WHEN 1 THEN '.cache/' ELSE concat(lang, '/') END, 'f', file_id, ext)
    AS original_path,
  language, original_content,
  CASE WHEN status <> 'completed' THEN '' WHEN file_id % 3 = 0 THEN concat(original_content, chr(10), '// end')
    WHEN file_id % 3 = 1 THEN replace(original_content, chr(10) || chr(10), chr(10)) ELSE original_content END AS refactored_content,
  status, error_message, TIMESTAMP '2024-01-01 00:00:00' + file_id * INTERVAL '1' MINUTE AS created_at,
  complexity_score, readability_score, maintainability_score,
  CAST(floor((4 * complexity_score + 3 * readability_score + 3 * maintainability_score + 5) / 10) AS INT) AS overall_quality_score
FROM (SELECT *,
    CASE WHEN status = 'failed' THEN CASE file_id % 7 WHEN 0 THEN 'Syntax error at line 3: invalid syntax'
        WHEN 1 THEN 'Request timed out' WHEN 2 THEN 'LLM service error' WHEN 3 THEN 'Validation failed: structure'
        WHEN 4 THEN 'Rate limit reached, quota used' WHEN 5 THEN '' ELSE 'Connection refused' END
      WHEN status = 'completed' AND file_id % 4 = 0 THEN CASE file_id % 3
        WHEN 0 THEN 'Enhanced: Added docstring placeholder for run, Cleaned up excessive blank lines'
        WHEN 1 THEN 'File is empty | Enhanced: Function run could benefit from type hints'
        ELSE 'Enhanced: Simplified boolean comparison (== True) | note' END
      ELSE '' END AS error_message,
    CASE WHEN status = 'completed' AND file_id % 7 <> 0 THEN CAST(65 + (file_id * 13) % 36 AS INT) ELSE 0 END AS complexity_score,
    CASE WHEN status = 'completed' AND file_id % 7 <> 0 THEN CAST((file_id * 17) % 101 AS INT) ELSE 0 END AS readability_score,
    CASE WHEN status = 'completed' AND file_id % 7 <> 0 THEN CAST((file_id * 29) % 101 AS INT) ELSE 0 END AS maintainability_score
  FROM (SELECT d.doc_id AS file_id, d.source AS session_id, d.text AS original_content, d.lang,
      CASE d.doc_id % 10 WHEN 0 THEN 'Python' WHEN 1 THEN 'JavaScript' WHEN 2 THEN 'Java' WHEN 3 THEN 'C++' WHEN 4 THEN 'C'
        WHEN 5 THEN 'TypeScript' WHEN 6 THEN 'C/C++' WHEN 7 THEN 'HTML' WHEN 8 THEN 'JSX' ELSE 'Text' END AS language,
      CASE d.doc_id % 10 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.java' WHEN 3 THEN '.cpp' WHEN 4 THEN '.c'
        WHEN 5 THEN '.ts' WHEN 6 THEN '.h' WHEN 7 THEN '.html' WHEN 8 THEN '.jsx' ELSE '.txt' END AS ext,
      CASE WHEN d.doc_id % 10 IN (5, 7, 9) THEN 'skipped' WHEN l.quality = 0 THEN 'failed'
        WHEN l.quality IS NULL AND d.doc_id % 11 = 0 THEN 'processing' ELSE 'completed' END AS status
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) b) m
"""

SCAN = """
SELECT file_id, original_path AS relative_path, CAST(bit_length(original_content) / 8 AS INT) AS size_bytes,
  length(original_content) - length(replace(original_content, chr(10), '')) + 1 AS line_count, original_content AS content,
  CASE language WHEN 'Python' THEN 'python' WHEN 'JavaScript' THEN 'javascript' WHEN 'Java' THEN 'java' WHEN 'C++' THEN 'cpp'
    WHEN 'C' THEN 'c' WHEN 'TypeScript' THEN 'typescript' WHEN 'C/C++' THEN 'header' WHEN 'HTML' THEN 'html'
    WHEN 'JSX' THEN 'jsx' ELSE 'unknown' END AS language,
  file_id % 17 = 0 AS is_binary, CASE WHEN file_id % 5 = 0 THEN NULL ELSE CAST(complexity_score AS DOUBLE) END AS complexity_estimate
FROM files
"""

COMMITS = """
SELECT md5(CAST(o_orderkey AS STRING)) AS hash, concat('dev', o_custkey % 40) AS author, o_orderdate AS committed_at,
  concat('Change ', o_orderpriority) AS message FROM orders
"""

CHANGES = """
SELECT md5(CAST(l_orderkey AS STRING)) AS hash,
  concat('src/p', l_partkey, CASE l_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.java' ELSE '.md' END) AS path,
  CASE WHEN l_linenumber = 1 THEN 'A' WHEN l_linenumber = 6 THEN 'D' WHEN l_linenumber = 7 THEN 'C' ELSE 'M' END AS change_type
FROM lineitem
"""

LOG_EVENTS = """
SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' WHEN 'purchase' THEN 'info' ELSE 'debug' END AS level,
  CASE event_type WHEN 'error' THEN 'validation' WHEN 'signup' THEN 'file_scan' WHEN 'purchase' THEN 'llm_request' WHEN 'click' THEN 'rename' ELSE 'transformation' END AS operation_type,
  CAST(user_id AS STRING) AS session_id, concat('src/f', user_id, '.py') AS file_path, value AS duration, props,
  CAST(floor(event_id / 2) AS BIGINT) AS operation_id, CASE WHEN event_id % 14 = 0 OR event_id % 10 = 9 THEN 'lost' WHEN event_id % 2 = 0 THEN 'start' ELSE 'end' END AS phase
FROM events
"""

ERROR_EVENTS = """
SELECT event_id, ts, CASE event_id % 3 WHEN 0 THEN 'refactoring_failed' WHEN 1 THEN 'llm_processing' ELSE 'unhandled_exception' END AS error_type,
  CASE event_id % 11 WHEN 0 THEN 'Request timed out' WHEN 1 THEN 'DNS unreachable' WHEN 2 THEN 'Too many requests' WHEN 3 THEN 'Forbidden'
    WHEN 4 THEN 'Invalid syntax near def' WHEN 5 THEN 'Out of memory' WHEN 6 THEN 'File size too large' WHEN 7 THEN 'Server error 502'
    WHEN 8 THEN 'Invalid JSON body' WHEN 9 THEN 'Model overloaded' ELSE 'Unexpected' END AS message,
  CAST(user_id AS STRING) AS session_id FROM events WHERE event_type = 'error'
"""

REQUESTS = """
SELECT event_id, ts, concat('/results/', user_id % 20) AS path, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
  value / 10 AS processing_time FROM events
"""

# --- derived source code -------------------------------------------------------------------------------------------


def _fill(template: str, slots: dict[str, str]) -> str:
    """SQL for a template literal with its @slots@ replaced by SQL expressions; @q@ is a single quote."""
    out = f"'{template}'"
    for slot, sql in (slots | {"q": "chr(39)"}).items():
        if f"@{slot}@" in template:
            out = f"replace({out}, '@{slot}@', {sql})"
    return out


def _nested(template: str, depth: int, indent: int, base: int, head: str, tail: str, body: str, close: str) -> str:
    """Template with its nested conditionals written out; ``close`` is '' for indentation languages."""
    pad = [" " * (base + indent * i) for i in range(depth + 1)]
    lines = [f"{pad[i]}{head}@v@ > {i * 10}{tail}" for i in range(depth)] + [pad[depth] + body]
    lines += [pad[i] + close for i in reversed(range(depth))] if close else []
    return template.replace("@nest@", "\n".join(lines) + "\n")


_PY = """import os
from typing import List


class Handler@id@:
    def process_@v@(self, @v@, limit=@n@):
        # check @v@
@nest@        return @q@success@q@

    def Describe(self):
        @q@Describe it.@q@
        return self


def load_@v@(path, mode):
    items = []
    for row in path:
        items.append(row)
    if mode == True:
        total = @n@ * 12
    if mode != False and path is not None:
        print(path)


    try:
        value = 3600 + 7
    except:
        value = 0
    return items

@broken@
"""
_JS = """var total@id@ = @n@;
const add@v@ = (a, b) => {
  return a + b;
};
async function fetch_@v@(url) {
  return url;
}
function process@v@(@v@) {
@nest@  var label = "id " + @v@ + " end";
  let cb = function (x) { return x * 2; };
  return label;
}


class View@id@ {
}
"""
_JAVA = """import java.util.List;

public class Service@id@ {
    int count@id@;
    List<String> names = new ArrayList<String>();
    public static int process@v@(int @v@) {
@nest@        for (String name : names) { System.out.println(name); }
        return 0
    }
    private String label_@v@(String a) {
        return a;
    }
}
"""
_CPP = """#include <vector>
#define LIMIT_@id@ 100
typedef unsigned long size_@v@;
class Box@id@ {
  int get_@v@() { return 42; }
  void set_@v@(int x) { value = x; }
};
int run_@v@(char* p) {
@nest@  if (p == NULL) { return (int)p; }
  Node* node = new Node(1);
  for (int i = 0; i < items.size(); ++i) { use(i); }
  return 0;
}
"""


# language by id modulo 4: template and shape of its nested conditionals
_SKELETONS = [
    (_PY, dict(indent=4, base=8, head="if ", tail=":", body="return 1", close="")),
    (_JS, dict(indent=2, base=2, head="if (", tail=") {", body="ok();", close="}")),
    (_JAVA, dict(indent=4, base=8, head="if (", tail=") {", body="ok();", close="}")),
    (_CPP, dict(indent=2, base=2, head="if (", tail=") {", body="ok();", close="}")),
]


def code_files() -> str:
    """(file_id, session_id, language, original_path, content): one source file per document, language by id, depth 3..8."""
    cases = " ".join(
        f"WHEN {k * 10 + depth} THEN '{_nested(template, depth, **shape)}'" for k, (template, shape) in enumerate(_SKELETONS) for depth in range(3, 9)
    )
    names = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(PAIR_NAMES))
    return f"""
SELECT file_id, session_id, language, original_path, concat(replace(replace(replace(replace(replace(skeleton, '@v@', name), '@id@', CAST(file_id AS STRING)),
    '@n@', CAST(7 + file_id % 90 AS STRING)), '@broken@', broken), '@q@', chr(39)), mark, replace(body, chr(10), concat(chr(10), mark)), chr(10)) AS content
FROM (SELECT doc_id AS file_id, source AS session_id, text AS body, CASE doc_id % 16 {names} END AS name,
  CASE doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'java' ELSE 'cpp' END AS language,
  CASE doc_id % 4 WHEN 0 THEN '# ' ELSE '// ' END AS mark, CASE WHEN doc_id % 28 = 0 THEN concat('def broken(:', chr(10)) ELSE '' END AS broken,
  concat('src/', lang, '/c', doc_id, CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.java' ELSE '.cpp' END) AS original_path,
  CASE (doc_id % 4) * 10 + 3 + doc_id % 6 {cases} END AS skeleton FROM documents) c
"""


_V_PY = """def load_@v@(path@arg@):
    return path

def save_item(path):
    if path:
        return 1

"""
_V_JS = """function load@cap@(path@arg@) {
  return path;
}
const saveItem = (path) => path;
"""
_V_TEXT = """Notes on load (@v@@arg@)

Call save (item) after load (path).
"""
_V_JAVA = """class Part {
    public static int loadItem(int a@arg@) {
        return a;
    }
    private String saveItem(String b) { return b; }
}
"""


def file_versions() -> str:
    """(hash, path, language, content): the version of a file at a commit; the signature alternates with the line number."""
    slots = {"v": f"CASE l_partkey % 16 {' '.join(f'WHEN {i} THEN {chr(39)}{n}{chr(39)}' for i, n in enumerate(PAIR_NAMES))} END",
             "cap": "concat('Item', l_partkey % 5)"}
    more = slots | {"arg": "CASE WHEN l_linenumber % 2 = 0 THEN ', mode' ELSE '' END"}
    typed = slots | {"arg": "CASE WHEN l_linenumber % 2 = 0 THEN ', int mode' ELSE '' END"}
    return f"""
SELECT md5(CAST(l_orderkey AS STRING)) AS hash, l_linenumber AS change_no,
  concat('src/p', l_partkey, CASE l_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.java' ELSE '.md' END) AS path,
  CASE l_partkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'java' ELSE 'text' END AS language,
  CASE l_partkey % 4 WHEN 0 THEN {_fill(_V_PY, more)} WHEN 1 THEN {_fill(_V_JS, more)} WHEN 2 THEN {_fill(_V_JAVA, typed)} ELSE {_fill(_V_TEXT, more)} END AS content
FROM lineitem
"""


BINDINGS = {
    "sessions": (SESSIONS, ["documents"]),
    "files": (FILES, ["documents", "labels"]),
    "scan": (SCAN, ["files"]),
    "commits": (COMMITS, ["orders"]),
    "changes": (CHANGES, ["lineitem"]),
    "log_events": (LOG_EVENTS, ["events"]),
    "error_events": (ERROR_EVENTS, ["events"]),
    "requests": (REQUESTS, ["events"]),
    "code_files": (code_files(), ["documents"]),
    "file_versions": (file_versions(), ["lineitem"]),
}


def with_tables(*names: str, rest: str) -> str:
    """``WITH`` prefix for an oracle: the bindings it needs (dependencies first), then ``rest``."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in BINDINGS or name in order:
            return
        for dep in BINDINGS[name][1]:
            add(dep)
        order.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{n} AS ({BINDINGS[n][0]})" for n in order)
    if not order:
        return rest
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", rest)
    return f"WITH {own[1] or ''}{ctes},\n{rest[own.end():]}" if own else f"WITH {ctes}\n{rest}"
