"""Word lists, lookup tables and messages that decide results. All are small and of constant size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: display language -> file extensions -------------------------------------------------------------
DISPLAY_EXTENSIONS = {
    "Python": ".py .pyw .pyi .pyx",
    "JavaScript": ".js .mjs .cjs",
    "JSX": ".jsx",
    "TypeScript": ".ts .tsx",
    "Java": ".java",
    "Kotlin": ".kt .kts",
    "Scala": ".scala",
    "Clojure": ".clj .cljs .cljc",
    "C": ".c",
    "C++": ".cpp .cc .cxx .c++ .hpp .hxx .h++",
    "C/C++": ".h",
    "C#": ".cs .csx",
    "Visual Basic": ".vb",
    "F#": ".fs .fsx",
    "PHP": ".php .phtml .php3 .php4 .php5",
    "HTML": ".html .htm .xhtml",
    "CSS": ".css",
    "SCSS": ".scss",
    "Sass": ".sass",
    "Less": ".less",
    "Stylus": ".styl",
    "Ruby": ".rb .rbw",
    "Go": ".go",
    "Rust": ".rs",
    "Swift": ".swift",
    "Dart": ".dart",
    "Elm": ".elm",
    "Elixir": ".ex .exs",
    "Haskell": ".hs .lhs",
    "OCaml": ".ml .mli",
    "Pascal": ".pas .pp",
    "Perl": ".pl .pm",
    "Lua": ".lua",
    "XML": ".xml",
    "JSON": ".json .jsonc .json5",
    "YAML": ".yaml .yml",
    "TOML": ".toml",
    "INI": ".ini",
    "Configuration": ".cfg .conf .config",
    "Properties": ".properties",
    "Shell": ".sh .bash .zsh .fish .ksh .csh",
    "PowerShell": ".ps1 .psm1 .psd1",
    "Batch": ".bat .cmd",
    "SQL": ".sql .mysql .pgsql .sqlite",
    "R": ".r",
    "MATLAB": ".m",
    "Mathematica": ".nb",
    "Assembly": ".asm .s",
    "Markdown": ".md .markdown",
    "reStructuredText": ".rst",
    "LaTeX": ".tex",
    "Text": ".txt",
    "Gradle": ".gradle",
    "CMake": ".cmake",
    "Makefile": ".make .mk",
}

# --- fixed values: scanner language -> file extensions -------------------------------------------------------------
SCAN_EXTENSIONS = {
    "python": ".py .pyw .pyi",
    "javascript": ".js .mjs .cjs",
    "jsx": ".jsx",
    "typescript": ".ts",
    "tsx": ".tsx",
    "java": ".java",
    "cpp": ".cpp .cxx .cc .c++",
    "c": ".c",
    "header": ".h .hpp .hxx .h++",
    "csharp": ".cs",
    "go": ".go",
    "rust": ".rs",
    "php": ".php",
    "ruby": ".rb",
    "swift": ".swift",
    "kotlin": ".kt .kts",
    "scala": ".scala",
    "r": ".r",
    "matlab": ".m",
    "shell": ".sh .bash .zsh .fish",
    "powershell": ".ps1",
    "sql": ".sql",
    "html": ".html .htm",
    "css": ".css .scss .sass .less",
    "xml": ".xml",
    "json": ".json",
    "yaml": ".yaml .yml",
    "toml": ".toml",
    "markdown": ".md .markdown",
}

# --- fixed values: adapter name -> file extensions -----------------------------------------------------------------
ADAPTER_EXTENSIONS = {
    "python": ".py .pyw",
    "javascript": ".js .jsx .mjs .ts .tsx",
    "java": ".java",
    "cpp": ".cpp .cxx .cc .h .hpp .hxx",
    "c": ".c",
}

# --- fixed values: content patterns per language, in priority order ------------------------------------------------
CONTENT_PATTERNS = {
    "Python": [
        r"^\s*def\s+\w+\s*\(",
        r"^\s*class\s+\w+\s*[\(:]",
        r"^\s*import\s+\w+",
        r"^\s*from\s+\w+\s+import",
        r"if\s+__name__\s*==\s*[\"']__main__[\"']",
    ],
    "JavaScript": [
        r"function\s+\w+\s*\(",
        r"var\s+\w+\s*=",
        r"let\s+\w+\s*=",
        r"const\s+\w+\s*=",
        r"console\.log\s*\(",
        r"require\s*\(",
        r"module\.exports",
    ],
    "JSX": [
        r"<\w+[^>]*>",
        r"</\w+>",
        r"className\s*=",
        r"onClick\s*=",
        r"useState\s*\(",
        r"useEffect\s*\(",
        r"import\s+React",
        r"export\s+default",
    ],
    "TypeScript": [
        r"interface\s+\w+\s*\{",
        r"type\s+\w+\s*=",
        r":\s*\w+\s*[=;]",
        r"export\s+interface",
        r"export\s+type",
    ],
    "Java": [
        r"public\s+class\s+\w+",
        r"private\s+\w+\s+\w+",
        r"public\s+static\s+void\s+main",
        r"import\s+java\.",
        r"package\s+\w+",
    ],
    "C++": [
        r"#include\s*<\w+>",
        r"using\s+namespace\s+std",
        r"std::\w+",
        r"class\s+\w+\s*\{",
        r"int\s+main\s*\(",
    ],
    "C": [r"#include\s*<\w+\.h>", r"int\s+main\s*\(", r"printf\s*\(", r"scanf\s*\("],
    "C#": [r"using\s+System", r"namespace\s+\w+", r"public\s+class\s+\w+", r"Console\.WriteLine"],
    "PHP": [r"<\?php", r"\$\w+\s*=", r"function\s+\w+\s*\(", r"echo\s+"],
    "Ruby": [r"def\s+\w+", r"class\s+\w+", r"require\s+[\"']\w+[\"']", r"puts\s+"],
    "Go": [r"package\s+\w+", r"import\s+[\"']\w+[\"']", r"func\s+\w+\s*\(", r"fmt\.Print"],
    "Rust": [r"fn\s+\w+\s*\(", r"let\s+\w+\s*=", r"use\s+\w+", r"println!\s*\("],
    "HTML": [r"<!DOCTYPE\s+html>", r"<html\b", r"<head\b", r"<body\b", r"<div\b"],
    "CSS": [r"(?<!\w)\w+\s*\{[^}]*\}", r"@media\s+", r"@import\s+", r"#\w+\s*\{", r"\.\w+\s*\{"],
}

# --- fixed values: directories and extensions ----------------------------------------------------------------------
SKIP_DIRECTORIES = (
    ".git .svn .hg .bzr node_modules __pycache__ .pytest_cache build dist target bin obj .vscode .idea .vs venv env .env "
    "virtualenv coverage .coverage .nyc_output logs log tmp temp"
).split()
BUILD_DIRECTORIES = "__pycache__ node_modules .git .svn venv env build dist target bin obj".split()
CODE_EXTENSIONS = (
    ".py .js .ts .java .cpp .c .h .hpp .cs .php .rb .go .rs .swift .kt .scala .html .css .scss .less .xml .json .yaml .yml"
).split()
COMMIT_EXTENSIONS = ".py .js .ts .java .cpp .c .h .hpp .cs".split()
BINARY_EXTENSIONS = (
    ".exe .dll .so .dylib .a .lib .obj .o .png .jpg .jpeg .gif .bmp .ico .svg .pdf .doc .docx .xls .xlsx .ppt .pptx .zip "
    ".tar .gz .bz2 .7z .rar .mp3 .mp4 .avi .mov .wav .flac .ttf .otf .woff .woff2 .pyc .pyo .class .jar"
).split()
REFACTORABLE = "python javascript jsx typescript tsx java cpp c".split()
PROCESSED_LANGUAGES = ["Python", "JavaScript", "Java", "C", "C++", "C/C++", "JSX"]

# --- fixed values: processing-time multipliers ---------------------------------------------------------------------
TIME_MULTIPLIER = {"python": 1.0, "javascript": 1.2, "jsx": 1.3, "typescript": 1.4, "java": 1.5, "cpp": 2.0, "c": 1.8}

# --- fixed values: prompt display names ----------------------------------------------------------------------------
PROMPT_NAMES = {"C/C++": "C or C++", "SCSS": "SCSS/Sass", "Less": "Less CSS", "Unknown": "code"}

# --- fixed values: keyword lists of the scores ---------------------------------------------------------------------
BRANCH_WORDS = ["if", "else", "for", "while", "switch", "case", "catch"]
BRANCH_WORDS_C = ["if", "else", "for", "while", "switch", "case"]
COUNT_WORDS = ["if", "else", "while", "for", "switch", "case"]
COUNT_OPERATORS = ["&&", "||"]
ISSUE_WORDS = ["if", "else", "for", "while", "switch", "case", "catch", "try"]

# --- fixed values: error pattern -> keywords, first match wins -----------------------------------------------------
ERROR_PATTERNS = {
    "timeout": ["timeout", "timed out"],
    "network": ["network", "connection", "dns", "unreachable"],
    "rate_limit": ["rate limit", "quota", "too many requests"],
    "auth": ["unauthorized", "authentication", "api key", "forbidden"],
    "syntax": ["syntax error", "invalid syntax", "parsing"],
    "memory": ["memory", "out of memory", "allocation"],
    "file_size": ["too large", "file size", "exceeds limit"],
    "api_error": ["api error", "server error", "500", "502", "503"],
    "json_error": ["json", "invalid json", "decode"],
    "llm_error": ["llm", "model", "generation"],
}

# --- fixed values: messages ----------------------------------------------------------------------------------------
FRIENDLY_MESSAGES = {
    "timeout": "Request timed out. Please try again with a smaller file.",
    "network": "Network connection issue. Please check your internet and try again.",
    "rate_limit": "Service temporarily busy. Please try again in a few minutes.",
    "auth": "Service configuration issue. Please contact support.",
    "syntax": "Code contains syntax errors that prevent refactoring.",
    "memory": "File too large to process. Please try with a smaller file.",
    "file_size": "File is too large for processing. Please try with a smaller file.",
    "api_error": "Refactoring service temporarily unavailable. Please try again later.",
    "json_error": "Service response error. Please try again.",
    "llm_error": "Refactoring model encountered an issue. Please try again.",
    "unknown": "An unexpected error occurred. Please try again.",
}
SESSION_MESSAGES = [
    (["timeout"], "Processing timed out. Please try with a smaller ZIP file."),
    (["memory", "out of memory"], "File too large to process. Please try with a smaller ZIP file."),
    (["permission", "access"], "File access error. Please check file permissions and try again."),
    (["network", "connection"], "Network connection issue. Please check your internet and try again."),
    (["api", "rate limit"], "Refactoring service temporarily busy. Please try again in a few minutes."),
    (["zip", "extract"], "Invalid or corrupted ZIP file. Please check your file and try again."),
]
SESSION_DEFAULT = "An unexpected error occurred during processing. Please try again."
HINTS = [
    (["timeout"], [
        "Try with a smaller ZIP file (under 10MB)",
        "Ensure your internet connection is stable",
        "Wait a few minutes before trying again",
    ]),
    (["memory", "size"], [
        "Reduce the size of your ZIP file",
        "Remove large files or binaries from your ZIP",
        "Try processing files in smaller batches",
    ]),
    (["network", "connection"], [
        "Check your internet connection",
        "Try again in a few minutes",
        "Contact your network administrator if the problem persists",
    ]),
    (["rate limit", "quota"], [
        "Wait 5-10 minutes before trying again",
        "Try with fewer files at once",
        "The service may be experiencing high demand",
    ]),
    (["zip", "extract"], [
        "Ensure your ZIP file is not corrupted",
        "Try creating a new ZIP file",
        "Check that the ZIP file contains valid code files",
    ]),
]
HINTS_DEFAULT = [
    "Wait a few minutes and try again",
    "Try with a smaller ZIP file",
    "Check your internet connection",
    "Contact support if the problem persists",
]
SYNTAX_WARNING_WORDS = [
    "syntax", "invalid syntax", "syntaxerror", "parse error", "unexpected token", "unexpected indent",
    "indentation error", "invalid character", "unexpected eof", "invalid decimal literal",
]
FIX_KEYWORDS = ["def", "return", "print", "if", "for", "while", "import"]

# --- fixed values: suggestion and candidate texts per language -----------------------------------------------------
NESTED_SUGGESTIONS = {
    "python": ("extract_method", "Extract nested conditions into separate functions with descriptive names",
               ["Improved readability", "Better testability", "Reduced complexity"]),
    "java": ("extract_method", "Extract nested conditions into private methods with meaningful names",
             ["Improved readability", "Better testability", "Reduced cyclomatic complexity"]),
    "javascript": ("extract_function", "Extract nested conditions into separate functions or use early returns",
                   ["Improved readability", "Better maintainability", "Easier debugging"]),
    "": ("simplify_conditionals", "Consider simplifying nested conditional logic",
         ["Improved readability", "Reduced complexity"]),
}
REFACTOR_CANDIDATES = {
    "python": ("guard_clauses", 0.8, "Convert nested if statements to guard clauses with early returns"),
    "java": ("early_return", 0.75, "Convert nested if statements to early return pattern"),
    "javascript": ("early_return", 0.75, "Convert nested if statements to early return pattern"),
    "": ("extract_method", 0.5, "Consider extracting nested logic to separate methods"),
}

# --- fixed values: improvement classes: label -> alternatives, each alternative needs all of its words -------------
IMPROVEMENT_TYPES = {
    "Type Hints Added": [["type hints"]],
    "Long Functions Identified": [["long function"]],
    "Documentation Added": [["docstring"], ["jsdoc"]],
    "Formatting Cleaned": [["blank lines"]],
    "Boolean Logic Simplified": [["boolean comparison"]],
    "None Comparisons Fixed": [["none comparison"]],
    "JS var→const Conversion": [["var", "const"]],
}
IMPROVEMENT_GROUPS = {
    "Type Hints": ["type hints"],
    "Documentation": ["docstring", "jsdoc"],
    "Long Functions": ["long function"],
    "Formatting": ["blank lines"],
    "Boolean Logic": ["boolean"],
}

# --- fixed values: generator vocabulary ----------------------------------------------------------------------------
PAIR_LANGUAGES = ["python", "java", "javascript", "csharp"]
PAIR_PATTERNS = ["guard_clauses", "early_return", "method_extraction", "strategy_pattern", "switch_statement"]
PAIR_NAMES = (
    "score value data input result status level grade amount count size length weight height age price"
).split()


def extension_pairs(groups: dict[str, str]) -> list[tuple[str, str]]:
    return [(ext, language) for language, exts in groups.items() for ext in exts.split()]


def extension_dim(spark: SparkSession, groups: dict[str, str]) -> DataFrame:
    """(extension, ext_language): a constant table of at most about a hundred rows."""
    return spark.createDataFrame(extension_pairs(groups), "extension string, ext_language string")
