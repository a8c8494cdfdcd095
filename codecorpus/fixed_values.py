"""Lists, tables, limits, patterns and texts that results depend on.

Everything here has to be exactly what it is for results to be right; nothing
here is computed.  The code that uses the values lives elsewhere.
"""

# --- fixed values: scanning -------------------------------------------------

SCANNED_SUFFIXES = [".py", ".r", ".ipynb", ".sql", ".js", ".java", ".cpp", ".c", ".cs", ".rb", ".go", ".rs", ".ts"]
EXCLUDED_DIRECTORIES = ["node_modules", "venv", "__pycache__", ".git"]
EXCLUDED_FILE_NAMES = ["config.json", "secrets.json"]
MAX_FILE_BYTES = 5 * 1024 * 1024
MAX_SCAN_BYTES = 50 * 1024 * 1024
MAX_SCAN_FILES = 100
MAX_LINES = 1000
CHUNK_LINES = 500

# --- fixed values: classification -------------------------------------------

LANGUAGE_BY_SUFFIX = {
    ".py": "Python",
    ".r": "R",
    ".ipynb": "Jupyter Notebook",
    ".sql": "SQL",
    ".js": "JavaScript",
    ".java": "Java",
    ".cpp": "C++",
    ".c": "C",
    ".cs": "C#",
    ".ts": "TypeScript",
    ".json": "JSON",
}
UNKNOWN_LANGUAGE = "unknown"
LINES_PER_COMPLEXITY_POINT = 100
# (more lines than, priority, difficulty), first match wins
PRIORITY_BANDS = [(800, 1, "high"), (300, 2, "medium")]
LOWEST_PRIORITY_BAND = (3, "low")
CONVERTIBLE_LANGUAGES = ["python", "javascript", "java", "cpp", "c++", "c#", "typescript", "sql"]

# --- fixed values: conversion -----------------------------------------------

SUFFIX_BY_TARGET_LANGUAGE = {
    "python": ".py",
    "java": ".java",
    "r": ".r",
    "sql": ".sql",
    "javascript": ".js",
    "typescript": ".ts",
    "c++": ".cpp",
    "c#": ".cs",
    "json": ".json",
}
FALLBACK_TARGET_SUFFIX = ".txt"
CONVERTED_HEADER = "// This file was auto-generated by GenAI from {source_language} → {target_language}\n\n"
MAX_ATTEMPTS = 3
BACKOFF_SECONDS = 2

CONVERSION_CONTEXT = "Here is some additional context that may help:\n{context}\n"
CONVERSION_REQUEST = """You are an expert software engineer helping to translate code.

Convert the following {source_language} code into {target_language}.
Preserve all functionality, structure, and logic.
{context_block}

### BEGIN {source_language} CODE
{code}
### END {source_language} CODE

Now, write the equivalent in {target_language} only.
Respond with ONLY the {target_language} code, no commentary.
"""

# --- fixed values: review ---------------------------------------------------

REVIEW_NAME_BY_SUFFIX = {
    "py": "Python",
    "java": "Java",
    "js": "JavaScript",
    "cpp": "C++",
    "c": "C",
    "cs": "C#",
    "rb": "Ruby",
    "go": "Go",
    "rs": "Rust",
    "ts": "TypeScript",
}
REVIEW_REQUEST = """
You are a code validation agent comparing {source_language} code converted to {target_language}.

IMPORTANT GUIDELINES FOR CROSS-LANGUAGE CONVERSION:
1. Focus on FUNCTIONAL EQUIVALENCE, not syntax similarity
2. Understand that different languages have different idioms and patterns
3. Accept reasonable adaptations (e.g., Python list → Java ArrayList)
4. Consider framework differences (e.g., Flask → Spring Boot)
5. Allow for language-specific error handling patterns
6. Accept minor differences in implementation details

EVALUATION CRITERIA:
- PASS if the core functionality and logic are preserved
- PASS if the conversion handles language-specific requirements appropriately
- FAIL only if critical functionality is missing or broken
- FAIL if the conversion completely misunderstands the original intent

Original {source_language} code:
{original_code}

Converted {target_language} code:
{converted_code}

Provide a detailed analysis focusing on:
1. Core functionality preservation
2. Appropriate language adaptations
3. Any critical missing features
4. Overall assessment (PASS/FAIL)

Your response should end with a clear PASS or FAIL recommendation.
"""
REVIEW_NO_RESPONSE = "No response from LLM."
REVIEW_CALL_FAILED = "LLM validation error: {error}. Defaulting to PASS."

# --- fixed values: complexity rule ------------------------------------------

FUNCTION_MARKERS = {
    "py": ["def "],
    "java": ["public ", "private ", "protected "],
    "js": ["function ", "=>"],
}
CLASS_MARKER = "class "
CONTROL_MARKERS = ["if ", "for ", "while ", "try ", "switch ", "case "]
FUNCTION_WEIGHT = 2
CLASS_WEIGHT = 3
CONTROL_WEIGHT = 1
LINE_WEIGHT = 0.1
MIN_FUNCTION_RATIO = 0.5
MIN_CONTROL_RATIO = 0.3
MIN_SCORE_RATIO = 0.3
MAX_SCORE_RATIO = 3

COMPLEXITY_FUNCTIONS_MISSING = "Too many functions missing in {target} conversion"
COMPLEXITY_CLASSES_MISSING = "Classes missing in {target} conversion"
COMPLEXITY_CONTROL_MISSING = "Too many control structures missing in {target} conversion"
COMPLEXITY_TOO_SIMPLE = "Code too simplified in {target} conversion"
COMPLEXITY_TOO_COMPLEX = "Code overly complex in {target} conversion"
COMPLEXITY_ERROR = "Cross-language complexity analysis error: {error}. Defaulting to PASS."
COMPLEXITY_KEPT = "Cross-language conversion from {source} to {target} maintains appropriate complexity"

# --- fixed values: structural rule ------------------------------------------

STRUCTURE_PATTERNS = {
    "py": {
        "functions": [r"def\s+(\w+)\s*\("],
        "classes": [r"class\s+(\w+)"],
        "imports": [r"import\s+(\w+)", r"from\s+(\w+)"],
        "variables": [r"(\w+)\s*="],
        "control_structures": [r"(if|for|while|try|with)\s+"],
    },
    "java": {
        "functions": [
            r"(?:public|private|protected)?\s*(?:static\s+)?(?:final\s+)?"
            r"(?:void|int|String|boolean|double|float|long|short|byte|char)\s+(\w+)\s*\("
        ],
        "classes": [r"class\s+(\w+)"],
        "imports": [r"import\s+([^;]+)"],
        "variables": [
            r"(?:public|private|protected)?\s*(?:static\s+)?(?:final\s+)?"
            r"(?:int|String|boolean|double|float|long|short|byte|char)\s+(\w+)"
        ],
        "control_structures": [r"(if|for|while|try|switch)\s*\("],
    },
    "js": {
        "functions": [r"function\s+(\w+)|(\w+)\s*[:=]\s*function|(\w+)\s*[:=]\s*\([^)]*\)\s*=>"],
        "classes": [r"class\s+(\w+)"],
        "imports": [r"import\s+([^;]+)"],
        "variables": [r"(?:const|let|var)\s+(\w+)"],
        "control_structures": [r"(if|for|while|try|switch)\s*\(", r"(if|for|while|try|switch)\s+"],
    },
}
STRUCTURE_FUNCTIONS_MISSING = "Functions missing in {target} conversion"
STRUCTURE_CLASSES_MISSING = "Classes missing in {target} conversion"
STRUCTURE_CONTROL_MISSING = "Control structures missing in {target} conversion"
STRUCTURE_ERROR = "Cross-language validation error: {error}. Defaulting to PASS."
STRUCTURE_KEPT = "Cross-language conversion from {source} to {target} preserves key structural elements"
SOURCES_MATCH = "ASTs match."
SOURCES_ERROR = "Error during AST comparison: {error}"
SOURCES_DIFFER = "ASTs differ structurally."

# --- fixed values: runtime rule ---------------------------------------------

RUN_TIMEOUT_SECONDS = 10
MAX_SLOWDOWN = 2
RUN_ORIGINAL_FAILED = "Original file failed to run: {error}"
RUN_CONVERTED_FAILED = "Converted file failed to run: {error}"
RUN_TIMED_OUT = "Execution timed out."
RUN_ACCEPTABLE = "Converted file ran in {converted}s, original in {original}s. Performance acceptable."
RUN_REGRESSION = "Converted file ran in {converted}s, original in {original}s. Performance regression detected."

# --- fixed values: leniency and quorum --------------------------------------

LENIENT_PHRASES = ["only supports python", "cross-language", "language-specific", "defaulting to pass"]
LENIENT_PREFIX = "Cross-language conversion: "
LENIENT_QUORUM = 2

# --- fixed values: extraction without a parser ------------------------------

SCRIPT_DEFINITION = r"function\s+(\w+)\s*\(|(\w+)\s*=\s*\(.*\)\s*=>|class\s+(\w+)"
SCRIPT_IMPORT_LINE = r"^import .+"
SCRIPT_DECLARATION = r"function\s+\w+|class\s+\w+"
SCRIPT_IMPORT_FROM = r"import\s+(.+?)\s+from\s+['\"](.+?)['\"]"
SCRIPT_REQUIRE = r"require\s*\(\s*['\"](.+?)['\"]"
SCRIPT_CALL = r"(\w+)\s*\("
CPP_INCLUDE = r"#include\s*[<\"](.+?)[>\"]"
CSHARP_USING = r"using\s+([\w.]+);"
ANONYMOUS = "<anonymous>"
WHOLE_FILE_TYPE = "File"
SCRIPT_MATCH_TYPE = "FunctionOrClass"
UNKNOWN_NODE_TYPE = "unknown"

# --- fixed values: previews -------------------------------------------------

SEGMENT_PREVIEW_LINES = (4, 4)
CONTEXT_PREVIEW_LINES = (3, 0)
CONTEXT_PREVIEW_LIMIT = 5
