"""Record schemas and the constants that define results."""

from __future__ import annotations

from pyspark.sql import types as T

# Limits, thresholds and defaults that results depend on.
MAX_FILE_BYTES = 1_000_000
BINARY_SNIFF_BYTES = 8192
EMBED_BATCH, UPSERT_BATCH = 32, 128
EMBED_MODEL, EMBED_DIM = "nomic-embed-code", 3584
QUERY_PREFIX, CODE_PREFIX = "Represent this query for searching relevant code: ", ""
OVERFETCH = 3
DEFINITION_BOOST = 0.20
TRIVIAL_BASENAME, TRIVIAL_LINES = "__init__.py", 2
CHARS_PER_TOKEN = 4
DEFAULT_LIMIT, MAX_LIMIT = 10, 50
DEFAULT_PAGE, MAX_PAGE = 100, 1000
DEFAULT_DAYS, MAX_DAYS = 14, 365
EVAL_K, EVAL_TOLERANCE = 5, 0.0
# Directories that are never indexed, besides those that start with a dot.
IGNORED_DIRS = (".git", "node_modules", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".tox", "dist", "build", "obj", "bin", ".idea", ".vscode")
# Extension to language.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".cs": "csharp", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx",
}
#: Outcome codes.
OK, BAD_INPUT, NOT_A_REPO, UNAVAILABLE, NOT_INDEXED, EMBEDDER_DOWN, FAILED = 0, 2, 3, 4, 5, 6, 7
#: Results of an exact search that an outcome carries itself; more are written.
MOST_RESULTS = 10_000
METRICS = {"recall_at_k": True, "mrr": True, "noise_at_k": False, "definition_rank_pass_rate": True, "symbol_completeness": True}


_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def _struct(fields: str, **nested: T.DataType) -> T.StructType:
    """A schema of "name kind" pairs, followed by the nested fields; it needs no session."""
    flat = [T.StructField(n, _KINDS[k]) for n, k in (f.split() for f in fields.split(", "))]
    return T.StructType(flat + [T.StructField(n, t) for n, t in nested.items()])


_STRINGS = T.ArrayType(T.StringType())
CHUNK = _struct("path string, language string, start_line int, end_line int, start_byte int, end_byte int, text string, symbol string")
POINT = _struct("id string, repo_id string, path string, language string, start_line int, end_line int, code string, symbol string", vector=T.ArrayType(T.FloatType()))
LANGUAGE_STAT = _struct("language string, files bigint, chunks bigint")
REGISTRY = _struct("repo_id string, indexed_sha string, indexed_at string, chunk_count bigint, file_count bigint, skipped_count bigint", languages=T.ArrayType(LANGUAGE_STAT))
HIT = _struct("path string, language string, start_line int, end_line int, code string, symbol string, score double")
FILE = _struct("path string, size bigint, content binary, skipped string")
LISTED = _struct("path string, size bigint, language string, skipped string")
VECTOR = _struct("digest string", vector=T.ArrayType(T.FloatType()))
LEDGER_LINE = _struct("id string, value string")
CHANGE = _struct("repo_id string, repo_path string, path string, sha string, number bigint")
LEDGER = _struct("event_id string, ts string, repo_id string, query string, count int, returned_tokens bigint, baseline_tokens_upper bigint, saved_tokens_upper bigint, files_counted int, files_missing int")
CASE = _struct(
    "id string, query string, k int, mode string, must_pass boolean", expect_in_top_k=_STRINGS, forbid_in_top_k=_STRINGS, expect_all=_STRINGS,
    expect_rank_above=_struct("above string, below string"), tags=_STRINGS,
)
