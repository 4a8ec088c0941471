"""The library's queries over the test tables, and the SQL that each equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkmill.functions import scalar as S
from chunkmill.functions.session import workspace
from chunkmill.operators import evaluate as E
from chunkmill.operators import chunker, inspect, savings, search, staleness, store, symbol
from chunkmill.operators.text_index import TextIndex
from chunkmill.operators.vector_index import VectorIndex
from chunkmill.plans import schema as C
from chunkmill.plans import views as V
from chunkmill.streaming import ledger

LIMIT, WIDE = 10, 15
AS_OF, DAYS = "2024-01-31 00:00:00", 14
WITH = "WITH RECURSIVE " + V.CHUNKS_SQL.strip()
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


KNN_SQL = f"""{WITH}, {V.QUERIES_SQL.strip()},
knn AS (
  SELECT * FROM (SELECT c.*, query_id, query_tokens, round(list_cosine_similarity(vector::DOUBLE[], query_vector::DOUBLE[]), 6) AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(vector::DOUBLE[], query_vector::DOUBLE[]), 6) DESC, id) AS raw_rank
  FROM chunks c, queries))"""


def _rank(name: str) -> F.Column:
    return F.col(name).cast("bigint").alias(name)


@query(f"{KNN_SQL} SELECT query_id, id, score, raw_rank FROM knn WHERE raw_rank <= {WIDE}")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.knn_blocks(V.chunks(spark, d).select("id", "vector"), V.queries(spark, d).drop("query_tokens"), WIDE).select("query_id", "id", "score", _rank("raw_rank"))


@query(_SQL["knn_topk"])
def knn_topk_arrow(spark: SparkSession, d: str) -> DataFrame:
    return search.knn_arrow(V.chunks(spark, d), V.queries(spark, d), WIDE).select("query_id", "id", "score", _rank("raw_rank"))


@query(f"""{WITH}, {V.QUERIES_SQL.strip()}
SELECT * FROM (SELECT query_id, id, round(list_cosine_similarity(vector::DOUBLE[], query_vector::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(vector::DOUBLE[], query_vector::DOUBLE[]), 6) DESC, id) AS raw_rank
FROM chunks, queries WHERE repo_id = 'src0') WHERE raw_rank <= {WIDE}""")
def knn_filtered_by_repo(spark: SparkSession, d: str) -> DataFrame:
    points = V.chunks(spark, d).where(F.col("repo_id") == "src0").select("id", "vector")
    return search.knn_blocks(points, V.queries(spark, d).drop("query_tokens"), WIDE).select("query_id", "id", "score", _rank("raw_rank"))


def _index(spark: SparkSession, d: str, dims: int) -> VectorIndex:
    return VectorIndex.build(V.chunks(spark, d), workspace(spark, "index"), dims)


@query()
def knn_ivf(spark: SparkSession, d: str) -> DataFrame:
    """Approximate: by the cells and codes of an index, built here from all chunks."""
    return _index(spark, d, 2).approximate(V.queries(spark, d), WIDE).select("query_id", "id", "score", _rank("raw_rank"))


@query(_SQL["knn_topk"])
def knn_codes(spark: SparkSession, d: str) -> DataFrame:
    """Exact: codes of the index prove which vectors needn't be read."""
    return _index(spark, d, 1).exact(V.queries(spark, d), WIDE).select("query_id", "id", "score", _rank("raw_rank"))


BOOST_SQL = f"""{KNN_SQL},
boosted AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, raw_rank) AS rank
  FROM (SELECT id, path, language, start_line, end_line, symbol, code, query_id, raw_rank, round(score + CASE WHEN list_contains(query_tokens, lower(symbol)) THEN 0.20 ELSE 0 END, 6) AS score FROM knn WHERE raw_rank <= {3 * LIMIT}))"""


@query(f"{BOOST_SQL} SELECT query_id, id, symbol, score, raw_rank, rank FROM boosted")
def definition_boost(spark: SparkSession, d: str) -> DataFrame:
    return search.boost(search.candidates(V.chunks(spark, d), V.queries(spark, d), 3 * LIMIT), F.col("query_tokens")).select("query_id", "id", "symbol", "score", _rank("raw_rank"), _rank("rank"))


LINES_SQL = r"len(list_filter(regexp_split_to_array(code, '\r\n|[\n\r\x0B\f\x1c-\x1e]'), lambda x: trim(x) <> ''))"
TRIVIAL_SQL = f"""{BOOST_SQL},
kept AS (SELECT * FROM (SELECT *, max({LINES_SQL}) OVER (PARTITION BY query_id, path) AS most FROM boosted) WHERE NOT (ends_with(path, '/__init__.py') AND most <= 2))"""


@query(f"{TRIVIAL_SQL} SELECT query_id, id, path, rank FROM kept")
def trivial_filter(spark: SparkSession, d: str) -> DataFrame:
    hits = search.boost(search.candidates(V.chunks(spark, d), V.queries(spark, d), 3 * LIMIT), F.col("query_tokens"))
    return search.drop_trivial(hits).select("query_id", "id", "path", _rank("rank"))


def _fold(source: str, key: str, columns: str) -> str:
    """SQL of the greedy collapse: rows of a key in order, each tested against those kept before."""
    test = "len(list_filter(f.kept, lambda k: least(k.e, o.e) >= greatest(k.s, o.s) AND ((k.s <= o.s AND k.e >= o.e) OR (o.s <= k.s AND o.e >= k.e) OR 2 * (least(k.e, o.e) - greatest(k.s, o.s) + 1) > least(k.e - k.s, o.e - o.s) + 1))) > 0"
    on = " AND ".join(f"o.{k} = f.{k}" for k in key.split(", "))
    return f"""
ordered AS (SELECT *, least(start_line, end_line) AS s, greatest(start_line, end_line) AS e, row_number() OVER (PARTITION BY {key} ORDER BY rank) AS n FROM {source}),
fold AS (
  SELECT {columns}, n, [struct_pack(s := s, e := e)] AS kept, true AS stays FROM ordered WHERE n = 1
  UNION ALL
  SELECT {", ".join("o." + c for c in columns.split(", "))}, o.n, CASE WHEN {test} THEN f.kept ELSE list_append(f.kept, struct_pack(s := o.s, e := o.e)) END, NOT ({test})
  FROM fold f JOIN ordered o ON {on} AND o.n = f.n + 1)"""


@query(f"{BOOST_SQL}, {_fold('boosted', 'query_id, path', 'query_id, id, path, start_line, end_line').strip()} SELECT query_id, id, path, start_line, end_line FROM fold WHERE stays")
def overlap_collapse(spark: SparkSession, d: str) -> DataFrame:
    hits = search.boost(search.candidates(V.chunks(spark, d), V.queries(spark, d), 3 * LIMIT), F.col("query_tokens"))
    return search.collapse(hits.select("query_id", "id", "path", "start_line", "end_line", "rank")).select("query_id", "id", "path", "start_line", "end_line")


@query(f"""{TRIVIAL_SQL}, {_fold('kept', 'query_id, path', 'query_id, id, path, language, start_line, end_line, symbol, score, rank').strip()}
SELECT query_id, id, path, language, start_line, end_line, symbol, score, rank FROM (
  SELECT query_id, id, path, language, start_line, end_line, symbol, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM fold WHERE stays) WHERE rank <= {LIMIT}""")
def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    found = search.semantic_search(V.chunks(spark, d), V.queries(spark, d), LIMIT)
    return found.select("query_id", "id", "path", "language", "start_line", "end_line", "symbol", "score", _rank("rank"))


WORD = "the"


@query(rf"""SELECT doc_id, CAST(n AS INTEGER) AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
WHERE regexp_matches(line, '(^|[^A-Za-z0-9_]){WORD}([^A-Za-z0-9_]|$)')""")
def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    return symbol.symbol_search(V.read(spark, d, "documents").select("doc_id", "text"), WORD)


@query(_SQL["symbol_search"])
def symbol_search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """By trigrams: blocks that can't hold the word aren't read."""
    rows = V.read(spark, d, "documents").select("doc_id", "lang", "text")
    return TextIndex.build(rows, workspace(spark, "text-index"), "lang").search(WORD).select("doc_id", "line_no", "line")


@query(rf"""{WITH}, found AS (SELECT DISTINCT path FROM chunks WHERE regexp_matches(code, '(^|[^A-Za-z0-9_]){WORD}([^A-Za-z0-9_]|$)'))
SELECT count(*) AS expected, count(f.path) AS present, round(count(f.path)::DOUBLE / count(*), 6) AS symbol_completeness FROM (SELECT DISTINCT path FROM chunks) c LEFT JOIN found f USING (path)""")
def symbol_completeness(spark: SparkSession, d: str) -> DataFrame:
    c = V.chunks(spark, d)
    return symbol.completeness(symbol.symbol_search(c.select("path", "code"), WORD, "code"), c)


@query(f"{WITH} SELECT coalesce(language, 'unknown') AS language, count(DISTINCT path) AS files, count(*) AS chunks FROM chunks GROUP BY 1")
def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return inspect.stats_by_language(V.chunks(spark, d))


@query(f"{WITH} SELECT count(*) AS chunk_count, count(DISTINCT path) AS file_count FROM chunks")
def collection_stats_total(spark: SparkSession, d: str) -> DataFrame:
    return inspect.stats_total(V.chunks(spark, d))


@query(f"{WITH} SELECT language, count(DISTINCT path) AS files, count(*) AS chunks, grouping(language) = 1 AS total FROM (SELECT coalesce(language, 'unknown') AS language, path FROM chunks) GROUP BY GROUPING SETS ((language), ())")
def collection_statistics(spark: SparkSession, d: str) -> DataFrame:
    return inspect.statistics(V.chunks(spark, d))


REPOS_SQL = f"""{WITH}, per AS (SELECT repo_id, language, count(DISTINCT path) AS files, count(*) AS chunks FROM chunks GROUP BY 1, 2),
repos AS (SELECT repo_id, CAST(sum(chunks) AS BIGINT) AS chunk_count, string_agg(concat(language, ':', files, ':', chunks), ',' ORDER BY language) AS languages FROM per GROUP BY 1),
counts AS (SELECT repo_id, count(DISTINCT path) AS file_count FROM chunks GROUP BY 1)"""


def _flat(repos: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("languages", lambda x: F.concat_ws(":", x["language"], x["files"].cast("string"), x["chunks"].cast("string"))), ",")
    return repos.withColumn("languages", text)


@query(f"{REPOS_SQL} SELECT repo_id, languages FROM repos")
def language_array(spark: SparkSession, d: str) -> DataFrame:
    return _flat(inspect.repositories(V.chunks(spark, d))).select("repo_id", "languages")


@query(f"{REPOS_SQL} SELECT repo_id, chunk_count FROM repos ORDER BY repo_id")
def list_repos(spark: SparkSession, d: str) -> DataFrame:
    return inspect.repositories(V.chunks(spark, d)).select("repo_id", "chunk_count").orderBy("repo_id")


@query(f"{REPOS_SQL} SELECT repo_id, chunk_count, file_count, languages FROM repos JOIN counts USING (repo_id) WHERE repo_id = 'src3'")
def get_repo(spark: SparkSession, d: str) -> DataFrame:
    """One row of a registry that the library has written."""
    registry = store.Registry(spark, workspace(spark, "store"))
    rows = inspect.repositories(V.chunks(spark, d))
    known = [F.col(f.name) if f.name in rows.columns else F.lit(None).alias(f.name) for f in C.REGISTRY]
    registry.replace("all", rows.select(*known))
    return _flat(registry.read("src3").select("repo_id", "chunk_count", "file_count", "languages"))


FILES_SQL = f"{WITH}, files AS (SELECT path, arg_min(language, id) AS language, count(*) AS chunk_count FROM chunks WHERE path <> '' GROUP BY 1)"


@query(f"{FILES_SQL} SELECT * FROM files")
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    return inspect.inventory(V.chunks(spark, d))


@query(f"{FILES_SQL} SELECT * FROM files ORDER BY path LIMIT 20 OFFSET 10")
def file_inventory_page(spark: SparkSession, d: str) -> DataFrame:
    return inspect.page(inspect.inventory(V.chunks(spark, d)), 10, 20)[1]


@query(f"{FILES_SQL} SELECT * FROM (SELECT * FROM files ORDER BY path LIMIT 60 OFFSET 10) WHERE language = 'en'")
def file_inventory_lang(spark: SparkSession, d: str) -> DataFrame:
    return inspect.page(inspect.inventory(V.chunks(spark, d)), 10, 60, "en")[1]


@query("""SELECT path, CASE regexp_extract(lower(path), '\\.[^.]*$') WHEN '.py' THEN 'python' WHEN '.pyi' THEN 'python' WHEN '.cs' THEN 'csharp' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript'
  WHEN '.mjs' THEN 'javascript' WHEN '.cjs' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.mts' THEN 'typescript' WHEN '.cts' THEN 'typescript' WHEN '.tsx' THEN 'tsx' END AS language
FROM (SELECT concat('src/', p_name, CASE p_partkey % 9 WHEN 0 THEN '.PY' WHEN 1 THEN '.cs' WHEN 2 THEN '.tsx' WHEN 3 THEN '.mjs' WHEN 4 THEN '.md' WHEN 5 THEN '' WHEN 6 THEN '.d.ts' WHEN 7 THEN '.pyi' ELSE '.jsx' END) AS path FROM part)""")
def language_for(spark: SparkSession, d: str) -> DataFrame:
    ends = [".PY", ".cs", ".tsx", ".mjs", ".md", "", ".d.ts", ".pyi", ".jsx"]
    ending = F.element_at(F.array(*[F.lit(e) for e in ends]), (F.col("p_partkey") % 9 + 1).cast("int"))
    rows = V.read(spark, d, "part").select(F.concat(F.lit("src/"), "p_name", ending).alias("path"))
    return rows.select("path", S.language_for(F.col("path")).alias("language"))


@query("""SELECT doc_id, 1 AS start_line, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS end_line, CAST(0 AS BIGINT) AS start_byte, CAST(octet_length(encode(text)) AS BIGINT) AS end_byte
FROM documents WHERE regexp_matches(text, '\\S')""")
def whole_file_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = V.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    whole = chunker.whole_files(rows)
    return whole.select(F.col("path").cast("bigint").alias("doc_id"), "start_line", "end_line", F.col("start_byte").cast("bigint").alias("start_byte"), F.col("end_byte").cast("bigint").alias("end_byte"))


#: A source file of each language for every part, with the lines, bytes and name that its chunks have.
SOURCES = {
    "python": ("import os\n\n\n@wrap\ndef run_@(ü):\n    return ü\n\n\nclass Part@:\n    def size(self):\n        def inner():\n            pass\n        return @\n", (("run_", 5, 6), ("Part", 9, 13), ("size", 10, 13))),
    "csharp": ("// Part {\nnamespace Parts\n{\n    class Part@\n    {\n        int Size(int n) { return n + @; }\n        string Name() => \"}\";\n    }\n}\n", (("Parts", 2, 9), ("Part", 4, 8), ("Size", 6, 6), ("Name", 7, 7))),
    "typescript": ("interface Sized@ { size(): number }\nexport function total@(n: number) { return n; }\nclass Part@ {\n  size() { return `{${@}`; }\n}\n", (("Sized", 1, 1), ("total", 2, 2), ("Part", 3, 5), ("size", 4, 4))),
    "javascript": ("const x@ = 1;\n", ()),
}


def _source_sql() -> str:
    """What the chunks of SOURCES must be; a name that ends in the part's key is given without it."""
    rows = []
    for language, (_, chunks) in SOURCES.items():
        rows += [f"('{language}', '{name}', {first}, {last})" for name, first, last in chunks] or [f"('{language}', NULL, 1, 2)"]
    return f"SELECT p_partkey, language, name, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM part, (VALUES {', '.join(rows)}) AS v(language, name, start_line, end_line)"


@query(_source_sql())
def chunk_source(spark: SparkSession, d: str) -> DataFrame:
    sources = F.explode(F.create_map(*[F.lit(x) for language, (text, _) in SOURCES.items() for x in (language, text)]))
    # the table is small and its chunks are much work: keys are dealt to tasks evenly, before texts are made of them
    parts = V.read(spark, d, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    rows = parts.select("p_partkey", sources.alias("language", "text"))
    content = F.encode(F.replace("text", F.lit("@"), F.col("p_partkey").cast("string")), "UTF-8")
    found = chunker.chunk_files(rows.select(F.col("p_partkey").cast("string").alias("path"), content.alias("content"), "language"))
    key = F.col("path").cast("bigint").alias("p_partkey")
    return found.select(key, "language", F.regexp_replace("symbol", "[0-9]+$", "").alias("name"), "start_line", "end_line")


UUID_SQL = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query(f"""{WITH} SELECT id, {UUID_SQL} AS chunk_id FROM (
  SELECT id, sha1(from_hex('{S.NAMESPACE}') || encode(concat(repo_id, ':', path, ':', start_line * 10, ':', end_line * 10 + 7))) AS h FROM chunks)""")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return V.chunks(spark, d).select("id", S.chunk_id(F.col("repo_id"), F.col("path"), F.col("start_line") * 10, F.col("end_line") * 10 + 7).alias("chunk_id"))


@query("""SELECT s_suppkey, concat(coalesce(nullif(trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'repo'), '-', substr(sha1(lower(concat('/srv/Repos/', s_name))), 1, 8)) AS repo_id FROM supplier""")
def repo_ids(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "supplier").select("s_suppkey", S.repo_id(F.concat(F.lit("/srv/Repos/"), "s_name", F.lit("/"))).alias("repo_id"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "documents").select("doc_id", S.token_estimate(F.col("text")).alias("tokens"))


@query(f"""{KNN_SQL}, hits AS (SELECT query_id, path, code FROM knn WHERE raw_rank <= {LIMIT}),
files AS (SELECT path, CAST(ceil(length(string_agg(code, chr(10) ORDER BY id)) / 4.0) AS BIGINT) AS tokens FROM chunks WHERE id % 40 <> 3 GROUP BY 1),
r AS (SELECT query_id, CAST(sum(CAST(ceil(length(code) / 4.0) AS BIGINT)) AS BIGINT) AS returned_tokens FROM hits GROUP BY 1),
b AS (SELECT query_id, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS baseline_tokens_upper, count(tokens) AS files_counted, count(*) - count(tokens) AS files_missing FROM (SELECT DISTINCT query_id, path FROM hits) LEFT JOIN files USING (path) GROUP BY 1)
SELECT query_id, returned_tokens, baseline_tokens_upper, files_counted, files_missing, greatest(0, baseline_tokens_upper - returned_tokens) AS saved_tokens_upper,
  CAST(CASE WHEN baseline_tokens_upper > 0 THEN round_even(greatest(0, baseline_tokens_upper - returned_tokens) / baseline_tokens_upper::DOUBLE * 100, 0) ELSE 0 END AS INTEGER) AS pct_upper FROM r JOIN b USING (query_id)""")
def savings_per_query(spark: SparkSession, d: str) -> DataFrame:
    c = V.chunks(spark, d)
    hits = search.candidates(c, V.queries(spark, d), LIMIT)
    files = c.where("id % 40 <> 3").groupBy("path").agg((F.sum(F.length("code")) + F.count("code") - 1).alias("n_chars"))
    return savings.per_query(hits, files)


def _events(spark: SparkSession, d: str, times: int = 0) -> DataFrame:
    """Events as lines of a ledger, parsed: every 50th line is corrupt and every 77th has a time that can't be read. times: as a stream that delivers each so often."""
    table = V.read(spark, d, "events")
    e = table
    for k in range(times):
        some = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(d)
        e = e.unionByName(some) if k else some
    corrupt, unread = F.col("event_id") % 50 == 0, F.col("event_id") % 77 == 5
    event = F.struct(
        F.col("event_id").cast("string").alias("event_id"), F.when(unread, "yesterday").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).alias("ts"), (100 + F.col("user_id") % 900).alias("baseline_tokens_upper"),
        (F.col("event_id") % 100).alias("returned_tokens"), (100 + F.col("user_id") % 900 - F.col("event_id") % 100).alias("saved_tokens_upper"),
    )
    broken = F.when(F.col("event_id") % 100 == 0, '{"ts": ').otherwise('{"returned_tokens": 1}')
    return savings.parse_ledger(e.select(F.when(corrupt, broken).otherwise(F.to_json(event)).alias("value")))


EVENTS_SQL = """WITH e AS (SELECT 100 + user_id % 900 AS b, event_id % 100 AS r, 100 + user_id % 900 - event_id % 100 AS s, event_id % 50 = 0 AS corrupt,
  CASE WHEN event_id % 50 <> 0 AND event_id % 77 <> 5 THEN ts END AS t FROM events)"""


def _pct(s: str, b: str) -> str:
    return f"CAST(CASE WHEN {b} > 0 THEN round_even({s}::DOUBLE / {b} * 100, 0) ELSE 0 END AS INTEGER)"


@query(f"""{EVENTS_SQL}, x AS (SELECT count(*) FILTER (NOT corrupt) AS all_queries, CAST(coalesce(sum(r) FILTER (NOT corrupt), 0) AS BIGINT) AS all_returned_tokens, CAST(coalesce(sum(b) FILTER (NOT corrupt), 0) AS BIGINT) AS all_baseline_tokens,
  CAST(coalesce(sum(s) FILTER (NOT corrupt), 0) AS BIGINT) AS all_saved_tokens, count(*) FILTER (corrupt) AS corrupt_lines, CAST(min(t) AS VARCHAR) AS first_at, CAST(max(t) AS VARCHAR) AS last_at FROM e)
SELECT *, {_pct('all_saved_tokens', 'all_baseline_tokens')} AS all_pct FROM x""")
def ledger_rollup(spark: SparkSession, d: str) -> DataFrame:
    out = savings.rollup(_events(spark, d), DAYS, F.lit(AS_OF).cast("timestamp"))
    names = [c for c in out.columns if not c.startswith("window") and not c.endswith("_at")]
    return out.select(*names, F.col("first_at").cast("string").alias("first_at"), F.col("last_at").cast("string").alias("last_at"))


@query(f"""{EVENTS_SQL}, x AS (SELECT count(*) AS window_queries, CAST(coalesce(sum(r), 0) AS BIGINT) AS window_returned_tokens, CAST(coalesce(sum(b), 0) AS BIGINT) AS window_baseline_tokens, CAST(coalesce(sum(s), 0) AS BIGINT) AS window_saved_tokens
  FROM e WHERE NOT corrupt AND t >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY)
SELECT *, {_pct('window_saved_tokens', 'window_baseline_tokens')} AS window_pct FROM x""")
def ledger_window(spark: SparkSession, d: str) -> DataFrame:
    out = savings.rollup(_events(spark, d), DAYS, F.lit(AS_OF).cast("timestamp"))
    return out.select(*[c for c in out.columns if c.startswith("window")])


@query(f"{EVENTS_SQL} SELECT time_bucket(INTERVAL 7 DAY, t, TIMESTAMP '1970-01-01') AS window_start, count(*) AS queries, CAST(sum(r) AS BIGINT) AS returned_tokens, CAST(sum(b) AS BIGINT) AS baseline_tokens_upper, CAST(sum(s) AS BIGINT) AS saved_tokens_upper FROM e WHERE t IS NOT NULL GROUP BY 1")
def ledger_stream_window(spark: SparkSession, d: str) -> DataFrame:
    """All windows, open ones too, as they are after the last batch."""
    windows = ledger.windowed(ledger.timed(_events(spark, d, 1)))
    return _moments(ledger.all_windows(windows, workspace(spark, "ledger"))).drop("window_end")


def _moments(windows: DataFrame) -> DataFrame:
    return windows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


TRAILING_SQL = f"""{EVENTS_SQL}, b AS (SELECT unnest(generate_series(date_trunc('day', (SELECT min(t) FROM e)) - INTERVAL {DAYS - 1} DAY, (SELECT max(t) FROM e), INTERVAL 1 DAY)) AS window_start)
SELECT window_start, window_start + INTERVAL {DAYS} DAY AS window_end, count(*) AS queries, CAST(sum(r) AS BIGINT) AS returned_tokens, CAST(sum(b) AS BIGINT) AS baseline_tokens_upper, CAST(sum(s) AS BIGINT) AS saved_tokens_upper
FROM b JOIN e ON t >= window_start AND t < window_start + INTERVAL {DAYS} DAY WHERE window_start + INTERVAL {DAYS} DAY <= (SELECT max(t) - INTERVAL 1 DAY FROM e) GROUP BY 1"""


@query(TRAILING_SQL)
def ledger_stream_trailing(spark: SparkSession, d: str) -> DataFrame:
    """Sums of the last days for each day that is over."""
    windows = ledger.trailing(ledger.timed(_events(spark, d, 1)), DAYS)
    return _moments(ledger.closed_windows(windows, workspace(spark, "ledger")))


@query(TRAILING_SQL)
def ledger_stream_once(spark: SparkSession, d: str) -> DataFrame:
    """The same of a stream that delivers each event twice."""
    windows = ledger.trailing(ledger.once(ledger.timed(_events(spark, d, 2))), DAYS)
    return _moments(ledger.closed_windows(windows, workspace(spark, "ledger")))


def _new_chunks(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A change set: files f1 to f4 were edited (their chunks with even ids stay, edited) and f5 was deleted."""
    changed = c.where(F.col("path").rlike("/f[1-5][.]txt$"))
    new = changed.where(F.col("path").rlike("/f[1-4][.]txt$") & (F.col("id") % 2 == 0)).withColumn("code", F.concat(F.lit("edited "), F.col("code")))
    return new, changed


@query(rf"""{WITH} SELECT id, path, md5(code) AS code_md5 FROM (
  SELECT id, path, code FROM chunks WHERE NOT regexp_matches(path, '/f[1-5][.]txt$')
  UNION ALL SELECT id, path, concat('edited ', code) FROM chunks WHERE regexp_matches(path, '/f[1-4][.]txt$') AND id % 2 = 0)""")
def incremental_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A base of all chunks and a delta of the changed files, merged as they are read."""
    c = V.chunks(spark, d).select("id", "repo_id", "path", "code")
    new, changed = _new_chunks(c)
    table = store.Table(spark, workspace(spark, "store"), "chunks", c.schema)
    table.replace("all", c)
    table.merge("all", new, changed)
    return table.read("all").select("id", "path", F.md5("code").alias("code_md5"))


@query("""WITH o AS (SELECT concat('d', doc_id) AS path, sha1(text) AS h FROM documents WHERE doc_id % 10 <> 1), n AS (SELECT concat('d', doc_id) AS path, sha1(CASE WHEN doc_id % 10 = 3 THEN concat(text, '!') ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 2)
SELECT path, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM o FULL JOIN n USING (path) WHERE o.h IS DISTINCT FROM n.h""")
def staleness_report(spark: SparkSession, d: str) -> DataFrame:
    rows = V.read(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "doc_id", F.col("text").alias("content"))
    now = rows.where("doc_id % 10 <> 2").withColumn("content", F.when(F.col("doc_id") % 10 == 3, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return staleness.changes(staleness.manifest(rows.where("doc_id % 10 <> 1")), staleness.manifest(now))


@query("""SELECT s_suppkey, registered AND indexed IS NOT NULL AND head IS NOT NULL AND indexed <> head AS stale
FROM (SELECT s_suppkey, s_suppkey % 3 <> 0 AS registered, CASE WHEN s_suppkey % 7 <> 0 THEN sha1(s_name) END AS indexed, CASE WHEN s_suppkey % 5 <> 0 THEN sha1(CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE concat(s_name, '!') END) END AS head FROM supplier)""")
def stale_flags(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    indexed, head = F.when(key % 7 != 0, F.sha1("s_name")), F.when(key % 5 != 0, F.sha1(F.when(key % 2 == 0, F.col("s_name")).otherwise(F.concat("s_name", F.lit("!")))))
    return V.read(spark, d, "supplier").select(key, staleness.is_stale(key % 3 != 0, indexed, head).alias("stale"))


PATH_PARTS = ["", "./", "././", " .\\", "../", "a\\b/", " "]


@query(rf"""SELECT p_partkey, trim(regexp_replace(replace(path, '\', '/'), '^(\./)+', '')) AS path
FROM (SELECT p_partkey, concat((['', './', '././', ' .\', '../', 'a\b/', ' '])[p_partkey % {len(PATH_PARTS)} + 1], p_name, '\x.py ') AS path FROM part)""")
def path_normal(spark: SparkSession, d: str) -> DataFrame:
    start = F.element_at(F.array(*[F.lit(x) for x in PATH_PARTS]), (F.col("p_partkey") % len(PATH_PARTS) + 1).cast("int"))
    return V.read(spark, d, "part").select("p_partkey", S.normal_path(F.concat(start, "p_name", F.lit("\\x.py "))).alias("path"))


EVAL_SQL = f"{WITH}, {V.CASES_SQL.strip()}"
MEANS_SQL = """count(*) AS case_count, count(*) FILTER (passed) AS passed_count, round_even(avg(passed::INT), 6)::DOUBLE AS pass_rate, round_even(avg(recall_at_k), 6)::DOUBLE AS recall_at_k, round_even(avg(mrr), 6)::DOUBLE AS mrr,
  round_even(avg(noise_at_k), 6)::DOUBLE AS noise_at_k, round_even(avg(definition_rank_pass::INT), 6)::DOUBLE AS definition_rank_pass_rate, round_even(avg(symbol_completeness), 6)::DOUBLE AS symbol_completeness"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.case_metrics(V.cases(spark, d), V.case_results(spark, d))


@query(f"{EVAL_SQL} SELECT case_id, must_pass, recall_at_k, mrr, noise_at_k, definition_rank_pass, symbol_completeness, passed FROM verdict")
def eval_case_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).drop("tags", "failed_checks")


@query(f"{EVAL_SQL} SELECT {MEANS_SQL} FROM verdict")
def eval_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return E.aggregate(_metrics(spark, d))


@query(f"{EVAL_SQL} SELECT tag, {MEANS_SQL} FROM (SELECT *, unnest(tags) AS tag FROM verdict) GROUP BY tag")
def eval_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return E.by_tag(_metrics(spark, d))


#: A fixed baseline: what a perfect run would have scored.
PERFECT = {"recall_at_k": 1.0, "mrr": 1.0, "noise_at_k": 0.0, "definition_rank_pass_rate": 1.0, "symbol_completeness": None}


@query(f"""{EVAL_SQL}, a AS (SELECT {MEANS_SQL} FROM verdict)
SELECT * FROM (SELECT 'recall_at_k' AS metric, 1.0::DOUBLE AS baseline, recall_at_k AS current FROM a UNION ALL SELECT 'mrr', 1.0, mrr FROM a UNION ALL SELECT 'definition_rank_pass_rate', 1.0, definition_rank_pass_rate FROM a) WHERE current + 0.05 < baseline
UNION ALL SELECT 'noise_at_k', 0.0, noise_at_k FROM a WHERE noise_at_k - 0.05 > 0.0""")
def eval_regressions(spark: SparkSession, d: str) -> DataFrame:
    perfect = spark.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in PERFECT.items()])
    return E.metric_regressions(E.aggregate(_metrics(spark, d)), perfect, 0.05)


@query(f"{EVAL_SQL} SELECT case_id FROM verdict WHERE must_pass AND NOT passed AND case_id % 4 <> 0")
def eval_unexpected_failures(spark: SparkSession, d: str) -> DataFrame:
    expected = V.cases(spark, d).where("case_id % 4 = 0").select("case_id")
    return E.unexpected_failures(_metrics(spark, d), expected).select("case_id")


@query(f"{EVAL_SQL} SELECT case_id FROM verdict WHERE must_pass AND NOT passed AND case_id < 7")
def eval_flips(spark: SparkSession, d: str) -> DataFrame:
    before = V.cases(spark, d).select("case_id", (F.col("case_id") < 7).alias("passed"))
    return E.flips(_metrics(spark, d), before)


@query(r"SELECT item_id, unnest(list_filter(list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')), lambda t: t <> '')) AS token FROM benchmark")
def query_tokens(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "benchmark").select("item_id", F.explode(S.tokens(F.col("text"))).alias("token"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
