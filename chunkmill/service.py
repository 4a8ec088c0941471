"""The facade: indexing, search, inspection, status, savings and evaluation over one store folder."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkmill.functions import scalar as S
from chunkmill.functions.session import python_path
from chunkmill.operators import evaluate as E
from chunkmill.operators import inspect, savings, search, store, symbol
from chunkmill.operators.chunker import chunk_files
from chunkmill.plans import schema as C
from chunkmill.sources import changes, eval_inputs, git, ledger
from chunkmill.sources.embed import Embedder, embed_query
from chunkmill.sources.repo_files import repo_files, walk
from chunkmill.sources.vectors import Vectors
from chunkmill.streaming import reindex


@dataclass
class Outcome:
    """Always has code; ok mirrors it."""

    code: int
    body: dict = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return self.code == C.OK

    def to_json(self) -> str:
        """The result envelope: one object that always has ok and code."""
        return json.dumps({"ok": self.ok, "code": self.code, **self.body}, default=str)


class NotARepository(ValueError):
    """The path lies in no git working tree."""


def id_of_root(root: str) -> dict:
    norm = root.replace("\\", "/").rstrip("/").lower()
    slug = re.sub(r"[^a-z0-9]+", "-", os.path.basename(norm)).strip("-") or "repo"
    return {"repo_id": f"{slug}-{hashlib.sha1(norm.encode()).hexdigest()[:8]}", "repo_root": root, "normalized_path": norm, "slug": slug}


def repo_id(path: str) -> dict:
    """The repository that a path lies in: any folder of a working tree gives the same id."""
    found = git.top_level(path) if os.path.isdir(path) else None
    if found is None:
        raise NotARepository(f"not in a git repository: {path}")
    return id_of_root(os.path.realpath(found))


def _between(name: str, value: int, low: int, high: int | None) -> None:
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be between {low} and {high}")


class Service:
    def __init__(self, spark: SparkSession, root: str, embedder: Embedder, chunks: store.Snapshots | None = None, registry: store.Snapshots | None = None):
        python_path(spark)
        self.spark, self.root, self.embedder = spark, root, embedder
        self.chunks, self.registry = chunks or store.chunk_table(spark, root), registry or store.registry_table(spark, root)
        self.vectors = Vectors(spark, root, embedder)

    # Indexing

    def index(self, path: str, repo: str | None = None, changed: list[str] | None = None) -> dict:
        """Index a tree, or its changed files; the registry row comes last and makes it count. Without an id, the path's whole repository."""
        if repo is None:
            found = repo_id(path)
            repo, path = found["repo_id"], found["repo_root"]
        files = repo_files(self.spark, path, changed)
        skipped = files.where("skipped is not null").count()
        points = self._points(files.where("skipped is null").select(F.lit(repo).alias("repo_id"), "path", "content"))
        if changed is not None:
            gone = self.spark.createDataFrame([(repo, p) for p in changed], "repo_id string, path string")
            store.merge_into(self.chunks, repo, points, gone)
        else:
            self.chunks.replace(repo, points)
        found = inspect.statistics(self.chunks.read(repo)).orderBy("language").collect()  # a row of each language
        languages = [(r["language"], r["files"], r["chunks"]) for r in found if not r["total"]]
        total = next(({"chunk_count": r["chunks"], "file_count": r["files"]} for r in found if r["total"]), {"chunk_count": 0, "file_count": 0})
        sha = git.head(path)
        row = (repo, sha, datetime.now(UTC).isoformat(), total["chunk_count"], total["file_count"], skipped, languages)
        self.registry.replace(repo, self.spark.createDataFrame([row], C.REGISTRY))
        return {"repo_id": repo, "files": total["file_count"], "chunks": total["chunk_count"], "skipped": skipped, "sha": sha, "incremental": changed is not None, "skipped_scope": "all" if changed is None else "changed"}

    def _points(self, files: DataFrame) -> DataFrame:
        """Chunks with vectors of files (repo_id, path, content) of any number of repositories."""
        rows = files.withColumn("language", S.language_for(F.col("path")))
        chunks = self.vectors.embed(chunk_files(rows, "repo_id"))
        return chunks.select(S.chunk_id(F.col("repo_id"), F.col("path"), F.col("start_byte"), F.col("end_byte")).alias("id"), "repo_id", "path", "language", "start_line", "end_line", F.col("text").alias("code"), "symbol", "vector")

    # Following changes

    def _changes(self) -> str:
        return f"{self.root.rstrip('/')}/changes"

    def changed(self, path: str, paths: list[str]) -> int:
        """Note changed files of a working tree in the log that follow() reads; for a commit hook. The change set's number."""
        at = repo_id(path)
        return changes.append(self.spark, self._changes(), at["repo_id"], at["repo_root"], git.head(path), paths)

    def merge_changes(self, rows: DataFrame, batch: int) -> list[str]:
        """Index a batch of changes (repo_id, repo_path, path, sha, number) of any repositories: files are read, cut and embedded in one plan, and merged once however often the batch comes. The repositories that changed."""
        done = self.chunks.merge_parts(self._points(reindex.contents(rows)), rows.select("repo_id", "path"), ("changes", batch))
        if done:
            now = self.chunks.read(done[0])
            for repo in done[1:]:
                now = now.unionByName(self.chunks.read(repo))
            found = inspect.repositories(now).join(reindex.latest_commit(rows), "repo_id").join(self.registry.read_all().select("repo_id", "skipped_count"), "repo_id", "left")
            moment = F.lit(datetime.now(UTC).isoformat())
            self.registry.put(found.select("repo_id", F.col("sha").alias("indexed_sha"), moment.alias("indexed_at"), "chunk_count", "file_count", F.coalesce("skipped_count", F.lit(0)).alias("skipped_count"), "languages"))
        return done

    def follow(self) -> None:
        """Index what the log of changes holds beyond what was read before."""
        reindex.on_changes(changes.stream(self.spark, self._changes()), self.merge_changes, f"{self.root.rstrip('/')}/changes-read").awaitTermination()

    def reindex(self, path: str, incremental: bool = False) -> dict:
        """Full, or only what changed since the indexed commit; nothing where that is the current one."""
        found = repo_id(path)
        repo, root = found["repo_id"], found["repo_root"]
        status = self.repo_status(root)
        if incremental and status["registered"]:
            if not status["stale"]:
                return {"repo_id": repo, "up_to_date": True}
            if status["changed_files"]:
                return self.index(root, repo, status["changed_files"])
        return self.index(root, repo)

    # Introspection

    def status(self) -> dict:
        return {"status": "ok", "api_version": "1", "embed_model": getattr(self.embedder, "model", "hash"), "embed_dim": self.embedder.dim, "store_connected": self.chunks.reachable()}

    def health(self) -> Outcome:
        return Outcome(C.OK if self.chunks.reachable() else C.UNAVAILABLE, self.status())

    def list_repos(self) -> DataFrame:
        return self.registry.read_all().select("repo_id", "indexed_sha", "indexed_at", "chunk_count").orderBy("repo_id")

    def get_repo(self, repo: str) -> dict | None:
        row = self.registry.read(repo).where(F.col("repo_id") == repo).limit(1).first()
        return None if row is None else row.asDict(recursive=True)

    def stats(self, repo: str) -> dict | None:
        """Counts of a repository as they were registered; None for an unknown one."""
        return self.get_repo(repo)

    def files(self, repo: str, offset: int = 0, limit: int = C.DEFAULT_PAGE, language: str | None = None) -> dict | None:
        _between("offset", offset, 0, None)
        _between("limit", limit, 1, C.MAX_PAGE)
        if self.get_repo(repo) is None:
            return None
        total, rows = inspect.page(inspect.inventory(self.chunks.read(repo)), offset, limit, language)
        found = [r.asDict() for r in rows.orderBy("path").collect()]
        return {"repo_id": repo, "total": total, "offset": offset, "limit": limit, "returned": len(found), "files": found}

    def inspect(self, path: str, files: bool = False, **page) -> dict | None:
        repo = repo_id(path)["repo_id"]
        return self.files(repo, **page) if files else self.stats(repo)

    def repo_status(self, path: str) -> dict:
        """Registered, and stale: indexed at another commit than the tree's."""
        repo, head = repo_id(path)["repo_id"], git.head(path)
        row = self.get_repo(repo)
        sha = row["indexed_sha"] if row else None
        stale = bool(row and sha and head and sha != head)
        changed = git.changed_files(path, sha, head) if stale else ([] if row and sha and head else None)
        return {"repo_id": repo, "registered": row is not None, "indexed_sha": sha, "indexed_at": row["indexed_at"] if row else None, "head_sha": head, "stale": stale, "changed_files": changed}

    # Search

    def search(self, repo: str, q: str, limit: int = C.DEFAULT_LIMIT, best_effort: bool = False) -> DataFrame | None:
        """Ranked hits; None for an unknown repository, none for one without chunks."""
        if not q or not q.strip():
            raise ValueError("the query is blank")
        _between("limit", limit, 1, C.MAX_LIMIT)
        if self.get_repo(repo) is None:
            return None
        try:
            points = self.chunks.read(repo)
            words = F.array(*[F.lit(t) for t in S.query_tokens(q)]).cast("array<string>")
            candidates = search.nearest(points, embed_query(self.embedder, q), max(limit, limit * C.OVERFETCH)).withColumn("query_tokens", words)
            return _hits(search.rank_candidates(candidates, limit)).orderBy("rank")
        except Exception:
            if best_effort:
                return self.spark.createDataFrame([], "path string, language string, start_line int, end_line int, code string, symbol string, score double, rank int")
            raise

    def query(self, q: str, path: str, limit: int = C.DEFAULT_LIMIT) -> Outcome:
        """Search, savings against reading the whole files, and a ledger entry."""
        if not q or not q.strip():
            return Outcome(C.BAD_INPUT, {"message": "the query is blank"})
        try:
            at = repo_id(path)
        except NotARepository as e:
            return Outcome(C.NOT_A_REPO, {"message": str(e)})
        repo, path = at["repo_id"], at["repo_root"]
        found = self.search(repo, q, limit)
        if found is None:
            return Outcome(C.NOT_INDEXED, {"repo_id": repo})
        hits = [r.asDict() for r in found.collect()]
        return self._answer(repo, q, hits, path)

    def _answer(self, repo: str, q: str, hits: list[dict], path: str) -> Outcome:
        block = self._savings_of(hits, path)
        ledger.append(self.spark, self._ledger(repo), {"repo_id": repo, "query": q, "count": len(hits), **{k: block[k] for k in ("returned_tokens", "baseline_tokens_upper", "saved_tokens_upper", "files_counted", "files_missing")}})
        return Outcome(C.OK, {"repo_id": repo, "query": q, "count": len(hits), "results": hits, "savings": block})

    def _savings_of(self, hits: list[dict], path: str) -> dict:
        """Plain arithmetic on the driver: a response has at most MAX_LIMIT hits."""
        tokens = lambda t: -(-len(t) // C.CHARS_PER_TOKEN)
        returned, baseline, counted, missing = sum(tokens(h["code"] or "") for h in hits), 0, 0, 0
        for p in dict.fromkeys(h["path"] for h in hits if (h["path"] or "").strip()):
            try:
                with open(os.path.join(path, p), encoding="utf-8", errors="replace") as source:
                    baseline, counted = baseline + tokens(source.read()), counted + 1
            except OSError:
                missing += 1
        saved = max(0, baseline - returned)
        return {"returned_tokens": returned, "baseline_tokens_upper": baseline, "saved_tokens_upper": saved, "pct_upper": round(saved / baseline * 100) if baseline else 0, "files_counted": counted, "files_missing": missing, "basis": "whole files of the hits, 4 characters a token"}

    def symbol_search(self, path: str, identifier: str) -> DataFrame:
        """Exact identifiers in the working tree as it is now: tracked and untracked files of a git repository, else all files."""
        listed = git.tracked_and_untracked(path)
        return symbol.symbol_hits(_tree(self.spark, path, listed), identifier)

    def smart_search(self, q: str, path: str, limit: int = C.DEFAULT_LIMIT, mode: str = "semantic", identifier: str | None = None, may_index: bool = True) -> Outcome:
        """Search with fallbacks: without a store, an index or hits the caller is told to search the workspace; that is no failure."""
        try:
            found = repo_id(path)
        except NotARepository as e:
            return Outcome(C.NOT_A_REPO, {"message": str(e)})
        repo, path = found["repo_id"], found["repo_root"]
        if not (identifier or q or "").strip():
            return Outcome(C.BAD_INPUT, {"message": "the query is blank"})
        out = {"repo_id": repo, "query": q, "mode": mode, "count": 0, "results": [], "savings": None, "used_index": False, "fallback_reason": None, "fallback_message": None, "next_action": None, "indexed_this_run": False, "index_result": None, "index_stale": False, "changed_files_not_indexed": None}
        if mode == "symbol":
            found = self.symbol_search(path, identifier or q)
            hits = [r.asDict() for r in found.limit(C.MOST_RESULTS + 1).collect()]
            more = {}
            if len(hits) > C.MOST_RESULTS:  # all are in a table, the first ones here
                where = f"{self.root.rstrip('/')}/results/{uuid.uuid4().hex}"
                found.write.parquet(where)
                written = self.spark.read.parquet(where)
                more = {"count": written.count(), "results_path": where}
                hits = [r.asDict() for r in written.orderBy("path", "start_line").limit(C.MOST_RESULTS).collect()]
            hits.sort(key=lambda h: (h["path"], h["start_line"]))
            return Outcome(C.OK, out | {"count": len(hits), "results": hits, "used_index": True, "savings": self._savings_of([], path)} | more)
        fall = lambda reason, text: Outcome(C.OK, out | {"fallback_reason": reason, "fallback_message": text, "next_action": "workspace_search"})
        if not self.health().ok:
            return fall("store_unavailable", "the store can't be reached")
        status = self.repo_status(path)
        out |= {"index_stale": status["stale"], "changed_files_not_indexed": status["changed_files"]}
        if not status["registered"]:
            if not may_index:
                return fall("indexing_declined", "the repository isn't indexed")
            out |= {"index_result": self.index(path, repo), "indexed_this_run": True}
        answer = self.query(q, path, limit)
        if not answer.ok:
            return Outcome(answer.code, out | answer.body)
        if not answer.body["count"]:
            return fall("no_semantic_hits", "nothing was found")
        return Outcome(C.OK, out | {k: answer.body[k] for k in ("count", "results", "savings")} | {"used_index": True})

    # Ledger and evaluation

    def _ledger(self, repo: str) -> str:
        return f"{self.root.rstrip('/')}/ledger/{repo}"

    def savings(self, repo: str, days: int = C.DEFAULT_DAYS, as_of: datetime | None = None) -> dict:
        _between("days", days, 1, C.MAX_DAYS)
        moment = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
        return savings.rollup(ledger.read(self.spark, self._ledger(repo)), days, moment).first().asDict()

    def compact_ledger(self, repo: str) -> int:
        """Fold the files of single searches into one table; how many there were."""
        return ledger.compact(self.spark, self._ledger(repo))

    def run_evaluation(self, cases: DataFrame, path: str, baseline: dict | None = None, tolerance: float = C.EVAL_TOLERANCE, update: str | None = None) -> dict:
        """Run every case (a hand-written list) against an indexed tree and evaluate; update names a baseline file to write.

        Semantic cases with the same limit are one search; a tree that isn't indexed is indexed first.
        """
        at = repo_id(path)
        repo, root = at["repo_id"], at["repo_root"]
        found, asked = [], {}
        for case in cases.collect():
            if case["mode"] == "symbol":
                answer = self.smart_search(case["query"], root, mode="symbol", identifier=case["query"])
                found += [(case["case_id"], k + 1, h["path"]) for k, h in enumerate(answer.body.get("results") or [])]
            elif (case["query"] or "").strip():
                asked.setdefault(min(C.MAX_LIMIT, max(case["k"], C.DEFAULT_LIMIT)), []).append((case["case_id"], case["query"]))
        if asked and self.get_repo(repo) is None:
            self.index(root, repo)
        for limit, own in asked.items():
            rows = [(k, [float(x) for x in embed_query(self.embedder, q)], S.query_tokens(q)) for k, (_, q) in enumerate(own)]
            queries = self.spark.createDataFrame(rows, "query_id int, query_vector array<double>, query_tokens array<string>")
            hits: dict[int, list[dict]] = {k: [] for k in range(len(own))}
            ranked = search.semantic_search(self.chunks.read(repo), queries, limit)
            for r in _hits(ranked, "query_id").orderBy("query_id", "rank").collect():
                hits[r["query_id"]].append(r.asDict())
            for k, (case_id, q) in enumerate(own):
                self._answer(repo, q, hits[k], root)
                found += [(case_id, h["rank"], h["path"]) for h in hits[k]]
        results = self.spark.createDataFrame(found, "case_id string, rank int, path string").withColumn("path", S.normal_path(F.col("path")))
        frames = {} if baseline is None else eval_inputs.baseline_frames(self.spark, baseline)
        report = self.evaluate(cases, results, tolerance=tolerance, **frames)
        if update:
            eval_inputs.write_baseline(update, report)
        return report

    def evaluate(self, cases: DataFrame, results: DataFrame, baseline: DataFrame | None = None, baseline_cases: DataFrame | None = None, expected_failures: DataFrame | None = None, tolerance: float = C.EVAL_TOLERANCE) -> dict:
        """Metrics, rollups and the gate; code 1 on a regression or an unexpected failure."""
        metrics = E.case_metrics(cases, results)
        total = E.aggregate(metrics)
        worse = [] if baseline is None else [r.asDict() for r in E.metric_regressions(total, baseline, tolerance).collect()]
        worse += [] if baseline_cases is None else [r.asDict() for r in E.flips(metrics, baseline_cases).collect()]
        none = cases.select("case_id").limit(0) if expected_failures is None else expected_failures
        failed = [r["case_id"] for r in E.unexpected_failures(metrics, none).collect()]
        return {"code": int(bool(worse or failed)), "cases": metrics, "aggregate": total, "by_tag": E.by_tag(metrics), "regressions": worse, "unexpected_must_pass_failures": failed}


def _hits(ranked: DataFrame, *more: str) -> DataFrame:
    """Hits with the defaults of missing values: empty path and code, line 0."""
    filled = [F.coalesce("path", F.lit("")).alias("path"), "language", F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", F.lit(0)).alias("end_line"), F.coalesce("code", F.lit("")).alias("code")]
    return ranked.select(*more, *filled, "symbol", "score", "rank")


def _tree(spark: SparkSession, path: str, listed: list[str] | None) -> DataFrame:
    """(path, content) of any kind of text file, read in tasks."""
    names = list(walk(path)) if listed is None else listed

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for name in batch.column("path").to_pylist():
                try:
                    with open(os.path.join(path, name), "rb") as source:
                        rows.append((name, source.read()))
                except OSError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["path", "content"])

    return spark.createDataFrame([(n,) for n in names], "path string").mapInArrow(read, "path string, content binary")
