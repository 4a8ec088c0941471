"""Command line: index a tree, in the background if wanted, poll such a job, search, follow changes, inspect, sum up savings, and evaluate.

Prints one JSON object and ends with the outcome's code.
"""

from __future__ import annotations

import argparse
import os
import sys

from chunkmill import jobs
from chunkmill.plans import schema as C
from chunkmill.service import NotARepository, Outcome, Service, repo_id
from chunkmill.sources import eval_inputs
from chunkmill.sources.embed import HashEmbedder, HttpEmbedder


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="chunkmill", description="Code search over a store folder.")
    parser.add_argument("--store", default=os.environ.get("CHUNKMILL_STORE", "chunkmill-store"), help="store folder")
    parser.add_argument("--embedder-url", default=os.environ.get("CHUNKMILL_EMBEDDER"), help="embedding service; without it, words are hashed")
    parser.add_argument("--verbose", action="store_true")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="index a tree or its changed files")
    index.add_argument("--repo-path", default=".")
    index.add_argument("--repo-id", help="id of the repository; derived from the path's git root without it")
    index.add_argument("--changed-file", action="append", dest="changed", help="a path that is read again, and only such are; may be repeated")
    index.add_argument("--background", action="store_true", help="start a job and print its id")
    job = commands.add_parser("job", help="state of a background job")
    job.add_argument("job_id")
    job.add_argument("--keep", action="store_true", help="keep the job's folder after it has ended")
    for name, text in (("status", "is the index behind the tree?"), ("repo-id", "id of a path's repository")):
        commands.add_parser(name, help=text).add_argument("path", nargs="?", default=".")
    query = commands.add_parser("query", help="search")
    query.add_argument("text")
    query.add_argument("--path", default=".")
    query.add_argument("--limit", type=int, default=C.DEFAULT_LIMIT)
    query.add_argument("--symbol", action="store_true", help="exact identifier instead of meaning")
    at = lambda name, text: _with_path(commands.add_parser(name, help=text))
    at("savings", "tokens saved, of all time and of the last days").add_argument("--days", type=int, default=C.DEFAULT_DAYS)
    files = at("inspect", "counts of a repository, or a page of its files")
    files.add_argument("--files", action="store_true")
    files.add_argument("--language")
    files.add_argument("--offset", type=int, default=0)
    files.add_argument("--limit", type=int, default=C.DEFAULT_PAGE)
    commands.add_parser("health", help="can the store be reached?")
    commands.add_parser("list", help="indexed repositories")
    commands.add_parser("follow", help="index what the log of changes holds")
    at("changed", "note changed files in the log; for commit hooks").add_argument("--changed-file", action="append", dest="changed", required=True)
    evaluation = at("evaluate", "run cases and compare with a baseline")
    evaluation.add_argument("--cases", required=True)
    evaluation.add_argument("--baseline")
    evaluation.add_argument("--update-baseline")
    evaluation.add_argument("--tolerance", type=float, default=C.EVAL_TOLERANCE)
    return parser


def _with_path(parser: argparse.ArgumentParser) -> argparse.ArgumentParser:
    parser.add_argument("--path", default=".")
    return parser


def _savings(service: Service, told) -> Outcome:
    return Outcome(C.OK, service.savings(repo_id(told.path)["repo_id"], told.days))


def _inspect(service: Service, told) -> Outcome:
    page = {"language": told.language, "offset": told.offset, "limit": told.limit} if told.files else {}
    found = service.inspect(told.path, told.files, **page)
    return Outcome(C.NOT_INDEXED, {"path": told.path}) if found is None else Outcome(C.OK, found)


def _list(service: Service, told) -> Outcome:
    return Outcome(C.OK, {"repos": [r.asDict() for r in service.list_repos().collect()]})


def _follow(service: Service, told) -> Outcome:
    service.follow()
    return Outcome(C.OK)


def _changed(service: Service, told) -> Outcome:
    return Outcome(C.OK, {"number": service.changed(told.path, told.changed)})


def _evaluate(service: Service, told) -> Outcome:
    cases = eval_inputs.load_cases(service.spark, told.cases)
    baseline = eval_inputs.load(told.baseline) if told.baseline else None
    report = service.run_evaluation(cases, told.path, baseline, told.tolerance, told.update_baseline)
    shown = {k: report[k] for k in ("regressions", "unexpected_must_pass_failures")}
    return Outcome(report["code"], shown | {"aggregate": report["aggregate"].first().asDict(), "cases": [r.asDict(recursive=True) for r in report["cases"].collect()]})


#: Commands that need nothing but the service and what was told.
COMMANDS = {"savings": _savings, "inspect": _inspect, "list": _list, "follow": _follow, "changed": _changed, "evaluate": _evaluate, "health": lambda service, told: service.health()}


def run(arguments: list[str], spark=None) -> Outcome:
    told = _parser().parse_args(arguments)
    folder = os.path.join(told.store, "jobs")
    if told.command == "job":
        return Outcome(C.OK, jobs.status(folder, told.job_id, told.keep))
    try:
        if told.command == "repo-id":
            return Outcome(C.OK, repo_id(told.path))
        if told.command == "index" and told.background:
            command = [sys.executable, "-m", "chunkmill.cli", *(a for a in arguments if a != "--background")]
            return Outcome(C.OK, {"job_id": jobs.start(folder, command), "done": False})
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("chunkmill").getOrCreate()
            spark.sparkContext.setLogLevel("INFO" if told.verbose else "ERROR")
        service = Service(spark, told.store, HttpEmbedder(told.embedder_url) if told.embedder_url else HashEmbedder())
        if told.command == "index":
            return Outcome(C.OK, service.index(told.repo_path, told.repo_id, told.changed))
        if told.command in COMMANDS:
            return COMMANDS[told.command](service, told)
        if told.command == "status":
            return Outcome(C.OK, service.repo_status(told.path))
        return service.smart_search(told.text, told.path, told.limit, "symbol" if told.symbol else "semantic")
    except NotARepository as e:
        return Outcome(C.NOT_A_REPO, {"message": str(e)})
    except ValueError as e:
        return Outcome(C.BAD_INPUT, {"message": str(e)})


def main() -> int:
    outcome = run(sys.argv[1:])
    print(outcome.to_json())
    return outcome.code


if __name__ == "__main__":
    raise SystemExit(main())
