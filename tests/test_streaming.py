"""Streams of changed files and of ledger events: batches that come again, many repositories at once, late and repeated events."""

import json
import threading
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chunkmill.operators.savings import parse_ledger
from chunkmill.service import Service, id_of_root
from chunkmill.sources import changes
from chunkmill.sources.embed import HashEmbedder
from chunkmill.streaming import ledger

START = datetime(2024, 3, 1, tzinfo=UTC)


# Changed files


def tree(path, files):
    for name, text in files.items():
        (path / name).parent.mkdir(parents=True, exist_ok=True)
        (path / name).write_text(text)
    return str(path)


@pytest.fixture
def two(spark, tmp_path):
    """A service over two indexed trees."""
    service = Service(spark, str(tmp_path / "store"), HashEmbedder(16))
    roots = [tree(tmp_path / name, {"a.py": "def one():\n    return 1\n", "b.py": "def two():\n    return 2\n"}) for name in ("left", "right")]
    repos = [id_of_root(r)["repo_id"] for r in roots]
    for repo, root in zip(repos, roots, strict=True):
        service.index(root, repo)
    return service, roots, repos


def note(service, repo, root, sha, *paths):
    return changes.append(service.spark, service._changes(), repo, root, sha, list(paths))


def symbols(service, repo):
    return sorted(r["symbol"] for r in service.chunks.read(repo).collect())


def test_changes_of_many_repositories_in_one_batch(two, tmp_path):
    service, roots, repos = two
    tree(tmp_path / "left", {"a.py": "def one():\n    return 1\n\ndef uno():\n    return 1\n", "node_modules/x.py": "def no(): pass\n", "new.txt": "text"})
    (tmp_path / "right" / "b.py").unlink()
    note(service, repos[0], roots[0], "sha1", "a.py", "node_modules/x.py")
    note(service, repos[0], roots[0], "sha2", "a.py", "new.txt")
    note(service, repos[1], roots[1], "sha3", "b.py", "never.py")
    before = {r: service.chunks.version(r) for r in repos}
    service.follow()
    assert symbols(service, repos[0]) == ["one", "two", "uno"] and symbols(service, repos[1]) == ["one"]
    assert {r: service.chunks.version(r) - before[r] for r in repos} == dict.fromkeys(repos, 1)
    left, right = (service.get_repo(r) for r in repos)
    assert (left["indexed_sha"], left["chunk_count"], left["file_count"]) == ("sha2", 3, 2) and (right["indexed_sha"], right["chunk_count"]) == ("sha3", 1)
    assert service.search(repos[0], "uno", 3).first()["path"] == "a.py"
    versions = {r: service.chunks.version(r) for r in repos}
    service.follow()  # nothing new
    assert {r: service.chunks.version(r) for r in repos} == versions
    tree(tmp_path / "right", {"b.py": "def back():\n    return 2\n"})
    note(service, repos[1], roots[1], "sha4", "b.py")
    service.follow()
    assert symbols(service, repos[1]) == ["back", "one"] and service.chunks.version(repos[0]) == versions[repos[0]]


def test_a_batch_that_comes_again_changes_nothing(spark, two, tmp_path):
    service, roots, repos = two
    tree(tmp_path / "left", {"a.py": "def other():\n    return 1\n"})
    rows = spark.createDataFrame([(repos[0], roots[0], "a.py", "s", 1)], "repo_id string, repo_path string, path string, sha string, number long")
    assert service.merge_changes(rows, 7) == [repos[0]]
    found, version = symbols(service, repos[0]), service.chunks.version(repos[0])
    tree(tmp_path / "left", {"a.py": "def later():\n    return 1\n"})
    assert service.merge_changes(rows, 7) == [] == service.merge_changes(rows, 6)
    assert (symbols(service, repos[0]), service.chunks.version(repos[0])) == (found, version) and service.chunks.holds(repos[0], ("changes", 7))
    service.chunks.compact(repos[0])
    assert service.merge_changes(rows, 7) == [] and symbols(service, repos[0]) == found == ["other", "two"]
    assert service.merge_changes(rows, 8) == [repos[0]] and symbols(service, repos[0]) == ["later", "two"]
    assert service.chunks.vacuum(repos[0], older_than=-1) > 0 and symbols(service, repos[0]) == ["later", "two"]
    assert service.merge_changes(rows.limit(0), 9) == []


def test_half_of_a_batch_is_made_up_for(spark, two):
    """A failure between two repositories' commits: the batch comes again, and only the other one is merged."""
    service, roots, repos = two
    rows = spark.createDataFrame([(r, p, "a.py", "s", 1) for r, p in zip(repos, roots, strict=True)], "repo_id string, repo_path string, path string, sha string, number long")
    commit, calls = service.chunks._commit, []

    def failing(part, *rest):
        calls.append(part)
        if len(calls) == 2:
            raise OSError("gone")
        return commit(part, *rest)

    service.chunks._commit = failing
    with pytest.raises(OSError):
        service.merge_changes(rows, 1)
    service.chunks._commit = commit
    assert service.merge_changes(rows, 1) == [calls[1]]
    assert all(symbols(service, r) == ["one", "two"] for r in repos)


def test_numbers_of_the_log_have_no_gaps(spark, tmp_path):
    folder, got = str(tmp_path / "log"), []
    threads = [threading.Thread(target=lambda k=k: got.append(changes.append(spark, folder, f"r{k}", "/r", None, [f"{k}.py"]))) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == list(range(1, 9))
    seen = []
    query = changes.stream(spark, folder).writeStream.foreachBatch(lambda rows, _: seen.extend(r["path"] for r in rows.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(seen) == [f"{k}.py" for k in range(8)]


# Ledger events


def line(number, hours, tokens=10, **more):
    return json.dumps({"event_id": str(number), "ts": (START + timedelta(hours=hours)).isoformat(), "repo_id": "r", "returned_tokens": tokens, "baseline_tokens_upper": 10 * tokens, "saved_tokens_upper": 9 * tokens} | more)


def run_batches(spark, tmp_path, batches, build):
    """One file and one run of the query for each batch of lines; the windows that were written, by start."""
    folder = tmp_path / "lines"
    folder.mkdir()
    for k, lines in enumerate(batches):
        (folder / f"{k}.jsonl").write_text("\n".join(lines) + "\n")
        stream = build(ledger.timed(parse_ledger(spark.readStream.schema("value string").text(str(folder)))))
        ledger.append_windows(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()
    assert len({r["window_start"] for r in rows}) == len(rows)  # each window once
    return {r["window_start"].replace(tzinfo=UTC) - START: (r["queries"], r["returned_tokens"]) for r in rows}


def test_trailing_windows_and_late_events(spark, tmp_path):
    """Three-day windows, a day apart: late events count while their window is open, and are left out once it is written."""
    batches = [
        [line(1, 1), line(2, 30), line(3, 50), "not json", '{"returned_tokens": 5}', line(4, 3, ts="yesterday")],
        [line(5, 2), line(6, 24 * 6)],  # event 5 is late for the first window alone, which ended a day before event 3
        [line(7, 24), line(8, 24 * 9)],  # event 7 is older than the watermark
        [line(9, 24 * 30)],
    ]
    got = run_batches(spark, tmp_path, batches, lambda rows: ledger.trailing(rows, 3))
    day = timedelta(days=1)
    assert got[-2 * day] == (1, 10) and got[-1 * day] == (3, 30) and got[0 * day] == (4, 40) and got[1 * day] == (2, 20)
    assert got[4 * day] == (1, 10) and got[9 * day] == (1, 10) and 28 * day not in got


def test_repeated_events_count_once(spark, tmp_path):
    """Within a batch, in later batches, without ids: the windows equal those of each event once."""
    own = [line(k, 5 * k, k + 1) for k in range(30)]
    plain = [line(None, 7 * k, k) for k in range(1, 8)]
    plain = [p.replace('"event_id": "None", ', "") for p in plain]
    close = [line(99, 24 * 40)]
    (tmp_path / "once").mkdir()
    (tmp_path / "twice").mkdir()
    want = run_batches(spark, tmp_path / "once", [own + plain, close], ledger.windowed)
    got = run_batches(spark, tmp_path / "twice", [own + own[:20] + plain, own[5:] + plain, own, close], lambda rows: ledger.windowed(ledger.once(rows)))
    assert got == want and sum(n for n, _ in want.values()) == 37


def test_all_windows_with_open_ones(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "1.jsonl").write_text("\n".join([line(1, 1), line(2, 24 * 8)]))
    events = parse_ledger(spark.readStream.schema("value string").text(str(tmp_path / "lines")))
    found = ledger.all_windows(ledger.windowed(ledger.timed(events)), str(tmp_path / "all"))
    assert found.agg(F.sum("queries")).first()[0] == 2 and found.count() == 2
    batch = ledger.windowed(ledger.timed(parse_ledger(spark.read.text(str(tmp_path / "lines")))))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect()))
