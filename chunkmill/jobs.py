"""Background jobs: a command in its own process, and its state by the job's id.

A job is a folder with the process's number, its output and, once it has ended, its exit code. Asking for the state of a job
that has ended removes the folder unless it's to be kept; a job without a folder is gone: it has ended and was removed.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
import uuid


def _read(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8") as source:
            return source.read().strip() or None
    except FileNotFoundError:
        return None


def start(folder: str, command: list[str]) -> str:
    """Start a command; returns the job's id."""
    job = uuid.uuid4().hex[:12]
    home = os.path.join(folder, job)
    os.makedirs(home)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = {**os.environ, "PYTHONPATH": os.pathsep.join(filter(None, [root, os.environ.get("PYTHONPATH")]))}
    with open(os.path.join(home, "output"), "wb") as out:
        process = subprocess.Popen([sys.executable, "-m", "chunkmill.jobs", home, *command], stdin=subprocess.DEVNULL, stdout=out, stderr=out, start_new_session=True, env=environment)
    with open(os.path.join(home, "process"), "w", encoding="utf-8") as out:
        out.write(str(process.pid))
    return job


def status(folder: str, job: str, keep: bool = False) -> dict:
    """job_id, state (running, exited, dead or gone), exit_code (null while it runs or is unknown), done."""
    home = os.path.join(folder, job)
    code, process = _read(os.path.join(home, "code")), _read(os.path.join(home, "process"))
    if code is not None:
        state = "exited"
    elif not os.path.isdir(home):
        state = "gone"
    else:
        state = "running" if process is None or _alive(int(process)) else "dead"
    done = state != "running"
    if state in ("exited", "dead") and not keep:
        shutil.rmtree(home, ignore_errors=True)
    return {"job_id": job, "state": state, "exit_code": None if code is None else int(code), "done": done}


def output(folder: str, job: str) -> str | None:
    """What a job that is kept, or still runs, has printed."""
    return _read(os.path.join(folder, job, "output"))


def _alive(process: int) -> bool:
    try:
        if os.waitpid(process, os.WNOHANG)[0] == process:
            return False
    except ChildProcessError:
        pass
    try:
        os.kill(process, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


def _run(home: str, command: list[str]) -> int:
    code = subprocess.run(command, check=False).returncode
    part = os.path.join(home, "code.part")
    with open(part, "w", encoding="utf-8") as out:
        out.write(str(code))
    os.replace(part, os.path.join(home, "code"))
    return code


if __name__ == "__main__":
    raise SystemExit(_run(sys.argv[1], sys.argv[2:]))
