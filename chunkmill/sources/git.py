"""What git says about a working tree; every answer may be None."""

from __future__ import annotations

import subprocess


def _git(root: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def head(root: str) -> str | None:
    return (_git(root, "rev-parse", "HEAD") or "").strip() or None


def top_level(root: str) -> str | None:
    return (_git(root, "rev-parse", "--show-toplevel") or "").strip() or None


def changed_files(root: str, indexed: str, now: str) -> list[str] | None:
    """Paths that differ between two commits, both names of a rename; None if the first commit is unknown."""
    if _git(root, "cat-file", "-e", indexed + "^{commit}") is None:
        return None
    out = _git(root, "diff", "--name-only", "--no-renames", "-z", indexed, now)
    return None if out is None else [p for p in out.split("\0") if p]


def tracked_and_untracked(root: str) -> list[str] | None:
    """Files of the tree that aren't ignored."""
    out = _git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard")
    return None if out is None else [p for p in out.split("\0") if p]
