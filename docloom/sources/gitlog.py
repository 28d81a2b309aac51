"""Git history as a Spark data source, read with the git command on the executors.

``format("gitlog")`` with ``path`` (one repository, on storage that all executors reach) and ``table``:

* ``commits`` (default): oid, parent_oid, commit_ts, walk_ordinal; all commits reachable from HEAD, those found so far newest first (by time alone, whatever is whose parent).
* ``added_lines``: oid, commit_ts, walk_ordinal, new_path, old_path, is_binary, origin, line_number, content; the
  lines that each commit adds against its first parent (a root commit against the empty tree).

``since`` (epoch seconds) ends the walk at the first older commit. ``partitions`` deals commits to so many tasks.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docloom.config import GitOperationError, RepositoryNotFound

COMMITS = "repo string, oid string, parent_oid string, commit_ts bigint, walk_ordinal bigint"
ADDED = "repo string, oid string, commit_ts bigint, walk_ordinal bigint, new_path string, old_path string, is_binary boolean, origin string, line_number int, content string"
_HUNK = re.compile(rb"@@ -\d+(?:,\d+)? \+(\d+)")


def git(repo: str, *args: str) -> bytes:
    got = subprocess.run(["git", "-c", "safe.directory=*", "-c", "core.quotepath=off", "-C", repo, *args], capture_output=True)
    if got.returncode:
        raise GitOperationError(f"{repo}: {got.stderr.decode('utf-8', 'replace').strip()}")
    return got.stdout


def check_repository(repo: str) -> None:
    """The path itself must be a repository; none above it is looked for."""
    path = repo.strip()
    if not (os.path.exists(os.path.join(path, ".git")) or os.path.exists(os.path.join(path, "HEAD"))):
        raise RepositoryNotFound(path)


def walk(repo: str, since: int | None = None) -> Iterator[tuple[str, str | None, int, int]]:
    """(oid, first parent, time, ordinal), newest first, up to the first commit older than ``since``; none for a repository without commits."""
    check_repository(repo)
    probe = subprocess.run(["git", "-c", "safe.directory=*", "-C", repo.strip(), "rev-parse", "--verify", "-q", "HEAD"], capture_output=True)
    if probe.returncode:
        return
    for k, line in enumerate(git(repo.strip(), "log", "--format=%H %ct %P", "HEAD").decode().splitlines()):
        oid, ts, *parents = line.split()
        if since is not None and int(ts) < since:
            return
        yield oid, parents[0] if parents else None, int(ts), k


def _unquote(path: bytes) -> str:
    if path.startswith(b'"') and path.endswith(b'"'):
        path = re.sub(rb"\\([0-7]{3}|.)", lambda m: bytes([int(m[1], 8)]) if m[1][:1].isdigit() else {b"n": b"\n", b"t": b"\t"}.get(m[1], m[1]), path[1:-1])
    return path.decode("utf-8", "replace")


def added_lines(repo: str, oid: str) -> Iterator[tuple[str | None, str | None, int, str]]:
    """(new path, old path, line number, content) of the lines that a commit adds against its first parent."""
    flags = ("--root", "-p", "-U0", "--no-renames", "--no-indent-heuristic", "--no-ext-diff", "--no-textconv", "--diff-merges=first-parent", "--format=")
    old = new = None
    number, left = 0, 0
    for line in git(repo.strip(), "show", *flags, oid).split(b"\n"):
        if left == 0 and line.startswith(b"diff --git "):
            old = new = None
        elif left == 0 and line.startswith(b"--- "):
            old = None if line == b"--- /dev/null" else _unquote(line[4:].rstrip(b"\t")).removeprefix("a/")
        elif left == 0 and line.startswith(b"+++ "):
            new = None if line == b"+++ /dev/null" else _unquote(line[4:].rstrip(b"\t")).removeprefix("b/")
        elif left == 0 and (m := _HUNK.match(line)):
            number = int(m[1])
            sizes = re.match(rb"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))?", line)
            left = int(sizes[1] or 1) + int(sizes[2] or 1)  # type: ignore[index]
        elif left and line.startswith(b"+"):
            yield new, old, number, line[1:].decode("utf-8", "replace")
            number, left = number + 1, left - 1
        elif left and line.startswith(b"-"):
            left -= 1


class _Range(InputPartition):
    def __init__(self, commits: list[tuple[str, str | None, int, int]]):
        self.commits = commits


class GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.repo = options["path"]
        self.table = options.get("table", "commits")
        self.since = int(options["since"]) if options.get("since") else None
        self.tasks = int(options.get("partitions", "8"))

    def partitions(self) -> list[InputPartition]:
        found = list(walk(self.repo, self.since))
        size = max(1, -(-len(found) // self.tasks))
        return [_Range(found[a : a + size]) for a in range(0, len(found), size)] or [_Range([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        repo = self.repo.strip()
        for oid, parent, ts, k in partition.commits:  # type: ignore[attr-defined]
            if self.table == "commits":
                yield repo, oid, parent, ts, k
            else:
                for new, old, number, content in added_lines(repo, oid):
                    yield repo, oid, ts, k, new, old, False, "+", number, content


class GitLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        table = self.options.get("table", "commits")
        if table not in ("commits", "added_lines"):
            raise ValueError(f"no table named {table}")
        return COMMITS if table == "commits" else ADDED

    def reader(self, schema) -> DataSourceReader:
        return GitReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitLogSource)
