import subprocess
import time

import pytest

from docloom.config import GitOperationError, RepositoryNotFound, ReportOptions
from docloom.plans.engine import Engine, EngineConfig

DAY = 86400


class Repo:
    def __init__(self, path):
        self.path = path
        self.now = int(time.time())
        self.git("init", "-q", "-b", "main")

    def git(self, *args, age=0):
        when = f"{self.now - int(age)} +0000"
        env = {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b", "HOME": "/tmp", "PATH": "/usr/bin:/bin"}
        return subprocess.run(["git", *args], cwd=self.path, env=env, check=True, capture_output=True).stdout.decode().strip()

    def commit(self, path, content, age):
        f = self.path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(content if isinstance(content, bytes) else content.encode())
        self.git("add", "-A")
        self.git("commit", "-q", "-m", "c", age=age)


@pytest.fixture
def repo(tmp_path):
    return Repo(tmp_path)


@pytest.fixture
def engine(spark):
    return Engine(spark, EngineConfig(b"model", b"dict"))


def lines(engine, repo, days, extensions=None):
    got = engine.added_lines(ReportOptions(str(repo.path), days, extensions)).collect()
    return sorted((r["path"], r["line_number"], r["content"]) for r in got)


def test_window(engine, repo):
    repo.commit("README.md", "initial\n", 3 * DAY)
    repo.commit("README.md", "update\n", DAY / 2)
    assert engine.commits(ReportOptions(str(repo.path), 2)).count() == 1
    assert lines(engine, repo, 2) == [("README.md", 1, "update")]


def test_across_commits_and_sorted(engine, repo):
    repo.commit("docs/notes.md", "# Title\n\n- base\n", 5 * DAY)
    repo.commit("docs/notes.md", "# Title\n\n- base\n- feature a\n", DAY / 2)
    repo.commit("docs/notes.md", "# Title\n\n- base\n- feature a\n- feature b\n", 60)
    assert lines(engine, repo, 1, (".md",)) == [("docs/notes.md", 4, "- feature a"), ("docs/notes.md", 5, "- feature b")]
    assert len(lines(engine, repo, 7)) == 5


def test_deletions_binaries_and_other_files_are_left_out(engine, repo):
    repo.commit("notes.md", "line1\nline2\n", 4 * DAY)
    repo.commit("notes.md", "line1\n", 100)
    assert lines(engine, repo, 1) == []
    repo.commit("binary.md", bytes([0, 0x9F, 0x92, 0x96, 0]), 50)
    repo.commit("notes.txt", "text\n", 40)
    repo.commit("日本 語.md", "+++ x\n--- y\n", 30)
    assert lines(engine, repo, 1) == [("日本 語.md", 1, "+++ x"), ("日本 語.md", 2, "--- y")]


def test_merge_counts_against_its_first_parent(engine, repo):
    repo.commit("base.md", "base\n", 5 * DAY)
    repo.git("checkout", "-q", "-b", "feature")
    repo.commit("feature.md", "feature line\n", 4 * DAY)
    repo.git("checkout", "-q", "main")
    repo.commit("main.md", "main line\n", DAY)
    repo.git("merge", "-q", "--no-ff", "-m", "m", "feature", age=0)
    assert ("feature.md", 1, "feature line") in lines(engine, repo, 2)


def test_missing_and_empty_repositories(engine, repo, tmp_path):
    with pytest.raises(RepositoryNotFound):
        engine.generate_git_report(ReportOptions("./path/does/not/exist", 1))
    assert engine.commits(ReportOptions(str(repo.path), 7)).count() == 0
    assert "No Markdown changes detected" in engine.generate_git_report(ReportOptions(str(repo.path), 7))
    got = engine.run_git_native_rag(ReportOptions(str(repo.path), 7))
    assert got["kind"] == "FALLBACK" and "No relevant" in got["message"]


def test_lost_object(engine, repo):
    repo.commit("a.md", "x\n", 10)
    oid = repo.git("rev-parse", "HEAD")
    (repo.path / ".git" / "objects" / oid[:2] / oid[2:]).unlink()
    with pytest.raises(Exception, match=r"(?s)" + str(repo.path)):
        lines(engine, repo, 1)
    assert issubclass(GitOperationError, Exception)


def test_rag(engine, repo):
    text = "# Title\n\n## Summary\n- initial\n"
    repo.commit("docs/changelog.md", text, 7200)
    repo.commit("docs/changelog.md", text + "- added point\n", 60)
    options = ReportOptions(str(repo.path), 7, None, "Stress customer impact.")
    got = engine.run_git_native_rag(options)
    assert got["kind"] == "SYNTHESIZED" and "File: docs/changelog.md" in got["prompt"] and "  Section: Summary (level 2)\n" in got["prompt"]
    assert "mock-bytes" in got["summary"] and "    +5 - added point" in got["summary"] and "Stress customer impact." in got["prompt"]
    assert "### docs/changelog.md" in engine.generate_git_report(options)
    bad = engine.run_git_native_rag(ReportOptions(str(repo.path), 0))
    assert bad["kind"] == "FALLBACK" and "was invalid" in bad["message"]
    (repo.path / "docs" / "changelog.md").unlink()
    with pytest.raises(FileNotFoundError):
        engine.run_git_native_rag(options)


def test_folders_and_names_that_spark_passes_over(engine, repo, monkeypatch):
    for path in ("_posts/a.md", ".github/b.md", "it's/c d.md"):
        repo.commit(path, "# Head\nnew line\n", 60)
    got = engine.contextual_changes(ReportOptions(str(repo.path), 7)).collect()
    assert {r["path"] for r in got} == {"_posts/a.md", ".github/b.md", "it's/c d.md"}
    monkeypatch.chdir(repo.path.parent)
    assert engine.contextual_changes(ReportOptions(f"./{repo.path.name}", 7)).count() == len(got)


def test_the_walk_goes_by_time(engine, repo):
    repo.commit("p.md", "p\n", 2 * DAY)
    repo.git("checkout", "-q", "-b", "side")
    repo.commit("b.md", "b\n", 20 * DAY)
    repo.git("checkout", "-q", "main")
    repo.commit("a.md", "a\n", DAY)
    repo.git("merge", "-q", "--no-ff", "-m", "m", "side", age=60)
    assert {r["path"] for r in engine.added_lines(ReportOptions(str(repo.path), 7)).collect()} == {"a.md", "b.md", "p.md"}


def test_repeated_extensions_by_ascii_case():
    ReportOptions(".", 7, [".É", ".é"]).validate()
