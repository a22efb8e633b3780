"""Commits as tables."""

import subprocess

import pytest
from pyspark.sql import functions as F

from lodeseek.operators import versions
from lodeseek.sources import git_source


def git(folder, *words):
    return subprocess.run(["git", "-C", str(folder), "-c", "user.name=n", "-c", "user.email=e", *words], check=True, capture_output=True, text=True).stdout.strip()


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    folder = tmp_path_factory.mktemp("git")
    git(folder, "init", "-q")
    files = {"a.py": "one\n", "lib/b.py": "two\n" * 50, "lib/deep/c d.py": "three\n", "lib/e.js": "four\n", "venv/skipped.py": "no\n", "touched.sh": "run\n", "*.py": "star\n"}
    for name, text in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    git(folder, "add", "-A")
    git(folder, "commit", "-qm", "first")
    first = git(folder, "rev-parse", "HEAD")
    (folder / "a.py").write_text("changed\n")
    git(folder, "mv", "lib/b.py", "lib/renamed.py")
    git(folder, "rm", "-q", "lib/e.js")
    git(folder, "update-index", "--chmod=+x", "touched.sh")
    (folder / "new.py").write_text("new\n")
    git(folder, "add", "a.py", "new.py")
    git(folder, "commit", "-qm", "second")
    return folder, first, git(folder, "rev-parse", "HEAD")


def test_files_of_a_commit(spark, repo):
    folder, first, _ = repo
    found = {r.path: r.size for r in git_source.files(spark, str(folder), first, ["venv"]).collect()}
    assert found == {"a.py": 4, "lib/b.py": 200, "lib/deep/c d.py": 6, "lib/e.js": 5, "touched.sh": 4, "*.py": 5}
    blobs = {r.path: r.blob for r in git_source.files(spark, str(folder), first).collect()}
    assert blobs["a.py"] == git(folder, "rev-parse", f"{first}:a.py") and "venv/skipped.py" in blobs


def test_filters_reach_the_reader(spark, repo):
    folder, first, _ = repo
    found = git_source.files(spark, str(folder), first, ["venv"]).filter((F.col("size") <= 10) & F.col("path").endswith(".py") & (F.length("path") > 4))
    assert {r.path for r in found.collect()} == {"lib/deep/c d.py"}
    reader = git_source.FilesReader({"path": str(folder), "commit": first})
    left = list(reader.pushFilters([git_source.LessThanOrEqual(("size",), 10), git_source.StringEndsWith(("path",), ".py"), git_source.StringEndsWith(("blob",), "0")]))
    rows = [r for part in reader.partitions() for r in reader.read(part)]
    assert len(left) == 1 and {r[0] for r in rows} == {"a.py", "lib/deep/c d.py", "venv/skipped.py", "*.py"}


def test_changes_of_git_and_of_contents(spark, repo):
    folder, first, second = repo
    by_git = git_source.changes(spark, str(folder), first, second)
    want = {"a.py": "modified", "lib/b.py": "deleted", "lib/renamed.py": "added", "lib/e.js": "deleted", "new.py": "added", "touched.sh": "modified"}
    assert {r.path: r.change for r in by_git.collect()} == want
    by_blob = versions.diff(*(git_source.files(spark, str(folder), c) for c in (first, second)))
    assert {r.path for r in by_blob.collect()} == set(want) - {"touched.sh"}  # only its mode changed
    assert {r.path: r.change for r in versions.all_changes(by_blob, by_git).collect()} == want
    with pytest.raises(Exception, match="nowhere|unknown revision|bad revision|ambiguous"):
        git_source.changes(spark, str(folder), "nowhere", second).collect()
