"""Commit history of a repository as a data source: ``spark.read.format("gitlog").load(path)``."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADER = "%H%x00%at%x00%s"


def git(repo: str, *args: str) -> str:
    env = os.environ | {"LC_ALL": "C", "GIT_PAGER": "cat", "GIT_TERMINAL_PROMPT": "0"}
    return subprocess.run(["git", "-C", repo, *args], env=env, capture_output=True, text=True, errors="replace", timeout=300, check=True).stdout


def is_ancestor(repo: str, commit: str) -> bool:
    """Whether ``commit`` is in the history of HEAD, so that a log may go on from it."""
    return subprocess.run(["git", "-C", repo, "merge-base", "--is-ancestor", commit, "HEAD"], capture_output=True, timeout=300).returncode == 0


class GitLogSource(DataSource):
    """Rows ``project_id, raw``: the captured log of a repository, without merges, with renames.
    Options: ``path``, ``project``, ``since`` (a commit to go on from; ignored if HEAD does not
    descend from it)."""

    @classmethod
    def name(cls):
        return "gitlog"

    def schema(self):
        return "project_id string, raw string"

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        repo, since = self.options["path"], self.options.get("since")
        span = [f"{since}..HEAD"] if since and is_ancestor(repo, since) else []
        yield self.options.get("project", os.path.basename(repo.rstrip("/"))), git(repo, "log", "--numstat", f"--format={HEADER}", "--no-merges", "-M", *span)
