"""History of a repository as tables, read with plain git on the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True).stdout.decode(errors="replace")


def history(spark: SparkSession, repo: str, rows: int = 100_000) -> DataFrame:
    """commit_id, author, ts (epoch seconds), file of every change of the current branch, without merges. The log is read as a stream and
    handed over in tables of ``rows`` rows."""
    schema, parts, out = "commit_id string, author string, ts long, file string", [], []
    log = subprocess.Popen(["git", "-C", repo, "log", "--no-merges", "--no-renames", "-z", "--format=%x01%H%x02%ae%x02%ct", "--name-only"], stdout=subprocess.PIPE)
    head, rest = None, b""
    for chunk in iter(lambda: log.stdout.read(1 << 16), b""):
        *records, rest = (rest + chunk).split(b"\0")
        for record in records:
            for piece in record.decode(errors="replace").lstrip("\n").split("\n"):
                if piece.startswith("\1"):
                    commit, author, ts = piece[1:].split("\2")
                    head = commit, author, int(ts)
                elif piece and head:
                    out.append((*head, piece))
        if len(out) >= rows:
            parts.append(spark.createDataFrame(out, schema))
            out = []
    if log.wait():
        raise RuntimeError(f"{repo}: git log failed")
    for df in parts[1:]:
        parts[0] = parts[0].unionByName(df)
    last = spark.createDataFrame(out, schema)
    return parts[0].unionByName(last) if parts else last


def changed_files(spark: SparkSession, repo: str, since: str) -> DataFrame:
    """(path, change: created, modified, deleted) between a commit and the current one; a renamed file is deleted and created."""
    kinds, fields = {"A": "created", "D": "deleted"}, _git(repo, "diff", "--no-renames", "--name-status", "-z", since, "HEAD").split("\0")
    rows = [(path, kinds.get(status[:1], "modified")) for status, path in zip(fields[::2], fields[1::2], strict=False) if path]
    return spark.createDataFrame(rows, "path string, change string")


def current_commit(repo: str) -> str:
    return _git(repo, "rev-parse", "HEAD").strip()
