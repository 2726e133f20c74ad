"""Change logs: lines of a header per commit and the paths that it touched."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER = "^[0-9a-f]{40}$"


class LogError(ValueError):
    """A path before the first header."""


def groups_of_lines(lines: DataFrame, header=None, by: tuple[str, ...] = ()) -> DataFrame:
    """``lines (n, line)`` with ``grp``, the number of headers up to them, per ``by``; a running sum over the order of lines.

    A log is one sequence; logs of several sources are numbered side by side, each in its own task.
    """
    is_header = F.col("line").rlike(HEADER) if header is None else header
    order = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("is_header", is_header).withColumn("grp", F.sum(F.col("is_header").cast("int")).over(order))


def commit_files(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by, grp, item)`` of a log. Blank lines are skipped; a path before the first header raises ``LogError``."""
    rows = groups_of_lines(lines.where(F.trim("line") != ""), by=by).where("not is_header")
    if not rows.where("grp = 0").isEmpty():
        raise LogError("a path stands before the first commit header")
    return rows.select(*by, "grp", F.trim("line").alias("item")).distinct()


def git_log(spark: SparkSession, root: str, most: int = 4000, timeout: int = 120) -> DataFrame:
    """``(n, line)`` of a checkout's log, newest first. The log is read where the checkout is, on the driver; a failure gives an empty table."""
    try:
        run = subprocess.run(["git", "-C", root, "log", "--name-only", "--pretty=format:%H", "-n", str(most)], capture_output=True, text=True, timeout=timeout, check=True)
        lines = run.stdout.splitlines()
    except (OSError, subprocess.SubprocessError):
        lines = []
    return spark.createDataFrame(list(enumerate(lines)), "n long, line string")


def repo_state(root: str, timeout: int = 10) -> dict:
    """Branch, head, commits behind and ahead of upstream, and changed files; what can't be known is null, never guessed."""

    def git(*args: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=timeout, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    counts = (git("rev-list", "--left-right", "--count", "HEAD...@{upstream}") or "").split()
    changed = git("status", "--porcelain")
    return {
        "repo": root,
        "branch": git("rev-parse", "--abbrev-ref", "HEAD"),
        "head": git("rev-parse", "--short", "HEAD"),
        "ahead": int(counts[0]) if len(counts) == 2 else None,
        "behind": int(counts[1]) if len(counts) == 2 else None,
        "dirty": -1 if changed is None else len(changed.splitlines()),
    }


def fast_forward(root: str, timeout: int = 120) -> bool:
    """Pulls if that is a fast forward; whether it went well."""
    try:
        subprocess.run(["git", "-C", root, "pull", "--ff-only", "--quiet"], capture_output=True, timeout=timeout, check=True)
    except (OSError, subprocess.SubprocessError):
        return False
    return True
