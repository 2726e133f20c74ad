"""Files of a repository tree as rows."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories that hold nothing of the repository's own, at any depth.
SKIPPED = frozenset("__pycache__ node_modules vendor third_party build dist out target venv .venv .git .hg .svn .cache .mypy_cache .pytest_cache .ruff_cache .tox .build .gradle .next .nuxt .turbo .yarn .worktrees .clone Pods Carthage DerivedData site-packages coverage bin obj gen generated Generated public www".split())
CODE = tuple(sorted("c cc cpp cs go h hpp java js jsx kt kts m mm php py rb rs scala sh swift ts tsx vue".split()))


def tree_paths(root: str) -> Iterator[str]:
    """Paths relative to ``root``, in order, of all files but those in skipped directories and in nested checkouts: directories below the root with a ``.git``, which is
    a directory in clones and a file in worktrees and submodules. Hidden files and names that begin with an underscore count like others."""
    todo = [""]
    while todo:
        at = todo.pop()
        folders = []
        try:
            entries = sorted(os.scandir(os.path.join(root, at)), key=lambda e: e.name)
        except OSError:  # a directory that can't be read has no files
            continue
        for entry in entries:
            path = f"{at}/{entry.name}" if at else entry.name
            if entry.is_dir(follow_symlinks=False):
                if entry.name not in SKIPPED and not os.path.exists(os.path.join(entry.path, ".git")):
                    folders.append(path)
            elif entry.is_file():
                yield path
        todo.extend(reversed(folders))


def is_code(path: str) -> bool:
    name = path.rsplit("/", 1)[-1]
    return "." in name and name.rsplit(".", 1)[1].lower() in CODE


def _read(root: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sources = []
            for path in frame.path:
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        sources.append(f.read().decode("utf-8", "replace"))
                except OSError:  # gone since it was listed, or not to be read
                    sources.append(None)
            yield frame.assign(source=sources)

    return run


def repo_files(spark: SparkSession, root: str, repo: str, only_code: bool = True) -> DataFrame:
    """``(repo, path, source)``: files under ``root``, paths relative to it (see ``tree_paths``); with ``only_code``, those of code's endings.

    The driver lists names; contents are read where the rows are, so on a cluster the checkout lies in a folder that all executors share. Bytes that aren't
    UTF-8 become replacement characters; a file that can't be read has a null source.
    """
    base = os.path.abspath(root.removeprefix("file://"))
    names = [p for p in tree_paths(base) if not only_code or is_code(p)]
    slices = max(1, min(len(names) // 64 + 1, 4 * spark.sparkContext.defaultParallelism))
    listed = spark.createDataFrame(pd.DataFrame({"repo": repo, "path": names}, dtype=object), "repo string, path string").repartition(slices)
    return listed.mapInPandas(_read(base), "repo string, path string, source string")


def packages(files: DataFrame) -> DataFrame:
    """``(repo, package)``: first-party packages, directories with an ``__init__.py`` at the top or under ``src``."""
    return files.select("repo", F.regexp_extract("path", r"^(?:src/)?([^/]+)/__init__\.py$", 1).alias("package")).where("package <> ''").distinct()
