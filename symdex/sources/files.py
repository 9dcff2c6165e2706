"""File trees as tables: scan, ignore rules, text, changes."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_regex

#: Directories and files that a scan leaves out.
IGNORED_DIRS = ".git node_modules __pycache__ .next .venv venv .tox .mypy_cache .pytest_cache dist build .ace-tool .agents .codex".split()
IGNORED_FILES = "*.pyc *.pyo *.so *.o *.dll *.dylib".split()


def ignore_rules(lines: list[str]) -> list[tuple[str, bool]]:
    """(regex over a relative path, keep) of gitignore lines in order; the last that matches decides."""
    rules = []
    for line in lines:
        line = line.rstrip("\n").rstrip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        pattern = line[1:] if keep else line
        only_dirs, pattern = pattern.endswith("/"), pattern.rstrip("/")
        anchored = "/" in pattern
        pattern = pattern.lstrip("/")
        out, i = "", 0
        while i < len(pattern):
            if pattern.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif pattern.startswith("**", i):
                out, i = out + ".*", i + 2
            elif pattern[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif pattern[i] == "?":
                out, i = out + "[^/]", i + 1
            elif pattern[i] == "[" and (end := pattern.find("]", i + 2)) > 0:
                body = pattern[i + 1 : end]
                out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
            else:
                out, i = out + re.escape(pattern[i]), i + 1
        rules.append(("^" + ("" if anchored else "(?:.*/)?") + out + ("/.*" if only_dirs else "(?:/.*)?") + "$", keep))
    return rules


def load_ignore(root: str | Path) -> list[tuple[str, bool]]:
    path = Path(root) / ".gitignore"
    return ignore_rules(path.read_text("utf-8").splitlines()) if path.is_file() else []


def ignored(path: Column, rules: list[tuple[str, bool]], dirs: list[str] = IGNORED_DIRS, patterns: list[str] = IGNORED_FILES) -> Column:
    """Whether a relative path is in an ignored directory, of an ignored name, or ignored by the rules."""
    name = F.element_at(F.split(path, "/"), -1)
    parents = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    out = F.exists(parents, lambda d: d.isin(dirs))
    for p in patterns:
        out = out | name.rlike(glob_regex(p))
    chosen = F.lit(False)
    for regex, keep in rules:
        chosen = F.when(path.rlike(regex), F.lit(not keep)).otherwise(chosen)
    return out | chosen


def discover(spark: SparkSession, root: str | Path, rules: list[tuple[str, bool]] | None = None, modified_after: str | None = None) -> DataFrame:
    """(file_path relative to root, content binary, mtime) of all files that no rule ignores."""
    base = os.path.realpath(os.fspath(root))
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    found = reader.load(base).select(F.regexp_replace("path", "^file:/*" + re.escape(base) + "/", "").alias("file_path"), "content", F.col("modificationTime").alias("mtime"))
    return found.where(~ignored(F.col("file_path"), load_ignore(base) if rules is None else rules))


def named(spark: SparkSession, root: str | Path, paths: list[str]) -> DataFrame:
    """As `discover`, but only of the given relative paths, of which only those that exist are read."""
    base = os.path.realpath(os.fspath(root))
    there = [p for x in sorted(set(paths)) if os.path.isfile(p := os.path.join(base, x)) and os.path.realpath(p).startswith(base + os.sep)]
    if not there:
        return spark.createDataFrame([], "file_path string, content binary, mtime timestamp")
    found = spark.read.format("binaryFile").load(there).select(F.regexp_replace("path", "^file:/*" + re.escape(base) + "/", "").alias("file_path"), "content", F.col("modificationTime").alias("mtime"))
    return found.where(~ignored(F.col("file_path"), load_ignore(base)))


def as_text(files: DataFrame) -> DataFrame:
    """Files that are UTF-8 and not blank, with content as text and line ends made uniform."""
    text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), r"\r\n?", "\n")
    return files.withColumn("content", text).where("content is not null and trim(content) <> ''")
