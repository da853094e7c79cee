"""A directory of source files as rows, read by a Python data source, without what .gitignore files leave out.

Spark's own file source hides names that begin with an underscore, which are ordinary source files.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text
from ..operators.findings import LANGUAGES

# Directories that are never entered, and other languages by extension.
IGNORED = frozenset(".git .hg .svn .venv venv node_modules target dist build coverage __pycache__ .next .cache".split())
DISCOVERY = {"js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx"}
MOST_BYTES = 1_048_576
#: What one task reads.
FILES_IN_TASK, BYTES_IN_TASK = 500, 32 << 20
SCHEMA = "path string, size long, content binary"


class Ignored:
    """Patterns of the .gitignore files from the root down to a folder; the last that matches decides."""

    def __init__(self, rules: tuple[tuple[str, re.Pattern, bool, bool], ...] = ()):
        self.rules = rules

    def below(self, root: str, folder: str) -> "Ignored":
        """With the patterns that a folder (relative to the root) adds for what lies in it."""
        try:
            with open(os.path.join(root, folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
                given = [line.rstrip("\n").rstrip() for line in f]
        except OSError:
            return self
        more = []
        for line in given:
            pattern = line.removeprefix("!").removeprefix("\\")
            if not pattern or line.startswith("#") or not pattern.strip("/"):
                continue
            anchored = "/" in pattern.rstrip("/")
            more.append((folder, re.compile(("" if anchored else "(?:.*/)?") + ignore_regex(pattern.strip("/")) + r"\Z", re.S), pattern.endswith("/"), line.startswith("!")))
        return Ignored((*self.rules, *more))

    def __call__(self, path: str, is_folder: bool) -> bool:
        hit = False
        for folder, pattern, folders_only, kept in self.rules:
            inside = path[len(folder) + 1 :] if folder else path
            if (is_folder or not folders_only) and pattern.match(inside):
                hit = not kept
        return hit


def ignore_regex(pattern: str) -> str:
    """A pattern of a .gitignore: a star stays in its folder, two stars between slashes span folders."""
    out, k = "", 0
    while k < len(pattern):
        if pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif pattern.startswith("**", k):
            out, k = out + ".*", k + 2
        elif pattern[k] == "[" and (end := pattern.find("]", k + 2)) > 0:
            inside = pattern[k + 1 : end]
            out, k = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]", end + 1
        else:
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(pattern[k], re.escape(pattern[k])), k + 1
    return out


class WorkspaceReader(DataSourceReader):
    """The driver lists names and sizes; a task reads so many files or bytes."""

    def __init__(self, root: str):
        self.root = root

    def files(self, folder: str = "", ignored: Ignored | None = None) -> Iterator[tuple[str, int]]:
        here = (ignored or Ignored()).below(self.root, folder)
        with os.scandir(os.path.join(self.root, folder)) as entries:
            found = sorted(entries, key=lambda e: e.name)
        for entry in found:
            path = f"{folder}/{entry.name}" if folder else entry.name
            is_folder = entry.is_dir(follow_symlinks=False)
            if entry.name in IGNORED or entry.name.startswith(".") or entry.is_symlink() or here(path, is_folder):
                continue
            if is_folder:
                yield from self.files(path, here)
            else:
                yield path, entry.stat().st_size

    def partitions(self) -> list[InputPartition]:
        groups, own, held = [], [], 0
        for path, size in self.files():
            if own and (len(own) >= FILES_IN_TASK or held + size > BYTES_IN_TASK):
                groups.append(InputPartition(tuple(own)))
                own, held = [], 0
            own.append(path)
            held += size
        return [*groups, InputPartition(tuple(own))]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int, bytes]]:
        for path in partition.value:
            whole = os.path.join(self.root, path)
            with open(whole, "rb") as f:
                yield path, os.path.getsize(whole), f.read(MOST_BYTES + 1)


class WorkspaceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workspace"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkspaceReader:
        return WorkspaceReader(self.options["path"])


def scan(spark: SparkSession, root: str, *, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, size, language, kind (source, discovery, other), skipped (why, or null), source."""
    spark.dataSource.register(WorkspaceSource)
    files = spark.read.format("workspace").option("path", root).load()
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    named = lambda table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), extension)
    sample = F.substring(F.col("content"), 1, text.SAMPLE_BYTES)
    binary = (F.locate("\0", F.decode(sample, "ISO-8859-1")) > 0) | F.try_validate_utf8(F.col("content").cast("string")).isNull()
    source = F.when(~binary, F.col("content").cast("string"))
    files = files.withColumn("language", F.coalesce(named(LANGUAGES), named(DISCOVERY))).withColumn("kind", F.when(named(LANGUAGES).isNotNull(), "source").when(named(DISCOVERY).isNotNull(), "discovery").otherwise("other"))
    head = F.substring(source, 1, text.SAMPLE_BYTES)
    why = text.skip_reason(F.col("size"), F.lit(most_bytes), binary, text.generated_reason(head), text.minified_reason(head, named(DISCOVERY).isNotNull() | F.col("language").isin("typescript", "tsx")))
    return files.select("path", "size", "language", "kind", why.alias("skipped"), source.alias("source"))

