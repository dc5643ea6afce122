"""Both versions of the files that a change touches (S8, S9), read from a git repository by a data source of its own, and what the change does."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from skein.operators.changes import BASES, diff_impact
from skein.operators.loops import settle
from skein.sources.code import symbols
from skein.sources.manifests import SKIP_PATH

MODES = ("range", "working", "staged")


def _git(repo: str, *args: str, feed: bytes | None = None) -> bytes | None:
    """What git prints; None where it fails."""
    done = subprocess.run(["git", "-C", repo, "-c", "core.quotepath=false", *args], input=feed, capture_output=True, check=False)
    return done.stdout if done.returncode == 0 else None


def _commit(repo: str, *names: str) -> str | None:
    """The hash of the first name that is a commit."""
    for name in names:
        if got := _git(repo, "rev-parse", "--verify", "--quiet", "--end-of-options", name + "^{commit}"):
            return got.decode().strip()
    return None


def _changes(repo: str, mode: str, base: str | None, head: str | None) -> list[tuple[str, str, str | None, str, str]]:
    """(status, path, old path, old blob, new blob) of each changed file; a blob of zeros has to be read from the working folder."""
    if mode == "range":
        a, b = _commit(repo, *([base] if base else []), *BASES), _commit(repo, *([head] if head else []), "HEAD")
        if a is None or b is None:
            return []
        out = _git(repo, "diff", "--raw", "-z", "-M", "--abbrev=40", f"{a}...{b}") or _git(repo, "diff", "--raw", "-z", "-M", "--abbrev=40", a, b)
    else:
        out = _git(repo, "diff", "--raw", "-z", "-M", "--abbrev=40", *(["--cached"] if mode == "staged" else []), "HEAD")
    parts = iter((out or b"").decode("utf-8", "replace").split("\0"))
    rows = []
    for head_ in parts:
        if not head_:
            continue
        _, _, old, new, status = head_.lstrip(":").split(" ")
        first = next(parts)
        moved = status[0] in "RC"
        rows.append((status[0], next(parts) if moved else first, first if moved else None, old, new))
    if mode == "working":
        known = {r[1] for r in rows}
        loose = (_git(repo, "ls-files", "--others", "--exclude-standard", "-z") or b"").decode("utf-8", "replace").split("\0")
        rows += [("A", p, None, "0" * 40, "0" * 40) for p in loose if p and p not in known]
    return rows


class _Part(InputPartition):
    def __init__(self, side: str, files: list):
        super().__init__(side)
        self.side, self.files = side, files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.mode = options["path"], options.get("mode") or ("range" if options.get("base") else "working")
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        self.base, self.head, self.most = options.get("base"), options.get("head"), int(options.get("files_per_task", "64"))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and lists on status and side choose what is listed and read at all; the rest is Spark's."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) else None
            if column not in ("status", "side"):
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[column] = self.wanted.get(column, values) & values

    def _asked(self, column: str, value: str) -> bool:
        return column not in self.wanted or value in self.wanted[column]

    def partitions(self) -> list[InputPartition]:
        rows = [r for r in _changes(self.repo, self.mode, self.base, self.head) if self._asked("status", r[0])]
        out = []
        for side, without in (("old", "A"), ("new", "D")):
            files = [r for r in rows if r[0] != without] if self._asked("side", side) else []
            out += [_Part(side, files[i : i + self.most]) for i in range(0, len(files), self.most)]
        return out or [_Part("old", [])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        old = partition.side == "old"
        for status, path, was, before, after in partition.files:
            blob = before if old else after
            if blob.strip("0"):
                content = _git(self.repo, "cat-file", "blob", blob)
            else:
                content = self._working(path)
            if content is not None:
                yield status, path, was, partition.side, content.decode("utf-8", "replace")

    def _working(self, path: str) -> bytes | None:
        at = os.path.join(self.repo, path)
        if not os.path.isfile(at) or os.path.islink(at):
            return None
        with open(at, "rb") as f:
            return f.read()


class GitVersions(DataSource):
    """spark.read.format("git_versions"): (status, path, old_path, side, content) of a change; side is old or new.

    Options: path (the repository, in a folder that all nodes see), mode (range, working or staged), base, head, files_per_task.
    Only names and blob hashes of changed files pass through the driver; each task reads the contents of its own files. A range
    of three dots without changes falls back to one of two. Without a repository, or a commit, there are no rows; an added file
    has no old side, a deleted one no new side, a renamed one its old path too."""

    @classmethod
    def name(cls) -> str:
        return "git_versions"

    def schema(self) -> str:
        return "status string, path string, old_path string, side string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def file_versions(spark: SparkSession, repo: str, mode: str | None = None, base: str | None = None, head: str | None = None, files_per_task: int = 64) -> DataFrame:
    """Both sides of all changed files but locks, maps and minified ones."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitVersions)
    r = spark.read.format("git_versions").option("files_per_task", files_per_task)
    for key, value in (("mode", mode), ("base", base), ("head", head)):
        r = r.option(key, value) if value else r
    return r.load(repo).where(~F.rlike("path", F.lit(SKIP_PATH)))


def version_symbols(versions: DataFrame, side: str) -> DataFrame:
    """(id, signature, body) of the definitions in one side's files (versions: a written table); the old side's lie under their old paths. Of an id defined twice in a file, the last counts."""
    path = F.coalesce("old_path", "path") if side == "old" else F.col("path")
    files = versions.where(F.col("side") == side).select(path.alias("path"), F.coalesce("content", F.lit("")).alias("content"))
    if not files.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # copies of one file; else no text is shuffled
        files = settle(files.distinct())
    return symbols(files).groupBy("id").agg(F.max_by("signature", "start_line").alias("signature"), F.max_by("body", "start_line").alias("body"))


def diff_versions(nodes: DataFrame, edges: DataFrame, versions: DataFrame, max_depth: int = 5) -> dict[str, DataFrame]:
    """diff_impact of both sides' symbols: symbols, impact, contracts. A definition in a renamed file is removed and added."""
    held = settle(versions)
    return diff_impact(nodes, edges, version_symbols(held, "old"), version_symbols(held, "new"), held.select("path").distinct(), max_depth)
