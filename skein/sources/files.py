"""Repository files as DataFrames: scan, ignore rules, language, lines, embedded-text mask."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders and files that a scan leaves out.
IGNORED_DIRS = ("node_modules", ".git", "dist", "build", "__pycache__", ".next", "coverage", "vendor", "target", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache")
IGNORED_FILES = (".gitignore", ".env", ".env.local", ".env.production", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Cargo.lock", "Gemfile.lock")
# Languages by file ending.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".py": "python", ".java": "java", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".cs": "csharp",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "cpp", ".hpp": "cpp", ".c": "c", ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin",
    ".scala": "scala", ".sql": "sql", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml", ".proto": "protobuf",
    ".graphql": "graphql", ".gql": "graphql", ".md": "markdown", ".tf": "terraform", ".hcl": "terraform", ".dockerfile": "docker",
    ".sh": "shell", ".bash": "shell", ".prisma": "prisma",
}
# Paths of tests.
TEST_PATH = r"\.(test|spec)\.[jt]sx?$|(?:^|/)tests?/|(?:^|/)test_|_test\.py$|Test\.java$"


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(path, content): files below root, paths relative to it, without ignored folders, files and patterns."""
    base = root.rstrip("/")
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    path = F.regexp_replace("path", "^(file:)?/*" + re.escape(base.removeprefix("file:").lstrip("/")) + "/", "")
    d = d.select(path.alias("path"), F.decode("content", "UTF-8").alias("content"))
    kept = ~F.exists(F.split(F.col("path"), "/"), lambda s: s.isin(*IGNORED_DIRS)) & ~F.substring_index("path", "/", -1).isin(*IGNORED_FILES)
    return d.where(kept & ~ignored(F.col("path"), ignore or []))


def ignore_regex(pattern: str) -> str:
    """A regular expression for one ignore pattern; ** crosses slashes, * and ? do not."""
    p = pattern.strip("/")
    out = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*|\*|\?|[^*?]+", p))
    return f"(^|/){out}(/|$)" if "/" not in p else f"^{out}(/|$)"


def ignored(path: Column, patterns: list[str]) -> Column:
    """Any pattern matches, and no pattern beginning with ! does."""
    lines = [p.strip() for p in patterns if p.strip() and not p.startswith("#")]
    yes, no = [ignore_regex(p) for p in lines if p[0] != "!"], [ignore_regex(p[1:]) for p in lines if p[0] == "!"]
    hit = F.lit(False)
    for rx in yes:
        hit = hit | F.rlike(path, F.lit(rx))
    for rx in no:
        hit = hit & ~F.rlike(path, F.lit(rx))
    return hit


def language(path: Column) -> Column:
    """By file ending; Dockerfiles by name; null for others."""
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    name = F.lower(F.substring_index(path, "/", -1))
    return F.when(name == "dockerfile", "docker").otherwise(F.try_element_at(table, F.regexp_extract(name, r"(\.[^.]+)$", 1)))


def is_test(path: Column) -> Column:
    return F.rlike(path, F.lit(TEST_PATH))


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no, text), lines from 1."""
    return files.select("path", F.posexplode(F.split("content", "\r?\n")).alias("_p", "text")).select("path", (F.col("_p") + 1).alias("line_no"), "text")


def evidence(path: Column, line: Column, text: Column) -> Column:
    return F.array(F.struct(path.alias("file"), line.cast("int").alias("line"), F.substring(F.trim(text), 1, 120).alias("snippet")))
