"""Identities and names: prefixes, edge ids, path helpers, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Id prefixes and the kinds they stand for.
PREFIX_KIND = {
    "file": "File", "mod": "Module", "pkg": "Package", "cls": "Class", "iface": "Interface", "fn": "Function",
    "svc": "Service", "api": "API", "table": "Table", "col": "Column", "event": "Event", "job": "Job",
    "test": "Test", "ext": "External", "infra": "Infra", "doc": "Doc", "cfg": "ConfigKey", "repo": "Repo",
}


def edge_id(src: Column, dst: Column, kind: Column) -> Column:
    """e_ and the first 12 hex digits of the SHA-256 of src|dst|type."""
    return F.concat(F.lit("e_"), F.substring(F.sha2(F.concat_ws("|", src, dst, kind), 256), 1, 12))


def kind_of(id_: Column) -> Column:
    """The kind that an id's prefix stands for; null for others."""
    table = F.create_map(*(F.lit(x) for kv in PREFIX_KIND.items() for x in kv))
    return F.try_element_at(table, F.substring_index(id_, ":", 1))


def normal_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """'' for a path without a slash."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def tokens(c: Column) -> Column:
    """Lower-cased runs of [a-z0-9_.:/-] of two characters or more, in order, with repeats."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9_.:/\-]", " "), r"\s+"), lambda t: F.length(t) > 1)


def like_pattern(query: str) -> str:
    """A substring pattern in which % and _ stay wildcards and a backslash is itself."""
    return "%" + query.replace("\\", "\\\\") + "%"


def fold_ascii(c: Column) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
