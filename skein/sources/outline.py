"""Indented documents as rows: every entry with the keys above it (the ground of S14, S17, S19, S20, S26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.loops import settle
from skein.sources.files import lines

#: An entry's key, plain or quoted, before a colon that ends the line or stands before a blank.
KEY = r"""^("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#"'\[\]{},&*!|>%@`-][^#]*?|-[^\s#][^#]*?)\s*:(?:\s+(.*))?$"""
_QUOTED = r"""^(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)')"""
_BLOCK = r"^[|>][+\-0-9]*(?:\s+#.*)?$"


def _plain(c: Column) -> Column:
    """A scalar without quotes, or without the comment after it."""
    q = F.rlike(c, F.lit(_QUOTED))
    double = F.startswith(c, F.lit('"'))
    inner = F.when(double, F.replace(F.replace(F.regexp_extract(c, _QUOTED, 1), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))).otherwise(F.replace(F.regexp_extract(c, _QUOTED, 2), F.lit("''"), F.lit("'")))
    return F.when(q, inner).otherwise(F.trim(F.regexp_replace(c, r"(^|\s)#.*$", "")))


def _flow(value: Column) -> tuple[Column, Column]:
    """Entries (key, value) of a flow list or map of scalars on one line: whether it is one, and what it holds."""
    text = F.trim(F.regexp_replace(value, r"([\]}])\s+#.*$", "$1"))
    is_list, is_map = F.rlike(text, F.lit(r"^\[.*\]$")), F.rlike(text, F.lit(r"^\{.*\}$"))
    inner = F.substring(text, 2, F.length(text) - 2)
    one = F.filter(F.regexp_extract_all(inner, F.lit(r"""((?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,"'])+)"""), 1), lambda x: F.trim(x) != "")
    pair = r"""^\s*("[^"]*"|'[^']*'|[^:]*?)\s*:\s*(.*)$"""
    items = F.transform(one, lambda x, i: F.struct(F.concat(F.lit("#"), i.cast("string")).alias("key"), _plain(F.trim(x)).alias("value")))
    pairs = F.transform(one, lambda x: F.struct(_plain(F.regexp_extract(x, pair, 1)).alias("key"), _plain(F.trim(F.regexp_extract(x, pair, 2))).alias("value")))
    return is_list | is_map, F.when(is_list, items).otherwise(pairs)


def _entries(files: DataFrame) -> DataFrame:
    """(path, doc, line, at, key, value): at is the entry's column; an item of a list (key #line) lies half a column further."""
    d = lines(files.where("content is not null")).where(F.trim("text") != "")
    d = d.withColumn("text", F.regexp_replace("text", r"\s+$", ""))
    mark = F.rlike("text", F.lit(r"^---(\s|$)"))
    d = d.withColumn("doc", F.count(F.when(mark, 1)).over(Window.partitionBy("path").orderBy("line_no")))
    d = d.where(~mark & ~F.rlike("text", F.lit(r"^(\s*#|\.\.\.\s*$|%YAML)")))
    lead = F.regexp_extract("text", r"^(\s*(?:-\s+)*(?:-$)?)", 1)
    rest = F.substring(F.col("text"), F.length(lead) + 1, F.length("text"))
    dashes = F.filter(F.transform(F.split(lead, ""), lambda x, i: F.when(x == "-", i)), lambda x: x.isNotNull())
    item = F.transform(dashes, lambda i: F.struct((2 * i + 1).alias("at"), F.concat(F.lit("#"), F.col("line_no").cast("string"), F.lit("."), i.cast("string")).alias("key"), F.lit(None).cast("string").alias("value")))
    has_key = F.rlike(rest, F.lit(KEY))
    own = F.struct((2 * F.length(lead)).alias("at"), F.when(has_key, _plain(F.regexp_extract(rest, KEY, 1))).alias("key"), F.when(has_key, F.regexp_extract(rest, KEY, 2)).otherwise(rest).alias("value"))
    return d.select("path", "doc", F.col("line_no").alias("line"), F.explode(F.concat(item, F.when(rest != "", F.array(own)).otherwise(F.array().cast("array<struct<at:int,key:string,value:string>>")))).alias("e")).select("path", "doc", "line", "e.*")


def outline(files: DataFrame) -> DataFrame:
    """(path, doc, line, trail, value) of indented documents (path, content).

    trail holds the keys from the top to the entry, an item of a list as # and its place; value is null where the entry has none of
    its own. The entry above is the nearest one before with a smaller indent: each depth of indent that occurs is one running
    maximum over the file's lines, so that lines are sorted once and nothing is joined. Lists and maps of scalars in brackets on one
    line are entries (empty ones are a value, [] or {}); texts in blocks are a value of their key (the marker) and no entries. Not resolved: anchors, tags, nested brackets,
    scalars over several lines. Null or empty contents have no rows; comments and quotes are no part of a value."""
    d = settle(_entries(files))
    depths = [r["at"] for r in d.select("at").distinct().orderBy("at").collect()]  # columns of entries: as many as indents, not as lines
    if not depths:
        return d.select("path", "doc", "line", F.array().cast("array<string>").alias("trail"), "value")
    before = Window.partitionBy("path", "doc").orderBy("line", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seq = F.struct("line", "at", "key", "value")
    d = d.select("*", *(F.max(F.when(F.col("at") == at, seq)).over(before).alias(f"_{i}") for i, at in enumerate(depths)))
    above = F.filter(F.array(*(f"_{i}" for i in range(len(depths)))), lambda x: x.isNotNull() & (x["at"] < F.col("at")))
    # The last entry of a depth is above this one if no entry of a smaller depth came after it.
    later = lambda x, y: (y["at"] < x["at"]) & ((y["line"] > x["line"]) | ((y["line"] == x["line"]) & (y["at"] > x["at"])))
    chain = F.filter(F.col("_above"), lambda x: ~F.exists("_above", lambda y: later(x, y)))
    d = d.withColumn("_above", above).withColumn("_above", chain)
    block = F.exists("_above", lambda x: F.coalesce(F.rlike(x["value"], F.lit(_BLOCK)), F.lit(False)) | x["key"].isNull())
    d = d.where(~block)
    trail = F.concat(F.transform("_above", lambda x: x["key"]), F.when(F.col("key").isNotNull(), F.array("key")).otherwise(F.array().cast("array<string>")))
    d = d.select("path", "doc", "line", trail.alias("trail"), "value")
    flow, held = _flow(F.col("value"))
    flat = d.where(~F.coalesce(flow, F.lit(False))).select("path", "doc", "line", "trail", F.nullif(_plain(F.trim("value")), F.lit("")).alias("value"))
    own = F.struct(F.lit(None).cast("string").alias("key"), F.when(F.size(held) == 0, F.substring(F.trim("value"), 1, 2)).alias("value"))
    inner = d.where(flow).select("path", "doc", "line", "trail", F.explode(F.concat(F.array(own), held)).alias("e"))
    inner = inner.select("path", "doc", "line", F.when(F.col("e.key").isNull(), F.col("trail")).otherwise(F.concat("trail", F.array("e.key"))).alias("trail"), F.nullif("e.value", F.lit("")).alias("value"))
    return flat.unionByName(inner)
