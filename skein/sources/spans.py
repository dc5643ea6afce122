"""Where definitions end (P8, P9): a file's text read whole by one pattern, and ends as next-lower depths.

A definition begins in code, so that a stray quote above it does no harm: the text from it to the next one is read alone. One
pattern passes over strings and comments there, which leaves the braces, each with its line's number. As surveyed, a
quote lasts beyond its line, and a backslash takes the next character in code and in comments too, be it on the next line.

Most definitions are closed before the next one begins: a sum over their own braces finds the end in the file's row. In files
where one is not, the braces in order, with definitions between them, give depths by a running sum; a definition ends at the
first closing brace after it that comes back to its own depth, which one window finds (the last such brace seen from the end).

What embeds other texts (masked_lines) is read line by line in the file's row: a line maps the state at its beginning, 0 code,
1 a template, 2 a block comment, to the one at its end, and a fold over the lines follows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.loops import settle

_SHORT, _TEMPLATE = "|".join(rf"{q}[^{q}\\]*+(?:\\.[^{q}\\]*+)*+{q}" for q in ("'", '"')), r"`[^`\\]*+(?:\\.[^`\\]*+)*+`"
#: Whole constructs leave nothing; a line comment leaves //, an open construct its opener, and both end the line. A comment's
#: inner /* counts for nothing here. In TEMPLATES any template is an open one.
EMBEDDED = rf"(?s)(//).*+|/\*(?:[^*\\]++|\\.|\*(?!/))*+\*/|{_SHORT}|{_TEMPLATE}|(['\"`]|/\*).*+|\\.?"
TEMPLATES = EMBEDDED.replace(f"|{_TEMPLATE}", "")
OPENERS = ("", "'", '"', "`", "/*")
#: What stands around a line's number behind a brace.
BRACE_AT = "\x01"
_ESC = r"\\\n*+[^\n]?"
_QUOTED = "|".join(rf"{q}[^{q}\\]*+(?:{_ESC}[^{q}\\]*+)*+{q}" for q in ("'", '"', "`"))
#: The same for whole texts, where quotes last beyond their line, an inner /* is passed over, and the text's end ends all that is open.
WHOLE = rf"//[^\n]*+|/\*(?:[^*/\\]++|{_ESC}|/\*|/|\*(?!/))*+\*/|{_QUOTED}|(?:['\"`]|/\*)[\s\S]*+|{_ESC}"
#: Braces with their numbers as the group; what lies between is passed over in one step, not tried at each character.
TOLD = rf"[^/'\"`\\{{}}]*+(?:{WHOLE}|([{{}}]{BRACE_AT}[0-9]+)|[/{{}}]|\z)"
#: Lines that a span without a closing brace goes on for. Fixed value.
OPEN_LINES = 100


def stripped(text: Column, state: int, lexeme: str) -> Column:
    """What is left of a line's text that begins in a state: code, then // or the opener of what stays open."""
    return F.regexp_replace(F.concat(F.lit(OPENERS[state]), text), lexeme, " $1$2")  # the blank keeps apart what a construct stood between


def once(d: DataFrame, **made: Column) -> DataFrame:
    """d with more columns, each worked out once a row however often it is used afterwards."""
    one = F.explode(F.array(F.struct(*(c.alias(k) for k, c in made.items())))).alias("_one")
    return d.select("*", one).select(*d.columns, *(F.col(f"_one.{k}").alias(k) for k in made))


def hidden(d: DataFrame) -> DataFrame:
    """d (lines: array<string>, a file in each row) with _hidden: which lines masked_lines() blanks; null for none.

    Only lines with a mark of a template or a block comment are read by the lexer, in the one state that they begin in."""
    has = lambda x, *marks: [F.contains(x, F.lit(m)) for m in marks]
    marked = lambda x: F.coalesce(*[F.when(c, True) for c in has(x, "`", "/*", "*/")], F.lit(False))
    behind = lambda x, i: F.length(F.regexp_extract(stripped(x, i, EMBEDDED), r"(`|/\*)$", 1))  # noqa: E731  the opener's length is the state
    after = lambda x, at: F.when(at == 0, behind(x, 0)).when(at == 1, behind(x, 3)).otherwise(behind(x, 4))
    opens = lambda x: F.contains(x, F.lit("`")) & F.endswith(stripped(x, 0, TEMPLATES), F.lit("`"))
    first = F.struct(F.lit("").alias("s"), F.lit(0).alias("at"))
    step = lambda a, x: F.struct(F.concat(a["s"], a["at"].cast("string")).alias("s"), F.when(marked(x), after(x, a["at"])).otherwise(a["at"]).alias("at"))
    d = once(d, _states=F.when(F.exists("lines", marked), F.aggregate("lines", first, step)["s"]))
    seen = F.transform("lines", lambda x, i: (F.substring("_states", i + 1, F.lit(1)) != "0") | opens(x))
    return once(d, _hidden=F.when(F.col("_states").isNotNull(), seen)).drop("_states")


def _masked(d: DataFrame) -> DataFrame:
    """d (lines: array<string>, a file in each row) with the lines blanked as masked_lines() says."""
    d = hidden(d)
    shown = F.zip_with("lines", "_hidden", lambda x, h: F.when(h, F.lit("")).otherwise(x))
    return d.withColumn("lines", F.when(F.col("_hidden").isNull(), F.col("lines")).otherwise(shown)).drop("_hidden")


def masked_files(files: DataFrame) -> DataFrame:
    """(path, ..., line_no, text) of files (path, content, ...), lines from 1, blanked as masked_lines() says."""
    d = _masked(files.withColumn("lines", file_lines(F.col("content"))).drop("content"))
    return d.select(*(c for c in d.columns if c != "lines"), F.posexplode("lines").alias("_p", "text")).withColumn("line_no", F.col("_p") + 1).drop("_p")


def masked_lines(src: DataFrame) -> DataFrame:
    """src (path, line_no, text) with the text blanked of lines that begin inside a template or a block comment, or open a template.

    Quotes and backslashes end with their line here, as surveyed."""
    more = [c for c in src.columns if c not in ("path", "line_no", "text")]
    d = src.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "text", *more))).alias("_r"))
    d = _masked(d.withColumn("lines", F.transform("_r", lambda x: x["text"])))
    both = d.select("path", F.explode(F.zip_with("_r", "lines", lambda x, y: F.struct(x.alias("r"), y.alias("t")))).alias("x"))
    return both.select("path", *(F.col(f"x.r.{c}").alias(c) for c in ("line_no", *more)), F.col("x.t").alias("text")).select(*src.columns)


def brace_ends(src: DataFrame, starts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """starts (path, line_no), once each, with end_line: the line of the brace that closes what they open.

    Without one, OPEN_LINES lines on or the file's last line, whichever is first. src holds all lines of the files; files
    (path, content), where given, stands for it and saves bringing the lines together again."""
    begun = starts.groupBy("path").agg(F.array_sort(F.collect_set("line_no")).alias("_starts"))
    if files is None:
        held = src.join(begun.select("path"), "path", "left_semi").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("_r"))
        held = held.select("path", F.transform("_r", lambda x: x["text"]).alias("lines"))
    else:
        held = files.select("path", file_lines(F.col("content")).alias("lines"))
    d = closings(held.join(begun, "path"))
    d = settle(d.select("path", F.size("lines").alias("_last"), "_ends", "_b", "_starts"))
    closed = d.where("_b is null").select("path", F.explode(F.arrays_zip(F.col("_starts").alias("line_no"), F.col("_ends").alias("end_line"))).alias("x")).select("path", F.col("x.line_no").alias("line_no"), F.col("x.end_line").alias("end_line"))
    return closed.unionByName(nested_ends(d.where("_b is not null")))


def file_lines(content: Column) -> Column:
    """A text's lines. A single character is split at faster than a pattern."""
    return F.split(F.replace(content, F.lit("\r\n"), F.lit("\n")), "\n")


def _line(x: Column) -> Column:
    return F.substring(x, F.lit(3), F.length(x)).cast("int")


def closings(d: DataFrame) -> DataFrame:
    """d (lines: array<string>, _starts: lines of definitions in order, from 1) with _ends, the lines of their closing braces, and
    _b, where one of these is null, which a brace before the next definition does not close: the braces of each definition."""
    at = lambda b, n: F.concat(F.lit(b + BRACE_AT), n.cast("string"), F.lit(BRACE_AT))
    own = lambda x: F.when(F.contains(x, F.lit(BRACE_AT)), F.replace(x, F.lit(BRACE_AT), F.lit(" "))).otherwise(x)
    told = lambda x, n: F.when(F.contains(x, F.lit("{")) | F.contains(x, F.lit("}")), F.replace(F.replace(own(x), F.lit("{"), at("{", n)), F.lit("}"), at("}", n))).otherwise(x)
    until = lambda i: F.coalesce(F.get("_starts", i + 1), F.size("lines") + 1)
    text = lambda s, i: F.concat(F.array_join(F.transform(F.slice("lines", s, until(i) - s), lambda x, j: told(x, s + j)), "\n"), F.lit("\n"))
    braces = lambda s, i: F.filter(F.regexp_extract_all(text(s, i), F.lit(TOLD), F.lit(1)), lambda x: x != "")
    step = lambda a, x: F.struct((a["d"] + F.when(F.startswith(x, F.lit("{")), 1).otherwise(-1)).alias("d"), F.coalesce(a["e"], F.when(F.startswith(x, F.lit("}")) & (a["d"] == 1), _line(x))).alias("e"))
    none = F.struct(F.lit(0).alias("d"), F.lit(None).cast("int").alias("e"))
    d = once(d.withColumn("_starts", F.transform("_starts", lambda n: n.cast("int"))), _b=F.transform("_starts", braces))
    d = once(d, _ends=F.transform("_b", lambda b: F.aggregate(b, none, step)["e"]))
    return d.withColumn("_b", F.when(F.exists("_ends", lambda x: x.isNull()), F.col("_b")))


def nested_ends(d: DataFrame) -> DataFrame:
    """Ends in files (path, _last, _starts, _b) where a definition is not closed before the next one begins: all their braces in order, as rows."""
    one = d.select("path", F.explode(F.arrays_zip(F.col("_starts").alias("s"), F.col("_b").alias("b"))).alias("x"))
    marks = one.select("path", F.col("x.s").alias("line_no"), F.lit(-1).alias("pos"), F.lit(0).alias("step"))
    each = one.select("path", F.posexplode("x.b").alias("pos", "t")).select("path", _line(F.col("t")).alias("line_no"), "pos", F.when(F.startswith("t", F.lit("{")), 1).otherwise(-1).alias("step"))
    depth = each.unionByName(marks).withColumn("depth", F.sum("step").over(Window.partitionBy("path").orderBy("line_no", "pos")))
    back = Window.partitionBy("path", "depth").orderBy(F.desc("line_no"), F.desc("pos"))
    closing = F.last(F.when(F.col("step") == -1, F.col("line_no")), ignorenulls=True).over(back)
    ends = depth.withColumn("end_line", closing).where("step = 0").select("path", "line_no", "end_line")
    return ends.join(d.select("path", "_last"), "path").select("path", "line_no", F.coalesce("end_line", F.least(F.col("line_no") + OPEN_LINES, F.col("_last"))).alias("end_line"))


def indent_ends(src: DataFrame, starts: DataFrame) -> DataFrame:
    """starts (path, line_no) with end_line: the line before the next one with text that is indented no more, or the last.

    A line ends what is open at the depths of the file's definitions not below its own: it stands in the sweep of each of
    these depths, of which a file has few."""
    depth = F.length(F.regexp_extract("text", r"^(\s*)", 1))
    own = src.join(starts.select("path", "line_no").distinct(), ["path", "line_no"], "left_semi").select("path", "line_no", depth.alias("depth"))
    depths = own.groupBy("path").agg(F.array_sort(F.collect_set("depth")).alias("_d"), F.min("line_no").alias("_first"))
    rows = src.where(F.trim("text") != "").join(depths, "path").where("line_no >= _first").select("path", "line_no", depth.alias("_in"), "_d")
    ends = rows.select("path", "line_no", F.explode(F.filter("_d", lambda x: x >= F.col("_in"))).alias("depth")).withColumn("after", F.lit(1))
    events = ends.unionByName(own.withColumn("after", F.lit(0)))
    back = Window.partitionBy("path", "depth").orderBy(F.desc("line_no"), "after")
    end = F.last(F.when(F.col("after") == 1, F.col("line_no")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    last = src.groupBy("path").agg(F.max("line_no").alias("_last"))
    # a definition's own line stands in its sweep as well: of the two rows of that line the definition's comes first from the end
    found = events.withColumn("_e", end).where("after = 0").join(last, "path")
    return found.select("path", "line_no", F.coalesce(F.col("_e") - 1, "_last").alias("end_line"))
