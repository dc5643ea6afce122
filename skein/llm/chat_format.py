"""Chat formatting by schema fingerprint, with DataFrame functions only.

A record is one JSON object in any of several layouts. Its nested field paths, sorted and hashed, are its
fingerprint; the fingerprint selects a declarative mapping, which turns the record into canonical turns
(role, text). The template writes `<|role|>` + newline + text + `<|end|>` + newline for each turn; in roles and
texts `~` is written `~0` and `|` is written `~1`, so that no text can hold a marker, and reading back undoes it.

Defined results: a null or malformed record, or one whose fingerprint no mapping knows, has layout null, no
turns and an empty formatted text; null roles and texts count as empty; rows of one conversation and turn (ties,
repeats) stand in the order of role and text, each once for each row; rows with a null conversation are one; very long
turns stay whole; an empty table gives no rows; extra columns pass through unchanged (columns named like an output are
replaced).
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
#: What any mapping may read, parsed in one pass.
RECORD = (
    "turns array<struct<role:string,text:string>>, messages array<struct<role:string,content:string>>, "
    "conversations array<struct<`from`:string,value:string>>, system string, instruction string, input string, "
    "output string, prompt string, response string, completion string, "
    "data struct<messages:array<struct<role:string,content:string>>>"
)
#: Levels of nesting that a fingerprint descends.
DEPTH = 4
#: Runs that are summed up at once.
BLOCK = 512
# What the from-value layout calls the roles. In layouts of role and text, roles stay as they are.
ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))


@dataclass(frozen=True)
class Mapping:
    """paths: the nested field paths it stands for; listed: (array, with dots where it is nested, role field, text field), or
    fixed: (role, fields joined by a blank line) in order. aliases: roles that this layout names otherwise."""

    name: str
    paths: tuple[str, ...]
    listed: tuple[str, str, str] | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    aliases: tuple[tuple[str, str], ...] = ()

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256("\n".join(sorted(self.paths)).encode()).hexdigest()[:16]

    def turns(self, record: Column) -> Column:
        if self.listed:
            at, role, text = self.listed
            for field in at.split("."):
                record = record[field]
            return F.transform(record, lambda x: F.struct(_role(x[role], self.aliases).alias("role"), F.coalesce(x[text], F.lit("")).alias("text")))
        made = [F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *(F.nullif(record[f], F.lit("")) for f in fields)).alias("text")) for role, fields in self.fixed]
        return F.array(*made)


def _role(c: Column, aliases) -> Column:
    c = F.coalesce(c, F.lit(""))
    out = c
    for k, v in aliases:
        out = F.when(c == k, v).otherwise(out)
    return out


MAPPINGS = (
    Mapping("turns", ("turns", "turns[].role", "turns[].text"), ("turns", "role", "text")),
    Mapping("messages", ("messages", "messages[].role", "messages[].content"), ("messages", "role", "content")),
    Mapping("nested-messages", ("data", "data.messages", "data.messages[].role", "data.messages[].content"), ("data.messages", "role", "content")),
    Mapping("from-value", ("conversations", "conversations[].from", "conversations[].value"), ("conversations", "from", "value"), aliases=ROLES),
    Mapping("instruction", ("instruction", "output"), fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction-input", ("instruction", "input", "output"), fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("prompt-response", ("prompt", "response"), fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt-completion", ("prompt", "completion"), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("system-prompt-response", ("system", "prompt", "response"), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
)


def field_paths(value: Column, prefix: Column | None = None, depth: int = DEPTH) -> Column:
    """Paths of the fields of an object, or of the objects of a list, in JSON text: a.b for objects, a[].b for lists."""
    none = F.array().cast("array<string>")
    named = lambda k: k if prefix is None else F.concat(prefix, k)
    fields = F.map_entries(F.from_json(value, "map<string,string>"))

    def below(e: Column) -> Column:
        inner, at = F.ltrim(e["value"]), named(e["key"])
        if depth == 1:
            return F.array(at)
        objects = F.coalesce(F.from_json(inner, "array<string>"), none)
        listed = F.flatten(F.transform(objects, lambda o: field_paths(o, F.concat(at, F.lit("[].")), depth - 1)))
        return F.concat(F.array(at), F.when(F.startswith(inner, F.lit("[")), listed).when(F.startswith(inner, F.lit("{")), field_paths(inner, F.concat(at, F.lit(".")), depth - 1)).otherwise(none))

    found = F.flatten(F.transform(F.when(F.startswith(F.ltrim(value), F.lit("{")), fields), below))
    return F.array_distinct(F.coalesce(found, none))


def fingerprint(record: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the record's sorted nested field paths, DEPTH levels deep; null if it is no object."""
    paths = field_paths(record)
    return F.when(F.size(paths) > 0, F.substring(F.sha2(F.array_join(F.sort_array(paths), "\n"), 256), 1, 16))


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("|"), F.lit("~1"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~1"), F.lit("|")), F.lit("~0"), F.lit("~"))


def format_chat(df: DataFrame, record: str = "record", mappings=MAPPINGS, loss_roles=("assistant",)) -> DataFrame:
    """Adds fingerprint, layout, formatted and loss_runs (chars, loss) in order: the run lengths of the loss mask."""
    own = uuid.uuid4().hex
    p, t, x = (f"{name}_{own}" for name in ("parsed", "turns", "escaped"))  # no column of the caller's
    df = df.withColumn("fingerprint", fingerprint(F.col(record)))
    parsed = F.from_json(F.col(record), RECORD)
    turns, layout = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for m in mappings:
        hit = F.col("fingerprint") == m.fingerprint
        turns, layout = F.when(hit, m.turns(F.col(p)).cast(TURNS)).otherwise(turns), F.when(hit, m.name).otherwise(layout)
    df = df.withColumn(p, parsed).withColumn(t, F.coalesce(turns, F.array().cast(TURNS))).withColumn("layout", layout)
    esc = F.transform(t, lambda t: F.struct(escape(F.coalesce(t["role"], F.lit(""))).alias("role"), escape(F.coalesce(t["text"], F.lit(""))).alias("text"), t["role"].isin(*loss_roles).alias("loss")))
    df = df.withColumn(x, esc)
    runs = F.flatten(F.transform(x, lambda t: F.array(
        F.struct((F.char_length(t["role"]) + 5).alias("chars"), F.lit(False).alias("loss")),
        F.struct(F.char_length(t["text"]).alias("chars"), F.coalesce(t["loss"], F.lit(False)).alias("loss")),
        F.struct(F.lit(8).alias("chars"), F.lit(False).alias("loss")),
    )))
    out = F.array_join(F.transform(x, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")
    return df.withColumn("formatted", out).withColumn("loss_runs", runs).drop(p, t, x)


def read_back(formatted: Column, loss_runs: Column) -> Column:
    """Turns (role, text, loss) from the formatted text and its mask; `|` stands in markers alone, four to a turn.

    The text is split once, and the parts, of which the second of four is a role and the third ">\\n" + text + "<", walked once."""
    nth = lambda c, every, k: F.filter(c, lambda _, i: i % every == k)
    parts = F.split(formatted, r"\|")
    turns = F.arrays_zip(nth(parts, 4, 1).alias("role"), nth(parts, 4, 2).alias("body"), nth(loss_runs, 3, 1).alias("run"))
    return F.transform(turns, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(F.substring(t["body"], F.lit(3), F.char_length(t["body"]) - 3)).alias("text"), t["run"]["loss"].alias("loss")))


def _once(value: Column, use):
    """use(value) with value evaluated once, however often the expression stands inside lambdas of it."""
    return F.transform(F.array(value), use)[0]


def under_mask(formatted: Column, loss_runs: Column) -> Column:
    """What stands in the formatted text under the loss mask, unescaped: one text for each run with loss.

    The run lengths are summed up, in blocks of BLOCK runs and then inside each, and cut out of the text, four bytes to a code point
    and encoded once, so that each cut costs what it is long. A byte order mark before each keeps one that a text begins with."""
    def cuts(wide: Column, begins: Column) -> Column:
        def step(s, run):
            n = run["chars"].cast("long")
            piece = F.substring(wide, (4 * s["at"] + 1).cast("int"), (4 * n).cast("int"))
            return F.struct((s["at"] + n).alias("at"), F.when(run["loss"], F.concat(s["cut"], F.array(piece))).otherwise(s["cut"]).alias("cut"))

        def block(b: Column) -> Column:
            empty = F.struct(b["at"].alias("at"), F.array().cast("array<binary>").alias("cut"))
            return F.aggregate(b["runs"], empty, step, lambda s: s["cut"])

        return F.flatten(F.transform(begins, block))

    mark = F.unhex(F.lit("0000FEFF"))
    found = _once(F.encode(formatted, "UTF-32"), lambda wide: cuts(wide, _blocks(loss_runs)))
    return F.transform(found, lambda x: unescape(F.when(F.octet_length(x) > 0, F.decode(F.concat(mark, x), "UTF-32")).otherwise("")))


def _blocks(loss_runs: Column) -> Column:
    """array<struct<at, runs>>: the runs in blocks, each with the number of characters before it."""
    n = F.ceil(F.size(loss_runs) / BLOCK).cast("int")
    cut = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.slice(loss_runs, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array().cast("array<array<struct<chars:int,loss:boolean>>>"))

    def step(s, runs):
        size = F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["chars"])
        return F.struct((s["at"] + size).alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("at"), runs.alias("runs")))).alias("out"))

    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<at:long,runs:array<struct<chars:int,loss:boolean>>>>").alias("out"))
    return F.aggregate(cut, empty, step, lambda s: s["out"])


def rows_to_records(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """One JSON record {"turns": [{role, text}]} for each key, by turn (then role and text; nulls first)."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.sort_array(F.collect_list(one))
    return df.groupBy(key).agg(F.to_json(F.struct(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))).alias("record"))


def op10(spark, sf_dir: str) -> DataFrame:
    from skein.llm.common import table

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.sql("select -1L conv_id, id turn, if(id = 0, 'user', 'assistant') role, '</s>[INST] ok [/INST]' text from range(0, 2, 1, 1)")
    out = format_chat(rows_to_records(rows.unionByName(own)))
    out = out.withColumn("back", read_back(F.col("formatted"), F.col("loss_runs")))
    out = out.withColumn("loss_text", F.array_join(under_mask(F.col("formatted"), F.col("loss_runs")), ""))
    return out.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "layout",
    )


ORACLE_SQL = r"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, replace(replace(text, '~', '~0'), '|', '~1') as etext, replace(replace(role, '~', '~0'), '|', '~1') as erole from r
), g as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
    coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
    cast(sum(length(etext) + length(erole) + 13) as bigint) as formatted_chars
  from e group by conv_id
)
select conv_id, n_turns, sha256(turns) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256,
  formatted_chars, 'turns' as layout
from g
"""
