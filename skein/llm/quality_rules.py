"""Quality rules by distribution divergence, with DataFrame functions only.

Each document has two histograms: of character classes, and of common words of four languages. The references
are those histograms summed over all documents of a language. A document is rejected when the Jensen-Shannon
distance (square root of the divergence, base 2, 0 to 1) of its histogram to its language's reference exceeds a
threshold, and only if it is long enough for that histogram to mean something (min_chars; min_words, and min_hits
common words both in the document and in its reference). With fewer, it is rejected only where its language's share of
common words lets expect min_expected or more, and a tenth of them or less is there. Documents of unknown language are
held against the sum of all. Base rules (too few words; too many words in repeated three-word windows) reject besides.

Defined results: null texts count as empty (no words: rejected by the base rule, distances null); very long texts are
measured whole; each of several equal rows is judged alone; an empty table gives no rows; extra columns pass through,
whatever they are called, but for those named like an output, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]+"
SYMBOLS = "#*$%&|<>"
# Frequent function words of four languages.
COMMON = (
    "the of and to in is that it",
    "der die und den von das ist nicht",
    "le la de et les des est que",
    "el los se un por con una las",
)
COMMON_WORDS = " ".join(COMMON).split()
#: The character classes, in order; "beyond" is the bytes that non-ASCII characters take besides one each.
CLASSES = ("upper", "digit", "beyond", "symbol", "space", "rest")

MIN_CHARS, MIN_WORDS, MAX_CHAR_JS, MAX_WORD_JS = 200, 50, 0.20, 0.65
#: So many references are broadcast (1 KB each); more are joined by a shuffle, to the same result.
MAX_BROADCAST = 4096
#: Of fewer common words than this the histogram is too coarse to be held against a reference.
MIN_HITS, MIN_EXPECTED = 20, 8


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "words")
VERDICT = ("base_failed", "char_js", "word_js", "kept")


def _row(df: DataFrame, without: tuple[str, ...]) -> tuple[Column, list[str]]:
    """The columns of df but these, as one struct: names inside it can clash with nothing."""
    kept = [c for c in df.columns if c not in without]
    return F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), kept


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars and words (the two histograms)."""
    row, kept = _row(df, MEASURES)
    df = df.select(row, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t")).withColumn("_w", F.filter(F.split("_t", SPACE), lambda x: x != ""))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    # 3-word windows as hashes; where some are equal, each is joined with its place in one long, and sorted
    grams = F.when(F.col("n_words") >= 4, F.transform(F.slice("_w", 1, F.size("_w") - 2), lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_g", grams)
    df = df.withColumn("_bits", F.length(F.bin(F.size("_g"))).cast("int"))
    keyed = F.sort_array(F.transform("_g", lambda h, i: F.call_function("shiftleft", h, F.col("_bits")).bitwiseOR(i.cast("long"))))
    df = df.withColumn("_k", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), keyed).otherwise(F.array().cast("array<bigint>")))
    same = lambda a, b: F.coalesce(F.call_function("shiftright", a, F.col("_bits")) == F.call_function("shiftright", b, F.col("_bits")), F.lit(False))
    at = F.filter("_k", lambda k, i: same(k, F.get("_k", i + 1)) | same(k, F.get("_k", i - 1)))
    df = df.withColumn("_at", F.sort_array(F.transform(at, lambda k: k.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1))))
    repeated = F.aggregate(F.transform("_at", lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("_at", i + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda s, x: s + x)
    lines = F.filter(F.split("_t", "\n"), lambda x: F.rlike(x, F.lit(r"[^ \t\n\x0B\f\r]")))
    df = (
        df.withColumn("n_repeat_words", repeated)
        .withColumn("_lines", lines)
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("word_chars", F.char_length(F.array_join("_w", "")).cast("long"))
        .withColumn("_n", F.char_length("_t"))
        # one pass over the text leaves the few characters that are counted
        .withColumn("_s", F.regexp_replace("_t", "[^A-Z0-9#*$%&|<>]+", ""))
        .withColumn("_s2", F.regexp_replace("_s", "[A-Z]+", ""))
        .withColumn("n_symbols", F.char_length(F.regexp_replace("_s2", "[0-9]+", "")).cast("long"))
        .withColumn("_upper", F.char_length("_s") - F.char_length("_s2"))
        .withColumn("_digit", F.char_length("_s2") - F.col("n_symbols").cast("int"))
        .withColumn("_beyond", F.octet_length("_t") - F.col("_n"))
    )
    rest = F.greatest(F.lit(0), (F.col("word_chars") - F.col("n_symbols")).cast("int") - F.col("_upper") - F.col("_digit") - F.col("_beyond"))
    chars = F.array("_upper", "_digit", "_beyond", F.col("n_symbols").cast("int"), (F.col("_n") - F.col("word_chars")).cast("int"), rest)
    # each common word between two blanks, so that the length that its removal takes counts it
    hits = F.filter(F.transform("_w", lambda w: F.lower(w)), lambda w: w.isin(COMMON_WORDS))
    df = df.withColumn("_hits", F.array_join(F.transform(hits, lambda w: F.concat(F.lit(" "), w, F.lit(" "))), ""))
    words = F.array(*(((F.octet_length("_hits") - F.octet_length(F.replace("_hits", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("int") for w in COMMON_WORDS))
    # _fence is not deterministic for the optimizer: no filter is pushed below it, which would repeat the expressions
    df = df.withColumn("chars", chars).withColumn("words", words).withColumn("_fence", F.spark_partition_id())
    return df.where("_fence >= 0").select(*(F.col(f"_row.`{c}`") for c in kept), *MEASURES)


def references(measured: DataFrame, lang: str = "lang") -> DataFrame:
    """A row for each language, and one (ref_lang null) for all: summed histograms."""
    n_c, n_w = len(CLASSES), len(COMMON_WORDS)
    sums = [F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(n_c)] + [F.sum(F.col("words")[i]).alias(f"w{i}") for i in range(n_w)]
    by = measured.groupBy(F.col(f"`{lang}`").alias("ref_lang")).agg(F.sum("n_words").alias("ref_n_words"), *sums)
    every = by.agg(*(F.sum(c).alias(c) for c in by.columns[1:])).select(F.lit(None).cast("string").alias("ref_lang"), *by.columns[1:])
    pack = lambda p, n: F.array(*(F.coalesce(F.col(f"{p}{i}"), F.lit(0)).cast("double") for i in range(n)))
    return by.where("ref_lang is not null").unionByName(every).select("ref_lang", pack("c", n_c).alias("ref_chars"), pack("w", n_w).alias("ref_words"), "ref_n_words")


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def js_distance(p: Column, q: Column, total_p: Column | None = None, total_q: Column | None = None) -> Column:
    """Jensen-Shannon distance of two count arrays, base 2; null if either is all zero.

    Where p has nothing, a share b of q adds b; as all shares of q add up to 1, only the places are visited where p
    has something. The totals are best given as columns: a loop would make them anew in each step."""
    tp, tq = (_total(p) if total_p is None else total_p), (_total(q) if total_q is None else total_q)
    some = F.filter(F.zip_with(p, q, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))), lambda v: v["x"] > 0)

    def term(v):
        a, b = v["x"] / tp, v["y"] / tq
        return a * F.log2(2 * a / (a + b)) + F.when(b > 0, b * F.log2(2 * b / (a + b))).otherwise(0.0) - b

    div = (F.aggregate(some, F.lit(0.0), lambda s, v: s + term(v)) + 1) / 2
    return F.when((tp > 0) & (tq > 0), F.sqrt(F.greatest(div, F.lit(0.0))))


def judge(measured: DataFrame, refs: DataFrame, lang: str = "lang", min_chars=MIN_CHARS, min_words=MIN_WORDS, max_char_js=MAX_CHAR_JS, max_word_js=MAX_WORD_JS, min_hits=MIN_HITS, min_expected=MIN_EXPECTED) -> DataFrame:
    """Adds base_failed, char_js, word_js and kept to measured documents. refs: a written table."""
    row, kept = _row(measured, VERDICT)
    d = measured.select(row, F.col(f"`{lang}`").alias("lang"), *MEASURES)
    known, every = refs.where("ref_lang is not null"), refs.where("ref_lang is null").first()
    if known.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        known = F.broadcast(known)
    d = d.join(known, d.lang == known.ref_lang, "left")
    of = lambda c, values: F.coalesce(F.col(c), F.array(*map(F.lit, values)).cast("array<double>"))
    d = d.select(
        "_row", *MEASURES, of("ref_chars", every["ref_chars"]).alias("ref_chars"), of("ref_words", every["ref_words"]).alias("ref_words"),
        F.coalesce("ref_n_words", F.lit(every["ref_n_words"]).cast("long")).alias("ref_n_words"),
    )
    for c in ("chars", "words", "ref_chars", "ref_words"):
        d = d.withColumn(f"sum_{c}", _total(F.col(c)))
    for name, c in (("char_js", "chars"), ("word_js", "words")):
        d = d.withColumn(name, js_distance(F.col(c), F.col(f"ref_{c}"), F.col(f"sum_{c}"), F.col(f"sum_ref_{c}")))
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    odd = (F.col("sum_chars") >= min_chars) & (F.coalesce("char_js", F.lit(0.0)) > max_char_js)
    hits, known_hits = F.col("sum_words"), F.col("sum_ref_words")
    expected = F.col("n_words") * known_hits / F.greatest(F.col("ref_n_words"), F.lit(1))
    enough = (hits >= min_hits) & (known_hits >= min_hits)
    far = F.when(enough, F.coalesce("word_js", F.lit(0.0)) > max_word_js).otherwise((expected >= min_expected) & (10 * hits <= expected))
    odd |= (F.col("n_words") >= min_words) & F.coalesce(far, F.lit(False))
    return d.withColumn("kept", ~F.col("base_failed") & ~odd).select(*(F.col(f"_row.`{c}`") for c in kept), *VERDICT)


def quality_rules(df: DataFrame, text: str = "text", lang: str = "lang", **limits) -> DataFrame:
    """df with its measures and verdict; the references come from all rows of df. Null-safe; see the module.

    The measures are made once and written with the rows."""
    from skein.llm.common import stash

    measured = stash(measures(df, text))
    return judge(measured, stash(references(measured, lang)), lang, **limits)


def op8(spark, sf_dir: str) -> DataFrame:
    from skein.llm.common import stash, table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = stash(measures(docs).drop("text"))  # the texts are read once
    out = judge(measured, stash(references(measured)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("char_js", 6).alias("char_js"), F.round("word_js", 6).alias("word_js"))


ORACLE_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, lang from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) as l, regexp_replace(t, '[^A-Z0-9#*$%&|<>]+', '', 'g') as s from d),
g as (select doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] as gram from w, unnest(range(1, len(w) - 1)) as x(i)),
m as (select doc_id, i from (select *, count(*) over (partition by doc_id, gram) as c from g) where c > 1),
rep as (select doc_id, count(distinct i + k) as n from m, (values (0), (1), (2)) as k(k) group by doc_id),
f as (select w.doc_id, lang, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(s, '[A-Z0-9]+', '', 'g')) as n_symbols,
  len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, length(t) as n, strlen(t) - length(t) as beyond,
  length(regexp_replace(s, '[^A-Z]+', '', 'g')) as upper, length(regexp_replace(s, '[^0-9]+', '', 'g')) as digit, [len(list_filter(w, lambda x: lower(x) = c)) for c in COMMON] as words
  from w left join rep using (doc_id)),
h as (select *, [upper, digit, beyond, n_symbols, n - word_chars, greatest(0, word_chars - n_symbols - upper - digit - beyond)] as chars from f),
ec as (select doc_id, lang, i, chars[i]::double as x from h, unnest(range(1, 7)) as k(i)), ew as (select doc_id, lang, i, words[i]::double as x from h, unnest(range(1, len(words) + 1)) as k(i)),
rc as (select lang, i, sum(x) as x from ec where lang is not null group by all union all select null, i, sum(x) from ec group by i),
rw as (select lang, i, sum(x) as x from ew where lang is not null group by all union all select null, i, sum(x) from ew group by i),
tc as (select doc_id, sum(x) as t from ec group by doc_id), tw as (select doc_id, sum(x) as t from ew group by doc_id),
zc as (select lang, sum(x) as t from rc group by lang), zw as (select lang, sum(x) as t from rw group by lang),
jc as (select doc_id, sqrt(greatest(0, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2)) as js
  from (select doc_id, ec.x / tc.t as p, rc.x / zc.t as q from ec join tc using (doc_id) join rc on rc.i = ec.i and rc.lang is not distinct from ec.lang join zc on zc.lang is not distinct from ec.lang where tc.t > 0 and zc.t > 0) group by doc_id),
jw as (select doc_id, sqrt(greatest(0, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2)) as js
  from (select doc_id, ew.x / tw.t as p, rw.x / zw.t as q from ew join tw using (doc_id) join rw on rw.i = ew.i and rw.lang is not distinct from ew.lang join zw on zw.lang is not distinct from ew.lang where tw.t > 0 and zw.t > 0) group by doc_id),
q as (select lang, sum(n_words) as n from h where lang is not null group by lang union all select null, sum(n_words) from h)
select h.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not (list_sum(chars) >= 200 and coalesce(jc.js, 0) > 0.2) and not (n_words >= 50 and case when tw.t >= 20 and zw.t >= 20 then coalesce(jw.js, 0) > 0.65
    else n_words * zw.t / greatest(q.n, 1) >= 8 and 10 * tw.t <= n_words * zw.t / greatest(q.n, 1) end) as kept,
  round(jc.js, 6) as char_js, round(jw.js, 6) as word_js
from h left join jc using (doc_id) left join jw using (doc_id) join tw using (doc_id) join zw on zw.lang is not distinct from h.lang join q on q.lang is not distinct from h.lang
""".replace("COMMON", "[" + ", ".join(f"'{w}'" for w in COMMON_WORDS) + "]")
