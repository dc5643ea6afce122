"""From raw documents to packed training sequences: five stages, each one operator of skein.llm.

Each stage takes (spark, docs, sf_dir) and returns what its operator keeps of docs: all but the last return the
columns of documents. Columns besides pass through; a stage that changes a text sets n_chars anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import mixing, ngram_join, packing, pii, quality_rules
from skein.llm.common import discard, stash, table

ORACLE_SQL = None  # signatures, word windows and packing have no SQL form; tests/llm holds them against brute force


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, written; a null text is rejected, a null language judged against all.

    A text is written once beside its measures, not in its row too, and these go as soon as what is kept has been written:
    a stage's tables lie in the shared folder while the next one runs."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    measured = stash(quality_rules.measures(docs.select(row, "text", "lang")))
    refs = stash(quality_rules.references(measured))
    kept = quality_rules.judge(measured, refs).where("kept")
    out = stash(kept.select(*(F.col("text" if c == "text" else f"row.`{c}`") for c in docs.columns)))
    discard(measured, refs)
    return out


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles (Jaccard 0.8 or more): the one with the smallest id.

    Rows are told apart by id and text: rows of one id and unlike texts stay unless a link joins them; of rows with equal
    ids and texts one stays. Documents without an id or without words are in no group and stay."""
    tag = F.xxhash64(F.col("text"))
    found = ngram_join.ngram_join(docs.select("doc_id", "text", tag.alias("tag")), "doc_id", "text", n=5, num=80, den=100, tag="tag")
    counted = found.where("group_id is not null").groupBy("group_id", "doc_id", "tag").agg(F.count("*").alias("n"))
    first = counted.groupBy("group_id").agg(F.min(F.struct("doc_id", "tag", "n")).alias("first"))
    keep = stash(first.select(F.col("first.doc_id").alias("id"), F.col("first.tag").alias("tag"), F.col("first.n").alias("n")))
    discard(found)
    named = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), tag.alias("tag"), named.alias("named"))
    chosen = rows.where("named").join(keep, ["id", "tag"])
    once = chosen.where("n = 1")
    if not keep.where("n > 1").isEmpty():
        once = once.unionByName(chosen.where("n > 1").dropDuplicates(["id", "tag"]))
    return once.select("row").unionByName(rows.where("not named").select("row")).select(*(F.col(f"row.`{c}`") for c in docs.columns))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; null texts stay null."""
    return pii.redact_pii(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes; the last may be cut to its leading words.

    Null and wordless texts take nothing and go; a null source is a source; equal rows are taken each alone."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    sized = docs.select(row, F.col("doc_id").alias("id"), mixing.size_of(F.col("text")).alias("size"), F.array("source").alias("of"))
    plan = stash(mixing.plan_mix(stash(sized.select("id", "size", "of")), "of", "size", ["id", "size"]))
    taken = mixing.apply_mix(sized, plan, "of", "size", ["id", "size"]).where("taken > 0")
    copies = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size"))), lambda i: F.least(F.col("size"), F.col("taken") - i * F.col("size")))
    rows = taken.withColumn("words", F.explode(copies))
    leading = F.array_join(F.slice(F.filter(F.split("row.text", quality_rules.SPACE), lambda w: w != ""), 1, F.col("words").cast("int")), " ")
    text = F.when(F.col("words") < F.col("size"), leading).otherwise(F.col("row.text"))
    new = {"text": F.col("made"), "n_chars": F.char_length("made").cast("long")}
    return rows.withColumn("made", text).select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens; a null text is its end token alone."""
    return packing.pack(docs, "doc_id", "text")


STAGES = [("quality_rules", quality), ("ngram_join", dedup), ("pii", private), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        docs = docs if hasattr(docs, "_stashed_at") else stash(docs)
        discard(before)  # each stage reads what the one before it wrote, and nothing older
    return STAGES[-1][1](spark, docs, sf_dir)
