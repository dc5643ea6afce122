"""The stages of the corpus pipeline on a small table."""

import os
import random

from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import ngram_join
from skein.llm.common import shared_dir, stash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def test_stages(spark):
    rng = random.Random(11)
    words = ["the", "of", "and", "to", "in", "river", "stone", "light", "paper", "garden", "window", "letter", "morning", "table"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "s", "er", "ing", "ed"]) for _ in range(n)) + "."
    clean = [text(80) for _ in range(40)]
    rows = [(i, t, "en", rng.choice("ab"), len(t), "x") for i, t in enumerate(clean)]
    rows += [(100, clean[0], "en", "a", 1, "x"), (101, clean[1] + " more words here", "en", "b", 1, "x"), (102, "$$$ ### " * 60, "en", "a", 1, "x"), (103, None, "en", "a", 0, "x")]
    rows += [(104, text(70) + " write to jo@ex.org now", "en", "a", 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stash(stage(spark, docs, ""))
        if name != "pack":
            assert docs.columns == before.columns
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "quality_rules":
            assert set(range(40)) <= ids and not ids & {102, 103}
        if name == "ngram_join":
            assert set(range(40)) <= ids and not ids & {100, 101}
        if name == "pii":
            assert docs.where("doc_id = 104").first()["text"].endswith("write to [EMAIL] now")
    assert docs.count() > 0 and {"sequence_id", "offset"} <= set(docs.columns)


def test_dedup_tells_rows_apart(spark):
    rng = random.Random(12)
    one, two, three = (" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(99)) for _ in range(60)) for _ in range(3))
    rows = [(1, one), (1, two), (2, three), (3, two), (4, three), (4, three), (5, None), (5, ""), (None, one), (6, "x"), (6, "x")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0, "e") for i, t in rows], SCHEMA).withColumn("id", F.lit(1)).withColumn("tag", F.lit(2)).withColumn("n", F.lit(3)).withColumn("row", F.lit(4))
    got = corpus_pipeline.dedup(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert kept == sorted([(1, one), (1, two), (2, three), (5, None), (5, ""), (None, one), (6, "x")], key=str)


def test_stages_on_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    odd = spark.createDataFrame([(None, None, None, None, None, None), (1, "", None, None, 0, "x"), (1, "word " * 5000, "xx", None, 0, "x")] * 2, SCHEMA)
    clash = [F.lit(7).alias(c) for c in ("row", "size", "taken", "kept", "chars", "_row", "rounds", "targets", "left", "ref_lang", "h")]
    for docs in (empty, odd.select("*", *clash)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            assert name == "pack" or out.columns == docs.columns
            n = out.count()
            assert n >= (0 if name in ("quality_rules", "mix") or docs is empty else 3), name


def test_quality_leaves_its_output_alone(spark):
    """The measures, and the texts beside them, are gone from the shared folder when the next stage begins."""
    at = shared_dir(spark).removeprefix("file://")
    rng = random.Random(13)
    texts = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(99)) for _ in range(60)) for _ in range(5)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0, "e") for i, t in enumerate([*texts, None, "x"])], SCHEMA)
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    out = corpus_pipeline.quality(spark, docs, "")
    assert {f"{at}/{x}" for x in set(os.listdir(at)) - before} == {out._stashed_at.removeprefix("file://")}
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}


def test_pairs_are_written_before_their_sketches_travel(spark, monkeypatch):
    """What the tiles found is a table of its own, so that their shuffle can go first."""
    met = []
    real = ngram_join.sketch_pairs
    monkeypatch.setattr(ngram_join, "sketch_pairs", lambda pairs, *rest: met.append(hasattr(pairs, "_stashed_at")) or real(pairs, *rest))
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(1, text), (2, text + " and"), (3, text + " or"), (4, "none of it")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4} and len(met) > 1 and all(met)
