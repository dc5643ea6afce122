"""The stored index against the search that reads all chunks, and what it reads."""

from pyspark.sql import functions as F

from skein.operators import mining, search_index


def test_stored_search(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "src/a.ts", "x_y", "the"]
    rows = [(f"c{i:03}", " ".join(words[(i * k) % 6] for k in range(1 + i % 5)) + f" own{i}") for i in range(120)] + [("null", None), ("empty", ""), ("c001x", "Alpha ALPHA beta!")]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string")
    at = f"file://{tmp_path}/index"
    search_index.write_index(chunks, at)
    search_index.write_index(chunks, at)  # over itself
    for query in ("alpha beta the beta", "SRC/a.ts x_y own7", "the", "nowhere to be found"):
        want = [tuple(r) for r in mining.search(chunks, query, None).orderBy(F.desc("score"), "chunk_id").collect()]
        got = [tuple(r)[1:] for r in search_index.search_stored(spark, at, query, None).orderBy(F.desc("score"), "chunk_id").collect()]
        assert got == want
    top = search_index.search_stored(spark, at, "beta alpha", 5).orderBy("rank").collect()
    assert [r["rank"] for r in top] == [1, 2, 3, 4, 5] and top[0]["score"] == 1.0 and [r["score"] for r in top] == sorted((r["score"] for r in top), reverse=True)
    assert search_index.search_stored(spark, at, "! ?").count() == 0
    plan = search_index.postings(spark, at, ["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "token" in plan.split("PushedFilters: [")[1].split("]")[0]
    search_index.write_index(chunks.limit(0), at)
    assert search_index.search_stored(spark, at, "alpha").count() == 0
