"""Journal, circuit breaker and change feed as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.operators.mining import manifest, manifest_diff

# The counting window, the conflicts in a row that open the circuit, and its cooldown.
WINDOW_MS, THRESHOLD, COOLDOWN_MS = 60_000, 5, 300_000
STATE = "window_start long, proposals long, conflicts long, streak long, is_open boolean, opened_at long"
OUT = "repo string, ts long, proposals long, conflicts long, streak long, is_open boolean"


def step(state: tuple, ts: int, conflict: bool) -> tuple:
    """The breaker after a proposal at ts (milliseconds): the window is reset at the first proposal after its end, and an
    open circuit is half-open, its streak cleared, once the cooldown has passed."""
    start, n, bad, streak, is_open, opened = state
    if is_open and ts - opened > COOLDOWN_MS:
        is_open, streak = False, 0
    if start is None or ts - start > WINDOW_MS:
        start, n, bad = ts, 0, 0
    n, bad, streak = n + 1, bad + conflict, streak + 1 if conflict else 0
    if conflict and streak >= THRESHOLD:
        is_open, opened = True, ts
    return start, n, bad, streak, is_open, opened


def circuit_breaker(proposals: DataFrame) -> DataFrame:
    """The breaker's state after each proposal (repo, ts in milliseconds, is_conflict), in order of ts within a batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = state.get if state.exists else (None, 0, 0, 0, False, 0)
        rows, d = [], pd.concat(batches).sort_values("ts", kind="stable")
        for ts, conflict in zip(d["ts"].tolist(), d["is_conflict"].tolist()):
            s = step(s, ts, bool(conflict))
            rows.append((key[0], ts, s[1], s[2], s[3], s[4]))
        state.update(s)
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    return proposals.select("repo", "ts", "is_conflict").groupBy("repo").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def journal_sink(events: DataFrame, path: str, checkpoint: str):
    """Appends events to a journal of JSON lines, exactly once."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def change_feed(files: DataFrame, store: str, out: str, checkpoint: str):
    """For each batch of files (path, content): its changes against the manifest in store, appended to out (JSON).

    A manifest of each batch is written beside the last one, so that a batch run again overwrites its own results."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = manifest(batch)
        try:
            old = spark.read.parquet(f"{store}/{number - 1}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = spark.createDataFrame([], new.schema)
        seen = new.join(old.select("path"), "path", "left_semi")
        change = manifest_diff(old.join(seen.select("path"), "path", "left_semi"), new)
        change.withColumn("batch", F.lit(number)).write.mode("overwrite").json(f"{out}/batch={number}")
        old.join(new.select("path"), "path", "left_anti").unionByName(new).write.mode("overwrite").parquet(f"{store}/{number}")

    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
