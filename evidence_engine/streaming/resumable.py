"""A run over a growing table that can be stopped, killed and started again: each key is done once, replacements replace.

State keeps for every key the digest of what was handed out for it last (``transformWithState``): rows that a restart
or a repeated file brings again are dropped, rows of a key with another content are handed out as its next
version. A batch is scored and written to its own folder, which a repetition of the batch overwrites, so
a run that was killed anywhere gives each version once. A file stops the run between batches, and a
``StreamingQueryListener`` leaves a heartbeat for the monitor.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from ..operators.relational import keep_one

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StopRequested(RuntimeError):
    """The stop file is there; the batch was not begun and comes again with the next start."""


class _Versions(StatefulProcessor):
    """Hands out a key's row when its content is not the one that was handed out last, with its version from 1."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "digest string, version int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.last.get() if self.last.exists() else None
        digest, version = found if found else (None, 0)
        out = []
        for part in rows:
            for r in part.sort_values(part.columns[-1], kind="stable").itertuples(index=False):
                if r[-1] != digest:
                    digest, version = r[-1], version + 1
                    out.append((*r[:-1], version))
        if out:
            self.last.update((digest, version))
            yield pd.DataFrame(out, columns=[*self.columns, "version"])

    def close(self) -> None:
        pass


class Heartbeat(StreamingQueryListener):
    """A JSON line for each event of a run: when it was, how many rows the batch had and how long it took."""

    def __init__(self, path: str):
        self.path = Path(path)
        self.path.parent.mkdir(parents=True, exist_ok=True)

    def _beat(self, **what) -> None:
        with self.path.open("a", encoding="utf-8") as f:
            f.write(json.dumps({"time": time.time()} | what) + "\n")

    def onQueryStarted(self, event) -> None:
        self._beat(event="started", run=str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._beat(event="progress", run=str(p.runId), batch=p.batchId, rows=p.numInputRows, seconds=(p.durationMs or {}).get("triggerExecution", 0) / 1000)

    def onQueryIdle(self, event) -> None:
        self._beat(event="idle", run=str(event.runId))

    def onQueryTerminated(self, event) -> None:
        self._beat(event="ended", run=str(event.runId), failed=event.exception is not None)


def run(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, key: str, score: Callable[[DataFrame], DataFrame], *, stop_file: str | None = None, files_a_batch: int = 16) -> StreamingQuery:
    """Starts a run over what there is. Rows of a null key are no task's and are left out."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source).where(F.col(key).isNotNull())
    columns = stream.columns
    kinds = dict(stream.dtypes)
    digest = next(n for n in ("digest", *(f"digest{i}" for i in range(len(columns) + 1))) if n not in columns)
    digested = stream.withColumn(digest, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))
    out = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", version int"
    fresh = digested.groupBy(key).transformWithStateInPandas(statefulProcessor=_Versions(columns), outputStructType=out, outputMode="Append", timeMode="None")

    def write(batch: DataFrame, batch_id: int) -> None:
        if stop_file and Path(stop_file).exists():
            raise StopRequested(stop_file)
        score(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, sink: str, key: str) -> DataFrame:
    """The last version of each key."""
    return keep_one(spark.read.parquet(sink), [key], ["version", "batch"], last=True)


def signals(beats: DataFrame, target_rows: int, now: float | None = None) -> DataFrame:
    """One row for the monitor's verdict, from the heartbeat's lines (time, event, rows, seconds): rows so far, the latest batches' seconds a row, the age of the last beat, whether the run goes on."""
    at = F.lit(time.time() if now is None else now)
    last = F.max_by("event", "time")
    a_row = F.when(F.col("rows") > 0, F.col("seconds") / F.col("rows"))
    one = beats.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.avg(a_row).alias("window_avg_sec"), F.percentile(a_row, 0.95).alias("window_p95_sec"), ((at - F.max("time")) / 60).alias("heartbeat_age_min"), (last != "ended").alias("process_alive"))
    return one.withColumns({
        "target_rows": F.lit(target_rows), "output_age_min": F.lit(None).cast("double"), "log_age_min": F.lit(None).cast("double"), "benchmark_age_min": F.lit(None).cast("double"),
        "benchmark_passed": F.lit(None).cast("boolean"), "blocked_in_log": F.lit(False),
    })
