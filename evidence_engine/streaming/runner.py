"""Resumable scoring as a stream: what a run has done is its checkpoint, what a restart repeats is dropped by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.relational import keep_one

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def score_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, score: Callable[[DataFrame], DataFrame], files_a_batch: int = 16) -> StreamingQuery:
    """Scores new files of ``source`` and appends to ``sink``, once each: a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, sink: str, key: str) -> DataFrame:
    """One row a key: the first that was written."""
    return keep_one(spark.read.parquet(sink), [key], ["batch"])


def model_scorer(df: DataFrame, score: Scorer, schema: str) -> DataFrame:
    """The seam for a model: Arrow batches in, Arrow batches out, the model loaded once a task."""
    return df.mapInPandas(score, schema)


def mock_answer(question, context):
    """A deterministic stand-in for a model, as a Column: the first context line, or a refusal."""
    first = F.get(F.split(F.coalesce(context, F.lit("")), "\n"), 0)
    return F.when(F.coalesce(first, F.lit("")) == "", F.lit("현재 데이터로는 판단할 수 없습니다.")).otherwise(F.concat(F.coalesce(question, F.lit("")), F.lit(" → "), first))


def windowed_latency(events: DataFrame, time_col: str = "ts", value: str = "value", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Tumbling-window latencies of a stream or a table, late rows up to ``late``."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width)).agg(F.count("*").alias("rows"), F.avg(value).alias("window_avg")).select(F.col("window.start").alias("start"), "rows", "window_avg")
