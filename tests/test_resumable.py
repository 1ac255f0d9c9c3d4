"""Stopped, failing and repeated runs give each version of each key once."""

import time

import pytest
from pyspark.sql import functions as F

from evidence_engine.operators import gates
from evidence_engine.streaming import resumable

SCHEMA = "id long, text string"


def test_stopped_killed_and_restarted(spark, tmp_path):
    source, sink, checkpoint, stop = (f"{tmp_path}/{n}" for n in ("in", "out", "state", "stop"))
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    beat = resumable.Heartbeat(f"{tmp_path}/beat/run.jsonl")
    spark.streams.addListener(beat)
    broken = {"left": 1}

    def score(df):
        out = df.withColumn("answer", F.concat(F.lit("a:"), "text"))
        if broken["left"] and df.where("id = 3").count():
            broken["left"] -= 1
            raise RuntimeError("lost in the middle of a batch")
        return out

    def go():
        q = resumable.run(spark, source, SCHEMA, sink, checkpoint, "id", score, stop_file=stop, files_a_batch=1)
        q.awaitTermination()

    try:
        put([(1, "one"), (2, "two"), (None, "nobody")])
        put([(3, "three"), (2, "two")])
        with pytest.raises(Exception, match="lost in the middle"):
            go()
        put([(1, "one again"), (4, None)])
        open(stop, "w").close()
        with pytest.raises(Exception, match="StopRequested"):
            go()
        (tmp_path / "stop").unlink()
        go()
        go()  # nothing new
        rows = sorted((r.id, r.version, r.answer) for r in spark.read.parquet(sink).collect())
        assert rows == [(1, 1, "a:one"), (1, 2, "a:one again"), (2, 1, "a:two"), (3, 1, "a:three"), (4, 1, None)]
        assert sorted((r.id, r.answer) for r in resumable.results(spark, sink, "id").collect()) == [(1, "a:one again"), (2, "a:two"), (3, "a:three"), (4, None)]
        time.sleep(2)
        beats = spark.read.schema("time double, event string, run string, batch long, rows long, seconds double, failed boolean").json(f"{tmp_path}/beat")
        assert {r.event for r in beats.collect()} >= {"started", "progress", "ended"}
        verdict = lambda target, late: resumable.signals(beats, target, time.time() + late).select(gates.monitor_verdict()).first()[0]
        assert verdict(1, 0) == "COMPLETED" and verdict(10**6, 3600) == "STALL_CONFIRMED" and verdict(10**6, 0) == "STALL_WARNING"
    finally:
        spark.streams.removeListener(beat)
