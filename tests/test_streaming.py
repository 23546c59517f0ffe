from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd

from threadquarry.sources.sinks import Generations
from threadquarry.streaming import incremental
from threadquarry.streaming.incremental import consensus_stream, intake, read_parts, upsert_into

T0 = datetime(2026, 1, 1)
SCHEMA = "platform string, raw_video_id string, raw_comment_id string, raw_author_id string, text string, like_count bigint, collected_at timestamp, arrival_seq bigint"


def feed(spark, path, rows, schema, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}")


def test_upsert_and_intake(spark, tmp_path):
    src = f"{tmp_path}/in"
    feed(spark, src, [("b", "v", "1", "a", "x", 1, T0, 1), ("b", "v", "1", "a", "x", 1, T0, 2)], SCHEMA, 1)
    g = lambda i: Generations(spark, f"file://{tmp_path}/g/{i}")

    def run():
        q = spark.readStream.schema(SCHEMA).parquet(src).writeStream.foreachBatch(upsert_into(g, count=4)).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    feed(spark, src, [("b", "v", "1", "a", "x", 5, T0, 3), ("b", "v", "1", "z", "x", 9, T0, 4)], SCHEMA, 2)
    run()
    assert [(r["raw_comment_id"], r["like_count"]) for r in read_parts(g, 4).collect()] == [("1", 1)]  # a run in conflict with itself changes nothing
    feed(spark, src, [("b", "v", "1", "a", "x", 7, T0, 5), ("b", "v", "2", "z", "y", 9, T0, 6)], SCHEMA, 3)
    run()
    assert {r["raw_comment_id"]: r["like_count"] for r in read_parts(g, 4).collect()} == {"1": 7, "2": 9}
    assert sum(g(i).current() is not None for i in range(4)) <= 2  # other parts were never written
    q = intake(spark.readStream.schema(SCHEMA).parquet(src)).writeStream.format("memory").queryName("taken").option("checkpointLocation", f"{tmp_path}/ck2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("taken").count() == 2


def test_consensus_over_days(spark, tmp_path):
    schema = "video_id string, cluster_id string, author_id string, at timestamp"
    videos = spark.createDataFrame([("v", "owner"), ("w", None)], "video_id string, author_id string")
    src = f"{tmp_path}/in"
    feed(spark, src, [("v", "k", "a", T0), ("v", "k", "b", T0), ("v", "k", "a", T0), ("v", "k", None, T0), ("v", "k", "owner", T0), *[("w", "k", x, T0) for x in "abcd"]], schema, 1)

    def run():
        q = consensus_stream(spark.readStream.schema(schema).parquet(src), videos).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    assert spark.read.schema("video_id string, cluster_id string, authors int").parquet(f"{tmp_path}/out").count() == 0
    feed(spark, src, [("v", "k", "c", T0 + timedelta(1)), ("v", "l", "c", T0 + timedelta(1))], schema, 2)
    run()
    run()
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("v", "k", 3)]


class State:
    """A state of one key, with a watermark that the test moves."""

    def __init__(self):
        self.value, self.now = None, 0

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)
    hasTimedOut = False

    def getCurrentWatermarkMs(self):
        return self.now

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, at):
        self.timeout = at


def test_evidence_expires_singly():
    state, day = State(), lambda n: T0 + timedelta(n)

    def see(now, *rows):
        state.now = int(day(now).timestamp() * 1000)
        pdf = pd.DataFrame([(a, o, day(n)) for a, o, n in rows], columns=["author_id", "owner_id", "at"])
        return [x["authors"][0] for x in incremental._gather(("v", "k"), iter([pdf] if rows else []), state)]

    assert see(0, ("a", "own", 0), ("b", "own", 4), ("own", "own", 4), (None, "own", 4), ("c", None, 4)) == []
    assert see(11) == [] and state.value[0] == ["b"]  # the first one is gone, the other alive
    assert see(11, ("c", "own", 11)) == [] and see(12, ("d", "own", 12)) == [3]
    assert see(12, ("e", "own", 12)) == [] and len(state.value[0]) == 3  # said once
    assert see(40) == [] and not state.exists
    assert see(40, ("a", "own", 40), ("b", "own", 41), ("c", "own", 42)) == [3]
