"""Streams of collected comments: idempotent intake, incremental upsert, consensus over days."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadquarry.operators.consensus import LEAST_AUTHORS
from threadquarry.operators.merging import KEY, merge_run, upsert
from threadquarry.runtime import Scratch
from threadquarry.sources.sinks import Generations

#: How long evidence lives, and so how late a row may come.
DELAY = "10 days"


def intake(stream: DataFrame, at: str = "collected_at") -> DataFrame:
    """Each comment once, whatever its repeats within the delay; later rows than that are dropped by the watermark."""
    return stream.withWatermark(at, DELAY).dropDuplicatesWithinWatermark(list(KEY))


def author_counts(stream: DataFrame, at: str = "collected_at", window: str = "1 day") -> DataFrame:
    """Comments and (approximately) distinct authors per video and window."""
    return stream.withWatermark(at, DELAY).groupBy(F.window(at, window), "platform", "raw_video_id").agg(F.count("*").alias("comments"), F.approx_count_distinct("raw_author_id").alias("authors"))


#: Parts of a table that an upsert rewrites one by one.
PARTS = 64


def upsert_into(parts: Callable[[int], Generations], order: str = "arrival_seq", count: int = PARTS):
    """A foreachBatch function that merges each micro-batch into a table kept in ``count`` parts by a hash of the key, each with
    versions of its own: ``parts(i)`` is where part i lives. Only the parts that a batch touches are read and written again. A
    replayed batch changes nothing, also where a failure left some of its parts committed."""

    def run(batch: DataFrame, _id: int) -> None:
        fresh = merge_run(batch, order).where("not conflict").drop("conflict", "exact_duplicates").withColumn("_part", F.pmod(F.xxhash64(*KEY), F.lit(count)).cast("int"))
        fresh = Scratch(batch.sparkSession, "upsert").keep(fresh, "fresh", ["_part"])
        for i in sorted(r["_part"] for r in fresh.select("_part").distinct().collect()):  # at most ``count``
            mine = fresh.where(F.col("_part") == i).drop("_part")
            before = parts(i).read()
            parts(i).commit(mine if before is None else upsert(before, mine.select(*before.columns))[0])

    return run


def read_parts(parts: Callable[[int], Generations], count: int = PARTS) -> DataFrame | None:
    """The table that ``upsert_into`` keeps, or none before its first batch."""
    out = None
    for i in range(count):
        part = parts(i).read()
        out = part if out is None else out if part is None else out.unionByName(part)
    return out


LIFETIME_S = 10 * 86_400


def _gather(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    authors = dict(zip(*state.get[:2])) if state.exists else {}
    passed = bool(state.get[2]) if state.exists else False
    now = state.getCurrentWatermarkMs() / 1000  # evidence is dead at its very moment of expiry
    for pdf in batches:
        for author, owner, seen in zip(pdf["author_id"], pdf["owner_id"], pdf["at"]):
            if author is None or owner is None or author == owner:
                continue
            # An author's evidence is alive as long as the latest of it.
            authors[author] = max(seen.timestamp(), authors.get(author, 0.0))
    authors = {a: at for a, at in authors.items() if at + LIFETIME_S > now}
    newly = not passed and len(authors) >= LEAST_AUTHORS
    if not authors:
        if state.exists:
            state.remove()
        return
    # A cluster that has not passed has fewer authors than the threshold; of one that has, so many are kept.
    kept = sorted(authors.items(), key=lambda x: (-x[1], x[0]))[:LEAST_AUTHORS]
    state.update(([a for a, _ in kept], [at for _, at in kept], passed or newly))
    state.setTimeoutTimestamp(int(max(state.getCurrentWatermarkMs() + 1, (min(at for _, at in kept) + LIFETIME_S) * 1000)))
    if newly:
        yield pd.DataFrame({"video_id": [key[0]], "cluster_id": [key[1]], "authors": [len(authors)]})


def consensus_stream(stream: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, cluster_id, authors) once a cluster has enough distinct authors whose evidence is alive together, on whatever
    days they came; ``stream`` has video_id, cluster_id, author_id and at, ``videos`` video_id and author_id. A video's own
    author is no evidence, nor is anything under a video whose author is unknown. Each author's evidence expires singly. State
    per cluster is bounded by the threshold, and ends with its last evidence."""
    owned = stream.withWatermark("at", DELAY).join(videos.select("video_id", F.col("author_id").alias("owner_id")), "video_id")
    return owned.groupBy("video_id", "cluster_id").applyInPandasWithState(
        _gather, "video_id string, cluster_id string, authors int", "authors array<string>, seen array<double>, passed boolean", "append", GroupStateTimeout.EventTimeTimeout)
