"""A cache of verified stage results, by content: keys from everything that may change a result, entries that prove themselves.

An entry holds its payload, the digest of it, the comments it rests on and when the first of these expires. What is read back
is trusted only if digest, sources, references and ids hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadquarry.functions.scalars import canonical_json, cluster_id, signal_id, summary_text

#: What a stage's key is made of; a part that is null stays null in it.
KEY_PARTS = (
    "stage", "normalized_input_hash", "sampling_policy_version", "batch_manifest_hash", "rules_version", "prompt_version", "schema_version", "model_config_ref", "model_name", "model_revision", "identity_verification_required",
)
ENTRY = ["key", "stage", "payload", "result_hash", "sources", "expires_at"]


def stage_key(*missing: str) -> Column:
    """The digest of a row's key parts; ``missing`` names parts that the table lacks and that count as null."""
    parts = sorted(p for p in KEY_PARTS if p not in missing)
    nulls = sorted(missing)
    both = F.struct(*[F.lit(None).cast("string").alias(p) if p in nulls else F.col(p) for p in sorted([*parts, *nulls])])
    return F.sha2(F.to_json(both, {"ignoreNullFields": "false"}), 256)


def signal_entries(keys: DataFrame, members: DataFrame, signals: DataFrame) -> DataFrame:
    """Entries of the signal stage. ``keys``: key, batch_id; ``members``: batch_id, comment_id, expires_at; ``signals``: batch_id,
    signal_id, comment_id, kind, summary. A batch without signals is an entry, too; batches are bounded by their calls."""
    one = F.struct("signal_id", "comment_id", "kind", "summary")
    said = signals.groupBy("batch_id").agg(F.array_sort(F.collect_list(one)).alias("s"))
    rest = members.groupBy("batch_id").agg(F.array_sort(F.collect_set("comment_id")).alias("sources"), F.min("expires_at").alias("expires_at"))
    none = F.array().cast("array<struct<signal_id:string,comment_id:string,kind:string,summary:string>>")
    return _entries(keys.join(rest, "batch_id").join(said, "batch_id", "left").select("key", F.lit("signals").alias("stage"), F.to_json(F.struct(F.coalesce("s", none).alias("signals"))).alias("payload"), "sources", "expires_at"))


def cluster_entries(keys: DataFrame, members: DataFrame, clusters: DataFrame) -> DataFrame:
    """Entries of the cluster stage. ``keys``: key, video_id; ``members``: video_id, comment_id, expires_at of the signals' comments;
    ``clusters``: video_id, cluster_id, comment_ids, summary."""
    said = clusters.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("cluster_id", "comment_ids", "summary"))).alias("c"))
    rest = members.groupBy("video_id").agg(F.array_sort(F.collect_set("comment_id")).alias("sources"), F.min("expires_at").alias("expires_at"))
    return _entries(keys.join(rest, "video_id").join(said, "video_id").select("key", F.lit("cluster").alias("stage"), F.to_json(F.struct(F.col("c").alias("clusters"))).alias("payload"), "sources", "expires_at"))


def _entries(df: DataFrame) -> DataFrame:
    return df.withColumn("result_hash", F.sha2("payload", 256)).select(*ENTRY)


def put(cache: DataFrame | None, entries: DataFrame) -> DataFrame:
    """The cache with new entries in the place of those of their key and stage."""
    if cache is None:
        return entries.select(*ENTRY)
    return cache.join(entries.select("key", "stage"), ["key", "stage"], "left_anti").unionByName(entries.select(*ENTRY))


def expire(cache: DataFrame, now: Column) -> DataFrame:
    """The entries still alive; one is dead at its very moment of expiry."""
    return cache.where(F.col("expires_at") > now)


def probe(wanted: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """``wanted`` (key, stage, ..) plus ``event`` (hit, miss, expired) and, of hits, payload, result_hash and sources. A stage never
    sees the entries of another."""
    e = cache.select("key", "stage", *[F.col(c).alias(f"_{c}") for c in ENTRY[2:]])
    alive = F.col("_expires_at") > now
    return wanted.join(e, ["key", "stage"], "left").select(
        *wanted.columns, F.when(F.col("_expires_at").isNull(), "miss").when(alive, "hit").otherwise("expired").alias("event"), *[F.when(alive, F.col(f"_{c}")).alias(c) for c in ENTRY[2:5]])


_SIGNALS = "struct<signals: array<struct<signal_id: string, comment_id: string, kind: string, summary: string>>>"
_CLUSTERS = "struct<clusters: array<struct<cluster_id: string, comment_ids: array<string>, summary: string>>>"


def signal_faults(hits: DataFrame, version: str) -> DataFrame:
    """(key, code) of hits of the signal stage that may not be used. ``hits``: key, payload, result_hash, sources, expected (the ids of
    the batch, in order)."""
    s = F.from_json("payload", _SIGNALS)["signals"]
    ids = F.transform(s, lambda x: x["comment_id"])
    own = lambda x: signal_id(x["comment_id"], x["kind"], x["summary"], version) == x["signal_id"]
    one = hits.select("key", "payload", "result_hash", "sources", "expected", s.alias("s"), ids.alias("ids"))
    # Ids need NFC, which runs per value: signals are rows there.
    forged = one.select("key", F.explode("s").alias("x")).where(~own(F.col("x")) | (summary_text(F.col("x.summary")) != F.col("x.summary"))).select("key").distinct().withColumn("forged", F.lit(True))
    c = F.col
    code = (
        F.when(c("result_hash") != F.sha2("payload", 256), "result_hash_mismatch").when(c("sources") != c("expected"), "sources_differ").when(c("s").isNull(), "payload_invalid")
        .when((F.size(F.array_distinct("ids")) < F.size("ids")) | (F.size(F.array_except("ids", "expected")) > 0), "reference_invalid").when(c("forged"), "identity_invalid")
    )
    return one.join(forged, "key", "left").select("key", code.alias("code")).where("code is not null")


def cluster_faults(hits: DataFrame, version: str) -> DataFrame:
    """The same for hits of the cluster stage; ``expected`` are the comments of the signals, which clusters must cover exactly."""
    k = F.from_json("payload", _CLUSTERS)["clusters"]
    one = hits.select("key", "payload", "result_hash", "sources", "expected", k.alias("k"), F.flatten(F.transform(k, lambda x: x["comment_ids"])).alias("ids"))
    x = F.col("x")
    forged = one.select("key", F.explode("k").alias("x")).where((cluster_id(x["comment_ids"], x["summary"], version) != x["cluster_id"]) | (summary_text(x["summary"]) != x["summary"])).select("key").distinct().withColumn("forged", F.lit(True))
    c = F.col
    code = (
        F.when(c("result_hash") != F.sha2("payload", 256), "result_hash_mismatch").when(c("sources") != c("expected"), "sources_differ").when(c("k").isNull(), "payload_invalid")
        .when((F.size(F.array_distinct("ids")) < F.size("ids")) | (F.array_sort("ids") != c("expected")), "cover_not_exact").when(c("forged"), "identity_invalid")
    )
    return one.join(forged, "key", "left").select("key", code.alias("code")).where("code is not null")


def batch_manifest_hash(*columns: str) -> Column:
    """The digest of what a stage was given: batch, members, estimates."""
    return F.sha2(canonical_json(*columns), 256)
