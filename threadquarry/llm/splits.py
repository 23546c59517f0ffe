"""Splits that keep related records together.

Related ids are joined into components (alternating large-star / small-star contraction, all aggregations are map-side
combinable minima). Components are balanced by largest differencing: shards of components are packed into equal bins, the
shards' bin tuples are differenced again level by level, and whole bins go to the splits by target proportion.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadquarry.runtime import Scratch

#: Equal bins that components are packed into before bins go to splits. A bin is 1 % of the weight.
BINS = 100
#: Components that one task differences at once; bin tuples of that many shards / BINS are merged at once above it.
SHARD_COMPONENTS = 20_000
MERGE_SHARDS = 200
PROPORTIONS = {"development": 0.4, "calibration": 0.3, "holdout": 0.3}


def star_edges(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Edges (a, b) from each member of a key's group to the group's least member: linear in rows, never all pairs."""
    rows = df.select(*keys, F.col(member).alias("a")).distinct()
    least = rows.groupBy(*keys).agg(F.min("a").alias("b"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return rows.join(least, keys).where("a <> b").select("a", "b")


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) for every id of ``vertices``; the component is named by its least id.

    ``edges`` (a, b) count only where both ends are vertices; loops, repeats and direction make no difference. Ids without
    edges form components of their own. Null ids are left out.
    """
    spark = vertices.sparkSession
    scratch = Scratch(spark, "components")
    ids = scratch.keep(vertices.select(F.col(vertices.columns[0]).alias("id")).where("id is not null").distinct(), "ids")
    e = edges.select("a", "b").where("a <> b")
    e = e.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    e = scratch.keep(e.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    mark = None
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        large = scratch.keep(large, "large")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
            .unionByName(low.select("hi", F.col("m").alias("lo"))).distinct()
        )
        small = scratch.keep(small, "small")
        scratch.drop(large, e)
        e = small
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if (r["n"], r["h"]) == mark:
            break
        mark = (r["n"], r["h"])
    return ids.join(e.select(F.col("hi").alias("id"), "lo"), "id", "left").select("id", F.coalesce("lo", "id").alias("component"))


def difference(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multi-way largest differencing of bin tuples.

    ``weights`` is (n, k): row i has the k bin sums of tuple i. Repeatedly the two tuples of widest spread are combined, the
    fullest bin of one with the emptiest of the other. Returns the k sums and, for each (i, bin), the bin it ends in.
    """
    n, k = weights.shape
    if n == 0:
        return np.zeros(k), np.zeros((0, k), dtype=np.int64)
    heap = []
    for i in range(n):
        order = np.argsort(-weights[i], kind="stable")
        sums = weights[i][order]
        heap.append((-(sums[0] - sums[-1]), i, sums, [[(i, int(b))] if weights[i][b] or weights.shape[0] == 1 else [] for b in order]))
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, s1, m1 = heapq.heappop(heap)
        _, _, s2, m2 = heapq.heappop(heap)
        sums = s1 + s2[::-1]
        members = []
        for x, y in zip(m1, m2[::-1]):
            if len(x) < len(y):
                x, y = y, x
            x.extend(y)
            members.append(x)
        order = np.argsort(-sums, kind="stable")
        heapq.heappush(heap, (-(sums[order[0]] - sums[order[-1]]), tick, sums[order], [members[j] for j in order]))
        tick += 1
    _, _, sums, members = heap[0]
    where = np.zeros((n, k), dtype=np.int64)
    for b, rows in enumerate(members):
        for i, c in rows:
            where[i, c] = b
    return sums, where


def _pack_shard(bins: int):
    def pack(key, pdf):
        pdf = pdf.sort_values(["weight", "component"], ascending=[False, True], kind="stable")
        w = np.zeros((len(pdf), bins))
        w[:, 0] = pdf["weight"].to_numpy()
        sums, where = difference(w)
        at = where[:, 0]
        return pd.DataFrame({"component": pdf["component"].to_numpy(), "shard": key[0], "bin": at, "bin_sum": sums[at]})

    return pack


def _merge_shards(bins: int):
    def merge(key, pdf):
        shards = np.sort(pdf["shard"].unique())
        at = {s: i for i, s in enumerate(shards)}
        w = np.zeros((len(shards), bins))
        for s, b, x in zip(pdf["shard"], pdf["bin"], pdf["bin_sum"]):
            w[at[s], b] = x
        sums, where = difference(w)
        rows = pdf["shard"].map(at).to_numpy()
        to = where[rows, pdf["bin"].to_numpy()]
        return pd.DataFrame({"shard": pdf["shard"], "bin": pdf["bin"], "to_shard": key[0], "to_bin": to, "to_sum": sums[to]})

    return merge


def allocate(sums: dict[int, float], proportions: dict[str, float]) -> dict[int, str]:
    """Whole bins to splits: fullest first, each to the split that lacks most of its target."""
    total = sum(sums.values()) or 1.0
    lack = {s: p * total for s, p in proportions.items()}
    out = {}
    for b, w in sorted(sums.items(), key=lambda x: (-x[1], x[0])):
        s = max(lack, key=lambda name: (lack[name], name))
        out[b] = s
        lack[s] -= w
    return out


def balanced_splits(weighted: DataFrame, proportions: dict[str, float] | None = None, bins: int = BINS, shard: int = SHARD_COMPONENTS) -> DataFrame:
    """(component, weight) to (component, weight, split).

    A null or negative weight counts as 0. Every component lands in exactly one split; an empty table gives an empty result.
    Only the fixed number of bin sums reaches the driver.
    """
    proportions = proportions or PROPORTIONS
    spark = weighted.sparkSession
    scratch = Scratch(spark, "splits")
    w = scratch.keep(weighted.select("component", F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight")), "weights")
    shards = max(1, -(-w.count() // shard))
    packed = scratch.keep(
        w.withColumn("_s", F.pmod(F.xxhash64("component"), F.lit(shards)).cast("int")).groupBy("_s")
        .applyInPandas(_pack_shard(bins), "component string, shard int, bin int, bin_sum double"),
        "packed",
    )
    sums = scratch.keep(packed.select("shard", "bin", "bin_sum").distinct(), "sums")
    place = sums.select("shard", "bin", F.col("shard").alias("at_shard"), F.col("bin").alias("at_bin"))
    level = shards
    while level > 1:
        step = scratch.keep(
            sums.withColumn("_g", (F.col("shard") / MERGE_SHARDS).cast("int")).groupBy("_g")
            .applyInPandas(_merge_shards(bins), "shard int, bin int, to_shard int, to_bin int, to_sum double"),
            "merge",
        )
        place = place.join(step.select(F.col("shard").alias("at_shard"), F.col("bin").alias("at_bin"), "to_shard", "to_bin"), ["at_shard", "at_bin"]).select(
            "shard", "bin", F.col("to_shard").alias("at_shard"), F.col("to_bin").alias("at_bin"))
        place = scratch.keep(place, "place")
        scratch.drop(sums if level < shards else None)
        sums = scratch.keep(step.select(F.col("to_shard").alias("shard"), F.col("to_bin").alias("bin"), F.col("to_sum").alias("bin_sum")).distinct(), "sums")
        level = -(-level // MERGE_SHARDS)
    final = {r["bin"]: r["bin_sum"] for r in sums.select("bin", "bin_sum").collect()}  # at most ``bins`` rows
    split_of = allocate(final, proportions)
    names = F.create_map(*[x for b, s in split_of.items() for x in (F.lit(b), F.lit(s))]) if split_of else F.create_map().cast("map<int,string>")
    return (
        w.join(packed.select("component", "shard", "bin"), "component")
        .join(place, ["shard", "bin"])
        .select("component", "weight", F.try_element_at(names, F.col("at_bin")).alias("split"))
    )
