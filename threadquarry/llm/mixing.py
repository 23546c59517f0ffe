"""Mixing sources to target weights.

A source's share of the mix fixes how often its documents repeat on average. The whole part repeats every document; the
fractional part is an inclusion probability, sampled by the cube method: probabilities move through the null space of the
constraints (tokens and documents) until all but two units of a task are 0 or 1. What tasks leave open meets again, level
by level, until two units per source and mix remain and land.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadquarry.runtime import Scratch

#: Documents of one source and mix that one task balances at once.
SHARD_UNITS = 8_192
EPS = 1e-9


def source_name(c: Column) -> Column:
    """One spelling per source: case, hyphens, inner and outer spaces make no difference; empty is null."""
    name = F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))), r"[\s\-_]+", "_")
    return F.when(name != "", name)


def flight(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Cube flight with two constraints, sum of sizes and count: returns probabilities of which at most two are fractional."""
    p = p.copy()
    open_units = [int(i) for i in np.flatnonzero((p > EPS) & (p < 1 - EPS))]
    rest = iter(open_units)
    hand: list[int] = []
    while True:
        while len(hand) < 3:
            i = next(rest, None)
            if i is None:
                return p
            hand.append(i)
        # Constraint columns are (size / p0, 1 / p0)-weighted in the textbook; moving p itself keeps sum(p * size) and sum(p).
        a, b, c = (float(sizes[i]) for i in hand)
        v = np.array([b - c, c - a, a - b])
        if np.abs(v).max() < EPS:
            v = np.array([1.0, -1.0, 0.0])
        q = p[hand]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(v > 0, (1 - q) / v, np.where(v < 0, -q / v, np.inf)).min()
            down = np.where(v > 0, q / v, np.where(v < 0, (q - 1) / v, np.inf)).min()
        q = q + up * v if rng.random() < down / (up + down) else q - down * v
        q = np.where(q < EPS, 0.0, np.where(q > 1 - EPS, 1.0, q))
        p[hand] = q
        hand = [i for i, x in zip(hand, q) if 0.0 < x < 1.0]


def land(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Round what a flight left (few units): of all roundings the one nearest in tokens, then in count."""
    at = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    if not len(at):
        return p
    want, count = float((p[at] * sizes[at]).sum()), float(p[at].sum())
    best = min(range(1 << len(at)), key=lambda m: (abs(sum(sizes[i] for j, i in enumerate(at) if m >> j & 1) - want), abs(bin(m).count("1") - count), m))
    p = p.copy()
    p[at] = [float(best >> j & 1) for j in range(len(at))]
    return p


_UNITS = "mix_id bigint, source string, doc_id bigint, tokens bigint, p double"


def _fly(seed: int, last: bool):
    def run(key, pdf):
        pdf = pdf.sort_values("doc_id", kind="stable").reset_index(drop=True)
        rng = np.random.default_rng(zlib.crc32(f"{seed}/{key[0]}/{key[1]}/{key[2]}".encode()))
        order = rng.permutation(len(pdf))
        sizes = pdf["tokens"].to_numpy(dtype=float)[order]
        p = flight(pdf["p"].to_numpy(dtype=float)[order], sizes, rng)
        if last:
            p = land(p, sizes)
        out = pdf[["mix_id", "source", "doc_id", "tokens"]].iloc[order].copy()
        out["p"] = p
        return out

    return run


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: available tokens, wanted tokens (share of all tokens), whether even the cap falls ``short`` of them, the
    ``goal`` in tokens and the average repeats that gives.

    Where sources are short, a mix of all tokens' size would give the others more than their shares of what is there. The mix
    then has the largest size at which short sources are used up to their caps and all others meet their shares: what the
    short ones have, over the share that is theirs. A source without tokens leaves its share to all others alike.
    ``exact_tokens`` is the largest size at which every share could be met. ``sizes`` is (source, tokens, docs) per source with
    canonical names. Sources without documents have 0 tokens; repeated rows of a mix and source: the largest figures hold; null
    mixes and sources are left out."""
    t = targets.withColumn("source", source_name(F.col("source"))).where("mix_id is not null and source is not null")
    t = t.groupBy("mix_id", "source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"))
    all_tokens = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    out = t.join(sizes, "source", "left").crossJoin(F.broadcast(all_tokens))  # one row
    out = out.select("mix_id", "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"), "all_tokens")
    wanted = F.col("target_share") * F.col("all_tokens")
    out = out.withColumn("wanted", wanted).withColumn("cap", F.col("tokens") * F.col("max_repeats")).withColumn("short", F.col("cap") < F.col("wanted"))
    bound = F.col("short") & (F.col("cap") > 0)
    exact = F.min(F.when(F.col("target_share") > 0, F.least(F.col("all_tokens").cast("double"), F.col("cap") / F.col("target_share"))))
    per_mix = out.groupBy("mix_id").agg(
        exact.alias("exact_tokens"), (F.sum(F.when(bound, F.col("cap"))) / F.sum(F.when(bound, F.col("target_share")))).alias("_size"))
    out = out.join(per_mix, "mix_id")
    goal = F.least(F.when(bound, F.col("cap")).otherwise(F.col("target_share") * F.coalesce("_size", "all_tokens")), F.col("cap"))
    return out.withColumn("goal", goal.cast("double")).withColumn("repeats", F.when(F.col("tokens") > 0, F.col("goal") / F.col("tokens")).otherwise(0.0)).drop("_size", "cap")


def mix(docs: DataFrame, targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Mix ``docs`` (doc_id bigint, source, tokens bigint) by ``targets`` (mix_id, source, target_share, max_repeats).

    Returns (mix_id, source, doc_id, tokens, repeats) for documents used at least once, and one report row per mix and source
    with wanted and actual tokens and shares. Documents of unknown or null source, and those without tokens, are not used.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    docs = scratch.keep(docs.select("doc_id", source_name(F.col("source")).alias("source"), F.coalesce("tokens", F.lit(0)).alias("tokens")), "docs")
    sizes = scratch.keep(docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "sizes")
    planned = scratch.keep(plan(sizes, targets), "plan")
    units = docs.where("tokens > 0 and doc_id is not null and source is not null").join(planned.select("mix_id", "source", "repeats").where("repeats > 0"), "source")
    units = units.select("mix_id", "source", "doc_id", "tokens", F.floor("repeats").alias("whole"), (F.col("repeats") - F.floor("repeats")).alias("p"))
    units = scratch.keep(units, "units")
    level, parts = 0, []
    todo = units.where((F.col("p") > EPS) & (F.col("p") < 1 - EPS)).select("mix_id", "source", "doc_id", "tokens", "p")
    counts = planned.agg(F.max("docs").alias("n")).first()["n"] or 0
    while True:
        shards = max(1, -(-counts // SHARD_UNITS))
        last = shards == 1
        flown = (
            todo.withColumn("_s", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.lit(shards)).cast("int")).groupBy("mix_id", "source", "_s")
            .applyInPandas(_fly(seed + level, last), _UNITS)
        )
        flown = scratch.keep(flown, f"flown{level}")
        settled = flown.where(f"p <= {EPS} or p >= {1 - EPS}")
        parts.append(settled.where("p > 0.5").select("mix_id", "source", "doc_id", "tokens", F.lit(1).cast("bigint").alias("n")))
        if last:
            break
        todo = flown.where(f"p > {EPS} and p < {1 - EPS}")
        counts, level = 2 * shards, level + 1
    picked = units.where(f"whole > 0 or p >= {1 - EPS}").select("mix_id", "source", "doc_id", "tokens", (F.col("whole") + F.when(F.col("p") >= 1 - EPS, 1).otherwise(0)).alias("n"))
    for part in parts:
        picked = picked.unionByName(part)
    chosen = picked.groupBy("mix_id", "source", "doc_id", "tokens").agg(F.sum("n").cast("bigint").alias("repeats"))
    chosen = scratch.keep(chosen, "chosen")
    actual = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("actual_tokens"), F.sum("repeats").alias("actual_documents"))
    totals = actual.groupBy("mix_id").agg(F.sum("actual_tokens").alias("mix_tokens"))
    report = (
        planned.join(actual, ["mix_id", "source"], "left").join(totals, "mix_id", "left")
        .select(
            "mix_id", "source", "target_share", "max_repeats", F.col("tokens").cast("bigint").alias("available_tokens"), "wanted", "short", "goal", "repeats", "exact_tokens",
            F.coalesce("actual_tokens", F.lit(0)).cast("bigint").alias("actual_tokens"), F.coalesce("actual_documents", F.lit(0)).cast("bigint").alias("actual_documents"),
            F.coalesce(F.col("actual_tokens") / F.col("mix_tokens"), F.lit(0.0)).alias("actual_share"),
        ).withColumn("share_error", F.col("actual_share") - F.col("target_share"))
    )
    return chosen, report
