"""Samples that match target category proportions.

Cells (which categories a record is in, over all margins) are raked to the targets by iterative proportional fitting, one
weight per cell. Records then draw exponential keys with their cell's weight, and the least keys of a request win. Keys are
counted in narrow buckets, so that a task decides from counts alone how many each cell gives: the winners first, then
exchanges between cells that repair minimums, and shares after them. Of each cell the least keys are taken; only the rows of
the bucket where a cell's share ends are ranked. Residual gaps are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadquarry.runtime import Scratch

#: Buckets of keys per doubling: the rows that one cell ranks are about 1 / 180 of those below.
BUCKETS = 128
IPF_ROUNDS = 1_000
IPF_TOLERANCE = 1e-9
#: Numbers (requests x categories x cells) that are raked at once.
RAKE_AT_ONCE = 1 << 20


def stratum_name(c: Column) -> Column:
    """One spelling per stratum: case, outer spaces, hyphens and inner spaces make no difference; empty is null."""
    name = F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))), r"[\s\-_]+", "_")
    return F.when(name != "", name)


def rake(counts: np.ndarray, member: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights per cell so that weighted shares meet each margin, for one request or (with a leading axis) many at once.

    ``member`` lists margins as (category x cell incidence, target shares). A cell may lie in several categories of a margin
    or in none; categories without cells are skipped.
    """
    many = counts.ndim == 2
    n = counts if many else counts[None]
    margins = [(i if many else i[None], t if many else t[None]) for i, t in member]
    w = np.ones(n.shape)
    # A cell in several categories moves by their geometric mean.
    means = [np.where(i.sum(axis=1) > 0, 1 / np.maximum(i.sum(axis=1), 1), 0.0) for i, _ in margins]
    todo = np.flatnonzero((n * w).sum(axis=1) > 0)
    for _ in range(IPF_ROUNDS):
        if not len(todo):
            break
        v = w[todo]
        for (i, t), mean in zip(margins, means):
            mass = n[todo] * v
            have = np.einsum("rsc,rc->rs", i[todo], mass) / np.maximum(mass.sum(axis=1, keepdims=True), 1e-300)
            goal = t[todo]
            factor = np.where((have > 0) & (goal > 0), goal / np.where(have > 0, have, 1), np.where(goal > 0, 1.0, 1e-6))
            v = v * np.exp(np.einsum("rsc,rs->rc", i[todo], np.log(factor)) * mean[todo])
        v = v / np.maximum(v.max(axis=1, keepdims=True), 1e-300)
        moved = np.abs(v - w[todo]).max(axis=1)
        w[todo] = v
        todo = todo[moved >= IPF_TOLERANCE]
    w = np.maximum(w, 1e-9)
    return w if many else w[0]


def _by_request(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of batches sorted by request_id, request by request; a request may span batches."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and held[-1]["request_id"] != r["request_id"]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _rake_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells (request_id, strata, side, n, t_names, t_shares), few of each request, to their numbers and weights."""

    def flush(group: list[list[dict]]) -> pa.RecordBatch:
        most = max(map(len, group))
        names = max(len(x[0]["t_names"]) for x in group)
        sides = max(len({c["side"] for c in x}) for x in group)
        counts, inc, goal = np.zeros((len(group), most)), np.zeros((len(group), names, most)), np.zeros((len(group), names))
        inc2, goal2 = np.zeros((len(group), sides, most)), np.zeros((len(group), sides))
        for g, cells in enumerate(group):
            at, side_at = {s: i for i, s in enumerate(cells[0]["t_names"])}, {s: i for i, s in enumerate(sorted({c["side"] for c in cells}))}
            goal[g, : len(at)] = cells[0]["t_shares"]
            for k, c in enumerate(cells):
                counts[g, k] = c["n"]
                inc2[g, side_at[c["side"]], k] = 1
                for s in c["strata"]:
                    if s in at:
                        inc[g, at[s], k] = 1
            goal2[g] = inc2[g] @ counts[g] / counts[g].sum()
        w = rake(counts, [(inc2, goal2), (inc, goal)])
        cells = [(c["request_id"], k, c["strata"], c["side"], float(w[g, k])) for g, x in enumerate(group) for k, c in enumerate(x)]
        cols = list(zip(*cells))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.float64())], ["request_id", "cell", "strata", "side", "weight"])

    group: list[list[dict]] = []
    widest = 0
    for cells in _by_request(batches):
        widest = max(widest, len(cells) * (len(cells[0]["t_names"]) + 2))
        group.append(cells)
        if len(group) * widest >= RAKE_AT_ONCE:
            yield flush(group)
            group, widest = [], 0
    if group:
        yield flush(group)


def settle(strata: list[set[str]], buckets: list[list[tuple[int, int]]], target: int, shares: dict[str, float], minimum: dict[str, int]) -> list[int]:
    """How many records each cell gives. ``strata``: the categories of each cell; ``buckets``: its (bucket, count), ascending.

    The least keys come first; where their last bucket holds more than the target needs, cells give of it in proportion. Then
    exchanges repair minimums, and shares after them. A record that lies in several categories serves each. An exchange takes
    from the cell of the category that lacks most whose next key is least, and gives up records of a cell outside that
    category: while minimums are repaired of the cell whose categories have most to spare and stay at their minimums,
    afterwards of the one with the greatest last key whose categories stay at what they should have. So what is lacking falls
    with every exchange; with none to give up records are added only up to the target.
    """
    cats = [x & shares.keys() for x in strata]
    size = [sum(n for _, n in b) for b in buckets]
    target = min(target, sum(size))
    ends = [np.cumsum([n for _, n in b]) for b in buckets]
    k = [0] * len(cats)
    flat = sorted({b for x in buckets for b, _ in x})
    at = [dict(x) for x in buckets]
    left = target
    for b in flat:
        here = [x.get(b, 0) for x in at]
        total = sum(here)
        if total <= left:
            k = [x + y for x, y in zip(k, here)]
            left -= total
            continue
        part = [left * y // total for y in here]
        for i in sorted(range(len(here)), key=lambda i: (-(left * here[i] % total), i))[: left - sum(part)]:
            part[i] += 1
        k = [x + y for x, y in zip(k, part)]
        left = 0
        break
    least = {s: minimum.get(s) or 0 for s in shares}
    share = {s: max(least[s], int(np.floor(target * (p or 0.0) + 1e-9))) for s, p in shares.items()}
    have = {s: sum(n for n, x in zip(k, cats) if s in x) for s in shares}
    chosen = sum(k)

    def bucket(i: int, rank: int) -> tuple[int, int]:
        """The bucket of a cell's record by rank (from 0), and how many of it rank from there on."""
        j = int(np.searchsorted(ends[i], rank, side="right"))
        return buckets[i][j][0], int(ends[i][j]) - rank

    for want in (least, share, least):  # what shares gave up may serve a minimum
        stuck: set[str] = set()
        while True:
            lacking = [(have[s] - want[s], s) for s in shares if have[s] < want[s] and s not in stuck]
            if not lacking:
                break
            short, s = min(lacking)
            fresh = [(*bucket(i, k[i]), i) for i, x in enumerate(cats) if s in x and k[i] < size[i]]
            if not fresh:
                stuck.add(s)
                continue
            _, room, new = min(fresh, key=lambda x: (x[0], x[2]))
            move = min(-short, room)
            if chosen < target:
                move = min(move, target - chosen)
                chosen += move
            else:
                givers = []
                for i, x in enumerate(cats):
                    spare = min((have[y] - want[y] for y in x - cats[new]), default=k[i])
                    if k[i] and s not in x and spare > 0:
                        last = bucket(i, k[i] - 1)[0]
                        merit = last if want is share else min((have[y] - share[y] for y in x), default=target)
                        givers.append((merit, i, spare))
                if not givers:
                    stuck.add(s)
                    continue
                _, out, spare = max(givers)
                move = min(move, spare, k[out])
                k[out] -= move
                for y in cats[out]:
                    have[y] -= move
            k[new] += move
            for y in cats[new]:
                have[y] += move
            stuck.clear()
    return k


def _settle_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells (request_id, cell, buckets, counts, strata, target, t_names, t_shares, t_mins), sorted, to where each ends: below
    ``last`` all its records are chosen, of that bucket itself ``rest``."""
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, t) for c, t in zip(cols[1:], (pa.int32(), pa.int32(), pa.int64()))]], ["request_id", "cell", "last", "rest"])

    for rows in _by_request(batches):
        first = rows[0]
        cells: dict[int, list[tuple[int, int]]] = {}
        strata = {}
        for r in rows:
            cells[r["cell"]] = list(zip(r["buckets"], r["counts"]))
            strata[r["cell"]] = set(r["strata"])
        names = sorted(cells)
        shares, minimum = dict(zip(first["t_names"], first["t_shares"])), dict(zip(first["t_names"], first["t_mins"]))
        for c, k in zip(names, settle([strata[c] for c in names], [cells[c] for c in names], first["target"], shares, minimum)):
            if k:
                for b, n in cells[c]:
                    if k <= n:
                        out.append((first["request_id"], c, b, k))
                        break
                    k -= n
        if len(out) >= 20_000:
            yield flush()
            out = []
    yield flush()


def requests_of(targets: DataFrame, scope: list[str]) -> DataFrame:
    """One row per request: scope, target and its strata as arrays. Repeated strata of a request: the largest figures hold.

    Rows with a null request or stratum are left out; null shares and minimums count as 0; a null or negative target as 0.
    """
    rows = targets.where("request_id is not null").withColumn("_s", stratum_name(F.col("source_stratum"))).where("_s is not null")
    rows = rows.groupBy("request_id", *scope, "_s").agg(
        F.max("target_count").alias("t"), F.max(F.coalesce("target_share", F.lit(0.0))).alias("p"), F.max(F.coalesce("min_count", F.lit(0))).alias("m"))
    return rows.groupBy("request_id", *scope).agg(
        F.greatest(F.coalesce(F.max("t"), F.lit(0)), F.lit(0)).alias("target"),
        F.array_sort(F.collect_list(F.struct(F.col("_s").alias("s"), "p", "m"))).alias("x"),
    ).select("request_id", *scope, "target", F.col("x.s").alias("t_names"), F.col("x.p").alias("t_shares"), F.col("x.m").alias("t_mins"))


def _grows(df: DataFrame) -> DataFrame:
    """A side of a join that grows with requests or records: merged, never broadcast."""
    return df.hint("merge")


def stratified_sample(records: DataFrame, requests: DataFrame, scope: list[str], record: str, side: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Draw each request's sample.

    ``records``: one row per observation with scope, ``record``, ``stratum`` and ``side`` (a second margin kept at its own
    share); a record counts in each stratum it was seen in. ``requests``: see requests_of. Returns the chosen records
    (request_id, record, strata, weight) and one report row per request and stratum (available, needed, chosen).
    Records with a null id or scope take part in nothing; a request without records gets report rows with zeros.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "stratified")
    requests = scratch.keep(requests, "requests")
    wanted = records.join(_grows(requests.select(*scope).distinct()), scope, "left_semi").where(F.col(record).isNotNull())
    pool = wanted.groupBy(*scope, F.col(record).alias("record")).agg(
        F.array_sort(F.collect_set("stratum")).alias("strata"), F.max(F.col(side).cast("string")).alias("side"))
    pool = scratch.keep(pool.withColumn("side", F.coalesce("side", F.lit("?"))), "pool")
    cells = pool.groupBy(*scope, "strata", "side").agg(F.count("*").alias("n"))
    raked = cells.join(_grows(requests), scope).select("request_id", "strata", "side", "n", "t_names", "t_shares").repartition("request_id").sortWithinPartitions("request_id", "strata", "side")
    raked = scratch.keep(raked.mapInArrow(_rake_sorted, "request_id string, cell int, strata array<string>, side string, weight double"), "raked")
    unit = (F.pmod(F.xxhash64("request_id", "record", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    keyed = (
        pool.join(_grows(requests.select("request_id", *scope)), scope).join(_grows(raked), ["request_id", "strata", "side"])
        .select("request_id", "record", "cell", (-F.log(unit) / F.col("weight")).alias("key"))
        .withColumn("bucket", F.floor(F.log2("key") * BUCKETS).cast("int"))
    )
    keyed = scratch.keep(keyed, "keyed")
    counted = keyed.groupBy("request_id", "cell", "bucket").agg(F.count("*").alias("n"))
    counted = counted.groupBy("request_id", "cell").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("x")).select("request_id", "cell", F.col("x.bucket").alias("buckets"), F.col("x.n").alias("counts"))  # bounded by the buckets
    counted = counted.join(_grows(raked.select("request_id", "cell", "strata")), ["request_id", "cell"]).join(_grows(requests.drop(*scope)), "request_id")
    counted = counted.repartition("request_id").sortWithinPartitions("request_id", "cell")
    ends = scratch.keep(counted.mapInArrow(_settle_sorted, "request_id string, cell int, last int, rest bigint"), "ends")
    reached = keyed.join(_grows(ends), ["request_id", "cell"]).where("bucket <= last")
    rank = F.row_number().over(W.partitionBy("request_id", "cell").orderBy("key", "record"))
    won = reached.where("bucket < last").select("request_id", "cell", "record").unionByName(
        reached.where("bucket = last").withColumn("k", rank).where("k <= rest").select("request_id", "cell", "record"))
    chosen = scratch.keep(won.join(_grows(raked.select("request_id", "cell", "strata", "weight")), ["request_id", "cell"]).select("request_id", "record", "strata", "weight"), "chosen")
    have = chosen.select("request_id", F.explode("strata").alias("s")).groupBy("request_id", "s").agg(F.count("*").alias("chosen"))
    there = pool.select(*scope, F.explode("strata").alias("s")).groupBy(*scope, "s").agg(F.count("*").alias("available"))
    lines = requests.select("request_id", *scope, "target", F.explode(F.arrays_zip("t_names", "t_shares", "t_mins")).alias("t")).select(
        "request_id", *scope, F.col("t.t_names").alias("s"), F.col("target"), F.col("t.t_shares").alias("target_share"), F.col("t.t_mins").alias("min_count"))
    report = (
        lines.join(_grows(there), [*scope, "s"], "left").join(_grows(have), ["request_id", "s"], "left")
        .select(
            "request_id", *scope, F.col("s").alias("source_stratum"), "target_share", "min_count",
            F.greatest(F.col("min_count").cast("double"), F.col("target") * F.col("target_share")).alias("needed"),
            F.coalesce("available", F.lit(0)).cast("bigint").alias("available"), F.coalesce("chosen", F.lit(0)).cast("bigint").alias("chosen"),
        )
    )
    return chosen, report
