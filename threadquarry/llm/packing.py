"""Filling fixed-capacity containers with items.

Groups are packed in shards by best-fit decreasing. Dual-feasible functions bound the bin count of each group from below. A
shard above its bound repacks: handfuls of its gapped bins exchange their items and run best-fit decreasing again, until the
bound is met or the tries end. Groups of several shards that are still above their bound reopen their gapped bins, exchange
those items between shards (another hash) and pack them again, and a round is kept only where it saves bins.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadquarry.runtime import Scratch

#: Items that one task packs at once.
SHARD_ITEMS = 2_000
#: Rounds in which shards of a group exchange the items of gapped bins.
EXCHANGES = 2
#: A bin at least this full stays closed in an exchange between shards.
FULL = 0.995
#: Exchanges within a shard above its bound, and the gapped bins that take part in each.
TRIES, HANDFUL = 24, 8
#: Items times capacity up to which an exchange fills its bins by subset sums every second time (memory of the sums, in bits).
SUM_BITS = 1 << 24
#: Full pieces of a cut item that one row becomes at once.
CUT = 4_096
#: Parameters of the dual-feasible functions: u_k rounds to k-ths, f_e drops items below e.
DFF_K = tuple(range(1, 21))
DFF_E = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5)


def dff_sums(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Sums of dual-feasible images of the sizes; they add up over shards, and each, rounded up, is a lower bound."""
    x = sizes.astype(float) / capacity
    out = [x.sum()]
    for k in DFF_K:
        y = (k + 1) * x
        whole = np.abs(y - np.round(y)) < 1e-9
        out.append(np.where(whole, x, np.floor(y + 1e-12) / k).sum())
    for e in DFF_E:
        out.append(np.where(x > 1 - e, 1.0, np.where(x < e, 0.0, x)).sum())
    return np.array(out)


def bound(sums: np.ndarray) -> int:
    return int(np.ceil(np.max(sums) - 1e-7)) if len(sums) else 0


def best_fit(order: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """Items in this order, each into the bin that it leaves least room in; every size is at most the capacity."""
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    bins: list[list[int]] = []
    for i in order:
        j = bisect_left(room, (sizes[i], -1))
        if j < len(room):
            free, b = room.pop(j)
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        insort(room, (free - sizes[i], b))
    return bins


def least_slack(order: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """Bin after bin: the first open item and, by subset sums over bit sets, the fill that leaves least room."""
    bins, open_items = [], list(order)
    mask = (1 << (capacity + 1)) - 1
    while open_items:
        first, rest = open_items[0], open_items[1:]
        sums = [1 << sizes[first]]
        for i in rest:
            sums.append((sums[-1] | sums[-1] << sizes[i]) & mask)
        fill = sums[-1].bit_length() - 1
        chosen = [first]
        for n in range(len(rest), 0, -1):
            if not sums[n - 1] >> fill & 1:
                chosen.append(rest[n - 1])
                fill -= sizes[rest[n - 1]]
        bins.append(chosen)
        gone = set(chosen)
        open_items = [i for i in open_items if i not in gone]
    return bins


def pack(sizes: list[int], capacity: int, tries: int = TRIES) -> tuple[list[list[int]], np.ndarray]:
    """Bins of items by best-fit decreasing, repacked while they are above their bound; and the sums of the bound."""
    sums = dff_sums(np.array(sizes), capacity)
    low = bound(sums)
    down = lambda items: sorted(items, key=lambda i: (-sizes[i], i))
    bins = best_fit(down(range(len(sizes))), sizes, capacity)
    fill = [sum(sizes[i] for i in b) for b in bins]
    rnd = random.Random(len(sizes))
    for t in range(tries):
        gapped = [j for j, f in enumerate(fill) if f < capacity]
        if len(bins) <= low or len(gapped) < 2:
            break
        # The emptiest bin and some others exchange all they hold; what gathers the room in fewer bins is kept.
        emptiest = min(gapped, key=lambda j: (fill[j], j))
        some = {emptiest, *rnd.sample([j for j in gapped if j != emptiest], min(HANDFUL - 1, len(gapped) - 1))}
        items = [i for j in sorted(some) for i in bins[j]]
        if t % 2 or len(items) * capacity > SUM_BITS:
            again = best_fit(sorted(items, key=lambda i: -sizes[i] * (1 + rnd.random())), sizes, capacity)
        else:
            again = least_slack(down(items), sizes, capacity)
        new = [sum(sizes[i] for i in b) for b in again]
        if (-len(again), sum(f * f for f in new)) >= (-len(some), sum(fill[j] ** 2 for j in some)):
            keep = [j for j in range(len(bins)) if j not in some]
            bins, fill = [bins[j] for j in keep] + again, [fill[j] for j in keep] + new
    return bins, sums


_PACKED = "grp string, item string, part bigint, size bigint, capacity bigint, shard int, bin int, fill bigint, bounds array<double>"


def _pack_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by group, shard, item and part, to the same rows with their bins; a shard may span batches."""
    schema = pa.schema([("grp", pa.string()), ("item", pa.string()), ("part", pa.int64()), ("size", pa.int64()), ("capacity", pa.int64()), ("shard", pa.int32()), ("bin", pa.int32()), ("fill", pa.int64()), ("bounds", pa.list_(pa.float64()))])
    held: pa.Table | None = None

    def packed(rows: pa.Table, ends: list[int]) -> Iterator[pa.RecordBatch]:
        sizes, caps = rows.column("size").to_pylist(), rows.column("capacity").to_pylist()
        at, fills, bounds = [0] * len(sizes), [0] * len(sizes), [None] * len(sizes)
        a = 0
        for z in ends:
            bins, sums = pack(sizes[a:z], caps[a])
            bounds[a] = sums.tolist()
            for b, items in enumerate(bins):
                f = sum(sizes[a + i] for i in items)
                for i in items:
                    at[a + i], fills[a + i] = b, f
            a = z
        cols = [*[rows.column(c) for c in schema.names[:6]], pa.array(at, pa.int32()), pa.array(fills, pa.int64()), pa.array(bounds, schema.field("bounds").type)]
        yield from pa.Table.from_arrays(cols, schema=schema).to_batches()

    for batch in batches:
        rows = pa.Table.from_batches([batch]).select(schema.names[:6])
        rows = rows if held is None else pa.concat_tables([held, rows])
        grp, shard = rows.column("grp").to_pylist(), rows.column("shard").to_pylist()
        ends = [i for i in range(1, len(grp)) if grp[i] != grp[i - 1] or shard[i] != shard[i - 1]]
        if ends:
            yield from packed(rows.slice(0, ends[-1]), ends)
            held = rows.slice(ends[-1])
        else:
            held = rows
    if held is not None and held.num_rows:
        yield from packed(held, [held.num_rows])


def _sharded(df: DataFrame, salt: int) -> DataFrame:
    counts = df.groupBy("grp").agg(F.count("*").alias("_n"))
    return (
        df.join(counts, "grp")
        .withColumn("shard", F.pmod(F.xxhash64("item", "part", F.lit(salt)), F.ceil(F.col("_n") / SHARD_ITEMS)).cast("int"))
        .drop("_n")
    )


def _packed(df: DataFrame, salt: int) -> DataFrame:
    rows = _sharded(df, salt).select("grp", "item", F.col("part").cast("bigint").alias("part"), "size", "capacity", "shard")
    return rows.repartition("grp", "shard").sortWithinPartitions("grp", "shard", "item", "part").mapInArrow(_pack_sorted, _PACKED)


def pack_items(items: DataFrame, exchanges: int = EXCHANGES) -> tuple[DataFrame, DataFrame]:
    """Pack (grp string, item string, size bigint, capacity bigint) rows.

    Returns the pieces (grp, item, part, size, capacity, bin string, fill) and the groups (grp, capacity, bins, lower_bound).
    An item above the capacity is cut: full pieces fill bins of their own and the rest is packed like an item; all others stay
    whole. Rows with a null or non-positive size or capacity are the caller's to handle and are left out here.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "packing")
    usable = items.where("grp is not null and item is not null and size > 0 and capacity > 0")
    # An item of many times the capacity becomes rows in two steps, so that no row holds a long array.
    full, cap, size = F.col("_full"), F.col("capacity"), F.col("size")
    cut = usable.select("grp", "item", cap.cast("bigint").alias("capacity"), size.cast("bigint").alias("size"), F.when(size > cap, F.floor(size / cap)).otherwise(0).cast("bigint").alias("_full"))
    parts = cut.where("_full > 0").select("grp", "item", "capacity", "_full", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((full - 1) / CUT))).alias("_b"))
    parts = parts.select("grp", "item", "capacity", F.explode(F.sequence(F.col("_b") * CUT + 1, F.least(full, (F.col("_b") + 1) * CUT))).alias("part"))
    rest = size - full * cap
    pieces = cut.where(rest > 0).select("grp", "item", "capacity", (full + 1).alias("part"), rest.alias("size"), F.lit(False).alias("whole")).unionByName(
        parts.select("grp", "item", "capacity", "part", F.col("capacity").alias("size"), F.lit(True).alias("whole")))
    pieces = scratch.keep(pieces, "pieces")
    full = pieces.where("whole").select("grp", "item", "part", "size", "capacity", F.concat(F.lit("w/"), "item", F.lit("/"), F.col("part").cast("string")).alias("bin"), F.col("size").alias("fill"))
    loose = pieces.where("not whole").drop("whole")
    name = lambda r: F.concat(F.lit(f"r{r}/"), F.col("shard").cast("string"), F.lit("/"), F.col("bin").cast("string"))
    done = scratch.keep(_packed(loose, 0).withColumn("bin", name(0)), "packed")
    width = 1 + len(DFF_K) + len(DFF_E)
    bounds = done.where("bounds is not null").groupBy("grp").agg(*[F.sum(F.col("bounds")[i]).alias(f"b{i}") for i in range(width)])
    bounds = bounds.select("grp", F.ceil(F.greatest(*[F.col(f"b{i}") for i in range(width)]) - 1e-7).alias("lower"))
    bounds = scratch.keep(bounds, "bounds")
    done = done.drop("bounds")
    for r in range(1, exchanges + 1):
        state = done.groupBy("grp").agg(F.count_distinct("bin").alias("bins"), F.max("shard").alias("shards")).join(bounds, "grp").where("bins > lower and shards > 0").select("grp")
        gapped = done.join(state, "grp", "left_semi").where(F.col("fill") < F.col("capacity") * FULL)
        gapped = scratch.keep(gapped.select("grp", "item", "part", "size", "capacity", F.col("bin").alias("old")), f"gapped{r}")
        if gapped.isEmpty():
            break
        again = scratch.keep(_packed(gapped.drop("old"), r).withColumn("bin", name(r)).drop("bounds"), f"again{r}")
        saved = (
            gapped.groupBy("grp").agg(F.count_distinct("old").alias("before"))
            .join(again.groupBy("grp").agg(F.count_distinct("bin").alias("after")), "grp").where("after < before").select("grp")
        )
        saved = scratch.keep(saved, f"saved{r}")
        before = done
        kept = done.join(gapped.join(saved, "grp", "left_semi").select("grp", "item", "part"), ["grp", "item", "part"], "left_anti")
        done = scratch.keep(kept.unionByName(again.join(saved, "grp", "left_semi")), f"done{r}")
        scratch.drop(before if r > 1 else None, gapped, again, saved)
    out = done.select("grp", "item", "part", "size", "capacity", "bin", "fill").unionByName(full)
    groups = (
        out.groupBy("grp").agg(F.max("capacity").alias("capacity"), F.count_distinct("bin").alias("bins"), F.count_if(F.col("bin").startswith("w/")).alias("_w"))
        .join(bounds, "grp", "left")
        .select("grp", "capacity", "bins", (F.coalesce("lower", F.lit(0)) + F.col("_w")).cast("bigint").alias("lower_bound"))
    )
    return out, groups
