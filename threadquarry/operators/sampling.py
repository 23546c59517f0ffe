"""Stratified quotas and selections under a target."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadquarry.functions.scalars import REFILL, STRATA
from threadquarry.operators.ranking import least_per_group

ORDER = tuple(s for s, _ in STRATA)


def _largest_remainder(target: Column, floors: dict[str, Column], remainders: dict[str, Column], tie: list[str]) -> dict[str, Column]:
    left = target
    for s in floors:
        left = left - floors[s]
    out = {}
    for s in floors:
        ahead = F.lit(0)
        for o in floors:
            if o != s:
                first = tie.index(o) < tie.index(s)
                ahead = ahead + F.when((remainders[o] > remainders[s]) | ((remainders[o] == remainders[s]) & F.lit(first)), 1).otherwise(0)
        out[s] = (floors[s] + F.when(ahead < left, 1).otherwise(0)).cast("bigint")
    return out


def collection_quotas(target: Column) -> dict[str, Column]:
    """Quotas per stratum in whole numbers; equal remainders go by name."""
    floors = {s: F.floor(target * w / F.lit(100)) for s, w in STRATA}
    remainders = {s: F.pmod(target * w, F.lit(100)) for s, w in STRATA}
    return _largest_remainder(target, floors, remainders, sorted(ORDER))


def sampling_quotas(target: Column) -> dict[str, Column]:
    """Quotas per stratum in doubles; equal remainders go by the strata's order. Differs from collection_quotas now and then."""
    exact = {s: target.cast("double") * F.lit(w / 100) for s, w in STRATA}
    floors = {s: F.floor(exact[s]) for s in exact}
    return _largest_remainder(target, floors, {s: exact[s] - floors[s] for s in exact}, list(ORDER))


def fold(pools: dict[str, list[str]], quotas: dict[str, int], target: int) -> list[tuple[str, str]]:
    """(stratum, id) in the order taken: quotas first, then the refill order up to the target; an id counts once."""
    taken: dict[str, str] = {}
    for stratum, most in [*((s, quotas[s]) for s in ORDER), *((s, target) for s in REFILL)]:
        n = 0
        for i in pools.get(stratum, ()):
            if n >= most or len(taken) >= target:
                break
            if i not in taken:
                taken[i] = stratum
                n += 1
    return [(s, i) for i, s in taken.items()]


def select(pool: DataFrame, targets: DataFrame, scope: list[str], quotas, order: list[str]) -> DataFrame:
    """Select ids per scope: ``pool`` has scope, stratum, id and the ``order`` columns, ``targets`` scope and target.

    Of each stratum at most twice the target's first rows can matter (the target may be used up by ids of other strata), so
    the fold sees a bounded group whatever the pool's size. Returns scope, stratum, id, position.
    """
    q = quotas(F.col("target"))
    plan = targets.select(*scope, F.greatest("target", F.lit(0)).alias("target")).select("*", *[q[s].alias(f"q_{s}") for s in ORDER], (F.col("target") * 2).alias("_most"))
    rows = pool.where(F.col("stratum").isin(*ORDER) & F.col("id").isNotNull()).join(plan, scope)
    rows = least_per_group(rows, [*scope, "stratum"], order, "_most")
    kinds = {f.name: f.dataType.simpleString() for f in pool.schema}
    by = [*order]

    def run(key, table):
        table = table.sort_by([(c, "ascending") for c in by])
        pools: dict[str, list[str]] = {}
        for s, i in zip(table.column("stratum").to_pylist(), table.column("id").to_pylist()):
            pools.setdefault(s, []).append(i)
        got = fold(pools, {s: table.column(f"q_{s}")[0].as_py() for s in ORDER}, table.column("target")[0].as_py())
        cols = {c: pa.array([k.as_py()] * len(got), k.type) for c, k in zip(scope, key)}
        return pa.table(cols | {"stratum": pa.array([s for s, _ in got], pa.string()), "id": pa.array([i for _, i in got], pa.string()), "position": pa.array(range(1, len(got) + 1), pa.int64())})

    schema = ", ".join(f"{c} {kinds[c]}" for c in scope) + ", stratum string, id string, position bigint"
    return rows.groupBy(*scope).applyInArrow(run, schema)
