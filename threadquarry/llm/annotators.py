"""Consensus from several annotators' labels.

Iteratively reweighted voting: a consensus per item and field by weighted votes, then a smoothed accuracy per annotator
and field against the consensus of the *others* on the same items, weights from those accuracies, until stable. What the
last round's leave-one-out hits exceed those of labels dealt at random tells who agrees no better than chance. Agreement
is chance corrected from value counts per item, which copes with missing ratings and never forms pairs of labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadquarry.runtime import BROADCAST_BYTES, Scratch

#: Pseudo-counts of the smoothed accuracy, and the accuracy they stand for.
SMOOTHING = 4.0
PRIOR = 0.6
#: Weights are log odds of the accuracy, held between these.
LEAST_WEIGHT, MOST_WEIGHT = 0.05, 4.0
#: A lead of so much vote weight is a full hit, the same lag none, a tie half a hit. So no tie flips to and fro.
MARGIN = 0.5
#: Stable: no annotator's accuracy in any field moves by more than this.
TOLERANCE = 1e-3
MAX_ROUNDS = 50
#: Labels of an item up to which they are one row.
HOT_LABELS = 1_000
#: Share of the annotators who label at random that p5_found may miss: its one-sided normal deviate is the cut.
CHANCE_ERROR = 1e-4


def holding_labels(df: DataFrame, item: list[str], annotator: str, fields: list[str], latest: list[str], void: str = "unlabeled") -> DataFrame:
    """The latest row of each item and annotator, in long form (item.., annotator, field, value).

    ``latest`` orders rows, last wins, nulls first. ``void`` and null values are no labels; rows with a null item or annotator
    are left out.
    """
    keys = [*item, annotator]
    rows = df.select(*keys, *latest, *fields)
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    held = rows.groupBy(*keys).agg(F.max(F.struct(*latest, *fields)).alias("r"))
    return (
        held.select(*item, F.col(annotator).alias("annotator"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"r.{f}").alias("value")) for f in fields])).alias("x"))
        .select(*item, "annotator", "x.field", "x.value")
        .where(F.col("value").isNotNull() & (F.col("value") != void))
    )


def _tally(labels: DataFrame, item: list[str]) -> DataFrame:
    """Value counts per item and field as a map: bounded by the number of values, whatever the number of labels."""
    per_value = labels.groupBy(*item, "field", "value").agg(F.count("*").alias("n"))
    return per_value.groupBy(*item, "field").agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("counts"), F.sum("n").alias("total"))


def agreement(labels: DataFrame, item: list[str]) -> DataFrame:
    """Per annotator and field, agreement with the others on the same items, against chance.

    pairs: (own label, another's label) couples; observed: share that agree; expected: share that would agree if own and
    others' labels were independent, which gives kappa. z sets the agreeing pairs against own labels dealt to the same items
    at random (others' labels as they are, so that what others agree on weighs as it should); it is about normal under chance.
    Annotators who share no item are absent.
    """
    own = labels.join(_tally(labels, item), [*item, "field"]).where("total > 1")
    own = own.withColumn("same", F.col("counts")[F.col("value")] - 1).withColumn("others", F.col("total") - 1)
    mine = own.groupBy("annotator", "field", "value").agg(F.sum("others").alias("m"), F.count("*").alias("k"))
    parts = mine.groupBy("annotator", "field").agg(F.map_from_entries(F.collect_list(F.struct("value", "k"))).alias("_p"), F.sum("k").alias("_all"))  # bounded by the values
    left = F.transform(F.map_entries("counts"), lambda e: F.struct((F.coalesce(F.try_element_at("_p", e["key"]), F.lit(0)) / F.col("_all")).alias("p"), (e["value"] - F.when(e["key"] == F.col("value"), 1).otherwise(0)).cast("double").alias("n")))
    zero = F.lit(0.0)
    own = own.join(parts, ["annotator", "field"]).withColumn("_l", left)
    own = own.withColumn("_e", F.aggregate("_l", zero, lambda a, x: a + x["p"] * x["n"])).withColumn("_q", F.aggregate("_l", zero, lambda a, x: a + x["p"] * x["n"] * x["n"]))
    base = own.groupBy("annotator", "field").agg(F.sum("others").alias("pairs"), F.sum("same").alias("agreed"), F.sum("_e").alias("_e"), F.sum(F.col("_q") - F.col("_e") * F.col("_e")).alias("_v"))
    theirs = (
        own.select("annotator", "field", F.col("value").alias("own"), F.explode("counts").alias("value", "n"))
        .groupBy("annotator", "field", "value").agg(F.sum(F.col("n") - F.when(F.col("own") == F.col("value"), 1).otherwise(0)).alias("t"))
    )
    chance = mine.join(theirs, ["annotator", "field", "value"]).groupBy("annotator", "field").agg(F.sum(F.col("m").cast("double") * F.col("t")).alias("mt"))
    out = base.join(chance, ["annotator", "field"], "left").withColumn("observed", F.col("agreed") / F.col("pairs"))
    out = out.withColumn("expected", F.coalesce(F.col("mt") / (F.col("pairs").cast("double") * F.col("pairs")), F.lit(0.0)))
    return out.select(
        "annotator", "field", "pairs", "observed", "expected",
        F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).alias("kappa"),
        F.when(F.col("_v") > 1e-9, (F.col("agreed") - F.col("_e")) / F.sqrt("_v")).otherwise(F.lit(0.0)).alias("z"),
    )


def field_agreement(labels: DataFrame, item: list[str]) -> DataFrame:
    """Per field, Krippendorff's alpha for nominal values with missing ratings: items with one label add nothing."""
    tally = _tally(labels, item).where("total > 1")
    per_value = tally.select("field", F.col("total").alias("m"), F.explode("counts").alias("value", "n"))
    within = per_value.groupBy("field").agg(F.sum(F.col("n") * (F.col("n") - 1) / (F.col("m") - 1)).alias("agree"), F.sum("n").alias("labels"))
    totals = per_value.groupBy("field", "value").agg(F.sum("n").alias("nv")).groupBy("field").agg(F.sum(F.col("nv").cast("double") * (F.col("nv") - 1)).alias("ee"))
    out = within.join(totals, "field")
    n = F.col("labels").cast("double")
    seen, chance = F.col("agree") / n, F.col("ee") / (n * (n - 1))
    return out.select("field", "labels", seen.alias("observed"), chance.alias("expected"), F.when(chance < 1, (seen - chance) / (1 - chance)).alias("alpha"))


def _best(entries):
    """Of (value, w, ..) entries the heaviest value; ties go to the least value."""
    return F.aggregate(
        entries, F.struct(F.lit(None).cast("string").alias("value"), F.lit(-1.0).alias("w")),
        lambda acc, e: F.when((e["w"] > acc["w"] + 1e-9) | ((F.abs(e["w"] - acc["w"]) <= 1e-9) & (e["value"] < acc["value"])), F.struct(e["value"].alias("value"), e["w"].alias("w"))).otherwise(acc),
    )


def _credit(others, value):
    """How far ``value`` leads the other entries of a vote (field, value, w), as a hit from 0 to 1."""
    own = F.aggregate(others, F.lit(0.0), lambda a, v: F.when(v["value"] == value, v["w"]).otherwise(a))
    rest = F.aggregate(others, F.lit(0.0), lambda a, v: F.when(v["value"] != value, F.greatest(a, v["w"])).otherwise(a))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + (own - rest) / (2 * MARGIN)))


def _numbered(df: DataFrame, columns: list[str], name: str, scratch: Scratch) -> DataFrame:
    """Distinct rows of ``columns`` with a number, written so that the number stays."""
    return scratch.keep(df.select(*columns).distinct().withColumn(name, F.monotonically_increasing_id()), name)


def _small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def consensus(labels: DataFrame, item: list[str]) -> tuple[DataFrame, DataFrame]:
    """Consensus (item.., field, value, share, labels) and reliability (annotator, field, labels, accuracy, weight, hits, dealt, z).

    ``labels``: one row per item, annotator and field. share is the consensus value's part of the vote weight. An item with one
    label takes it; ties go to the least value. labels and accuracy of an annotator count only items that others labelled too;
    without such items the prior stays. hits: leave-one-out hits; dealt: those expected of the same labels dealt to the same
    items at random; z: hits beyond dealt in standard deviations, 0 where dealing changes nothing (always the same label), null
    without items.

    An item's labels are one row, judged in Arrow batches against weights that each task receives, and only sums per annotator
    are shuffled. Items of more than HOT_LABELS labels stay in rows and are judged by joins with one sum per value, and so is
    everything where the weights of all annotators are too large to send.
    """
    scratch = Scratch(labels.sparkSession, "annotators")
    labels = scratch.keep(labels.select(*item, "annotator", "field", "value"), "labels")
    size = labels.select("annotator").distinct().agg(F.count("*").alias("n"), F.sum(F.length("annotator") + 32).alias("bytes")).first()
    fields = labels.select("field").distinct().count()
    if (size["bytes"] or 0) * max(1, fields) <= BROADCAST_BYTES:
        return _packed(labels, item, scratch)
    return _joined(labels, item, scratch)


def _smoothed(hits, seen):
    return (hits + SMOOTHING * PRIOR) / (seen + SMOOTHING)


def _packed(labels: DataFrame, item: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The voting with weights that fit into a task: arrays by annotator and field, whose size the caller has checked."""
    spark = labels.sparkSession
    names = [r[0] for r in labels.select("annotator").distinct().orderBy("annotator").collect()]
    fields = [r[0] for r in labels.select("field").distinct().orderBy("field").collect()]
    hot = scratch.keep(labels.groupBy(*item).agg(F.count("*").alias("n")).where(F.col("n") > HOT_LABELS).select(*item), "hot")
    rows = None
    cold = labels
    if not hot.isEmpty():
        cold, rows = labels.join(hot, item, "left_anti"), labels.join(hot, item, "left_semi")
        rows = scratch.keep(rows.groupBy(*item, "annotator").agg(F.collect_list(F.struct("field", "value")).alias("said")).join(_numbered(rows, item, "it", scratch), item).select("it", F.col("annotator").alias("an"), "said"), "rows")
    said = scratch.keep(cold.groupBy(*item).agg(F.collect_list(F.struct("annotator", "field", "value")).alias("said")).select("said"), "said")
    shape = (len(names), len(fields))
    at, of = {n: i for i, n in enumerate(names)}, {f: i for i, f in enumerate(fields)}
    accuracy, weight, seen = np.full(shape, PRIOR), np.ones(shape), np.zeros(shape, np.int64)
    used = weight

    def table(w: np.ndarray) -> DataFrame:
        return spark.createDataFrame([(n, {f: float(w[i, j]) for j, f in enumerate(fields)}) for i, n in enumerate(names)], "an string, w map<string,double>")

    for _ in range(MAX_ROUNDS if names else 0):
        used = weight
        hits, seen = np.zeros(shape), np.zeros(shape, np.int64)
        for r in said.mapInArrow(_judge(names, fields, used), "a int, f int, hits double, seen bigint").groupBy("a", "f").agg(F.sum("hits").alias("hits"), F.sum("seen").alias("seen")).collect():  # bounded by the weights
            hits[r["a"], r["f"]], seen[r["a"], r["f"]] = r["hits"], r["seen"]
        if rows is not None:
            weighted = rows.join(_small(table(used), len(names), 256), "an")
            for r in _led(weighted, _cast(weighted)).groupBy("an", "field").agg(F.sum("hit").alias("hits"), F.count("*").alias("seen")).collect():  # bounded likewise
                hits[at[r["an"]], of[r["field"]]] += r["hits"]
                seen[at[r["an"]], of[r["field"]]] += r["seen"]
        before, accuracy = accuracy, _smoothed(hits, seen)
        weight = np.clip(np.log(accuracy / (1 - accuracy)), LEAST_WEIGHT, MOST_WEIGHT)
        if np.abs(accuracy - before).max() < TOLERANCE:
            break
    final = said.mapInArrow(_chances(names, fields, used), "an string, field string, value string, c array<struct<value:string,c:double>>")
    if rows is not None:
        weighted = rows.join(_small(table(used), len(names), 256), "an")
        final = final.unionByName(_chances_joined(weighted, _cast(weighted)))
    dealt = _dealt(scratch.keep(final, "judged"), len(names))
    state = [(n, f, int(seen[i, j]), float(accuracy[i, j]), float(weight[i, j])) for n, i in at.items() for f, j in of.items()]
    state = spark.createDataFrame(state, "annotator string, field string, labels bigint, accuracy double, weight double")
    state = labels.select("annotator", "field").distinct().join(state, ["annotator", "field"])
    flat = spark.createDataFrame([(n, f, float(used[i, j])) for n, i in at.items() for f, j in of.items()], "annotator string, field string, w double")
    votes = labels.join(_small(flat, len(names) * len(fields), 64), ["annotator", "field"]).groupBy(*item, "field", "value").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    votes = votes.groupBy(*item, "field").agg(F.collect_list(F.struct("value", "w", "n")).alias("votes"))  # bounded by the values
    return _agreed(votes, item), state.join(dealt.withColumnRenamed("an", "annotator"), ["annotator", "field"], "left")


def _agreed(votes: DataFrame, item: list[str]) -> DataFrame:
    best = _best(F.col("votes"))
    return votes.select(
        *item, "field", best["value"].alias("value"), (best["w"] / F.aggregate("votes", F.lit(0.0), lambda a, v: a + v["w"])).alias("share"),
        F.aggregate("votes", F.lit(0).cast("bigint"), lambda a, v: a + v["n"]).alias("labels"))


class _Batch:
    """The labels of a batch of items, and their votes: groups of equal labels of an item and field, ordered by item and field."""

    def __init__(self, column: pa.ListArray, names: pa.Array, fields: pa.Array, weights: np.ndarray):
        flat = column.flatten()
        counts = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        self.a = pc.index_in(flat.field("annotator"), value_set=names).to_numpy(zero_copy_only=False)
        self.f = pc.index_in(flat.field("field"), value_set=fields).to_numpy(zero_copy_only=False)
        coded = flat.field("value").dictionary_encode()
        v, self.values = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        self.w = weights[self.a, self.f]
        seg = np.repeat(np.arange(len(counts)), counts) * len(fields) + self.f
        keys, self.group = np.unique(seg * max(1, len(self.values)) + v, return_inverse=True)
        self.value = keys % max(1, len(self.values))  # of each group
        _, self.start, self.seg = np.unique(keys // max(1, len(self.values)), return_index=True, return_inverse=True)
        self.size = np.diff(np.append(self.start, len(keys)))  # groups of each item and field
        self.n = np.bincount(self.group, minlength=len(keys))
        self.W = np.bincount(self.group, weights=self.w, minlength=len(keys))
        self.own = self.seg[self.group]  # item and field of each label
        self.met = np.bincount(self.own, minlength=len(self.start))[self.own] > 1


def _best_two(x: np.ndarray, part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each part (ascending ids) the place of its greatest value, that value, and the next one (0 where there is none)."""
    order = np.lexsort((-x, part))
    first = np.searchsorted(part[order], np.arange(parts))
    top = order[first]
    nxt = np.minimum(first + 1, len(order) - 1)
    second = np.where((first + 1 < len(order)) & (part[order[nxt]] == np.arange(parts)), x[order[nxt]], 0.0)
    return top, x[top], second


def _judge(names: list[str], fields: list[str], weights: np.ndarray):
    """Batches of items to the leave-one-out hits of each annotator and field, one set of sums per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, seen = np.zeros(weights.size), np.zeros(weights.size, np.int64)
        for batch in batches:
            if batch.num_rows:
                b = _Batch(batch.column(0), pa.array(names), pa.array(fields), weights)
                top, first, second = _best_two(b.W, b.seg, len(b.start))
                rest = np.where(top[b.own] == b.group, second[b.own], first[b.own])
                hit = np.clip(0.5 + (b.W[b.group] - b.w - rest) / (2 * MARGIN), 0.0, 1.0)
                cell = (b.a * len(fields) + b.f)[b.met]
                hits += np.bincount(cell, weights=hit[b.met], minlength=weights.size)
                seen += np.bincount(cell, minlength=weights.size)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array((at // len(fields)).astype(np.int32)), pa.array((at % len(fields)).astype(np.int32)), pa.array(hits[at]), pa.array(seen[at])], ["a", "f", "hits", "seen"])

    return run


def _chances(names: list[str], fields: list[str], weights: np.ndarray):
    """Batches of items to a row per label that others met: the hit that each value which others gave would have been."""
    kind = pa.list_(pa.struct([("value", pa.string()), ("c", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            b = _Batch(batch.column(0), pa.array(names), pa.array(fields), weights)
            met = np.flatnonzero(b.met)
            counts = b.size[b.own[met]]
            label = np.repeat(np.arange(len(met)), counts)
            group = np.repeat(b.start[b.own[met]] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            mine = group == b.group[met][label]
            kept = ~(mine & (b.n[group] == 1))
            label, group, mine = label[kept], group[kept], mine[kept]
            x = b.W[group] - np.where(mine, b.w[met][label], 0.0)
            top, first, second = _best_two(x, label, len(met)) if len(met) else (np.zeros(0, int),) * 3
            rest = np.where(top[label] == np.arange(len(label)), second[label], first[label])
            c = np.clip(0.5 + (x - rest) / (2 * MARGIN), 0.0, 1.0)
            offsets = np.append(0, np.cumsum(np.bincount(label, minlength=len(met)))).astype(np.int32)
            entries = pa.StructArray.from_arrays([b.values.take(pa.array(b.value[group])), pa.array(c)], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names).take(pa.array(b.a[met])), pa.array(fields).take(pa.array(b.f[met])), b.values.take(pa.array(b.value[b.group[met]])), pa.ListArray.from_arrays(pa.array(offsets), entries).cast(kind)], ["an", "field", "value", "c"])

    return run


def _cast(weighted: DataFrame) -> DataFrame:
    """The votes of items: one sum per value, so that a hot item combines before it moves."""
    cast = weighted.select("it", "w", F.explode("said").alias("s")).groupBy("it", "s.field", "s.value").agg(F.sum(F.col("w")[F.col("s.field")]).alias("w"), F.count("*").alias("n"))
    return cast.groupBy("it").agg(F.collect_list(F.struct("field", "value", "w", "n")).alias("votes"))  # bounded by the values


def _chances_joined(weighted: DataFrame, votes: DataFrame) -> DataFrame:
    return _judged(weighted, votes).select("an", "field", "value", F.transform("others", lambda v: F.struct(v["value"].alias("value"), _credit(F.col("others"), v["value"]).alias("c"))).alias("c"))


def _dealt(final: DataFrame, people: int) -> DataFrame:
    """(an, field, hits, dealt, z): own labels against the same labels dealt at random to the same items, value by value."""
    habit = final.groupBy("an", "field", "value").agg(F.count("*").alias("k")).groupBy("an", "field").agg(F.map_from_entries(F.collect_list(F.struct("value", "k"))).alias("k"), F.sum("k").alias("all"))  # bounded by the values
    p = lambda x: F.coalesce(F.try_element_at("k", x["value"]), F.lit(0)) / F.col("all")
    zero = F.struct(F.lit(0.0).alias("e"), F.lit(0.0).alias("q"), F.lit(0.0).alias("h"))
    step = lambda a, x: F.struct((a["e"] + p(x) * x["c"]).alias("e"), (a["q"] + p(x) * x["c"] * x["c"]).alias("q"), F.when(x["value"] == F.col("value"), x["c"]).otherwise(a["h"]).alias("h"))
    sums = final.join(_small(habit, 4 * people, 256), ["an", "field"]).select("an", "field", F.aggregate("c", zero, step).alias("s"))
    sums = sums.groupBy("an", "field").agg(F.sum("s.h").alias("hits"), F.sum("s.e").alias("dealt"), F.sum(F.col("s.q") - F.col("s.e") * F.col("s.e")).alias("v"))
    return sums.select("an", "field", "hits", "dealt", F.when(F.col("v") > 1e-9, (F.col("hits") - F.col("dealt")) / F.sqrt("v")).otherwise(F.lit(0.0)).alias("z"))


def _joined(labels: DataFrame, item: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The voting by joins alone: items and annotators are numbered once, and rounds move numbers."""
    items = _numbered(labels, item, "it", scratch)
    people = _numbered(labels, ["annotator"], "an", scratch)
    count = people.count()
    # An annotator's fields of an item are one row: a few short strings.
    rows = labels.groupBy(*item, "annotator").agg(F.collect_list(F.struct("field", "value")).alias("said")).join(items, item).join(_small(people, count, 96), "annotator")
    rows = scratch.keep(rows.select("it", "an", "said"), "rows")
    state = scratch.keep(labels.select("annotator", "field").distinct().join(people, "annotator").select("an", "field", F.lit(PRIOR).alias("accuracy"), F.lit(1.0).alias("weight")), "state")
    votes = None
    for r in range(MAX_ROUNDS):
        weights = state.groupBy("an").agg(F.map_from_entries(F.collect_list(F.struct("field", "weight"))).alias("w"))
        weighted = rows.join(_small(weights, count, 256), "an")
        scratch.drop(votes)
        votes = scratch.keep(_cast(weighted), f"votes{r}")
        score = _led(weighted, votes).groupBy("an", "field").agg(F.sum("hit").alias("hits"), F.count("*").alias("seen"))
        accuracy = (F.coalesce("hits", F.lit(0.0)) + SMOOTHING * PRIOR) / (F.coalesce("seen", F.lit(0)) + SMOOTHING)
        new = state.select("an", "field", F.col("accuracy").alias("before"), F.col("weight").alias("used")).join(score, ["an", "field"], "left").withColumn("accuracy", accuracy)
        new = new.withColumn("weight", F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(MOST_WEIGHT), F.log(F.col("accuracy") / (1 - F.col("accuracy"))))))
        new = scratch.keep(new.select("an", "field", "accuracy", "weight", "before", "used", F.coalesce("seen", F.lit(0)).cast("bigint").alias("labels")), f"state{r}")
        moved = new.agg(F.max(F.abs(F.col("accuracy") - F.col("before"))).alias("m")).first()["m"]
        scratch.drop(state)
        state = new
        if moved is None or moved < TOLERANCE:
            break
    used = state.groupBy("an").agg(F.map_from_entries(F.collect_list(F.struct("field", F.col("used").alias("weight")))).alias("w"))
    dealt = _dealt(scratch.keep(_chances_joined(rows.join(_small(used, count, 256), "an"), votes), "judged"), count)
    reliability = state.join(people, "an").join(dealt, ["an", "field"], "left").select("annotator", "field", "labels", "accuracy", "weight", "hits", "dealt", "z")
    each = votes.join(items, "it").select(*item, F.explode(F.array_distinct(F.transform("votes", lambda v: v["field"]))).alias("field"), "votes")
    return _agreed(each.withColumn("votes", F.filter("votes", lambda v: v["field"] == F.col("field"))), item), reliability


def _led(weighted: DataFrame, votes: DataFrame) -> DataFrame:
    """The hit of each label (an, field, hit), from the best and second best of its field's vote: what leads the others is the best
    if that is another value, else the second. Labels that nobody else's label meets are left out."""
    w = lambda v: v["w"]
    fields = F.array_distinct(F.transform("votes", lambda v: v["field"]))

    def of(f):
        own = F.array_sort(F.filter("votes", lambda v: v["field"] == f), lambda a, b: F.when(w(a) > w(b), -1).when(w(a) < w(b), 1).otherwise(0))
        return F.struct(
            F.aggregate(own, F.lit(0).cast("bigint"), lambda a, v: a + v["n"]).alias("total"), own[0]["value"].alias("best"), own[0]["w"].alias("first"), F.coalesce(F.get(own, F.lit(1))["w"], F.lit(0.0)).alias("second"),
            F.map_from_arrays(F.transform(own, lambda v: v["value"]), F.transform(own, w)).alias("by"))

    by_field = votes.select("it", F.map_from_arrays(fields, F.transform(fields, of)).alias("m"))
    said = weighted.join(by_field, "it").select("an", "w", "m", F.explode("said").alias("s")).select("an", "s.field", "s.value", F.col("w")[F.col("s.field")].alias("w"), F.col("m")[F.col("s.field")].alias("x"))
    rest = F.when(F.col("x.best") == F.col("value"), F.col("x.second")).otherwise(F.col("x.first"))
    lead = F.col("x.by")[F.col("value")] - F.col("w") - rest
    return said.where("x.total > 1").select("an", "field", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + lead / (2 * MARGIN))).alias("hit"))


def _judged(weighted: DataFrame, votes: DataFrame) -> DataFrame:
    """Each label (an, field, value) with the vote of the others on its item: own weight taken from own value, and that value
    gone if nobody else gave it. Labels that nobody else's label meets are left out."""
    said = weighted.join(votes, "it").select("an", "w", "votes", F.explode("said").alias("s")).select("an", "s.field", "s.value", F.col("w")[F.col("s.field")].alias("w"), "votes")
    mine = lambda v: v["value"] == F.col("value")
    others = F.transform(F.filter("votes", lambda v: (v["field"] == F.col("field")) & ((v["n"] > 1) | ~mine(v))), lambda v: F.struct(v["value"].alias("value"), (v["w"] - F.when(mine(v), F.col("w")).otherwise(0.0)).alias("w")))
    return said.select("an", "field", "value", others.alias("others")).where(F.size("others") > 0)
