"""An analysis of many videos at once: model calls under a budget, one repair of unreadable output, and clusters merged in layers.

A stage is a table of batches, in order within a video. Videos are folded independently: each has a ledger, and what stops
one stops none of the others. A layer of merging packs every video's nodes into batches, calls the model for each, checks that
its clusters cover the nodes exactly, and passes them on as nodes, until each video has needed one batch only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadquarry.functions.scalars import UNIT, cluster_id, merge_reserve, signal_id, summary_text, text_tokens
from threadquarry.operators.batching import plan_batches
from threadquarry.operators.model_step import Ledger, TransientError
from threadquarry.runtime import Scratch

#: Tokens that names of schemas and envelopes of messages may add to a call.
ENVELOPE = 32
KINDS = ("pain", "need", "alternative", "product_defect")
OPEN, CLOSE = "BEGIN UNTRUSTED DATA", "END UNTRUSTED DATA"
REPAIR = "The last answer did not hold to the schema. Answer again, with ids of the untrusted data only."


@dataclass
class Answer:
    """What a gateway returns beside a bare text: the usage that it reports and who answered, null where unknown."""

    text: str
    input_tokens: int | None = None
    output_tokens: int | None = None
    model: str | None = None
    revision: str | None = None


def prompt(instruction: str, data: Column) -> Column:
    """An instruction, and data between markers that tell a model not to obey it."""
    return F.concat(F.lit(f"{instruction}\n{OPEN}\n"), data, F.lit(f"\n{CLOSE}"))


def data_of(text: str) -> dict:
    """The data of a prompt."""
    return json.loads(text.split(f"\n{OPEN}\n", 1)[1].rsplit(f"\n{CLOSE}", 1)[0])


def call_tokens(text: Column) -> Column:
    return text_tokens(text) + ENVELOPE


# ---------------------------------------------------------------- nodes


def signal_nodes(signals: DataFrame) -> DataFrame:
    """(video_id, node_id, comment_ids, summary, kind): a node of one comment for each signal (video_id, signal_id, comment_id, kind,
    summary)."""
    return signals.select("video_id", F.col("signal_id").alias("node_id"), F.array("comment_id").alias("comment_ids"), summary_text(F.col("summary")).alias("summary"), "kind")


def cluster_nodes(clusters: DataFrame) -> DataFrame:
    """Nodes for the next layer, of clusters (video_id, cluster_id, comment_ids, summary). They have no kind any more."""
    return clusters.select("video_id", F.col("cluster_id").alias("node_id"), "comment_ids", "summary", F.lit(None).cast("string").alias("kind"))


def planning_text() -> Column:
    """A node as the model will see it: its fields in order, a missing kind left out."""
    return F.to_json(F.struct("comment_ids", F.col("node_id").alias("item_id"), "kind", "summary"))


def plan_merge(nodes: DataFrame, limits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One layer's batches (video_id, node_id, batch), and a status per video with nodes, as ``plan_batches`` has them.

    ``limits``: video_id, per_call, reserve (input tokens of all merging calls), fixed, calls_left.
    """
    items = nodes.select(F.col("video_id").alias("plan_id"), F.col("node_id").alias("item_id"), text_tokens(F.concat_ws(UNIT, "node_id", planning_text())).alias("tokens"))
    plans = limits.join(nodes.select("video_id").distinct(), "video_id", "left_semi").select(
        F.col("video_id").alias("plan_id"), "per_call", F.col("reserve").alias("budget"), "fixed", (F.col("calls_left") + 1).alias("max_calls"))  # no call is kept back here
    packed, status = plan_batches(items, plans)
    return packed.select(F.col("plan_id").alias("video_id"), F.col("item_id").alias("node_id"), "batch"), status.withColumnRenamed("plan_id", "video_id")


# ---------------------------------------------------------------- calls


def check_signals(data: dict, answer: str) -> str | None:
    """Why an answer of the signal stage can't be trusted, or none."""
    try:
        parsed = json.loads(answer)
        rows = parsed["signals"]
        if set(parsed) != {"signals"}:
            return "unknown_field"
        ids = [r["comment_id"] for r in rows]
        if any(r["kind"] not in KINDS or not isinstance(r["summary"], str) or not r["summary"].strip() or not isinstance(r.get("disputed", False), bool) for r in rows):
            return "field_invalid"
    except (ValueError, TypeError, KeyError, AttributeError):
        return "not_readable"
    if len(ids) != len(set(ids)):
        return "comment_repeats"
    return None if set(ids) <= {c["comment_id"] for c in data["comments"]} else "comment_not_in_batch"


def check_clusters(data: dict, answer: str) -> str | None:
    """Why proposed clusters don't cover the nodes of a batch exactly, each node whole, or none."""
    try:
        parsed = json.loads(answer)
        groups = [c["comment_ids"] for c in parsed["clusters"]]
        if set(parsed) != {"clusters"}:
            return "unknown_field"
        if any(not isinstance(c["summary"], str) or not c["summary"].strip() or not c["comment_ids"] for c in parsed["clusters"]):
            return "field_invalid"
        at = {i: k for k, g in enumerate(groups) for i in g}
        said = sum(map(len, groups))
    except (ValueError, TypeError, KeyError, AttributeError):
        return "not_readable"
    inputs = {i for n in data["items"] for i in n["comment_ids"]}
    if said != len(at):
        return "overlap"
    if set(at) != inputs:
        return "unknown" if set(at) - inputs else "omitted"
    return "split" if any(len({at[i] for i in n["comment_ids"]}) > 1 for n in data["items"]) else None


_LEDGER = ("calls", "input", "output")
_CALLED = (
    "video_id string, batch bigint, attempt int, status string, code string, answer string, input_hash string, model string, revision string, "
    "input_tokens bigint, output_tokens bigint, calls bigint, input bigint, output bigint"
)


def run_stage(batches: DataFrame, gateway, check: Callable[[dict, str], str | None], retries: int = 2, repairs: int = 1, identity: tuple[str, str] | None = None) -> DataFrame:
    """Call the model for batches (video_id, batch, prompt, tokens, reserved_output, max_calls, max_input, max_output, calls, input,
    output), the last three being what the video has used before. One audit row per attempt, with what is used after it.

    status: ``ok`` (the batch's answer holds), ``invalid`` (an answer that ``check`` refuses, with its code), ``error`` (what the
    gateway raised), ``budget`` (code: the resource), ``identity`` (somebody else answered than ``identity``, a model's name and
    revision). Transport errors are tried again, an invalid answer is repaired once, each by a call of its own that reserves
    anew. A row that ends otherwise than ``ok`` ends its video: none of its later batches is called. Each video's batches are
    bounded by its calls; they stream through the fold.
    """
    import hashlib

    cols = ["video_id", "batch", "prompt", "tokens", "reserved_output", "max_calls", "max_input", "max_output", *_LEDGER]

    def attempts(r: dict, used: Ledger) -> Iterator[tuple]:
        limit = (r["max_calls"], r["max_input"], r["max_output"])
        text, tokens, left, attempt, fixes = r["prompt"], r["tokens"], retries, 0, repairs
        while True:
            attempt += 1
            seen = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
            row = lambda status, code=None, a=None: (
                r["video_id"], r["batch"], attempt, status, code, a.text if a and status == "ok" else None, seen, a.model if a else None, a.revision if a else None,
                a.input_tokens if a else None, a.output_tokens if a else None, used.calls, used.input, used.output)
            if refused := used.refuses(tokens, r["reserved_output"], limit):
                yield row("budget", refused)
                return
            try:
                a = gateway.invoke({"prompt": text, "video_id": r["video_id"], "batch": r["batch"]}, attempt)
            except TransientError as e:
                used.settle(tokens, r["reserved_output"], None, None, limit)
                yield row("error", str(e) or "transient")
                if not left:
                    return
                left -= 1
                continue
            except Exception:  # what a gateway raises beyond that is final
                used.settle(tokens, r["reserved_output"], None, None, limit)
                yield row("error", "error")
                return
            a = a if isinstance(a, Answer) else Answer(a)
            exceeded = used.settle(tokens, r["reserved_output"], a.input_tokens, a.output_tokens, limit)
            if exceeded:
                yield row("budget", exceeded, a)
                return
            if identity and (a.model, a.revision) != identity:
                yield row("identity", "model_identity_unverifiable" if a.revision is None else "model_identity_mismatch", a)
                return
            code = check(data_of(r["prompt"]), a.text)
            yield row("invalid" if code else "ok", code, a)
            if not code or not fixes:
                return
            fixes -= 1
            text = f"{r['prompt']}\n{REPAIR}"
            tokens = r["tokens"] + max(1, -(-len(REPAIR) // 3))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, used, stopped = None, Ledger(), False
        for b in parts:
            out = []
            for r in b.to_pylist():
                if r["video_id"] != video:
                    video, used, stopped = r["video_id"], Ledger(*[r[c] for c in _LEDGER]), False
                if not stopped:
                    rows = list(attempts(r, used))
                    out += rows
                    stopped = rows[-1][3] != "ok"
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, x)) for x in out], schema=_ARROW)

    return batches.select(*cols).repartition("video_id").sortWithinPartitions("video_id", "batch").mapInArrow(run, _CALLED)


_NAMES = [f.split()[0] for f in _CALLED.split(", ")]
_ARROW = pa.schema([(f.split()[0], {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[f.split()[1]]) for f in _CALLED.split(", ")])


def last_attempts(called: DataFrame) -> DataFrame:
    """Per video, where its calls ended: the status and code of its last attempt and all that is used."""
    return called.groupBy("video_id").agg(F.max_by(F.struct("status", "code", *_LEDGER), F.struct("batch", "attempt")).alias("r")).select("video_id", "r.*")


def stage_signals(called: DataFrame, version: str) -> DataFrame:
    """(video_id, signal_id, comment_id, kind, summary) of answers that hold, without disputed ones, ids made anew."""
    schema = "signals array<struct<comment_id: string, kind: string, summary: string, disputed: boolean>>"
    rows = called.where("status = 'ok'").select("video_id", F.explode(F.from_json("answer", schema)["signals"]).alias("s")).select("video_id", "s.*").where("not coalesce(disputed, false)")
    return rows.select("video_id", signal_id(F.col("comment_id"), F.col("kind"), F.col("summary"), version).alias("signal_id"), "comment_id", "kind", summary_text(F.col("summary")).alias("summary"))


def stage_clusters(called: DataFrame, version: str) -> DataFrame:
    """(video_id, batch, cluster_id, comment_ids, summary) of answers that hold, ids made anew from sorted members and summary."""
    schema = "clusters array<struct<comment_ids: array<string>, summary: string>>"
    rows = called.where("status = 'ok'").select("video_id", "batch", F.explode(F.from_json("answer", schema)["clusters"]).alias("c"))
    rows = rows.select("video_id", "batch", F.array_sort("c.comment_ids").alias("comment_ids"), summary_text(F.col("c.summary")).alias("summary"))
    return rows.select("video_id", "batch", cluster_id(F.col("comment_ids"), F.col("summary"), version).alias("cluster_id"), "comment_ids", "summary")


INSTRUCTION = {"signals": "List the needs that the comments state, each with the id of its comment.", "cluster": "Put the items that state the same need together, every item in one cluster."}


def merge_layers(signals: DataFrame, state: DataFrame, gateway, version: str, retries: int = 2, repairs: int = 1, identity: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clusters (video_id, cluster_id, comment_ids, summary), where each video ended (video_id, status, code, layers) and audit rows
    of all layers.

    ``signals``: video_id, signal_id, comment_id, kind, summary. ``state``: video_id, per_call, max_calls, max_input, max_output,
    reserved_output and what was used so far (calls, input, output). Merging may use the reserve of the input, over all layers.
    A video whose layer can't be planned, paid or trusted has no clusters. Layers go on until every video has had one batch in
    its layer or has stopped; a layer that leaves a video as many nodes as before stops it, too (``no_progress``).
    """
    scratch = Scratch(signals.sparkSession, "layers")
    nodes = scratch.keep(signal_nodes(signals), "nodes")
    state = state.select("video_id", "per_call", "max_calls", "max_input", "max_output", "reserved_output", *_LEDGER, merge_reserve(F.col("max_input")).alias("reserve"))
    state = scratch.keep(state.join(nodes.select("video_id").distinct(), "video_id", "left_semi"), "state")
    empty = prompt(INSTRUCTION["cluster"], F.to_json(F.struct("video_id", F.array().cast("array<string>").alias("items"))))
    clusters, ended, audits, layer = [], [], [], 0
    while not nodes.isEmpty():
        layer += 1
        limits = state.select("video_id", "per_call", "reserve", call_tokens(empty).alias("fixed"), (F.col("max_calls") - F.col("calls")).alias("calls_left"))
        packed, planned = plan_merge(nodes, limits)
        packed, planned = scratch.keep(packed, f"packed{layer}"), scratch.keep(planned, f"planned{layer}")
        ended.append(planned.where("status <> 'planned'").select("video_id", F.lit("plan").alias("status"), F.col("status").alias("code"), F.lit(layer).alias("layers")))
        # A batch is bounded by its call.
        item = F.struct("comment_ids", F.col("node_id").alias("item_id"), "kind", "summary")
        full = packed.join(nodes, ["video_id", "node_id"]).groupBy("video_id", "batch").agg(F.array_sort(F.collect_list(F.struct("node_id", item.alias("item")))).alias("x"))
        full = full.select("video_id", "batch", prompt(INSTRUCTION["cluster"], F.to_json(F.struct("video_id", F.col("x.item").alias("items")))).alias("prompt"))
        calls = full.join(state, "video_id").withColumn("tokens", call_tokens(F.col("prompt")))
        called = scratch.keep(run_stage(calls, gateway, check_clusters, retries, repairs, identity).withColumn("layer", F.lit(layer)), f"called{layer}")
        audits.append(called)
        last = scratch.keep(last_attempts(called), f"last{layer}")
        ended.append(last.where("status <> 'ok'").select("video_id", "status", "code", F.lit(layer).alias("layers")))
        good = stage_clusters(called, version).join(last.where("status = 'ok'").select("video_id"), "video_id", "left_semi")
        sizes = planned.where("status = 'planned'").select("video_id", "batches", F.col("items").alias("before"))
        good = scratch.keep(good.join(sizes, "video_id"), f"clusters{layer}")
        clusters.append(good.where("batches = 1").select("video_id", "cluster_id", "comment_ids", "summary"))
        ended.append(sizes.where("batches = 1").join(last.where("status = 'ok'"), "video_id", "left_semi").select("video_id", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("code"), F.lit(layer).alias("layers")))
        more = good.where("batches > 1")
        stuck = more.groupBy("video_id").agg(F.count("*").alias("n"), F.max("before").alias("before")).where("n >= before").select("video_id")
        ended.append(stuck.select("video_id", F.lit("plan").alias("status"), F.lit("no_progress").alias("code"), F.lit(layer).alias("layers")))
        nodes = scratch.keep(cluster_nodes(more.join(stuck, "video_id", "left_anti")), f"nodes{layer}")
        spent = last.select("video_id", *[F.col(c).alias(f"now_{c}") for c in _LEDGER])
        state = state.join(spent, "video_id").select(
            "video_id", "per_call", "max_calls", "max_input", "max_output", "reserved_output", *[F.col(f"now_{c}").alias(c) for c in _LEDGER], (F.col("reserve") - F.col("now_input") + F.col("input")).alias("reserve"))
        state = scratch.keep(state, f"state{layer}")

    def union(parts: list[DataFrame], schema: str) -> DataFrame:
        out = signals.sparkSession.createDataFrame([], schema)
        for part in parts:
            out = out.unionByName(part)
        return out

    return (
        union(clusters, "video_id string, cluster_id string, comment_ids array<string>, summary string"), union(ended, "video_id string, status string, code string, layers int"),
        union(audits, f"{_CALLED}, layer int"),
    )
