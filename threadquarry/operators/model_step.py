"""The model step: a port, a deterministic stub, calls per partition, and distrust of what comes back.

Calls carry ids and text only. Answers are verified set-at-a-time: a batch whose answer names a comment outside of it is
rejected whole. Budgets replay as folds in order, stage results are cached by content.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadquarry.functions.scalars import nfc, signal_id, summary_text


class Gateway(Protocol):
    """Answers a request {"batch_id", "comments": [{"comment_id", "text"}]} with a JSON text; raises TransientError to be
    called again."""

    def invoke(self, request: dict, attempt: int) -> str: ...


class TransientError(Exception):
    """A time-out, a rate limit or a transport fault."""


class KeywordGateway:
    """A deterministic stand-in: a signal for each comment that holds one of the words, of the first such word, and a cluster for
    each summary. ``forge`` adds an id of its own, ``fail_first`` makes first attempts fail, ``break_first`` makes first answers
    unreadable, ``usage`` is what it says each call used, ``model`` and ``revision`` who it says it is."""

    def __init__(self, words: dict[str, str], forge: str | None = None, fail_first: bool = False, break_first: bool = False, usage: tuple[int, int] | None = None, model: str | None = None, revision: str | None = None):
        self.words, self.forge, self.fail_first, self.break_first = words, forge, fail_first, break_first
        self.usage, self.model, self.revision = usage or (None, None), model, revision

    def invoke(self, request: dict, attempt: int):
        if self.fail_first and attempt == 1:
            raise TransientError("rate_limited")
        if "prompt" not in request:
            return json.dumps({"signals": self._signals(request["comments"])}, ensure_ascii=False)
        from threadquarry.operators.analysis import Answer, data_of

        data = data_of(request["prompt"])
        if "comments" in data:
            out = {"signals": self._signals(data["comments"])}
        else:
            groups: dict[str, list[str]] = {}
            for n in data["items"]:
                groups.setdefault(n["summary"], []).extend(n["comment_ids"])
            out = {"clusters": [{"comment_ids": ids, "summary": s} for s, ids in sorted(groups.items())] + ([{"comment_ids": [self.forge], "summary": "forged"}] if self.forge else [])}
        text = "{" if self.break_first and attempt == 1 else json.dumps(out, ensure_ascii=False)
        return Answer(text, *self.usage, self.model, self.revision)

    def _signals(self, comments: list[dict]) -> list[dict]:
        held = ((c, next((w for w in self.words if w in (c["text"] or "")), None)) for c in comments)
        out = [{"comment_id": c["comment_id"], "kind": self.words[w], "summary": w, "disputed": False} for c, w in held if w is not None]
        return [*out, {"comment_id": self.forge, "kind": "need", "summary": "forged", "disputed": False}] if self.forge else out


def requests(batches: DataFrame, comments: DataFrame) -> DataFrame:
    """(batch_id, request): ids and text of a batch. A batch is bounded by its call."""
    rows = batches.join(comments.select("comment_id", "text"), "comment_id")
    listed = F.array_sort(F.collect_list(F.struct("comment_id", "text")))
    return rows.groupBy("batch_id").agg(F.to_json(F.struct(F.first("batch_id").alias("batch_id"), listed.alias("comments")), {"ignoreNullFields": "false"}).alias("request"))  # a comment without text keeps its field


def invoke(requests: DataFrame, gateway: Gateway, retries: int = 2) -> DataFrame:
    """(batch_id, attempt, status, answer): one audit row per attempt, the answer on the one that succeeded. One gateway per
    partition; only transient faults are tried again."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for b, r in zip(pdf["batch_id"], pdf["request"]):
                for attempt in range(1, retries + 2):
                    try:
                        rows.append((b, attempt, "ok", gateway.invoke(json.loads(r), attempt)))
                        break
                    except TransientError as e:
                        rows.append((b, attempt, str(e) or "transient", None))
                    except Exception:  # what the gateway raises beyond that is final
                        rows.append((b, attempt, "error", None))
                        break
            yield pd.DataFrame(rows, columns=["batch_id", "attempt", "status", "answer"])

    return requests.select("batch_id", "request").mapInPandas(run, "batch_id string, attempt int, status string, answer string")


def trusted_signals(answers: DataFrame, batches: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(signals, rejected batches). An answer must parse and name comments of its own batch only, each once; otherwise its
    batch is rejected whole. Disputed signals are dropped, ids are made anew."""
    schema = "signals array<struct<comment_id: string, kind: string, summary: string, disputed: boolean>>"
    got = answers.where("status = 'ok'").withColumn("j", F.from_json("answer", schema))
    broken = got.where("j is null or j.signals is null").select("batch_id", F.lit("not_readable").alias("code"))
    rows = got.select("batch_id", F.explode("j.signals").alias("s")).select("batch_id", "s.*")
    foreign = rows.join(batches.select("batch_id", "comment_id"), ["batch_id", "comment_id"], "left_anti").select("batch_id", F.lit("comment_not_in_batch").alias("code"))
    twice = rows.groupBy("batch_id", "comment_id", "kind").agg(F.count("*").alias("n")).where("n > 1").select("batch_id", F.lit("comment_repeats").alias("code"))
    unfit = rows.where(~F.col("summary").rlike(r"(?U)\S") | F.col("summary").isNull() | F.col("kind").isNull()).select("batch_id", F.lit("field_missing").alias("code"))
    rejected = broken.unionByName(foreign).unionByName(twice).unionByName(unfit).distinct()
    good = rows.join(rejected.select("batch_id").distinct(), "batch_id", "left_anti").where("not coalesce(disputed, false)")
    return good.select(signal_id(F.col("comment_id"), F.col("kind"), F.col("summary"), version).alias("signal_id"), "batch_id", "comment_id", "kind", summary_text(F.col("summary")).alias("summary")), rejected


def replay_budget(attempts: DataFrame, limits: DataFrame) -> DataFrame:
    """``attempts`` (scope, attempt, input_tokens, output_tokens, reserved_input, reserved_output) plus what was used before
    each, ``refused`` and ``exceeded``.

    refused: the first limit, of calls, input and output in this order, that the reservation would break; such an attempt is
    never made and charges nothing. exceeded: the first of input and output whose usage went beyond its reservation or took the
    scope over its limit; it is charged all the same. A missing usage charges the reservation. ``limits``: scope, max_calls,
    max_input, max_output; a scope without limits is left out.

    No running sum can tell this, since what is charged depends on what was refused. Attempts are folded in order, a scope
    after the other, with three numbers held: nothing is gathered, however many attempts a scope has.
    """
    cols = ["scope", "attempt", "input_tokens", "output_tokens", "reserved_input", "reserved_output", "max_calls", "max_input", "max_output"]
    rows = attempts.join(limits, "scope").select("scope", *[F.col(c).cast("bigint").alias(c) for c in cols[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope, used = None, Ledger()
        for b in batches:
            before, verdicts = [], []
            for r in b.to_pylist():
                if r["scope"] != scope:
                    scope, used = r["scope"], Ledger()
                before.append((used.calls, used.input, used.output))
                limit = (r["max_calls"], r["max_input"], r["max_output"])
                refused = used.refuses(r["reserved_input"], r["reserved_output"], limit)
                verdicts.append((refused, None if refused else used.settle(r["reserved_input"], r["reserved_output"], r["input_tokens"], r["output_tokens"], limit)))
            cols_of = lambda rows, n: list(zip(*rows)) or [()] * n
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *[pa.array(c, pa.int64()) for c in cols_of(before, 3)], *[pa.array(c, pa.string()) for c in cols_of(verdicts, 2)]],
                [*b.schema.names, "calls_before", "input_before", "output_before", "refused", "exceeded"])

    schema = "scope string, " + ", ".join(f"{c} bigint" for c in [*cols[1:], "calls_before", "input_before", "output_before"]) + ", refused string, exceeded string"
    return rows.repartition("scope").sortWithinPartitions("scope", "attempt").mapInArrow(run, schema)


class Ledger:
    """What a scope has used: calls, input and output tokens."""

    def __init__(self, calls: int = 0, input: int = 0, output: int = 0):
        self.calls, self.input, self.output = calls, input, output

    def refuses(self, input: int, output: int, limit: tuple[int, int, int]) -> str | None:
        """The first limit that a reservation would break."""
        for name, total, most in (("model_calls", self.calls + 1, limit[0]), ("input_tokens", self.input + input, limit[1]), ("output_tokens", self.output + output, limit[2])):
            if total > most:
                return name
        return None

    def settle(self, held_input: int, held_output: int, input: int | None, output: int | None, limit: tuple[int, int, int]) -> str | None:
        """Charge a call, by its reservation where no usage is known; the first token limit that it went beyond."""
        input, output = held_input if input is None else input, held_output if output is None else output
        self.calls, self.input, self.output = self.calls + 1, self.input + input, self.output + output
        if input > held_input or self.input > limit[1]:
            return "input_tokens"
        return "output_tokens" if output > held_output or self.output > limit[2] else None


def cache_key(*parts) -> F.Column:
    """Content address of a stage's inputs: the digest of their canonical parts in order, nulls told from empty ones."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), nfc(p.cast("string"))), F.lit("-")) for p in parts])), 256)


def probe_cache(wanted: DataFrame, cache: DataFrame, now) -> DataFrame:
    """``wanted`` (key, ..) plus ``event`` (hit, miss, expired) and the cached ``value`` of hits; an entry is dead at its very
    moment of expiry."""
    entries = cache.select("key", F.col("value").alias("_v"), "expires_at")
    alive = F.col("expires_at") > now
    return wanted.join(entries, "key", "left").select(
        *[F.col(c) for c in wanted.columns], F.when(F.col("expires_at").isNull(), "miss").when(alive, "hit").otherwise("expired").alias("event"), F.when(alive, F.col("_v")).alias("value"))
