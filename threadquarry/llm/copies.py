"""Copies hidden by formatting differences.

Records become canonical bytes, once. Each partition first collapses its own copies, so a group of any size sends one row per
partition. Buckets are leading bytes; a bucket that holds too many rows is split by further bytes, again and again, until
each fits, and one task per bucket counts its contents in a byte trie whose terminals carry count and first key. A split
skips the bytes that all of its bucket share, so long common beginnings cost one round, and only rows of buckets that are
still too large take part in it.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadquarry.runtime import BROADCAST_BYTES, Scratch, spread

#: Collapsed rows and bytes that one bucket may hold, bytes a split looks beyond what its bucket shares, and bytes of the
#: first split.
BUCKET_ROWS = 40_000
BUCKET_BYTES = 64 << 20
STRIDE = 4
FIRST = 4
#: Distinct contents, and their bytes, that a task collapses before it passes them on.
COLLAPSE_ROWS = 50_000
COLLAPSE_BYTES = 64 << 20


def _width_table() -> dict[int, str]:
    table = {}
    for c in [0x3000, *range(0xFF01, 0xFFEF)]:
        parts = unicodedata.decomposition(chr(c)).split()
        if parts and parts[0] in ("<wide>", "<narrow>"):
            table[c] = "".join(chr(int(x, 16)) for x in parts[1:])
    return table


_WIDTH = _width_table()
_DROP = None


def _drop():
    global _DROP
    if _DROP is None:
        import regex

        # Punctuation, white space, controls, format characters, and letters or marks that show nothing.
        _DROP = regex.compile(
            r"[\p{P}\s\p{Z}\p{Cc}\p{Cf}͏ᅟᅠ឴឵᠋-᠏⠀ㅤ︀-️ﾠ\U000E0000-\U000E0FFF]+"
        )
    return _DROP


def canonical_text(text: str | None) -> str | None:
    """Text without what makes no difference: white space, letter case, character width, punctuation (class P) and invisible
    characters. Canonically equivalent spellings are one. Null stays null; nothing but punctuation gives the empty text."""
    if text is None:
        return None
    if text.isascii():
        return _drop().sub("", text).lower()
    t = unicodedata.normalize("NFC", text.translate(_WIDTH))
    t = _drop().sub("", t.casefold())
    return unicodedata.normalize("NFC", t)


def text_bytes(text: str | None) -> bytes | None:
    c = canonical_text(text)
    return c.encode("utf-8", "surrogatepass") if c else None


def _plain(value):
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**63:
        return int(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def line_bytes(body: str | None, text_field: str = "text") -> bytes | None:
    """A JSON object in one notation: fields sorted, numbers plain, the text canonical (as it stands if only punctuation).
    Null for what can't be read as an object."""
    if body is None:
        return None
    try:
        o = json.loads(body)
    except (ValueError, RecursionError):
        return None
    if not isinstance(o, dict):
        return None
    o = _plain(o)
    if isinstance(o.get(text_field), str):
        c = canonical_text(o[text_field])
        o[text_field] = ["c", c] if c else ["r", o[text_field]]
    return json.dumps(o, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()


class Trie:
    """A byte trie over (bytes, key, count) with terminal counters; chains without branches are stored as one edge."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = [{}, 0, None, None]  # edges by first byte, count, least key, content id

    def add(self, data: bytes, key: int, count: int, content: bytes) -> None:
        node, at = self.root, 0
        while at < len(data):
            edge = node[0].get(data[at])
            if edge is None:
                leaf = [{}, 0, None, None]
                node[0][data[at]] = [data[at:], leaf]
                node = leaf
                break
            label, child = edge
            rest = data[at:]
            if rest.startswith(label):
                node, at = child, at + len(label)
                continue
            n = 0
            for x, y in zip(label, rest):
                if x != y:
                    break
                n += 1
            middle = [{label[n]: [label[n:], child]}, 0, None, None]
            node[0][data[at]] = [label[:n], middle]
            node, at = middle, at + n
        node[1] += count
        if node[2] is None or key < node[2]:
            node[2] = key
        node[3] = content

    def terminals(self) -> Iterator[tuple[bytes, int, int]]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[1]:
                yield node[3], node[1], node[2]
            stack.extend(child for _, child in node[0].values())


def _digest(data: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(data)


def _collapsed_rows(to_bytes: Callable[[str | None], bytes | None]):
    """Batches of (scope, key, body) to a row (null, digest, 0, key) for each record, and one (data, digest, n, first) per
    content and stretch of the partition."""

    def flush(seen: dict, keys: list, digests: list) -> pa.RecordBatch:
        none = len(keys)
        return pa.RecordBatch.from_arrays(
            [pa.array([None] * none + list(seen), pa.binary()), pa.array(digests + [v[2] for v in seen.values()], pa.binary()), pa.array([0] * none + [v[0] for v in seen.values()], pa.int64()),
             pa.array(keys + [v[1] for v in seen.values()], pa.int64())],
            ["data", "digest", "n", "first"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}
        held = 0
        for b in batches:
            keys, digests = [], []
            for scope, key, body in zip(*[b.column(i).to_pylist() for i in range(3)]):
                data = to_bytes(body)
                if data is None or key is None:
                    continue
                data = data + b"\x00" + scope.encode("utf-8", "surrogatepass")
                v = seen.get(data)
                if v is None:
                    v = seen[data] = [1, key, _digest(data)]
                    held += len(data)
                else:
                    v[0] += 1
                    if key < v[1]:
                        v[1] = key
                keys.append(key)
                digests.append(v[2])
                if held >= COLLAPSE_BYTES:
                    yield flush(seen, keys, digests)
                    seen, held, keys, digests = {}, 0, [], []
            full = len(seen) >= COLLAPSE_ROWS
            yield flush(seen if full else {}, keys, digests)
            if full:
                seen, held = {}, 0
        yield flush(seen, [], [])

    return run


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (prefix, width, data, digest, n, first), sorted by bucket, to (digest, copies, first_key): one trie at a time."""
    trie, at, rows = Trie(), None, []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["digest", "copies", "first_key"])

    for b in batches:
        for prefix, width, data, digest, n, first in zip(*[b.column(c).to_pylist() for c in ("prefix", "width", "data", "digest", "n", "first")]):
            if (prefix, width) != at:
                rows.extend(trie.terminals())
                trie, at = Trie(), (prefix, width)
            trie.add(data[width:], first, n, digest)
        if len(rows) >= COLLAPSE_ROWS:
            yield flush()
            rows = []
    rows.extend(trie.terminals())
    yield flush()


def radix_buckets(rows: DataFrame, scratch: Scratch, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` plus ``width``, the leading bytes that name the row's bucket; no bucket holds more than ``bucket_rows`` rows or
    BUCKET_BYTES bytes unless they are one content.

    ``todo`` are the rows of oversized buckets alone; what they settle into never comes back.
    """
    lead = F.expr("substring(data, 1, width)")
    todo, settled = rows.withColumn("width", F.lit(FIRST)), None
    while True:
        named = todo.withColumn("prefix", lead)
        sized = named.groupBy("prefix", "width").agg(F.count("*").alias("rows"), F.sum(F.length("data")).alias("bytes"))
        big = scratch.keep(sized.where(((F.col("rows") > bucket_rows) | (F.col("bytes") > BUCKET_BYTES)) & (F.col("rows") > 1)).select("prefix", "width"), "big")
        n, longest = big.agg(F.count("*"), F.max("width")).first()  # at most rows / bucket_rows buckets
        if not n:
            return todo if settled is None else settled.unionByName(todo)
        small = F.broadcast if n * (longest + 64) <= BROADCAST_BYTES else lambda x: x
        inside = named.join(small(big), ["prefix", "width"])
        # What a bucket's least and greatest contents share, all of it shares: the next split starts behind that.
        ends = inside.groupBy("prefix", "width").agg(F.min("data").alias("lo"), F.max("data").alias("hi"))
        ends = scratch.keep(ends.select("prefix", "width", _shared(F.col("lo"), F.col("hi")).alias("shared"), (F.col("lo") == F.col("hi")).alias("one")), "ends")
        done = named.join(small(big), ["prefix", "width"], "left_anti").unionByName(named.join(small(ends.where("one")), ["prefix", "width"], "left_semi").select(*named.columns))
        done = done.select(*todo.columns)
        split = named.join(small(ends.where("not one").withColumnRenamed("shared", "_s")), ["prefix", "width"]).select(*rows.columns, F.greatest(F.col("_s") + STRIDE, F.col("width") + 1).alias("width"))
        done = scratch.keep(done, "settled")
        settled = done if settled is None else settled.unionByName(done)
        todo = scratch.keep(split, "split")


def _shared(lo: Column, hi: Column) -> Column:
    """How many leading bytes two binaries share."""
    # Differing hex digits in pairs: the first one's byte. Bytes beyond the shorter one differ.
    a, b = F.hex(lo), F.hex(hi)
    size = F.least(F.length(lo), F.length(hi))
    bits = F.aggregate(
        F.sequence(F.lit(0), F.lit(31)), F.struct(F.lit(0).alias("lo"), size.cast("int").alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(_halved(s, a, b)))
    return bits["lo"]


def _halved(s: Column, a: Column, b: Column) -> Column:
    """One step of a binary search for the longest shared beginning."""
    mid = ((s["lo"] + s["hi"] + 1) / 2).cast("int")
    same = a.substr(F.lit(1), mid * 2) == b.substr(F.lit(1), mid * 2)
    return F.struct(F.when(same, mid).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(mid - 1).alias("hi"))


def _contents(df: DataFrame, scope: list[str], key: str, body: str, to_bytes, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """(digest, copies, first_key) per content, and (digest, key) per record, from one reading of the texts."""
    scratch = Scratch(df.sparkSession, "copies")
    rows = spread(_scoped(df, scope, key, body)).mapInArrow(_collapsed_rows(to_bytes), "data binary, digest binary, n bigint, first bigint")
    rows = scratch.keep(rows, "rows")
    buckets = radix_buckets(rows.where("n > 0"), scratch, bucket_rows)
    buckets = buckets.withColumn("prefix", F.expr("substring(data, 1, width)")).repartition("prefix", "width").sortWithinPartitions("prefix", "width")
    groups = buckets.mapInArrow(_count_buckets, "digest binary, copies bigint, first_key bigint")
    return scratch.keep(groups, "groups"), rows.where("n = 0").select("digest", F.col("first").alias("key"))


def copy_groups(df: DataFrame, scope: list[str], key: str, body: str, to_bytes: Callable[[str | None], bytes | None] = text_bytes, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(digest, copies, first_key): one row per content, with its number of rows and least key.

    ``digest`` is 128 bits of scope and canonical bytes; contents are told apart by all their bytes, in the tries. Records
    whose canonical form is null, and rows without key, belong to no group; null scope values form a scope of their own.
    """
    return _contents(df, scope, key, body, to_bytes, bucket_rows)[0]


def _scoped(df: DataFrame, scope: list[str], key: str, body: str) -> DataFrame:
    part = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in scope]
    return df.select(F.concat_ws("\x01", *part).alias("scope"), F.col(key).cast("bigint").alias("key"), F.col(body).alias("body"))


def copy_pairs(df: DataFrame, scope: list[str], key: str, body: str, to_bytes: Callable[[str | None], bytes | None] = text_bytes, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(first_key, copy_key) for each row that repeats another of its scope; linear in rows, never all pairs of a group."""
    groups, rows = _contents(df, scope, key, body, to_bytes, bucket_rows)
    return rows.join(groups.where("copies > 1").select("digest", "first_key"), "digest").where("key <> first_key").select("first_key", F.col("key").alias("copy_key"))
