"""Directories of captured videos (video.json, comments.jsonl, collection.json) and committed generations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadquarry.runtime import Scratch
from threadquarry.sources.payloads import read_lines

NAMES = ("video.json", "comments.jsonl", "collection.json")
VIDEO = "platform string, raw_video_id string, raw_author_id string, title string, description string, published_at string, duration_seconds bigint, total_comment_count bigint, view_count bigint, like_count bigint, favorite_count bigint, share_count bigint, author_follower_count bigint, captured_at string"
COLLECTION = "collection_schema_version string, exact_duplicate_count bigint, reported_total bigint, collected_total bigint, pages_requested bigint, pages_succeeded bigint, sort_modes array<string>, collection_started_at string, collection_finished_at string"
#: Largest JSON file that is read whole.
MOST_BYTES = 2 << 20
#: Largest comments.jsonl that one worker reads whole; larger ones are read in blocks.
WHOLE_BYTES = 16 << 20
#: Bytes and rows that a worker reads before it passes them on.
PASS_BYTES, PASS_ROWS = 4 << 20, 10_000

#: What the workers read of a comments.jsonl.
RAW_LINE = "platform string, raw_video_id string, line_number int, body binary"

_KEY = ["platform", "raw_video_id"]


def _open(root: str):
    """The file system of a root and the path there."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", root))
    return system, base.rstrip("/")


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows, the last column of which has their weight, as batches of bounded size."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[-1] or b"")
        if size >= PASS_BYTES or len(held) >= PASS_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _platforms(root: str) -> list[str]:
    from pyarrow import fs

    system, base = _open(root)
    return [x.base_name for x in system.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.Directory]


def _names(root: str):
    """Platforms to their directories."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = _open(root)
        rows = ((p, x.base_name) for b in batches for p in b.column(0).to_pylist() for x in system.get_file_info(fs.FileSelector(f"{base}/{p}")) if x.type == fs.FileType.Directory)
        yield from _batches(rows, pa.schema([(k, pa.string()) for k in _KEY]))

    return run


def _files(root: str):
    """Directories to their files. Names that begin with a dot or an underscore are no files of theirs, as everywhere in Spark; those
    of directories end with a slash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = _open(root)
        rows = ((p, v, x.size or 0, x.base_name + "/" * (x.type == fs.FileType.Directory)) for b in batches for p, v in zip(*[c.to_pylist() for c in b.columns]) for x in system.get_file_info(fs.FileSelector(f"{base}/{p}/{v}")) if x.base_name[0] not in "._")
        yield from _batches(rows, pa.schema([("platform", pa.string()), ("raw_video_id", pa.string()), ("length", pa.int64()), ("name", pa.string())]))

    return run


def _contents(root: str):
    """(platform, raw_video_id, name, length) to (platform, raw_video_id, length, content), without that of files over MOST_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)

        def read(p: str, v: str, name: str, n: int) -> bytes | None:
            if n > MOST_BYTES:
                return None
            with system.open_input_file(f"{base}/{p}/{v}/{name}") as f:
                return f.read()

        rows = ((p, v, n, read(p, v, name, n)) for b in batches for p, v, name, n in zip(*[c.to_pylist() for c in b.columns]))
        yield from _batches(rows, pa.schema([("platform", pa.string()), ("raw_video_id", pa.string()), ("length", pa.int64()), ("content", pa.binary())]))

    return run


def _lines(root: str):
    """(platform, raw_video_id) to (platform, raw_video_id, line_number, body), split at line feeds as Spark's text source does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)

        def lines(p: str, v: str) -> Iterator[tuple]:
            with system.open_input_file(f"{base}/{p}/{v}/comments.jsonl") as f:
                parts = f.read().removeprefix(b"\xef\xbb\xbf").split(b"\n")
            if not parts[-1]:
                parts.pop()
            return ((p, v, i, x) for i, x in enumerate(parts, 1))

        rows = (r for b in batches for p, v in zip(*[c.to_pylist() for c in b.columns]) for r in lines(p, v))
        yield from _batches(rows, pa.schema([("platform", pa.string()), ("raw_video_id", pa.string()), ("line_number", pa.int32()), ("body", pa.binary())]))

    return run


def own_lines(root: str) -> Iterator[pa.RecordBatch]:
    """RAW_LINE of every comments.jsonl below a root that only this process sees, listed and read as the workers of ``comment_lines``
    do; no file is read in blocks."""
    names = _names(root)(iter([pa.record_batch({"platform": pa.array(_platforms(root), pa.string())})]))
    found = (b.filter(pc.equal(b.column("name"), "comments.jsonl")).select(_KEY) for b in _files(root)(names))
    return _lines(root)(found)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(platform, raw_video_id, name, length) of every file below root/platform/video/; contents are not read.

    The workers list: directories may be too many for the driver, whose part are the platforms.
    """
    names = spark.createDataFrame([(p,) for p in _platforms(root)], "platform string").mapInArrow(_names(root), "platform string, raw_video_id string")
    parts = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return names.repartition(parts).mapInArrow(_files(root), "platform string, raw_video_id string, length bigint, name string").select(*_KEY, "name", "length")


def whole_json(spark: SparkSession, root: str, name: str, schema: str, listed: DataFrame | None = None) -> DataFrame:
    """One row per file of that name: keys from the path, ``j`` by schema, ``code`` (too_large, not_utf8, not_json or null)."""
    listed = listing(spark, root) if listed is None else listed
    files = listed.where(F.col("name") == name).select(*_KEY, "name", "length").mapInArrow(_contents(root), "platform string, raw_video_id string, length bigint, content binary")
    text = F.regexp_replace(F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")), "^﻿", "")
    out = files.withColumn("text", text).withColumn("j", F.from_json("text", schema))
    code = F.when(F.col("length") > MOST_BYTES, "too_large").when(F.col("text").isNull(), "not_utf8").when(F.json_object_keys("text").isNull(), "not_json")
    return out.select("platform", "raw_video_id", "j", F.json_object_keys("text").alias("keys"), code.alias("code"))


def comment_lines(spark: SparkSession, root: str, listed: DataFrame | None = None) -> DataFrame:
    """Lines of comments.jsonl, split at line feeds only, with line_number and what is wrong with them. ``listed`` is a kept
    ``listing``."""
    listed = Scratch(spark, "listing").keep(listing(spark, root), "files") if listed is None else listed
    own = listed.where("name = 'comments.jsonl'")
    small = own.where(F.col("length") <= WHOLE_BYTES).select(*_KEY).mapInArrow(_lines(root), RAW_LINE)
    lines = small.withColumn("body", F.col("body").cast("string"))
    large = own.where(F.col("length") > WHOLE_BYTES).collect()  # at most one for each WHOLE_BYTES of all files
    if large:
        lines = lines.unionByName(_block_lines(spark, [f"{root}/{r['platform']}/{r['raw_video_id']}/comments.jsonl" for r in large]))
    return read_lines(lines)


def _block_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of large files, which are read in blocks. A line's number is its place in its block plus the lines of the blocks
    before it."""
    plain = [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths]  # names are no patterns
    lines = spark.read.option("lineSep", "\n").text(plain).select(
        F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.col("value").alias("body"), F.monotonically_increasing_id().alias("_id"))
    lines = Scratch(spark, "lines").keep(lines, "lines")  # so that ids stay
    blocks = lines.groupBy("_file", "_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_file").orderBy("_at").rowsBetween(W.unboundedPreceding, -1))  # a file's blocks
    blocks = blocks.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    numbered = lines.join(blocks, ["_file", "_at"]).withColumn("line_number", (F.col("_before") + F.col("_id") - F.col("_first") + 1).cast("int"))
    parts = F.split("_file", "/")
    return numbered.select(F.element_at(parts, -3).alias("platform"), F.element_at(parts, -2).alias("raw_video_id"), "line_number", "body")


def bundle_violations(spark: SparkSession, root: str) -> DataFrame:
    """(platform, raw_video_id, code) for directories that are no sound bundle: other files than the three, unreadable JSON,
    ids that differ from the path, repeated comment ids, self-replies, a stated total that is off, half a version pair.

    Directories are listed once and each file is read once; what the codes need of it is kept.
    """
    scratch = Scratch(spark, "bundles")
    code = lambda df, c: df.select(*_KEY, F.lit(c).alias("code"))
    listed = scratch.keep(listing(spark, root), "files")
    names = listed.groupBy(*_KEY).agg(F.array_sort(F.collect_set("name")).alias("names"))
    bad_set = names.where(F.col("names") != F.array_sort(F.array(*[F.lit(n) for n in NAMES])))
    video = whole_json(spark, root, "video.json", VIDEO, listed)
    video = scratch.keep(video.select(*_KEY, "code", F.expr("j.platform <> platform or j.raw_video_id <> raw_video_id").alias("other")), "video")
    coll = whole_json(spark, root, "collection.json", COLLECTION, listed)
    half = F.array_contains("keys", "collection_schema_version") != F.array_contains("keys", "exact_duplicate_count")
    coll = scratch.keep(coll.select(*_KEY, "code", F.col("j.collected_total").alias("stated"), half.alias("half")), "collection")
    lines = comment_lines(spark, root, listed).select(*_KEY, "code", "l_raw_comment_id", F.expr("l_raw_parent_comment_id = l_raw_comment_id").alias("itself"))
    same = lines.groupBy(*_KEY, "code", "l_raw_comment_id").agg(F.count("*").alias("n"), F.max("itself").alias("itself"))
    lines = scratch.keep(same.groupBy(*_KEY, "code").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max("itself").alias("itself")), "lines")
    good = lines.where("code is null")
    totals = coll.where("code is null").select(*_KEY, "stated").join(good.select(*_KEY, "n"), _KEY, "left").where("stated <> coalesce(n, 0)")
    return (
        code(bad_set, "unexpected_files").unionByName(video.where("code is not null").select(*_KEY, "code")).unionByName(coll.where("code is not null").select(*_KEY, "code"))
        .unionByName(code(video.where("code is null and other"), "identity_mismatch"))
        .unionByName(lines.where("code is not null").select(*_KEY, "code"))
        .unionByName(code(good.where("most > 1"), "duplicate_comment_id"))
        .unionByName(code(good.where("itself"), "replies_to_itself")).unionByName(code(totals, "total_mismatch")).unionByName(code(coll.where("half"), "version_pair_incomplete"))
    )


def approved(spark: SparkSession, path: str) -> DataFrame:
    """An allow-list file: platform, video_key, direction, comment_scale per approved video."""
    schema = "manifest_version string, videos array<struct<platform: string, video_key: string, url: string, direction: string, comment_scale: string>>, unavailable_platforms array<string>"
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("videos").alias("v")).select("v.*")


def unapproved(directories: DataFrame, plan: DataFrame) -> DataFrame:
    """Directories that the allow-list doesn't name (left anti)."""
    named = plan.select("platform", F.col("video_key").alias("raw_video_id"))
    return directories.select("platform", "raw_video_id").distinct().join(named, ["platform", "raw_video_id"], "left_anti")
