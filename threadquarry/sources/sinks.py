"""Sinks: staged generations with an atomic pointer, append-only audits, refusal of sensitive keys."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

#: Parts of keys that an audit must not hold.
SENSITIVE = ("cookie", "token", "authorization", "password", "request_headers", "response_body", "storage_state")


def sensitive_keys(schema: StructType) -> list[str]:
    """Field names, at any depth, that hold a sensitive part."""
    out: list[str] = []

    def walk(t) -> None:
        if isinstance(t, StructType):
            for f in t.fields:
                if any(s in f.name.lower() for s in SENSITIVE):
                    out.append(f.name)
                walk(f.dataType)
        elif isinstance(t, ArrayType):
            walk(t.elementType)
        elif isinstance(t, MapType):
            walk(t.valueType)

    walk(schema)
    return out


def append_audit(df: DataFrame, path: str) -> None:
    """Append audit rows as JSON lines; refuses schemas with sensitive keys before anything is written."""
    bad = sensitive_keys(df.schema)
    if bad:
        raise ValueError(f"sensitive audit keys: {', '.join(sorted(bad))}")
    for column in [f.name for f in df.schema.fields if isinstance(f.dataType, MapType)]:
        named = df.select(F.explode(F.map_keys(column)).alias("k")).where(" or ".join(f"lower(cast(k as string)) like '%{x}%'" for x in SENSITIVE))
        if not named.isEmpty():
            raise ValueError(f"sensitive audit keys in {column}")
    df.write.mode("append").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """Write a report once: a path that exists is refused, sensitive fields are refused before anything is written, null fields are
    written as such."""
    bad = sensitive_keys(df.schema)
    if bad:
        raise ValueError(f"sensitive report keys: {', '.join(sorted(bad))}")
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


@F.pandas_udf(StringType())
def ascii_json(text: pd.Series) -> pd.Series:
    """JSON texts with sorted keys, in ASCII; null stays null."""
    return text.map(lambda x: None if x is None else json.dumps(json.loads(x), sort_keys=True, ensure_ascii=True, separators=(",", ":")))


def publish_candidates(candidates: DataFrame, audit: DataFrame, path: str) -> None:
    """Candidates and how they were found, each as lines of sorted ASCII JSON below ``path``, once: what exists is refused, and
    sensitive fields are before anything is written."""
    bad = sensitive_keys(candidates.schema) + sensitive_keys(audit.schema)
    if bad:
        raise ValueError(f"sensitive keys: {', '.join(sorted(bad))}")
    for name, df in (("candidates", candidates), ("audit", audit)):
        df.select(ascii_json(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).alias("value")).write.mode("errorifexists").text(f"{path}/{name}")


class Generations:
    """Versions of a table below a root. A version is written and checked in full before the pointer names it, so readers see
    the old one or the new one and a failed write leaves the old one in force."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        pointers = [s.getPath() for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("current-")] if self._fs.exists(self._path(self.root)) else []
        newest = max(pointers, key=lambda p: p.getName(), default=None)
        return None if newest is None else f"{self.root}/{newest.getName().split('-', 2)[2]}"

    def read(self) -> DataFrame | None:
        at = self.current()
        return None if at is None else self.spark.read.parquet(at)

    def commit(self, df: DataFrame, check: Callable[[DataFrame], None] | None = None, create_only: bool = False, partition_by: list[str] | None = None) -> str:
        """Write, check and publish a version. ``check`` raises to refuse it; ``create_only`` refuses where a version exists."""
        writer = lambda path: (df.write.mode("errorifexists").partitionBy(*partition_by) if partition_by else df.write.mode("errorifexists")).parquet(path)
        return self._version(writer, (lambda path: check(self.spark.read.parquet(path))) if check else None, create_only)

    def commit_tables(self, tables: dict[str, DataFrame], check: Callable[[dict[str, DataFrame]], None] | None = None, create_only: bool = False) -> str:
        """Write, check and publish several tables as one version: readers see all of them or none."""

        def write(path: str) -> None:
            for name, df in tables.items():
                df.write.mode("errorifexists").parquet(f"{path}/{name}")

        return self._version(write, (lambda path: check({n: self.spark.read.parquet(f"{path}/{n}") for n in tables})) if check else None, create_only)

    def read_table(self, name: str) -> DataFrame | None:
        """One table of a version of several."""
        at = self.current()
        return None if at is None else self.spark.read.parquet(f"{at}/{name}")

    def _version(self, write: Callable[[str], None], check: Callable[[str], None] | None, create_only: bool) -> str:
        before = self.current()
        if create_only and before is not None:
            raise FileExistsError(self.root)
        name = f"v{uuid.uuid4().hex[:12]}"
        try:
            write(f"{self.root}/{name}")
            if check:
                check(f"{self.root}/{name}")
        except Exception:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
            raise
        number = 1 + max((int(s.getPath().getName().split("-")[1]) for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("current-")), default=0)
        # Creating the next pointer is one atomic step; of two writers one fails here.
        self._fs.create(self._path(f"{self.root}/current-{number:08d}-{name}"), False).close()
        return f"{self.root}/{name}"

    def recover(self) -> int:
        """Remove versions that no pointer names: what an interrupted write left. Returns how many."""
        if not self._fs.exists(self._path(self.root)):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        kept = {n.split("-", 2)[2] for n in names if n.startswith("current-")}
        lost = [n for n in names if n.startswith("v") and n not in kept]
        for n in lost:
            self._fs.delete(self._path(f"{self.root}/{n}"), True)
        return len(lost)
