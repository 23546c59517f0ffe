"""Encoding a corpus with a public byte-level BPE tokenizer, and decoding it again.

Each partition splits its texts into words and has an embedded SQL engine encode the words it has not met: rows of token
positions join the merge table, each word's minimum-rank pair is contracted from the left, and a recursive query repeats
that until no pair is left. An ordered aggregation puts ids together, and back into text when decoding.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadquarry.runtime import spread

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the pattern that splits text into words before merging, as published with the vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of words per recursive query, characters of text per step, and encoded words a worker remembers. Speed only.
QUERY_BYTES = 120_000
STEP_CHARS = 1_500_000
REMEMBERED = 120_000

#: Words of so many bytes go alone, each round a table of its own, so that rounds don't pile up in memory.
LONG_WORD = 4_096

#: One row per token position. A round finds each open word's least merge rank, contracts every occurrence of that pair
#: from the left (in an overlapping run a a a the first, third, ...), and passes on only words that changed.
_ROUND = """
    WITH pairs AS (
      SELECT it, wid, pos, tok, lead(tok) OVER (PARTITION BY wid ORDER BY pos) AS nxt FROM t),
    ranked AS (
      SELECT p.*, m.rank, m.id FROM pairs p LEFT JOIN merges m ON m.l = p.tok AND m.r = p.nxt),
    least AS (
      SELECT *, min(rank) OVER (PARTITION BY wid) AS low, row_number() OVER (PARTITION BY wid ORDER BY pos) AS n FROM ranked),
    hit AS (
      SELECT *, coalesce(rank = low, false) AS h FROM least WHERE low IS NOT NULL),
    runs AS (
      SELECT *, n - row_number() OVER (PARTITION BY wid, h ORDER BY pos) AS run FROM hit),
    taken AS (
      SELECT *, h AND row_number() OVER (PARTITION BY wid, h, run ORDER BY pos) % 2 = 1 AS c FROM runs)
    SELECT it + 1 AS it, wid, pos, CASE WHEN c THEN id ELSE tok END AS tok
    FROM taken QUALIFY NOT coalesce(lag(c) OVER (PARTITION BY wid ORDER BY pos), false)
"""

_ENCODE = f"""
WITH RECURSIVE t(it, wid, pos, tok) AS (
  SELECT 0, wid, pos, tok FROM start
  UNION ALL
  SELECT it, wid, pos, tok FROM ({_ROUND}))
SELECT wid, list(tok ORDER BY pos) AS ids FROM (SELECT * FROM t QUALIFY it = max(it) OVER (PARTITION BY wid)) GROUP BY wid ORDER BY wid
"""

_DECODE = """
SELECT d.doc, coalesce(string_agg(v.hex, '' ORDER BY d.pos), '') AS hex
FROM positions d LEFT JOIN vocabulary v ON v.id = d.id GROUP BY d.doc ORDER BY d.doc
"""


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes stand for themselves, the others for
    the code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """A vocabulary in an embedded SQL engine; one per worker process."""

    def __init__(self, vocabulary_path: str):
        import duckdb
        import regex

        with open(vocabulary_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        vocab = model["vocab"]
        to_bytes = {t: bytes(letters[c] for c in t) for t in vocab if all(c in letters for c in t)}
        self.byte_id = np.zeros(256, dtype=np.int32)
        for t, b in to_bytes.items():
            if len(b) == 1:
                self.byte_id[b[0]] = vocab[t]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.con = duckdb.connect(":memory:")
        self.con.execute("SET threads = 1; SET memory_limit = '400MB'; SET preserve_insertion_order = false")
        merges = pa.table({
            "l": pa.array([vocab[a] for a, _ in pairs], pa.int32()), "r": pa.array([vocab[b] for _, b in pairs], pa.int32()),
            "rank": pa.array(range(len(pairs)), pa.int32()), "id": pa.array([vocab[a + b] for a, b in pairs], pa.int32()),
        })
        vocabulary = pa.table({"id": pa.array([vocab[t] for t in to_bytes], pa.int32()), "hex": pa.array([b.hex() for b in to_bytes.values()])})
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self.con.register("arrow_rows", rows)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM arrow_rows")
            self.con.unregister("arrow_rows")
        self.words = regex.compile(SPLIT)
        self.known: dict[str, np.ndarray] = {}

    def _query(self, words: list[bytes]) -> list[np.ndarray]:
        lengths = np.fromiter(map(len, words), np.int32, len(words))
        toks = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        rows = pa.table({"wid": np.repeat(np.arange(len(words), dtype=np.int32), lengths), "pos": (np.arange(len(toks)) - starts).astype(np.int32), "tok": toks})
        self.con.register("start", rows)
        ids = self.con.sql(_ENCODE).to_arrow_table().column("ids").combine_chunks()
        self.con.unregister("start")
        flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def _query_long(self, word: bytes) -> np.ndarray:
        toks = self.byte_id[np.frombuffer(word, np.uint8)]
        self.con.register("start", pa.table({"it": np.zeros(len(toks), np.int32), "wid": np.zeros(len(toks), np.int32), "pos": np.arange(len(toks), dtype=np.int32), "tok": toks}))
        self.con.execute("CREATE OR REPLACE TEMP TABLE t AS SELECT * FROM start")
        self.con.unregister("start")
        while True:
            self.con.execute(f"CREATE OR REPLACE TEMP TABLE next_t AS {_ROUND}")
            if not self.con.execute("SELECT count(*) FROM next_t").fetchall()[0][0]:
                break
            self.con.execute("DROP TABLE t; ALTER TABLE next_t RENAME TO t")
        ids = self.con.sql("SELECT tok FROM t ORDER BY pos").to_arrow_table().column("tok").to_numpy()
        self.con.execute("DROP TABLE t; DROP TABLE IF EXISTS next_t")
        return ids

    def learn(self, words: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known = {}
        part: list[str] = []
        size = 0
        todo = sorted((w for w in words if w not in self.known), key=lambda w: (len(w), w))  # alike lengths end in alike rounds
        while todo and len(todo[-1]) * 4 > LONG_WORD:
            w = todo.pop()
            self.known[w] = self._query_long(w.encode("utf-8", "surrogatepass")).astype(np.int32)
        for i, w in enumerate(todo):
            part.append(w)
            size += len(w) * 3
            if size >= QUERY_BYTES or i == len(todo) - 1:
                for x, ids in zip(part, self._query([x.encode("utf-8", "surrogatepass") for x in part])):
                    self.known[x] = ids.copy()
                part, size = [], 0

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text; a null or empty text has none."""
        none = np.zeros(0, dtype=np.int32)
        out: list[np.ndarray] = []
        i = 0
        while i < len(texts):
            split: list[list[str]] = []
            chars = 0
            while i < len(texts) and (chars < STEP_CHARS or not split):
                split.append(self.words.findall(texts[i]) if texts[i] else [])
                chars += len(texts[i] or "")
                i += 1
            fresh = {w for ws in split for w in ws}
            if len(self.known) > REMEMBERED:
                self.known = {}
            self.learn(fresh)
            out.extend(np.concatenate([self.known[w] for w in ws]) if ws else none for ws in split)
        return out

    def decode(self, ids: list) -> list[str]:
        lengths = np.fromiter((0 if x is None else len(x) for x in ids), np.int64, len(ids))
        flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in ids if x is not None and len(x)]) if lengths.sum() else np.zeros(0, np.int32)
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        rows = pa.table({"doc": np.repeat(np.arange(len(ids)), lengths), "pos": np.arange(len(flat)) - starts, "id": flat})
        self.con.register("positions", rows)
        got = self.con.sql(_DECODE).to_arrow_table()
        self.con.unregister("positions")
        out = [""] * len(ids)
        for d, h in zip(got.column("doc").to_pylist(), got.column("hex").to_pylist()):
            out[d] = bytes.fromhex(h).decode("utf-8", "replace")
        return out


_SENT: set[tuple[str, str]] = set()


def _send(spark: SparkSession, path: str) -> None:
    """Give a vocabulary file to the executors, once per application: only the driver needs the folder."""
    sent = (spark.sparkContext.applicationId, path)
    if sent not in _SENT:
        spark.sparkContext.addFile(path)
        _SENT.add(sent)


def _here(path: str) -> str:
    """Where a sent file lies on this worker."""
    from pyspark import SparkFiles

    return SparkFiles.get(os.path.basename(path))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of every row. Null and empty texts have an empty list; repeated keys stay repeated."""
    path = f"{tokenizers}/{vocabulary}"
    _send(docs.sparkSession, path)
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(_here(path))
        for b in batches:
            ids = enc.encode(b.column("text").to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if len(ids) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "ids"])

    return spread(docs.select(F.col(key), F.col(text).alias("text"))).mapInArrow(run, f"{key} {kind.simpleString()}, ids array<int>")


def decode_corpus(encoded: DataFrame, key: str = "doc_id", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) from (key, ids). Null and empty lists become the empty text, unknown ids nothing."""
    path = f"{tokenizers}/{vocabulary}"
    _send(encoded.sparkSession, path)
    kind = encoded.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(_here(path))
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(enc.decode(part.column("ids").to_pylist()), pa.string())], [key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} {kind.simpleString()}, text string")


def token_counts(docs: DataFrame, key: str, text: str = "text", tokenizers: str = TOKENIZERS, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``docs``' columns without the text, plus ``tokens``: the number of tokens, 0 for null and empty texts. A column of that name
    is replaced."""
    path = f"{tokenizers}/{ranks}"
    _send(docs.sparkSession, path)
    docs = docs.select(*[c for c in docs.columns if c != "tokens"])
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _rank_encoding(_here(path))
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(n, pa.int64())], [*keep, "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    return spread(docs).mapInArrow(run, f"{schema}, tokens bigint")


_RANKS: dict[str, object] = {}


def _rank_encoding(path: str):
    if path not in _RANKS:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _RANKS[path] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _RANKS[path]
