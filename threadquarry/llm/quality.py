"""Per-document text quality statistics, their place in the corpus, and what is not running text.

One pass computes the statistics of each text. Mergeable quantile sketches per language and source (Spark's approximate
percentiles) give the reference. First of the share of common words, whose upper end says how much of them running text
has; then of each statistic over the documents that have about so much. A statistic's centre is the median over sources of
their medians, its scale that of their narrower quartile distances, so neither a source that holds a third of all rows nor a
kind that makes up most of them moves it. Robust z-scores place each document, those beyond TAIL_Z lie in a tail, and the
tails say what a document is: list, table, junk, or running text.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadquarry.llm.mixing import source_name
from threadquarry.runtime import spread

#: Robust z-score from which a statistic lies in a tail, and relative rank error of the sketches.
TAIL_Z = 5.0
SKETCH_ACCURACY = 2_000
#: Quantile of the share of common words that running text is expected at, how far from it reference documents may be (as a
#: factor), and the share below which a language has no running text. It is then placed by the other language's reference.
PROSE_QUANTILE, PROSE_FACTOR, LEAST_COMMON = 0.9, 2.0, 0.05
#: Documents of a language that a source needs to have a say in the reference; where none has so many, all have.
LEAST_DOCUMENTS = 30
#: Least scale of a statistic, so that a corpus of equal values doesn't turn dust into tails.
LEAST_SCALE = {
    "mean_word_length": 0.5, "symbol_ratio": 0.01, "digit_ratio": 0.02, "ending_share": 0.1, "common_share": 0.03, "mean_line_length": 8.0,
    "entry_share": 0.1, "cell_share": 0.1, "repeat_ratio": 0.05, "odd_ratio": 0.01, "longest_run": 8.0, "rare_share": 0.03, "pair_share": 0.05, "code_share": 0.03,
    "letter_share": 0.03, "link_share": 0.06,
}
STATISTICS = list(LEAST_SCALE)
#: Amounts beside the statistics, which have no tails: what is too little proves nothing.
AMOUNTS = ["words", "lines", "chars", "han", "latin", "distinct_lines"]
#: An entry of a list is at most this long (a Han character counts two); more marks of running text make it no entry.
ENTRY_WIDTH = 64
#: The commonest letter pairs of English, by which words are told from keyboard noise.
COMMON_PAIRS = frozenset(
    "th he in er an re nd on en at ou ed ha to or it is hi es ng st te ar ti nt se le ne ve al de of as me ro ea ri ra ll io li om "
    "co us el ta la ch ic di et be wa no so wi fo ma tr pe ut ec ho ce un ur ow su po ac il ad lo ot ge ee ss em ol ct id im sh pl "
    "ai av mo tu ay op ig ag ap ty ul if fe pr rs ci am ab".split()
)

#: A list has at least so many entries, a table so many rows.
LEAST_ENTRIES = 3
LEAST_ROWS = 3

_P: dict[str, object] = {}


def _patterns():
    if not _P:
        import regex

        c = regex.compile
        _P.update(
            line=c(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]"), word=c(r"[\p{Latin}]+(?:['’][\p{Latin}]+)*"), han=c(r"\p{Han}+"), digit=c(r"\p{N}+"),
            symbol=c(r"[\p{S}\p{Cn}\p{Co}]+"), odd=c(r"[\x00-\x08\x0e-\x1f\x7f-\x9f\p{Co}\p{Cn}�]|[¡-¿À-ÿ](?=[¡-¿À-ÿ])"),
            space=c(r"[\s\p{Cf}]+"), run=c(r"[^\s\p{Han}\p{P}]+|[A-Za-z0-9+/=_-]+"), end=c(r"""[.!?。！？…～~;；:：][\p{Pf}\p{Pe}"'\p{S}\s]*$"""),
            sentence=c(r"[。！？；]|[.!?;](?=\s|$)|[…～]"), pause=c(r"[，、,](?=\s|\p{Han})"),
            marker=c(r"^\s*(?:[-*+•·●○◦▪■□◆◇→>✓✔✅☑☐※★☆]\s*|\[[ xX✓]?\]\s*|[(（]?(?:\d{1,4}|[A-Za-z]|[一二三四五六七八九十百]{1,5}|[ivxIVX]{1,6})\s*[.、)）:：]\s*|[①-⑳]\s*)(?=\S)"),
            link=c(r"https?://\S+|www\.\S+|[#＃@＠](?!\uFE0F?\u20E3)[^\s#＃@＠，。！？；：、,!?;]+"), cell=c(r"(?i)<t[dh][\s>]"), item=c(r"(?i)<li[\s>]"), tag=c(r"<[^<>\n]{1,80}>"), trail=c(r"[。；;.!！、,，]\s*$"),
            code=c(r"(?<![\p{L}\p{N}])(?:0x)?(?=[0-9a-fA-F]*\d)(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{6,}(?![\p{L}\p{N}])"),
            rule=c(r"^[\s|│┃+\-=─━┌┐└┘├┤┬┴┼╔╗╚╝╠╣╦╩╬═║:]+$"),
        )
    return _P


_WIDE = re.compile("[\u2e80-\U0010ffff]+")
_LATIN_LETTERS = re.compile("[A-Za-z]+")


def _width(s: str) -> int:
    """Columns of a line: characters from the Han range on count two."""
    return len(s) if s.isascii() else len(s) + sum(map(len, _WIDE.findall(s)))


@functools.lru_cache(maxsize=1 << 15)
def _is_rare(c: str) -> bool:
    gb, big = c.encode("gb2312", "ignore"), c.encode("big5", "ignore")
    return not (gb and gb[0] <= 0xD7) and not (big and big <= b"\xc6\x7e")


def _cells(line: str) -> dict[str, int]:
    """How many cells each kind of divider makes of a line."""
    out = {}
    bare = line.strip()
    for name, d in (("tab", "\t"), ("pipe", "|"), ("box", "│"), ("box2", "║"), ("comma", ","), ("semi", ";"), ("fcomma", "，"), ("slash", " / ")):
        if d in line:
            n = (line if name == "tab" else bare.strip("|│║") if name in ("pipe", "box", "box2") else bare).count(d) + 1
            if n > 1:
                out[name] = n
    import regex

    gaps = len(regex.findall(r"\S(?:\s{2,}|　+)(?=\S)", bare))
    if gaps:
        out["gap"] = gaps + 1
    return out


def table_share(lines: list[str]) -> float:
    """Share of lines that are rows of one divider with (about) one number of short cells; rules count as rows."""
    p = _patterns()
    rules = sum(1 for x in lines if p["rule"].match(x))
    body = [x for x in lines if not p["rule"].match(x)]
    if len(body) + min(rules, 2) < LEAST_ROWS or not body:
        return 0.0
    tagged = sum(1 for x in lines if p["cell"].search(x))
    if tagged >= 2:
        return sum(1 for x in lines if p["tag"].match(x.strip())) / len(lines)
    counts: dict[str, Counter] = {}
    for x in body:
        # Dividers of running text are followed by words of it: sentences make no cells.
        if p["sentence"].search(x):
            continue
        for k, n in _cells(x).items():
            if k in ("comma", "fcomma", "semi") and _width(x.strip()) / n > 24:
                continue
            counts.setdefault(k, Counter())[n] += 1
    best = 0
    for k, c in counts.items():
        n, _ = c.most_common(1)[0]
        near = sum(v for m, v in c.items() if (m == n or k == "gap" and abs(m - n) <= max(1, n // 3)))
        if n == 2 and k in ("comma", "fcomma", "slash", "semi"):
            continue
        best = max(best, near)
    return (best + rules) / len(lines) if best >= 2 else 0.0


def entry_share(lines: list[str]) -> float:
    """Share of the text's width in lines that are short entries: marked, or without any mark of running text."""
    p = _patterns()
    total = sum(_width(x.strip()) for x in lines)
    got, n = 0, 0
    for x in lines:
        bare = x.strip()
        m = p["marker"].match(bare) or p["item"].match(bare)
        rest = p["trail"].sub("", p["tag"].sub("", bare[m.end():])) if m else bare
        w = _width(rest)
        sentences = len(p["sentence"].findall(rest))
        if w <= ENTRY_WIDTH and not sentences and not p["pause"].search(rest):
            got += _width(bare)
            n += 1
    return got / total if total and n >= LEAST_ENTRIES else 0.0


#: Odd factors of the hashes of shingles.
_SHINGLE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def repeat_ratio(flat: str) -> float:
    """Share of the shingles of a text without spaces that it has more than once; of very short texts, of characters."""
    if len(flat) < 40:
        return 1 - len(set(flat)) / len(flat) if len(flat) >= 8 else 0.0
    x = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(x) - 5
    h = np.zeros(n, np.uint64)
    for i, f in enumerate(_SHINGLE):
        h += x[i : i + n] * f
    h ^= h >> np.uint64(29)
    h.sort()
    return 1 - (1 + int(np.count_nonzero(h[1:] != h[:-1]))) / n


def language(m: dict[str, float]) -> str:
    """zh where Han characters outnumber Latin words, else en; independent of the stated language."""
    return "zh" if 2 * m["han"] > m["words"] else "en"


def rare_share(han: str) -> float:
    """Share of Han characters outside the first levels (the commoner characters) of GB 2312 and Big5."""
    return sum(n for c, n in Counter(han).items() if _is_rare(c)) / len(han) if han else 0.0


_PAIRS = frozenset((x[0], x[1]) for x in COMMON_PAIRS)


def pair_share(words: list[str]) -> float:
    """Share of common English letter pairs among the pairs of words; 1 without any."""
    line = " ".join(w for w in words if w.isascii())
    pairs = Counter(zip(line, line[1:]))
    total = sum(n for (a, b), n in pairs.items() if a != " " != b)
    return sum(pairs[x] for x in _PAIRS) / total if total else 1.0


class Measures:
    def __init__(self, common: dict[str, list[str]]):
        import regex

        self.en = {w.lower() for w in common.get("en", [])}
        zh = sorted(common.get("zh", []), key=lambda w: (-len(w), w))
        self.zh = regex.compile("|".join(map(regex.escape, zh))) if zh else None

    def of(self, text: str) -> dict[str, float]:
        p = _patterns()
        lines = [x for x in p["line"].split(text) if x.strip()]
        flat = p["space"].sub("", text)
        n = max(1, len(flat))
        words = [w.lower() for w in p["word"].findall(text)]
        hans = "".join(p["han"].findall(text))
        han = len(hans)
        common = sum(1 for w in words if w in self.en) + (sum(len(x) for x in self.zh.findall(text)) if self.zh and han else 0)
        return {
            "han": float(han), "words": float(len(words) + han), "lines": float(len(lines)), "chars": float(len(flat)),
            "latin": float(sum(map(len, _LATIN_LETTERS.findall(text)))), "distinct_lines": len({x.strip() for x in lines}) / max(1, len(lines)),
            "mean_word_length": sum(map(len, words)) / len(words) if words else 0.0,
            "symbol_ratio": sum(map(len, p["symbol"].findall(flat))) / n, "digit_ratio": sum(map(len, p["digit"].findall(flat))) / n,
            "ending_share": sum(1 for x in lines if p["end"].search(x)) / max(1, len(lines)),
            "common_share": common / max(1, len(words) + han), "mean_line_length": sum(_width(x) for x in lines) / max(1, len(lines)),
            "entry_share": entry_share(lines), "cell_share": table_share(lines), "repeat_ratio": repeat_ratio(flat),
            "rare_share": rare_share(hans), "pair_share": pair_share(words), "code_share": sum(map(len, p["code"].findall(text))) / n,
            "letter_share": sum(map(str.isalnum, flat)) / n, "link_share": sum(map(len, p["link"].findall(text))) / n,
            "odd_ratio": len(p["odd"].findall(text)) / n, "longest_run": float(max((len(x) for x in p["run"].findall(text)), default=0)),
        }


def measure(docs: DataFrame, common: dict[str, list[str]]) -> DataFrame:
    """(doc_id, source, language, amounts.., statistics..) of every text that is not blank; a null source, or a table without
    sources, counts as one."""
    names = [*AMOUNTS, *STATISTICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures = Measures(common)
        for b in batches:
            ids, sources, langs = [], [], []
            cols: dict[str, list[float]] = {k: [] for k in names}
            for i, t, s in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", "source")]):
                if not t or not _patterns()["space"].sub("", t):
                    continue
                m = measures.of(t)
                ids.append(i)
                sources.append(s)
                langs.append(language(m))
                for k in names:
                    cols[k].append(m[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sources, pa.string()), pa.array(langs, pa.string()), *[pa.array(cols[k], pa.float64()) for k in names]], ["doc_id", "source", "language", *names])

    schema = "doc_id bigint, source string, language string, " + ", ".join(f"{k} double" for k in names)
    source = F.coalesce(source_name(F.col("source")), F.lit("")) if "source" in docs.columns else F.lit("")
    return spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", source.alias("source"))).mapInArrow(run, schema)


def sketches(measured: DataFrame) -> DataFrame:
    """Per language and source, quartiles and 1 %, 5 %, 95 %, 99 % of each statistic from mergeable sketches."""
    cuts = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    return measured.groupBy("language", "source").agg(F.count("*").alias("documents"), *[F.percentile_approx(s, cuts, SKETCH_ACCURACY).alias(s) for s in STATISTICS])


def _voting(sketched: DataFrame) -> DataFrame:
    most = sketched.groupBy("language").agg(F.max("documents").alias("_most"))  # a row per language, of which there are two
    return sketched.join(F.broadcast(most), "language").where(F.col("documents") >= F.least(F.col("_most"), F.lit(LEAST_DOCUMENTS)))


def reference(measured: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Per language (two rows at most) centre and scale of each statistic; and the language each is placed by."""
    share = measured.groupBy("language", "source").agg(F.count("*").alias("documents"), F.percentile_approx("common_share", PROSE_QUANTILE, SKETCH_ACCURACY).alias("p"))
    levels = {r["language"]: r["level"] for r in _voting(share).groupBy("language").agg(F.percentile_approx("p", 0.5, SKETCH_ACCURACY).alias("level")).collect()}  # two rows at most
    prose = {k: v for k, v in levels.items() if v >= LEAST_COMMON}
    near = F.lit(not prose)
    for k, v in prose.items():
        near = near | ((F.col("language") == k) & F.col("common_share").between(v / PROSE_FACTOR, v * PROSE_FACTOR))
    middle = lambda c, name: F.percentile_approx(c, 0.5, SKETCH_ACCURACY).alias(name)
    q = F.col
    out = _voting(sketches(measured.where(near))).groupBy("language").agg(
        *[middle(q(s)[3], f"c_{s}") for s in STATISTICS], *[middle(F.least(q(s)[4] - q(s)[3], q(s)[3] - q(s)[2]), f"d_{s}") for s in STATISTICS])
    out = out.select("language", *[f"c_{s}" for s in STATISTICS], *[F.greatest(F.col(f"d_{s}") / 0.6745, F.lit(v)).alias(f"d_{s}") for s, v in LEAST_SCALE.items()])
    return out, {k: k if k in prose or not prose else min(prose) for k in levels}


def flagged(measured: DataFrame) -> DataFrame:
    """``measured`` plus ``tails``: the statistics whose robust z-score lies beyond TAIL_Z, each with its sign."""
    ref, by = reference(measured)
    own = F.col("language")
    for k, v in by.items():
        own = F.when(F.col("language") == k, v).otherwise(own)
    out = measured.withColumn("_by", own).join(F.broadcast(ref.withColumnRenamed("language", "_by")), "_by").drop("_by")
    z = lambda s: (F.col(s) - F.col(f"c_{s}")) / F.col(f"d_{s}")
    tails = F.array_compact(F.array(*[F.when(z(s) > TAIL_Z, F.lit(f"+{s}")).when(z(s) < -TAIL_Z, F.lit(f"-{s}")) for s in STATISTICS]))
    return out.withColumn("tails", tails).drop(*[f"{k}_{s}" for s in STATISTICS for k in "cd"])


def kind() -> F.Column:
    """What the tails of a flagged document say: junk, table, list, or null for running text.

    Noise comes first (odd characters, codes, rare characters, links), then rows of cells, words that no language spells,
    entries, and last the same bit over and over, few letters, and runs without end. Amounts guard what a few characters
    can't show: prose may repeat its phrases as long as it goes on.
    """
    c = F.col
    tail = lambda t: F.array_contains("tails", t)
    noise = tail("+odd_ratio") | tail("+code_share") | tail("+link_share") | (tail("+rare_share") & (c("han") > F.greatest(F.lit(8.0), 0.4 * c("chars"))))
    unspelled = tail("-pair_share") & tail("-common_share") & (c("latin") > 0.5 * c("chars")) & (c("latin") >= 16)
    entries = tail("+entry_share") & (c("repeat_ratio") < 0.8) & (c("distinct_lines") > 0.4) & (c("letter_share") > 0.3)
    over = tail("+repeat_ratio") & (c("chars") >= 12) & ((c("repeat_ratio") > 0.9) | ((1 - c("repeat_ratio")) * c("chars") < 400))
    empty = (tail("-letter_share") & (c("chars") >= 6)) | (tail("+longest_run") & (c("chars") >= 24))
    return F.when(noise, "junk").when(tail("+cell_share") & (c("repeat_ratio") < 0.9), "table").when(unspelled, "junk").when(entries, "list").when(over | empty, "junk")
