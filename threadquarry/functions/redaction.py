"""Rule-based redaction with counts per rule, as regular expressions inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadquarry.functions.scalars import nfc

#: Rules in the order they apply (name, pattern, placeholder). Letters, digits and space have the wide, Unicode
#: sense; a line ends at a line feed only.
RULES = (
    ("email", r"(?Udi)(?<![\p{L}\p{N}_.+-])[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+(?![\p{L}\p{N}_.-])", "[EMAIL]"),
    ("phone", r"(?Ud)(?<!\d)1[3-9]\d{9}(?!\d)", "[PHONE]"),
    ("identity", r"(?Ud)(?<!\d)\d{17}[\dXx](?!\d)", "[IDENTIFIER]"),
    ("handle", r"(?Udi)(?:(?<![a-z0-9_])(?:(?:微信号?|wx|vx|v信|私信|qq号)[:：\s\x1c-\x1f]*|qq[:：\s\x1c-\x1f]+)[a-z0-9_-]{5,32}(?![a-z0-9_-])|@[a-z0-9_][a-z0-9_-]{1,31}(?![a-z0-9_-]))", "[HANDLE]"),
    ("address", r"(?Ud)地址[:：][\s\x1c-\x1f]*[^，,。\n]{4,80}(?=[，,。\n]|$)", "[ADDRESS]"),
    ("precise_address", r"(?Ud)[\x{4e00}-\x{9fff}]{2,}(?:路|街|巷)[\s\x1c-\x1f]*\d+[\s\x1c-\x1f]*号", "[ADDRESS]"),
)


def clean_text(text: Column) -> Column:
    """Line ends as line feeds, NFC, no outer white space."""
    return F.regexp_replace(nfc(F.regexp_replace(text, "\r\n?", "\n")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def redact(df: DataFrame, text: str, out: str = "redacted") -> DataFrame:
    """``df`` plus the redacted text, one count per rule (``n_<rule>``) and ``review``, true where a precise address was
    replaced. Counts are taken on the text as the earlier rules left it. A null text gives nulls and zero counts."""
    done = df.withColumn(out, clean_text(F.col(text)))
    for name, pattern, mark in RULES:
        done = done.withColumn(f"n_{name}", F.coalesce(F.regexp_count(F.col(out), F.lit(pattern)), F.lit(0)).cast("bigint"))
        done = done.withColumn(out, F.regexp_replace(F.col(out), pattern, mark.replace("[", r"\[").replace("]", r"\]")))
    return done.withColumn("n_address", F.col("n_address") + F.col("n_precise_address")).withColumn("review", F.col("n_precise_address") > 0).drop("n_precise_address")
