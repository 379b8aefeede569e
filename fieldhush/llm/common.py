"""Small helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The two alphabets of "lower-case A-Z only", and the words every contract counts.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII text takes the faster built-in, where both agree."""
    return F.when(F.char_length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def fold(c: Column, parts: int) -> Column:
    """crc32 of the value as text, modulo ``parts``; null for null."""
    return (F.crc32(c.cast("string").cast("binary")) % parts).cast("int")


def slim(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name cannot clash with an operator's own."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def free_name(df: DataFrame, base: str = "__row") -> str:
    """``base``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base += "_"
    return base
