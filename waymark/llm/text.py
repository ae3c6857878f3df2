"""Word expressions shared by the operators: Columns only, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = r"[\x20\x09-\x0D]+"
#: Separators of alphanumeric words: ASCII that is neither a digit nor a letter.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def pieces(text: Column, separator: str) -> Column:
    """The non-empty pieces between separators; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and tab to carriage return."""
    return pieces(text, WHITE)


def lower_ascii(word: Column) -> Column:
    """Lower-cases A-Z and nothing else. lower() is the cheap way where every character is ASCII."""
    ascii_only = F.octet_length(word) == F.length(word)
    return F.when(ascii_only, F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def hashes(parts: Column) -> Column:
    """A 64-bit hash for each element."""
    return F.transform(parts, lambda w: F.xxhash64(w))
