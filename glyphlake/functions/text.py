"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that a term loses. ``(?U)\s`` leaves 1C-1F out, so they are listed.
SPACE_CLASS = "(?U)[\\s\\x1C-\\x1F]"
#: Seven ranges of Han code points.
HAN = "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2B73F}\\x{2B740}-\\x{2B81F}\\x{2B820}-\\x{2CEAF}]"
COLOR_CODE = "\\^C[0-9A-Fa-f]{8}(?:[0-9A-Fa-f]{8})?"


def normalize_text(text: Column) -> Column:
    """Without any Unicode white space."""
    return F.regexp_replace(text, SPACE_CLASS, "")


def strip_color_codes(text: Column) -> Column:
    """Without ^C and its 8 or 16 hexadecimal digits."""
    return F.regexp_replace(text, COLOR_CODE, "")


def is_han(ch: Column) -> Column:
    return ch.rlike(f"^{HAN}$")


def characters(text: Column) -> Column:
    """Array of code points; no trailing empty string."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def sequence_cer(hypothesis: Column, reference: Column) -> Column:
    """Levenshtein distance over the longer length (1 at least)."""
    return F.levenshtein(hypothesis, reference) / F.greatest(F.length(hypothesis), F.length(reference), F.lit(1))


def subsequence_span(text: Column, term: Column) -> Column:
    """Greedy earliest alignment of text in term: struct(first, last, ok), 1-based places."""
    start = F.struct(F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(True).alias("ok"))

    def step(acc: Column, ch: Column) -> Column:
        at = _locate(ch, term, acc["last"])
        return F.struct(F.when(acc["first"] == 0, at).otherwise(acc["first"]).alias("first"), F.when(at > 0, at).otherwise(acc["last"]).alias("last"), (acc["ok"] & (at > 0)).alias("ok"))

    return F.aggregate(characters(text), start, step)


def _locate(ch: Column, term: Column, after: Column) -> Column:
    """Place of ch in term past ``after``, or 0."""
    at = F.instr(F.substring(term, after + 1, F.length(term)), ch)
    return F.when(at > 0, at + after).otherwise(F.lit(0)).cast("int")
