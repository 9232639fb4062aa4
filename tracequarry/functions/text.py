"""Text and number expressions that follow the event model: values are text, numbers are read from text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(v: Column) -> Column:
    """The 64-bit whole number that a text spells, else null.

    Up to 20 bytes; 0x and hex digits that fit 64 bits, read as a signed number; or an optional minus and
    digits. No blanks, plus signs or decimals.
    """
    digits = F.regexp_extract(v, r"^0[xX]0*([0-9a-fA-F]*)$", 1)
    hexadecimal = F.when(F.length(digits) <= 16, F.conv(F.concat(F.lit("0"), digits), 16, -10).cast("bigint"))
    short = F.octet_length(v) <= 20
    return F.when(short & v.rlike(r"^0[xX][0-9a-fA-F]+$"), hexadecimal).when(short & v.rlike(r"^-?[0-9]+$"), v.try_cast("bigint"))


def number_of(text: str) -> int | None:
    """The same for a literal."""
    if len(text.encode()) > 20:
        return None
    if re.fullmatch(r"0[xX][0-9a-fA-F]+", text):
        n = int(text, 16)
        return None if n >= 1 << 64 else n - (1 << 64) if n >= 1 << 63 else n
    if re.fullmatch(r"-?[0-9]+", text):
        n = int(text)
        return n if -(1 << 63) <= n < 1 << 63 else None
    return None


def natural_key(v: Column) -> Column:
    """A key whose order is that of lower-cased text with digit runs compared as numbers."""
    runs = F.regexp_extract_all(F.lower(v), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, F.greatest(F.lit(20), F.length(x)), "0")).otherwise(x)), "")


def has_mask(text: str) -> bool:
    return "*" in text or "?" in text


def like_pattern(mask: str) -> str:
    """A LIKE pattern, with backslash as escape, from a mask where * is any run and ? one character."""
    return "".join({"*": "%", "?": "_"}.get(c, "\\" + c if c in "%_\\" else c) for c in mask)


def matches_mask(v: Column, mask: str) -> Column:
    return F.lower(v).like(like_pattern(mask.lower()))
