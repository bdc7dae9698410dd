"""ASCII-only case folding. ``lower`` would also fold accented letters."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

# Java reads these as syntax outside a character class.
_JAVA_SYNTAX = set("\\^$.|?*+()[]{}")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def ascii_lower_str(text: str) -> str:
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def ascii_iequals(left: Column, right: Column) -> Column:
    return ascii_lower(left) == ascii_lower(right)


def java_literal(text: str) -> str:
    """``text`` as a Java regex that matches exactly itself."""
    return "".join("\\" + ch if ch in _JAVA_SYNTAX else ch for ch in text)


def ascii_icontains(text: Column, needle: Column | str) -> Column:
    """Substring test. A literal needle becomes one compiled case-blind search,
    which is several times cheaper per line than folding the whole line."""
    if isinstance(needle, str):
        if needle == "":
            return text.isNotNull()
        return text.rlike("(?i)" + java_literal(needle))
    return F.contains(ascii_lower(text), ascii_lower(needle))
