"""Log level of an entry header."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The recognised level words and the label for headers without one.
LEVELS = ["TRACE", "DEBUG", "INFO", "WARNING", "WARN", "ERROR", "FATAL"]
NO_LEVEL = "(none)"

# ASCII word borders spelled out: Java's \b treats accented letters as word characters.
# The first letters come first: most characters are none of them, and need no further look.
_FIRST = "".join(sorted({letter for word in LEVELS for letter in (word[0], word[0].lower())}))
_LEVEL_REGEX = f"(?i)(?=[{_FIRST}])(?<![A-Za-z0-9_])(" + "|".join(LEVELS) + ")(?![A-Za-z0-9_])"


def level_word(header: Column) -> Column:
    """The level word as the header has it, in capitals; empty if there is none."""
    return F.upper(F.regexp_extract(header, _LEVEL_REGEX, 1))


def level_of(header: Column) -> Column:
    word = level_word(header)
    return F.when(word == "", NO_LEVEL).when(word == "WARNING", "WARN").otherwise(word)


#: The labels in a fixed order, for tables that keep a level as its place here.
LABELS = [NO_LEVEL, *(word for word in LEVELS if word != "WARNING")]


def level_code(word: Column) -> Column:
    """The place in ``LABELS`` of a ``level_word``, which should be a column: it is looked at twice."""
    words = F.array(F.lit(""), *map(F.lit, LABELS[1:]))
    return F.array_position(words, F.when(word == "WARNING", "WARN").otherwise(word)).cast("int") - 1


def label_of(code: Column) -> Column:
    return F.get(F.array(*map(F.lit, LABELS)), code)
