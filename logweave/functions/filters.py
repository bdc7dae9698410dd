"""Filter expressions: OR of AND-groups of optionally negated terms, as one Column.

A space or ``&&`` means AND, ``||`` means OR, ``!`` negates the next term and
double quotes keep words together. There are no parentheses.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, SparkSession, functions as F

from logweave.functions.ascii import ascii_icontains
from logweave.functions.regex import InvalidRegex, to_java_regex


class InvalidFilter(ValueError):
    """The filter has no usable term, or a term is not a valid regex."""


@dataclass(frozen=True)
class Term:
    text: str
    negate: bool = False


# A word is a run of quoted pieces and non-space characters; an open quote runs to the end.
_WORD = re.compile(r'(?:"[^"]*(?:"|\Z)|[^"\s])+', re.ASCII)


def parse_filter(text: str) -> list[list[Term]]:
    """The OR-ed groups of AND-ed terms; empty groups and terms vanish."""
    words = [word.replace('"', "") for word in _WORD.findall(text)]
    groups: list[list[Term]] = [[]]
    negate_next = False
    for word in filter(None, words):
        if word == "||":
            groups.append([])
            negate_next = False
        elif word == "!":
            negate_next = not negate_next
        elif word != "&&":
            term = word.lstrip("!")
            flips = len(word) - len(term) + negate_next
            if term:
                groups[-1].append(Term(term, negate=flips % 2 == 1))
            negate_next = False
    return [group for group in groups if group]


def _compile(text: str, test: Callable[[str], Column]) -> Column | None:
    if text == "":
        return None
    groups = parse_filter(text)
    if not groups:
        raise InvalidFilter(f'nothing to search for in "{text}"')

    def term(t: Term) -> Column:
        return ~test(t.text) if t.negate else test(t.text)

    return reduce(or_, [reduce(and_, [term(t) for t in group]) for group in groups])


def substring_filter(text: str, line: Column | str = "line") -> Column:
    """Predicate for a substring filter; the empty text lets every line through."""
    column = F.col(line) if isinstance(line, str) else line
    compiled = _compile(text, lambda needle: ascii_icontains(column, needle))
    return F.lit(True) if compiled is None else compiled


def regexp_filter(text: str, line: Column | str = "line") -> Column:
    """Predicate for a filter whose terms are ECMAScript regexes, case-blind."""
    column = F.col(line) if isinstance(line, str) else line

    def test(pattern: str) -> Column:
        try:
            java = to_java_regex(pattern)
            _check_compiles(java)
        except InvalidRegex as error:
            raise InvalidFilter(f'a term of "{text}" is no regular expression: {error}') from error
        return column.rlike(java)

    compiled = _compile(text, test)
    return F.lit(True) if compiled is None else compiled


def _check_compiles(java: str) -> None:
    """Compile on the driver, so that a bad pattern fails before any job starts."""
    session = SparkSession.getActiveSession()
    if session is None:
        return
    try:
        session._jvm.java.util.regex.Pattern.compile(java)
    except Exception as error:  # py4j wraps PatternSyntaxException
        raise InvalidRegex(str(error).splitlines()[0]) from error
