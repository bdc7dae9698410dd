"""Timestamp patterns compiled to Column expressions.

A pattern is a SimpleDateFormat-like string. It is turned, once and on the
driver, into a single anchored regex plus a replacement template that lays the
captured fields out as the sort key, so most keys take one regex evaluation.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F

from logweave.functions.ascii import java_literal

# Month spellings, English and then French, with their numbers.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "janv.": 1, "févr.": 2, "mars": 3, "avr.": 4, "mai": 5, "juin": 6,
    "juil.": 7, "août": 8, "sept.": 9, "oct.": 10, "nov.": 11, "déc.": 12,
}

# Weekday spellings, English and then French.
WEEKDAYS = [
    "mon", "tue", "wed", "thu", "fri", "sat", "sun",
    "lun.", "mar.", "mer.", "jeu.", "ven.", "sam.", "dim.",
]

FRACTION_DIGITS = 9

_TOKEN = re.compile("yyyy|EEE|MMM|MM|dd|HH|hh|mm|ss|SSS|a|.", re.DOTALL)


def _names(names) -> str:
    """Longest spelling first; atomic, so a later mismatch never retries a shorter one."""
    ordered = sorted(names, key=lambda name: -len(name.encode()))
    return "(?i:(?>" + "|".join(java_literal(name) for name in ordered) + "))"


# Per token: the field it fills (None: read and ignored), its regex, and its
# byte width when that is constant.
_FIELDS = {
    "yyyy": ("year", "[0-9]{4}", 4),
    "EEE": (None, _names(WEEKDAYS), None),
    "MMM": ("month", _names(MONTHS), None),
    "MM": ("month", "[0-9]{2}", 2),
    "dd": ("day", "[0-9]{2}", 2),
    "HH": ("hour", "[0-9]{2}", 2),
    "hh": ("hour12", "[0-9]{2}", 2),
    "mm": ("minute", "[0-9]{2}", 2),
    "ss": ("second", "[0-9]{2}", 2),
    "SSS": ("fraction", "[0-9]++", None),
    "a": ("half", "(?i:[ap]m)", 2),
}


_NAMES = {"EEE": WEEKDAYS, "MMM": list(MONTHS)}

# Month names of three letters, each with its number.
_SHORT_MONTHS = "".join(f"{name}{number:02d}" for name, number in MONTHS.items() if len(name) == 3)


@dataclass(frozen=True)
class TimestampFormat:
    name: str
    pattern: str

    def __post_init__(self):
        missing = [f for f in ("month", "day", "minute", "second") if f not in self._groups]
        if "hour" not in self._groups and "hour12" not in self._groups:
            missing.append("hour")
        if missing:
            raise ValueError(
                f'timestamp pattern "{self.pattern}" must give month, day, hour, minute and '
                f"second; missing: {', '.join(missing)}"
            )

    @cached_property
    def tokens(self) -> list[str]:
        return _TOKEN.findall(self.pattern)

    @cached_property
    def _groups(self) -> dict[str, int]:
        """Field -> capture group. A repeated field keeps its last group."""
        captured = [_FIELDS[t][0] for t in self.tokens if t in _FIELDS and _FIELDS[t][0]]
        return {field: number for number, field in enumerate(captured, start=1)}

    def _body(self, capture: bool) -> str:
        parts, seen = [], 0
        for token in self.tokens:
            field, regex, _ = _FIELDS.get(token, (None, java_literal(token), None))
            seen += field is not None
            if not (field and capture):
                parts.append(regex)
            elif self._groups[field] == seen:
                parts.append(f"(?<{field}>{regex})")
            else:
                parts.append(f"({regex})")
        return "".join(parts)

    @cached_property
    def regex(self) -> str:
        """Matches the start of a line; whatever follows is ignored."""
        return "\\A" + self._body(capture=True)

    @cached_property
    def body(self) -> str:
        """The regex without anchor and capture groups, to be combined with others."""
        return self._body(capture=False)

    @cached_property
    def fixed_width(self) -> int | None:
        widths = [
            _FIELDS[t][2] if t in _FIELDS else len(t.encode()) for t in self.tokens
        ]
        return None if None in widths else sum(widths)

    @cached_property
    def _template(self) -> str:
        """The key, with a month name or a 12-hour clock still to be filled in."""
        def group(field, absent):
            return "${" + field + "}" if field in self._groups else absent

        month = "00" if self._month_name else "${month}"
        hour = "00" if "hour12" in self._groups else "${hour}"
        fraction = ".${fraction}" + "0" * FRACTION_DIGITS if "fraction" in self._groups else ""
        return f"{group('year', '0000')}-{month}-${{day}} {hour}:${{minute}}:${{second}}{fraction}"

    @cached_property
    def _month_name(self) -> bool:
        return [t for t in self.tokens if t in ("MM", "MMM")][-1] == "MMM"

    @cached_property
    def _layout(self) -> tuple[dict[str, int], list[tuple[int, str]], list[int | str], int | None] | None:
        """Where fields begin if each name has three characters, as English ones do.

        Field -> place; the literals ``(place, character)`` that show that a name has three; per place what is there, a
        literal or the place itself; and where the fraction begins. None if the pattern leaves that open: if
        fields follow the fraction, or a name is followed by what another name may go on with.
        """
        places, guards, at, fraction = {}, [], [], None
        for number, token in enumerate(self.tokens):
            field, _, width = _FIELDS.get(token, ("literal", token, 1))
            if fraction is not None and field != "literal":
                return None
            if token in _NAMES:
                after = self.tokens[number + 1] if number + 1 < len(self.tokens) else "."
                if after in _FIELDS or any(name[3:4] == after.lower() for name in _NAMES[token]):
                    return None
                guards.append((len(at) + 3, after))
                width = 3
            if field == "fraction":
                fraction = len(at)
                continue
            if field not in (None, "literal"):
                places[field] = len(at)
            at += [token] if field == "literal" else range(len(at), len(at) + width)
        return places, guards, at, fraction

    def _by_place(self, line: Column, by_place: Column, by_regex: Callable[[], Column]) -> Column:
        """The first value where names have three characters, else the second."""
        names = [F.substring(line, place + 1, 1) == literal for place, literal in self._layout[1]]
        return F.when(reduce(Column.__and__, names), by_place).otherwise(by_regex()) if names else by_place

    def _n_digits(self, line: Column) -> Column:
        """Length of the fraction."""
        tail = F.substr(line, F.lit(self._layout[3] + 1))
        return F.octet_length(tail) - F.octet_length(F.ltrim(tail, F.lit("0123456789")))

    def _placed_key(self, line: Column) -> Column:
        """The key from characters at fixed places, without a regex."""
        places, _, at, fraction = self._layout
        parts: list[Column | str | tuple[int, int]] = []

        def add(text: str | None, place: int = -1, width: int = 1) -> None:
            last = parts[-1] if parts else None
            if text is not None and isinstance(last, tuple) and [text] == at[last[1]:last[1] + 1]:
                place, text = last[1], None  # the line has this literal here too
            if text is not None:
                parts.append(text)
            elif isinstance(last, tuple) and last[1] == place:
                parts[-1] = (last[0], place + width)
            else:
                parts.append((place, place + width))

        def field(name: str, width: int = 2) -> None:
            add(None, places[name], width)

        if "year" in places:
            field("year", 4)
        else:
            add("0000")
        add("-")
        if self._month_name:
            name = F.lower(F.substring(line, places["month"] + 1, 3))
            parts.append(F.substr(F.lit(_SHORT_MONTHS), F.instr(F.lit(_SHORT_MONTHS), name) + 3, F.lit(2)))
        else:
            field("month")
        add("-")
        field("day")
        add(" ")
        if "hour12" in places:
            hour = F.substring(line, places["hour12"] + 1, 2).cast("int") % 12
            if "half" in places:
                hour = hour + F.when(F.upper(F.substring(line, places["half"] + 1, 2)) == "PM", 12).otherwise(0)
            parts.append(F.lpad(hour.cast("string"), 2, "0"))
        else:
            field("hour")
        add(":")
        field("minute")
        add(":")
        field("second")
        if fraction is not None:
            add(".")
            digits = F.substr(line, F.lit(fraction + 1), F.least(self._n_digits(line), F.lit(FRACTION_DIGITS)))
            parts.append(F.rpad(digits, FRACTION_DIGITS, "0"))
        return F.concat(*[
            F.lit(p) if isinstance(p, str) else F.substring(line, p[0] + 1, p[1] - p[0]) if isinstance(p, tuple) else p
            for p in parts
        ])

    def matches(self, line: Column) -> Column:
        return line.rlike(self.regex)

    def matched_key(self, line: Column) -> Column:
        """``YYYY-MM-DD HH:MM:SS``, and a 9-digit fraction if the format has one, for
        a line known to match.

        Built as text without range checks, so that odd but well-formed values
        (month 99) still give a key.
        """
        if self._layout is None:
            return self._regex_key(line)
        return self._by_place(line, self._placed_key(line), lambda: self._regex_key(line))

    def _regex_key(self, line: Column) -> Column:
        # The rest of the line goes with (?s:.*+): a class such as [\s\S] is far slower in Java.
        key = F.regexp_replace(line, self.regex + "(?s:.*+)", self._template)
        if "fraction" in self._groups:
            key = key.substr(1, 20 + FRACTION_DIGITS)
        if self._month_name:
            name = F.regexp_extract(line, self.regex, self._groups["month"])
            key = F.overlay(key, _month_number(name), 6, 2)
        if "hour12" in self._groups:
            hour = F.regexp_extract(line, self.regex, self._groups["hour12"]).try_cast("int") % 12
            if "half" in self._groups:
                half = F.regexp_extract(line, self.regex, self._groups["half"])
                hour = hour + F.when(F.upper(half) == "PM", 12).otherwise(0)
            key = F.overlay(key, F.lpad(hour.cast("string"), 2, "0"), 12, 2)
        return key

    def sort_key(self, line: Column) -> Column:
        return F.when(self.matches(line), self.matched_key(line))

    def matched_span(self, line: Column) -> Column:
        """Bytes taken by the timestamp of a line known to match."""
        if self.fixed_width is not None:
            return F.lit(self.fixed_width)

        def by_regex() -> Column:
            return F.octet_length(F.regexp_extract(line, self.regex, 0))

        if self._layout is None:
            return by_regex()
        _, _, at, fraction = self._layout
        width = F.lit(sum(len(c.encode()) if isinstance(c, str) else 1 for c in at))
        return self._by_place(line, width if fraction is None else width + self._n_digits(line), by_regex)

    def span(self, line: Column) -> Column:
        """Bytes taken by the timestamp, 0 when there is none."""
        return F.when(self.matches(line), self.matched_span(line)).otherwise(0)


def _month_number(name: Column) -> Column:
    pairs = ", ".join(f"'{spelling}', '{number:02d}'" for spelling, number in MONTHS.items())
    return F.try_element_at(F.expr(f"map({pairs})"), F.lower(name))


def key_for(formats: dict[int, TimestampFormat], fmt_idx: Column, line: Column) -> Column:
    """The key under the format numbered ``fmt_idx``; only that branch runs.

    Pass just the formats in use: with all of them the generated method grows
    beyond what the JVM compiles, which costs more than the matching itself.
    """
    return _by_format(fmt_idx, {number: fmt.matched_key(line) for number, fmt in formats.items()})


def span_for(formats: dict[int, TimestampFormat], fmt_idx: Column, line: Column) -> Column:
    return _by_format(fmt_idx, {number: fmt.matched_span(line) for number, fmt in formats.items()})


#: Digits of a fraction that a stamp allows for; one more is seen and kept.
_STAMP_DIGITS = 17


def _most_characters(fmt: TimestampFormat) -> int:
    names = {"MMM": list(MONTHS), "EEE": WEEKDAYS, "a": ["am"]}
    return sum(
        _STAMP_DIGITS if token == "SSS" else max(map(len, names[token])) if token in names else len(token)
        for token in fmt.tokens
    )


def stamp_of(formats: list[TimestampFormat], line: Column) -> Column:
    """The start of a line from which keys and spans of all formats come out as from the whole line.

    Only a run of digits is unbounded in a pattern; a line with a long one near its start is kept whole.
    """
    start = F.substring(line, 1, max(map(_most_characters, formats)))
    return F.when(start.rlike(f"[0-9]{{{_STAMP_DIGITS}}}"), line).otherwise(start)


def _by_format(fmt_idx: Column, branches: dict[int, Column]) -> Column:
    chosen = F.lit(None)
    for number, branch in reversed(branches.items()):
        chosen = F.when(fmt_idx == number, branch).otherwise(chosen)
    return chosen


def _elements(fmt: TimestampFormat) -> list[tuple[str, str]]:
    """What a pattern reads, step by step: a digit, a literal, a name, a run of digits."""
    steps: list[tuple[str, str]] = []
    for token in fmt.tokens:
        field, _, width = _FIELDS.get(token, ("literal", token, 1))
        if field == "literal":
            steps.append(("literal", token))
        elif field != "half" and width is not None:
            steps += [("digit", "")] * width
        else:
            steps.append(("name", token) if token != "SSS" else ("digits", ""))
    return steps


def _first_characters(step: tuple[str, str]) -> set[str]:
    kind, token = step
    if kind == "literal":
        return {token}
    if kind in ("digit", "digits"):
        return set("0123456789")
    names = {"MMM": list(MONTHS), "EEE": WEEKDAYS, "a": ["am", "pm"]}[token]
    return {c for name in names for c in (name[0], name[0].upper())}


def _also_matches(first: TimestampFormat, other: TimestampFormat) -> str:
    """Whether every (``1``), no (``0``) or some line (``?``) that matches ``first``
    also matches ``other``, as far as the patterns alone tell."""
    mine, others = _elements(first), _elements(other)
    for step, other_step in zip(mine, others):
        if step != other_step:
            return "?" if _first_characters(step) & _first_characters(other_step) else "0"
    return "1" if len(others) <= len(mine) else "?"


def with_match_flags(lines: DataFrame, formats: list[TimestampFormat], column: str = "line") -> DataFrame:
    """Add ``flags``: one character per format, ``1`` where it matches the line; NULL
    when none does. ``column`` holds the line, or its stamp, which the same formats match.

    A single regex tells the first matching format of a line. Mostly that settles
    the others: ``yyyy-MM-dd HH:mm:ss.SSS`` implies ``yyyy-MM-dd HH:mm:ss`` and rules
    out ``dd/MMM/yyyy``. Only what the patterns leave open is tested line by line.
    """
    line = F.col(column)
    literals = {step[1] for fmt in formats for step in _elements(fmt)}
    border = next(chr(c) for c in range(ord("|"), 0x10FFFF) if chr(c) not in literals)
    # Behind the line, and a border that no format matches, stands a character for each format. The regex of a format goes
    # on to its character, so one group tells which was first; to read that from a group for each format takes twice as long.
    signs = [chr(i + (ord("!") if i < 64 else 0x100)) for i in range(len(formats))]
    tests = "|".join(f"{fmt.body}(?s:.*)(?={java_literal(sign)})" for fmt, sign in zip(formats, signs))
    sign = F.regexp_extract(F.concat(line, F.lit(border + "".join(signs))), f"\\A(?:{tests})((?s:.))", 1)
    settled = [
        "0" * i + "1" + "".join(_also_matches(fmt, other) for other in formats[i + 1:])
        for i, fmt in enumerate(formats)
    ]
    by_first = F.array(*[F.lit(flags) for flags in settled])
    lines = lines.withColumn("sign", sign).withColumn(
        "flags", F.when(F.col("sign") != "", F.get(by_first, F.instr(F.lit("".join(signs)), F.col("sign")) - 1))
    ).drop("sign")
    unsettled = [i for i in range(len(formats)) if any(flags[i] == "?" for flags in settled)]
    if not unsettled:
        return lines

    def flag(i: int) -> Column:
        known = F.col("flags").substr(i + 1, 1)
        if i not in unsettled:
            return known
        tested = F.when(formats[i].matches(line), "1").otherwise("0")
        return F.when(known == "?", tested).otherwise(known)

    tested = F.concat(*[flag(i) for i in range(len(formats))])
    return lines.withColumn(
        "flags", F.when(F.contains("flags", F.lit("?")), tested).otherwise(F.col("flags"))
    )


def first_match(flags: Column) -> Column:
    """Number of the first matching format; NULL when none matches."""
    return F.instr(flags, "1") - 1


def matches_format(flags: Column, fmt_idx: Column) -> Column:
    return F.coalesce(flags.substr(fmt_idx + 1, F.lit(1)) == "1", F.lit(False))
