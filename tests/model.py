"""Sequential statement of the expected results, for comparison on small logs."""

from __future__ import annotations

import re

from logweave.functions.timestamps import MONTHS, WEEKDAYS


def fold(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def take_name(line, at, names):
    """The longest name found at a position, with no second try."""
    for name in sorted(names, key=lambda n: -len(n.encode())):
        if fold(line[at:at + len(name)]) == name:
            return name
    return None


def match(pattern, line):
    """``(sort_key, matched text)`` or None."""
    fields, at = {}, 0
    for token in re.findall("yyyy|EEE|MMM|MM|dd|HH|hh|mm|ss|SSS|a|.", pattern, re.S):
        rest = line[at:]
        if token in ("MMM", "EEE"):
            name = take_name(line, at, MONTHS if token == "MMM" else WEEKDAYS)
            if name is None:
                return None
            if token == "MMM":
                fields["MM"] = f"{MONTHS[name]:02d}"
            at += len(name)
            continue
        regex = {"yyyy": "[0-9]{4}", "SSS": "[0-9]+", "a": "[aApP][mM]"}.get(
            token, "[0-9]{2}" if token in ("MM", "dd", "HH", "hh", "mm", "ss") else re.escape(token)
        )
        found = re.match(regex, rest)
        if not found:
            return None
        if token in ("yyyy", "SSS", "a", "MM", "dd", "HH", "hh", "mm", "ss"):
            fields[token] = found.group()
        at += found.end()
    hour = fields.get("HH")
    if "hh" in fields:
        hour = f"{int(fields['hh']) % 12 + 12 * (fields.get('a', '').lower() == 'pm'):02d}"
    key = (
        f"{fields.get('yyyy', '0000')}-{fields['MM']}-{fields['dd']} "
        f"{hour}:{fields['mm']}:{fields['ss']}"
    )
    if "SSS" in fields:
        key += "." + fields["SSS"][:9].ljust(9, "0")
    return key, line[:at]


def split(content: bytes):
    lines = content.split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    return [line.removesuffix(b"\r").decode() for line in lines]


def detect(lines, formats, sample=2000):
    votes = [0] * len(formats)
    for line in lines[:sample]:
        hit = next((i for i, f in enumerate(formats) if match(f.pattern, line)), None)
        if hit is not None:
            votes[hit] += 1
    if any(votes):
        return votes.index(max(votes))
    for line in lines[sample:]:
        for i, f in enumerate(formats):
            if match(f.pattern, line):
                return i
    return None


def parse(content: bytes, formats, sample=2000):
    """``[(sort_key, [lines])]`` of one file."""
    lines = split(content)
    chosen = detect(lines, formats, sample)
    entries = []
    for line in lines:
        found = match(formats[chosen].pattern, line) if chosen is not None else None
        if found:
            entries.append((found[0], [line]))
        elif entries:
            entries[-1][1].append(line)
        else:
            entries.append(("", [line]))
    return entries


def merge(contents, formats, dedup=False, sample=2000):
    entries = [e for content in contents for e in parse(content, formats, sample)]
    entries.sort(key=lambda e: e[0].encode())
    if dedup:
        seen, kept = set(), []
        for key, lines in entries:
            if tuple(lines) not in seen:
                seen.add(tuple(lines))
                kept.append((key, lines))
        entries = kept
    return entries
