"""URL filters: a trie over reversed host labels and path segments.

Rules are (verdict, host, path prefix). A rule fits its host and every subdomain of it
if the url's path starts with the rule's path. The trie first walks the host's labels
from the right, then the path's segments, and remembers the deepest rule that it meets:
more host labels win over fewer, then the longer path wins; if the same host and path are
both allowed and blocked, block wins.

The rules are the operator's parameters, kept on the driver by whoever calls it; they are
broadcast once. ``MAX_RULE_BYTES`` bounds them, a larger list is refused.

Cases: a null url or one without ``://`` has an empty host and path, fits no rule and gets
the default verdict. Empty labels and segments (``a..com``, ``//``) are labels and segments like any others.
Repeated rows are judged one by one, an empty table gives an empty one, and the input's
other columns are kept as they are: the result is one added struct column.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logweave.llm.common import ascii_lower

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_RULE_BYTES = 64 << 20
# Keys of a node that no label and no segment can equal.
_PATHS, _RULES = 0, 1


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Nested dicts: label -> node; under ``_PATHS`` segment -> node; under ``_RULES`` the
    path prefixes that end inside the next segment, longest first."""
    root: dict = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule is allow or block, not {verdict!r}")
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node.setdefault(label, {})
        *segments, rest = path.split("/")
        for segment in segments:
            node = node.setdefault(_PATHS, {}).setdefault(segment, {})
        ends = node.setdefault(_RULES, {})
        if ends.get(rest, ("", ""))[0] != "block":
            ends[rest] = (verdict, host + path)
    _order(root)
    return root


def _order(node: dict) -> None:
    for key, child in node.items():
        if key == _RULES:
            node[key] = sorted(child.items(), key=lambda end: -len(end[0]))
        elif key == _PATHS:
            for below in child.values():
                _order(below)
        else:
            _order(child)


def _along_path(node: dict, path: str) -> tuple[str, str] | None:
    """The rule with the longest path below this host's node."""
    found, at = None, 0
    while True:
        for rest, rule in node.get(_RULES, ()):
            if path.startswith(rest, at):
                found = rule
                break
        end = path.find("/", at)
        if end < 0 or _PATHS not in node:
            return found
        node = node[_PATHS].get(path[at:end])
        if node is None:
            return found
        at = end + 1


def match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(verdict, rule) of the longest match, or None."""
    found = _along_path(trie, path)
    node = trie
    for label in reversed(host.split(".")) if host else ():
        node = node.get(label)
        if node is None:
            break
        found = _along_path(node, path) or found
    return found


def judge(
    spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]], *, url: str = "url",
    out: str = "filter", default: str = "allow",
) -> DataFrame:
    """``pages`` with a struct column ``out`` of host, path, rule and verdict."""
    if sum(len(part) for rule in rules for part in rule) > MAX_RULE_BYTES:
        raise ValueError(f"the rules exceed {MAX_RULE_BYTES} bytes")
    shared = spark.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def look_up(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        for hosts, paths in batches:
            found = [match(trie, host, path) or (default, None) for host, path in zip(hosts, paths)]
            yield pd.DataFrame({"rule": [x[1] for x in found], "verdict": [x[0] for x in found]})

    where = host_and_path(F.col(f"`{url}`"))
    parts = pages.withColumn(out, where)
    verdict = look_up(F.col(f"`{out}`.host"), F.col(f"`{out}`.path"))
    return parts.withColumn(out, F.struct(
        F.col(f"`{out}`.host").alias("host"), F.col(f"`{out}`.path").alias("path"),
        verdict.getField("rule").alias("rule"), verdict.getField("verdict").alias("verdict"),
    ))


def host_and_path(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.struct(
        ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )
