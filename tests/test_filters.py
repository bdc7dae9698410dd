import pytest
from pyspark.sql import functions as F

from logweave.functions.ascii import ascii_icontains, ascii_iequals, ascii_lower
from logweave.functions.filters import InvalidFilter, parse_filter, regexp_filter, substring_filter
from logweave.functions.levels import level_of
from logweave.functions.regex import InvalidRegex, to_java_regex

GRAMMAR = [
    ('disk && "no space left" || !retry gave', "disk,no space left | !retry,gave"),
    ('!"user 7" shard', "!user 7,shard"),
    ("  shard   7 && ", "shard,7"),
    ("!!!shard", "!shard"),
    ('|| "', ""),
    ("shard && || 7", "shard | 7"),
    ('"open until the end ||', "open until the end ||"),
    ("\t!\t", ""),
    ('a "||" b', "a | b"),
    ('"!x"', "!x"),
    ("! && x", "!x"),
    ("! || x", "x"),
    ("! !! x", "x"),
    ("! !x", "x"),
    ("a||b", "a||b"),
    ('foo"bar baz"qux', "foobar bazqux"),
    ('"" a', "a"),
    ("|| a || || b ||", "a | b"),
    ("a\tb\vc", "a,b,c"),
    ("a b", "a b"),
]


@pytest.mark.parametrize("text, expected", GRAMMAR)
def test_grammar(text, expected):
    shown = " | ".join(
        ",".join(("!" if t.negate else "") + t.text for t in group) for group in parse_filter(text)
    )
    assert shown == expected


@pytest.fixture(scope="module")
def lines(spark):
    rows = [
        "2031-02-03 04:05:06.700 INFO door one unlocked",
        "\tpanel.rs:418 at the gate",
        "2031-02-03 04:05:07.800 ERROR door two jammed",
        "2031-02-03 04:05:08.900 INFO door three locked",
        "caféERROR déjà VU",
        "ends with cr\r",
        "x[1] a.b (c) $5 ^top \\back",
    ]
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "n int, line string").cache()


def hits(lines, predicate):
    return [r.n for r in lines.where(predicate).orderBy("n").collect()]


@pytest.mark.parametrize("text, expected", [
    ("info", [0, 3]),
    ("info || error", [0, 2, 3, 4]),
    ("info && !three", [0]),
    ("", [0, 1, 2, 3, 4, 5, 6]),
    ("DÉJÀ", []),
    ("vu", [4]),
    ("x[1]", [6]),
    ("a.b", [6]),
    ("axb", []),
    ("$5 ^top \\BACK", [6]),
    ("!at !info", [2, 4, 5, 6]),
])
def test_substring_filter(lines, text, expected):
    assert hits(lines, substring_filter(text)) == expected


@pytest.mark.parametrize("text, expected", [
    ("^2031.*ERROR", [2]),
    ("^2031.*ERROR || three.locked$", [2, 3]),
    (r"\berror\b", [2, 4]),
    ("error || warning", [2, 4]),
    ("[[:digit:]]{4}-", [0, 2, 3]),
    ("[[:alpha:]]gate", []),
    (r"PANEL\.rs:\d", [1]),
    ("cr$", []),
    ("cr.$", []),
    ("cr[^x]$", [5]),
    ("a||b", [0, 1, 2, 3, 4, 5, 6]),
    (r"\(c\)", [6]),
    ("(o)ne|(?:tw)o", [0, 2]),
    ("unl(?=ock)", [0]),
    ("(i)n(f)o.*d(o)\\3r", [0, 3]),
    ("d.j", [4]),
    ("D\\xc9J", []),
    ("!info && !^2031", [1, 4, 5, 6]),
    ("[x-z&&[v]", [4, 6]),
])
def test_regexp_filter(lines, text, expected):
    assert hits(lines, regexp_filter(text)) == expected


@pytest.mark.parametrize("text", ["!", "&&", "   ", "||", '""'])
def test_filters_without_terms_are_refused(spark, text):
    with pytest.raises(InvalidFilter):
        substring_filter(text)
    with pytest.raises(InvalidFilter):
        regexp_filter(text)


@pytest.mark.parametrize("pattern", [
    "(", ")", "a++", "a*+", "a?+", "(?<x>a)", "(?<=a)b", "(?>a)", "(?i)a", r"\p{L}", r"\Qa\E",
    r"\Aa", r"a\z", "[a", "*a", "a{2", "[[:nope:]]", "\\",
])
def test_regexes_of_other_dialects_are_refused(spark, pattern):
    with pytest.raises(InvalidFilter):
        regexp_filter(f'"{pattern}"')


def test_unicode_escape():
    assert to_java_regex("\\u00e9") == "(?i)\\x{e9}"
    with pytest.raises(InvalidRegex):
        to_java_regex("\\q")


def test_ascii_functions(spark):
    row = spark.range(1).select(
        ascii_lower(F.lit("MiXed 123 ÉÀ")),
        ascii_iequals(F.lit("Quit"), F.lit("qUIT")),
        ascii_iequals(F.lit("quit"), F.lit("quits")),
        ascii_icontains(F.lit("a Connection Refused b"), "connection refused"),
        ascii_icontains(F.lit("anything"), ""),
        ascii_icontains(F.lit("short"), "much longer needle"),
        ascii_icontains(F.lit("aaab"), "aab"),
        ascii_icontains(F.lit("aaab"), F.lit("AAB")),
        ascii_icontains(F.lit("é"), "É"),
    ).first()
    assert list(row) == ["mixed 123 ÉÀ", True, False, True, True, False, True, True, False]


def test_levels(spark):
    cases = [
        ("12:00 info x", "INFO"), ("WARNING y", "WARN"), ("a warn", "WARN"), ("informational", "(none)"),
        ("caféERROR", "ERROR"), ("x_error fatal", "FATAL"), ("[Trace]", "TRACE"), ("", "(none)"),
        ("debug then error", "DEBUG"), ("warnings", "(none)"), ("error1", "(none)"),
    ]
    df = spark.createDataFrame(cases, "line string, level string")
    for row in df.select("*", level_of(F.col("line")).alias("got")).collect():
        assert row.got == row.level, row.line
