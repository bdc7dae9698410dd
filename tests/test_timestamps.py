import pytest
from pyspark.sql import functions as F

from logweave.functions.timestamps import TimestampFormat, first_match, with_match_flags
from logweave.sources.catalog import BUILT_IN_FORMATS
from tests import model

LOGBACK = "yyyy-MM-dd HH:mm:ss.SSS"
ISO = "yyyy-MM-ddTHH:mm:ss.SSS"
APACHE = "dd/MMM/yyyy:HH:mm:ss"
BRACKET = "[MMM dd HH:mm:ss.SSS]"
CTIME = "EEE MMM dd HH:mm:ss yyyy"
US = "MM/dd/yyyy hh:mm:ss a"

CASES = [
    (US, "02/29/2024 12:00:07 AM|cron", "2024-02-29 00:00:07"),
    (US, "02/29/2024 12:00:07 PM|cron", "2024-02-29 12:00:07"),
    (US, "11/03/2024 05:06:07 pm", "2024-11-03 17:06:07"),
    (US, "11/03/2024 05:06:07 pn", None),
    ("yyyy-MM-dd hh:mm:ss", "2019-10-11 12:13:14,", "2019-10-11 00:13:14"),
    ("yyyy-MM-dd hh:mm:ss", "2019-10-11 22:13:14,", "2019-10-11 10:13:14"),
    (CTIME, "fri Jan 05 06:07:08 2018", "2018-01-05 06:07:08"),
    (CTIME, "ven. déc. 28 06:07:08 2018", "2018-12-28 06:07:08"),
    (CTIME, "05 Jan 05 06:07:08 2018", None),
    (BRACKET, "[mai 07 00:00:59.9]", "0000-05-07 00:00:59.900000000"),
    (BRACKET, "[Feb 03 04:05:06.9876543210]", "0000-02-03 04:05:06.987654321"),
    (APACHE, "07/NOV/2017:18:19:20 POST", "2017-11-07 18:19:20"),
    (APACHE, "07/Nov/2017:18:19:20 POST", "2017-11-07 18:19:20"),
    (APACHE, "30/avr./2017:18:19:20 POST", "2017-04-30 18:19:20"),
    (APACHE, "30/FÉVR./2017:18:19:20 POST", None),
    (ISO, "2016-02-03T04:05:06.07+01:00", "2016-02-03 04:05:06.070000000"),
    (LOGBACK, "2015-12-31 23:59:59.000001 main", "2015-12-31 23:59:59.000001000"),
    (LOGBACK, "2015-12-31 23:59:59.98765432109 main", "2015-12-31 23:59:59.987654321"),
    (LOGBACK, "2015-13-32 25:61:62.7", "2015-13-32 25:61:62.700000000"),
    (LOGBACK, "2015-12-31 23:59:59.", None),
    (LOGBACK, "2015-12-31 23", None),
    (LOGBACK, "main 2015-12-31 23:59:59.1", None),
    (LOGBACK, "٢٠١٥-12-31 23:59:59.1", None),
    (LOGBACK, "", None),
    # A name is read once: "Oct." is taken, so the literal dot is missing.
    ("dd.MMM.yyyy HH:mm:ss", "21.Oct.2026 10:00:00", None),
    ("dd.MMM.yyyy HH:mm:ss", "21.Nov..2026 10:00:00", "2026-11-21 10:00:00"),
    # The last of repeated fields counts, and hh wins over HH.
    ("yyyy yyyy-MM-dd HH:mm:ss", "2025 2026-01-02 03:04:05", "2026-01-02 03:04:05"),
    ("HH hh yyyy-MM-dd mm:ss a", "23 01 2026-01-02 04:05 PM", "2026-01-02 13:04:05"),
    ("a yyyy-MM-dd HH:mm:ss", "PM 2026-01-02 03:04:05", "2026-01-02 03:04:05"),
    ("(yyyy|MM.dd) HH*mm+ss$", "(2026|01.02) 03*04+05$ x", "2026-01-02 03:04:05"),
    ("MMMM dd HH:mm:ss", "JanM 02 03:04:05", "0000-01-02 03:04:05"),
]


def test_sort_keys_and_spans(spark):
    for pattern in sorted({case[0] for case in CASES}):
        fmt = TimestampFormat("x", pattern)
        lines = [(line,) for p, line, _ in CASES if p == pattern]
        df = spark.createDataFrame(lines, "line string")
        got = df.select("line", fmt.sort_key(F.col("line")), fmt.span(F.col("line"))).collect()
        expected = {line: key for p, line, key in CASES if p == pattern}
        for line, key, span in got:
            assert key == expected[line], (pattern, line)
            found = model.match(pattern, line)
            assert (found[0] if found else None) == key
            assert span == (len(found[1].encode()) if found else 0), (pattern, line)


def test_key_order_is_bytewise(spark):
    keys = ["", "0000-12-31 23:59:59", "2031-02-03 04:05:06", "2031-02-03 04:05:06.000000000"]
    df = spark.createDataFrame([(k,) for k in reversed(keys)], "key string").orderBy("key")
    assert [r.key for r in df.collect()] == keys


@pytest.mark.parametrize("pattern", ["yyyy-MM-dd HH:mm", "yyyy-MM HH:mm:ss", "dd HH:mm:ss", "MM-dd mm:ss", ""])
def test_incomplete_patterns_are_refused(pattern):
    with pytest.raises(ValueError):
        TimestampFormat("bad", pattern)


def test_year_is_optional():
    assert TimestampFormat("ok", "MM-dd HH:mm:ss").fixed_width == 14


def test_first_matching_format(spark):
    lines = [
        ("2031-02-03 04:05:06 boiler lit", "plain"),
        ("2031-02-03 04:05:07.5 x", "logback"),
        ("2031-02-03 04:05:07,5 x", "logback-comma"),
        ("2031-02-03T04:05:07,5 x", "logback-iso"),
        ("2031-02-03T04:05:07-03:00", "iso8601-nofrac"),
        ("03/Feb/2031:04:05:07.25", "apache"),
        ("2031/02/03 04:05:07 x", "nginx"),
        ("Feb 03 04:05:07 host", "syslog"),
        ("03 Feb 2031 04:05:07.250 # x", "redis"),
        ("03-FEB-2031 04:05:07", "oracle"),
        ("Mon, 03 Feb 2031 04:05:07 GMT", "http-date"),
        ("02/03/2031 04:05:07 PM", "us-12h"),
        ("\tmore of it", None),
        ("", None),
    ]
    df = spark.createDataFrame(lines, "line string, name string")
    flagged = with_match_flags(df, BUILT_IN_FORMATS)
    for row in flagged.select("line", "name", "flags", first_match(F.col("flags")).alias("i")).collect():
        assert (None if row.i is None else BUILT_IN_FORMATS[row.i].name) == row.name
        if row.flags is not None:
            hits = [model.match(f.pattern, row.line) is not None for f in BUILT_IN_FORMATS]
            assert [c == "1" for c in row.flags] == hits, row.line


AWKWARD = [
    "MM-dd HH:mm:ss", "MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "MMM dd HH:mm:ss", "EEE MMM dd HH:mm:ss",
    "|MM-dd HH:mm:ss", "}MM-dd HH:mm:ss", "SSS-MM-dd HH:mm:ss", "aMM-dd HH:mm:ss", "$MM-dd HH:mm:ss",
    "MM-dd HH:mm:ssEEE", "MM-dd HH:mm:ssMMM", "MM-dd HH:mm:ssa",
]


@pytest.mark.parametrize("order", [1, -1])
def test_flags_of_overlapping_formats(spark, order):
    """Formats that are prefixes of each other, or that only some lines tell apart."""
    formats = [TimestampFormat(p, p) for p in AWKWARD[::order]]
    tails = ["", ".5", "Mon", "mar", "mar.", "am", "x"]
    heads = ["", "2026-", "Mar ", "mar. Jan ", "|", "}", "7-", "pm", "$", "Sat mai "]
    stamps = ["01-02 03:04:05", "01 03:04:05", "01-02 03:04"]
    lines = [(h + s + t,) for h in heads for s in stamps for t in tails]
    for row in with_match_flags(spark.createDataFrame(lines, "line string"), formats).collect():
        hits = "".join("1" if model.match(f.pattern, row.line) else "0" for f in formats)
        assert (row.flags or "0" * len(formats)) == hits, row.line


def test_keys_at_fixed_places_equal_those_by_regex(spark):
    """Names of three letters stand at fixed places; longer ones, and patterns that leave places open, take the regex."""
    tails = ["", " x", "7", ".", "é" * 60, "9" * 30]
    heads = {
        "EEE": ["Mon", "lun.", "SUN"], "MMM": ["Jan", "mai", "mars", "sept.", "DEC", "août"], "a": ["AM", "pm"],
        "SSS": ["1", "123456789", "12345678901234567890"],
    }
    values = {"yyyy": "2031", "MM": "12", "dd": "03", "HH": "14", "hh": "12", "mm": "06", "ss": "07"}
    patterns = [fmt.pattern for fmt in BUILT_IN_FORMATS] + [p for p, _, _ in CASES] + ["MMMd dd HH:mm:ss", "é MMM€dd HH:mm:ss.SSS]", "SSS MM-dd HH:mm:ss"]
    for pattern in dict.fromkeys(patterns):
        fmt = TimestampFormat("x", pattern)
        lines = [""]
        for token in fmt.tokens:
            lines = [line + text for line in lines for text in heads.get(token, [values.get(token, token)])]
        df = spark.createDataFrame([(line + tail,) for line in lines for tail in tails], "line string").where(fmt.matches(F.col("line")))
        line = F.col("line")
        by_regex = F.octet_length(F.regexp_extract(line, fmt.regex, 0))
        wrong = df.where(~(fmt.matched_key(line).eqNullSafe(fmt._regex_key(line)) & fmt.matched_span(line).eqNullSafe(by_regex)))
        assert df.count() > 0 and wrong.count() == 0, (pattern, wrong.first())


def test_keys_of_plain_formats_take_no_regex(spark):
    line = F.col("line")
    for fmt in BUILT_IN_FORMATS:
        if not {"EEE", "MMM"} & set(fmt.tokens):
            df = spark.createDataFrame([("",)], "line string").select(fmt.matched_key(line), fmt.matched_span(line))
            assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString(), fmt.name
