"""Time the headline queries; prints one JSON line.

The log files are rendered before the clock starts, as they stand for the input.
Queries that begin with a parse read and parse those files within their time;
viewer queries (filters, find, statistics) run on a document parsed beforehand,
as they do for a user who keeps it open.
"""

from __future__ import annotations

import json
import os
import time

from logweave.session import local_session
from workload.logs import logs_of
from workload.queries import QUERIES

FROM_FILES = [
    "read_tree", "detect_format", "group_entries", "merge_chronological", "dedup_entries",
    "number_lines", "level_counts", "write_merged",
]
ON_DOCUMENT = [
    "filter_substring", "filter_expression", "filter_regexp", "line_counts", "find_from", "find_next",
    "find_previous", "find_spans", "slice_lines", "tail_lines", "entry_context", "entry_content",
    "visible_headers", "level_share",
]
EXPRESSIONS = ["sort_key", "twelve_hour", "month_names", "fraction_precision", "level_of_header", "ascii_icontains"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    logs = logs_of(spark, sf_dir)
    logs.root, logs.parsed, logs.numbered
    times = {}
    for name in FROM_FILES + ON_DOCUMENT + EXPRESSIONS:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "log queries, total time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
