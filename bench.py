"""Times the headline queries and prints one line of JSON.

Each is run once to warm up and then five times, of which the median counts; a query stops after
the first timed run that goes beyond `BENCH_SECONDS` in sum.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from datatrawl.checks.queries import QUERIES
from datatrawl.session import local_session

HEADLINE = (
    "links", "titles", "abstract", "download_links", "metadata_page", "tokens", "sentences",
    "token_roots", "organizations", "publisher_orgs", "search_urls", "expand_urls",
    "search_cursor", "dedupe_batch", "spatial_extent", "route", "assign_link_ids",
    "link_metadata_flat", "expand_one_hop", "page_record", "tab_title",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "6"))
    most = float(os.environ.get("BENCH_SECONDS", "12"))
    spark = local_session("bench", cpus, 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            if sum(times[1:]) > most:
                break
        # The first run warms up the JVM unless it is the only one.
        seconds[name] = round(statistics.median(times[1:] or times), 3)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
