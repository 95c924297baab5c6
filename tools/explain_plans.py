"""Print the executed physical plan of registered queries, trimmed to exchanges, joins, aggregates, Python
operators and scans (with pushed filters and read schema). usage: python tools/explain_plans.py SF_DIR NAME..."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pairforge.plans.registry import QUERIES  # noqa: E402
from pairforge.session import get_session  # noqa: E402

KEEP = ("Exchange", "Scan", "Join", "Aggregate", "Window", "Generate", "InPandas", "Sort ", "QueryStage")


def main() -> None:
    sf, names = sys.argv[1], sys.argv[2:]
    spark = get_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        df = QUERIES[name](spark, sf)
        df.count()
        plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())
        print("=====", name)
        for line in plan.splitlines():
            if any(k in line for k in KEEP):
                print(line[:240])
        for m in re.finditer(r"PushedFilters: \[[^\]]*\]|ReadSchema: [^\n]*", plan):
            print("   ", m.group(0)[:200])


if __name__ == "__main__":
    main()
