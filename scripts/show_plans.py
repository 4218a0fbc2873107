"""Summarise the final (adaptive) physical plan of every catalog query.

usage: python scripts/show_plans.py [sf_dir] [query ...]

Per query: shuffles, join strategies, windows, single-partition exchanges
(with what feeds them), and for each scan the columns read and the filters
pushed into Parquet.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(plan: str) -> dict:
    plan = plan.split("== Initial Plan ==")[0]  # the adaptive plan as executed
    lines = plan.split("\n")
    single = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line and i + 1 < len(lines):
            single.append(re.sub(r"#\d+L?", "", lines[i + 1].strip())[:70])
    scans = []
    for line in lines:
        m = re.search(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\]", line)
        if m:
            cols = re.sub(r"#\d+L?", "", m.group(1))
            table = re.search(r"/([a-z_]+)(\.parquet)?[,\]]", line)
            scans.append(f"{table.group(1) if table else '?'}[{cols}] pushed[{m.group(2)[:60]}]")
    stages = {int(x) for x in re.findall(r"\*\((\d+)\)", plan)}
    outside = set()
    for line in lines:
        op = re.sub(r"^[\s:+\-]*", "", line)
        if not op or op.startswith("*(") or op.startswith("=="):
            continue
        name = re.match(r"[A-Za-z]+", op)
        if name and name.group(0) not in {
                "AdaptiveSparkPlan", "ResultQueryStage", "ShuffleQueryStage", "BroadcastQueryStage",
                "AQEShuffleRead", "Exchange", "BroadcastExchange", "ReusedExchange", "TableCacheQueryStage",
                "ColumnarToRow", "FileScan", "Scan", "Subquery", "WriteFiles", "Execute"}:
            outside.add(name.group(0))
    return {
        "codegen_stages": len(stages),
        "outside_codegen": sorted(outside),
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning", plan)),
        "reused": plan.count("ReusedExchange"),
        "broadcast_joins": plan.count("BroadcastHashJoin"),
        "sort_merge_joins": plan.count("SortMergeJoin"),
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "single_partition": single,
        "scans": scans,
    }


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    wanted = argv[2:]
    from latebound.plans import QUERIES
    from latebound.session import local_session

    spark = local_session(8, 16)
    for name, fn in QUERIES.items():
        if (wanted and name not in wanted) or name.endswith("_stream"):
            continue
        df = fn(spark, sf_dir)
        df.collect()
        s = summarise(df._jdf.queryExecution().executedPlan().toString())
        print(f"## {name}")
        print(f"shuffles {s['shuffles']} (reused {s['reused']}), broadcast joins {s['broadcast_joins']}, "
              f"sort-merge joins {s['sort_merge_joins']}, windows {s['windows']}, "
              f"codegen stages {s['codegen_stages']}, outside codegen {s['outside_codegen'] or '-'}")
        for x in s["single_partition"]:
            print(f"  single partition over: {x}")
        for x in s["scans"]:
            print(f"  scan {x}")
        print()


if __name__ == "__main__":
    main(sys.argv)
