"""Summarise the executed physical plans of registered queries.

For each query: number of shuffles (hash / range / single-partition
exchanges), broadcasts, whole-stage-codegen spans, Python evaluation nodes,
and each file scan's read schema and pushed filters.  Usage:
python tools/plan_report.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stepcorpus.plans.registry import load_all  # noqa: E402
from stepcorpus.session import get_session  # noqa: E402


def summarise(plan: str) -> dict:
    lines = plan.split("\n")
    count = lambda pat: sum(1 for ln in lines if re.search(pat, ln))
    scans = []
    for ln in lines:
        m = re.search(r"FileScan (\w+) \[.*?PushedFilters: (\[.*?\]).*ReadSchema: (struct<.*?>)", ln)
        if m:
            scans.append(f"{m.group(1)} read={m.group(3)[:90]} pushed={m.group(2)[:80]}")
    return {
        "hash_shuffles": count(r"Exchange hashpartitioning"),
        "range_shuffles": count(r"Exchange rangepartitioning"),
        "single_partition": count(r"Exchange SinglePartition"),
        "broadcasts": count(r"BroadcastExchange"),
        "codegen_stages": count(r"WholeStageCodegen|^\s*[:+-]*\s*\*\(\d+\)"),
        "python": count(r"ArrowEvalPython|MapInPandas|PythonMapInArrow|FlatMapGroupsInPandas"),
        "scans": scans,
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_session()
    reg = load_all()
    for name in names or sorted(reg):
        df = reg[name].build(spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(re.sub(r"(<\|image_pad\|>)+", "<PADS>", plan))
        print(f"{name}: shuffles hash={s['hash_shuffles']} range={s['range_shuffles']} "
              f"single={s['single_partition']} broadcast={s['broadcasts']} python={s['python']}")
        for sc in s["scans"]:
            print(f"    scan {sc}")
    spark.stop()


if __name__ == "__main__":
    main()
