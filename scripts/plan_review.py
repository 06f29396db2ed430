"""Summarise the physical plan of every report (exchanges, broadcasts,
windows, scans) on the staged warehouse tables; writes markdown.

usage: python scripts/plan_review.py [sf_dir] [out.md]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.plans import fine_grain  # noqa: E402
from ledgerlens.plans.catalog import REPORTS  # noqa: E402
from ledgerlens.session import build_session  # noqa: E402
from ledgerlens.sources.staging import staged_tables  # noqa: E402


INTRODUCTION = """# Plan review

Generated by `scripts/plan_review.py` from the final (adaptive) physical plans
of every report on staged tables, local[8]. Columns: the columns each scan
reads (one group per scan), the exchanges (shuffles) of the plan, the joins
Spark chose, and every window with its partition and order keys (`-` = no
PARTITION BY, i.e. one task).

How to read it against the scale rules:

* Scans read only the columns the report uses, from the smallest staged table
  that answers; the fact is never re-joined.
* Nothing is exchanged by order_id where lines are grouped by order: they are
  bucketed by it.
* `SinglePartition` appears only above bounded aggregates: one-row aggregates,
  windows over months, categories, states or segments, and tables with one row
  per partition (order `[_part]`).
* Quartile reports have no window and no sort but the final one. What is written
  while a report is built (its input, ordered tables) is not part of the plan.
* BroadcastHashJoin only appears where the size estimate allows it and for tables
  with one row per partition.

"""


def summarise(plan: str) -> dict:
    reused = plan.count("ReusedExchange")
    plan_wo_reused = "\n".join(line for line in plan.splitlines() if "ReusedExchange" not in line)
    ex = re.findall(r"Exchange (hashpartitioning\(([^)]*)\)|SinglePartition|rangepartitioning)",
                    plan_wo_reused)
    kinds = []
    for full, keys in ex:
        if full.startswith("hash"):
            names = [k.split("#")[0] for k in keys.split(", ")[:-1]]
            kinds.append("hash(" + ", ".join(names) + ")")
        else:
            kinds.append(full.split("(")[0])
    windows = []
    for line in plan.splitlines():
        if "Window [" not in line or "WindowGroupLimit" in line:
            continue
        spec = re.search(r"windowspecdefinition\((.*?), specifiedwindowframe", line)
        items = spec.group(1).split(", ") if spec else []
        order = [i for i in items if " ASC" in i or " DESC" in i]
        part = [i for i in items if i not in order]
        p = ", ".join(x.split("#")[0] for x in part) or "-"
        o = ", ".join(x.split("#")[0] + (" DESC" if " DESC" in x else "") for x in order)
        windows.append(f"by [{p}] order [{o}]")
    return {
        "exchanges": kinds,
        "broadcasts": plan.count("BroadcastExchange"),
        "joins": re.findall(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin|BroadcastNestedLoopJoin)", plan),
        "windows": windows,
        "scans": [", ".join(re.findall(r"(\w+):", rs))
                  for rs in re.findall(r"ReadSchema: struct<([^>\]]*?)(?:>|\.\.\.)", plan)],
        "reused": reused,
        "python_udf": "BatchEvalPython" in plan or "ArrowEvalPython" in plan,
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    out = sys.argv[2] if len(sys.argv) > 2 else None
    extra = {"spark.ui.showConsoleProgress": "false"}
    spark = build_session("local[8]", 8, extra=extra)
    t = staged_tables(spark, sf_dir)
    lines = ["| report | columns read (per scan) | exchanges | joins | windows (partition / order) |",
             "| --- | --- | --- | --- | --- |"]
    for name, report in (REPORTS | fine_grain.REPORTS).items():
        df = report(t)
        df.write.format("noop").mode("overwrite").save()   # final adaptive plan
        s = summarise(df._jdf.queryExecution().executedPlan().toString())
        assert not s["python_udf"], name
        reused = f" (+{s['reused']} reused)" if s["reused"] else ""
        lines.append(f"| {name} | {'; '.join(s['scans'])} | {'; '.join(s['exchanges']) or '-'}{reused} "
                     f"| {', '.join(s['joins']) or '-'} | {'; '.join(s['windows']) or '-'} |")
    text = INTRODUCTION + "\n".join(lines) + "\n"
    if out:
        with open(out, "w") as f:
            f.write(text)
    print(text)


if __name__ == "__main__":
    main()
