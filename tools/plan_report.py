"""Write PLANS.md: the final (post-AQE) physical plan shape of every query.

Usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from labelforge.plans.queries import QUERIES  # noqa: E402
from labelforge.session import build_session  # noqa: E402

SKIP = {"train_classifier", "experiment"}  # driver-side round loop; see README


def scan_nodes(formatted: str):
    """(kind, details) of every scan node in a formatted explain string."""
    sections = re.split(r"\n(?=\(\d+\) )", formatted)
    out = []
    for sec in sections:
        head = sec.split("\n", 1)[0]
        if re.match(r"\(\d+\) Scan parquet", head) or re.match(r"\(\d+\) Scan ExistingRDD", head):
            out.append((head, sec))
    return out


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    print("# Physical plans\n")
    print(f"Final adaptive plans of every registered query at `{os.path.basename(sf)}` on local[8], "
          "8 shuffle partitions (written by `tools/plan_report.py`).  `scans` = parquet scans of the "
          "driver tables; `staged` = reads of tables written by the query itself (bucketed stages, "
          "checkpoints); `exchanges` = shuffles; `bhj` / `smj` = broadcast / sort-merge joins.\n")
    print("| query | scans | staged | exchanges | bhj | smj | windows | python | pushed filters / read schema |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for name in QUERIES:
        if name in SKIP:
            continue
        df = QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        # re-plan after execution so the adaptive plan is final
        p = df._jdf.queryExecution().executedPlan().toString()
        fp = df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        nodes = scan_nodes(fp)
        scans = sum(1 for head, sec in nodes if "Scan parquet" in head and sf in sec)
        staged = len(nodes) - scans
        ex = len(re.findall(r"(?<!Reused)Exchange (hashpartitioning|SinglePartition|rangepartitioning|RoundRobin)", p))
        pushed = sorted(set(re.findall(r"PushedFilters: (\[[^\]]*\])", fp)) - {"[]"})
        schema = sorted(set(re.findall(r"ReadSchema: (struct<[^\n]*>)", fp)))
        info = "; ".join(pushed + [s if len(s) < 90 else s[:87] + "...>" for s in schema])
        print(f"| {name} | {scans} | {staged} | {ex} | {p.count('BroadcastHashJoin')} | "
              f"{p.count('SortMergeJoin')} | {p.count('Window ')} | "
              f"{p.count('MapInPandas') + p.count('ArrowEvalPython')} | {info.replace('|', '/')} |")


if __name__ == "__main__":
    main()
