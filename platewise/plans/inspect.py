"""Plan inspection: capture ``explain`` text and summarise what matters at scale.

    python -m platewise.plans.inspect [--sf DIR] [key ...]
"""

from __future__ import annotations

import argparse
import contextlib
import io
import re

from pyspark.sql import DataFrame

from . import registry


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def scan_counts(df: DataFrame) -> dict[str, int]:
    """How many times each parquet folder is scanned by the final plan."""
    counts: dict[str, int] = {}
    for loc in re.findall(r"^Location: \S+ \[([^\]]+)\]", plan_text(df), re.M):
        name = loc.rstrip("/").split("/")[-1].removesuffix(".parquet")
        counts[name] = counts.get(name, 0) + 1
    return counts


def summarize(df: DataFrame) -> dict:
    text = plan_text(df)
    body = text.split("\n\n", 1)[-1]
    return {
        "exchanges": len(re.findall(r"^\(\d+\) Exchange", body, re.M)),
        "single_partition": body.count("SinglePartition"),
        "broadcasts": len(re.findall(r"^\(\d+\) BroadcastExchange", body, re.M)),
        "window_group_limit": "WindowGroupLimit" in text,
        "python": any(n in text for n in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas")),
        "pushed": sorted(set(re.findall(r"PushedFilters: \[([^\]]*)\]", body))),
    }


def markdown_table(spark, data: str, keys) -> str:
    """One row per query: the plan figures that matter at scale."""
    lines = ["| Query | Exchanges | Single-partition | Broadcasts | WindowGroupLimit | Scans per table |",
             "|---|---|---|---|---|---|"]
    for key in keys:
        df = registry.QUERIES[key](spark, data)
        s = summarize(df)
        scans = ", ".join(f"{t} {n}" for t, n in sorted(scan_counts(df).items())) or "checkpoints only"
        lines.append(f"| `{key}` | {s['exchanges']} | {s['single_partition']} | {s['broadcasts']} | "
                     f"{'yes' if s['window_group_limit'] else ''} | {scans} |")
    return "\n".join(lines)


def main(argv=None) -> None:
    from ..session import get_session
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--full", action="store_true")
    ap.add_argument("--markdown", action="store_true")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args(argv)
    spark = get_session(master="local[8]", shuffle_partitions=8)
    keys = args.keys or list(registry.QUERIES)
    if args.markdown:
        print(markdown_table(spark, args.sf, keys))
        return
    for key in keys:
        df = registry.QUERIES[key](spark, args.sf)
        if args.full:
            print(plan_text(df))
        print(key, summarize(df), flush=True)


if __name__ == "__main__":
    main()
