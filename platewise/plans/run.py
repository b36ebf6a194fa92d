"""Write registered reports as parquet (the sink: results leave as files).

    python -m platewise.plans.run --data DIR --out DIR [--layout canonical] [key ...]

``--data`` is a canonical layout, or with ``--layout test`` the driver's test tables; each report is
written to ``OUT/<key>`` (overwritten), computed on the cluster and written by
the executors, never collected to the driver.
"""

from __future__ import annotations

import argparse

from . import registry


def write_reports(spark, data: str, out: str, keys=None, fmt: str = "parquet", layout: str = "canonical") -> list[str]:
    written, queries = [], registry.queries(layout)
    for key in keys or list(queries):
        path = f"{out}/{key}"
        queries[key](spark, data).write.mode("overwrite").format(fmt).save(path)
        written.append(path)
    return written


def main(argv=None) -> None:
    from ..session import get_session
    ap = argparse.ArgumentParser()
    ap.add_argument("--data", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--format", default="parquet")
    ap.add_argument("--layout", default="canonical", choices=["canonical", "test"])
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args(argv)
    spark = get_session()
    for path in write_reports(spark, args.data, args.out, args.keys or None, args.format, args.layout):
        print(path)


if __name__ == "__main__":
    main()
