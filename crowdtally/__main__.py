"""Command line: list the registered queries, run one, or print its plan.

    python -m crowdtally list
    python -m crowdtally run KEY [SF_DIR] [--rows N]
    python -m crowdtally explain KEY [SF_DIR]
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="crowdtally")
    ap.add_argument("command", choices=["list", "run", "explain"])
    ap.add_argument("key", nargs="?")
    ap.add_argument("sf_dir", nargs="?", default="/root/testdata/sf0.01")
    ap.add_argument("--rows", type=int, default=20)
    args = ap.parse_args(argv)

    from .plans.registry import all_oracles, all_queries

    queries = all_queries()
    if args.command == "list":
        oracles = all_oracles()
        for k in sorted(queries):
            print(f"{k}{'' if k in oracles else '  (no oracle)'}")
        return 0
    if args.key not in queries:
        print(f"unknown key {args.key!r}; see `python -m crowdtally list`", file=sys.stderr)
        return 2

    from .session import get_spark

    spark = get_spark("crowdtally-cli")
    df = queries[args.key](spark, args.sf_dir)
    if args.command == "explain":
        df.explain("formatted")
    else:
        df.show(args.rows, truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main())
