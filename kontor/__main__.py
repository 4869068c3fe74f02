"""Command line: list the registered queries, or run one over a directory of tables.

    python -m kontor list
    python -m kontor run trial_balance --sf-dir /root/testdata/sf0.01 --out /path/to/result
    python -m kontor run ar_aging --sf-dir /root/testdata/sf0.01 --show 20
    python -m kontor explain fifo_cogs --sf-dir /root/testdata/sf0.01

Results are written as Parquet (``--out``) or previewed (``--show``); nothing
is collected to the driver.
"""

from __future__ import annotations

import argparse
import sys


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="kontor")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    for name in ("run", "explain"):
        p = sub.add_parser(name)
        p.add_argument("query")
        p.add_argument("--sf-dir", default="/root/testdata/sf0.01")
        p.add_argument("--master", default="local[8]")
        if name == "run":
            p.add_argument("--out")
            p.add_argument("--show", type=int, default=0)
    args = ap.parse_args(argv)

    from kontor.plans import registry
    queries = registry.queries()
    if args.cmd == "list":
        oracles = registry.oracle_sql()
        for q in sorted(queries):
            print(q, "(oracle)" if q in oracles else "")
        return 0
    if args.query not in queries:
        print(f"unknown query {args.query!r}; try `python -m kontor list`", file=sys.stderr)
        return 2
    from kontor.session import build_session
    spark = build_session(master=args.master)
    df = queries[args.query](spark, args.sf_dir)
    if args.cmd == "explain":
        df.explain("formatted")
        return 0
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    if args.show:
        df.show(args.show, truncate=False)
    if not args.out and not args.show:
        df.write.format("noop").mode("overwrite").save()
    return 0


if __name__ == "__main__":
    sys.exit(main())
