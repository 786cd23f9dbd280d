"""Command line: ``python -m tillroll`` (or ``spark-submit -m``-style launchers).

    refresh  --canonical PATH | --testdata DIR   --out ROOT [--keys k1,k2] [--policy valid]
             [--database analytics] [--workers 8] [--quarantine ROOT [--max-rejected 0.01]]
             materialise the layer and the shared tables, then write every result table
             (or the listed ones) to ROOT/<key> - the full dashboard rebuild.
    show     KEY (--canonical PATH | --testdata DIR) [-n 20]
             print one result table.
    list     print the registered keys.
"""

from __future__ import annotations

import argparse
import sys

from tillroll.functions.metrics import StatusPolicy


def _model(spark, args):
    from tillroll.plans.model import Model
    from tillroll.sources import load_canonical, load_testdata
    policy = StatusPolicy(args.policy)
    if args.canonical and getattr(args, "quarantine", None):
        from tillroll.sources.quarantine import split_canonical
        split = split_canonical(spark, args.canonical, args.quarantine, args.max_rejected)
        for name, (rows, rejected) in split.counts.items():
            print(f"{name}: {rejected} of {rows} rows rejected")
        return Model(split.sources, status_policy=policy)
    if args.canonical:
        return Model(load_canonical(spark, args.canonical), status_policy=policy)
    return Model(load_testdata(spark, args.testdata), status_policy=policy)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="tillroll")
    sub = ap.add_subparsers(dest="cmd", required=True)
    for name in ("refresh", "show"):
        p = sub.add_parser(name)
        src = p.add_mutually_exclusive_group(required=True)
        src.add_argument("--canonical", help="folder with order_items/products/users/events")
        src.add_argument("--testdata", help="folder with the generated <table>.parquet files")
        p.add_argument("--policy", default=StatusPolicy.VALID.value,
                       choices=[s.value for s in StatusPolicy],
                       help="status policy of fact_order_items")
        p.add_argument("--master", help="Spark master (default: from the launcher)")
        if name == "refresh":
            p.add_argument("--out", required=True, help="output root (shared storage)")
            p.add_argument("--keys", help="comma-separated keys (default: all)")
            p.add_argument("--database", help="also register each table as <database>.<key>")
            p.add_argument("--quarantine", help="folder for rows with bad values (with --canonical); "
                           "without it one such value fails the job")
            p.add_argument("--max-rejected", type=float, default=0.01, help="largest share of a table's rows")
            p.add_argument("--workers", type=int, default=8, help="tables written at a time")
        else:
            p.add_argument("key")
            p.add_argument("-n", type=int, default=20)
    sub.add_parser("list")
    args = ap.parse_args(argv)

    from tillroll.registry import QUERIES, run_query
    if args.cmd == "list":
        print("\n".join(QUERIES))
        return 0

    from tillroll.plans.refresh import refresh_layer, refresh_results
    from tillroll.session import build_session
    spark = build_session("tillroll-" + args.cmd, master=args.master)
    model = _model(spark, args)
    if args.cmd == "show":
        run_query(args.key, model).show(args.n, truncate=False)
        return 0
    keys = args.keys.split(",") if args.keys else None
    unknown = [k for k in keys or [] if k not in QUERIES]
    if unknown:
        ap.error(f"unknown keys: {unknown}")
    out = args.out.rstrip("/")
    model = refresh_layer(model, f"{out}/_layer").model
    done = refresh_results(model, out, keys, database=args.database, workers=args.workers)
    print(f"wrote {len(done.written)} tables under {args.out}")
    for node, why in done.failed.items():
        print(f"failed: {node}: {why}", file=sys.stderr)
    for node, lost in done.skipped.items():
        print(f"not run: {node}, which reads {lost}", file=sys.stderr)
    return 1 if done.failed else 0


if __name__ == "__main__":
    sys.exit(main())
