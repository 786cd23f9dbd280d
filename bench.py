"""Benchmark: prints one JSON line with wall times of the result tables.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [--headline] [--e2e] [--warm]

Default flow mirrors the layered model: ``layer`` times the one-off materialisation of
the canonical inputs (the source mapping's joins), ``shared`` the tables other tables read
(monthly KPIs, category base, ...), then every registered table (or the headline subset)
is timed
over the written layer, executed fully with the no-op sink (nothing is collected).
``--e2e`` instead times every table from the raw generated tables.

Keys served from maintained state replay a history of batches; they are timed under ``maintained``
and are not part of ``value``, which stays the refresh of the result tables. ``refresh`` is the wall time
of the same result tables written by ``plans.refresh``, several at a time; neither is it part of it.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # page 1-3 production tables
    "final_category_performance", "agg_funnel_metrics", "agg_monthly_kpis",
    "agg_monthly_kpis_enriched", "agg_yearly_kpis", "agg_yearly_kpis_enriched",
    # heavier archive tables: many-to-many segments, wide distincts, three-way joins
    "country_segment_metrics", "category_conversion_global", "agg_country_kpis",
    "aggregate_category_kpis", "agg_daily_funnel", "country_cancellation_metrics",
    "revenue_variance_by_country", "category_user_skew", "product_performance_summary",
    "brand_performance_summary", "country_month_kpis", "final_country_performance_v2",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--headline", action="store_true",
                    help="time only the headline tables instead of every registered one")
    ap.add_argument("--e2e", action="store_true", help="time from the raw tables")
    ap.add_argument("--warm", action="store_true",
                    help="also run every table a second time and report those times")
    ap.add_argument("--no-shared", action="store_true",
                    help="do not materialise the shared result tables first")
    args = ap.parse_args()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")

    from tillroll.plans.model import Model
    from tillroll.plans.warehouse import default_root, materialize, materialize_shared
    from tillroll.plans.refresh import refresh_results
    from tillroll.registry import MAINTAINED, QUERIES, run_query
    from tillroll.session import build_session, checkpoint_dir

    spark = build_session("tillroll-bench", master=f"local[{cpus}]",
                          shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", int(cpus) * 2)),
                          extra={"spark.driver.memory": "16g"})
    keys = HEADLINE if args.headline else [k for k in QUERIES if k not in MAINTAINED]
    raw = Model.from_testdata(spark, sf_dir)
    times: dict[str, float] = {}
    if args.e2e:
        model = raw
    else:
        # this bench builds a local session, where a local folder is as good as a shared one
        root = os.environ.get("BENCH_OUT_DIR") or (
            default_root(spark) if checkpoint_dir(spark) else tempfile.mkdtemp(prefix="tillroll-bench-"))
        t0 = time.perf_counter()
        model = materialize(raw, root)
        times["layer"] = round(time.perf_counter() - t0, 3)
        if not args.no_shared:
            t0 = time.perf_counter()
            materialize_shared(model, root)
            times["shared"] = round(time.perf_counter() - t0, 3)
    # one untimed warm-up so JIT and class loading are not charged to the first table
    run(run_query("dim_user", model))
    for key in keys:
        t0 = time.perf_counter()
        run(run_query(key, model))
        times[key] = round(time.perf_counter() - t0, 3)
    warm: dict[str, float] = {}
    if args.warm:
        for key in keys:
            t0 = time.perf_counter()
            run(run_query(key, model))
            warm[key] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    extra: dict[str, float] = {}
    if not args.headline and not args.e2e:
        for key in MAINTAINED:
            t0 = time.perf_counter()
            run(run_query(key, model))
            extra[key] = round(time.perf_counter() - t0, 3)
        t0 = time.perf_counter()
        refresh_results(model, root, keys, workers=int(cpus)).paths()
        extra["refresh"] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_wall_time" + ("_e2e" if args.e2e else ""),
                      "value": total, "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      **({"maintained": extra} if extra else {}),
                      "cpus": int(cpus), "mode": "e2e" if args.e2e else "layer",
                      **({"warm": warm, "warm_total": round(sum(warm.values()), 3)}
                         if warm else {})}))
    spark.stop()


if __name__ == "__main__":
    main()
