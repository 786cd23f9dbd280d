"""Bad values go to quarantine with column and reason; good rows are read on."""

import datetime as dt
import json

import pytest

from tests.fixtures import spark_sources
from tests.helpers import spark_rows
from tillroll.__main__ import main
from tillroll.plans.model import Model
from tillroll.plans.versions import read_table
from tillroll.registry import run_query
from tillroll.sources.canonical import SCHEMAS, load_canonical
from tillroll.sources.quarantine import TooManyRejected, current_split, split_canonical

#: table -> (schema as delivered, good rows, bad rows with the columns at fault)
DELIVERED = {
    "order_items": ("order_id string, user_id double, product_id long, status string, created_at string, sale_price double", [
        ("1", 2.0, 3, "Complete", "2021-01-05 10:00:00", 2.25), ("2", None, None, None, None, None)], [
        (("x1", 2.0, 3, "Complete", "2021-01-05 10:00:00", 1.0), ["order_id"]),             # no number
        ((None, 2.0, 3, "Complete", "2021-01-05 10:00:00", 1.0), ["order_id"]),             # no key
        (("3", 2.5, 3, "Complete", "2021-01-05 10:00:00", 1.0), ["user_id"]),               # half a user
        (("4", float("nan"), 3, "Complete", "2021-01-05 10:00:00", 1.0), ["user_id"]),
        (("5", 1.0, 3, "Complete", "yesterday", 1.0), ["created_at"]),
        (("6", 1.0, 3, "Complete", "2021-02-31 10:00:00", 2.004), ["created_at", "sale_price"]),
        (("7", 1.0, 3, "Complete", "2021-01-05 10:00:00", 1e15), ["sale_price"])]),          # beyond the type
    "products": ("id long, category string, brand string, name string, retail_price string", [
        (1, "c", "b", "n", "5.00"), (2, None, None, None, None)], [((3, "c", "b", "n", "five"), ["retail_price"])]),
    "users": ("id long, country string, gender string, age long", [(1, "Spain", "F", 30), (2, None, None, None)], [
        ((3, "Spain", "F", 3_000_000_000), ["age"]), ((None, "Spain", "F", 30), ["id"])]),
    "events": ("id decimal(20,1), user_id long, session_id string, event_type string, created_at timestamp", [
        ("1.0", 1, "s", "product", dt.datetime(2021, 1, 5, 10)), ("2.0", None, None, None, None)], [
        (("1.5", 1, "s", "product", None), ["id"])]),
}


def deliver(spark, folder, with_bad=True):
    from decimal import Decimal
    for name, (schema, good, bad) in DELIVERED.items():
        rows = good + [r for r, _ in bad if with_bad]
        if name == "events":
            rows = [(Decimal(r[0]), *r[1:]) for r in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def test_every_row_goes_one_way(spark, tmp_path):
    deliver(spark, str(tmp_path / "in"))
    split = split_canonical(spark, str(tmp_path / "in"), str(tmp_path / "out"), max_rejected=0.9)
    for name, (_, good, bad) in DELIVERED.items():
        df = getattr(split.sources, name)
        assert [f.dataType for f in df.schema] == [f.dataType for f in SCHEMAS[name]]
        own = split.rejected.filter(f"source = '{name}'").collect()
        assert split.counts[name] == (len(good) + len(bad), len(bad))
        assert df.count() == len(good) and len(own) == len(bad)
        want = sorted(sorted(columns) for _, columns in bad)
        assert sorted(sorted({x["column"] for x in r["faults"]}) for r in own) == want
        for r in own:
            assert set(json.loads(r["raw"])) == set(SCHEMAS[name].fieldNames()) and all(x["reason"] for x in r["faults"])
    raw = [json.loads(r["raw"]) for r in split.rejected.filter("source = 'order_items'").collect()]
    assert {"x1", "3"} <= {r.get("order_id") for r in raw} and any(r.get("sale_price") == 2.004 for r in raw)


def test_good_rows_read_as_the_strict_reader_reads_them(spark, tmp_path):
    deliver(spark, str(tmp_path / "clean"), with_bad=False)
    strict = load_canonical(spark, str(tmp_path / "clean"))
    split = split_canonical(spark, str(tmp_path / "clean"), str(tmp_path / "out"), max_rejected=0)
    for name in SCHEMAS:
        assert spark_rows(getattr(split.sources, name)) == spark_rows(getattr(strict, name))
    assert split.rejected.count() == 0
    deliver(spark, str(tmp_path / "bad"))
    with pytest.raises(Exception, match="changes when read as"):
        load_canonical(spark, str(tmp_path / "bad")).order_items.collect()


def test_too_many_rejected_rows_keep_the_old_split(spark, tmp_path):
    out = str(tmp_path / "out")
    deliver(spark, str(tmp_path / "in"), with_bad=False)
    split_canonical(spark, str(tmp_path / "in"), out)
    deliver(spark, str(tmp_path / "in2"))
    with pytest.raises(TooManyRejected, match="order_items: 7 of 9"):
        split_canonical(spark, str(tmp_path / "in2"), out, max_rejected=0.5)
    assert current_split(spark, out).counts["order_items"] == (2, 0)
    with pytest.raises(FileNotFoundError):
        current_split(spark, str(tmp_path / "nothing"))


def test_a_missing_column_is_an_error(spark, tmp_path):
    deliver(spark, str(tmp_path / "in"))
    spark.createDataFrame([(1, "Spain")], "id long, country string").write.mode("overwrite").parquet(str(tmp_path / "in" / "users"))
    with pytest.raises(ValueError, match="column gender is missing"):
        split_canonical(spark, str(tmp_path / "in"), str(tmp_path / "out"), max_rejected=1)


def test_refresh_with_quarantine(spark, tmp_path):
    src = spark_sources(spark)
    for name in SCHEMAS:
        df = getattr(src, name)
        if name == "order_items":
            df = df.withColumn("sale_price", df["sale_price"].cast("double"))
            df = df.unionByName(df.limit(1).selectExpr("order_id", "user_id", "product_id", "status", "created_at", "cast(2.004 as double) as sale_price"))
        df.coalesce(1).write.parquet(str(tmp_path / "in" / name))
    out = str(tmp_path / "out")
    args = ["refresh", "--canonical", str(tmp_path / "in"), "--out", out, "--keys", "agg_monthly_kpis", "--quarantine", str(tmp_path / "bad")]
    with pytest.raises(TooManyRejected):
        main([*args, "--max-rejected", "0.01"])
    assert main([*args, "--max-rejected", "0.1"]) == 0
    assert spark_rows(read_table(spark, f"{out}/agg_monthly_kpis")) == spark_rows(run_query("agg_monthly_kpis", Model(src)))
    assert current_split(spark, str(tmp_path / "bad")).rejected.count() == 1
