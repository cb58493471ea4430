"""Stored runs: keys from positions, pruning by manifest and Bloom filters,
planner statistics, mergeable sketches."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgermart.plans import marts, warehouse
from ledgermart.sources import load, stored
from ledgermart.sources import schemas as S


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def run(spark, frames, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("dw"))
    sub = {t: frames[t] for t in ("dim_date", "dim_customer", "dim_product", "fact_transaction", "fact_loan_daily_snapshot", "fact_payment_order")}
    out = warehouse.load_warehouse(sub, root, 1996, 1999, minimums=dict.fromkeys(sub, 0), load_date="2024-01-01")
    return root, f"{root}/{out['run_id']}", sub, out


def test_generated_keys_come_from_positions(spark, run):
    root, folder, sub, out = run
    for t in ("fact_transaction", "fact_loan_daily_snapshot"):
        key = S.key_column(t)
        assert key not in sub[t].columns
        df = load.read_run(spark, folder, t)
        n = sub[t].count()
        # dense, unique, and the same on every read, whatever is selected with them
        assert tuple(df.agg(F.min(key), F.max(key), F.count_distinct(key)).first()) == (1, n, n)
        one = {r[0]: tuple(r)[1:] for r in df.select(key, "account_sk", "customer_sk").collect()}
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        try:
            two = {r[0]: tuple(r)[1:] for r in load.read_run(spark, folder, t).select(key, "account_sk", "customer_sk").collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert one == two
        assert df.schema[key].dataType == S.spark_type(next(c.dtype for c in S.columns(t) if c.name == key))
        # a query without the key does not pay for it
        assert "Join" not in plan_of(df.groupBy("customer_sk").count()) and "Join" in plan_of(df.select(key))
    marks = {r["table_name"]: r["next_key"] for r in out["next_keys"].collect()}
    assert marks["fact_transaction"] == sub["fact_transaction"].count() + 1


def test_a_key_that_the_source_has_is_kept(spark, run):
    root, folder, sub, _ = run
    assert not stored.read_manifest(spark, folder, "dim_customer").filter("keyed").count()
    got = load.read_run(spark, folder, "dim_customer")
    assert {r[0] for r in got.select("customer_sk").collect()} == {r[0] for r in sub["dim_customer"].select("customer_sk").collect()}


def test_keys_of_an_empty_table(spark, frames, tmp_path):
    sub = {"fact_transaction": frames["fact_transaction"].filter("false"), "dim_date": frames["dim_date"]}
    out = warehouse.load_warehouse(sub, str(tmp_path), 1996, 1999, minimums=dict.fromkeys(sub, 0))
    assert out["rows"]["fact_transaction"] == 0
    assert load.read_current(spark, str(tmp_path), "fact_transaction").count() == 0


def test_manifest_chooses_files(spark, run):
    _, folder, sub, _ = run
    manifest = stored.read_manifest(spark, folder, "fact_transaction")
    assert manifest.agg(F.sum("rows")).first()[0] == sub["fact_transaction"].count()
    ranges = {"booking_date_sk": (19970601, 19970731)}
    some, every = stored.files_in_range(manifest, ranges), manifest.count()
    assert 0 < len(some) < every
    got = stored.read_pruned(spark, folder, "fact_transaction", ranges)
    assert len(got.inputFiles()) == len(some)
    whole = spark.read.parquet(f"{folder}/fact_transaction")
    want = whole.filter(F.col("booking_date_sk").between(19970601, 19970731))
    assert got.count() == want.count() > 0
    assert got.select("account_sk", "booking_date_sk", "booking_year").exceptAll(
        want.select("account_sk", "booking_date_sk", "booking_year")).count() == 0
    assert stored.read_pruned(spark, folder, "fact_transaction", {"booking_date_sk": (20990101, 20990102)}).count() == 0
    # a column that is not recorded rules out nothing
    assert stored.read_pruned(spark, folder, "fact_transaction", {"product_sk": (1, 5)}).count() == whole.filter("product_sk between 1 and 5").count()


def test_bloom_filters_skip_row_groups(spark, tmp_path):
    """Keys scattered over all files: minima and maxima rule out nothing,
    Bloom filters leave the files that hold the value."""
    df = spark.range(0, 60_000, 1, 6).select(F.xxhash64("id").alias("customer_sk"), F.col("id").alias("v"), F.spark_partition_id().alias("p"))
    wanted = df.filter("v = 31").first()["customer_sk"]
    read = {}
    for name, options in (("plain", {}), ("bloom", stored.bloom_options(["customer_sk"]))):
        path = str(tmp_path / name)
        df.drop("p").write.options(**options, **{"parquet.enable.dictionary": "false"}).parquet(path)
        found = spark.read.parquet(path).filter(F.col("customer_sk") == wanted)
        assert found.collect() == [(wanted, 31)]
        read[name] = _scan_rows(found._jdf.queryExecution().executedPlan())
    assert read["plain"] == 60_000 and read["bloom"] == 10_000


def _scan_rows(plan):
    """Rows that the scans of a plan have put out."""
    total = 0
    if plan.nodeName().startswith("Scan"):
        total += plan.metrics().apply("numOutputRows").value()
    children = plan.children()
    return total + sum(_scan_rows(children.apply(i)) for i in range(children.size()))


def test_statistics_change_the_plan_of_a_mart(spark, run):
    """Without statistics the planner takes a partitioned fact for huge and
    sends the customers to it; with them it knows how few loans one day has,
    and sends these to the customers."""
    _, folder, sub, _ = run
    names = stored.register_tables(spark, folder, ["dim_date", "dim_customer", "dim_product", "fact_loan_daily_snapshot"], "analysed")
    assert spark.table("analysed.dim_customer").schema["is_current_record"].dataType.typeName() == "boolean"
    day = spark.table("analysed.fact_loan_daily_snapshot").agg(F.max("snapshot_date_sk")).first()[0]

    def mart():
        f = {t: spark.table(f"analysed.{t}") for t in names}
        f["dim_geography"] = sub_geography(spark)
        f["dim_date"] = f["dim_date"].filter(F.col("date_sk") == day)
        return marts.credit_risk_portfolio(f)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    try:
        before, rows = plan_of(mart()), sorted(map(str, mart().collect()))
        stored.analyze_tables(spark, names, "analysed")
        for k, v in stored.COST_BASED.items():
            spark.conf.set(k, v)
        after = plan_of(mart())
        assert sorted(map(str, mart().collect())) == rows and rows
    finally:
        for k in stored.COST_BASED:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    assert "BuildLeft" in after and "BuildLeft" not in before
    described = {r["info_name"]: r["info_value"] for r in spark.sql("DESCRIBE EXTENDED analysed.dim_customer customer_sk").collect()}
    assert int(described["distinct_count"]) > 0 and "num_of_bins" in described["histogram"]


def sub_geography(spark):
    from ledgermart.sources.testviews import bank_frames
    return bank_frames(spark, "/root/testdata/sf0.001")["dim_geography"]


def test_sketches_merge_to_the_whole(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(20), rng.randrange(5000), rng.choice([None, *map(float, range(-900, 900))]), rng.choice(["x", None, "é", ""]),
             dt.date(2024, 1, 1 + rng.randrange(28))) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "day int, k bigint, v double, s string, d date")
    parts = stored.sketch_statistics(df, F.col("day"), ["k", "v", "s", "d"])
    got = {r["column_name"]: r for r in stored.merge_statistics(parts, [0.1, 0.5, 0.9]).collect()}
    for i, c in enumerate("kvsd", 1):
        cells = [r[i] for r in rows]
        have = [x for x in cells if x is not None]
        assert (got[c]["row_count"], got[c]["null_count"]) == (len(cells), len(cells) - len(have))
        assert abs(got[c]["distinct_count"] - len(set(have))) <= max(1, 0.05 * len(set(have)))
        if c in "kv":
            have.sort()
            assert float(got[c]["min_value"]) == have[0] and float(got[c]["max_value"]) == have[-1]
            for q, x in zip((0.1, 0.5, 0.9), got[c]["quantiles"]):
                low, high = (have[max(0, min(len(have) - 1, round((q + e) * len(have))))] for e in (-0.02, 0.02))
                assert low <= x <= high
        else:
            assert got[c]["quantiles"] is None and (got[c]["min_value"], got[c]["max_value"]) == (str(min(have)), str(max(have)))
    # a new day: only that day is aggregated, the stored parts are merged as they are
    old, new = stored.sketch_statistics(df.filter("day < 19"), F.col("day"), ["k"]), stored.sketch_statistics(df.filter("day = 19"), F.col("day"), ["k"])
    again = stored.merge_statistics(old.unionByName(new)).first()
    assert again["row_count"] == 20_000 and math.isclose(again["distinct_count"], got["k"]["distinct_count"], rel_tol=0.02)
    empty = stored.merge_statistics(stored.sketch_statistics(df.filter("false"), F.col("day"), ["k"]))
    assert empty.count() == 0
