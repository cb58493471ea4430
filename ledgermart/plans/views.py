"""SQL access by name (L10): tables and marts as temporary views.

The reference serves its marts as views (``vw_customer_360`` and so on);
here they are registered as temporary views over the lazy mart
DataFrames, so ``spark.sql("SELECT * FROM vw_credit_risk_portfolio WHERE
snapshot_date = ...")`` is planned by Catalyst exactly like the DataFrame
call - the date predicate still reaches the date dimension below the
aggregate.  Nothing is materialised.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermart.functions.metrics import avg_round, dec_sum
from ledgermart.operators.joins import join_dim
from ledgermart.plans import marts
from ledgermart.sources import schemas as S
from ledgermart.sources.load import register_views

# The view names of the mart layer.
MART_VIEWS = {
    "vw_customer_360": marts.customer_360,
    "vw_credit_risk_portfolio": marts.credit_risk_portfolio,
    "vw_financial_performance": marts.financial_performance,
    "vw_aml_compliance_dashboard": marts.aml_compliance,
    "vw_payments_analytics": marts.payments_analytics,
}


def _ifrs9_by_day(frames: Mapping[str, DataFrame]) -> DataFrame:
    """The IFRS 9 portfolio of every snapshot day."""
    loans = frames["fact_loan_daily_snapshot"].select("snapshot_date_sk", "ifrs9_stage", "dpd_bucket", "total_outstanding_rcy", "ecl_pd")
    x = join_dim(loans, frames["dim_date"], "snapshot_date_sk", "date_sk", {"full_date": "snapshot_date"}, name="dim_date")
    return x.groupBy("snapshot_date", "ifrs9_stage", "dpd_bucket").agg(
        F.count(F.lit(1)).alias("loans"), dec_sum("total_outstanding_rcy").alias("exposure_usd"), avg_round("ecl_pd", 4).alias("avg_pd"))


# name -> (parameters, the view that it reads, builder of that view, condition)
TABLE_FUNCTIONS = {
    "ifrs9_portfolio": ("on_date DATE", "vw_ifrs9_by_day", _ifrs9_by_day, "snapshot_date = ifrs9_portfolio.on_date"),
    "credit_risk": ("on_date DATE", "vw_credit_risk_portfolio", marts.credit_risk_portfolio, "snapshot_date = credit_risk.on_date"),
    "financial_performance": ("in_year INT", "vw_financial_performance", marts.financial_performance, "calendar_year = financial_performance.in_year"),
    "aml_alerts": ("severity STRING", "vw_aml_compliance_dashboard", marts.aml_compliance, "alert_severity = aml_alerts.severity"),
    "customer": ("customer BIGINT", "vw_customer_360", marts.customer_360, "customer_sk = customer.customer"),
}


def register_functions(spark: SparkSession, frames: Mapping[str, DataFrame], names: Iterable[str] | None = None) -> list[str]:
    """Marts with a parameter, as SQL table functions of the session:
    ``SELECT * FROM ifrs9_portfolio(DATE'2024-12-31')``.  A function is
    expanded into the query that calls it, so its condition moves below the
    mart's aggregate like any filter, and nothing is materialised."""
    done = []
    for name in names or TABLE_FUNCTIONS:
        parameters, view, build, condition = TABLE_FUNCTIONS[name]
        df = build(frames)
        df.createOrReplaceTempView(view)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) "
                  f"RETURN SELECT * FROM {view} WHERE {condition}")
        done.append(name)
    return done


def register_marts(spark: SparkSession, frames: Mapping[str, DataFrame]) -> list[str]:
    """Register every declared table present in ``frames`` and the five
    mart views; returns the registered names."""
    names = register_views(spark, frames, [t for t in S.TABLES])
    for view, build in MART_VIEWS.items():
        build(frames).createOrReplaceTempView(view)
        names.append(view)
    return names


def view_dictionary(spark: SparkSession, frames: Mapping[str, DataFrame]) -> DataFrame:
    """L11 for the marts: (view_name, view_comment, column_name, data_type, position)."""
    rows = [(view, S.VIEW_COMMENTS[view], f.name, f.dataType.simpleString(), i + 1)
            for view, build in MART_VIEWS.items() for i, f in enumerate(build(frames).schema.fields)]
    return spark.createDataFrame(rows, "view_name string, view_comment string, column_name string, data_type string, position int")
