"""Customer, price and scored views over the given tables.

The views bring TPC-H-like tables into the shape of a customer table and a
monthly price series. Only orders before the snapshot feed the features; the
label says whether a customer placed no order on or after it.

Money is summed in whole units (cents, or ten-thousandths for prices), so that
sums fit a 64-bit integer and are the same in whatever order tasks finish.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.config import Layout
from stayrate.sources.files import read_parquet

SNAPSHOT = date(2000, 1, 1)
# Line flags stand for the three price periods.
PERIOD_FLAGS = {"off_peak": "A", "peak": "N", "mid_peak": "R"}
LAYOUT = replace(
    Layout(),
    log_columns=("cons_12m", "cons_last_month", "cons_balance"),
    density_columns=("cons_12m", "cons_last_month", "cons_balance"),
)


# Declared types of the tables in use; the scan reads the columns a query asks for.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{folder}/{name}.parquet", SCHEMAS[name])


def snapshot() -> Column:
    return F.lit(SNAPSHOT.isoformat()).cast("timestamp_ntz")


def whole(column: str | Column, scale: int) -> Column:
    """``column`` in units of 1/scale, rounded to a whole number."""
    value = F.col(column) if isinstance(column, str) else column
    return F.floor(value * scale + 0.5)


def money(cents: Column) -> Column:
    """An amount in cents as a decimal amount."""
    return (cents / 100).cast("decimal(15,2)")


def past_orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").where(F.col("o_orderdate") < snapshot())


def month_of(column: str) -> Column:
    return F.trunc(F.col(column).cast("date"), "month")


def prices(spark: SparkSession, folder: str) -> DataFrame:
    """One sparse price row per order line: the flag says which period it is for.

    Prices are whole numbers of ten-thousandths.
    """
    orders = past_orders(spark, folder).select(
        "o_orderkey", F.col("o_custkey").alias("id"), month_of("o_orderdate").alias("price_date")
    )
    values = {
        "var": whole(F.col("l_extendedprice") / F.col("l_quantity"), 10000),
        "fix": whole(F.col("l_extendedprice") * F.col("l_tax"), 10000),
    }
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        *[
            F.when(F.col("l_returnflag") == flag, values[kind]).alias(LAYOUT.price_column(period, kind))
            for kind in LAYOUT.kinds
            for period, flag in PERIOD_FLAGS.items()
        ],
    )
    return orders.join(lines, "o_orderkey").drop("o_orderkey")


def _margins(spark: SparkSession, folder: str) -> DataFrame:
    """Discounted value in ten-thousandths, one row per order before any join."""
    value = whole("l_extendedprice", 100) * (100 - whole("l_discount", 100))
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.sum(value).alias("margin"))
    )


def clients(spark: SparkSession, folder: str, margin: bool = True) -> DataFrame:
    """One row per customer with an order before the snapshot."""
    at = snapshot()
    orders = table(spark, folder, "orders")
    before = F.col("o_orderdate") < at

    def within(months: int) -> Column:
        start = F.lit(SNAPSHOT.isoformat()).cast("timestamp_ntz") - F.expr(f"INTERVAL '{months}' MONTH")
        return before & (F.col("o_orderdate") >= start)

    per_order = [
        F.min(F.when(before, F.col("o_orderdate"))).cast("date").alias("date_activ"),
        F.max(F.when(before, F.col("o_orderdate"))).cast("date").alias("date_renewal"),
        F.max(F.when(before & (F.col("o_orderstatus") == "P"), F.col("o_orderdate")))
        .cast("date")
        .alias("date_modif_prod"),
        F.max(F.when(before, (F.col("o_orderpriority") == "1-URGENT").cast("int"))).alias("urgent"),
        money(F.sum(F.when(within(12), whole("o_totalprice", 100)))).alias("cons_12m"),
        money(F.sum(F.when(within(1), whole("o_totalprice", 100)))).alias("cons_last_month"),
        F.max(F.when(before, F.col("o_totalprice"))).alias("pow_max"),
        F.count_if(before).alias("nb_prod_act"),
        (F.count_if(~before) == 0).cast("int").alias("churn"),
    ]
    if margin:
        orders = orders.join(_margins(spark, folder), "o_orderkey", "left")
        total = F.sum(F.when(before, F.col("margin")))
        per_order.append((total / 10000).cast("decimal(18,4)").alias("net_margin"))
    history = orders.groupBy("o_custkey").agg(*per_order).where(F.col("nb_prod_act") > 0)

    customer = table(spark, folder, "customer")
    nation = table(spark, folder, "nation")
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        history, F.col("c_custkey") == F.col("o_custkey")
    )
    return joined.select(
        F.col("c_custkey").alias("id"),
        F.col("c_mktsegment").alias("channel_sales"),
        F.col("n_name").alias("origin_up"),
        F.col("c_acctbal").cast("decimal(15,2)").alias("cons_balance"),
        "date_activ",
        F.date_add("date_renewal", 365).alias("date_end"),
        "date_modif_prod",
        "date_renewal",
        F.when(F.col("urgent") == 1, "t").otherwise("f").alias("has_gas"),
        "cons_12m",
        "cons_last_month",
        "pow_max",
        "nb_prod_act",
        F.floor(F.datediff(F.lit(SNAPSHOT), "date_activ") / 365).cast("int").alias("num_years_antig"),
        *(["net_margin"] if margin else []),
        "churn",
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """A label and a score with ties for each labelled document; no model needed."""
    labels = table(spark, folder, "labels").select("doc_id", (1 - F.col("quality")).alias("label"))
    documents = table(spark, folder, "documents").select("doc_id", "n_chars")
    score = F.floor(F.lit(1000000.0) / (1000 + F.col("n_chars"))).cast("double") / 1000
    return labels.join(documents, "doc_id").select(
        F.col("doc_id").alias("id"),
        "label",
        score.alias("score"),
        (score >= 0.5).cast("int").alias("prediction"),
    )


def bills(spark: SparkSession, folder: str) -> DataFrame:
    """Bill in cents, quantity and unit price per customer and month before the snapshot."""
    orders = past_orders(spark, folder).select(
        "o_orderkey", F.col("o_custkey").alias("id"), month_of("o_orderdate").alias("price_date")
    )
    lines = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.sum(whole("l_extendedprice", 100)).alias("amount"),
            F.sum(whole("l_quantity", 1)).alias("quantity"),
        )
    )
    return (
        orders.join(lines, "o_orderkey")
        .groupBy("id", "price_date")
        .agg(F.sum("amount").alias("bill"), F.sum("quantity").alias("quantity"))
        .withColumn("unit_price", F.try_divide(F.col("bill") / 100, F.col("quantity")))
    )


def discounts(spark: SparkSession, folder: str) -> DataFrame:
    """Mean discount per customer over order lines before the snapshot."""
    orders = past_orders(spark, folder).select("o_orderkey", F.col("o_custkey").alias("id"))
    lines = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.sum(whole("l_discount", 100)).alias("discount"), F.count("l_discount").alias("lines"))
    )
    return (
        orders.join(lines, "o_orderkey")
        .groupBy("id")
        .agg((F.sum("discount") / F.sum("lines") / 100).alias("mean_discount"))
    )
