"""Event streams over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeline.sources.events import small


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _who(kind: str, column: str):
    return F.array(F.struct(F.lit(kind).alias("type"), F.col(column).cast("string").alias("value")))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events`: value and k, a band of the value, whether it is over 50; by user."""
    return activity_of(_t(spark, sf_dir, "events"))


def activity_of(e: DataFrame) -> DataFrame:
    """The same from the rows of `events`, streamed ones too."""
    band = F.when(F.col("value") < 10, "low").when(F.col("value") < 50, "mid").otherwise("high")
    return e.select(
        F.col("event_id").cast("string").alias("uuid"), F.lit("activity").alias("source_id"), "event_type", "ts", _who("user", "user_id").alias("attributions"),
        F.struct("value", F.get_json_object("props", "$.k").cast("double").alias("k"), band.alias("band"), (F.col("value") > 50).alias("big")).alias("payload"),
    )


def line_shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem`; by supplier.  Its keys repeat, so uuid is no key."""
    x = _t(spark, sf_dir, "lineitem")
    return x.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("uuid"), F.lit("shipping").alias("source_id"), F.lit("line_shipped").alias("event_type"), F.col("l_shipdate").alias("ts"),
        _who("supplier", "l_suppkey").alias("attributions"),
        F.struct(
            F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("extendedprice"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
            F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"), (F.col("l_discount") > 0.05).alias("discounted"),
        ).alias("payload"),
    )


def order_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders`; by customer."""
    o = _t(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("uuid"), F.lit("sales").alias("source_id"), F.lit("order_placed").alias("event_type"), F.col("o_orderdate").alias("ts"),
        _who("customer", "o_custkey").alias("attributions"),
        F.struct(F.col("o_totalprice").alias("totalprice"), F.col("o_orderstatus").alias("orderstatus"), F.col("o_orderpriority").alias("orderpriority"), (F.col("o_totalprice") > 200000).alias("large")).alias("payload"),
    )


def orders_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with region, nation and market segment of the customer."""
    place = (
        _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    )
    c = _t(spark, sf_dir, "customer").join(small(place), F.col("c_nationkey") == F.col("n_nationkey"))
    o = _t(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("uuid"), F.lit("places").alias("source_id"), F.lit("order_placed").alias("event_type"), F.col("o_orderdate").alias("ts"),
        _who("customer", "o_custkey").alias("attributions"), F.struct(F.col("o_totalprice").alias("totalprice"), "region", "nation", F.col("c_mktsegment").alias("mktsegment")).alias("payload"),
    )
