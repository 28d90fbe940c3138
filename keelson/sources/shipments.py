"""Shipments fact table (A1, A6) and its derivation from orders + lineitem.

The derivation is the FIXTURES.md statement written with the DataFrame API:
one shipment per order, lineitem pre-aggregated by order key before the join
so the only wide exchange is the order-key shuffle shared by both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.sources.tables import table

SHIPMENT_SCHEMA = T.StructType([
    T.StructField("Order_ID", T.LongType(), False),
    T.StructField("Order_Date", T.DateType(), True),
    T.StructField("Origin_City", T.StringType(), True),
    T.StructField("Destination_City", T.StringType(), True),
    T.StructField("Route_Type", T.StringType(), True),
    T.StructField("Transportation_Mode", T.StringType(), True),
    T.StructField("Product_Category", T.StringType(), True),
    T.StructField("Base_Lead_Time_Days", T.IntegerType(), True),
    T.StructField("Scheduled_Lead_Time_Days", T.IntegerType(), True),
    T.StructField("Delay_Days", T.IntegerType(), True),
    T.StructField("Delivery_Status", T.StringType(), True),
    T.StructField("Geopolitical_Risk_Index", T.DoubleType(), True),
    T.StructField("Weather_Severity_Index", T.DoubleType(), True),
    T.StructField("Inflation_Rate_Pct", T.DoubleType(), True),
    T.StructField("Shipping_Cost_USD", T.DoubleType(), True),
    T.StructField("Order_Weight_Kg", T.LongType(), True),
])

# Fixed values of the shipments fixture: lane -> origin / destination / route type,
# and category index -> product category.
LANE_ORIGINS = ["Shenzhen, CN", "Shanghai, CN", "Hamburg, DE", "Tokyo, JP", "Mumbai, IN", "Santos, BR"]
LANE_DESTINATIONS = ["Rotterdam, NL", "Los Angeles, US", "New York, US", "Singapore, SG",
                     "Felixstowe, UK", "Shanghai, CN"]
LANE_ROUTE_TYPES = ["Suez", "Pacific", "Atlantic", "Intra-Asia", "Suez", "Commodity"]
CATEGORIES = ["Auto Parts", "Consumer Electronics", "Perishable Foods", "Pharmaceuticals",
              "Raw Materials", "Semiconductors", "Textiles"]


def _pick(values: list[str], idx: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[idx]


def derive_shipments(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    li = lineitem.groupBy("l_orderkey").agg(
        F.sum("l_quantity").cast("bigint").alias("qty"),
        F.min("l_suppkey").alias("sk"),
        F.min("l_partkey").alias("pk"),
        F.sum(F.round(F.col("l_extendedprice") * F.lit(1e2)).cast("bigint")).alias("cents"),
    )
    b = (orders.select("o_orderkey", "o_orderdate", "o_custkey")
         .join(li, F.col("o_orderkey") == F.col("l_orderkey"))
         .select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("dt"),
                 F.col("o_custkey").alias("ck"), "qty", "cents",
                 (F.col("sk") % 6).cast("int").alias("lane"),
                 ((F.col("pk") % 5) == 0).alias("air"),
                 ((F.col("pk") + F.col("sk")) % 7).cast("int").alias("cat")))
    lane, air, cat, i = F.col("lane"), F.col("air"), F.col("cat"), F.col("id")
    base_lead = F.when(air, 2 + lane).otherwise(12 + 3 * lane)
    pct = (F.when(cat.isin(0, 3), 45).when(cat.isin(1, 5), 20).otherwise(5)
           + F.when(lane.isin(0, 4), 25).otherwise(0) + F.when(air, -15).otherwise(0))
    late = ((i * 37) % 100) < pct
    return b.select(
        i.alias("Order_ID"),
        F.col("dt").alias("Order_Date"),
        _pick(LANE_ORIGINS, lane).alias("Origin_City"),
        _pick(LANE_DESTINATIONS, lane).alias("Destination_City"),
        _pick(LANE_ROUTE_TYPES, lane).alias("Route_Type"),
        F.when(air, "Air").otherwise("Sea").alias("Transportation_Mode"),
        _pick(CATEGORIES, cat).alias("Product_Category"),
        base_lead.cast("int").alias("Base_Lead_Time_Days"),
        (base_lead + 1 + i % 3).cast("int").alias("Scheduled_Lead_Time_Days"),
        F.when(late, 1 + i % 9).otherwise(i % 3 - 2).cast("int").alias("Delay_Days"),
        F.when(late, F.when(i % 2 == 0, "Late").otherwise(" late "))
         .when(i % 50 == 7, F.lit(None).cast("string")).otherwise("On Time").alias("Delivery_Status"),
        ((F.col("ck") % 101).cast("double") / F.lit(1e2)).alias("Geopolitical_Risk_Index"),
        (((i * 7) % 101).cast("double") / F.lit(1e1)).alias("Weather_Severity_Index"),
        ((F.col("qty") % 91 - 10).cast("double") / F.lit(1e1)).alias("Inflation_Rate_Pct"),
        (F.col("cents").cast("double") / F.when(air, F.lit(1e3)).otherwise(F.lit(5e3))).alias("Shipping_Cost_USD"),
        F.when(i % 97 == 0, F.lit(0).cast("bigint")).otherwise(F.col("qty") * 25).alias("Order_Weight_Kg"),
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_shipments(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


def read_shipments(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A1: scan a landed shipments file with the declared schema (no inference)."""
    reader = spark.read.schema(SHIPMENT_SCHEMA)
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    return reader.format(fmt).load(path)


def export_scored(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Export of (filtered) scored shipments, all columns, with header for CSV.

    Parquet output is partitioned by ``Order_YearMonth`` so later month filters prune files.
    """
    writer = df.write.mode(mode)
    if fmt == "csv":
        # the writer trims blanks by default; the export keeps texts as they are
        writer.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        writer.partitionBy("Order_YearMonth").parquet(path)


def replace_months(df: DataFrame, path: str, months: list[str]) -> None:
    """The given months of a month-partitioned export are written anew from ``df``; the files of others stay as they are."""
    df.where(F.col("Order_YearMonth").isin(months)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("Order_YearMonth").parquet(path)


def read_months(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """A month-partitioned export, only the folders of ``months`` if given."""
    rows = spark.read.option("basePath", path).parquet(path).withColumn("Order_YearMonth", F.col("Order_YearMonth").cast("string"))
    return rows if months is None else rows.where(F.col("Order_YearMonth").isin(months))
