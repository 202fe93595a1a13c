"""The sample star schema seen as a purchase log, offers and histories.

Each sale line is a purchase by the order's customer; returned lines count
negatively, and every 50th order is in the log twice.  Some orders lack the
shopper, dept, brand or date, some are of another dept than their category's.
The 35 best selling products are on offer, one of them twice, together with
one never sold.  Some shoppers of the history have an unknown offer, some have
no purchases.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.operators.joins import fits_broadcast
from tillroll.session import stage
from tillroll.sources.schemas import ITEMS


IDLE_FROM = 10_000_000


class RetailTables(NamedTuple):
    transactions: DataFrame
    offers: DataFrame
    train_history: DataFrame
    test_history: DataFrame


_made: dict[tuple[str, str], RetailTables] = {}


def sample_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    # What a purchase takes from the other tables is joined and worked out there, so
    # that the lines, by far the most rows, are shuffled once by order and once by part.
    orders = table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.select("o_orderkey", "o_custkey", "c_nationkey")
    word = F.split_part("p_name", F.lit(" "), F.lit(2))
    parts = table("part").select(
        "p_partkey", "p_type", "p_brand", F.concat("p_type", F.lit("/"), word).alias("_category")
    )
    suppliers = table("supplier").select("s_suppkey", "s_nationkey")
    # One small file is one task; a large table has its own splits.
    lines, slots = table("lineitem"), spark.sparkContext.defaultParallelism
    if lines.rdd.getNumPartitions() < slots:
        lines = lines.repartition(slots, "l_orderkey")
    if fits_broadcast(suppliers):
        suppliers = F.broadcast(suppliers)
    sales = (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
    )
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    twice = F.array_repeat(F.lit(0), F.when(F.col("l_orderkey") % 50 == 0, 2).otherwise(1))

    def every(n: int) -> Column:
        return F.col("l_orderkey") % n == 0

    return sales.select(
        F.when(~every(101), F.col("o_custkey")).alias("id"),
        (F.lit(100) + F.col("c_nationkey")).alias("chain"),
        F.when(every(71), "Mixed").when(~every(89), F.col("p_type")).alias("dept"),
        F.col("_category").alias("category"),
        F.col("s_nationkey").alias("company"),
        F.when(~every(97), F.col("p_brand")).alias("brand"),
        F.when(~every(83), F.to_date("l_shipdate")).alias("date"),
        F.col("l_linenumber").cast("double").alias("productsize"),
        F.lit("EA").alias("productmeasure"),
        (sign * F.col("l_quantity")).cast("int").alias("purchasequantity"),
        (sign * F.col("l_extendedprice")).cast("decimal(12,2)").alias("purchaseamount"),
        F.explode(twice).alias("_copy"),
    ).drop("_copy")


def sample_offers(transactions: DataFrame) -> DataFrame:
    sales = transactions.where("brand is not null").groupBy(*ITEMS).agg(F.count("*").alias("n"))
    best = sales.orderBy(F.desc("n"), *ITEMS).limit(35)
    rank = Window.orderBy(F.desc("n"), *ITEMS)  # over these 35 rows only
    best = best.withColumn("offer", F.row_number().over(rank).cast("bigint"))

    def offer(rows: DataFrame, **columns) -> DataFrame:
        rows = rows.withColumn("quantity", F.lit(1)).withColumns(columns)
        return rows.select(
            "offer",
            "category",
            "quantity",
            "company",
            F.col("offervalue").cast("decimal(6,2)").alias("offervalue"),
            "brand",
        )

    own_value = F.lit(0.75) + (F.col("offer") % 4) * F.lit(0.25)
    first, second = best.where("offer = 1"), best.where("offer = 2")
    repeated = {"offer": F.lit(36).cast("bigint"), "offervalue": F.lit(3.00)}
    unsold = {
        "offer": F.lit(37).cast("bigint"),
        "offervalue": F.lit(1.50),
        "company": F.lit(999),
        "brand": F.lit("Brand#99"),
    }
    return (
        offer(best, offervalue=own_value)
        .unionByName(offer(first, **repeated))
        .unionByName(offer(second, **unsold))
    )


def sample_history(customers: DataFrame, transactions: DataFrame, offers: DataFrame) -> DataFrame:
    own = (
        transactions.select("id", *ITEMS)
        .join(F.broadcast(offers.select(*ITEMS, "offer")), [*ITEMS])  # 37 offers
        .groupBy("id")
        .agg(F.min("offer").alias("own_offer"))
    )
    key = F.col("c_custkey")
    known = customers.join(own, key == F.col("id"), "left").drop("id")
    # Further shoppers, none of whom has bought anything.
    idle = known.where(key % 37 == 0).withColumn("c_custkey", key + IDLE_FROM)
    return known.unionByName(idle).select(
        key.alias("id"),
        (F.lit(100) + F.col("c_nationkey")).alias("chain"),
        F.when(key % 29 == 0, 99)
        .when(key % 11 == 0, 37)
        .when(key % 13 == 0, 36)
        .otherwise(F.coalesce("own_offer", key % 35 + 1))
        .alias("offer"),
        F.col("c_nationkey").alias("market"),
        (key % 5).cast("int").alias("repeattrips"),
        F.when(key % 4 == 0, "t").otherwise("f").alias("repeater"),
        F.date_add(F.lit("2001-05-01").cast("date"), (key % 150).cast("int")).alias("offerdate"),
    )


def retail_tables(spark: SparkSession, sf_dir: str) -> RetailTables:
    """The four input tables, written once per session to the shared folder."""
    made = (spark.sparkContext.applicationId, sf_dir)
    if made not in _made:
        transactions = stage(sample_transactions(spark, sf_dir), "transactions")
        offers = stage(sample_offers(transactions).coalesce(1), "offers")
        customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
        history = stage(sample_history(customers, transactions, offers), "history")
        train = history.where("id % 3 <> 0 and offer not in (30, 31, 32)")
        test = history.where("id % 3 = 0 and offer > 4")
        test = test.select("id", "chain", "offer", "market", "offerdate")
        _made[made] = RetailTables(transactions, offers, train, test)
    return _made[made]
