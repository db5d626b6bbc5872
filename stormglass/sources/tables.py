"""Macro-like panels derived from the supplied sales tables.

Prices are summed as decimals, so that a sum does not depend on the order of the rows:
a task that is run again, or another engine, gets the same number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables(dict):
    """Readers by table name, each opened when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self[name]


def load_tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


ORDERS_PER_TASK = 50_000  # of customers; a customer's few orders become a row for each month between


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(20,2)")


def macro_obs(tables: dict[str, DataFrame], entity: str = "c_mktsegment") -> DataFrame:
    """(entity, series, date, value): monthly, quarterly and daily series of each entity.

    Orders are first reduced to one row per entity and day, combined before the shuffle;
    a customer with most of the orders is split by the adaptive skew join. The reduced
    table, at most one row per entity and calendar day, is then placed by entity once,
    and no later grouping or window of an entity moves it again.
    """
    orders = tables["orders"].select(
        F.col("o_custkey"), F.to_date("o_orderdate").alias("day"),
        F.lit(1).alias("n"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"),
        (F.col("o_orderstatus") == "F").cast("int").alias("finished"),
        _exact("o_totalprice").alias("price"))
    if entity == "o_custkey":
        rows = orders.withColumn("entity", F.col("o_custkey").cast("string"))
    else:
        customer = tables["customer"].select(F.col("c_custkey").alias("o_custkey"),
                                             F.col(entity).cast("string").alias("entity"))
        rows = orders.join(customer, "o_custkey")
    daily = rows.groupBy("entity", "day").agg(
        F.sum("n").alias("n"), F.sum("urgent").alias("urgent"),
        F.sum("finished").alias("finished"), F.sum("price").alias("price"))
    if entity == "o_custkey":
        # As many tasks as the orders need: sizes of the shuffle say nothing of the months to come.
        daily = daily.repartition(max(1, -(-orders.count() // ORDERS_PER_TASK)), "entity")
    else:
        daily = daily.repartition("entity")
    month, quarter, n = F.trunc("day", "MM"), F.trunc("day", "quarter"), F.col("n")

    def part(series, date, over, under):
        return F.struct(F.lit(series).alias("series"), date.alias("date"),
                        over.cast("decimal(30,2)").alias("over"),
                        under.cast("decimal(30,2)").alias("under"))
    parts = F.explode(F.array(
        part("FEDFUNDS", month, F.col("urgent") * 100, n),
        part("UNRATE", month, F.col("finished") * 100, n),
        part("CPI", month, F.col("price"), n * 1000),
        part("GDP", quarter, F.col("price"), F.lit(0)),
        part("TREASURY", F.col("day"), F.col("price"), n * 10000),
        part("VIX", F.col("day"), n, F.lit(0))))
    sums = (daily.select("entity", parts.alias("p"))
            .groupBy("entity", F.col("p.series").alias("series"), F.col("p.date").alias("date"))
            .agg(F.sum("p.over").cast("double").alias("over"),
                 F.sum("p.under").cast("double").alias("under")))
    whole = F.when(F.col("series") == "GDP", F.col("over") / 1_000_000).otherwise(F.col("over"))
    value = F.when(F.col("under") > 0, F.try_divide(F.col("over"), F.col("under"))).otherwise(whole)
    return sums.select("entity", "series", "date", value.alias("value"))


INDICATORS = {
    "ORD.COUNT": "order_count",
    "ORD.REV": "revenue_millions",
    "ORD.AVG": "average_price",
    "ORD.URG": "urgent_share",
    "ORD.FIN": "finished_share",
    "ORD.BIG": "largest_price",
    "ORD.TOP": "top_sales_millions",
    "ORD.NONE": "returns_value",
}


def panel_years(tables: dict[str, DataFrame]) -> tuple[int, int]:
    """First and last year of an order; without orders there is no panel."""
    dates = tables["orders"].agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last")).first()
    if dates["first"] is None:
        raise ValueError("there are no orders to take the years from")
    return dates["first"].year, dates["last"].year


def indicator_long(tables: dict[str, DataFrame]) -> DataFrame:
    """(country_code, country, year, indicator_code, indicator, value), one row per cell.

    `top_sales_millions` exists only where a sale is above 495,000; `returns_value` never.
    """
    nation = tables["nation"].select(F.col("n_nationkey").alias("c_nationkey"),
                                     nation_code("n_nationkey").alias("country_code"),
                                     F.col("n_name").alias("country"))
    customer = tables["customer"].select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = tables["orders"].select(
        "o_custkey", F.year("o_orderdate").alias("year"),
        F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "F",
        _exact("o_totalprice")).toDF("o_custkey", "year", "urgent", "finished", "price")
    # Customer to nation first: both are far smaller than orders.
    yearly = (orders.join(customer, "o_custkey").groupBy("c_nationkey", "year").agg(
        F.count("*").alias("n"), F.sum("price").cast("double").alias("revenue"),
        F.count_if("urgent").alias("urgent"), F.count_if("finished").alias("finished"),
        F.max("price").cast("double").alias("biggest"),
        F.sum(F.when(F.col("price") > 495_000, F.col("price"))).cast("double").alias("top"))
        .join(nation, "c_nationkey"))
    n = F.col("n")
    values = {
        "ORD.COUNT": n.cast("double"),
        "ORD.REV": F.col("revenue") / 1_000_000,
        "ORD.AVG": F.col("revenue") / n,
        "ORD.URG": F.col("urgent") * 100.0 / n,
        "ORD.FIN": F.col("finished") * 100.0 / n,
        "ORD.BIG": F.col("biggest"),
        "ORD.TOP": F.col("top") / 1_000_000,
    }
    cells = F.explode(F.array(*[
        F.struct(F.lit(code).alias("indicator_code"), F.lit(INDICATORS[code]).alias("indicator"),
                 v.alias("value")) for code, v in values.items()]))
    return (yearly.select("country_code", "country", "year", cells.alias("c"))
            .select("country_code", "country", "year", "c.*"))


def nation_code(c: str) -> Column:
    return F.concat(F.lit("N"), F.lpad(F.col(c).cast("string"), 2, "0"))


def nation_countries(tables: dict[str, DataFrame]) -> DataFrame:
    return tables["nation"].select(nation_code("n_nationkey").alias("country_code"),
                                   F.col("n_name").alias("country"))


def scored_documents(tables: dict[str, DataFrame]) -> DataFrame:
    """(id, grp, actual, probability) of labelled documents, with ties on purpose."""
    docs = tables["documents"].select("doc_id", "lang", "n_chars")
    raw = 1 / (1 + F.exp(-(F.col("n_chars") / 1000.0 - 1.0)))
    return tables["labels"].join(docs, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("grp"),
        F.col("quality").alias("actual"), F.round(raw, 3).alias("probability"))


def scored_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """(id, grp, actual, probability) of all order lines: a large set with many ties."""
    raw = 1 / (1 + F.exp(-(F.col("l_quantity") / 20.0 - F.col("l_discount") * 10.0 - 1.0)))
    return tables["lineitem"].select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.col("l_linestatus").alias("grp"),
        (F.col("l_returnflag") == "R").cast("int").alias("actual"),
        F.round(raw, 4).alias("probability"))
