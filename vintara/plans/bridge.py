"""The driver tables seen as a panel of issuers: what plays revenue, filings, requests and so on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintara.functions.scalars import joined_sum, split_sum

#: Knowledge cutoff used where a query needs one model date.
MODEL_DATE = "2001-06-30"
#: Concepts that every quarter of ``quarter_rows`` reports.
REPORTED = ("revenue", "operating_income", "cash_from_operations", "capital_expenditures")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hundredths(column: str, digits: int) -> Column:
    """``cast(column as decimal(digits, 2))`` in hundredths, as a long.

    A double that is the nearest one to a whole number of hundredths is that number; only others take the slow way through decimal digits.
    """
    c = F.col(column).cast("double")
    near = F.rint(c * 100.0)
    exact = (near / 100.0 == c) & (F.abs(c) < 10.0 ** (digits - 2)) & (F.abs(c) < 1e12)
    return F.when(exact, near.cast("long")).otherwise((c.cast(f"decimal({digits},2)") * 100).cast("long"))


def quarter_rows(spark: SparkSession, sf_dir: str, more: dict[str, Column] | None = None) -> DataFrame:
    """Wide panel: issuer, q_start, q_end, fiscal_quarter and a column for each concept (DECIMAL(28,4)), one row a quarter.

    ``more`` are further amounts, in ten thousandths, of the scan's columns price, discount, tax and quantity (longs, in hundredths) and flag.

    Amounts are cast to exact decimals at the scan. Operating income is what is left of six per cent
    of the price after the discount, so it is negative now and then.
    """
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("issuer"),
        F.trunc("l_shipdate", "quarter").alias("q_start"),
        hundredths("l_extendedprice", 12).alias("price"),
        hundredths("l_discount", 4).alias("discount"),
        hundredths("l_tax", 4).alias("tax"),
        hundredths("l_quantity", 12).alias("quantity"),
        *([F.col("l_returnflag").alias("flag")] if more else []),
    )
    amounts = {
        "revenue": F.col("price") * (100 - F.col("discount")), "operating_income": F.col("price") * (6 - F.col("discount")),
        "cash_from_operations": F.col("price") * F.col("tax"), "capital_expenditures": F.col("quantity") * 1000,
    } | (more or {})
    wide = line.groupBy("issuer", "q_start").agg(*[part for name, amount in amounts.items() for part in split_sum(amount, name)])
    wide = wide.select("issuer", "q_start", *[joined_sum(name).cast("decimal(28,4)").alias(name) for name in amounts])
    return wide.select("issuer", "q_start", F.last_day(F.add_months("q_start", 2)).alias("q_end"), F.quarter("q_start").alias("fiscal_quarter"), *amounts)


def quarter_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long panel: issuer, concept, q_start, q_end, fiscal_quarter, value (DECIMAL(28,4)), one row a cell."""
    long = quarter_rows(spark, sf_dir).unpivot(["issuer", "q_start", "q_end", "fiscal_quarter"], list(REPORTED), "concept", "value")
    return long.select("issuer", "concept", "q_start", "q_end", "fiscal_quarter", "value")


def customer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse panel: each customer's order total by quarter."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("issuer"), F.trunc("o_orderdate", "quarter").alias("q_start"), F.col("o_totalprice").cast("decimal(12,2)").alias("amount"))
    cells = orders.groupBy("issuer", "q_start").agg(F.sum("amount").cast("decimal(28,2)").alias("value"))
    return cells.select("issuer", F.lit("order_total").alias("concept"), "q_start", F.last_day(F.add_months("q_start", 2)).alias("q_end"), F.quarter("q_start").alias("fiscal_quarter"), "value")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a filing index: issuer, accession, form, report_period, accepted, available, amended value."""
    return filings_of(table(spark, sf_dir, "orders"))


def filings_of(o: DataFrame) -> DataFrame:
    """The filing index of any frame of orders, a stream too."""
    accepted = F.col("o_orderdate") + F.make_interval(hours=F.col("o_orderkey") % 24)
    return o.select(
        F.col("o_custkey").alias("issuer"),
        F.col("o_orderkey").alias("accession"),
        F.when(F.col("o_orderpriority").startswith("1"), "10-K").when(F.col("o_orderpriority").startswith("2"), "10-K/A").otherwise("10-Q").alias("form"),
        F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), -1)).alias("report_period"),
        accepted.alias("accepted"),
        F.to_date(accepted + F.make_interval(days=1 + F.col("o_orderkey") % 3)).alias("available"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("value"),
    )


def ytd_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported facts of revenue with year-to-date parents: issuer, concept, start, end, value, mapping_rule, unit, available.

    Quarters are reported directly except that issuers divisible by 3 leave out the second to fourth
    and issuers divisible by 7 misstate their third; half-year, nine-month and yearly facts are sums.
    """
    cells = quarter_cells(spark, sf_dir).where("concept = 'revenue'")
    year = F.trunc("q_start", "year")
    direct = cells.where("fiscal_quarter = 1 or issuer % 3 <> 0").select("issuer", "concept", F.col("q_start").alias("start"), F.col("q_end").alias("end"), F.when((F.col("issuer") % 7 == 0) & (F.col("fiscal_quarter") == 3), F.col("value") + 1000).otherwise(F.col("value")).cast("decimal(28,4)").alias("value"))
    spans = F.explode(F.sequence(F.col("fiscal_quarter"), F.lit(4)))
    longer = cells.select("issuer", "concept", year.alias("start"), "value", "fiscal_quarter", spans.alias("upto")).where("upto >= 2")
    longer = longer.groupBy("issuer", "concept", "start", "upto").agg(F.sum("value").cast("decimal(28,4)").alias("value"), F.count(F.lit(1)).alias("parts")).where("parts = upto")
    longer = longer.select("issuer", "concept", "start", F.last_day(F.add_months("start", F.col("upto") * 3 - 1)).alias("end"), "value")
    facts = direct.unionByName(longer)
    return facts.withColumn("mapping_rule", F.lit("STANDARD")).withColumn("unit", F.lit("USD")).withColumn("available", F.date_add("end", 30)).withColumn("bound", F.lit(0.5))
