"""The demand planning view: what a principal, a molecule or a product has been asked for, the notices behind it, and what is to be expected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.operators import forecast
from gazette.operators.tracker import search

SEARCHED = ("portfolio_principal", "portfolio_product", "product_name", "registered_products")
UNMATCHED = "(no product matched)"


def hits(joined: DataFrame, needle: str) -> DataFrame:
    """Items of the tracker in whose principals, products, name or registrations a text occurs, whatever its case."""
    return search(joined, needle, SEARCHED)


def headline(found: DataFrame, as_of: str) -> DataFrame:
    """Products, notices, open notices and items of some hits: one row, also of none. Items without a product count as one further product."""
    open_ = F.coalesce(F.col("submission_deadline") >= F.to_date(F.lit(as_of)), F.lit(False))
    number = F.coalesce("tender_number", F.lit(""))
    counts = found.agg(F.count_distinct(number).alias("n_tenders"), F.count_distinct(F.when(open_, number)).alias("n_open"), F.count(F.lit(1)).alias("n_items"))
    skus = found.select(F.explode(F.when(F.size("portfolio_product") > 0, F.col("portfolio_product")).otherwise(F.array(F.lit(UNMATCHED)))).alias("sku"))
    return counts.join(skus.agg(F.count_distinct("sku").alias("n_skus")), F.lit(True))


def tenders_behind(found: DataFrame, as_of: str) -> DataFrame:
    """The notices behind some hits: one row for each notice and product name, the one that closes first (no closing day before all).

    Of several items with one closing day the least item_id counts, then unit and quantity.
    """
    first = F.struct("submission_deadline", "item_id", "unit", "quantity", "area", F.array_join("portfolio_product", "; ").alias("products"))
    out = found.groupBy("tender_number", "product_name").agg(F.min(first).alias("x")).select("tender_number", "product_name", "x.*")
    open_ = F.coalesce(F.col("submission_deadline") >= F.to_date(F.lit(as_of)), F.lit(False))
    return out.withColumn("state", F.when(open_, "open").otherwise("closed"))


def matching_forecasts(products: DataFrame, authorities: DataFrame, needle: str) -> DataFrame:
    """Forecasts, and what is withheld, of the products and authorities whose name has a text in it, whatever its case.

    ``products`` are rows for :func:`forecast.product_forecasts`, ``authorities`` (subject, day). Names are searched before anything is
    aggregated. Columns: kind, subject, metric, value, confidence, basis; value is NULL where too little was observed, basis says how much.
    """
    named = lambda df: df.filter(F.contains(F.lower("subject"), F.lit(needle.lower())))
    of_products = forecast.product_forecasts(named(products)).withColumn("kind", F.lit("product"))
    of_authorities = forecast.cycle_forecasts(named(authorities)).withColumn("kind", F.lit("authority"))
    return of_products.unionByName(of_authorities).select("kind", "subject", "metric", "value", "confidence", "basis")
