"""Procurement tables derived from the driver's tables, once as DataFrames and once as DuckDB SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-06-15"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (read(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    code = F.element_at(F.array(*map(F.lit, ("IN", "TB", "ON", "SP", "NU"))), (k % 5 + 1).cast("int"))
    deadline = F.when(k % 17 != 0, F.date_add(day, (30 + k % 60).cast("int")))
    first = F.substring("o_orderpriority", 1, 1)
    return joined.select(
        k.alias("id"), F.concat(F.lit("TN/"), F.year(day).cast("string"), F.lit("/"), k.cast("string")).alias("tender_number"),
        F.concat(F.lit("Supply of medicines for "), F.col("n_name"), F.lit(" "), F.col("c_mktsegment")).alias("tender_title"),
        F.col("n_name").alias("issuing_authority"), F.col("c_mktsegment").alias("department"), day.alias("publication_date"), deadline.alias("submission_deadline"),
        F.col("o_totalprice").alias("estimated_value"), F.when(first.isin("1", "2"), "High").when(first == "3", "Medium").otherwise("Low").alias("priority"),
        (F.col("o_totalprice") / 1000).alias("priority_score"), (F.col("o_orderstatus") == "P").alias("needs_review"), code.alias("search_code"),
        (code == "ON").alias("is_oncology"), F.when(k % 3 == 0, "Other Pharmaceutical").when(k % 3 == 1, "Cardiology").alias("therapeutic_area"),
        F.concat(F.lit("https://tenders.example/"), F.col("n_name"), F.lit("/"), k.cast("string"), F.lit("?token=1")).alias("tender_page_url"), F.lit("portal").alias("source"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    name = F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit(" mg "), F.lower("p_type"), F.lit(" tablet"))
    k = F.col("l_partkey")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", cents).alias("item_id"), F.col("l_orderkey").alias("tender_id"), F.col("l_linenumber").alias("item_no"),
        name.alias("product_name"), F.col("p_name").alias("generic_name"), F.col("l_quantity").alias("quantity"), F.when(F.col("l_returnflag") == "A", "Vial").when(F.col("l_returnflag") == "N", "Tablet ").otherwise("box").alias("unit"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), F.when(k % 4 == 0, "Neurology").when(k % 4 == 1, "Other Pharmaceutical").alias("therapeutic_area"),
        F.when(k % 3 == 0, F.array(F.concat(F.lit("Product "), (k % 50).cast("string")))).otherwise(F.array().cast("array<string>")).alias("portfolio_product"),
        F.when(k % 3 == 0, F.array(F.concat(F.lit("Principal "), (k % 7).cast("string")))).otherwise(F.array().cast("array<string>")).alias("portfolio_principal"),
        F.when(k % 2 == 0, F.array(F.concat(F.lit("Registered "), (k % 90).cast("string")))).otherwise(F.array().cast("array<string>")).alias("registered_products"),
        F.when(k % 6 == 0, "exact").when(k % 6 == 3, "skeleton").when(k % 6 == 2, "brand").otherwise("none").alias("ref_match_method"), (k % 5 == 0).alias("needs_review"),
    )


TENDERS_SQL = """
SELECT o_orderkey AS id, concat('TN/', year(o_orderdate), '/', o_orderkey) AS tender_number, concat('Supply of medicines for ', n_name, ' ', c_mktsegment) AS tender_title,
  n_name AS issuing_authority, c_mktsegment AS department, CAST(o_orderdate AS DATE) AS publication_date,
  CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 60 AS INT) END AS submission_deadline, o_totalprice AS estimated_value,
  CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN 'High' WHEN left(o_orderpriority, 1) = '3' THEN 'Medium' ELSE 'Low' END AS priority, o_totalprice / 1000 AS priority_score,
  o_orderstatus = 'P' AS needs_review, ['IN', 'TB', 'ON', 'SP', 'NU'][CAST(o_orderkey % 5 + 1 AS INT)] AS search_code, o_orderkey % 5 = 2 AS is_oncology,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Other Pharmaceutical' WHEN o_orderkey % 3 = 1 THEN 'Cardiology' END AS therapeutic_area,
  concat('https://tenders.example/', n_name, '/', o_orderkey, '?token=1') AS tender_page_url, 'portal' AS source
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

ITEMS_SQL = """
SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS item_id, l_orderkey AS tender_id, l_linenumber AS item_no,
  concat(p_name, ' ', p_size, ' mg ', lower(p_type), ' tablet') AS product_name, p_name AS generic_name, l_quantity AS quantity,
  CASE WHEN l_returnflag = 'A' THEN 'Vial' WHEN l_returnflag = 'N' THEN 'Tablet ' ELSE 'box' END AS unit, l_extendedprice / l_quantity AS unit_price,
  CASE WHEN l_partkey % 4 = 0 THEN 'Neurology' WHEN l_partkey % 4 = 1 THEN 'Other Pharmaceutical' END AS therapeutic_area,
  CASE WHEN l_partkey % 3 = 0 THEN [concat('Product ', l_partkey % 50)] ELSE CAST([] AS VARCHAR[]) END AS portfolio_product,
  CASE WHEN l_partkey % 3 = 0 THEN [concat('Principal ', l_partkey % 7)] ELSE CAST([] AS VARCHAR[]) END AS portfolio_principal,
  CASE WHEN l_partkey % 2 = 0 THEN [concat('Registered ', l_partkey % 90)] ELSE CAST([] AS VARCHAR[]) END AS registered_products,
  CASE l_partkey % 6 WHEN 0 THEN 'exact' WHEN 3 THEN 'skeleton' WHEN 2 THEN 'brand' ELSE 'none' END AS ref_match_method, l_partkey % 5 = 0 AS needs_review
FROM lineitem JOIN part ON l_partkey = p_partkey"""


def with_views(rest: str) -> str:
    """An oracle over tenders and items; ``rest`` is a query, or further named tables (after a comma) and a query."""
    return f"WITH tenders AS ({TENDERS_SQL}\n), items AS ({ITEMS_SQL}\n) {rest}"
