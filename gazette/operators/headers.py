"""Names of columns: which field a header means, and how complete a table of products is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.functions.text import fold
from gazette.operators.resolve import letters, ratio, within_letters

#: Fixed value: similarity from which a header is taken for an alias.
LEAST = 0.86


def guess_fields(headers: DataFrame, aliases: DataFrame, least: float = LEAST, normalise: bool = True) -> DataFrame:
    """(header, field, score) for each distinct header: the field of the equal folded alias, else of the most similar one from ``least`` on.

    Ties go to the alias that sorts first; a header that resembles none has neither field nor score. Headers meet only aliases whose
    length leaves a chance (a similarity of s needs lengths within a factor of 2 / s - 1), and are compared only if they share letters enough.
    """
    asked = headers.select("header").distinct().withColumn("h", fold(F.col("header"), normalise))
    known = aliases.select(fold(F.col("alias"), normalise).alias("alias"), "field").filter("alias <> ''").groupBy("alias").agg(F.min("field").alias("field"))
    equal = asked.join(known, asked["h"] == known["alias"]).select("header", "field", F.lit(1.0).alias("score"))
    rest, reach = asked.join(equal, "header", "left_anti").filter("h <> ''"), 2 / least - 1
    lengths = F.explode(F.sequence(F.ceil(F.length("h") / reach).cast("int"), F.floor(F.length("h") * reach).cast("int")))
    known = known.withColumn("alias_letters", letters(F.col("alias"))).withColumn("size", F.length("alias"))
    met = rest.withColumn("h_letters", letters(F.col("h"))).withColumn("size", lengths).join(known, "size").filter(within_letters("h", "alias", least))
    close = met.withColumn("score", ratio("h", "alias")).filter(F.col("score") >= least)
    top = close.groupBy("header").agg(F.min(F.struct((-F.col("score")).alias("back"), "alias", "field", "score")).alias("x")).select("header", "x.field", "x.score")
    return headers.select("header").distinct().join(equal.unionByName(top), "header", "left")


def completeness(products: DataFrame, by: str = "source") -> DataFrame:
    """For each source: its rows, and how many lack a manufacturer, a pack size or a price, or couldn't be read (no name)."""
    lacks = lambda c: F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    return products.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"), lacks("manufacturer").alias("n_no_manufacturer"), lacks("pack_qty").alias("n_no_pack"), lacks("retail_price").alias("n_no_price"), lacks("product_name").alias("n_unread")
    )
