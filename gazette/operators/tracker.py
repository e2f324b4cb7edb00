"""The item tracker: items with their notices, filtered in one place, so that screens, reports and exports agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gazette.functions import present
from gazette.plans.params import ScreenParams

SEARCHED = ("tender_number", "product_name", "issuing_authority", "area", "search_code", "unit")


def joined(items: DataFrame, tenders: DataFrame, params: ScreenParams, how: str = "inner") -> DataFrame:
    """Items with their notice's columns and the area that is shown. ``left`` keeps notices without items."""
    t = tenders.select("id", "tender_number", "tender_title", "issuing_authority", "submission_deadline", "publication_date", "priority", "is_oncology", "search_code", F.col("therapeutic_area").alias("tender_area"))
    i = items.withColumnRenamed("therapeutic_area", "item_area")
    both = t.join(i, t.id == i.tender_id, "left") if how == "left" else i.join(t, i.tender_id == t.id)
    return both.withColumn("area", present.display_area(F.col("item_area"), F.col("tender_area"), present.labels_of(params.code_labels, F.col("search_code"))))


def status(kind: str) -> Column:
    """Match status: all, portfolio, registry-only, none, review."""
    ours, registered = F.size("portfolio_product") > 0, F.size("registered_products") > 0
    tests = {"all": F.lit(True), "portfolio": ours, "registry-only": registered & ~ours, "none": ~registered & ~ours, "review": F.col("needs_review")}
    return tests[kind]


def search(df: DataFrame, needle: str, columns=SEARCHED) -> DataFrame:
    """Rows in which a text occurs in any of some columns, whatever its case."""
    spaced = reduce(lambda a, b: F.concat(a, F.lit(" "), b), (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return df.filter(F.contains(F.lower(spaced), F.lit(needle.lower())))


def scoped(items: DataFrame, tenders: DataFrame, params: ScreenParams, as_of: str, window: str = "", first: str | None = None, last: str | None = None, kind: str = "all", area: str | None = None, needle: str = "", codes=()) -> DataFrame:
    """The tracker under a filter; explicit days take the place of the preset window."""
    low, high = (F.to_date(F.lit(first)) if first else None, F.to_date(F.lit(last)) if last else None) if first or last else present.closing_window(window, as_of)
    out = joined(items, tenders, params).filter(present.within(F.col("submission_deadline"), low, high)).filter(status(kind))
    if area:
        out = out.filter(F.col("area") == area)
    if codes:
        out = out.filter(F.col("search_code").isin(*codes))
    return search(out, needle) if needle else out


def ordered(df: DataFrame) -> DataFrame:
    return df.orderBy(F.asc_nulls_last("submission_deadline"), "tender_number", "item_id")


def shown(df: DataFrame) -> DataFrame:
    """The eleven columns of the tracker, and how a row is highlighted."""
    mark = F.when(F.col("ref_match_method").isin("skeleton", "brand"), "amber").when(F.col("ref_match_method") == "none", "pink").otherwise("none")
    return df.select(
        "item_id", "tender_number", F.coalesce(F.col("submission_deadline").cast("string"), F.lit(present.NOT_AVAILABLE)).alias("closing"), "area", "product_name", "unit", "quantity",
        present.join_top(F.col("registered_products")).alias("registered"), present.join_top(F.col("portfolio_product")).alias("product"), present.join_top(F.col("portfolio_principal")).alias("principal"),
        F.coalesce("ref_match_method", F.lit("none")).alias("method"), mark.alias("highlight"),
    )


def coverage(df: DataFrame) -> DataFrame:
    """Rows, and how many match the registry, the portfolio, neither, or only fuzzily."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size("registered_products") > 0).alias("n_registry"), F.count_if(F.size("portfolio_product") > 0).alias("n_portfolio"),
        F.count_if((F.size("registered_products") == 0) & (F.size("portfolio_product") == 0)).alias("n_unmatched"), F.count_if(F.col("ref_match_method").isin("skeleton", "brand")).alias("n_fuzzy"),
    )


def kpis(df: DataFrame, as_of: str) -> DataFrame:
    """Eight counts of a scope in one pass; a missing number counts as one notice."""
    open_ = F.coalesce(F.col("submission_deadline") >= F.to_date(F.lit(as_of)), F.lit(False))
    ours = F.size("portfolio_product") > 0
    number = F.coalesce("tender_number", F.lit(""))
    return df.agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if(ours).alias("n_portfolio"), F.count_if(F.size("registered_products") > 0).alias("n_registry"), F.count_if(open_ & ours).alias("n_open_portfolio"),
        F.count_if("needs_review").alias("n_review"), F.count_if("is_oncology").alias("n_oncology"), F.count_if(open_).alias("n_open"),
        F.count_distinct(number).alias("n_tenders"), F.count_distinct(F.when(open_, number)).alias("n_open_tenders"),
    )


def first_rows(df: DataFrame, by: str, order: list) -> DataFrame:
    """The first row of each group in an order."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.filter("_n = 1").drop("_n")


def display_order() -> list:
    return [F.asc_nulls_last("submission_deadline"), F.col("tender_number"), F.col("item_id")]


def by_principal(df: DataFrame) -> DataFrame:
    return df.select(F.explode("portfolio_principal").alias("principal")).groupBy("principal").agg(F.count(F.lit(1)).alias("n_items")).orderBy(F.desc("n_items"), "principal")


def by_area(df: DataFrame) -> DataFrame:
    """Notices for each area, by the area of a notice's first row in display order."""
    return first_rows(df, "tender_number", display_order()).groupBy("area").agg(F.count(F.lit(1)).alias("n_tenders")).orderBy(F.desc("n_tenders"), "area")


def roll_up(df: DataFrame) -> DataFrame:
    """One row for each notice: items, matched items, first area and first closing day."""
    order = F.struct(F.col("submission_deadline").isNull(), "submission_deadline", "item_id")
    return df.groupBy("tender_number").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.size("portfolio_product") > 0).alias("n_matched"), F.min_by("area", order).alias("first_area"), F.min("submission_deadline").alias("closing"))


def demand(df: DataFrame, as_of: str) -> DataFrame:
    """Demand for each portfolio product; items without one count under one name."""
    open_ = F.coalesce(F.col("submission_deadline") >= F.to_date(F.lit(as_of)), F.lit(False))
    sku = F.explode(F.when(F.size("portfolio_product") > 0, F.col("portfolio_product")).otherwise(F.array(F.lit("(no product matched)"))))
    return df.withColumn("sku", sku).groupBy("sku").agg(
        F.count_distinct("tender_number").alias("n_tenders"), F.sum("quantity").alias("quantity"), F.array_join(F.sort_array(F.collect_set(F.trim("unit"))), ", ").alias("units"),
        F.count_distinct("product_name").alias("n_names"), F.count_if(open_).alias("n_open"), F.min(F.when(open_, F.col("submission_deadline"))).alias("next_closing"),
        F.min_by(F.get("portfolio_principal", F.lit(0)), "item_id").alias("principal"),
    )


def portfolio_overview(df: DataFrame, as_of: str) -> DataFrame:
    """Distinct products, items and open notices of each principal."""
    open_ = F.coalesce(F.col("submission_deadline") >= F.to_date(F.lit(as_of)), F.lit(False))
    each = df.withColumn("principal", F.explode("portfolio_principal")).withColumn("sku", F.explode_outer("portfolio_product"))
    return each.groupBy("principal").agg(F.count_distinct("sku").alias("n_skus"), F.count_distinct("item_id").alias("n_items"), F.count_distinct(F.when(open_, F.col("tender_number"))).alias("n_open_tenders"))


def opportunities(df: DataFrame, as_of: str) -> DataFrame:
    """Open items that match the portfolio; fuzzy matches are to be verified."""
    found = df.filter((F.col("submission_deadline") >= F.to_date(F.lit(as_of))) & (F.size("portfolio_product") > 0))
    return found.select("item_id", "tender_number", "submission_deadline", "area", F.substring("product_name", 1, 60).alias("product"), F.when(F.col("ref_match_method") == "exact", "exact").otherwise("verify").alias("check"))


def closing_soon(df: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """One row for each notice that closes within some days, with title and priority looked up (the last of equal numbers wins)."""
    soon = first_rows(df.filter(present.within(F.col("submission_deadline"), *present.closing_window(str(days), as_of))), "tender_number", display_order())
    titles = df.groupBy("tender_number").agg(F.max_by(F.struct("tender_title", "priority"), "id").alias("t")).select(F.col("tender_number").alias("number"), "t.*")
    return soon.select("tender_number", "submission_deadline", "area").join(titles, F.col("tender_number") == F.col("number")).drop("number")


def review_queue(items: DataFrame, tenders: DataFrame, params: ScreenParams, needle: str = "") -> DataFrame:
    """Flagged notices and flagged items with the area that is shown."""
    area = present.display_area(F.lit(None).cast("string"), F.col("therapeutic_area"), present.labels_of(params.code_labels, F.col("search_code")))
    notices = tenders.filter("needs_review").select(F.lit("tender").alias("kind"), F.col("id").cast("string").alias("key"), "tender_number", area.alias("area"), F.col("tender_title").alias("name"))
    flagged = joined(items, tenders, params).filter("needs_review").select(F.lit("item").alias("kind"), F.col("item_id").alias("key"), "tender_number", "area", F.col("product_name").alias("name"))
    both = notices.unionByName(flagged)
    return search(both, needle, ("tender_number", "area", "name", "kind")) if needle else both


def detail(tenders: DataFrame, items: DataFrame, changes: DataFrame, documents: DataFrame) -> DataFrame:
    """Each notice with its items, changes and documents as arrays."""
    out = tenders
    for name, child in (("items", items), ("changes", changes), ("documents", documents)):
        columns = sorted(c for c in child.columns if c != "tender_id")
        lists = child.groupBy("tender_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name)).withColumnRenamed("tender_id", f"_{name}")
        out = out.join(lists, out.id == lists[f"_{name}"], "left").drop(f"_{name}")
    return out
