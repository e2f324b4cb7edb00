"""Intake of listings as portals write them: texts become dates, amounts and quantities; what can't be read is NULL and a row of its own.

One bad value never stops a batch: the listing goes on without it, and the error says which listing, which field and which text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.parse import parse_amount, parse_date, parse_quantity
from gazette.functions.text import clean

RAW = "row_id long, source string, tender_number string, tender_title string, tender_title_ar string, issuing_authority string, department string, publication_date string, submission_deadline string, tender_page_url string, source_url string, description string, estimated_value string, search_code string, items array<struct<item_no: int, product_name: string, quantity: string>>, raw_row map<string, string>"
DATES = ("publication_date", "submission_deadline")


def _error(stage: str, field: str, value: Column) -> Column:
    return F.struct(F.lit(stage).alias("stage"), F.concat(F.lit(f"{field}: "), value).alias("message"))


def read_listings(raw: DataFrame, day_first: bool = True) -> tuple[DataFrame, DataFrame]:
    """(listings, errors) from rows like ``RAW``: typed listings, and (stage, target, message) of every value that can't be read.

    Stages: parse (dates, amounts), items (quantities; an item without a name is left out), listing (neither number, title nor URL: such a
    row is left out). The target is the number, else the title, else the URL, else the row.
    """
    some = lambda c: c.isNotNull() & (F.trim(c) != "")
    name = lambda x: clean(x["product_name"], normalise=False)  # noqa: E731  no Python in the functions over items
    amount = parse_amount(F.col("estimated_value"))
    dates = {d: parse_date(F.col(d), day_first) for d in DATES}
    target = F.coalesce(*(F.when(some(F.col(c)), F.col(c)) for c in ("tender_number", "tender_title", "tender_page_url", "source_url")))
    items = F.coalesce(F.col("items"), F.array().cast(raw.schema["items"].dataType))
    parsed = raw.select("*", *(v.alias(f"_{d}") for d, v in dates.items()), amount["amount"].alias("_estimated_value"), target.alias("_target"), items.alias("_items"))
    unread = lambda x: some(x["quantity"]) & parse_quantity(x["quantity"])["quantity"].isNull()
    at = lambda x: F.concat(F.lit("item "), F.coalesce(x["item_no"].cast("string"), F.lit("?")), F.lit(", "), F.coalesce(x["quantity"], F.lit("")))
    fields = [*DATES, "estimated_value"]
    wrong = F.array(*(F.when(some(F.col(f)) & F.col(f"_{f}").isNull(), _error("parse", f, F.col(f))) for f in fields), F.when(F.col("_target").isNull(), _error("listing", "row", F.lit("neither number, title nor URL"))))
    lines = F.concat(
        F.transform(F.filter("_items", unread), lambda x: _error("items", "quantity", at(x))), F.transform(F.filter("_items", lambda x: ~some(x["product_name"])), lambda x: _error("items", "product_name", at(x)))
    )
    errors = parsed.select(F.coalesce("_target", F.concat(F.lit("row "), F.col("row_id").cast("string"))).alias("target"), F.explode(F.concat(F.array_compact(wrong), lines)).alias("e"))
    kept = F.filter("_items", lambda x: some(x["product_name"]))
    line = lambda x: F.struct(x["item_no"].alias("item_no"), name(x).alias("product_name"), parse_quantity(x["quantity"])["unit"].alias("unit"), parse_quantity(x["quantity"])["quantity"].alias("quantity"))
    typed = {d: F.col(f"_{d}") for d in DATES} | {"estimated_value": F.col("_estimated_value"), "items": F.transform(kept, line)}
    listings = parsed.filter("_target is not null").select(*(typed[c].alias(c) if c in typed else F.col(c) for c in raw.columns))
    return listings, errors.select("e.stage", "target", "e.message")
