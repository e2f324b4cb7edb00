"""History: change detection, merging, change feed, children, reviews. Every function returns new tables; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gazette.sources.settled import settled

#: Fields that an update may change.
MUTABLE = ("tender_title", "issuing_authority", "department", "publication_date", "submission_deadline", "closing_time", "tender_status", "contract_period", "estimated_value", "currency", "tender_fee", "bid_bond", "therapeutic_area", "priority", "tender_page_url")


def incoming(c: Column) -> Column:
    """A value that may replace another: not NULL, empty or the word for missing."""
    text = F.trim(c.cast("string"))
    return F.when(text.isNotNull() & ~text.isin("", "Not Available"), c)


def changed(matched: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matched rows (tender_id, content_hash, ...) whose hash differs from the stored one, and those whose hash is equal."""
    known = old.select(F.col("id").alias("tender_id"), F.col("content_hash").alias("_before"))
    both = matched.join(known, "tender_id")
    moved = ~F.col("content_hash").eqNullSafe(F.col("_before"))
    return both.filter(moved).drop("_before"), both.filter(~moved).drop("_before")


def upsert(old: DataFrame, updates: DataFrame, fields=(*MUTABLE, "content_hash")) -> DataFrame:
    """Old rows with the updates' filled fields (by id), and rows that are new, in one outer join. Ids of the updates are distinct."""
    fields = [f for f in fields if f in old.columns and f in updates.columns]
    new = updates.select(*(F.col(c).alias(f"_{c}") for c in updates.columns))
    both = old.join(new, old.id == new["_id"], "full")
    value = lambda c: F.when(F.col("id").isNull(), F.col(f"_{c}")).otherwise(F.coalesce(incoming(F.col(f"_{c}")), F.col(c)) if c in fields else F.col(c)).alias(c)
    return both.select(*(value(c) if c in updates.columns else F.col(c) for c in old.columns))


def change_feed(old: DataFrame, updates: DataFrame, fields=MUTABLE) -> DataFrame:
    """(tender_id, field, old_value, new_value) for each field that an update changes."""
    fields = [f for f in fields if f in old.columns and f in updates.columns]
    both = old.alias("o").join(updates.alias("n"), F.col("o.id") == F.col("n.id"))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").cast("string").alias("old_value"), incoming(F.col(f"n.{f}")).cast("string").alias("new_value")) for f in fields))
    rows = both.select(F.col("o.id").alias("tender_id"), F.explode(pairs).alias("x")).select("tender_id", "x.*")
    return rows.filter(F.col("new_value").isNotNull() & ~F.col("old_value").eqNullSafe(F.col("new_value")))


def unknown(links: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The distinct links that aren't among those known."""
    return links.select(key).distinct().join(known.select(key), key, "left_anti")


def history(changes: DataFrame) -> DataFrame:
    """A change feed in the order in which its rows came."""
    return changes.orderBy("id")


def review_order(tenders: DataFrame) -> DataFrame:
    """Flagged notices, the ones seen last first."""
    return tenders.filter("needs_review").orderBy(F.desc("last_seen"), "id")


def places(ordered: DataFrame) -> DataFrame:
    """An ordered table with the place of each row, from 1. The sort's partitions are in order, so a row's place is its place in its own
    partition and the rows of the partitions before; only their counts, one a partition, come together."""
    rows = settled(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id()), "ordered")
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_n").alias("_first"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    both = rows.join(F.broadcast(before), "_part")  # a row for each partition
    return both.withColumn("place", F.col("_before") + F.col("_n") - F.col("_first") + 1).drop("_part", "_n", "_rows", "_first", "_before")


def replace_children(old: DataFrame, new: DataFrame, key: str = "tender_id") -> DataFrame:
    """All new children, and the old ones of parents that have no new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_ignore(old: DataFrame, new: DataFrame, keys=("tender_id", "sha256")) -> DataFrame:
    """Old rows, and the new ones whose key isn't there yet; one row for each new key."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def with_placeholders(tenders: DataFrame, items: DataFrame) -> DataFrame:
    """Items, and one item named after the title for each notice that has none, flagged for review."""
    bare = tenders.join(items.select(F.col("tender_id").alias("id")), "id", "left_anti")
    made = bare.select(F.col("id").alias("tender_id"), F.col("tender_title").alias("product_name"), F.lit(True).alias("needs_review"), F.lit("no line items found").alias("review_reason"))
    return items.unionByName(made, allowMissingColumns=True)


def distinct_items(items: DataFrame, order: str = "item_no") -> DataFrame:
    """One item for each name, unit and quantity inside a notice, the first in order."""
    from gazette.functions.keys import item_key

    keyed = items.withColumn("_k", item_key(F.col("product_name"), F.col("unit"), F.col("quantity")))
    ranked = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("tender_id", "_k").orderBy(order, *(c for c in items.columns if c.endswith("_id")))))
    return ranked.filter("_n = 1").drop("_k", "_n")


def approve(tenders: DataFrame, items: DataFrame, approved_tenders: DataFrame, approved_items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clears the flags of approved notices and items, then of touched notices that have no flagged item left."""
    mark = lambda df, key, ids: df.join(ids.select(F.col(ids.columns[0]).alias("_ok")).distinct(), F.col(key) == F.col("_ok"), "left")
    marked = mark(items, "item_id", approved_items)
    done = marked.withColumn("needs_review", F.col("needs_review") & F.col("_ok").isNull())
    touched = done.filter("_ok is not null").select(F.col("tender_id").alias("_t")).distinct()
    flagged = done.filter("needs_review").select(F.col("tender_id").alias("_t")).distinct()
    clear = touched.join(flagged, "_t", "left_anti")
    out = mark(tenders, "id", approved_tenders).join(clear, F.col("id") == F.col("_t"), "left")
    return out.withColumn("needs_review", F.col("needs_review") & F.col("_ok").isNull() & F.col("_t").isNull()).drop("_ok", "_t"), done.drop("_ok")
