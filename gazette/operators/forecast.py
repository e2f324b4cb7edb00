"""Forecasts with evidence: renewal cycles, quantities, values and seasons, only where enough was observed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gazette.sources.settled import dealt

#: Observations needed for a cycle, a quantity, a value, a season.
MIN_CYCLE, MIN_QUANTITY, MIN_VALUE, MIN_SEASON = 3, 3, 3, 6


def gaps(dated: DataFrame) -> DataFrame:
    """(subject, day) with the days since the subject's day before."""
    return dated.withColumn("gap", F.datediff("day", F.lag("day").over(Window.partitionBy("subject").orderBy("day"))))


def cycles(dated: DataFrame) -> DataFrame:
    """Renewal cycle of each subject of (subject, day): median gap, spread, last and expected next day, confidence.

    NULL where fewer than three days are known. Halves round to even.
    """
    enough = F.col("n_days") >= MIN_CYCLE
    ranked = gaps(dated.filter("day is not null")).withColumn("_r", F.row_number().over(Window.partitionBy("subject").orderBy("day")))
    out = ranked.groupBy("subject").agg(
        F.count(F.lit(1)).alias("n_days"), F.median("gap").alias("_m"), F.stddev_pop("gap").alias("_s"), F.max("day").alias("_last"), F.min("day").alias("first_day"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_r").between(2, 9), F.struct("_r", "gap")))), lambda x: x["gap"]).alias("first_gaps"),
    )
    confidence = F.when(F.col("_s") < F.col("_m") * 0.20, "high").when(F.col("_s") < F.col("_m") * 0.45, "medium").otherwise("low")
    cycle = F.bround("_m", 0).cast("int")
    return out.select(
        "subject", "n_days", "first_day", F.col("_last").alias("last_day"), F.when(enough, cycle).alias("cycle_days"), F.when(enough, F.bround(F.coalesce("_s", F.lit(0.0)), 0).cast("int")).alias("spread_days"),
        F.when(enough, F.date_add("_last", cycle)).alias("expected_next"), F.when(enough, confidence).alias("confidence"), "first_gaps",
    )


def amounts(rows: DataFrame) -> DataFrame:
    """Typical quantity and value of each subject of (subject, quantity, value, unit, key); the unit is that of the least key."""
    some = lambda c: F.when(F.col(c) != 0, F.col(c))
    out = rows.groupBy("subject").agg(
        F.count(some("quantity")).alias("n_quantity"), F.median(some("quantity")).alias("_q"), F.min(some("quantity")).alias("least"), F.max(some("quantity")).alias("most"),
        F.count(some("value")).alias("n_value"), F.median(some("value")).alias("_v"), F.min_by("unit", "key").alias("unit"),
    )
    return out.select("subject", "n_quantity", F.when(F.col("n_quantity") >= MIN_QUANTITY, F.col("_q")).alias("quantity"), "least", "most", "n_value", F.when(F.col("n_value") >= MIN_VALUE, F.col("_v")).alias("value"), "unit")


def seasons(dated: DataFrame) -> DataFrame:
    """Peak months of each subject: all months that are most frequent, given enough days in two years."""
    known = dated.filter("day is not null")
    months = known.groupBy("subject", F.month("day").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    top = months.withColumn("_r", F.rank().over(Window.partitionBy("subject").orderBy(F.desc("n")))).filter("_r = 1")
    peaks = top.groupBy("subject").agg(F.array_join(F.sort_array(F.collect_list("month")), ", ").alias("peaks"))
    years = known.groupBy("subject").agg(F.count(F.lit(1)).alias("n_days"), F.count_distinct(F.year("day")).alias("n_years"))
    enough = (F.col("n_days") >= MIN_SEASON) & (F.col("n_years") >= 2)
    return years.join(peaks, "subject").select("subject", "n_days", "n_years", F.when(enough, F.col("peaks")).alias("peaks"), F.when(enough, F.when(F.col("n_days") < 10, "low").otherwise("medium")).alias("confidence"))


def product_forecasts(rows: DataFrame) -> DataFrame:
    """All forecasts of (subject, day, quantity, value, unit, key) in long form: subject, metric, value, confidence, basis; missing ones have no value."""
    c = cycles(rows.select("subject", "day"))
    a, s = amounts(rows), seasons(rows.select("subject", "day"))
    wide = c.join(a, "subject", "full").join(s.select("subject", "n_years", "peaks", F.col("confidence").alias("season")), "subject", "left")
    number = lambda x: F.format_number(x, 0)
    entry = lambda metric, value, confidence, basis: F.struct(F.lit(metric).alias("metric"), value.alias("value"), confidence.alias("confidence"), basis.alias("basis"))
    days = F.coalesce("n_days", F.lit(0)).cast("string")
    metrics = F.array(
        entry("expected_next", F.col("expected_next").cast("string"), F.col("confidence"), F.concat(days, F.lit(" days observed"))),
        entry("frequency", F.concat(F.col("cycle_days").cast("string"), F.lit(" days")), F.col("confidence"), F.concat(F.lit("gaps "), F.array_join("first_gaps", ", "))),
        entry("typical_quantity", F.when(F.col("quantity").isNotNull(), F.concat_ws(" ", number(F.col("quantity")), F.trim("unit"))), F.when(F.col("n_quantity") >= 5, "high").otherwise("medium"), F.concat(F.col("n_quantity").cast("string"), F.lit(" quantities"))),
        entry("historical_value", number(F.col("value")), F.lit("medium"), F.concat(F.col("n_value").cast("string"), F.lit(" values"))),
        entry("seasonal_pattern", F.col("peaks"), F.col("season"), F.concat(days, F.lit(" days in "), F.coalesce("n_years", F.lit(0)).cast("string"), F.lit(" years"))),
    )
    return wide.select("subject", F.explode(metrics).alias("m")).select("subject", "m.*")


def summary(forecasts: DataFrame) -> DataFrame:
    """Subjects examined, and forecasts produced and withheld."""
    return forecasts.agg(F.count_distinct("subject").alias("examined"), F.count("value").alias("produced"), F.count_if(F.col("value").isNull()).alias("withheld"))


def cycle_forecasts(dated: DataFrame) -> DataFrame:
    """The two forecasts of a rhythm alone, of (subject, day), in the form of :func:`product_forecasts`."""
    basis = F.concat(F.col("n_days").cast("string"), F.lit(" days observed"))
    both = F.array(
        F.struct(F.lit("expected_next").alias("metric"), F.col("expected_next").cast("string").alias("value")),
        F.struct(F.lit("frequency").alias("metric"), F.concat(F.col("cycle_days").cast("string"), F.lit(" days")).alias("value")),
    )
    return cycles(dated).select("subject", F.explode(both).alias("m"), "confidence", basis.alias("basis")).select("subject", "m.*", "confidence", "basis")


def withheld(rows: DataFrame) -> DataFrame:
    """(subject, metric, observed, needed, message): what can't be forecast of (subject, day, quantity, value, unit, key), and how much is lacking.

    A season needs days in two years besides; its row says so in the message. Values are optional in notices and so never said to lack.
    """
    seen = rows.groupBy("subject").agg(F.count("day").alias("days"), F.count_if(F.col("quantity") != 0).alias("quantities"), F.count_distinct(F.year("day")).alias("years"))
    lack = lambda metric, n, needed, short, more="": F.when(short, F.struct(F.lit(metric).alias("metric"), F.col(n).alias("observed"), F.lit(needed).alias("needed"), F.concat(F.lit(f"{metric}: "), F.col(n).cast("string"), F.lit(f" {n}, {needed} needed{more}")).alias("message")))
    gaps_ = F.array_compact(F.array(
        lack("cycle", "days", MIN_CYCLE, F.col("days") < MIN_CYCLE),
        lack("typical_quantity", "quantities", MIN_QUANTITY, F.col("quantities") < MIN_QUANTITY),
        lack("seasonal_pattern", "days", MIN_SEASON, (F.col("days") < MIN_SEASON) | (F.col("years") < 2), " in two years"),
    ))
    return seen.select("subject", F.explode(gaps_).alias("m")).select("subject", "m.*")


def evidence(rows: DataFrame) -> DataFrame:
    """(subject, kind, value), distinct: the notices, authorities and days that forecasts of (subject, tender_number, authority, day) rest on.

    A table and not a list in each forecast: a product that a third of all items ask for would be one list in one row. Nearly each row has a
    notice of its own, so rows are told apart where they are dealt to and not before. ``rows`` is read twice.
    """
    kinds = ("tender", "tender_number"), ("authority", "authority"), ("day", "day")
    each = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")) for kind, c in kinds)))
    found = rows.select("subject", each.alias("m")).select("subject", "m.*").filter("value is not null")
    return dealt(found, len(kinds) * rows.count(), "subject", "kind", "value").distinct()


def saved(forecasts: DataFrame, proof: DataFrame, run_id: str) -> DataFrame:
    """Rows of the forecasts table for one run: what was produced, with the size and the ends of its evidence as JSON; for ``io.append_run``."""
    sizes = proof.groupBy("subject").agg(
        F.count_if(F.col("kind") == "tender").alias("tenders"), F.count_if(F.col("kind") == "authority").alias("authorities"), F.count_if(F.col("kind") == "day").alias("days"),
        F.min(F.when(F.col("kind") == "day", F.col("value"))).alias("first"), F.max(F.when(F.col("kind") == "day", F.col("value"))).alias("last"),
    )
    own = sizes.select("subject", F.to_json(F.struct("tenders", "authorities", "days", "first", "last")).alias("evidence"))
    return forecasts.filter("value is not null").join(own, "subject", "left").select(F.lit(run_id).alias("run_id"), "subject", "metric", "value", "confidence", "evidence")
