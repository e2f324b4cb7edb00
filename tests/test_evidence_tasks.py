"""Evidence of forecasts: more rows make more tasks, with the same rows as sets."""

from pyspark.sql import functions as F

from gazette.operators import forecast
from gazette.sources import settled


def test_tasks_of_evidence_grow_with_its_rows(spark, monkeypatch):
    monkeypatch.setattr(settled, "ROWS", 1000, raising=False)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int"))
    rows = spark.range(12_000).select(
        (F.col("id") % 7).cast("string").alias("subject"), F.col("id").cast("string").alias("tender_number"), F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("authority"), day.alias("day")
    )
    proof = forecast.evidence(rows)
    sizes = [r["count"] for r in proof.groupBy(F.spark_partition_id()).count().collect()]
    asked = rows.collect()
    want = {(r.subject, kind, str(v)) for r in asked for kind, v in (("tender", r.tender_number), ("authority", r.authority), ("day", r.day)) if v is not None}
    got = [tuple(r) for r in proof.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(sizes) >= 30 and max(sizes) <= 1000


def test_a_subject_is_dealt_to_one_task(spark, monkeypatch):
    monkeypatch.setattr(settled, "ROWS", 100)
    rows = spark.range(3000).select((F.col("id") % 50).alias("subject"))
    dealt = settled.dealt(rows, 3000, "subject")
    tasks = dealt.select("subject", F.spark_partition_id().alias("task")).distinct().collect()
    assert dealt.rdd.getNumPartitions() == 30 and len(tasks) == 50
