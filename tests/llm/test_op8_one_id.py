"""An id that half of the rows share (here: none) is parted by the texts, and the order of ids still holds over all files."""

from pyspark.sql import functions as F

from gazette.llm.common import scratch
from gazette.llm.op8_token_files import read_token_files, write_token_files


def test_one_id_for_half_of_the_rows(spark):
    n = 8000
    docs = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    folder = scratch(spark, "tokens")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")  # so little data would be one partition
    try:
        manifest = write_token_files(docs, folder)
    finally:
        spark.conf.set(name, before)
    sizes = [r.n for r in manifest.groupBy("part").agg(F.sum(F.size("doc_ids")).alias("n")).collect()]
    assert len(sizes) > 2 and max(sizes) < 2 * n / len(sizes)
    rows = sorted(read_token_files(manifest, folder).collect(), key=lambda r: r.start)
    assert len(rows) == n and [r.doc_id for r in rows] == [None] * (n // 2) + list(range(0, n, 2))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
