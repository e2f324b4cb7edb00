import tempfile

import pytest
from pyspark.sql import functions as F

from gazette.llm.op1_warc import read_archives, write_archives


@pytest.mark.parametrize("copies", [1, 2, 5])
def test_segmented_responses_that_repeat(spark, copies):
    long, other = "é<a>" * 20_000, "b" * 70_000  # several segments each
    rows = [(7, "u", long), (None, "n", other)] * copies + [(9, "later", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    write_archives(pages, folder)
    out = read_archives(spark, folder).select("page_id", "url", "kind", "refers_to", "complete", F.col("payload").cast("string").alias("payload")).collect()
    want = [(7, "u", "response", None, True, long), (None, "n", "response", None, True, other)] * copies + [(9, "later", "revisit", 7, True, None)]
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))
