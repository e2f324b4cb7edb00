from pyspark.sql import functions as F

from gazette.llm.near_copies import survivors
from gazette.llm.op2_suffix_dedup import remove_repeated_bytes
from gazette.llm.op5_substring_dedup import remove_repeated_words


def test_texts_with_equal_ids_and_32_bit_hashes(spark):
    digest = F.md5(F.col("id").cast("string"))
    text = F.concat_ws(" ", *(F.substring(digest, at, 8) for at in (1, 9, 17, 25)))
    same = spark.range(400_000).select(text.alias("w")).groupBy(F.hash("w").alias("h")).agg(F.sort_array(F.collect_list("w")).alias("w")).filter(F.size("w") > 1)
    a, b = same.orderBy("w").first().w[:2]
    docs = spark.createDataFrame([(5, a), (5, b), (1, a)], "doc_id long, text string")
    assert a != b and docs.select(F.hash("text")).distinct().count() == 1
    cut = sorted((r.doc_id, r.n_removed) for r in remove_repeated_bytes(docs, window=16, anchor=8).collect())
    assert cut == [(1, len(a)), (5, 0), (5, len(a))]
    cut = sorted((r.doc_id, r.kept) for r in remove_repeated_words(docs, window=3, anchor=1).collect())
    assert cut == sorted([(1, a), (5, ""), (5, b)])
    assert sorted(r.text for r in survivors(docs.filter("doc_id = 5")).collect()) == sorted([a, b])
