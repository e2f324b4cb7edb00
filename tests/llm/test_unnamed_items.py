import tempfile

import pandas as pd

from gazette.llm.op10_decontamination import clean, op10_decontamination


def test_item_without_id_marks_hits(spark):
    item, named = "Lone words, of an ITEM without any id at all here", "the other item has an id of its own and is listed"
    rows = [(1, f"before {item.lower()} after"), (2, "nothing of it"), (3, f"{named} and {item}"), (4, "lone words of an item"), (None, item)]
    folder = tempfile.mkdtemp(prefix="spark-")
    pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}).to_parquet(f"{folder}/documents.parquet")
    pd.DataFrame([(None, item), (5, named)], columns=["item_id", "text"]).astype({"item_id": "Int64"}).to_parquet(f"{folder}/benchmark.parquet")
    out = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in op10_decontamination(spark, folder).collect()}
    assert out == {1: (11, 0, True), 2: (0, 0, False), 3: (23, 1, True), 4: (0, 0, False), None: (11, 0, True)}
    kept = clean(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4]
