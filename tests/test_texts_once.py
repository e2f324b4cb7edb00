"""Texts are read once each, and no further than they have something to find."""

import pyarrow as pa
from pyspark.sql import functions as F

from gazette.functions import text
from gazette.operators.lexicon import stem_hits
from gazette.plans.params import ScreenParams

P = ScreenParams()


def test_each_distinct_text_of_a_batch_is_read_once():
    seen = []

    def work(values):
        seen.extend(values.to_pylist())
        return pa.array([f"<{x or ''}>" for x in values.to_pylist()])

    texts = pa.array(["a", "b", None, "a", "", "b"])
    assert text.once_each(texts, work).to_pylist() == ["<a>", "<b>", "<>", "<a>", "<>", "<b>"] and sorted(seen) == ["", "a", "b"]
    assert text.once_each(pa.array([], pa.string()), work).to_pylist() == []
    assert text.once_each(pa.array(["x", None]), work).to_pylist() == ["<x>", "<>"]


def test_ascii_and_other_texts_fold_alike(spark):
    texts = ["", " \t\r\n ", "KW-77/2025.b  (x)\x0b\x1cY_%+", "a" * 50 + "\x7f\x00b", "٣ أدوية​  ÀB", "é", "İx", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.fold(F.col("t"), normalise=False).alias("f")).orderBy("i").collect()
    assert [r.f for r in got] == [text.folded(t, normalise=False) for t in texts]


def test_stems_are_found_where_there_are_some(spark):
    texts = ["zanubrutinib", "tinib", "xtinibs and metinib cobimetinib", "", None, "medicine"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", stem_hits(F.col("t"), P.stems).alias("h")).orderBy("i").collect()
    assert [r.h for r in got] == [["zanubrutinib"], [], ["cobimetinib", "metinib"], [], None, []]
