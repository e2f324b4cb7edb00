"""The rows of an anchor meet in one task whatever join Spark picks: small broadcast limits, joins changed while they run."""

from gazette.llm import repeats
from gazette.llm.op2_suffix_dedup import remove_repeated_bytes
from tests.llm.test_repeats import brute_bytes, corpus, frame

JOINS = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.maxPartitionBytes": "2k"}


def test_joins_that_begin_as_a_shuffle(spark, monkeypatch):
    rows = corpus(6)
    monkeypatch.setattr(repeats.repeated, "__defaults__", (2,))
    before = {k: spark.conf.get(k, None) for k in JOINS}
    try:
        for k, v in JOINS.items():
            spark.conf.set(k, v)
        got = remove_repeated_bytes(frame(spark, rows), window=40, anchor=16).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept))) for r in got) == sorted(map(repr, brute_bytes(rows, 40)))
