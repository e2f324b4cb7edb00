"""Runs of NUL bytes: spans that only differ in how many of them they end with are different spans."""

import random

from gazette.llm.op2_suffix_dedup import remove_repeated_bytes
from tests.llm.test_repeats import brute_bytes, frame


def test_spans_that_end_with_nul_bytes(spark):
    rng = random.Random(11)
    rows = []
    for k in range(12):
        head = "".join(rng.choice("abcdefgh ij") for _ in range(50))
        rows += [(10 * k + i, head + "\0" * (10 + 5 * i)) for i in range(3)] + [(10 * k + 5, "q" + head[12:] + "\0" * 30), (10 * k + 6, "\0" * (38 + k) + head[:3])]
    got = remove_repeated_bytes(frame(spark, rows), window=40, anchor=16).collect()
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept))) for r in got) == sorted(map(repr, brute_bytes(rows, 40)))
