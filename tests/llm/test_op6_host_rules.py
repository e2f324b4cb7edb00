import random
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from helpers import oracle_rows, spark_rows  # noqa: E402

from gazette.llm.op6_host_rules import ORACLE_SQL, host_rates, judge  # noqa: E402


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {p for i, t in enumerate(tri) if tri.count(t) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def corpus():
    rng = random.Random(1)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \x0b\n", None), (None, "é " * 60, None), (5, "a b c a b c", "b"), (6, "x\n\nx\n x\nx", "b"), (7, "a|b <c> #", "b"), (8, "w" * 20_000, "b")]
    for i in range(150):
        words = [rng.choice("abcdefgh") * rng.randint(1, 2) + (str(rng.randint(0, 99)) if i % 3 else "") for _ in range(rng.choice([10, 60, 200]))]
        rows.append((100 + i, rng.choice([" ", "\n", "\t \n"]).join(words), f"host{i % 5}" if i % 3 else "bad"))
    return rows + [rows[20], rows[20]]


def frame(spark, rows):
    return spark.createDataFrame([(a, b, c, 1, "x") for a, b, c in rows], "doc_id long, text string, source string, n_words int, host string").repartition(3)


def test_counts_and_oracle(spark):
    rows = corpus()
    out = judge(frame(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in out.collect())
    assert got == sorted(repr((d, *brute(t))) for d, t, _ in rows)
    import pandas as pd

    docs = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    assert spark_rows(out) == oracle_rows(ORACLE_SQL, documents=docs)
    kept = {r.kept for r in out.collect()}
    assert kept == {True, False}


def test_shrinkage(spark):
    base = [("big", i % 10 == 0) for i in range(400)] + [("other", i % 8 == 0) for i in range(400)] + [("worse", i % 2 == 0) for i in range(400)] + [("tiny", True)]
    rates = {r.host: r for r in host_rates(spark.createDataFrame(base, "host string, base_failed boolean")).collect()}
    assert 0.09 < rates["big"].rate < 0.12 and 0.47 < rates["worse"].rate < 0.5
    assert rates["tiny"].rate < 0.7  # one document of one host doesn't make a rate of 1


def test_empty(spark):
    assert judge(frame(spark, [])).count() == 0
