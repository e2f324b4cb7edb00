"""Needles that a worker can hold are found in one pass over each text; more of them by grams, with the same result."""

import random

import numpy as np

from gazette.operators import contains


def test_one_pass_and_grams_agree_with_a_loop(spark, monkeypatch):
    dice = random.Random(11)
    texts = ["".join(dice.choice("abc ç😀\x00") for _ in range(dice.randint(0, 40))) for _ in range(120)] + ["y" * 5000 + "abcab", None, "", "ab"]
    needles = [t[i : i + dice.randint(1, 9)] for t in texts if t for i in [dice.randrange(len(t))]] + ["abcab", "abcabc", "zz", "a", "", None]
    t, n = spark.createDataFrame([(x,) for x in texts], "t string"), spark.createDataFrame([(x,) for x in needles], "n string")
    want = {(a, b) for a in texts for b in needles if a and b and b in a}
    monkeypatch.setattr(contains, "_PIECE", 100)  # pieces end inside texts, and texts inside pieces
    one_pass = contains.contains_join(t, n, "t", "n")
    assert "Exchange hashpartitioning(gram" not in one_pass._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in one_pass.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.setattr(contains, "FEW", 10)
    assert {tuple(r) for r in contains.contains_join(t, n, "t", "n").collect()} == want


def test_needles_are_told_apart_at_their_rarest_gram():
    needles = [b"common" + bytes([97 + i]) * 4 for i in range(26)]
    data = np.frombuffer(b"common common commonzzzz", np.uint8)
    finder = contains._Finder(needles, data)
    ((_, _, keys, *_),) = finder.by_size
    assert len(keys) == 26
    assert [x.tolist() for x in finder.find(data, np.array([24]))] == [[0], [25]]
    # The same bytes as two texts: what begins in one and ends in the other is in neither.
    assert [x.tolist() for x in finder.find(data, np.array([18, 24]))] == [[], []]
    assert [x.tolist() for x in finder.find(data, np.array([14, 24]))] == [[1], [25]]


def test_periodic_texts_stay_bounded(monkeypatch):
    monkeypatch.setattr(contains, "_PIECE", 64)
    needles = [b"a" * i for i in range(1, 40)] + [b"a" * 20 + b"b"]
    data = np.frombuffer(b"a" * 500 + b"b", np.uint8)
    rows, which = contains._Finder(needles, data).find(data, np.array([10, 501]))
    assert sorted(zip(rows.tolist(), which.tolist())) == [(0, i) for i in range(10)] + [(1, i) for i in range(40)]
