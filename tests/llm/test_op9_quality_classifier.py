import random
import zlib

import numpy as np

from gazette.llm.op9_quality_classifier import STATISTICS, Discriminant, classify, statistics


def corpus(n, seed=1):
    rng = random.Random(seed)
    prose = lambda: " ".join(rng.choice(["The", "river", "bank", "is", "near", "old,", "town.", "walks"]) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(5, 200)))
    junk = [lambda: " | ".join(prose().split()), lambda: prose().upper().replace(" ", "!! "), lambda: "same " * 60, lambda: prose().replace(" ", "%%% ")]
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        rows.append((i, prose() if good else rng.choice(junk)()))
        if rng.random() < 0.7:
            labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_folds(spark):
    rows, labels = corpus(600)
    wrong = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    docs = spark.createDataFrame([(a, b, "en", 0.5) for a, b in rows], "doc_id long, text string, lang string, score double")
    truth = {i: q for i, q, _ in labels}
    for taught in (labels, wrong):  # the held-out fold teaches nothing
        out = classify(docs, spark.createDataFrame(taught, "doc_id long, quality int, toxic int")).collect()
        assert len(out) == 600
        held = [r for r in out if r.held_out]
        assert {r.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
        known = [r for r in held if r.doc_id in truth]
        assert sum(r.predicted == truth[r.doc_id] for r in known) > 0.97 * len(known)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)


def test_odd_rows(spark):
    rows, labels = corpus(120)
    rows += [(1000, None), (1001, ""), (None, "x"), (1002, "w " * 50_000), (1003, "q" * 100_000), rows[0], rows[0]]
    labels += [(5000, 1, 0), (None, 0, 0), (3, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (1000, 1001)}) == 1
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in classify(docs, none).collect()} == {1.0}
    assert classify(docs.limit(0), none).count() == 0


def test_statistics_by_hand(spark):
    got = statistics(spark.createDataFrame([(1, "Aa aa aa! | b%\n7")], "doc_id long, text string")).first()
    want = {"words": np.log1p(6), "symbols": np.sqrt(1 / 6), "pipes": np.sqrt(1 / 6), "shouts": np.sqrt(1 / 6), "capitals": np.sqrt(1 / 7), "variety": 1.0, "echoes": 0.0, "stops": 0.0, "length": np.log1p(11 / 6), "digits": np.sqrt(1 / 6)}
    assert set(want) == set(STATISTICS)
    for k, v in want.items():
        assert abs(got[k] - v) < 1e-12, k


def test_densities_match_numpy():
    rng = np.random.default_rng(1)
    x = [rng.normal(size=(50, 3)), rng.normal(size=(80, 3)) * 2 + 1]
    covariances = [np.cov(a.T, bias=True) for a in x]
    model = Discriminant([50, 80], [a.mean(0) for a in x], covariances, shrink=0.0, ridge=0.0)
    scale = model.scale
    for k in (0, 1):
        c = covariances[k] / np.outer(scale, scale)
        d = (x[0] - x[k].mean(0)) / scale
        want = -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1])
        assert np.allclose(model.log_density(x[0], k), want)
