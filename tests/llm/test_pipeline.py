import random
import re
import sys
import tempfile
from pathlib import Path

import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline  # noqa: E402
from test_near_copies import brute as near_brute  # noqa: E402
from test_near_copies import shingles  # noqa: E402
from test_op7_simhash import brute_fp  # noqa: E402
from test_op10_decontamination import brute as leaks  # noqa: E402
from test_repeats import brute_words  # noqa: E402

from gazette.llm import op9_quality_classifier as op9  # noqa: E402


def corpus():
    rng = random.Random(7)
    vocabulary = [f"{a}{b}" for a in ("riv", "ban", "tow", "wal", "sto", "hea") for b in ("er", "k", "n", "ks", "ry", "th", "ing", "ed")]
    prose = lambda n: " ".join(rng.choice(vocabulary).capitalize() if i % 9 == 0 else rng.choice(vocabulary) for i in range(n)) + "."
    passages = [prose(60) for _ in range(3)]
    items = [(i, prose(14)) for i in range(6)]
    rows, labels = [], []
    for i in range(160):
        kind = rng.random()
        text = prose(rng.randint(30, 120)) if kind < 0.75 else " | ".join(prose(40).split()) if kind < 0.9 else "again " * 80
        if kind < 0.75 and i % 6 == 0:
            text += "\n" + rng.choice(passages) + "\n" + prose(20)
        if kind < 0.75 and i % 11 == 0:
            text += " " + rng.choice(items)[1]
        rows.append((i, text, "en", f"src{i % 3}"))
        labels.append((i, int(kind < 0.75), 0))
    rows += [(200 + i, rows[i][1], "en", "copy") for i in range(12)]
    for i, r in enumerate([r for r in rows if len(r[1].split()) > 70 and "|" not in r[1] and "again" not in r[1]][:20]):
        words = r[1].split()
        words[30 : 31 + i % 2] = ["riverbank"] * (1 + i % 2)  # similar by five-word shingles, further apart than three bits
        rows.append((400 + i, " ".join(words), "en", "edited"))
    rows += [(300, None, None, None), (None, rows[3][1], "en", "x"), rows[5], rows[5], (301, "", "en", "x")]
    return [(*r, len(r[1] or "")) for r in rows], labels, items


def test_run_matches_brute_force(spark):
    rows, labels, items = corpus()
    folder = tempfile.mkdtemp(prefix="spark-")
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"}).to_parquet(f"{folder}/documents.parquet")
    pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).to_parquet(f"{folder}/labels.parquet")
    pd.DataFrame(items, columns=["item_id", "text"]).to_parquet(f"{folder}/benchmark.parquet")

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in op9.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    left = [r for r in rows if scores[r[0]]]
    assert 100 < len(left) < len(rows) - 15
    stages = dict(corpus_pipeline.STAGES)
    got = stages["quality"](spark, docs, folder)
    assert got.schema == docs.schema and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, left))

    one, pairs = near_brute(left)
    sets = [(shingles(r[1]), brute_fp(r[1])) for r in left]
    far = [(x ^ y).bit_count() for i, (a, x) in enumerate(sets) for b, y in sets[:i] if 5 * len(a & b) >= 4 * len(a | b)]
    assert pairs > 15 and sum(4 <= bits <= 18 for bits in far) > 5
    near = stages["near_duplicates"](spark, got, folder)
    assert near.columns == docs.columns and sorted(map(repr, map(tuple, near.collect()))) == sorted(map(repr, one))

    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    kept = {d: k for d, _, _, k in brute_words([(r[0], r[1]) for r in one], 20)}
    cut = stages["repeated_passages"](spark, near, folder)
    assert cut.columns == docs.columns
    shortened = cut.collect()
    assert {r.doc_id: " ".join(words(r.text)) for r in shortened} == kept and all(r.n_chars == len(r.text) for r in shortened)
    assert sum(len(words(r.text)) for r in shortened) < sum(len(words(r[1])) for r in one)
    source = {r[0]: r[3] for r in one}
    assert all(r.source == source[r.doc_id] for r in shortened)

    hit = leaks([(r.doc_id, r.text) for r in shortened], items, 10)
    clean = [r for r in shortened if repr((r.doc_id, len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower())), 0, [])) in hit]
    assert 0 < len(clean) < len(shortened)
    assert sorted(r.doc_id for r in stages["benchmark_leaks"](spark, cut, folder).collect()) == sorted(r.doc_id for r in clean)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in clean}
    out = corpus_pipeline.run(spark, folder)
    assert {r.doc_id: list(r.ids) for r in out.collect()} == want


def test_extra_and_missing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c " * 20, "x", 1, "r"), (2, None, None, None, None)], "doc_id long, text string, rest string, d int, `odd name.x` string")
    folder = tempfile.mkdtemp(prefix="spark-")
    pd.DataFrame({"doc_id": [1], "quality": [1], "toxic": [0]}).to_parquet(f"{folder}/labels.parquet")
    pd.DataFrame({"item_id": [1], "text": ["none of these"]}).to_parquet(f"{folder}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "rest", "d", "odd name.x"]
    assert docs.count() == 2


def test_empty_tables(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    frames = {
        "documents": pd.DataFrame({"doc_id": [1], "text": ["a b c"], "lang": ["en"], "source": ["s"], "n_chars": [5]}),
        "labels": pd.DataFrame({"doc_id": [1], "quality": [1], "toxic": [0]}),
        "benchmark": pd.DataFrame({"item_id": [1], "text": ["none of these"]}),
    }
    for name, frame in frames.items():
        frame.iloc[:0].astype(frame.dtypes).to_parquet(f"{folder}/{name}.parquet")
    docs = spark.createDataFrame([(1, "a b c " * 20, "en", "s", 120), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.run(spark, folder).count() == 0
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == 2, name
