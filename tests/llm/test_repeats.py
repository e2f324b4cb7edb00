import hashlib
import random
import re

from gazette.llm import repeats
from gazette.llm.op2_suffix_dedup import remove_repeated_bytes
from gazette.llm.op5_substring_dedup import remove_repeated_words

SCHEMA = "doc_id long, text string, lang string, d string, t string, runs string"


def brute_bytes(rows, window):
    seen = {}
    for i, (_, text) in enumerate(rows):
        b = (text or "").encode()
        for s in range(len(b) - window + 1):
            seen.setdefault(b[s : s + window], []).append((i, s))
    hit = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                hit[i].update(range(s, s + window))
    out = []
    for i, (doc, text) in enumerate(rows):
        b = (text or "").encode()
        spans = sum(1 for p in hit[i] if p - 1 not in hit[i])
        out.append((doc, len(b), len(hit[i]), spans, bytes(x for p, x in enumerate(b) if p not in hit[i])))
    return out


def brute_words(rows, window):
    first = {}
    words = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    for i, (doc, _) in enumerate(rows):
        for s in range(len(words[i]) - window + 1):
            key = tuple(words[i][s : s + window])
            at = (-1 if doc is None else doc, s)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, (doc, _) in enumerate(rows):
        gone = set()
        for s in range(len(words[i]) - window + 1):
            if first[tuple(words[i][s : s + window])] != (-1 if doc is None else doc, s):
                gone.update(range(s, s + window))
        out.append((doc, len(words[i]), len(gone), " ".join(w for p, w in enumerate(words[i]) if p not in gone)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gämma", "de", "é", "zz z", "Ω"]
    passage = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(4)]
    rows = [(1, None), (2, ""), (3, "   \n\t "), (None, "one two three " * 9), (4, "aaaa" * 60), (5, "aaaa" * 60), (6, "ab" * 100)]
    for i in range(60):
        text = " \n".join(rng.choice([rng.choice(passage), " ".join(rng.choice(words) + str(rng.randint(0, 50)) for _ in range(rng.randint(1, 40)))]) for _ in range(rng.randint(1, 5)))
        rows.append((100 + i, text))
    rows += [(200, rows[20][1]), (201, rows[20][1] + " x"), (202, "y " + rows[20][1]), rows[30], rows[30]]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "en", "clash", "clash", "clash") for a, b in rows], SCHEMA).repartition(5)


def test_bytes_match_brute_force(spark, monkeypatch):
    for seed, group in ((1, 64), (2, 2)):
        rows = corpus(seed)
        monkeypatch.setattr(repeats, "GROUP", group)
        monkeypatch.setattr(repeats.repeated, "__defaults__", (1, group))
        got = remove_repeated_bytes(frame(spark, rows), window=40, anchor=16).collect()
        assert sorted((repr((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept))) for r in got)) == sorted(map(repr, brute_bytes(rows, 40)))


def test_words_match_brute_force(spark, monkeypatch):
    for seed, group in ((3, 64), (4, 2)):
        rows = corpus(seed)
        monkeypatch.setattr(repeats.repeated, "__defaults__", (1, group))
        got = remove_repeated_words(frame(spark, rows), window=6, anchor=3).collect()
        assert sorted((repr((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in got)) == sorted(map(repr, brute_words(rows, 6)))
        for r in got:
            assert re.findall(r"[^\x20\x09-\x0D]+", r.text) == re.findall(r"[^\x20\x09-\x0D]+", r.kept)


def test_pieces_of_long_texts(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(repeats, "PIECE", 64)
    rng = random.Random(5)
    text = " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 999)) for _ in range(600))
    unit = repeats.Unit("words", 6, 3)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"d": [1], "t": [1], "text": [text]})
    spans = [r for b in repeats._spans(unit)([batch]) for r in b.to_pylist()]
    starts = sorted(s for r in spans for s in range(r["lo"], r["hi"] + 1))
    assert starts == list(range(600 - 6 + 1))
    assert np.unique([r["a"] for r in spans]).size > 50


def test_empty_table(spark):
    assert remove_repeated_bytes(frame(spark, []), window=40, anchor=16).count() == 0
    assert remove_repeated_words(frame(spark, [])).count() == 0


def test_digest_is_of_bytes():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
