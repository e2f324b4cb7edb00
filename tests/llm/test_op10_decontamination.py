import random
import re

from gazette.llm.op10_decontamination import find_benchmark


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items, window):
    patterns = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            if item is not None:
                patterns.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for p, names in patterns.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    found |= names
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(map(repr, out))


def cases(seed):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "é1", "zz", "b2b", "ÄÖ", "x"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, line(rng.choice([1, 2, 3, 7, 12, 30])) + f" q{i % 9}") for i in range(30)] + [(50, ""), (51, "..."), (52, None), (None, "lone item"), (3, "same id other text"), (60, "the of"), (61, "The, OF")]
    rows = [(1, None), (2, ""), (3, "... --- ,"), (None, "lone item and the of")]
    for i in range(60):
        parts = [line(rng.randint(1, 40))] + [rng.choice(items)[1] or "" for _ in range(rng.randrange(3))]
        rng.shuffle(parts)
        rows.append((10 + i, rng.choice([" ", ", ", "\n"]).join(parts)))
    return rows + [rows[10], rows[10], (99, line(3000) + " " + items[5][1])], items


def test_matches_brute_force(spark):
    for seed, limit in ((1, 10**6), (2, 200)):
        rows, items = cases(seed)
        docs = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, items int, hits string").repartition(3)
        bench = spark.createDataFrame(items, "item_id long, text string")
        for window in (4, 10):
            got = find_benchmark(docs, bench, window=window, patterns=limit)
            got = sorted(repr((r.doc_id, r.n_words, sum(x.end - x.begin for x in r.hits), r["items"])) for r in got.collect())
            assert got == brute(rows, items, window)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.hits for r in find_benchmark(docs, none).collect()] == [[]]
    assert find_benchmark(docs.limit(0), none).count() == 0
