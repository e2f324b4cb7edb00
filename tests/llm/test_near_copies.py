import random
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

from gazette.llm import near_copies  # noqa: E402


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows):
    """The rows that stay, in order of id (null last), and the similar pairs."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets, root, pairs = [shingles(r[1]) for r in rows], list(range(len(rows))), 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            common = len(a & b)
            if 5 * common >= 4 * (len(a) + len(b) - common):
                pairs += rows[i][1] != rows[j][1]
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [r for i, r in enumerate(rows) if find(i) == i], pairs


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"W{rng.randrange(3000)}é"
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one two three four")]
    for i in range(60):
        words = [word() for _ in range(rng.choice([5, 40, 120, 300]))]
        rows.append((100 + 100 * i, " ".join(words)))
        for j in range(rng.randrange(9)):
            other = list(words)
            for _ in range(rng.randrange(1, 2 + len(words) // 30)):
                other[rng.randrange(len(other))] = word()
            rows.append((100 + 100 * i + j + 1, rng.choice([" ", "\t"]).join(other).swapcase() if j == 3 else " ".join(other)))
    words = [word() for _ in range(100)]
    for j in range(40):  # a large group, whose members are similar to some of the others only
        rows.append((9000 + j, " ".join([*words[: 100 - j], *(word() for _ in range(j))])))
    return [*rows, rows[9], rows[9], (None, rows[12][1])]


def test_matches_brute_force(spark, monkeypatch):
    for seed, rounds in ((1, 5), (2, 0)):
        monkeypatch.setattr(near_copies, "ROUNDS", rounds)
        rows = corpus(seed)
        want, pairs = brute(rows)
        assert pairs > 100 and 60 < len(want) < len(rows) - 50
        docs = spark.createDataFrame([(a, b, "c", 1) for a, b in rows], "doc_id long, text string, node string, root int").repartition(3)
        got = corpus_pipeline.near_duplicates(spark, docs, "")
        assert got.columns == docs.columns
        assert sorted(repr((r.doc_id, r.text)) for r in got.collect()) == sorted(map(repr, want))


def test_nothing_alike(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    assert near_copies.survivors(docs).count() == 2
    assert near_copies.survivors(docs.limit(0)).count() == 0


def pooled(n, seed=5):
    """Texts that each take 20 of 25 shared paragraphs: nearly all share bands, few are similar, no shingle is a text's own."""
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(5000)}" for _ in range(40)) for _ in range(25)]
    return [(i, "\n".join(pool[k] for k in sorted(rng.sample(range(25), 20)))) for i in range(n)]


def test_shared_paragraphs_do_not_make_all_pairs(spark, monkeypatch):
    tried, real = [], near_copies._linked
    monkeypatch.setattr(near_copies, "_linked", lambda pairs, sets: (tried.append(pairs.count()), real(pairs, sets))[1])
    counts = []
    for n in (200, 400):
        tried.clear()
        rows = pooled(n)
        want, pairs = brute(rows)
        assert pairs > n / 2 and len(want) < n
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(r.doc_id for r in near_copies.survivors(docs).collect()) == [r[0] for r in want]
        counts.append(sum(tried))
    assert counts[1] < 2.5 * counts[0] and counts[1] < 400 * 399 / 2 * 0.4


def test_parities_bound_the_difference():
    rng = near_copies.np.random.default_rng(3)
    for _ in range(200):
        every = near_copies.np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 3000)), dtype=near_copies.np.uint64))
        a, b = (near_copies.np.sort(every[rng.random(len(every)) < share]) for share in (0.9, rng.choice([0.2, 0.9])))
        if len(a) and len(b):
            assert near_copies.odds(near_copies.parities(a), near_copies.parities(b)) <= len(near_copies.np.setxor1d(a, b))


def test_a_band_that_many_texts_share(spark):
    """A third of the rows are one text, another third nearly so."""
    words = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join(words)) for i in range(300)] + [(300 + i, " ".join([*words[:190], f"x{i}"])) for i in range(300)] + [(600 + i, " ".join(f"{i}_{k}" for k in range(20))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.survivors(docs).collect()) == [0, *range(600, 900)]
