import random
import re
import zlib
from collections import Counter

import pytest

from gazette.llm.op13_spelling_variants import Tree, close_pairs, letter_counts, one_edit, spelling_variants, steps

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def edits(w, letters):
    for i in range(len(w) + 1):
        yield from (w[:i] + c + w[i:] for c in letters)
        if i < len(w):
            yield w[:i] + w[i + 1 :]
            yield from (w[:i] + c + w[i + 1 :] for c in letters if c != w[i])


def brute(docs):
    n = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(UPPER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    letters = sorted({c for w in n for c in w})
    out = {}
    for w in n:
        near = {x for x in edits(w, letters) if x in n and x != w}
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= 2 * n[w] else None
        out[w] = [form, None, n[w], len(near), n[form] if form else None]
    for w in out:
        end = w
        while out[end][0]:
            end = out[end][0]
        out[w][1] = end
    return {(w, *x) for w, x in out.items()}


def rows(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(seed, n_docs):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeéàßo") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    stems += ["".join(sorted(s)) for s in stems[:20]] + ["aaaaaaaaa", "x" * 300, "x" * 301, "x" * 299 + "y"]
    pool = stems + [x for s in stems for x in rng.sample(list(edits(s, "abé")), 6)]
    docs = [(i if rng.random() > 0.1 else None, " ".join(rng.choice(pool) if rng.random() < 0.8 else rng.choice(pool).upper() for _ in range(80)) + rng.choice(["", ".", "1", "×÷"])) for i in range(n_docs)]
    return docs + docs[:5] + [(7, None), (8, ""), (9, " 12 ... "), (10, "Verylong" * 3000)]


def test_one_edit():
    assert one_edit(b"color", b"colour") and one_edit(b"color", b"colon") and one_edit(b"aaaaa", b"aaaaaa")
    assert not one_edit(b"color", b"color") and not one_edit(b"abcde", b"bacde") and not one_edit(b"abcde", b"abxcdy")


def test_boxes_lose_no_neighbour():
    rng = random.Random(3)
    held = ["".join(rng.choice("abcd") for _ in range(6)).encode() for _ in range(400)]
    points = letter_counts(held)
    tree = Tree(points, 8, tight=True)
    at, points = steps(points), points.astype(int)
    for up, down in ((1, 1), (1, 0)):
        got = {(q, m) for leaf, hit in tree.reach(at, up, down) for q in hit for m in tree.leaves[leaf]}
        gap = points[None] - points[:, None]
        want = {(q, m) for q, m in zip(*((gap.clip(0).sum(2) <= up) & ((-gap).clip(0).sum(2) <= down)).nonzero())}
        assert want <= got
        assert want == {(q, m) for held, asking in close_pairs(at, at, down) for m, q in zip(held, asking)}


@pytest.mark.parametrize("sizes", [{}, {"sample": 120, "cell": 20, "held": 15, "asked": 10}, {"sample": 1, "cell": 1, "held": 7, "asked": 5}])
def test_brute_force(spark, sizes):
    docs = corpus(5, 60)
    df = spark.createDataFrame([(d, t, "extra") for d, t in docs], "doc_id long, text string, word string")
    want = brute(docs)
    assert sum(1 for x in want if x[1]) > 20
    assert rows(spelling_variants(df, **sizes)) == want


def test_empty(spark):
    assert rows(spelling_variants(spark.createDataFrame([], "doc_id long, text string"))) == set()


def test_one_word_in_a_third_of_all_runs(spark):
    docs = [(i, "common " * 40 + f"commun commun comon{'abc'[i % 3]} " * 20) for i in range(30)]
    assert rows(spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
