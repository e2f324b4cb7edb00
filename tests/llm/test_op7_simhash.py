import random
import re

import numpy as np
import xxhash

from gazette.llm.common import stored
from gazette.llm.components import components
from gazette.llm.kernels import xxh64_slices
from gazette.llm.op7_simhash import golay, keys_of, links, simhash_components


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_hashes_match_library():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(5000))
    begin = np.array([rng.randrange(4800) for _ in range(800)])
    end = np.array([b + n for b, n in zip(begin, [*range(160)] * 5)])
    got = xxh64_slices(np.frombuffer(data, dtype=np.uint8), begin, end, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip(begin, end)]


def test_golay_code_is_perfect():
    code = golay()
    words = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    near = words ^ code._errors[code.syndrome(words)]
    assert (code.syndrome(near) == 0).all() and np.bitwise_count(near ^ words).max() == 3
    row, _ = code.ball(words, 23)
    assert set(np.bincount(row)) == {1, 6}


def test_every_near_pair_shares_a_key():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, i % 4, replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    (row, key), _ = keys_of(a)
    _, (asked, want) = keys_of(b)
    held = set(zip(row.tolist(), key.tolist()))
    hit = {r for r, k in zip(asked.tolist(), want.tolist()) if (r, k) in held}
    assert hit == set(range(3000))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(-5, 7), (500, 500)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: -5 for i in [-5, *range(41)]}, **{i: 100 for i in range(100, 130)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_matches_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"W{i}é" for i in range(300)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "one TWO"), (6, "one two"), (None, "one two three four")]
    for i in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([5, 40, 400]))]
        rows.append((100 + 10 * i, " ".join(words)))
        for j in range(rng.randrange(4)):
            other = list(words)
            other[rng.randrange(len(other))] = "changed"
            rows.append((100 + 10 * i + j + 1, "\t".join(other)))
    rows += [rows[9], rows[9], (999, "x" * 5000 + " y z " + "x" * 70)]
    docs = spark.createDataFrame([(a, b, "c", 1) for a, b in rows], "doc_id long, text string, fp string, component_id int").repartition(3)
    got = sorted(repr((r.doc_id, r.fingerprint & (2**64 - 1), r.component_id)) for r in simhash_components(docs).collect())
    prints = [brute_fp(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    assert got == sorted(repr((d, prints[i], least.get(find(i)))) for i, (d, _) in enumerate(rows))
    assert sum(a != b for a, b in zip([d for d, _ in rows], [least.get(find(i)) for i in range(len(rows))])) > 10


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_components(docs).count() == 0
    assert links(spark.createDataFrame([(1,), (3,), (64 + 128,)], "fp long")).count() == 2


def test_keys_are_never_broadcast(spark):
    nodes = spark.createDataFrame([(i * 1_000_003,) for i in range(500)], "fp long")
    for threshold in ("10m", "-1"):
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            found = links(stored(nodes, "nodes"))
            found.collect()
            plan = found._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
