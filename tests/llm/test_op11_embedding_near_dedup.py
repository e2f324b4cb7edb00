import math

import numpy as np
import pytest

from gazette.llm.op11_embedding_near_dedup import ORACLE_SQL, bucket_keys, codes, embedding_components, least_product, parts, plan, rotation, units
from tests.llm.helpers import oracle_rows, spark_rows

SCHEMA = "vec_id long, embedding array<float>, label int, u string, x string"


def brute(rows):
    ok = [k for k, r in enumerate(rows) if r[2] is not None and r[1] and all(c is not None and math.isfinite(c) for c in r[1]) and any(r[1])]
    links = {k: [] for k in range(len(rows))}
    for a, k in enumerate(ok):
        for m in ok[:a]:
            if rows[k][2] == rows[m][2] and len(rows[k][1]) == len(rows[m][1]):
                x, y = (np.array(rows[i][1], dtype=np.float32).astype(float) for i in (k, m))
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[k].append(m)
                    links[m].append(k)
    out, seen = [], {}
    for k in links:
        if k not in seen:
            todo, part = [k], {k}
            while todo:
                for m in links[todo.pop()]:
                    if m not in part:
                        part.add(m)
                        todo.append(m)
            least = min((rows[m][0] for m in part if rows[m][0] is not None), default=None)
            seen |= dict.fromkeys(part, least)
        out.append((rows[k][0], len(links[k]), seen[k], rows[k][0] == seen[k]))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def vectors(seed, n, dims=16, noise=0.09, centres=12):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, dims))
    rows = []
    for i in range(n):
        x = middle[rng.integers(centres)] / math.sqrt(dims) * 2 + rng.standard_normal(dims) * noise if rng.random() < 0.7 else rng.standard_normal(dims)
        rows.append((i, [float(v) for v in x.astype(np.float32)], int(rng.integers(3)), "a", "b"))
    return rows


ODD = [(900, None, 1, "", ""), (901, [], 1, "", ""), (902, [0.0] * 16, 1, "", ""), (903, [1.0] * 15 + [None], 1, "", ""), (904, [1.0] * 15 + [float("nan")], 1, "", ""), (905, [float("inf")] * 16, 1, "", "")]
ODD += [(906, [1.0] * 16, None, "", ""), (907, [1.0] * 16, None, "", ""), (None, [3.0] * 16, 2, "", ""), (None, [3.0] * 16, 2, "", ""), (908, [1.0, 2.0], 2, "", ""), (909, [2.0, 4.0], 2, "", ""), (910, [5.0], 1, "", ""), (911, [7.0], 1, "", ""), (912, [-7.0], 1, "", "")]
ODD += [(913, [1e30] * 16, 0, "", ""), (914, [1e-30] * 16, 0, "", "")]


@pytest.mark.parametrize("block", [1024, 24])
def test_brute_force(spark, block):
    rows = vectors(1, 400) + ODD
    rows += rows[5:9] + [(i + 1000, *rows[3][1:]) for i in range(20)]
    want = brute(rows)
    assert sum(r[1] > 0 for r in want) > 150 and any(r[2] != r[0] for r in want)
    assert got(embedding_components(spark.createDataFrame(rows, SCHEMA), block=block)) == want


def test_group_of_near_copies_over_many_chunks(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal(16)
    rows = [(i, [float(v) for v in (x + rng.standard_normal(16) * 0.05).astype(np.float32)], 1, "", "") for i in range(200)] + vectors(5, 100)[:100]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    want = brute(rows)
    assert got(embedding_components(spark.createDataFrame(rows, SCHEMA), block=16)) == want and max(r[1] for r in want) >= 190


def test_empty(spark):
    assert got(embedding_components(spark.createDataFrame([], SCHEMA))) == []


def test_sql(spark):
    import pandas as pd

    rows = [r for r in vectors(7, 150) + ODD if r[0] is not None]
    frame = pd.DataFrame([(r[0], r[1], r[2]) for r in rows], columns=["vec_id", "embedding", "label"]).astype({"label": "Int32"})
    import pyarrow as pa

    tab = pa.table({"vec_id": pa.array(frame.vec_id), "embedding": pa.array(list(frame.embedding), pa.list_(pa.float32())), "label": pa.array(frame.label)})
    assert spark_rows(embedding_components(spark.createDataFrame(rows, SCHEMA))) == oracle_rows(ORACLE_SQL, embeddings=tab)


@pytest.mark.parametrize("dims", [2, 16, 64, 512])
def test_bounds_hold_and_estimate_is_unbiased(dims):
    rng = np.random.default_rng(dims)
    unit = units(rng.standard_normal((2000, dims)))
    code, c = codes(unit)
    signs = (np.unpackbits(code, axis=1, count=dims) * 2.0 - 1) / math.sqrt(dims)
    assert np.allclose((signs * (unit @ rotation(dims, 0).T)).sum(axis=1), c)
    other = rng.standard_normal((2000, dims))
    other -= (other * unit).sum(axis=1, keepdims=True) * unit
    for cosine in (0.93, 0.97):
        q = cosine * unit + math.sqrt(1 - cosine**2) * units(other)
        product = ((q @ rotation(dims, 0).T) * signs).sum(axis=1)
        assert (product >= least_product(c, dims, 0.93, 8.0)).all()
        assert abs((product / c).mean() - cosine) < 0.02
    if dims >= 64:
        assert ((unit[:300] @ rotation(dims, 0).T) @ signs[300:].T >= least_product(c[300:], dims, 0.93, 8.0)).mean() < 0.01


@pytest.mark.parametrize("nodes", [5_000, 100_000, 10_000_000])
def test_pairs_at_the_threshold_meet_at_every_size(nodes):
    bits, tables = plan(nodes)
    rng = np.random.default_rng(3)
    a = units(rng.standard_normal((4000, 64)))
    side = rng.standard_normal((4000, 64))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * units(side)
    met = (bucket_keys(a, bits, tables) == bucket_keys(b, bits, tables)).any(axis=1)
    assert (~met).sum() <= 4


def test_parts():
    assert parts(6, np.array([4, 3]), np.array([3, 1])).tolist() == [0, 1, 2, 1, 1, 5]
