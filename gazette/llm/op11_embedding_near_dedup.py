"""Embedding near-dedup with randomised-rotation binary codes.

A unit vector o is turned by a random rotation; the signs of its coordinates, divided by the root of their number, are its code, a unit
vector too. The code is stored with its correction factor c, the inner product of code and vector. For any unit vector q, (code . q) / c
estimates o . q without bias: the code is c * o and a remainder of random direction, of length sqrt(1 - c * c), at right angles to o. Only
the part of q at right angles to o meets that remainder, so

    |code . q - c * (o . q)| <= sqrt(1 - c * c) * sqrt(1 - (o . q)^2) * f

for certain with f = 1, and with a confidence bound f = CONFIDENCE / sqrt(dimensions - 1) where that is less: it fails for a pair with
probability 2 * exp(-CONFIDENCE^2 / 2) at most, 3e-14. A pair whose upper bound is below the threshold is settled; all others are
recomputed in double precision from the vectors, so no link is below the threshold.

* Equal vectors of a label are one node (with a count), folded before any shuffle. A group of copies of any size costs one row.
* Nodes of one label meet in blocks of ``BLOCK`` rows at most. While a label has no more nodes than a block, all of them meet. Beyond, signs
  of further rotations deal the nodes to buckets, in as many tables as it takes to part a pair at the threshold in all of them with
  probability ``MISS`` at most, whatever the number of nodes; closer pairs are missed more rarely still. So work grows as the number of
  nodes to the power of about 1.2, not with its square.
* A bucket above a block (near copies that all meet) is cut into chunks, and each pair of chunks is a task of its own.
* A pair counts in the first table in which it meets. No pair leaves a block: a block returns, for each node, how many vectors it links
  with there, and one link to the least node of its part. These make counts and components.

Cases: a null label, and a null, empty or zero vector, one with a null or non-finite component or of another length link with nothing (the
last with those of its own length only) and are their own component; a null id takes part but is never the least, and a component of null
ids has a null id; repeated rows are vectors of their own; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.common import stored, table
from gazette.llm.components import components

COSINE, CONFIDENCE, MISS, BLOCK, SEED = 0.93, 8.0, 1e-4, 1_024, 11
#: Pairs whose vectors are gathered at a time.
_PAIRS = 16_384


@functools.lru_cache(maxsize=64)
def rotation(dims: int, number: int) -> np.ndarray:
    """A random rotation, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dims, number]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated vectors, and the correction factors."""
    turned = unit @ rotation(unit.shape[1], 0).T
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])


def least_product(c: np.ndarray, dims: int, cosine: float, confidence: float) -> np.ndarray:
    """The least inner product with a code of correction factor c that leaves a chance of a cosine."""
    f = min(1.0, confidence / math.sqrt(dims - 1)) if dims > 1 else 1.0
    return c * cosine - f * np.sqrt(np.maximum(0, 1 - c * c)) * math.sqrt(max(0.0, 1 - cosine * cosine)) - 1e-9


def plan(largest: int, cosine: float = COSINE, miss: float = MISS, block: int = BLOCK) -> tuple[int, int]:
    """(bits of a bucket's key, tables) for labels of up to ``largest`` nodes."""
    bits = max(0, math.ceil(math.log2(max(1, largest) / block)))
    if not bits:
        return 0, 1
    meets = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - meets))


def bucket_keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables): signs of further rotations, ``bits`` for each table."""
    dims = unit.shape[1]
    if not bits:
        return np.zeros((len(unit), tables), dtype=np.int64)
    need = math.ceil(bits * tables / dims)
    signs = np.concatenate([unit @ rotation(dims, 1 + i).T >= 0 for i in range(need)], axis=1)[:, : bits * tables]
    return (signs.reshape(len(unit), tables, bits) << np.arange(bits)).sum(axis=2)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _encoded(bits: int, tables: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy()
            for dims in np.unique(size):
                part = batch.filter(pa.array(size == dims))
                for at in range(0, len(part), 2048):
                    own = part.slice(at, 2048)
                    unit = units(_matrix(own.column("x")))
                    code, c = codes(unit)
                    keys = bucket_keys(unit, bits, tables)
                    lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), pa.array(keys.ravel().astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array([r.tobytes() for r in code], pa.binary()), pa.array(c), lists], names=[*own.schema.names, "code", "c", "keys"])

    return run


def parts(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each one's part of the graph of links (i, j) over n nodes."""
    least = np.arange(n)
    while len(i):
        before = least.copy()
        np.minimum.at(least, i, before[j])
        np.minimum.at(least, j, before[i])
        least = least[least]
        if (least == before).all():
            break
    return least


def linked(x: np.ndarray, code: np.ndarray, c: np.ndarray, keys: np.ndarray, at: int, side: np.ndarray | None, cosine: float, confidence: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a block with the cosine or more that did not meet in a table before ``at``: rows of side 0 with those of side 1, or
    without sides all with each other."""
    unit, dims = units(x), x.shape[1]
    turned = unit @ rotation(dims, 0).T
    signs = np.unpackbits(code, axis=1, count=dims) * 2.0 - 1
    asking, held = (np.arange(len(x)),) * 2 if side is None else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    need = least_product(c[held], dims, cosine, confidence) * math.sqrt(dims)
    first, second = [], []
    for start in range(0, len(asking), 256):
        rows = asking[start : start + 256]
        chance = turned[rows] @ signs[held].T >= need
        if side is None:
            chance &= held[None] > rows[:, None]
        a, b = np.nonzero(chance)
        for some in range(0, len(a), _PAIRS):
            i, j = rows[a[some : some + _PAIRS]], held[b[some : some + _PAIRS]]
            ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
            ok[ok] = ~(keys[i[ok], :at] == keys[j[ok], :at]).any(axis=1)
            first.append(i[ok])
            second.append(j[ok])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
    return join(first), join(second)


def _block(cosine: float, confidence: float) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        u, n, side = (group.column(k).to_numpy() for k in ("u", "n", "side"))
        code = np.frombuffer(b"".join(group.column("code").to_pylist()), dtype=np.uint8).reshape(len(u), -1)
        order = np.argsort(u, kind="stable")  # the least row of a part is its least node
        pick = lambda a: a[order]
        same = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        u, n, side = pick(u), pick(n), None if same else pick(side)
        i, j = linked(pick(_matrix(group.column("x"))), pick(code), pick(group.column("c").to_numpy()), pick(_matrix(group.column("keys"))), group.column("at")[0].as_py(), side, cosine, confidence)
        count = np.bincount(i, n[j], len(u)) + np.bincount(j, n[i], len(u))
        some = np.flatnonzero(count)
        return pa.table({"u": u[some], "links": count[some].astype(np.int64), "v": u[parts(len(u), i, j)[some]]})

    return run


def nodes_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): (id, label, size, h1, h2) of every row, label null where it links with nothing; distinct vectors with count and least id."""
    finite = lambda x: x.isNotNull() & (F.abs(x) < float("inf"))  # noqa: E731  NaN is above all numbers
    base = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].alias("label"), vectors[vector_col].alias("x"))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("x") > 0) & F.forall("x", finite) & F.exists("x", lambda x: x != 0), F.lit(False))
    base = base.withColumn("label", F.when(usable, F.col("label"))).withColumn("size", F.size("x")).withColumn("h1", F.xxhash64("x")).withColumn("h2", F.xxhash64(F.lit("second"), "x"))
    name = ["label", "size", "h1", "h2"]
    grouped = base.filter("label is not null").groupBy(*name).agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return base.select("id", *name), grouped.select(F.monotonically_increasing_id().alias("u"), *name, "x", "n", "first")


def near_links(nodes: DataFrame, cosine: float = COSINE, confidence: float = CONFIDENCE, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """(u, links, v): from each block, how many vectors of other nodes a node links with, and the least node of its part there."""
    largest = nodes.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(largest, cosine, miss, block)
    kind = nodes.schema["x"].dataType.simpleString()
    label = nodes.schema["label"].dataType.simpleString()
    own = nodes.select("u", "label", "size", "x", "n")
    coded = stored(own.mapInArrow(_encoded(bits, tables), f"u long, label {label}, size int, x {kind}, n long, code binary, c double, keys array<int>"), "codes")
    met = coded.select("*", F.posexplode("keys").alias("at", "bucket"))
    sizes = met.groupBy("label", "size", "at", "bucket").agg(F.count(F.lit(1)).alias("members"))
    # Stored first: the join may then split a bucket that holds many rows.
    many = stored(sizes.filter(F.col("members") > block).withColumn("chunks", F.ceil(F.col("members") * 2 / block).cast("int")).drop("members"), "buckets")
    cut = met.join(many, ["label", "size", "at", "bucket"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("u"), F.col("chunks")).cast("int")
    dealt = cut.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).withColumn("side", (F.col("mine") > F.col("other")).cast("int"))
    # A pair of chunks gets side 0 from the lesser and side 1 from the greater chunk.
    rows = dealt.select("label", "size", "at", "bucket", "i", "j", "side", "u", "n", "x", "code", "c", "keys")
    return rows.groupBy("label", "size", "at", "bucket", "i", "j").applyInArrow(_block(cosine, confidence), "u long, links long, v long")


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, confidence: float = CONFIDENCE, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows, nodes = nodes_of(vectors, id_col, vector_col, label_col)
    nodes = stored(nodes, "nodes")
    found = stored(near_links(nodes, cosine, confidence, miss, block), "links")
    counts = found.groupBy("u").agg(F.sum("links").alias("links"))
    rooted = components(found.select("u", "v"))
    named = nodes.select("u", "first").join(rooted, F.col("u") == F.col("node"), "left").withColumn("root", F.coalesce("root", "u"))
    least = stored(named.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    placed = named.join(least, "root").select("u", "component_id")
    name = ["label", "size", "h1", "h2"]
    labels = stored(nodes.select("u", *name, "n").join(counts, "u", "left").join(placed, "u").select(*name, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "labels")
    out = rows.join(labels, name, "left")
    alone = F.col("n_links").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE ok AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.x) = len(b.x) AND a.r <> b.r WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least ON vec_id = least.a LEFT JOIN n ON vec_id = n.a
"""
