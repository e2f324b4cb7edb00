"""Hard-negative mining with STR-packed R-trees.

Vectors become whole numbers, floor(256 * x). Each anchor has positives, its best rows of the same label, and each positive's score gives a
window; its hard negatives are the best rows of other labels whose score lies inside.

* Spark sorts all rows by range on the first coordinate (the first level of sort-tile-recursive packing) and cuts them into slabs of
  ``SLAB`` rows; every row is in one slab. Inside a slab the packing goes on over the other coordinates, the widest first.
* Anchors come in groups of ``GROUP``. Every slab meets every group of anchors in a task of its own, so that no task holds more than one of
  each. Up to GROUP anchors the slabs are moved once.
* Minimum bounding boxes give, coordinate by coordinate, an interval of the inner product: both ends are sums of products with the box's
  corners. A queue yields boxes with the highest upper end first. For each search a box is skipped if its interval misses the window or its
  upper end lies strictly below the search's k-th score so far (equal scores may still win by a smaller id). Rows of opened leaves are scored.
* Each slab answers with at most k rows a search; Spark keeps the first k of all slabs, each task its own first.

Searches are exact: no row and no box is dropped by estimate.

Cases: rows with a null label, a null or empty vector or a null or non-finite component take no part; vectors of different lengths don't
meet; a null id is no anchor, counts last in ties and is returned as null; repeated rows are rows of their own (a copy of the anchor is
another row); an anchor without positives, or a window without rows, gives no row; empty tables give none; other columns are not read.
A score that a
long can't hold stops the job with an error.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gazette.llm.common import stored, table

SCALE, EVERY, RELABEL, LABELS = 256, 50, 7, 10
POSITIVES, NEGATIVES, FROM, TO = 5, 3, 50, 95
#: Rows of a slab and anchors of a group; rows of a leaf and children of an inner box; anchors that share a queue.
SLAB, GROUP, LEAF, FANOUT, TOGETHER = 4_096, 8_192, 64, 8, 512
LAST = np.iinfo(np.int64).max


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(row, id, label, v): rows that take part, with a number of their own, relabelled, as whole numbers."""
    finite = lambda x: x.isNotNull() & (F.abs(x) < float("inf"))  # noqa: E731  NaN is above all numbers
    some = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("long").alias("label"), vectors[vector_col].cast("array<double>").alias("x"))
    some = some.filter(F.col("label").isNotNull() & (F.size("x") > 0) & F.forall("x", finite))
    label = F.when(F.col("id") % RELABEL == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    whole = F.transform("x", lambda x: F.floor(x * SCALE).cast("long"))
    return some.select(F.monotonically_increasing_id().alias("row"), "id", label.alias("label"), whole.alias("v"))


def _cut(slab: int) -> Callable:
    """Slabs of consecutive rows: a number for each, unique through the number of its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, dims, number = 0, None, None
        for batch in batches:
            sizes, rows = batch.column("size").to_numpy(), batch.column("row").to_numpy()
            out = np.empty(len(batch), dtype=np.int64)
            for i in range(len(batch)):
                if left == 0 or sizes[i] != dims:
                    left, dims, number = slab, sizes[i], rows[i]
                out[i] = number
                left -= 1
            yield pa.RecordBatch.from_arrays([pa.array(out), *batch.columns], names=["slab", *batch.schema.names])

    return run


def slabs(rows: DataFrame, slab: int = SLAB) -> DataFrame:
    """rows and their slab: sorted by range on the length, the first coordinate and then the second; equal vectors may be split anywhere."""
    sized = rows.withColumn("size", F.size("v"))
    parts = max(1, math.ceil(rows.count() / (4 * slab)))
    order = ["size", F.col("v")[0], F.get("v", F.lit(1)), "row"]
    dealt = sized.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stored(dealt.mapInArrow(_cut(slab), "slab long, row long, id long, label long, v array<long>, size int"), "slabs")


class RTree:
    """A static R-tree packed by sort-tile-recursive: slices of equal size along one coordinate after another."""

    def __init__(self, v: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        #: Coordinates by falling spread: the first slices part what differs most.
        self._v, self._order = v, np.argsort(-v.var(axis=0, dtype=np.float64), kind="stable")
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray | None] = []
        level = [self._add(v[r].min(axis=0), v[r].max(axis=0), [], r) for r in self._tiles(np.arange(len(v)), 0, leaf)]
        while len(level) > 1:
            groups = [level[i : i + fanout] for i in range(0, len(level), fanout)]
            level = [self._add(np.min([self.boxes[c][0] for c in g], axis=0), np.max([self.boxes[c][1] for c in g], axis=0), g, None) for g in groups]
        self.root = level[0]
        self.lo, self.hi = (np.array([b[i] for b in self.boxes], dtype=np.float64) for i in (0, 1))

    def _add(self, lo, hi, children, rows) -> int:
        self.boxes.append((lo, hi))
        self.children.append(children)
        self.rows.append(rows)
        return len(self.boxes) - 1

    def _tiles(self, rows: np.ndarray, depth: int, leaf: int) -> Iterator[np.ndarray]:
        if len(rows) <= leaf:
            yield rows
            return
        left = len(self._order) - depth
        tiles = math.ceil(len(rows) / leaf)
        slices = tiles if left <= 1 else max(2, math.ceil(tiles ** (1 / left)))
        step = math.ceil(math.ceil(tiles / slices)) * leaf
        along = rows[np.argsort(self._v[rows, self._order[min(depth, len(self._order) - 1)]], kind="stable")]
        for at in range(0, len(along), step):
            yield from self._tiles(along[at : at + step], depth + 1, leaf)

    def interval(self, anchors: np.ndarray, nodes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each anchor with each box, as floats that err outwards."""
        up, down = np.maximum(anchors, 0).astype(np.float64), np.minimum(anchors, 0).astype(np.float64)
        lo, hi = self.lo[nodes].T, self.hi[nodes].T
        reach = (up - down) @ np.maximum(np.abs(lo), np.abs(hi))
        slack = reach * 1e-12
        return up @ lo + down @ hi - slack, up @ hi + down @ lo + slack


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)  # raises if a score is no long


def search(tree: RTree, v: np.ndarray, ids: np.ndarray, may: Callable, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, window, row of v, score): the first k rows by (score, smaller id) of each anchor and window low <= score <= high.

    ``may(anchors, rows)`` says which pairs count. Windows are (anchors, n); an empty one has low > high.
    """
    n, w = low.shape
    score = np.full((n, w, k), -LAST)
    best = np.full((n, w, k), -1)
    kth = np.where(low <= high, low, LAST)  # the score that a row must reach; equal scores compete by id
    everyone = np.arange(n)
    least, most = tree.interval(anchors, [tree.root])
    queue = [(-float(most.max()), tree.root, least[:, 0], most[:, 0])] if n else []
    while queue:
        _, node, least, most = heapq.heappop(queue)
        # A window needs the box if its interval meets it and reaches the k-th score.
        open_ = ((most[:, None] >= kth) & (least[:, None] <= high)).any(axis=1)
        who = everyone[open_]
        if not len(who):
            continue
        if tree.rows[node] is None:
            below = tree.children[node]
            lows, highs = tree.interval(anchors[who], below)
            for c, child in enumerate(below):
                least, most = np.full(n, np.inf), np.full(n, -np.inf)
                least[who], most[who] = lows[:, c], highs[:, c]
                heapq.heappush(queue, (-float(highs[:, c].max()), child, least, most))
            continue
        rows = tree.rows[node]
        found = scores(anchors[who], v[rows])
        allowed = may(who, rows)
        for t in range(w):
            hit = allowed & (found >= kth[who, t][:, None]) & (found <= high[who, t][:, None])
            a, r = np.nonzero(hit)
            if not len(a):
                continue
            touched = np.unique(a)
            mine = who[touched]
            # The rows found so far and the new ones, each anchor's best k.
            old_a, old_k = np.nonzero(best[mine, t] >= 0)
            owner = np.concatenate([mine[old_a], who[a]])
            row = np.concatenate([best[mine, t][old_a, old_k], rows[r]])
            value = np.concatenate([score[mine, t][old_a, old_k], found[a, r]])
            order = np.lexsort((row, ids[row], -value, owner))
            owner, row, value = owner[order], row[order], value[order]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            place = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
            keep = place < k
            best[owner[keep], t, place[keep]], score[owner[keep], t, place[keep]] = row[keep], value[keep]
            full = score[mine, t, k - 1]
            kth[mine, t] = np.where(best[mine, t, k - 1] >= 0, np.maximum(full, kth[mine, t]), kth[mine, t])
    a, t, place = np.nonzero(best >= 0)
    yield a, t, best[a, t, place], score[a, t, place]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _positives(k: int) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        out = [(a, r, s) for a, _, r, s in _searched(group, k, lambda label, own: label == own, lambda part: (np.full((part.num_rows, 1), -LAST), np.full((part.num_rows, 1), LAST)))]
        return pa.table({"anchor": _join(out, 0, "row"), "positive": _join(out, 1, "row"), "positive_id": _join(out, 1, "id"), "positive_score": _join(out, 2)})

    return run


def _join(parts: list, at: int, field: str | None = None) -> pa.Array:
    """One column of all parts; anchors and rows come as tables."""
    if not parts:
        return pa.array([], pa.int64())
    return pa.chunked_array([(p[at].column(field).combine_chunks() if field else pa.array(p[at], pa.int64())) for p in parts]).combine_chunks()


def _negatives(k: int) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        def windows(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            low, high = _padded(part.column("low"), LAST), _padded(part.column("high"), -LAST)
            return low, high

        out = [(a, t, r, s) for a, t, r, s in _searched(group, k, lambda label, own: label != own, windows)]
        return pa.table({"anchor": _join(out, 0, "row"), "turn": _join(out, 1), "negative": _join(out, 2, "row"), "negative_id": _join(out, 2, "id"), "negative_score": _join(out, 3)})

    return run


def _padded(column: pa.ChunkedArray, fill: int) -> np.ndarray:
    lists = column.to_pylist()
    width = max(map(len, lists), default=0)
    return np.array([x + [fill] * (width - len(x)) for x in lists], dtype=np.int64).reshape(len(lists), width)


def _searched(group: pa.Table, k: int, same: Callable, windows: Callable) -> Iterator[tuple]:
    """(anchors found, window, rows found, score) as tables and arrays, for a slab (asks = false) and a group of anchors (asks = true)."""
    asks = group.column("asks").to_numpy()
    held, asking = group.filter(pa.array(~asks)), group.filter(pa.array(asks))
    if not held.num_rows or not asking.num_rows:
        return
    v, label, row = _matrix(held.column("v")), held.column("label").to_numpy(), held.column("row").to_numpy()
    ids = held.column("id").fill_null(LAST).to_numpy()
    tree = RTree(v)
    for at in range(0, asking.num_rows, TOGETHER):
        part = asking.slice(at, TOGETHER)
        own_label, own_row = part.column("label").to_numpy(), part.column("row").to_numpy()
        may = lambda a, r, l=own_label, w=own_row: same(label[r][None], l[a][:, None]) & (row[r][None] != w[a][:, None])  # noqa: E731, E741
        low, high = windows(part)
        for a, t, r, s in search(tree, v, ids, may, _matrix(part.column("v")), low, high, k):
            yield part.take(pa.array(a)), t, held.take(pa.array(r)), s


def _share(percent: int, up: int) -> Column:
    """percent * positive_score / 100, rounded down (up = 0) or up (99), in whole numbers: p = 100 * a + b with b from 0 to 99."""
    b = "pmod(positive_score, 100)"
    return F.expr(f"(positive_score - {b}) div 100 * {percent} + ({percent} * {b} + {up}) div 100")


def _met(held: DataFrame, anchors: DataFrame, group: int, windows: bool) -> DataFrame:
    """Rows of slabs and of groups of anchors, every pair of them under a key of its own (slab, part)."""
    groups = max(1, math.ceil(anchors.count() / group))
    lists = ["low", "high"] if windows else []
    none = [F.lit(None).cast("array<long>").alias(c) for c in lists]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = held.select("slab", every(groups).alias("part"), F.lit(False).alias("asks"), "row", "id", "label", "v", *none)
    grid = stored(held.groupBy("slab").agg(F.first("size").alias("size")), "grid")
    # Anchors meet the numbers of slabs, a thousand at a time, so that no key of the join holds more than one group and one bin.
    bins = max(1, math.ceil(grid.count() / 1_000))
    grid = grid.select("slab", "size", F.pmod(F.xxhash64("slab"), F.lit(bins)).cast("int").alias("bin"), every(groups).alias("part"))
    part = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")
    asking = anchors.select(part.alias("part"), F.size("v").alias("size"), every(bins).alias("bin"), "row", "id", "label", "v", *lists)
    sent = asking.join(grid, ["size", "bin", "part"]).select("slab", "part", F.lit(True).alias("asks"), "row", "id", "label", "v", *lists)
    return mine.unionByName(sent)


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", slab: int = SLAB, group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and positive its first hard negatives."""
    rows = stored(prepared(vectors, id_col, vector_col, label_col), "vectors")
    held = slabs(rows, slab)
    anchors = rows.filter(F.col("id") % EVERY == 0)
    first = lambda df, keys, score, id_, row, k: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), F.asc_nulls_last(id_), row))).filter(F.col("rank") <= k)
    met = _met(held, anchors, group, False).groupBy("slab", "part")
    near = first(met.applyInArrow(_positives(POSITIVES), "anchor long, positive long, positive_id long, positive_score long"), ["anchor"], "positive_score", "positive_id", "positive", POSITIVES)
    positives = stored(near.withColumnRenamed("rank", "turn"), "positives")
    # FROM * p <= 100 * n <= TO * p in whole numbers.
    low, high = _share(FROM, 99), _share(TO, 0)
    window = positives.select("anchor", "turn", low.alias("low"), high.alias("high"))
    lists = window.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("turn", "low", "high"))).alias("w"))
    asked = anchors.join(lists, anchors["row"] == lists["anchor"]).select("row", "id", "label", "v", F.transform("w", lambda x: x["low"]).alias("low"), F.transform("w", lambda x: x["high"]).alias("high"))
    asked = stored(asked, "asked")
    met = _met(held, asked, group, True).groupBy("slab", "part")
    found = first(met.applyInArrow(_negatives(NEGATIVES), "anchor long, turn long, negative long, negative_id long, negative_score long"), ["anchor", "turn"], "negative_score", "negative_id", "negative", NEGATIVES)
    named = positives.join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    out = found.withColumn("turn", F.col("turn") + 1).join(named, ["anchor", "turn"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, a.label AS al, b.r AS br, b.vec_id, b.label AS bl, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.r <> b.r AND len(a.x) = len(b.x) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE bl = al QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id NULLS LAST) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
  FROM p JOIN s ON s.ar = p.ar AND s.bl <> p.al WHERE 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
