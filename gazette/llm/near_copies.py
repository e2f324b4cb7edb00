"""Near copies by similarity: pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from two sources. First, the SimHash of each text over these shingles: pairs within the three bits that the Golay keys
of :mod:`gazette.llm.op7_simhash` reach. But pairs at 0.8 differ in about ten of 64 bits (an angle of acos(8/9), 15 % of the bits), and
no affordable number of wider fingerprints finds them all (README, "What a SimHash can find"). So, second, minima of the shingle
hashes under ``BANDS`` x ``ROWS`` permutations: texts meet where all minima of a band are equal. A pair at 0.8 exactly shares no band
with probability (1 - 0.8^5)^28 = 1.5e-5, more similar pairs with less.

Every candidate pair is judged on its exact sets of shingles, and links become components by :mod:`gazette.llm.components`. First come
rounds, ``ROUNDS`` at most, that make no more pairs than there are rows of bands: each text is held against the text of its band that has
most links so far and, from the second round on, against one drawn at random for each band. Texts put together from shared paragraphs
become few components this way, and texts of one component are not compared again. Rounds end when one of them joins little. Texts that then
still share a band with another component are joined by prefixes: sets are put in one common order, rarest shingle first, and two sets
of similarity 0.8 meet at the first shingle they share, with enough left behind it on both sides. Shingles of one text alone can't be
shared and come first, so a text whose every fifth shingle is its own has no candidate at all: a large group of copies that all differ
costs no pairs of its members. Pairs whose parities tell that the sets differ in too many shingles go before the sets are fetched. No
pair that can be similar is dropped.

Cases: words are lower-cased (ASCII) and parted by white space; fewer words than a shingle give one shingle; null and empty texts and
texts without words are equal to each other; equal texts are one node, known by a 64-bit hash; a null id takes part but is never the
smallest; of rows equal in id and text one stays, the first by a hash of its other columns; a very long text is one set of hashes; an
empty table gives no rows; columns of any name are carried along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gazette.llm.common import stored
from gazette.llm.components import components
from gazette.llm.kernels import chunks, mix64, string_buffers
from gazette.llm.op7_simhash import links, shingle_hashes, simhash

SHINGLE = 5
BANDS = 28
ROWS = 5
#: Rounds by spokesmen at most; another round follows where more than one of YIELD pairs that a round judged was similar.
ROUNDS = 5
YIELD = 50
#: Similarity as a fraction, so that it is compared in whole numbers.
SIMILAR = (4, 5)
_RANDOM = np.random.default_rng(20)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)


#: The set of a text without words.
_NONE = np.zeros(1, dtype=np.uint64)


def band_keys(h: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys from the shingle hashes of some texts; texts without shingles share all of theirs."""
    full = np.flatnonzero(per_text)
    heads = (np.cumsum(per_text) - per_text)[full]
    out = np.zeros((len(per_text), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(full), band + 1, dtype=np.uint64)
        for k in range(band * ROWS, band * ROWS + ROWS if len(full) else 0):
            key = mix64(key ^ np.minimum.reduceat(h * _FACTORS[k] + _TERMS[k], heads)) + np.uint64(band)
        out[full, band] = key
        out[per_text == 0, band] = band
    return out


def _sketch(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = string_buffers(batch.column("text"))
            for first, last in chunks(offsets):
                h, per_text = shingle_hashes(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], shingle)
                keys = band_keys(h, per_text).view(np.int64)
                ends = np.arange(last - first + 1, dtype=np.int32) * BANDS
                columns = {"node": batch.column("node").slice(first, last - first), "fp": pa.array(simhash(h, per_text).view(np.int64))}
                yield pa.RecordBatch.from_pydict(columns | {"keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))})

    return run


def _sets(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = string_buffers(batch.column("text"))
            for first, last in chunks(offsets):
                h, per_text = shingle_hashes(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], shingle)
                own = [np.unique(x) if len(x) else _NONE for x in np.split(h, np.cumsum(per_text)[:-1])]
                columns = {"node": batch.column("node").slice(first, last - first), "n": pa.array([len(x) for x in own], pa.int64())}
                columns |= {"parity": pa.array([parities(x) for x in own], pa.binary()), "shingles": pa.array([x.tobytes() for x in own], pa.binary())}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def parities(shingles: np.ndarray) -> bytes:
    """One bit for each place: whether an odd number of the set's hashes fall there. As many places as shingles, within bounds."""
    places = min(max(1 << (len(shingles) - 1).bit_length(), 256), 1 << 16)
    at = (shingles & np.uint64(places - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=places) & 1).astype(np.uint8)).tobytes()


def odds(a: bytes, b: bytes) -> int:
    """Places in which the parities of two sets differ: the sets differ in that many elements at least."""
    x, y = sorted((np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)), key=len)
    # A place of the shorter one holds what falls into several of the longer one.
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _even(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v, both, a, b = (batch.column(c) for c in ("u", "v", "both", "a", "b"))
        # Sets of similarity p / q differ in (q - p) / (q + p) of their sizes together at most.
        kept = [odds(x.as_py(), y.as_py()) * sum(SIMILAR) <= n.as_py() * (SIMILAR[1] - SIMILAR[0]) for x, y, n in zip(a, b, both)]
        yield pa.RecordBatch.from_pydict({"u": u, "v": v}).filter(pa.array(kept, pa.bool_()))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach SIMILAR."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * SIMILAR[1] >= (len(a) + len(b) - common) * SIMILAR[0]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = ([np.frombuffer(x.as_py(), dtype=np.uint64) for x in batch.column(c)] for c in ("a", "b"))
        kept = pa.array([similar(a, b) for a, b in zip(*sets)], pa.bool_())
        yield pa.RecordBatch.from_pydict({"u": batch.column("u"), "v": batch.column("v")}).filter(kept)


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that are similar. Sets of too different sizes or parities are told apart by these."""
    sizes = sets.select("node", "n", "parity")
    near = pairs.join(sizes.toDF("u", "_m", "a"), "u").join(sizes.toDF("v", "_n", "b"), "v")
    near = near.filter(F.least("_m", "_n") * SIMILAR[1] >= F.greatest("_m", "_n") * SIMILAR[0])
    near = near.select("u", "v", (F.col("_m") + F.col("_n")).alias("both"), "a", "b").mapInArrow(_even, "u long, v long")
    left, right = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    return near.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(_judge, "u long, v long")


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def _by_fingerprint(prints: DataFrame) -> DataFrame:
    """Pairs (x, y) of nodes with one fingerprint, and of nodes whose fingerprints the Golay keys link; each fingerprint has one spokesman."""
    spokesmen = stored(prints.groupBy("fp").agg(F.min("node").alias("y")), "fingerprints")
    same = prints.join(spokesmen, "fp").filter("node <> y").select(F.col("node").alias("x"), "y")
    near = links(spokesmen).join(spokesmen.toDF("u", "x"), "u").join(spokesmen.toDF("v", "y"), "v").select("x", "y")
    return same.unionByName(near)


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            offsets, data = string_buffers(part.column("shingles"))
            size = np.diff(offsets) // 8
            keys = np.frombuffer(data.tobytes(), dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"node": pa.array(np.repeat(part.column("node").to_numpy(), size)), "n": pa.array(np.repeat(size, size)), "key": pa.array(keys)})


def _prefixes(sets: DataFrame) -> DataFrame:
    """(node, n, key, bound): the rarest shingles of each set, as many as two similar sets need to share one, and the size of the set.

    Rarity is counted over ``sets``; ``bound`` is how many shingles that others have too are left from here on in that order. Where two
    sets meet at the first shingle they share, they have no more in common than the lesser bound.
    """
    each = stored(sets.select("node", "shingles").mapInArrow(_flat, "node long, n long, key long"), "shingles")
    common = stored(each.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "common")
    own = Window.partitionBy("node")
    left = F.count(F.lit(1)).over(own) - F.row_number().over(own.orderBy("df", "key")) + 1
    ranked = each.join(common, "key").select("node", "n", "key", left.alias("bound"))
    return ranked.filter(F.col("bound") >= F.ceil(F.col("n") * SIMILAR[0] / SIMILAR[1]))  # a similar set shares as many at least


def _unsettled(bands: DataFrame, known: DataFrame) -> DataFrame:
    """(node, key, root, ...): members of the bands that hold several components."""
    placed = bands.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    many = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key")
    # Written first, here and below: a join with an aggregate can't split a key that many rows hold, a join with a table can.
    return stored(placed.join(stored(many, "many"), "key"), "open")


def _by_spokesmen(bands: DataFrame, found: DataFrame, turn: int) -> DataFrame:
    """Pairs (x, y) of each member of a band and the one or two others that speak for the band in this round."""
    # Those with most links so far come first: the text that a group of copies was made from has most.
    links_of = found.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg((-F.count(F.lit(1))).alias("links"))
    hub = F.struct(F.coalesce("links", F.lit(0)), F.xxhash64("node", F.lit(turn)), "node", "root")
    other = F.struct(F.xxhash64("node", "key", F.lit(turn)), "node", "root")
    drawn = bands.join(links_of, "node", "left").groupBy("key").agg(F.min(hub).alias("hub"), F.min(other).alias("other"))
    who = F.array(*(F.struct(f"{c}.node", f"{c}.root") for c in (("hub", "other") if turn else ("hub",))))
    speak = stored(drawn.select("key", who.alias("speak")), "spokesmen")
    held = bands.withColumnRenamed("node", "x").join(speak, "key").select("x", "root", F.explode("speak").alias("y"))
    return held.filter(F.col("root") != F.col("y.root")).select("x", F.col("y.node").alias("y"))


def _by_prefixes(bands: DataFrame, sets: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (x, y) of all members of open bands that belong to different components and can be similar by their prefixes."""
    both = _unsettled(_prefixes(sets.join(bands.select("node").distinct(), "node", "left_semi")), known)
    # The largest part of those that share a shingle is held against the others, not against itself.
    parts = both.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    main = stored(parts.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main")), "main")
    told = stored(both.join(main, "key").withColumn("is_main", F.col("root") == F.col("main")).drop("main"), "parts")
    others = told.filter("not is_main").select("key", F.col("node").alias("x"), F.col("root").alias("root_x"), F.col("n").alias("n_x"), F.col("bound").alias("bound_x"))
    every = told.select("key", F.col("node").alias("y"), F.col("root").alias("root_y"), F.col("n").alias("n_y"), F.col("bound").alias("bound_y"), "is_main")
    enough = F.least("bound_x", "bound_y") * sum(SIMILAR) >= (F.col("n_x") + F.col("n_y")) * SIMILAR[0]
    return others.join(every, "key").filter("root_x <> root_y and (is_main or x < y)").filter(enough)


def near_components(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, root) for the nodes of ``texts`` (node, text) that are similar to another; root is the least node of the component."""
    sketches = stored(texts.mapInArrow(_sketch(shingle), "node long, fp long, keys array<long>").dropDuplicates(["node"]), "sketches")
    keys = sketches.select("node", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    bands = stored(keys.join(stored(shared, "keys"), "key"), "shared")
    first = stored(_pairs(_by_fingerprint(sketches.select("node", "fp"))), "pairs")
    wanted = bands.select("node").unionByName(first.select(F.col("u").alias("node"))).unionByName(first.select(F.col("v").alias("node"))).distinct()
    # Equal texts become one row in each task before the shuffle: a large group of copies isn't dealt to one task.
    wanted = texts.dropDuplicates(["node"]).join(wanted, "node", "left_semi")
    sets = stored(wanted.mapInArrow(_sets(shingle), "node long, n long, parity binary, shingles binary"), "sets")
    found = stored(_linked(first, sets), "links")
    judged, known, linked = first, stored(components(found), "components"), 0
    turn, last = 0, ROUNDS == 0
    while True:
        bands = _unsettled(bands, known)
        met = _by_prefixes(bands, sets, known) if last else _by_spokesmen(bands, found, turn)
        bands, turn = bands.drop("root"), turn + 1
        pairs = stored(_pairs(met).join(judged, ["u", "v"], "left_anti"), "pairs")
        tried = pairs.count()
        if tried:
            new = stored(_linked(pairs, sets), "links")
            linked = new.count()
            judged, found = judged.unionByName(pairs), found.unionByName(new)
            known = stored(components(found), "components") if linked else known
        if last:
            return known
        last = turn == ROUNDS or not tried or linked * YIELD <= tried


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of docs, with all its columns, for each component of near copies: the one with the least id (null ids last)."""
    text, name = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    # A row is named by its id and two 64-bit hashes of its text; its columns travel in a struct, so that their names can't clash.
    plain = [f.name for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    key = [name.isNull().alias("none"), F.coalesce(name, F.lit(0)).alias("d"), F.xxhash64(text).alias("node"), F.xxhash64(F.lit(1), text).alias("other")]
    rows = docs.select(*key, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(*(F.col(f"`{c}`") for c in plain)).alias("order"))
    found = near_components(docs.select(F.xxhash64(text).alias("node"), text.alias("text")), shingle)
    rooted = docs.select(*key).join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = rooted.groupBy("root").agg(F.min(F.struct("none", "d", "node", "other")).alias("k")).select("k.*")
    same = ["none", "d", "node", "other"]
    stay = rows.join(stored(kept, "kept"), same, "left_semi").groupBy(*same).agg(F.min_by("row", "order").alias("row"))
    return stay.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
