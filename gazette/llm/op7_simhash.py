"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into three segments of 22, 21 and 21 bits, each taken as a word of the perfect binary Golay code
(23, 12): every word lies within 3 bits of one codeword. ``decode`` gives that codeword's 12-bit index; ``ball`` gives the indices
of a word and of its single-bit neighbours (one or six). If two words differ in one bit at most, the index of either lies in the ball of the other.

Two fingerprints with at most three differing bits spread their errors over the segments in one of two ways (pigeonhole):

* every segment has one error at most: key (index, index, index);
* some segment has two or three: of the other two, one is equal and one has one error at most: key (bits, index), six arrangements.

All keys have 33 bits or more, so chance matches stay rare at any size. Keys are joined between distinct fingerprints only, candidates
are verified on the fingerprints, and links become components by :mod:`gazette.llm.components`. Documents with equal fingerprints
share a node, so a group of copies of any size costs one row.

Cases: null and empty texts and texts without words have fingerprint zero and are linked like any other; fewer words than a shingle
give one shingle; ties (half the hashes) give bit 0; repeated rows share a fingerprint and appear as often as they came; a null id
takes part but is never the smallest; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.common import stored, table
from gazette.llm.components import components
from gazette.llm.kernels import LOWER, SPACE, chunks, string_buffers, word_bounds, xxh64_slices
from gazette.llm.repeats import NAME, keyed

SHINGLE = 3
BITS = 3
SEED = 42
_WIDTHS = (22, 21, 21)
_SHIFTS = (0, 22, 43)
#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_GENERATOR = 0b110001110101


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of a chunk, text by text, and how many each text has."""
    low = LOWER[data]
    begin, end, starts = word_bounds(low, offsets)
    n = len(offsets) - 1
    counts = np.diff(starts)
    if not len(begin):
        return np.zeros(0, dtype=np.uint64), np.zeros(n, dtype=np.int64)
    # Words with one space after each: a shingle is then one slice.
    place = np.flatnonzero(~SPACE[low])
    keep = np.zeros(len(low) + 1, dtype=np.int64)
    keep[place + 1] = 1
    np.cumsum(keep, out=keep)
    number = np.arange(len(begin))
    to_begin, to_end = keep[begin] + number, keep[end] + number
    packed = np.full(int(to_end[-1]) + 1, 0x20, dtype=np.uint8)
    packed[np.arange(len(place)) + np.repeat(number, end - begin)] = low[place]
    per_text = np.where(counts >= shingle, counts - shingle + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(n), per_text)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    first = starts[owner] + inner
    last = np.minimum(first + shingle, starts[owner + 1]) - 1
    return xxh64_slices(packed, to_begin[first], to_end[last], SEED), per_text


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text of a chunk."""
    return simhash(*shingle_hashes(data, offsets, shingle))


def simhash(h: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each text from the hashes of its shingles."""
    n = len(per_text)
    if not len(h):
        return np.zeros(n, dtype=np.uint64)
    full = np.flatnonzero(per_text)
    heads = (np.cumsum(per_text) - per_text)[full]
    bits = np.empty((len(full), 64), dtype=bool)
    for bit in range(64):
        bits[:, bit] = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(1), heads) * np.uint64(2) > per_text[full].astype(np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = string_buffers(batch.column("text"))
            parts = [fingerprints_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle) for a, b in chunks(offsets)]
            fp = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_pydict({"d": batch.column("d"), "t": batch.column("t"), "fp": pa.array(fp.view(np.int64))})

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(d, t, fp): id, hashes of the text and 64-bit fingerprint of every row."""
    return keyed(docs, id_col, text_col).mapInArrow(_fingerprint(shingle), f"d long, t {NAME}, fp long")


class Golay:
    """Decoding of 23-bit words to the index of the nearest codeword, by syndrome tables."""

    def __init__(self):
        residues = np.zeros(23, dtype=np.int64)
        for i in range(23):
            r = 1 << i
            for k in range(i, 10, -1):
                if r >> k & 1:
                    r ^= _GENERATOR << (k - 11)
            residues[i] = r
        byte = np.arange(256)
        self._parts = []
        for at in (0, 8, 16):
            part = np.zeros(256, dtype=np.int64)
            for b in range(min(8, 23 - at)):
                part ^= np.where(byte >> b & 1, residues[at + b], 0)
            self._parts.append(part)
        self._errors = np.zeros(2048, dtype=np.int64)
        one = [1 << i for i in range(23)]
        patterns = one + [a | b for i, a in enumerate(one) for b in one[:i]] + [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]
        patterns = np.array(patterns, dtype=np.int64)
        self._errors[self.syndrome(patterns)] = patterns

    def syndrome(self, word: np.ndarray) -> np.ndarray:
        return self._parts[0][word & 255] ^ self._parts[1][word >> 8 & 255] ^ self._parts[2][word >> 16]

    def decode(self, word: np.ndarray) -> np.ndarray:
        return (word ^ self._errors[self.syndrome(word)]) >> 11

    def ball(self, word: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct indices of each word and its single-bit neighbours: (row, index) pairs sorted by row."""
        flips = np.array([0, *(1 << i for i in range(width))], dtype=np.int64)
        found = np.sort(self.decode(word[:, None] ^ flips), axis=1)
        new = np.ones(found.shape, dtype=bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        row, _ = np.nonzero(new)
        return row, found[new]


_GOLAY: list[Golay] = []


def golay() -> Golay:
    if not _GOLAY:
        _GOLAY.append(Golay())
    return _GOLAY[0]


def keys_of(fp: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(row, key) pairs of the index side and of the query side."""
    code = golay()
    fp = fp.view(np.uint64)
    part = [((fp >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(_SHIFTS, _WIDTHS)]
    index = [code.decode(p) for p in part]
    balls = [code.ball(p, w) for p, w in zip(part, _WIDTHS)]
    every = np.arange(len(fp))
    held, asked = [], []
    kind = 0
    for u in range(3):
        for v in range(3):
            if u != v:
                kind += 1
                base = (np.int64(kind) << 60) | part[u] << 12
                held.append((every, base | index[v]))
                row, near = balls[v]
                asked.append((row, base[row] | near))
    row, near = balls[2]
    held.append((row, index[0][row] << 24 | index[1][row] << 12 | near))
    (row0, near0), (row1, near1) = balls[0], balls[1]
    size1 = np.bincount(row1, minlength=len(fp))
    first1 = np.cumsum(size1) - size1
    times = size1[row0]
    row = np.repeat(row0, times)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    asked.append((row, np.repeat(near0, times) << 24 | near1[first1[row] + inner] << 12 | index[2][row]))
    join = lambda x: (np.concatenate([r for r, _ in x]), np.concatenate([k for _, k in x]))
    return join(held), join(asked)


def _keys(side: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                fp = batch.column("fp").slice(at, 4096).to_numpy()
                row, key = keys_of(fp)[side]
                yield pa.RecordBatch.from_pydict({"key": pa.array(key), "fp": pa.array(fp[row])})

    return run


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(u, v): all pairs of distinct fingerprints in ``nodes.fp`` that differ in ``bits`` bits or fewer (three at most)."""
    if not 0 <= bits <= 3:
        raise ValueError("the keys find pairs of up to three differing bits")
    fp = nodes.select("fp")
    held = fp.mapInArrow(_keys(0), "key long, fp long").withColumnRenamed("fp", "u")
    asked = fp.mapInArrow(_keys(1), "key long, fp long").withColumnRenamed("fp", "v")
    near = (F.col("v") < F.col("u")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)
    # Spark takes a fingerprint for one row of keys, but it has twelve on one side and sixty on the other: neither side may be broadcast.
    return held.hint("merge").join(asked.hint("merge"), (held["key"] == asked["key"]) & near).select("u", "v").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row for each row of docs: doc_id, t (hashes of the text), fingerprint (long), root (the least fingerprint of the component)
    and component_id, the least id reachable over links."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("d").alias("first")), "nodes")
    found = stored(components(links(nodes, bits)), "components")
    rooted = found.join(nodes, found["node"] == nodes["fp"]).select("node", "root", "first")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    moved = rooted.join(least, "root").select(F.col("node").alias("fp"), "root", "component_id")
    labels = nodes.join(moved, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(stored(labels, "labels"), "fp").select(F.col("d").alias("doc_id"), "t", F.col("fp").alias("fingerprint"), "root", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
