"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of ten consecutive words of a benchmark item is a pattern (an item of fewer words is one pattern). Patterns of one
length form a group with a *shift table* over hashes of blocks of two words: where the block at the end of the current position
belongs to no pattern, the search skips ahead as far as no occurrence can be missed, nine words at most. Where the shift is zero, a
*bucket* selected by the block's hash lists the patterns that end in that block; the word numbers are then compared one by one. The
search runs over many lanes of a chunk at once, each lane a stretch of words of one length that overlaps the next by a pattern.

Words are compared exactly: each word of the benchmark has a number, found by its bytes. Patterns are broadcast in parts of at most
``PATTERNS``: items are packed one after another until a part is full, and an item with more windows than that is cut into stretches that
overlap by a window less one word. A larger benchmark makes several passes over the documents, one part at a time; each pass but the
last is written before the next begins, so that a task holds the tables of one part.

Cases: null and empty texts have no words and are clean; items without words have no pattern; repeated items count each under its
id, items with the same id once; an item with a null id marks hits in the query and in the pipeline, but is never listed; repeated rows are each judged;
a very long text is searched as a whole; empty tables give no rows, or clean ones; only the id and text columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.common import rows_where, stored, table
from gazette.llm.kernels import LOWER, chunks, mix64, string_buffers, word_bounds, word_hashes

WINDOW = 10
#: Patterns that one broadcast holds at most.
PATTERNS = 2_000_000
LANE = 256
_OUT = "doc_id long, n_words long, hits array<struct<begin: long, end: long>>, items array<string>, text string"


class Patterns:
    """Tables of one set of items, built once for each Python worker."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.words: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[int]]] = {}
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: i for i, name in enumerate(self.names)}
        for name, text in items:
            words = [self.words.setdefault(w, len(self.words) + 1) for w in split(text)]
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                named = by_length.setdefault(size, {}).setdefault(tuple(words[i : i + size]), set())
                if name is not None:
                    named.add(number[name])
        self.groups = [Group(size, found) for size, found in sorted(by_length.items())]
        raw = b" ".join(self.words)
        data = np.frombuffer(raw, dtype=np.uint8)
        begin, end, _ = word_bounds(data, np.array([0, len(data)]), alnum=True)
        hashes = word_hashes(data, begin, end)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order + 1
        self.bytes = [raw[a:b] for a, b in zip(begin[order].tolist(), end[order].tolist())]

    def number(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of each word, 0 for words that no item has."""
        out = np.zeros(len(begin), dtype=np.int64)
        if not len(self.hashes) or not len(begin):
            return out
        hashes = word_hashes(data, begin, end)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        out[hit] = self.numbers[at[hit]]
        return out


def split(text: bytes) -> list[bytes]:
    data = LOWER[np.frombuffer(text, dtype=np.uint8)]
    begin, end, _ = word_bounds(data, np.array([0, len(data)]), alnum=True)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(begin.tolist(), end.tolist())]


class Group:
    """Shift table and buckets of patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[int, ...], set[int]]):
        self.length, self.block = length, min(2, length)
        self.bits = max(12, int(4 * len(patterns)).bit_length())
        self.patterns = np.array(list(patterns), dtype=np.int64)
        self.items = [sorted(x) for x in patterns.values()]
        most = length - self.block + 1
        self.shift = np.full(1 << self.bits, most, dtype=np.int16)
        for end in range(self.block, length + 1):
            np.minimum.at(self.shift, self.key(*self.patterns[:, end - self.block : end].T), length - end)
        suffix = self.key(*self.patterns[:, length - self.block :].T)
        order = np.argsort(suffix, kind="stable")
        self.patterns, self.items = self.patterns[order], [self.items[i] for i in order]
        self.bucket = np.searchsorted(suffix[order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def key(self, first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
        mixed = first.astype(np.uint64) if second is None else first.astype(np.uint64) * np.uint64(0x1_0000_0001) + second.astype(np.uint64)
        return (mix64(mixed + np.uint64(1)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start word and pattern of every occurrence in a stream of word numbers."""
        m, n = self.length, len(words)
        if n < m:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        keys = np.zeros(n, dtype=np.int64)
        if self.block == 2:
            keys[1:] = self.key(words[:-1], words[1:])
        else:
            keys = self.key(words)
        shifts = self.shift[keys]
        lane = np.arange(m - 1, n, LANE)  # last word of the first position of each lane
        stop = np.minimum(lane + LANE, n)
        at, starts, found = lane, [], []
        while len(at):
            jump = shifts[at]
            here = at[jump == 0]
            if len(here):
                low, high = self.bucket[keys[here]], self.bucket[keys[here] + 1]
                size = high - low
                place = np.repeat(here, size)
                pattern = np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
                for k in range(m - 1, -1, -1):
                    equal = words[place - m + 1 + k] == self.patterns[pattern, k]
                    place, pattern = place[equal], pattern[equal]
                starts.append(place - m + 1)
                found.append(pattern)
            at = at + np.maximum(jump, 1)
            alive = at < stop
            at, stop = at[alive], stop[alive]
        return np.concatenate(starts or [np.zeros(0, dtype=np.int64)]), np.concatenate(found or [np.zeros(0, dtype=np.int64)])


_CACHE: dict[tuple[str, int], Patterns] = {}


def _tables(broadcast, window: int) -> Patterns:
    """Tables of a broadcast, built once in a worker."""
    name, items = broadcast.value
    if (name, window) not in _CACHE:
        _CACHE.clear()
        _CACHE[name, window] = Patterns(items, window)
    return _CACHE[name, window]


def _search(broadcast, window: int) -> Callable:
    """Adds occurrences to hits and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, starts, found in occurrences(_tables(broadcast, window), batch.column("text")):
                n = len(starts) - 1
                hits = [[(x["begin"], x["end"]) for x in row] for row in batch.column("hits").slice(first, n).to_pylist()]
                items = [set(row) for row in batch.column("items").slice(first, n).to_pylist()]
                for text, begin, end, names in found:
                    hits[text].append((begin, end))
                    items[text].update(names)
                kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                columns = {"doc_id": batch.column("doc_id").slice(first, n), "n_words": pa.array(np.diff(starts)), "hits": pa.array([[{"begin": a, "end": b} for a, b in merge(x)] for x in hits], kind)}
                columns |= {"items": pa.array([sorted(x) for x in items], pa.list_(pa.string())), "text": batch.column("text").slice(first, n)}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def occurrences(patterns: Patterns, column: pa.Array) -> Iterator[tuple[int, np.ndarray, list[tuple[int, int, int, list[str]]]]]:
    """For each chunk: its first row, the number of words before each text, and (text, begin, end, items) of all occurrences."""
    offsets, data = string_buffers(column)
    for first, last in chunks(offsets):
        own = offsets[first : last + 1] - offsets[first]
        low = LOWER[data[offsets[first] : offsets[last]]]
        begin, end, starts = word_bounds(low, own, alnum=True)
        numbers = patterns.number(low, begin, end)
        raw = low.tobytes()
        # A stream with a zero after each text: no occurrence crosses it.
        stream = np.insert(numbers, starts[1:], 0)
        shifted = starts + np.arange(last - first + 1)
        found = []
        for group in patterns.groups:
            place, pattern = group.search(stream)
            text = np.searchsorted(shifted, place, side="right") - 1
            for p, q, t in zip((place - text).tolist(), pattern.tolist(), text.tolist()):
                # The word numbers came from hashes: compare the bytes themselves.
                if all(patterns.words.get(raw[begin[k] : end[k]]) == w for k, w in zip(range(p, p + group.length), group.patterns[q].tolist())):
                    found.append((t, p - int(starts[t]), p - int(starts[t]) + group.length, [patterns.names[i] for i in group.items[q]]))
        yield first, starts, found


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _packed(window: int, most: int) -> Callable:
    """Numbers parts inside a partition; the windows of a part are ``most`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, part, held = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = split(text.encode())
                for at in range(0, max(len(words) - window + 1, min(len(words), 1)), most):
                    stretch = words[at : at + most + window - 1]
                    n = max(len(stretch) - window + 1, 1)
                    if held + n > most:
                        part, held = part + 1, 0
                    held += n
                    yield pa.RecordBatch.from_pydict({"part": [f"{partition}-{part}"], "item": pa.array([item], pa.string()), "text": pa.array([b" ".join(stretch)], pa.binary())})

    return run


def _broadcasts(benchmark: DataFrame, window: int, patterns: int, unnamed: bool = True) -> list:
    """One thunk for each part of the items, which makes its broadcast; items with a null id count only where ``unnamed`` is set."""
    spark = benchmark.sparkSession
    known = benchmark if unnamed else benchmark.filter(F.col("item_id").isNotNull())
    sized = known.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    # An item of n bytes has n / 2 windows at most.
    total = sized.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    dealt = sized.coalesce(1) if total <= patterns else sized.repartition(-(-int(total) // patterns))
    packed = stored(dealt.mapInArrow(_packed(window, patterns), "part string, item string, text binary"), "items")
    # A few names for each part of PATTERNS windows reach the driver.
    parts = sorted(r.part for r in packed.select("part").distinct().toLocalIterator())

    def made(part: str):
        rows = packed.filter(F.col("part") == part).toLocalIterator()
        return spark.sparkContext.broadcast((uuid.uuid4().hex, [(r["item"], bytes(r["text"])) for r in rows]))

    return [lambda part=part: made(part) for part in parts]


def _passes(docs: DataFrame, parts: list, step: Callable[[DataFrame, object], DataFrame]) -> DataFrame:
    """``step`` for one part after the other; all but the last are written, and their broadcast goes."""
    for i, part in enumerate(parts):
        broadcast = part()
        docs = step(docs, broadcast)
        if i + 1 < len(parts):
            docs = stored(docs, "pass")
            broadcast.unpersist()
    return docs


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, patterns: int = PATTERNS) -> DataFrame:
    """The rows of docs, with all their columns, in which no benchmark window occurs."""

    def step(docs: DataFrame, broadcast) -> DataFrame:
        def marks(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
            for first, starts, found in occurrences(_tables(broadcast, window), column):
                kept = np.ones(len(starts) - 1, dtype=bool)
                kept[[text for text, *_ in found]] = False
                yield first, kept

        return rows_where(docs, text_col, marks)

    return _passes(docs, _broadcasts(benchmark, window, patterns), step)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, patterns: int = PATTERNS, keep_text: bool = False, unnamed: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, hits (maximal runs of hit words) and items (sorted ids of items with occurring windows).

    With ``unnamed`` items with a null id mark hits too.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast("array<struct<begin: bigint, end: bigint>>")
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_words"), none.alias("hits"), F.array().cast("array<string>").alias("items"), text.alias("text"))
    none_at_all = [lambda: docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, []))]
    parts = _broadcasts(benchmark, window, patterns, unnamed) or none_at_all
    found = _passes(found, parts, lambda df, broadcast: df.mapInArrow(_search(broadcast, window), _OUT))
    return found if keep_text else found.drop("text")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), unnamed=True)
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["begin"])
    out = out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)
