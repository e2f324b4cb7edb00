"""Spelling variant grouping by k-d trees over letter counts.

A word is a point: how often it has each letter (the 26 letters and six folds of the accented ones; none, once, or more often). An inserted letter raises one
coordinate by one; a replaced letter raises one and lowers one: the points of words one edit apart lie within an L1 distance of two. Words
are searched for each pair of lengths, (L, L) and (L, L + 1), so that the shorter word asks and the longer one is held, and a box is pruned
if it can only be reached by more than one step up, or by more than one step down (none for an inserted letter).

* Counting is a plain aggregation in the JVM with partial sums, so a word of any frequency costs one row a task.
* A bounded sample (some ``SAMPLE`` words, chosen by their hashes) gives the upper levels of one k-d tree for each length; its leaves are the
  cells by which Spark deals the words. A word is held in one cell and asks in every cell within reach. Every word is indexed.
* Cells that hold or are asked by too many words are cut into blocks of bounded size. Each block builds its k-d tree with tight boxes,
  answers all its range searches together and verifies the order of letters of what they find.
* A word has a bounded number of near words, so pairs are rows. Forms lead to words at least twice as frequent, so chains are short:
  pointer doubling ends after a few joins.

Cases: a null text has no words; a null id counts as an empty one in the hash; empty texts and empty tables give no rows; a very long run
is one word like any other (a length that the sample lacks has a hashed cell of its own); ties of n go to the smallest word in code-point
order; repeated rows count as often as they came; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.common import stored, table

RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, SLIP, RATIO = 5, 3, 97, 2
#: Letters have coordinates of their own, other code points share FOLDS: folding brings points nearer, never farther.
FOLDS = 6
DIMS = 26 + FOLDS
#: Letters beyond the second of a kind don't count: that, too, brings points nearer only, and a point fits 64 bits.
MOST = 2
#: Words that the upper levels are fitted on, their longest length, words a cell should hold, words of a block that are held and that ask.
SAMPLE, SAMPLE_LENGTH, CELL, HELD, ASKED = 65_536, 64, 2_048, 4_096, 32_768
#: Cells of lengths that the sample lacks.
SPARE = 1_024
_LEAF = 64


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the runs of letters of all texts, some with a slip of the pen, of five code points and three occurrences or more."""
    run = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(docs[text_col], F.lit(RUN), F.lit(0))).alias("run"))
    ascii_only = F.octet_length("run") == F.char_length("run")
    low = run.select("d", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)).alias("run"))
    h = F.crc32(F.concat("d", F.lit(":"), "run").cast("binary"))
    hashed = low.select("run", h.alias("h"))
    at = "cast(h % char_length(run) as int)"
    slipped = F.expr(f"concat(substring(run, 1, {at}), substring(run, {at} + 2))")
    word = hashed.select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= LEAST_LENGTH)
    return word.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def letter_counts(encoded: list[bytes]) -> np.ndarray:
    """One row of letter counts for each word (Latin-1), up to MOST of a letter."""
    data = np.frombuffer(b"".join(encoded), dtype=np.uint8).astype(np.int64)
    dim = np.where((data >= 97) & (data <= 122), data - 97, 26 + data % FOLDS)
    owner = np.repeat(np.arange(len(encoded)), [len(w) for w in encoded])
    counts = np.bincount(owner * DIMS + dim, minlength=len(encoded) * DIMS).reshape(len(encoded), DIMS)
    return np.minimum(counts, MOST).astype(np.int8)


def steps(points: np.ndarray) -> np.ndarray:
    """Points as 64 bits, as many for each coordinate as it counts: a step up or down sets or clears one bit."""
    bits = np.concatenate([points >= 1, points >= 2], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


class Tree:
    """A k-d tree over letter counts: medians of the widest coordinate, boxes for pruning, rows in the leaves.

    Corners of boxes are held as steps. With ``tight`` a box is the bounding box of its rows; without, it is the region of the splits, which
    also holds rows not seen so far.
    """

    def __init__(self, points: np.ndarray, leaf: int, tight: bool):
        self._points, self._leaf, self._tight = points, leaf, tight
        self.nodes: list[tuple] = []
        self.leaves: list[np.ndarray] = []
        self._build(np.arange(len(points)), np.zeros(DIMS, dtype=np.int8), np.full(DIMS, MOST, dtype=np.int8))
        del self._points

    def _build(self, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> int:
        own = self._points[rows]
        if self._tight and len(rows):
            lo, hi = own.min(axis=0), own.max(axis=0)
        me = len(self.nodes)
        self.nodes.append(())
        corners = steps(np.stack([lo, hi]))
        cut = self._cut(own) if len(rows) > self._leaf else None
        if cut is None:
            self.nodes[me] = (corners[0], ~corners[1], -1, -1, len(self.leaves))
            self.leaves.append(rows)
            return me
        dim, value = cut
        below, above = hi.copy(), lo.copy()
        below[dim], above[dim] = value, value + 1
        left = self._build(rows[own[:, dim] <= value], lo, below)
        right = self._build(rows[own[:, dim] > value], above, hi)
        self.nodes[me] = (corners[0], ~corners[1], left, right, -1)
        return me

    @staticmethod
    def _cut(own: np.ndarray) -> tuple[int, int] | None:
        spread = own.var(axis=0)
        dim = int(spread.argmax())
        if spread[dim] == 0:
            return None
        column = own[:, dim]
        value = int(np.median(column))
        return dim, value if (column > value).any() else value - 1

    def reach(self, at: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of at) whose box a point (as steps) reaches by at most ``up`` steps up and ``down`` steps down."""
        todo = [(0, np.arange(len(at)))] if len(at) else []
        while todo:
            node, rows = todo.pop()
            lo, beyond, left, right, leaf = self.nodes[node]
            own = at[rows]
            rows = rows[(np.bitwise_count(lo & ~own) <= up) & (np.bitwise_count(own & beyond) <= down)]
            if not len(rows):
                continue
            if leaf >= 0:
                yield leaf, rows
            else:
                todo += [(left, rows), (right, rows)]


class Cells:
    """The upper levels: a tree for each length of the sample; its leaves have numbers, other lengths share the spare cells."""

    def __init__(self, sample: list[bytes], leaf: int):
        by_length: dict[int, list[bytes]] = {}
        for w in sample:
            by_length.setdefault(len(w), []).append(w)
        self.trees: dict[int, tuple[Tree, int]] = {}
        self.count = 0
        for length in sorted(by_length):
            tree = Tree(letter_counts(sorted(by_length[length])), leaf, tight=False)
            self.trees[length] = (tree, self.count)
            self.count += len(tree.leaves)
            tree.leaves = []

    def _at(self, at: np.ndarray, length: int, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        if length not in self.trees:
            return np.arange(len(at)), np.full(len(at), self.count + length % SPARE)
        tree, first = self.trees[length]
        found = list(tree.reach(at, up, down))
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate([rows for _, rows in found]), np.concatenate([np.full(len(rows), first + leaf) for leaf, rows in found])

    def route(self, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, asks): where each word is held (asks 0), and where it asks for words of its length (1) and one longer (2)."""
        out = []
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            own = at[rows]
            for asks, (other, up, down) in enumerate(((length, 0, 0), (length, 1, 1), (length + 1, 1, 0))):
                hit, cell = self._at(own, int(other), up, down)
                out.append((rows[hit], cell, np.full(len(hit), asks)))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, dtype=np.int64),) * 3


def _routed(cells: Cells) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 8192):
                part = batch.slice(first, 8192)
                encoded = [w.encode("latin-1") for w in part.column("word").to_pylist()]
                at = steps(letter_counts(encoded))
                row, cell, asks = cells.route(at, np.array([len(w) for w in encoded]))
                word, n = (part.column(c).take(pa.array(row)) for c in ("word", "n"))
                yield pa.RecordBatch.from_pydict({"word": word, "n": n, "at": pa.array(at[row].view(np.int64)), "cell": pa.array(cell, pa.int32()), "asks": pa.array(asks, pa.int32())})

    return run


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether b is a with exactly one letter replaced, or inserted (b is as long as a, or one longer)."""
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] and i < n if len(b) == n else a[i:] == b[i + 1 :]


def close_pairs(held: np.ndarray, asking: np.ndarray, down: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of held, rows of asking), points as steps, that one step up and at most ``down`` steps down may part; found leaf by leaf."""
    bits = np.unpackbits(held.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8)
    tree = Tree(bits[:, :DIMS] + bits[:, DIMS:], _LEAF, tight=True)
    for first in range(0, len(asking), 8192):
        some = asking[first : first + 8192]
        for leaf, hit in tree.reach(some, 1, down):
            for start in range(0, len(tree.leaves[leaf]), 1024):
                block = tree.leaves[leaf][start : start + 1024]
                for from_ in range(0, len(hit), 1024):
                    part = hit[from_ : from_ + 1024]
                    own, other = some[part][:, None], held[block][None]
                    q, m = np.nonzero((np.bitwise_count(other & ~own) <= 1) & (np.bitwise_count(own & ~other) <= down))
                    if len(q):
                        yield block[m], first + part[q]


def near_pairs(words: list[bytes], at: np.ndarray, asks: np.ndarray) -> Iterator[tuple[int, int]]:
    """(index of an asking word, index of a held word) one edit apart; of two words of one length the smaller asks."""
    length = np.array([len(w) for w in words])
    for size in np.unique(length[asks == 0]):
        held = np.flatnonzero((asks == 0) & (length == size))
        for kind, own, down in ((1, size, 1), (2, size - 1, 0)):
            asking = np.flatnonzero((asks == kind) & (length == own))
            for m, q in close_pairs(at[held], at[asking], down):
                for i, k in zip(asking[q].tolist(), held[m].tolist()):
                    a, b = words[i], words[k]
                    if (kind == 2 or a < b) and one_edit(a, b):
                        yield i, k


def _near(group: pa.Table) -> pa.Table:
    word, n = group.column("word").combine_chunks(), group.column("n").combine_chunks()
    at = group.column("at").to_numpy().view(np.uint64)
    pairs = np.array(list(near_pairs([w.encode("latin-1") for w in word.to_pylist()], at, group.column("asks").to_numpy())), dtype=np.int64).reshape(-1, 2)
    one, other = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    return pa.table({"word": word.take(pa.array(one)), "near": word.take(pa.array(other)), "near_n": n.take(pa.array(other))})


def near_words(counted: DataFrame, sample: int = SAMPLE, cell: int = CELL, held: int = HELD, asked: int = ASKED) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words in ``counted`` (word, n) that one edit parts."""
    total = counted.count()
    # Hashes choose, so that every task sends its share only; the limit proves the bound, twice what is expected.
    share = min(1.0, sample / max(total, 1))
    chosen = counted.filter((F.char_length("word") <= SAMPLE_LENGTH) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30)))).limit(2 * sample).select("word")
    fitted = [r.word.encode("latin-1") for r in chosen.collect()]
    cells = Cells(fitted, max(16, -(-cell * len(fitted) // max(total, 1))))
    routed = stored(counted.mapInArrow(_routed(cells), "word string, n long, at long, cell int, asks int"), "routed")
    # At most one row for each cell: a leaf of the sample or a spare one.
    sizes = routed.groupBy("cell").agg(F.count_if(F.col("asks") == 0).alias("members"), F.count_if(F.col("asks") > 0).alias("queries"))
    sizes = sizes.filter("members > 0 and queries > 0").select("cell", F.ceil(F.col("members") / held).cast("int").alias("rows"), F.ceil(F.col("queries") / asked).cast("int").alias("columns"))
    sized = routed.join(F.broadcast(sizes), "cell")
    mine = lambda parts: F.pmod(F.xxhash64("word"), F.col(parts)).cast("int")
    every = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    rows = F.when(F.col("asks") == 0, F.array(mine("rows"))).otherwise(every("rows"))
    columns = F.when(F.col("asks") == 0, every("columns")).otherwise(F.array(mine("columns")))
    dealt = sized.select("word", "n", "at", "asks", "cell", F.explode(rows).alias("i"), columns.alias("c")).select("word", "n", "at", "asks", "cell", "i", F.explode("c").alias("j"))
    return dealt.groupBy("cell", "i", "j").applyInArrow(_near, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word that forms lead to, by pointer doubling."""
    ahead = stored(forms.select("word", F.col("form").alias("root")), "ahead")
    while True:
        step = ahead.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = stored(ahead.join(step, ahead["root"] == step["at"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ahead")
        if not moved.filter("moved").take(1):
            return moved.select("word", "root")
        ahead = moved.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, cell: int = CELL, held: int = HELD, asked: int = ASKED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs``."""
    counted = stored(words(docs, id_col, text_col), "words")
    near = near_words(counted, sample, cell, held, asked)
    # The largest n, then the smallest word: the least of (-n, word).
    top = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("back"), F.col("near").alias("form"))).alias("x"))
    both = counted.join(top, "word", "left")
    strong = -F.col("x.back") >= RATIO * F.col("n")
    graph = stored(both.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("x.form")).alias("form"), F.when(strong, -F.col("x.back")).alias("form_n")), "forms")
    ends = roots(graph.filter("form is not null"))
    return graph.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
