"""Which texts contain which needles: one pass over each text for needles that a worker can hold, a substring join by grams beyond that."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

from gazette.sources.settled import settled

#: Bytes of a gram; a shorter needle is its own gram.
GRAM = 4
#: Needles of one text that are looked for in one row, as a mean at most.
BUCKET = 4096
#: Grams asked for, 8 MB, up to which the step that cuts texts holds them; more meet by the shuffled join alone.
HELD = 1 << 20
#: Needles, and their bytes, up to which every worker holds them all.
FEW, FEW_BYTES = 1 << 16, 1 << 22
_PIECE = 1 << 20
#: Places of the table that tells most grams of no needle, a power of two.
_PLACES = 1 << 18


def _runs(text: bytes, size: int) -> np.ndarray:
    """The distinct runs of ``size`` bytes as numbers, in pieces, so that a very long text takes little memory."""
    found = []
    for at in range(0, max(0, len(text) - size + 1), _PIECE):
        own = np.frombuffer(text, np.uint8, min(_PIECE + size - 1, len(text) - at), at).astype(np.int64)
        n = len(own) - size + 1
        found.append(np.unique(sum(own[k : k + n] << 8 * k for k in range(size)) | size << 8 * GRAM))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _cut(sizes: list[int], whole: bool, only: Broadcast | None = None) -> Callable:
    """Rows (name, text) to rows (name, gram): of every size, or with ``whole`` of the one that suits a needle's length; ``only`` some grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for i in range(len(batch)):
                text = texts[i].as_py().encode()
                grams = np.concatenate([_runs(text, k) for k in ([min(len(text), GRAM)] if whole else sizes)])
                if only is not None:
                    grams = grams[np.isin(grams, only.value, assume_unique=True)]
                if len(grams):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.full(len(grams), i))), pa.array(grams)], names=["name", "gram"])

    return run


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """The run of ``size`` bytes at every place of data, as a number."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    grams = data[:n].astype(np.uint32)
    for k in range(1, size):
        grams |= data[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    return grams


def _places(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint32(2654435761)) >> np.uint32(32 - _PLACES.bit_length() + 1)


class _Finder:
    """Needles by one gram of each: the one that is rarest in the first piece of text seen, which decides on speed alone."""

    def __init__(self, needles: list[bytes], sample: np.ndarray):
        self.n, self.longest, self.by_size = len(needles), max(map(len, needles), default=0), []
        lengths = np.array([len(x) for x in needles], np.int64)
        sizes = np.minimum(lengths, GRAM)
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            cut = [_grams(np.frombuffer(needles[i], np.uint8), size) for i in own]
            many = np.array([len(x) for x in cut])
            grams, at = np.concatenate(cut), np.repeat(np.arange(len(own)), many)
            place = np.arange(len(grams)) - np.repeat(np.cumsum(many) - many, many)
            known, n = np.unique(_grams(sample, size), return_counts=True)
            where = np.minimum(np.searchsorted(known, grams), max(0, len(known) - 1))
            times = np.where(known[where] == grams, n[where], 0) if len(known) else np.zeros(len(grams), np.int64)
            order = np.lexsort((place, times, at))
            rarest = order[np.r_[True, at[order][1:] != at[order][:-1]]]
            rarest = rarest[np.argsort(grams[rarest], kind="stable")]
            keys, first, count = np.unique(grams[rarest], return_index=True, return_counts=True)
            table = np.zeros(_PLACES, bool)
            table[_places(keys)] = True
            # A needle's bytes are grams side by side, the last of them at its end.
            words = [np.unique(np.r_[0 : len(x) : size, len(x) - 1]) for x in cut]
            n_words = np.array([len(x) for x in words])
            flat = np.concatenate([x[w] for x, w in zip(cut, words)])
            self.by_size.append((size, table, keys, first, count, at[rarest], place[rarest], own, lengths[own], n_words, np.cumsum(n_words) - n_words, flat, np.concatenate(words)))

    def find(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, needle), ordered and distinct, of texts that lie one behind the other in data and end at ``ends``."""
        begins, found = np.r_[0, ends[:-1]], [np.zeros(0, np.int64)]
        for low in range(0, len(data), _PIECE):
            base = max(0, low - self.longest)
            for size, table, keys, first, count, which, place, own, lengths, n_words, first_word, words, offsets in self.by_size:
                grams = _grams(data[base : low + _PIECE + self.longest], size)
                asked = grams[low - base : low - base + _PIECE]
                at = np.flatnonzero(table[_places(asked)])
                key = np.minimum(np.searchsorted(keys, asked[at]), len(keys) - 1)
                same = keys[key] == asked[at]
                at, key = at[same] + low, key[same]
                reach = np.cumsum(count[key])
                blocks = np.unique(np.r_[0, np.searchsorted(reach, np.arange(_PIECE, reach[-1] if len(reach) else 0, _PIECE)), len(at)])
                for one, other in zip(blocks[:-1], blocks[1:]):
                    times = count[key[one:other]]
                    of = np.repeat(np.arange(one, other), times)
                    x = first[key[of]] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
                    begin, x = at[of] - place[x], which[x]
                    row = np.searchsorted(ends, at[of], "right")
                    fits = np.flatnonzero((begin >= begins[row]) & (begin + lengths[x] <= ends[row]))
                    x, begin, row = x[fits], begin[fits] - base, row[fits]
                    done = []
                    for j in range(int(n_words.max())):
                        if not len(x):
                            break
                        word = first_word[x] + j
                        same = grams[begin + offsets[word]] == words[word]
                        x, begin, row = x[same], begin[same], row[same]
                        last = n_words[x] == j + 1
                        done.append(np.unique(row[last] * self.n + own[x[last]]))
                        x, begin, row = x[~last], begin[~last], row[~last]
                    found += done
        return np.divmod(np.unique(np.concatenate(found)), max(1, self.n))


def _finding(needles: Broadcast) -> Callable:
    """A column function: which of the needles each text contains."""

    @arrow_udf(ArrayType(StringType()))
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder, names = None, pa.array(needles.value, pa.string())
        for texts in batches:
            own = texts.cast(pa.large_binary())
            offsets = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
            data = np.frombuffer(own.buffers()[2] or b"", np.uint8)
            low, counts, ids = 0, [], []
            while low < len(own):
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + _PIECE, "right")) - 1)
                piece = data[offsets[low] : offsets[high]]
                finder = finder or _Finder([x.encode() for x in needles.value], piece[:_PIECE])
                rows, which = finder.find(piece, offsets[low + 1 : high + 1] - offsets[low])
                counts.append(np.bincount(rows, minlength=high - low))
                ids.append(which)
                low = high
            ends = np.cumsum(np.concatenate([[0], *counts])).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(np.concatenate([np.zeros(0, np.int64), *ids]))))

    return find


def contains_join(texts: DataFrame, needles: DataFrame, text: str, needle: str) -> DataFrame:
    """(text, needle), distinct: the needle occurs in the text, upper and lower case apart.

    Texts and needles are compared once for each distinct value. Needles that every worker can hold are looked for where the text is, in one
    pass over its bytes; more of them meet the texts by grams. NULLs and empty needles are contained nowhere, in a text without a character
    nothing is. Other columns of either side, whatever their names, are left out: join them back.
    """
    t = texts.select(F.col(text).cast("string").alias("text")).filter("text <> ''").distinct()
    n = needles.select(F.col(needle).cast("string").alias("needle")).filter("needle <> ''").distinct()
    size = n.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("needle")), F.lit(0)).alias("bytes")).first()
    if size["n"] > FEW or size["bytes"] > FEW_BYTES:
        return _by_grams(t, n)
    held = t.sparkSession.sparkContext.broadcast(sorted(r["needle"] for r in n.collect()))
    return t.select("text", F.explode(_finding(held)("text")).alias("needle"))


def _by_grams(t: DataFrame, n: DataFrame) -> DataFrame:
    """contains_join of distinct texts and needles, for any number of needles.

    A needle asks at the gram of its own that the fewest texts have, so that frequent grams are asked for only by needles that have no
    other; grams that none asks for stay where they are cut. Grams travel with a digest of their text; the text itself comes once more for
    each few thousand needles that it may contain.
    """
    t = t.select(F.unhex(F.sha2("text", 256)).alias("key"), "text")
    # At most GRAM numbers: the lengths of grams that occur, with how many needles have them.
    lengths = {r["size"]: r["n"] for r in n.groupBy(F.least(F.octet_length("needle"), F.lit(GRAM)).alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    asked = n.select("needle", F.col("needle").alias("own")).mapInArrow(_cut([], True), "name string, gram long").withColumnRenamed("name", "needle")
    cut = lambda only=None: t.mapInArrow(_cut(sorted(lengths), False, only), "name binary, gram long").withColumnRenamed("name", "key") if lengths else t.sparkSession.createDataFrame([], "key binary, gram long")
    counts = cut().groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A gram that no text has rules its needle out: it counts as 0 and wins.
    rare = asked.join(counts, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x"))
    keys = settled(rare.filter("x.n > 0").select("needle", F.col("x.gram").alias("gram")), "keys")
    grams = keys.select("gram").distinct()
    held = None
    if grams.count() <= HELD:
        held = t.sparkSession.sparkContext.broadcast(np.array(sorted(r["gram"] for r in grams.collect()), np.int64))
    buckets = -(-max(1, sum(lengths.values())) // BUCKET)
    lists = cut(held).join(keys, "gram").groupBy("key", F.pmod(F.xxhash64("needle"), F.lit(buckets)).alias("bucket")).agg(F.collect_list("needle").alias("needles"))
    inside = F.filter("needles", lambda x: F.contains(F.col("text"), x))
    return lists.join(t, "key").select("text", F.explode(inside).alias("needle"))
