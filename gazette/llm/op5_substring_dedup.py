"""Substring dedup: Rabin-Karp hashes of every window of ``window`` words, counted in Spark; repeated windows merge into removal intervals.

Hashes roll over the word stream inside the tasks. The first two passes of :mod:`gazette.llm.repeats` let go of windows that no other can
equal, and count runs of windows that are copied together by one hash for each run. Every other window is a row of its own, and Spark
counts (anchor, hash) with partial aggregation: a window that occurs in any number of texts costs one row for each task. The earliest
occurrence (least id, then least start) of each window stays; every later one is removed.

Cases: null and empty texts have no words; texts shorter than the window lose nothing; a row that appears twice (same id and text)
doesn't count as earlier than itself, so both stay alike, and the same holds for rows with the same id and other texts at the same
start; a null id sorts first; a very long text is cut into overlapping pieces; an empty table gives no rows; columns other than id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.llm.common import stored, table
from gazette.llm.kernels import RangeHash, chunks, string_buffers, word_bounds
from gazette.llm.op2_suffix_dedup import run_list
from gazette.llm.repeats import NAME, Unit, counted, covered, keyed, left_over, per_text, spans_table, unrepeated, wanted_spans

WINDOW = 20
ANCHOR = 8
_OUT = "doc_id long, n_words long, n_removed long, intervals array<struct<begin: long, end: long>>, kept string, text string"


def _hashes(unit: Unit) -> Callable:
    """One row for each window of the wanted spans: its anchor, its hash, and where it starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unrepeated(batches):
            offsets, data = string_buffers(batch.column("text"))
            ends, a, lo, hi = wanted_spans(batch)
            for first, last in chunks(offsets):
                some = np.arange(ends[first], ends[last])
                if not len(some):
                    continue
                get, starts, _, _ = unit.cut(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                hashes = RangeHash(get(0, int(starts[-1])))
                for at in range(0, len(some), 1 << 14):
                    i = some[at : at + (1 << 14)]
                    size = hi[i] - lo[i] + 1
                    span = np.repeat(i, size)
                    start = lo[span] + np.arange(len(span)) - np.repeat(np.cumsum(size) - size, size)
                    text = np.searchsorted(ends, span, side="right") - 1
                    place = starts[text - first] + start
                    row = pa.array(text)
                    columns = {"a": pa.array(a[span]), "h": pa.array(hashes.of(place, place + unit.window).view(np.int64)), "d": batch.column("d").take(row), "t": batch.column("t").take(row)}
                    yield pa.RecordBatch.from_pydict(columns | {"lo": pa.array(start)})

    return run


def later_windows(texts: DataFrame, unit: Unit) -> DataFrame:
    """(d, t, lo, hi): runs of window starts whose words also start earlier."""
    texts = texts.select("d", "t", "text")
    _, known, runs = counted(spans_table(texts, unit), True)
    windows = stored(left_over(texts, known).mapInArrow(_hashes(unit), f"a long, h long, d long, t {NAME}, lo long"), "windows")
    place = F.struct("d", "lo")
    several = windows.groupBy("a", "h").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last"))).select("a", "h", "first")
    later = windows.join(stored(several, "counts"), ["a", "h"]).filter(~place.eqNullSafe(F.col("first")))
    return runs.unionByName(later.select("d", "t", "lo", F.col("lo").alias("hi")))


def _cut(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = string_buffers(batch.column("text"))
            bounds, lo, hi = run_list(batch)
            for first, last in chunks(offsets):
                own = offsets[first : last + 1] - offsets[first]
                part = data[offsets[first] : offsets[last]]
                begin, end, starts = word_bounds(part, own)
                raw = part.tobytes()
                words, removed, intervals, kept, left = [], [], [], [], []
                for i in range(first, last):
                    a, b = int(starts[i - first]), int(starts[i - first + 1])
                    text = raw[own[i - first] : own[i - first + 1]]
                    words.append(b - a)
                    if bounds[i] == bounds[i + 1]:
                        removed.append(0)
                        intervals.append([])
                        kept.append(b" ".join(text.split()))
                        left.append(text)
                        continue
                    x, y = covered(lo[bounds[i] : bounds[i + 1]], hi[bounds[i] : bounds[i + 1]], window)
                    x, y = x.tolist(), y.tolist()
                    removed.append(sum(y) - sum(x))
                    intervals.append([{"begin": p, "end": q} for p, q in zip(x, y)])
                    stay = [(p, q) for p, q in zip([0, *y], [*x, b - a]) if p < q]
                    kept.append(b" ".join(raw[begin[a + k] : end[a + k]] for p, q in stay for k in range(p, q)))
                    left.append(b"\n".join(raw[begin[a + p] : end[a + q - 1]] for p, q in stay))
                kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                columns = {"text": pa.array(left, pa.binary()).cast(pa.string())}
                if "rest" in batch.schema.names:
                    columns = {"rest": batch.column("rest").slice(first, last - first)} | columns
                else:
                    counts = {"doc_id": batch.column("d").slice(first, last - first), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
                    columns = counts | {"intervals": pa.array(intervals, kind), "kept": pa.array(kept, pa.binary()).cast(pa.string())} | columns
                yield pa.RecordBatch.from_pydict(columns)

    return run


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, intervals (maximal runs of removed words), kept (the other words, joined
    by one space) and text (what lies between the intervals, with its own white space; a line end where a passage went)."""
    unit = Unit("words", window, anchor)
    texts = keyed(docs, id_col, text_col)
    return per_text(texts, later_windows(texts, unit)).mapInArrow(_cut(window), _OUT)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The rows of docs, with all their columns, and repeated passages cut out of the text."""
    unit = Unit("words", window, anchor)
    texts = keyed(docs, id_col, text_col, carry=True)
    found = per_text(texts, later_windows(texts, unit))
    schema = T.StructType([texts.schema["rest"], texts.schema["text"]])
    cut = found.select("text", "runs", "rest").mapInArrow(_cut(window), schema)
    return cut.select(*(F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_words(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
