"""Every window of W consecutive tokens that occurs more than once in a corpus, exactly, without a row for each window.

Tokens are UTF-8 bytes or words. Two passes, shared by the suffix sort (bytes) and by the window counts (words), drop what can't repeat:

1. *Anchor pass.* In each window the least k-token hash (leftmost on ties) is its anchor. The choice depends on the window's content
   alone, so equal windows have equal anchors. Neighbouring windows with the same anchor form one *span*, about a row for each
   (W - k) / 2 tokens. Windows of a span whose anchor occurs once in the corpus are unique.
2. *Span pass.* Spans with equal anchor and equal content: all their windows repeat together. Spark counts (anchor, content) with
   partial aggregation, so that groups of copies of any size become one row for each task.

What is left are anchors with several contents, one representative for each. :func:`repeated` orders their suffixes by
most-significant-digit passes over the bytes themselves (:func:`msd_groups`), inside a task for up to ``GROUP`` contents; larger groups
go through the two passes again with longer anchors, up to the whole window, where every group is settled by its count.
:mod:`gazette.llm.op5_substring_dedup` has Spark count the hash of each of their windows instead.

Hashes are 64-bit Rabin-Karp range hashes; a verdict by hashes needs two of them (anchor and content) to agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import dropped, stored
from gazette.llm.kernels import RangeHash, chunks, mix64, sliding_min, string_buffers, word_bounds, word_hashes

#: Contents of one anchor that one task compares; larger groups are told apart by longer anchors first.
GROUP = 64
#: Type of the second half of a row's name, beside its id: two 64-bit hashes of its text.
NAME = "struct<h: bigint, g: bigint>"
#: Tokens hashed at once; longer texts are cut into overlapping pieces.
PIECE = 1 << 20
_POSITION = np.uint64((1 << 24) - 1)
_GRAM = 8


class Unit:
    """How a text becomes tokens. ``cut`` gives, for a chunk, token values, the token number at which each text starts, and byte bounds."""

    def __init__(self, name: str, window: int, anchor: int):
        if not 0 < anchor <= window:
            raise ValueError("the anchor must not be longer than the window")
        if name == "bytes" and anchor < _GRAM:
            raise ValueError(f"byte anchors have {_GRAM} bytes at least")
        self.name, self.window, self.anchor = name, window, anchor
        rest = window - anchor
        self.deeper = sorted({window - rest * share // 100 for share in (48, 16, 0)} - {anchor}) or [window]
        # Bytes are hashed as overlapping 8-byte grams: a window of W bytes is W - 7 grams.
        less = _GRAM - 1 if name == "bytes" else 0
        self.less, self.values_in_window, self.values_in_anchor = less, window - less, anchor - less

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Callable[[int, int], np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        if self.name == "bytes":
            place = np.arange(len(data) + 1)
            return lambda a, b: grams(data[a : min(b + _GRAM - 1, len(data))]), offsets, place[:-1], place[1:]
        begin, end, starts = word_bounds(data, offsets)
        values = word_hashes(data, begin, end)
        return lambda a, b: values[a:b], starts, begin, end


def grams(data: np.ndarray) -> np.ndarray:
    if len(data) < _GRAM:
        return np.zeros(0, dtype=np.uint64)
    raw = np.ascontiguousarray(data)
    return mix64(np.ndarray((len(raw) - _GRAM + 1,), dtype="<u8", buffer=raw.data, strides=(1,)).astype(np.uint64))


def _pieces(unit: Unit, get: Callable, starts: np.ndarray, anchor: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, RangeHash, int]]:
    """For each piece of the chunk: text number, first and last window start (within the piece), anchor hash, hashes, offset."""
    total = int(starts[-1])
    for base in range(0, total, PIECE):
        values = get(base, min(total, base + PIECE + unit.window - 1))
        if len(values) < unit.values_in_window:
            continue
        hashes = RangeHash(values)
        anchors = hashes.windows(anchor - unit.less)
        ranked = (anchors & ~_POSITION) | np.arange(len(anchors), dtype=np.uint64)
        least = sliding_min(ranked, unit.window - anchor + 1)[:PIECE]
        start = np.arange(len(least))
        text = np.searchsorted(starts, start + base, side="right") - 1
        whole = start + base + unit.window <= starts[text + 1]
        start, text, at = start[whole], text[whole], (least[whole] & _POSITION).astype(np.int64)
        if not len(start):
            continue
        new = np.ones(len(start), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        yield text[first], start[first], start[last], anchors[at[first]], hashes, base


_PLAIN = f"d long, t {NAME}, a long, s long, lo long, hi long"
#: ``more`` lists further starts in the same piece of text where the same span begins: periodic texts have thousands.
SPANS = _PLAIN + ", more array<long>"
_RUNS = f"d long, t {NAME}, lo long, hi long"


def _content(unit: Unit, hashes: RangeHash, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of all bytes of each span and of their number: the gram of NUL bytes is zero, which alone doesn't tell how many end a span."""
    return mix64(hashes.of(lo, hi + unit.values_in_window) + (hi - lo + 1).astype(np.uint64))


def _as_table(columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One array, also of a column in several chunks or in none."""
    if isinstance(column, pa.ChunkedArray):
        return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], type=column.type)
    return column


def _spans(unit: Unit) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = string_buffers(batch.column("text"))
            for first, last in chunks(offsets):
                own = offsets[first : last + 1] - offsets[first]
                get, starts, _, _ = unit.cut(data[offsets[first] : offsets[last]], own)
                for text, lo, hi, anchor, hashes, base in _pieces(unit, get, starts, unit.anchor):
                    content = _content(unit, hashes, lo, hi)
                    order = np.lexsort((lo, content, anchor, text))
                    text, lo, hi, anchor, content = text[order], lo[order], hi[order], anchor[order], content[order]
                    new = np.ones(len(text), dtype=bool)
                    new[1:] = (content[1:] != content[:-1]) | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                    shift = base - starts[text]
                    head = np.flatnonzero(new)
                    ends = np.append(0, np.cumsum(np.diff(np.append(head, len(new))) - 1)).astype(np.int32)
                    more = pa.ListArray.from_arrays(pa.array(ends), pa.array((lo + shift)[~new]))
                    row = pa.array(text[head] + first)
                    columns = {"d": batch.column("d").take(row), "t": batch.column("t").take(row), "a": anchor[head].view(np.int64), "s": content[head].view(np.int64)}
                    yield _as_table(columns | {"lo": (lo + shift)[head], "hi": (hi + shift)[head], "more": more})

    return run


def unrepeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches without the rows whose id and text this task has had before."""
    seen = set()
    for batch in batches:
        names = list(zip(batch.column("d").to_pylist(), ((x["h"], x["g"]) for x in batch.column("t").to_pylist())))
        fresh = []
        for name in names:
            fresh.append(name not in seen)
            seen.add(name)
        if any(fresh):
            yield batch if all(fresh) else batch.filter(pa.array(fresh))


def wanted_spans(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the column ``wanted``: bounds of each row's spans, and all anchors, first and last starts."""
    flat = batch.column("wanted").flatten()
    ends = np.append(0, np.cumsum(batch.column("wanted").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)
    return ends, *(flat.field(k).to_numpy(zero_copy_only=False) for k in ("a", "lo", "hi"))


def _contents(unit: Unit) -> Callable:
    """The bytes of each wanted span, from the texts that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unrepeated(batches):
            offsets, data = string_buffers(batch.column("text"))
            ends, a, lo, hi = wanted_spans(batch)
            for first, last in chunks(offsets):
                own = offsets[first : last + 1] - offsets[first]
                part = data[offsets[first] : offsets[last]]
                _, starts, begin, end = unit.cut(part, own)
                i = np.arange(ends[first], ends[last])
                if not len(i):
                    continue
                text = np.searchsorted(ends, i, side="right") - 1
                contents = batch.column("wanted").flatten().field("contents").to_numpy(zero_copy_only=False)[i]
                left, right = begin[starts[text - first] + lo[i]], end[starts[text - first] + hi[i] + unit.window - 1]
                raw = part.tobytes()
                row = pa.array(text)
                content = pa.array([raw[x:y] for x, y in zip(left.tolist(), right.tolist())], type=pa.binary())
                yield _as_table({"d": batch.column("d").take(row), "t": batch.column("t").take(row), "a": a[i], "lo": lo[i], "hi": hi[i], "contents": contents, "content": content})

    return run


def msd_groups(digit: Callable[[int, np.ndarray], np.ndarray], passes: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Radix sort by most significant digit, depth-limited: members of equal groups after the last pass, and their group numbers.

    ``digit(p, rows)`` is the p-th digit of those rows. A group of one leaves at the pass that isolates it.
    """
    rows = np.argsort(group, kind="stable")
    group = group[rows]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = group[1:] != group[:-1]
    for p in range(passes + 1):
        number = np.cumsum(new) - 1
        shared = (np.bincount(number)[number] > 1) if len(number) else new
        rows, group = rows[shared], number[shared]
        if p == passes or not len(rows):
            break
        value = digit(p, rows)
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        if np.any(new[1:] & (group[1:] == group[:-1])):  # else all digits of each group are equal
            order = np.lexsort((value, group))
            rows, group, value = rows[order], group[order], value[order]
            new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
    return rows, group


def _runs(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges window starts of a row into runs."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return row[first], start[first], start[np.append(first[1:], len(row)) - 1] if len(row) else start[first]


def _windows(unit: Unit, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of the contents: row, start in the text, and place of the first byte in the bytes that hold them all."""
    offsets, data = string_buffers(table.column("content"))
    lo = whole(table.column("lo")).to_numpy(zero_copy_only=False)
    count = np.maximum(np.diff(offsets) - unit.window + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, lo[row] + inner, offsets[row] + inner, data


def _once(table: pa.Table) -> pa.Table:
    """Rows that are repeated come with equal spans: one of each is enough."""
    seen, kept = set(), []
    for i, key in enumerate(zip(*(whole(table.column(c)).to_pylist() for c in ("a", "d", "lo")), ((x["h"], x["g"]) for x in whole(table.column("t")).to_pylist()))):
        if key not in seen:
            seen.add(key)
            kept.append(i)
    return table if len(kept) == len(table) else table.take(pa.array(kept, pa.int64()))


def _resolve(unit: Unit) -> Callable:
    """Sorts the suffixes of representatives of the same anchor, by digits of eight bytes, through the window; rows come sorted by anchor."""
    width = min(_GRAM, unit.window)
    passes = -(-unit.window // width)

    def settle(table: pa.Table) -> pa.RecordBatch:
        table = _once(table)
        anchor = whole(table.column("a")).to_numpy()
        row, start, place, data = _windows(unit, table)
        if not len(row):
            return None
        raw = np.ascontiguousarray(data)
        words = np.ndarray((len(raw) - width + 1,), dtype=">u8", buffer=raw.data, strides=(1,))
        # The last digit ends with the window, and may overlap the one before.
        found, _ = msd_groups(lambda p, at: words[place[at] + min(p * width, unit.window - width)].astype(np.uint64), passes, anchor[row])
        row, lo, hi = _runs(row[found], start[found])
        at = pa.array(row)
        return _as_table({"d": whole(table.column("d").take(at)), "t": whole(table.column("t").take(at)), "lo": lo, "hi": hi})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                anchor = part.column("a").to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
                if cut or (held and held[-1].column("a")[-1].as_py() != anchor[0]):
                    if cut:
                        held.append(part.slice(0, cut))
                    if (out := settle(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                held.append(part.slice(cut))
        if held and (out := settle(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def _finer(unit: Unit, anchor: int) -> Callable:
    """Cuts span contents into the spans of a longer anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = string_buffers(batch.column("content"))
            outer, base_lo = batch.column("a").to_numpy().view(np.uint64), batch.column("lo").to_numpy()
            for first, last in chunks(offsets):
                own = offsets[first : last + 1] - offsets[first]
                part = data[offsets[first] : offsets[last]]
                get, starts, begin, end = unit.cut(part, own)
                raw = part.tobytes()
                for text, lo, hi, inner, hashes, base in _pieces(unit, get, starts, anchor):
                    row = pa.array(text + first)
                    left, right = begin[base + lo], end[base + hi + unit.window - 1]
                    shift = base - starts[text] + base_lo[text + first]
                    columns = {"d": batch.column("d").take(row), "t": batch.column("t").take(row), "a": mix64(inner ^ outer[text + first]).view(np.int64)}
                    columns |= {"s": _content(unit, hashes, lo, hi).view(np.int64), "lo": lo + shift, "hi": hi + shift}
                    yield _as_table(columns | {"content": pa.array([raw[x:y] for x, y in zip(left.tolist(), right.tolist())], type=pa.binary())})

    return run


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(d, t, text): id, two hashes of the text, and the text with null as empty. d and t name a row; rows equal in both share verdicts.

    With ``carry`` a struct ``rest`` holds all other columns.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rest = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("rest")] if carry else []
    return docs.select(F.col(id_col).cast("long").alias("d"), F.struct(F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g")).alias("t"), text.alias("text"), *rest)


def spans_table(texts: DataFrame, unit: Unit) -> DataFrame:
    return stored(texts.mapInArrow(_spans(unit), SPANS), "spans")


def left_over(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Texts that hold representatives of anchors with several contents, with ``wanted``, an array of (a, lo, hi, contents)."""
    several = known.filter("contents > 1").select("first.d", "first.t", F.struct("a", F.col("first.lo").alias("lo"), F.col("first.hi").alias("hi"), "contents").alias("x"))
    wanted = several.groupBy("d", "t").agg(F.collect_list("x").alias("wanted")).withColumnsRenamed({"d": "wd", "t": "wt"})
    return texts.join(wanted, F.col("d").eqNullSafe(F.col("wd")) & (F.col("t") == F.col("wt"))).drop("wd", "wt")


def repeated(texts: DataFrame, unit: Unit, group: int = GROUP) -> DataFrame:
    """Runs of repeated byte windows: (d, t, lo, hi), first and last window start of each run.

    ``texts`` comes from :func:`keyed`. Runs of a text may touch, overlap or come twice.

    Contents carry their anchor's number of contents, so that what is dealt by anchor is a stored table and no join: over a join by the same
    key Spark leaves out the second shuffle, and may then read the first one where it was written, with an anchor's rows in several tasks.
    """
    texts = texts.select("d", "t", "text")
    _, known, runs = counted(spans_table(texts, unit), False)
    contents = stored(left_over(texts, known).mapInArrow(_contents(unit), f"d long, t {NAME}, a long, lo long, hi long, contents long, content binary"), "contents")
    for anchor in unit.deeper:
        few, many = contents.filter(F.col("contents") <= group), contents.filter(F.col("contents") > group)
        runs = runs.unionByName(few.repartition("a").sortWithinPartitions("a").mapInArrow(_resolve(unit), _RUNS))
        if many.isEmpty():
            return runs
        finer = stored(many.mapInArrow(_finer(unit, anchor), _PLAIN + ", content binary").withColumn("more", F.array().cast("array<bigint>")), "finer")
        finer, known, members = counted(finer, False)
        runs = runs.unionByName(members)
        first = known.filter("contents > 1").select("a", "s", F.col("first.d").alias("d0"), F.col("first.lo").alias("lo0"))
        contents = finer.join(first, ["a", "s"]).filter(F.col("d").eqNullSafe(F.col("d0")) & (F.col("lo") == F.col("lo0")))
        contents = stored(contents.select("d", "t", "a", "lo", "hi", "contents", "content"), "contents")
    return runs


def counted(spans: DataFrame, keep_first: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans whose anchor occurs more than once; their (anchor, content) pairs with the first places; the runs of copied spans.

    The first counts move two hashes a row; places and contents move only for anchors that recur.
    """
    times = F.size("more") + 1
    anchors = spans.groupBy("a", "s").agg(F.sum(times).alias("n")).groupBy("a").agg(F.count(F.lit(1)).alias("contents"), F.sum("n").alias("total"))
    anchors = stored(anchors.filter("total > 1").drop("total"), "anchors")  # both sides of the join are then plain, so that Spark can split a hot anchor
    hits = stored(spans.join(anchors, "a"), "hits")
    dropped(spans)
    known = hits.groupBy("a", "s", "contents").agg(F.sum(times).alias("n"), F.min(F.struct("d", "lo", "t", "hi")).alias("first"))
    known = stored(known, "known")
    copies = known.filter("n > 1").select("a", "s", F.col("first.d").alias("d0"), F.col("first.lo").alias("lo0"))
    members = hits.join(copies, ["a", "s"])
    members = members.select("d", "t", "d0", "lo0", (F.col("hi") - F.col("lo")).alias("more_starts"), F.explode(F.concat(F.array("lo"), "more")).alias("lo"))
    if keep_first:
        members = members.filter(~(F.col("d").eqNullSafe(F.col("d0")) & (F.col("lo") == F.col("lo0"))))
    return hits, known, members.select("d", "t", "lo", (F.col("lo") + F.col("more_starts")).alias("hi"))


def per_text(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """texts with ``runs``, an array of (lo, hi), null where nothing repeats. Repeated rows bring each run as often as they came; it is listed once."""
    gathered = runs.groupBy("d", "t").agg(F.collect_set(F.struct("lo", "hi")).alias("runs")).withColumnsRenamed({"d": "rd", "t": "rt"})
    return texts.join(gathered, F.col("d").eqNullSafe(F.col("rd")) & (F.col("t") == F.col("rt")), "left").drop("rd", "rt")


def covered(lo: np.ndarray, hi: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [begin, end) of tokens under windows that start at lo..hi."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(hi[order] + window)
    new = np.ones(len(lo), dtype=bool)
    new[1:] = lo[1:] > end[:-1]
    first = np.flatnonzero(new)
    return lo[first], end[np.append(first[1:], len(lo)) - 1]
