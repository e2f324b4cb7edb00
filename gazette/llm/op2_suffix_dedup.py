"""Suffix-array dedup: a depth-limited radix sort of all suffixes, most significant digit first, only through the threshold.

Suffixes that are equal through ``window`` bytes are repeated windows. Before the sort, the anchor and span passes of
:mod:`gazette.llm.repeats` let go of suffixes that no other can equal and settle whole copies by their count. The rest is sorted by
digits of eight bytes of the text itself, from the first: a suffix leaves at the pass that tells it apart from all others, so only the
few that share a long passage reach full depth, and nothing is sorted further than the threshold.

Cases: null and empty texts and texts shorter than the window give no span; a row that appears twice (same id and text) repeats
itself; rows with the same id and other texts are other texts; a null id is kept as such; ties need no order, since all of a group go;
a very long text is cut into overlapping pieces of a bounded size; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.common import table
from gazette.llm.kernels import string_buffers
from gazette.llm.repeats import Unit, covered, keyed, per_text, repeated

WINDOW = 400
ANCHOR = 128
_OUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<begin: long, end: long>>, kept binary"


def run_list(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of each row's runs, and all first and last starts."""
    runs = batch.column("runs")
    lengths = runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = runs.flatten()
    lo, hi = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("lo", "hi"))
    return np.append(0, np.cumsum(lengths)), lo, hi


def _cut(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = string_buffers(batch.column("text"))
            bounds, lo, hi = run_list(batch)
            raw, spans, kept, removed = data.tobytes(), [], [], []
            for i in range(len(batch)):
                own = raw[offsets[i] : offsets[i + 1]]
                if bounds[i] == bounds[i + 1]:
                    spans.append([])
                    kept.append(own)
                    removed.append(0)
                    continue
                begin, end = covered(lo[bounds[i] : bounds[i + 1]], hi[bounds[i] : bounds[i + 1]], window)
                begin, end = begin.tolist(), end.tolist()
                spans.append([{"begin": b, "end": e} for b, e in zip(begin, end)])
                kept.append(b"".join(own[a:b] for a, b in zip([0, *end], [*begin, len(own)])))
                removed.append(sum(end) - sum(begin))
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("d"), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})

    return run


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, spans (maximal removed byte runs) and kept (remaining bytes)."""
    unit = Unit("bytes", window, anchor)
    texts = keyed(docs, id_col, text_col)
    return per_text(texts, repeated(texts, unit)).mapInArrow(_cut(window), _OUT)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
