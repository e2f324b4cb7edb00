"""Token-ID output: Arrow files of fixed-size-list batches, for zero-copy random access to equal-length sequences and masks.

The files are in Arrow's IPC file format, which is its stream of record batches closed by a footer with the place of each batch: a reader
maps a file and takes any batch without reading those before it, which the bare stream format doesn't allow.

Documents are dealt by ranges of their id and sorted, encoded, closed with an end id and written one after another. A file holds record
batches of ``rows`` sequences of ``length`` ids each, and masks that are true for ids and false for the padding of a file's last
sequence; ids have 16 bits where the vocabulary allows. Id ``i`` of a file lies in sequence ``i // length``, so a reader maps the file
and slices it. A manifest tells for each file the documents and their numbers of ids. Files are named after partition and number
and moved into place when complete, so a task that runs again replaces its own files.

Cases: null and empty texts have the end id alone; null ids come first; rows with the same id are ordered by a hash of their text;
a document longer than a file ends it; a very long text is one
row and may span many batches; an empty table gives no file and no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from gazette.llm.common import scratch, stored, table
from gazette.llm.pretokens import Lexicon, WordEncoder

VOCABULARY = "byte_bpe_50k.json"
END = 0
LENGTH = 1024
ROWS = 64
#: Ids of one file, about; documents are not cut.
FILE = 8 << 20
_MANIFEST = "part int, number int, path string, n_ids long, doc_ids array<long>, sizes array<long>"
_ENCODERS: dict[str, tuple[WordEncoder, int]] = {}


def encoder(path: str) -> tuple[WordEncoder, int]:
    """The library's encoding, asked once for each distinct word; and the size of the vocabulary."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work; a task has one core
        library = Tokenizer.from_file(path)
        library.no_padding()
        library.no_truncation()
        with open(path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}

        def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = [x.ids for x in library.encode_batch(words, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            return np.fromiter((i for x in found for i in x), dtype=np.uint32, count=int(sizes.sum())), sizes

        _ENCODERS[path] = WordEncoder(special, Lexicon(encode), spaced=True), library.get_vocab_size(with_added_tokens=True)
    return _ENCODERS[path]


class SequenceFile:
    """One file under construction."""

    def __init__(self, files: fs.FileSystem, path: str, kind: np.dtype, length: int, rows: int):
        self.files, self.path, self.kind, self.length, self.rows = files, path, kind, length, rows
        self.temporary = f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}"
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = files.open_output_stream(self.temporary, compression=None)
        self.writer = ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.size = self.total = 0
        self.docs: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.sizes.append(len(ids))
        self.held.append(ids.astype(self.kind))
        self.size += len(ids)
        self.total += len(ids)
        block = self.length * self.rows
        if self.size >= block:
            flat = np.concatenate(self.held)
            whole = len(flat) // block * block
            for at in range(0, whole, block):
                self._write(flat[at : at + block], block)
            self.held, self.size = [flat[whole:]], len(flat) - whole

    def _write(self, ids: np.ndarray, valid: int) -> None:
        mask = np.arange(len(ids)) < valid
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.size:
            flat = np.concatenate(self.held)
            self._write(np.append(flat, np.zeros(-len(flat) % self.length, dtype=self.kind)), len(flat))
        self.writer.close()
        self.sink.close()
        if self.files.get_file_info(self.path).type != fs.FileType.NotFound:
            self.files.delete_file(self.path)
        self.files.move(self.temporary, self.path)


def _write(folder: str, path: str, end: int, length: int, rows: int, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vocabulary = encoder(path)
        kind = np.dtype("<u2" if max(vocabulary, end + 1) <= 1 << 16 else "<u4")
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        part, number, file = TaskContext.get().partitionId(), 0, None

        def done() -> pa.RecordBatch:
            file.close()
            row = {"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "path": [file.path], "n_ids": pa.array([file.total], pa.int64())}
            return pa.RecordBatch.from_pydict(row | {"doc_ids": pa.array([file.docs], pa.list_(pa.int64())), "sizes": pa.array([file.sizes], pa.list_(pa.int64()))})

        for batch in batches:
            for at in range(0, len(batch), 4096):
                some = batch.slice(at, 4096)
                for doc, ids in zip(some.column("doc_id").to_pylist(), own.encode(some.column("text").to_pylist())):
                    if file is None:
                        file = SequenceFile(files, f"{root}/ids-{part:06d}-{number:04d}.arrow", kind, length, rows)
                    file.add(doc, np.append(ids, np.uint32(end)))
                    if file.total >= most:
                        yield done()
                        file, number = None, number + 1
        if file is not None:
            yield done()

    return run


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end: int = END, length: int = LENGTH, rows: int = ROWS, most: int = FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents in ascending id order below ``folder`` (a URI that driver and executors share); returns the manifest.

    The manifest has part, number, path, n_ids, doc_ids, sizes and start, the number of ids in all files before.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    # The hash of the text parts rows that share an id (or have none).
    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = texts.repartitionByRange(*order).sortWithinPartitions(*order)
    written = stored(dealt.mapInArrow(_write(folder, path or public_tokenizers.path(VOCABULARY), end, length, rows, most), _MANIFEST), "manifest")
    # One number for each partition reaches the driver.
    before, bases = 0, {}
    for r in written.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").toLocalIterator():
        bases[r["part"]] = before
        before += r["n"]
    base = written.sparkSession.createDataFrame(list(bases.items()), "part int, base long")
    earlier = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written.select("part", "number", earlier.alias("earlier")).join(base, "part").select("part", "number", (F.col("base") + F.col("earlier")).alias("start"))
    return written.join(starts, ["part", "number"])


def open_sequences(folder: str, path: str) -> ipc.RecordBatchFileReader:
    """A reader of one file; local files are mapped, not read."""
    files, _ = fs.FileSystem.from_uri(folder)
    if isinstance(files, fs.LocalFileSystem):
        return ipc.open_file(pa.memory_map(path))
    return ipc.open_file(files.open_input_file(path))


def _read(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                docs, sizes = batch.column("doc_ids")[row].values, batch.column("sizes")[row].values.to_numpy()
                ends = np.cumsum(sizes)
                crcs = []
                reader = open_sequences(folder, batch.column("path")[row].as_py())
                k = at = have = 0
                for n in sizes.tolist():
                    crc = 0
                    while n:
                        if at == have:  # the next batch, mapped and not copied; its mask ends where the padding starts
                            part = reader.get_batch(k)
                            ids = part.column("ids").flatten().to_numpy()
                            k, at, have = k + 1, 0, int(part.column("mask").flatten().to_numpy(zero_copy_only=False).sum())
                        some = min(n, have - at)
                        crc = zlib.crc32(ids[at : at + some].astype("<u4").tobytes(), crc)
                        at, n = at + some, n - some
                    crcs.append(crc)
                start = batch.column("start")[row].as_py() + ends - sizes
                yield pa.RecordBatch.from_pydict({"doc_id": docs, "start": pa.array(start), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(crcs, pa.int64())})

    return run


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each document, from the files: doc_id, start, n_tokens (with the end id) and the CRC-32 of its ids as 32-bit integers."""
    # A row of the manifest is small, the file behind it is not: deal files, not bytes of the manifest. A task takes several files in turn
    # where there are more of them than four times the cores.
    most = max(200, 4 * manifest.sparkSession.sparkContext.defaultParallelism)
    dealt = manifest.repartition(max(1, min(manifest.count(), most)))
    return dealt.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), folder), folder)
