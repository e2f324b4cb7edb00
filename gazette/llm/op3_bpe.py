"""BPE encoding and decoding with a pair occurrence index.

The distinct new words of a partition's batch become one stream of symbols. An index maps the rank of each mergeable pair to all its
positions in the stream; a heap holds the active ranks. The lowest rank is applied to all its positions at once (left to right within a
word), and the pairs that this makes or breaks with the neighbours update the lists of their ranks. Texts are then looked up word by
word. The vocabulary file is a parameter; nothing is trained.

The vocabulary is one with word ends and byte symbols: texts are brought to NFC and lower case, white space is dropped, and special
tokens in a text are taken whole, as they stand.

Cases: null and empty texts, and texts of white space, have no ids and decode to an empty string; very long texts are encoded whole;
repeated rows are each encoded; a null id is kept; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import normalizers

from gazette.llm.common import table
from gazette.llm.pretokens import Lexicon, WordEncoder

VOCABULARY = "word_bpe_49k.json"
_SUFFIX = "</w>"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class PairIndex:
    """The merges of a vocabulary, applied to many words at once."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str = _SUFFIX):
        symbols = byte_symbols()
        self.inner = np.array([vocabulary[s] for s in symbols], dtype=np.int64)
        self.last = np.array([vocabulary[s + suffix] for s in symbols], dtype=np.int64)
        parts = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.left = np.array([vocabulary[a] for a, _ in parts], dtype=np.int64)
        self.right = np.array([vocabulary[b] for _, b in parts], dtype=np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in parts], dtype=np.int64)
        keys = self.left << 20 | self.right
        # A pair that is listed twice keeps its last rank.
        order = np.lexsort((-np.arange(len(keys)), keys))
        distinct, first = np.unique(keys[order], return_index=True)
        self.keys, self.ranks = distinct, order[first]
        # If a merge can make a pair of lower rank, positions of one word must be merged one by one.
        made: dict[int, int] = {}
        for rank, token in enumerate(self.merged.tolist()):
            made[token] = max(rank, made.get(token, -1))
        self.stepwise = any(made.get(x, -1) > rank for rank, pair in enumerate(zip(self.left.tolist(), self.right.tolist())) for x in pair)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it doesn't merge."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        n = len(data)
        if not n:
            return np.zeros(0, dtype=np.uint32), sizes
        word = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        ends = np.cumsum(sizes)[sizes > 0] - 1
        symbol = self.inner[data].astype(np.int32)
        symbol[ends] = self.last[data[ends]]
        after = np.arange(1, n + 1, dtype=np.int32)
        after[ends] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[ends[:-1] + 1] = -1
        alive = np.ones(n, dtype=bool)

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(positions: np.ndarray) -> None:
            """Adds the pairs that begin at some positions to the lists of their ranks."""
            ranks = self.rank(symbol[positions], symbol[after[positions]])
            positions, ranks = positions[ranks >= 0], ranks[ranks >= 0]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            heads = [0, *cuts.tolist()]
            for a, b, rank in zip(heads, [*heads[1:], len(ranks)], ranks[heads].tolist()):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(heap, rank)
                index[rank].append(positions[a:b])

        for at in range(0, n, 1 << 18):
            own = after[at : at + (1 << 18)]
            note(np.flatnonzero(own >= 0).astype(np.int32) + np.int32(at))
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            left, right = self.left[rank], self.right[rank]
            at = at[alive[at] & (symbol[at] == left) & (after[at] >= 0)]
            at = at[symbol[after[at]] == right]
            if not len(at):
                continue
            if self.stepwise:
                again = np.zeros(len(at), dtype=bool)
                again[1:] = word[at[1:]] == word[at[:-1]]
                if again.any():
                    index[rank] = [at[again]]
                    heapq.heappush(heap, rank)
                    at = at[~again]
            elif left == right and len(at) > 1:
                # Of overlapping pairs every other one merges, from the left.
                linked = np.zeros(len(at), dtype=bool)
                linked[1:] = after[at[:-1]] == at[1:]
                head = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
            gone = after[at]
            then = after[gone]
            symbol[at] = self.merged[rank]
            after[at] = then
            alive[gone] = False
            before[then[then >= 0]] = at[then >= 0]
            earlier = before[at]
            touched = np.concatenate([at[then >= 0], earlier[earlier >= 0]])
            note(np.unique(touched) if len(touched) > 1 else touched)
        return symbol[alive].astype(np.uint32), np.bincount(word[alive], minlength=len(raw))


class Codec:
    """One vocabulary file: normalisation, splitting, encoding by :class:`PairIndex`, decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pairs = PairIndex(model["vocab"], model["merges"])
        self.encode = WordEncoder(special, Lexicon(self.pairs.encode), spaced=False, normal=self.normal).encode
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in special.items()}
        raw = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self._bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self._ends = np.cumsum([len(x) for x in raw])
        self._nfc, self._lower = normalizers.NFC(), normalizers.Lowercase()
        every = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x110000)]]
        odd = [a for a, b in zip(every, self._lower.normalize_str("\0".join(every)).split("\0")) if a.lower() != b]
        # Characters that the library lowers in another way than Python: those texts go through the library's normaliser.
        self._odd = regex.compile("[" + regex.escape("".join([*odd, "Σ"])) + "]")

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = self._nfc.normalize_str(text)
        return self._lower.normalize_str(text) if self._odd.search(text) else text.lower()

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings, joined by spaces (this vocabulary names no decoder), as UTF-8."""
        if not len(ids):
            return b""
        ends = self._ends[ids]
        starts = np.where(ids > 0, self._ends[np.maximum(ids.astype(np.int64) - 1, 0)], 0)
        sizes = ends - starts
        stop = np.cumsum(sizes)
        at = np.arange(int(stop[-1])) + np.repeat(starts - stop + sizes, sizes)
        return self._bytes[at[:-1]].tobytes()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _batches(path: str, full: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                counts, ids, digests, decoded = [], [], [], []
                for x in own.encode(part.column("text").to_pylist()):
                    raw, text = x.astype("<u4").tobytes(), own.decode(x)
                    counts.append(len(x))
                    digests.append(hashlib.sha256(raw).hexdigest())
                    decoded.append(text.decode() if full else hashlib.sha256(text).hexdigest())
                    ids.append(x if full else None)
                columns = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(counts, pa.int64())}
                if full:
                    columns |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
                else:
                    columns |= {"ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def encode_bpe(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids, and decoded, the decoding of the ids."""
    path = path or public_tokenizers.path(VOCABULARY)
    return _texts(docs, id_col, text_col).mapInArrow(_batches(path, True), "doc_id long, n_tokens long, ids array<int>, decoded string")


def digest_bpe(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_bpe`, with SHA-256 digests of ids (little-endian, 32 bits) and decoded text instead of both."""
    path = path or public_tokenizers.path(VOCABULARY)
    return _texts(docs, id_col, text_col).mapInArrow(_batches(path, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_bpe(table(spark, sf_dir, "documents"))
