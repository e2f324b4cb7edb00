"""Vectorised pre-tokenisation: splits chunks of text into words by character class, and encodes each distinct word once in a worker.

Two splitting rules are known. ``spaced`` keeps white space and lets one leading space belong to a word (byte-level vocabularies);
``bare`` drops white space and takes digits one by one (vocabularies with word ends). Both take the contractions 's 't 're 've 'm 'll 'd.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import regex
from tokenizers import Regex, pre_tokenizers

from gazette.llm.kernels import CHUNK_BYTES, RangeHash, mix64

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_CLASSES: list[np.ndarray] = []
_VALUES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point, as the tokenizers' own regular expressions see it."""
    if not _CLASSES:
        table = np.zeros(0x110000, dtype=np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            # Whatever the regex module calls so is a candidate; the tokenizers may know an earlier Unicode.
            candidates = "".join(regex.findall(pattern, every))
            rule = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
            for at in range(0, len(candidates), 4096):
                table[[ord(c) for c, _ in rule.pre_tokenize_str(candidates[at : at + 4096])]] = kind
        _CLASSES.append(table)
    return _CLASSES[0]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each begins (n + 1)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)


_SHORT = [ord(c) for c in "stmd"]
_LONG = [(ord("r"), ord("e")), (ord("v"), ord("e")), (ord("l"), ord("l"))]


def _contractions(points: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Length of the contraction at each apostrophe, 0 where there is none; ``stop`` is where its text ends."""
    padded = np.append(points, np.zeros(2, dtype=points.dtype))
    one, two = padded[at + 1], padded[at + 2]
    out = np.where(np.isin(one, _SHORT) & (at + 1 < stop), 2, 0)
    for a, b in _LONG:
        out = np.where((out == 0) & (one == a) & (two == b) & (at + 2 < stop), 3, out)
    return out


def split(points: np.ndarray, offsets: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word of a chunk."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    first = first[:n]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    if not spaced:
        start |= kind == NUMBER
    # An apostrophe that begins a run of other characters (and takes no space in front) may begin a contraction.
    quote = np.flatnonzero((points == 0x27) & start)
    if spaced:
        before = np.where(quote > 0, points[quote - 1] == 0x20, False) & ~first[quote]
        quote = quote[~before]
    if len(quote):
        stop = offsets[np.searchsorted(offsets, quote, side="right")]
        size = _contractions(points, quote, stop)
        quote, size, stop = quote[size > 0], size[size > 0], stop[size > 0]
        inner = np.concatenate([quote + 1, quote[size == 3] + 2])
        start[inner] = False
        after = quote + size
        start[after[after < n]] = True
    if spaced:
        # In front of a word, the last of a run of white space stands apart: a plain space joins the word.
        ends = np.flatnonzero(start[1:] & ~first[1:] & (kind[:-1] == SPACE) & (kind[1:] != SPACE)) + 1
        start[ends - 1] = True
        start[ends[points[ends - 1] == 0x20]] = False
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], n)
    if not spaced:
        keep = kind[begin] != SPACE
        begin, end = begin[keep], end[keep]
    return begin, end


def hashes(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(begin):
        return np.zeros(0, dtype=np.uint64)
    if not _VALUES:
        _VALUES.append(mix64(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)))
    return mix64(RangeHash(_VALUES[0][points]).of(begin, end) + (end - begin).astype(np.uint64))


class Lexicon:
    """Ids of the words that this Python worker has met; bounded, and emptied when full."""

    _BITS = 21

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 1_000_000):
        """``encode`` gives all ids of some words, and the number of ids of each."""
        self._encode, self._most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)  # sorted, with the slot of each
        self.slots = np.zeros(0, dtype=np.int32)
        self.by_slot = np.zeros(1, dtype=np.uint64)  # key of each slot; slot 0 is no word
        self.offsets = np.zeros(2, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)
        self._direct = np.zeros(1 << self._BITS, dtype=np.int32)  # a slot for the leading bits of a key

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, 0 where it isn't known."""
        slot = self._direct[keys >> np.uint64(64 - self._BITS)]
        rest = np.flatnonzero(self.by_slot[slot] != keys)
        slot[rest] = 0
        if len(rest) and len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, keys[rest]), len(self.keys) - 1)
            slot[rest] = np.where(self.keys[place] == keys[rest], self.slots[place], 0)
        return slot

    def read(self, chunks: Iterable[list[str]], spaced: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """Slots of the words of each chunk of texts, and the number of words of each text. All new words are encoded together."""
        if len(self.keys) > self._most:
            self._clear()
        found, fresh, words = [], [], []
        for texts in chunks:
            points, offsets = code_points(texts)
            begin, end = split(points, offsets, spaced)
            keys = hashes(points, begin, end)
            slots = self._find(keys)
            unknown = np.flatnonzero(slots == 0)
            missing = keys[unknown]
            found.append((slots, np.diff(np.searchsorted(begin, offsets)), unknown, missing))
            if len(missing):
                distinct, at = np.unique(missing, return_index=True)
                fresh.append(distinct)
                text, at = "".join(texts), unknown[at]
                words += [text[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist())]
        if fresh:
            distinct, at = np.unique(np.concatenate(fresh), return_index=True)
            flat, sizes = self._encode([words[i] for i in at.tolist()])
            slots = np.arange(len(self.by_slot), len(self.by_slot) + len(distinct), dtype=np.int32)
            self.by_slot = np.concatenate([self.by_slot, distinct])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, flat.astype(np.uint32)])
            place = np.searchsorted(self.keys, distinct)
            self.keys, self.slots = np.insert(self.keys, place, distinct), np.insert(self.slots, place, slots)
            self._direct[distinct >> np.uint64(64 - self._BITS)] = slots
            for slots, _, unknown, missing in found:
                slots[unknown] = self._find(missing)
        return [(slots, counts) for slots, counts, _, _ in found]

    def ids_of(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a stream of words, and the number of ids of each."""
        first = self.offsets[slot]
        sizes = self.offsets[slot + 1] - first
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(first - ends + sizes, sizes)], sizes


class WordEncoder:
    """Encodes texts word by word; special tokens in a text are taken whole, as they stand."""

    def __init__(self, special: dict[str, int], lexicon: Lexicon, spaced: bool, normal: Callable[[str], str] = lambda text: text):
        self.special, self.lexicon, self._spaced, self._normal = special, lexicon, spaced, normal
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        pieces, plan = [], []  # for each text, numbers of its pieces, or -1 and the id of a special token
        for text in texts:
            own: list[tuple[int, int]] = []
            for part in self._split.split(text) if self._split and self._split.search(text) else [text]:
                if part in self.special:
                    own.append((-1, self.special[part]))
                elif part:
                    own.append((len(pieces), 0))
                    pieces.append(self._normal(part))
            plan.append(own)
        chunks, first = [], 0
        while first < len(pieces):
            last, size = first, 0
            while last < len(pieces) and (last == first or size + len(pieces[last]) <= CHUNK_BYTES):
                size += len(pieces[last])
                last += 1
            chunks.append(pieces[first:last])
            first = last
        ids: list[np.ndarray] = []
        for slots, counts in self.lexicon.read(chunks, self._spaced):
            flat, sizes = self.lexicon.ids_of(slots)
            at = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))].tolist()
            ids += [flat[a:b] for a, b in zip(at[:-1], at[1:])]
        for own in plan:
            parts = [ids[i] if i >= 0 else np.array([token], dtype=np.uint32) for i, token in own]
            yield parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
