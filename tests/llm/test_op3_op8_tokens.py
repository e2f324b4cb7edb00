import hashlib
import json
import random
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gazette.llm import op3_bpe, op8_token_files
from gazette.llm.op3_bpe import PairIndex, byte_symbols, codec, digest_bpe, encode_bpe
from gazette.llm.op8_token_files import encoder, open_sequences, read_token_files, write_token_files

PIECES = [*"abcdeAB'streΣİmv  \n\t!19é²ÉΣ漢ßſ́ ", "'ll", "'s ", "<|endoftext|>", "<|startoftext|>", "<|", "ﬁ", "\U0001d7d8", "Ა", "\x1c", "\x85", "​", "don't", " the", "ing"]


def corpus(n=150):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(PIECES) for _ in range(rng.choice([3, 30, 300])))) for i in range(n)]
    rows += [(1000, None), (1001, ""), (1002, "   \n"), (1003, "a" * 5000), (1004, "ab " * 20_000), (5, "same id"), rows[7], rows[7], (-3, "negative")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, ids int, path string").repartition(3)


def test_bpe_matches_library(spark):
    rows = corpus()
    library = Tokenizer.from_file(public_tokenizers.path(op3_bpe.VOCABULARY))
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = digest_bpe(frame(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    full = encode_bpe(frame(spark, rows)).collect()
    assert sorted(hashlib.sha256(r.decoded.encode()).hexdigest() for r in full) == sorted(w[3] for w in want)
    assert digest_bpe(frame(spark, [])).count() == 0


def plain_bpe(word, ranks):
    word = list(word)
    while True:
        best = min(((ranks[a, b], i) for i, (a, b) in enumerate(zip(word, word[1:])) if (a, b) in ranks), default=None)
        if best is None:
            return word
        i = best[1]
        word[i : i + 2] = [word[i] + word[i + 1]]


@pytest.mark.parametrize("seed", range(4))
def test_pair_index_with_any_merge_order(seed):
    """Random merge lists: some merges make pairs of lower rank, and pairs overlap."""
    rng = random.Random(seed)
    base = byte_symbols()
    tokens, merges = [*"ab"], []
    for _ in range(14):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if len(a + b) < 7 and (a, b) not in merges:
            merges.append((a, b))
            tokens.append(a + b)
    rng.shuffle(merges)
    names = [*base, *(s + "</w>" for s in base)]
    names += [a + b for a, b in merges if a + b not in names]
    vocabulary = {}
    for x in [*names, *(p for m in merges for p in m)]:
        vocabulary.setdefault(x, len(vocabulary))
    index = PairIndex(vocabulary, merges)
    ranks = {m: i for i, m in enumerate(merges)}
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(200)]
    flat, sizes = index.encode(words)
    back = {i: t for t, i in vocabulary.items()}
    ends = np.cumsum(sizes)
    for word, a, b in zip(words, ends - sizes, ends):
        want = plain_bpe([*word[:-1], word[-1] + "</w>"], ranks)
        assert [back[i] for i in flat[a:b].tolist()] == want


def test_lexicon_is_bounded():
    own = codec(public_tokenizers.path(op3_bpe.VOCABULARY))
    assert len(list(own.encode([]))) == 0
    library = Tokenizer.from_file(public_tokenizers.path(op8_token_files.VOCABULARY))
    fast, _ = encoder(public_tokenizers.path(op8_token_files.VOCABULARY))
    fast.lexicon._most = 50
    texts = [t or "" for _, t in corpus()]
    for at in range(0, len(texts), 10):
        for x, t in zip(fast.encode(texts[at : at + 10]), texts[at : at + 10]):
            assert x.tolist() == library.encode(t, add_special_tokens=False).ids
    fast.lexicon._most = 1_000_000


def test_files_round_trip(spark):
    rows = corpus()
    library = Tokenizer.from_file(public_tokenizers.path(op8_token_files.VOCABULARY))
    folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    manifest = write_token_files(frame(spark, rows), folder, length=16, rows=4, most=2000)
    got = sorted(read_token_files(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(d for d, _ in rows)
    coded = {}
    for d, t in rows:
        coded.setdefault(d, []).append([*library.encode(t or "", add_special_tokens=False).ids, 0])
    start = 0
    for r in got:
        match = next(x for x in coded[r.doc_id] if len(x) == r.n_tokens and zlib.crc32(np.array(x, dtype="<u4").tobytes()) == r.ids_crc32)
        coded[r.doc_id].remove(match)
        assert r.start == start
        start += r.n_tokens
    files = manifest.collect()
    assert len(files) > 3
    for f in files:  # random access to any sequence
        reader = open_sequences(folder, f.path)
        batches = [reader.get_batch(k) for k in range(reader.num_record_batches)]
        assert batches[0].schema.field("ids").type == pa.list_(pa.uint16(), 16)
        masks = np.concatenate([b.column("mask").flatten().to_numpy(zero_copy_only=False) for b in batches])
        assert masks.sum() == f.n_ids == sum(f.sizes) and len(masks) - f.n_ids < 16
    empty = write_token_files(frame(spark, []), "file://" + tempfile.mkdtemp(prefix="spark-"))
    assert read_token_files(empty, folder).count() == 0


def test_vocabularies_are_read_not_kept():
    with open(public_tokenizers.path(op3_bpe.VOCABULARY), encoding="utf-8") as f:
        assert json.load(f)["model"]["end_of_word_suffix"] == "</w>"
