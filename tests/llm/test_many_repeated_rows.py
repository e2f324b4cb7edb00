import random

from test_repeats import brute_words, frame

from gazette.llm.op2_suffix_dedup import remove_repeated_bytes
from gazette.llm.op5_substring_dedup import remove_repeated_words


def test_thousands_of_equal_rows(spark):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
    other = " ".join(f"v{rng.randrange(10**6)}" for _ in range(300))
    rows = [(1, text)] * 5000 + [(None, text)] * 20 + [(2, other), (3, other[:900] + " tail " + text[700:1500])]
    got = remove_repeated_bytes(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed").distinct().collect()
    removed = {r.doc_id: (r.n_bytes, r.n_removed) for r in got}
    assert len(got) == 4
    assert removed[1] == removed[None] == (len(text), len(text))
    assert removed[2][1] == 900 or removed[2][1] == 901
    assert remove_repeated_bytes(frame(spark, rows)).count() == len(rows)


def test_contract_sizes_and_very_long_texts(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10**7)}é"
    passage = [word() for _ in range(90)]
    long = [word() for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[30_000:30_400], *passage])), (3, "\t".join([*passage, word()])), (4, " ".join(passage[5:60])), (5, " ".join([word(), *passage, *passage])), (6, None)]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeated_words(frame(spark, rows)).collect())
    assert got == sorted(brute_words(rows, 20))
    raw = {d: (t or "").encode() for d, t in rows}
    hits = {r.doc_id: [(s.begin, s.end) for s in r.spans] for r in remove_repeated_bytes(frame(spark, rows)).collect()}
    at = raw[1].find(" ".join(long[30_000:30_400]).encode())
    for doc, spans in hits.items():
        if doc == 1:  # the long text, by the passage that is known to repeat
            end, n = at, raw[2].find(" ".join(long[30_000:30_400]).encode())
            while raw[1][end] == raw[2][n]:
                end, n = end + 1, n + 1
            assert spans == [(at, end)]
            continue
        want = set()
        for s in range(len(raw[doc]) - 399):
            own = raw[doc][s : s + 400]
            if raw[doc].find(own, raw[doc].find(own) + 1) >= 0 or any(own in other for k, other in raw.items() if k != doc):
                want.update(range(s, s + 400))
        assert {x for a, e in spans for x in range(a, e)} == want
