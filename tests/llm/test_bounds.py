import random

from test_op10_decontamination import brute

from gazette.llm import op8_token_files as op8
from gazette.llm import op10_decontamination as op10
from gazette.llm.common import scratch


def test_parts_keep_their_bound_with_long_items(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 12, 40])))) for i in range(60)] + [(99, " ".join(word() for _ in range(3000))), (None, "only here")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for part in op10._broadcasts(benchmark, 10, 150):
        found = op10.Patterns(part().value[1], 10)
        assert 0 < sum(len(g.patterns) for g in found.groups) <= 150
    long = items[60][1].split()
    rows = [(i, " ".join([word() for _ in range(20)] + rng.choice(items)[1].split() + long[i * 90 : i * 90 + 25])) for i in range(30)] + [(None, None), (7, ""), (8, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    once = sorted(map(repr, op10.find_benchmark(docs, benchmark, unnamed=True).collect()))
    assert sorted(map(repr, op10.find_benchmark(docs, benchmark, unnamed=True, patterns=150).collect())) == once
    assert op10.clean(docs, benchmark, patterns=150).count() == op10.clean(docs, benchmark).count()
    nothing = op10.find_benchmark(docs, benchmark.limit(0)).collect()
    assert len(nothing) == len(rows) and {r.doc_id: r.n_words for r in nothing}[8] == 1 and op10.find_benchmark(docs.limit(0), benchmark).count() == 0
    assert brute


def test_files_are_read_in_as_many_tasks_as_there_are_files(spark):
    docs = spark.createDataFrame([(i if i % 7 else None, f"text {i} " * (i % 90)) for i in range(400)], "doc_id long, text string").repartition(4)
    folder = scratch(spark, "tokens")
    manifest = op8.write_token_files(docs, folder, length=16, rows=4, most=2000)
    got = op8.read_token_files(manifest, folder)
    assert got.rdd.getNumPartitions() == manifest.count() > 5
    rows = sorted(got.collect(), key=lambda r: r.start)
    assert len(rows) == 400 and [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(400)]
    assert [r.doc_id for r in rows[:58]] == [None] * 58
    assert op8.read_token_files(op8.write_token_files(docs.limit(0), scratch(spark, "tokens")), folder).count() == 0
