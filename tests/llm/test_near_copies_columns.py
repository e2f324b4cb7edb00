from gazette.llm import near_copies


def test_clashing_columns_and_repeated_rows(spark):
    text = " ".join(f"word{i}" for i in range(100))
    rows = [(1, text, 5, "x", None, 1), (1, text, 4, "x", None, 1), (2, text + " tail", 3, "y", "o", 2), (None, "other words here", 2, "z", "o", 3), (None, None, 1, "z", "o", 3)]
    names = ["doc_id", "text", "_own", "_d", "row", "order"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _own int, _d string, row string, order int")
    for _ in range(2):
        got = near_copies.survivors(docs.repartition(3))
        assert got.columns == names
        found = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r._d) for r in got.collect())
        assert found == [(False, 1, text, "x"), (True, 0, "", "z"), (True, 0, "other words here", "z")]


def test_a_group_without_links_costs_no_pairs(spark):
    """Every member differs from the common text in a fifth of its shingles and more."""
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in range(i % 10, 150, 21):
            words[at] = f"own{i}_{at}"
        rows.append((i, " ".join(words)))
    texts = spark.createDataFrame(rows, "node long, text string")
    sets = texts.mapInArrow(near_copies._sets(5), "node long, n long, shingles binary")
    assert near_copies._prefixes(sets).count() == 0
    assert near_copies.survivors(texts.withColumnRenamed("node", "doc_id")).count() == 120
