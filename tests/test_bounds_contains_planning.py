"""Bounds before title similarity, the substring join, reading of chosen documents, the planning view and forecasts' evidence."""

import datetime as dt
import hashlib
import json
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from gazette.operators import forecast, planning
from gazette.operators.contains import contains_join
from gazette.operators.headers import guess_fields
from gazette.operators.resolve import bounded_pairs, similar_pairs
from gazette.sources import io


def _titles(n=60):
    dice = random.Random(4)
    words = ["supply", "of", "medicines", "توريد", "أدوية", "vials", "😀", "for", "2024", "aaa", "ab"]
    made = {" ".join(dice.choice(words) for _ in range(dice.randint(1, 6))) for _ in range(n)}
    return sorted(made | {t[:-1] + "x" for t in list(made)[:20]} | {"a", "😀", "aa", "aaa"})


def test_bounds_lose_no_pair(spark):
    titles = _titles()
    df = spark.createDataFrame([("s", t) for t in [*titles, titles[0], "", None]], "source string, title string")
    for least in (0.66, 0.86):
        got = {(r.a, r.b): r.similar for r in similar_pairs(df, df, least).collect()}
        want = {(a, b): s for a in titles for b in titles if (s := SequenceMatcher(None, a, b).ratio()) >= least}
        assert got == want
        left = bounded_pairs(df, df, least).count()
        assert len(want) <= left < len(titles) ** 2
    assert similar_pairs(df.limit(0), df, 0.66).count() == 0


def test_headers_against_a_loop(spark):
    # Folding leaves these as they are.
    names = [n for n in _titles(80) if n.isascii()]
    headers = spark.createDataFrame([(n[1:] + "z",) for n in names] + [("",), (None,)], "header string")
    aliases = spark.createDataFrame([(n, n) for n in names], "alias string, field string")
    got = {r.header: r.field for r in guess_fields(headers, aliases, normalise=False).collect()}
    for h in {n[1:] + "z" for n in names}:
        best = max(SequenceMatcher(None, h.strip(), n).ratio() for n in names)
        assert (got[h] is not None) == (best >= 0.86), (h, best)


def test_contains_join_against_a_loop(spark):
    dice = random.Random(5)
    texts = ["".join(dice.choice("ab ç😀") for _ in range(dice.randint(0, 30))) for _ in range(80)] + ["Principal 10", "principal 1", "x" * 50_000 + "ab", None, ""]
    needles = ["".join(dice.choice("ab ç😀") for _ in range(dice.randint(0, 7))) for _ in range(60)] + ["Principal 1", "zzzzz", "z", "", None, "a", "a"]
    t = spark.createDataFrame([(x, 1, "k") for x in texts], "text string, gram int, key string")
    n = spark.createDataFrame([(x, 2) for x in needles], "needle string, text int")
    got = [(r.text, r.needle) for r in contains_join(t, n, "text", "needle").collect()]
    want = {(a, b) for a in texts for b in needles if a and b and b in a}
    assert len(got) == len(set(got)) and set(got) == want
    assert contains_join(t, n.limit(0), "text", "needle").count() == 0 and contains_join(t.limit(0), n, "text", "needle").count() == 0


def test_only_chosen_documents_are_opened(spark, tmp_path):
    folder = tmp_path / "docs"
    for key, n in (("7", 1000), ("8 b", 3)):
        (folder / key).mkdir(parents=True)
        for i in range(n):
            (folder / key / f"f {i:04}.txt").write_bytes(b"text \xff " + str(i).encode())
    (folder / "8 b" / "g.bin").write_bytes(b"\x00\x01")
    (folder / "8 b" / "h.txt").write_bytes(b"y" * 200)
    (folder / "8 b" / "plain").write_bytes(b"z")
    (folder / "8 b" / "nothing.txt").write_bytes(b"")
    df = io.documents(spark, f"file://{folder}", cap=100)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan, "bytes must not come through the listing"
    # What is gone between listing and opening shows which files are opened at all: of the others nobody notices.
    for i in range(12, 1000):
        (folder / "7" / f"f {i:04}.txt").unlink()
    (folder / "7" / "f 0003.txt").unlink()
    got = {(r.tender_id, r.filename): r for r in df.collect()}
    assert len([k for k in got if k[0] == "7"]) == 12 and len([k for k in got if k[0] == "8 b"]) == 6
    one = got["7", "f 0002.txt"]
    assert one.text == "text � 2" and one.sha256 == hashlib.sha256(b"text \xff 2").hexdigest() and one.error is None
    assert got["7", "f 0003.txt"].error == "missing" and got["8 b", "g.bin"].error == "unsupported kind: bin" and got["8 b", "g.bin"].sha256
    assert got["8 b", "h.txt"].error == "larger than the cap" and got["8 b", "h.txt"].sha256 is None and got["8 b", "plain"].error == "unsupported kind: "


def test_full_refresh_counts(spark, tmp_path):
    assert io.replace_table(spark.range(5), str(tmp_path / "t")) == 5 and io.replace_table(spark.range(2), str(tmp_path / "t")) == 2


def _tracker(spark):
    day = dt.date(2024, 5, 1)
    rows = [
        (1, "T1", day, "i1", "Alpha 5 mg", "Tab", 10.0, "A", ["P1"], ["Prin X"], []),
        (1, "T1", day, "i2", "Alpha 5 mg", "Box", 20.0, "A", ["P1", "P2"], ["Prin X"], []),
        (2, "T2", None, "i3", "Beta", None, None, None, [], [], ["prin x generic"]),
        (2, "T2", dt.date(2024, 1, 1), "i0", "Beta", "Box", 1.0, "B", [], [], ["prin x generic"]),
        (3, None, day, "i4", "Gamma", "Box", 1.0, "B", ["P3"], ["Other"], []),
    ]
    return spark.createDataFrame(rows, "id long, tender_number string, submission_deadline date, item_id string, product_name string, unit string, quantity double, area string, portfolio_product array<string>, portfolio_principal array<string>, registered_products array<string>")


def test_planning_view(spark):
    found = planning.hits(_tracker(spark), "PRIN X")
    assert sorted(r.item_id for r in found.collect()) == ["i0", "i1", "i2", "i3"]
    head = planning.headline(found, "2024-02-01").first()
    assert (head.n_tenders, head.n_open, head.n_items, head.n_skus) == (2, 1, 4, 3)
    behind = {(r.tender_number, r.product_name): (r.item_id, r.state, r.products) for r in planning.tenders_behind(found, "2024-02-01").collect()}
    assert behind == {("T1", "Alpha 5 mg"): ("i1", "open", "P1"), ("T2", "Beta"): ("i3", "closed", "")}
    none = planning.headline(planning.hits(_tracker(spark), "nobody"), "2024-02-01").collect()
    assert [(r.n_tenders, r.n_open, r.n_items, r.n_skus) for r in none] == [(0, 0, 0, 0)]


def _rows(spark):
    rows = [("alpha", dt.date(2024, m, 1), 5.0, 1.0, "Box", f"k{m}", f"T{m}", "MOH") for m in (1, 2, 3)] + [("beta", dt.date(2024, 1, 1), 0.0, None, None, "k", "T1", None), ("beta", None, 3.0, None, None, "l", "T1", "MOH")]
    return spark.createDataFrame(rows, "subject string, day date, quantity double, value double, unit string, key string, tender_number string, authority string")


def test_what_is_withheld(spark):
    got = {(r.subject, r.metric): (r.observed, r.needed, r.message) for r in forecast.withheld(_rows(spark)).collect()}
    assert got == {
        ("alpha", "seasonal_pattern"): (3, 6, "seasonal_pattern: 3 days, 6 needed in two years"), ("beta", "cycle"): (1, 3, "cycle: 1 days, 3 needed"),
        ("beta", "typical_quantity"): (1, 3, "typical_quantity: 1 quantities, 3 needed"), ("beta", "seasonal_pattern"): (1, 6, "seasonal_pattern: 1 days, 6 needed in two years"),
    }


def test_evidence_and_saved_forecasts(spark, tmp_path):
    rows = _rows(spark)
    proof = forecast.evidence(rows)
    assert {(r.kind, r.value) for r in proof.filter("subject = 'beta'").collect()} == {("tender", "T1"), ("authority", "MOH"), ("day", "2024-01-01")}
    kept = forecast.saved(forecast.product_forecasts(rows), proof, "r1")
    for _ in range(2):
        io.append_run(kept, str(tmp_path / "log"))
    back = {(r.subject, r.metric): r for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert set(back) == {("alpha", m) for m in ("expected_next", "frequency", "typical_quantity", "historical_value")}
    assert json.loads(back["alpha", "frequency"].evidence) == {"tenders": 3, "authorities": 1, "days": 3, "first": "2024-01-01", "last": "2024-03-01"}


def test_matching_forecasts(spark):
    rows = _rows(spark)
    got = planning.matching_forecasts(rows, rows.select(F.lit("Alpha Hospital").alias("subject"), "day"), "ALPHA").collect()
    assert {(r.kind, r.subject) for r in got} == {("product", "alpha"), ("authority", "Alpha Hospital")} and len(got) == 7
