import random
import tempfile
from datetime import date
from difflib import SequenceMatcher
from pathlib import Path

from test_cycle_io_stream import PORTFOLIO, REGISTRY, P, notice

from gazette.operators import headers, match, merge
from gazette.plans.cycle import LISTING, STATE, screen
from gazette.sources import adapters, io


def test_two_listings_of_one_tender_give_one_row(spark):
    registry = spark.createDataFrame(REGISTRY, "row long, product_name string, manufacturer string")
    portfolio = spark.createDataFrame(PORTFOLIO, "row long, api string, product_name string, company string, registration_status string")
    run = lambda rows, state, n: screen(spark.createDataFrame(rows, LISTING), state, None, registry, portfolio, None, P, f"run-{n}", f"2026-01-0{n} 12:00:00")
    first = run([notice(1, "T/1", "Supply of carboplatin vials", date(2026, 2, 10))], spark.createDataFrame([], STATE), 1)
    folder = tempfile.mkdtemp(prefix="spark-")
    first.tenders.write.parquet(f"{folder}/t")
    by_number = notice(1, "T/1", "Supply of carboplatin vials, again", date(2026, 3, 1))
    by_url = list(notice(2, None, "Supply of carboplatin infusion", date(2026, 3, 2)))
    by_url[8] = "https://p/T/1"
    out = run([by_number, tuple(by_url)], spark.read.parquet(f"{folder}/t"), 2)
    tenders = out.tenders.collect()
    assert len(tenders) == 1 and tenders[0].submission_deadline == date(2026, 3, 1)
    assert "content_hash" not in {r.field for r in out.changes.collect()}
    m = out.metrics.first()
    assert (m.listings, m.updated, m.duplicates) == (2, 1, 1)
    item = out.items.first()
    assert item.is_oncology and item.therapeutic_area == "Oncology"


def test_page_urls_update(spark):
    old = spark.createDataFrame([(1, "https://a", "h1"), (2, "https://b", "h2")], "id long, tender_page_url string, content_hash string")
    new = spark.createDataFrame([(1, "https://c", "h3"), (2, "", "h2")], "id long, tender_page_url string, content_hash string")
    assert [tuple(r) for r in merge.change_feed(old, new).collect()] == [(1, "tender_page_url", "https://a", "https://c")]
    assert sorted(map(tuple, merge.upsert(old, new).collect())) == [(1, "https://c", "h3"), (2, "https://b", "h2")]


def test_headers_match_a_loop(spark):
    rng = random.Random(3)
    words = ["tender number", "closing date", "issuing authority", "estimated value", "bid bond", "unit price"]
    asked = []
    for w in words * 12:
        x = list(w)
        for _ in range(rng.randrange(3)):
            x[rng.randrange(len(x))] = rng.choice("abcxyz ")
        asked.append("".join(x).upper() if rng.random() < 0.3 else "".join(x))
    asked += ["", "nothing alike", "tender number"]
    got = headers.guess_fields(spark.createDataFrame([(a,) for a in asked], "header string"), spark.createDataFrame([(w, w.replace(" ", "_")) for w in words], "alias string, field string"), normalise=False)
    for r in got.collect():
        folded = " ".join(r.header.lower().split())
        best = max(((SequenceMatcher(None, folded, w).ratio(), w) for w in words), key=lambda x: x[0])
        want = best[1].replace(" ", "_") if folded and best[0] >= headers.LEAST else None
        assert r.field == want, r


def test_a_failing_source_does_not_stop_the_others(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([("T/1", "one", 5)], "tender_number string, tender_title string, extra int").write.parquet(f"{folder}/good")
    schema = spark.createDataFrame([], LISTING).schema
    listings, errors = adapters.read_all(spark, [adapters.FileAdapter("good", f"{folder}/good"), adapters.FileAdapter("down", f"{folder}/none")], schema)
    assert [(r.source, r.tender_number, r.tender_page_url) for r in listings.collect()] == [("good", "T/1", None)] and listings.schema.names == schema.names
    assert [r.source for r in errors.collect()] == ["down"]


def test_publish_keeps_the_old_table_until_the_new_one_is_written(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/table"
    assert io.publish(spark.range(3), path) and not io.publish(spark.range(0), path)
    assert io.publish(spark.read.parquet(path).selectExpr("id + 1 as id"), path)  # reads what it replaces
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    assert [p.name for p in Path(path).parent.iterdir()] == ["table"]


def test_documents_above_the_cap_are_not_read(spark):
    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    (folder / "7").mkdir()
    for name, data in (("a.txt", b"text"), ("b.txt", b"x" * 100), ("c.bin", b"\x00"), ("d.csv", b"\xff\xfe")):
        (folder / "7" / name).write_bytes(data)
    got = {r.filename: r for r in io.documents(spark, str(folder), cap=50).collect()}
    assert got["a.txt"].text == "text" and got["b.txt"].error == "larger than the cap" and got["b.txt"].sha256 is None
    assert got["c.bin"].error == "unsupported kind: bin" and got["d.csv"].text and io.documents(spark, str(folder), most=2).count() == 2
    assert io.documents(spark, str(folder), most=None, cap=None).filter("error is null").count() == 3


def test_texts_with_equal_terms_share_a_spokesman(spark):
    texts = spark.createDataFrame([(f"carboplatin {i} mg vial",) for i in range(20)] + [("imatinib 100 mg",)], "text string")
    registry = spark.createDataFrame(REGISTRY, "row long, product_name string, manufacturer string")
    portfolio = spark.createDataFrame(PORTFOLIO, "row long, api string, product_name string, company string, registration_status string")
    terms = match.terms_of(texts, None)
    assert match.spokesmen(terms).select("rep").distinct().count() == 2
    got = match.match(texts, registry, portfolio, None).collect()
    assert len(got) == 21 and sum(r.n_registry == 1 and r.registered_products == ["Carboplatin inj"] for r in got) == 20
