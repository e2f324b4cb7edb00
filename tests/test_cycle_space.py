"""What a cycle leaves on disk."""

from datetime import date
from pathlib import Path

from gazette.plans.cycle import LISTING, STATE, screen
from gazette.plans.params import ScreenParams
from gazette.sources import settled

P = ScreenParams()


def notice(row, number, title, deadline):
    return (row, "portal", number, title, "Health", "Pharmacy", date(2026, 1, 1), deadline, f"https://p/{row}", None, "medicine", 10.0, "ON", [(1, "Amoxicillin 500 mg", "vial", 5.0)])


ROWS = [notice(1, "T/1", "Supply of medicines", date(2026, 2, 1)), notice(2, "t 1", "Supply of medicines", date(2026, 2, 1)), notice(3, None, "Supply of vaccines", date(2026, 3, 1)), notice(4, "T/9", "Construction", date(2026, 3, 1))]


def test_only_what_outputs_read_stays_on_disk(spark):
    folder = Path(settled.settled(spark.range(1), "first").inputFiles()[0].removeprefix("file://")).parents[1]
    before = set(folder.iterdir())
    registry = spark.createDataFrame([(1, "Amoxicillin caps", "M")], "row long, product_name string, manufacturer string")
    portfolio = spark.createDataFrame([(1, "amoxicillin", "Ours", "Principal", "Registered")], "row long, api string, product_name string, company string, registration_status string")
    out = screen(spark.createDataFrame(ROWS, LISTING), spark.createDataFrame([], STATE), None, registry, portfolio, None, P, "run-1", "2026-01-01 12:00:00")
    assert sorted(p.name[:-33] for p in set(folder.iterdir()) - before) == ["clashes", "decided", "errors", "live", "rows", "total"]
    assert out.metrics.select("listings", "new", "duplicates").first()[:] == (4, 3, 1)
    assert {(r.row_id, r.action) for r in out.decisions.collect()} == {(1, "new"), (2, "duplicate"), (3, "ambiguous"), (4, "new")}
    noted = {r.tender_page_url: r.review_reason for r in out.tenders.collect()}
    assert set(noted) == {"https://p/1", "https://p/3", "https://p/4"} and "possible duplicate of tender" in noted["https://p/3"]
    assert out.run.first().listings_reviewed == 4 and out.items.count() == 3


def test_a_table_made_alone_keeps_its_own_files_only(spark):
    def make():
        inner = settled.settled_alone(lambda: settled.settled(spark.range(3), "deep").selectExpr("id + 1 as id"), "inner")
        return inner.selectExpr("id * 2 as id")

    made = []
    token = settled._MADE.set(made)
    try:
        out = settled.settled_alone(make, "outer")
    finally:
        settled._MADE.reset(token)
    assert sorted(r.id for r in out.collect()) == [2, 4, 6] and len(made) == 1
    parent = Path(out.inputFiles()[0].removeprefix("file://")).parent
    assert parent.exists()
    settled.released(out)
    assert not parent.exists()
