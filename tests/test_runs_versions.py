import json
import tempfile
import threading
from datetime import date
from pathlib import Path

import pytest
from test_cycle_io_stream import A, C, P, PORTFOLIO, REGISTRY

from gazette.operators.intake import RAW, read_listings
from gazette.plans.cycle import ERROR, LISTING, RUN, STATE, screen
from gazette.sources import io
from gazette.sources.versions import Versions
from gazette.streaming import incremental


def tables(spark):
    return spark.createDataFrame(REGISTRY, "row long, product_name string, manufacturer string"), spark.createDataFrame(PORTFOLIO, "row long, api string, product_name string, company string, registration_status string")


def raw(row, number, title, deadline, value="1,250.500 KD", items=(), page=None, cells=None):
    return (row, "portal", number, title, None, "Health", "Pharmacy", "01/02/2026", deadline, page, None, None, value, "ON", [(i + 1, n, q) for i, (n, q) in enumerate(items)], cells)


def test_bad_values_become_rows_of_the_run(spark):
    rows = [
        raw(1, "T/1", "Supply of carboplatin vials", "2026-02-10", items=[("Carboplatin 150 mg", "50,000 vials"), ("Cisplatin 10 mg", "many"), ("  ", "3 box"), (None, None)]),
        raw(2, "T/2", "Imatinib tablets", "soon", value="on request"), raw(3, None, " ", "2026-02-30"), raw(4, "T/4", "Supplies", "", value=None, cells={"Note": "for chemotherapy of cancer, Carboplatin"}), raw(5, "T/4", "Supplies again", None),
    ]
    listings, errors = read_listings(spark.createDataFrame(rows, RAW))
    typed = {r.row_id: r for r in listings.collect()}
    assert sorted(typed) == [1, 2, 4, 5] and typed[1].estimated_value == 1250.5 and typed[1].publication_date == date(2026, 2, 1) and typed[2].submission_deadline is None
    assert [(i.product_name, i.quantity, i.unit) for i in typed[1]["items"]] == [("Carboplatin 150 mg", 50000.0, "vials"), ("Cisplatin 10 mg", None, None)]
    want = {
        ("items", "T/1", "quantity: item 2, many"), ("items", "T/1", "product_name: item 3, 3 box"), ("items", "T/1", "product_name: item 4, "), ("parse", "T/2", "submission_deadline: soon"), ("parse", "T/2", "estimated_value: on request"),
        ("parse", "row 3", "submission_deadline: 2026-02-30"), ("listing", "row 3", "row: neither number, title nor URL"),
    }
    assert {tuple(r) for r in errors.collect()} == want
    out = screen(listings, spark.createDataFrame([], STATE), None, *tables(spark), None, P, "run-1", "2026-01-01 12:00:00", errors)
    path = tempfile.mkdtemp(prefix="spark-")
    for _ in range(2):  # a run that is logged again replaces its rows
        io.append_run(out.run, f"{path}/screening_runs")
        io.append_run(out.errors, f"{path}/run_errors")
    later = out.run.selectExpr("'run-2' as run_id", *(c for c in out.run.columns if c != "run_id"))
    io.append_run(later, f"{path}/screening_runs")
    runs = spark.read.parquet(f"{path}/screening_runs").orderBy("run_id").collect()
    assert [r.run_id for r in runs] == ["run-1", "run-2"]
    r = runs[0]
    assert (r.status, r.listings_reviewed, r.new_tenders, r.duplicates_skipped, r.errors) == ("completed", 4, 3, 1, 7)
    assert spark.read.parquet(f"{path}/run_errors").count() == 7
    assert out.run.schema.simpleString() == spark.createDataFrame([], RUN).schema.simpleString() and out.errors.schema.simpleString() == spark.createDataFrame([], ERROR).schema.simpleString()
    # A term that only the raw row has decides the verdict.
    assert {t.tender_number: t.is_oncology for t in out.tenders.collect()}["T/4"]


def test_listings_of_one_batch_meet(spark):
    row = lambda i, number, page, title: (i, "portal", number, title, "Health", "Pharmacy", date(2026, 1, 1), None, page, None, None, 5.0, "ON", [(1, f"Carboplatin {i} mg", "vial", 1.0)])
    rows = [row(1, "N/1", "http://u/1", "Supply of carboplatin vials"), row(2, "n-1", "http://u/2", "Carboplatin"), row(3, None, "http://u/2", "Imatinib tablets"), row(4, None, "http://u/2", "Tamoxifen tablets"), row(5, None, "http://u/5", "Supply of carboplatin vial")]
    out = screen(spark.createDataFrame(rows, LISTING), spark.createDataFrame([], STATE), None, *tables(spark), None, P, "run-1", "2026-01-01 12:00:00")
    assert sorted(r.tender_title for r in out.tenders.collect()) == ["Imatinib tablets", "Supply of carboplatin vials"]
    assert sorted(r.product_name for r in out.items.collect()) == ["Carboplatin 1 mg", "Carboplatin 3 mg"]
    m = out.metrics.first()
    assert (m.listings, m.new, m.duplicates) == (5, 2, 3)


def test_three_micro_batches_with_a_replay_equal_three_cycles(spark):
    registry, portfolio = tables(spark)

    def apply(batch, before, run):
        state = before["tenders"] if before["tenders"] is not None else spark.createDataFrame([], STATE)
        out = screen(batch, state, before["items"], registry, portfolio, None, P, run, "2026-01-01 12:00:00")
        logs = {k: (v if before[k] is None else before[k].unionByName(v)) for k, v in (("changes", out.changes), ("runs", out.run))}
        return {"tenders": out.tenders, "items": out.items, **logs}

    names = ("tenders", "items", "changes", "runs")
    batches = [spark.createDataFrame(b, LISTING) for b in (A, A, C)]
    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    one, two = Versions(spark, str(folder / "one")), Versions(spark, str(folder / "two"))
    for n, b in enumerate(batches):
        one.commit(apply(b, {t: one.read(t) for t in names}, f"run-{n}"), n)
    (folder / "in").mkdir()
    for n, b in enumerate((A, A, C)):
        lines = b and [json.dumps(r, default=str) for r in (x.asDict(recursive=True) for x in batches[n].collect())]
        (folder / "in" / f"{n}.json").write_text("\n".join(lines))
        stream = incremental.listing_stream(spark, str(folder / "in"), LISTING, files=1)
        incremental.screen_into(stream, two, apply, names, str(folder / "checkpoint")).awaitTermination(300)
        if n == 1:
            before = two.pointer()
            assert not incremental.screen_versions(batches[1], 1, two, apply, names) and two.pointer() == before
    assert two.epoch() == 2
    for t in names:
        show = lambda v: sorted(repr(r) for r in v.read(t).collect())  # noqa: B023, E731
        assert show(one) == show(two), t


def test_readers_always_find_a_version(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    v = Versions(spark, folder)
    assert v.pointer() is None and v.read("t") is None
    assert v.commit({"t": spark.range(3)}) and not v.commit({"t": spark.range(0)}, least={"t": 1})
    failed, stop = [], threading.Event()

    def reader():
        while not stop.is_set():
            try:
                assert v.read("t").count() >= 3
            except Exception as e:
                failed.append(e)
                return

    thread = threading.Thread(target=reader)
    thread.start()
    for n in range(4, 9):
        assert v.commit({"t": spark.range(n)})
    stop.set()
    thread.join(60)
    assert not failed and v.read("t").count() == 8
    point, now = v._point, v.pointer()
    v._point = lambda to: (_ for _ in ()).throw(OSError("the rename fails"))
    with pytest.raises(OSError):
        v.commit({"t": spark.range(100)})
    v._point = point
    assert v.pointer() == now and v.read("t").count() == 8
    assert len(v.retire(1)) >= 5 and v.read("t").count() == 8
