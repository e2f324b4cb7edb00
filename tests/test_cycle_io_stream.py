import json
import tempfile
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.plans.cycle import LISTING, STATE, screen
from gazette.plans.params import ScreenParams
from gazette.sources import io
from gazette.streaming import incremental

P = ScreenParams()
REGISTRY = [(1, "Carboplatin inj", "M"), (2, "Amoxicillin caps", "M")]
PORTFOLIO = [(1, "carboplatin", "Ours", "Principal", "Registered")]


def notice(row, number, title, deadline, items=()):
    return (row, "portal", number, title, "Health", "Pharmacy", date(2026, 1, 1), deadline, f"https://p/{number}", "https://p/list", None, 250_000.0, "ON", [(i + 1, n, "vial", 5.0) for i, n in enumerate(items)])


A = [
    notice(1, "T/1", "Supply of carboplatin vials", date(2026, 2, 10), ["Carboplatin 150 mg", "Carboplatin 150 mg"]), notice(2, "T/2", "Supply of Zanubrutinib", date(2026, 2, 11)),
    notice(3, "T/3", "Construction of a warehouse", date(2026, 2, 12)), notice(4, "T/4", "Amoxicillin capsules", date(2026, 2, 13), ["Amoxicillin 500 mg"]), notice(5, "T/5", "توريد أدوية الأورام", date(2026, 2, 14)),
]
C = [notice(1, "t-1", "Supply of carboplatin vials", date(2026, 2, 24), ["Carboplatin 450 mg"]), *A[1:], notice(6, "T/6", "Imatinib tablets", date(2026, 3, 1)), notice(7, "T/6", "Imatinib tablets", date(2026, 3, 1))]


def test_three_cycles(spark):
    registry = spark.createDataFrame(REGISTRY, "row long, product_name string, manufacturer string")
    portfolio = spark.createDataFrame(PORTFOLIO, "row long, api string, product_name string, company string, registration_status string")
    state, items, seen = spark.createDataFrame([], STATE), None, []
    folder = tempfile.mkdtemp(prefix="spark-")
    for n, rows in enumerate((A, A, C)):
        out = screen(spark.createDataFrame(rows, LISTING), state, items, registry, portfolio, None, P, f"run-{n}", f"2026-01-0{n + 1} 12:00:00")
        m = out.metrics.first()
        seen.append((m.listings, m.new, m.updated, m.duplicates, [(r.field, r.old_value, r.new_value) for r in out.changes.orderBy("field").collect()]))
        out.tenders.write.parquet(f"{folder}/t{n}")
        out.items.write.parquet(f"{folder}/i{n}")
        state, items = spark.read.parquet(f"{folder}/t{n}"), spark.read.parquet(f"{folder}/i{n}")
        assert [r.tender_title for r in out.rejected.collect()] == ["Construction of a warehouse"]
    assert seen[0][:4] == (5, 4, 0, 0) and seen[1] == (5, 0, 0, 4, [])
    listings, new, updated, duplicates, changes = seen[2]
    assert (listings, new, updated, duplicates) == (7, 1, 1, 4)
    assert ("submission_deadline", "2026-02-10", "2026-02-24") in changes and {f for f, *_ in changes} == {"submission_deadline", "tender_page_url"}
    assert state.count() == 5 and state.filter("tender_number = 'T/1'").first().submission_deadline == date(2026, 2, 24)
    names = sorted(r.product_name for r in items.collect())
    assert names == ["Amoxicillin 500 mg", "Carboplatin 450 mg", "Imatinib tablets", "Supply of Zanubrutinib", "توريد أدوية الأورام"]
    assert items.filter("product_name like 'Carboplatin%'").first().portfolio_principal == ["Principal"]


def test_snapshots_and_publishing(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    t = spark.createDataFrame([(1, "a", True)], "id long, name string, extra boolean")
    assert {r.table: r.n_rows for r in io.export_snapshot({"tenders": t}, folder).collect()} == {"tenders": 1}
    known = {"tenders": T.StructType.fromDDL("id long, name string, added string"), "documents": T.StructType.fromDDL("id long")}
    back = io.import_snapshot(spark, folder, known)
    assert [tuple(r) for r in back["tenders"].collect()] == [(1, "a", None)] and back["documents"].count() == 0
    spark.createDataFrame([("tenders", 1, 9)], "table string, n_rows long, format int").write.mode("overwrite").parquet(f"{folder}/_manifest.parquet")
    with pytest.raises(ValueError):
        io.import_snapshot(spark, folder, known)
    assert io.publish(t, f"{folder}/p") and not io.publish(t.limit(0), f"{folder}/p") and spark.read.parquet(f"{folder}/p").count() == 1
    io.append(spark.createDataFrame([("x" * 900,)], "target string"), f"{folder}/e", {"target": 500})
    assert spark.read.parquet(f"{folder}/e").select(F.length("target")).first()[0] == 500
    assert [tuple(r) for r in io.projection(t, {"Id": "id", "Flag": "extra", "None": ""}, required=("Id",)).collect()] == [("1", "Yes")]


def test_documents(spark):
    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    (folder / "7").mkdir()
    for i in range(14):
        (folder / "7" / f"f{i:02d}.txt").write_bytes(b"text \xff" + bytes([65 + i]))
    (folder / "8").mkdir()
    (folder / "8" / "a.exe").write_bytes(b"MZ")
    rows = io.documents(spark, str(folder)).collect()
    assert sum(r.tender_id == "7" for r in rows) == 12 and all(r.text.startswith("text ") for r in rows if r.tender_id == "7")
    assert [r.error for r in rows if r.tender_id == "8"] == ["unsupported kind: exe"]


def test_streams(spark):
    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    (folder / "in").mkdir()
    schema = "source string, tender_number string, tender_title string, issuing_authority string, tender_page_url string, seen timestamp"
    for i in range(3):
        rows = [{"source": "s", "tender_number": f"T/{k}", "tender_title": "t", "issuing_authority": "a", "tender_page_url": "u", "seen": "2026-01-01T00:00:00Z"} for k in range(i + 1)]
        (folder / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
    runs = []
    for _ in range(2):  # nothing is left for the second time
        query = incremental.screen_stream(incremental.listing_stream(spark, str(folder / "in"), schema, files=1), lambda batch, run: runs.append((run, batch.count())), str(folder / "c1"))
        query.awaitTermination(120)
    assert [r for r, _ in runs] == ["run-0", "run-1", "run-2"] and sum(n for _, n in runs) == 6
    stream = incremental.distinct_stream(incremental.listing_stream(spark, str(folder / "in"), schema), "seen")
    query = stream.writeStream.format("memory").queryName("distinct_rows").option("checkpointLocation", str(folder / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("distinct_rows").count() == 3
