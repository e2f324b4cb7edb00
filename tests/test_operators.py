from collections import defaultdict
from datetime import date
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from gazette.operators import extract, forecast, match, merge, resolve, tracker
from gazette.operators.classify import with_verdict
from gazette.plans.params import ScreenParams, lexicons_from

P = ScreenParams()


def verdicts(spark, *texts):
    df = with_verdict(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), "text", P)
    return df.orderBy("i").collect()


def test_classification(spark):
    stem, supportive, arabic, carbo, furniture, empty, device, unclear = verdicts(
        spark, "Supply of Zanubrutinib 80mg", "ondansetron", "علاج (الأورام)", "Carboplatin injection for cancer", "office furniture", None, "surgical gloves", "tablet"
    )
    assert stem.is_oncology and stem.score == 0.5 and stem.priority == "High"
    assert not supportive.is_oncology and supportive.score == 0.15
    assert arabic.is_pharma and arabic.needs_review and not arabic.is_oncology
    assert carbo.is_oncology and carbo.therapeutic_area == "Oncology" and carbo.priority_score == 85 and carbo.score == 1 and carbo.confidence == 0.97
    assert not furniture.is_pharma and not furniture.needs_review and furniture.confidence == 0.8
    assert empty.needs_review and empty.confidence == 0 and device.confidence == 0.6 and not device.needs_review
    assert unclear.needs_review and unclear.therapeutic_area == "Other Pharmaceutical"
    assert carbo.notes[0].startswith("pharma: ") and len(set(carbo.notes)) == len(carbo.notes)


def test_lexicon_table(spark):
    rows = [("pharma", None, None, "pill"), ("area", 2, "B", "bb"), ("area", 1, "A", "aa"), ("area", 1, "A", "ab")]
    lexicons, areas = lexicons_from(spark.createDataFrame(rows, "lexicon string, area_rank int, area string, term string"))
    assert lexicons == {"pharma": ("pill",)} and areas == (("A", ("aa", "ab")), ("B", ("bb",)))


def loop_match(terms, exact, near, stop):
    """What one description finds, term by term."""
    hits = {}
    for term, via in terms:
        before = len(hits)
        for row in sorted(exact.get(term, ())):
            hits.setdefault(row, 2 if via else 0)
        if len(hits) == before and not via:
            for row in sorted(near.get(term, ())):
                hits.setdefault(row, 1)
        if stop and len(hits) >= stop:
            break
    return list(hits.items())


@pytest.mark.parametrize("stop", [None, 3])
def test_hits_follow_the_terms(spark, stop):
    texts = spark.createDataFrame([("Karboplatin lenalidomide",), ("imatinib carboplatin tablets",), ("Revlimid",), ("nothing known",)], "text string")
    registry = spark.createDataFrame([(i, n, f"maker {i % 3}") for i, n in enumerate(["Carboplatin inj", "Cisplatin x", "Lenalidomide caps", "Imatinib", "Carboplatinum", "Revlimid forte", "lenalidomide generic", "imatinib mesylate extra"])], "row long, product_name string, manufacturer string")
    aliases = match.bridge(spark.createDataFrame([("Revlimid", "lenalidomide"), ("Glivec", "imatinib")], "brand string, inn string"))
    terms, index = match.terms_of(texts, aliases), match.registry_index(registry)
    listed, exact, near = defaultdict(list), defaultdict(set), defaultdict(set)
    for r in terms.orderBy("at").collect():
        listed[r.text].append((r.term, r.via_alias))
    from gazette.functions.molecules import skeleton_of

    skeletons = {r.term: r.s for r in terms.select("term", skeleton_of(F.col("term")).alias("s")).distinct().collect()}
    for r in index.collect():
        exact[r.term].add(r.row)
        for term, s in skeletons.items():
            if r.skeleton and len(s) >= 5 and r.skeleton == s and min(len(term), len(r.word)) >= 0.8 * max(len(term), len(r.word)):
                near[term].add(r.row)
    got = {r.text: [(h.row, h.tier) for h in r.hits] for r in match.hits(terms, index, stop).collect()}
    want = {t: loop_match(x, exact, near, stop) for t, x in listed.items()}
    assert got == {t: h for t, h in want.items() if h}
    assert any(tier == 2 for h in got.values() for _, tier in h) and any(tier == 1 for h in got.values() for _, tier in h)


def test_enrichment(spark):
    items = spark.createDataFrame([("a", "Carboplatin 150 mg vial", False), ("b", "Karboplatyn", False), ("c", "zzz", False)], "item_id string, product_name string, needs_review boolean")
    registry = spark.createDataFrame([(1, "Carboplatin inj", "M1"), (2, "Carboplatin", None)], "row long, product_name string, manufacturer string")
    portfolio = spark.createDataFrame([(1, "carboplatin", "Ours", "Principal", "Registered")], "row long, api string, product_name string, company string, registration_status string")
    out = {r.item_id: r for r in match.enrich(items, registry, portfolio, None, columns=("product_name",)).collect()}
    assert out["a"].ref_match_method == "exact" and out["a"].registered_products == ["Carboplatin", "Carboplatin inj"] and out["a"].registered_companies == ["M1"] and not out["a"].needs_review
    assert out["a"].portfolio_product == ["Ours"] and out["a"].portfolio_status == ["Registered"]
    assert out["b"].ref_match_method == "skeleton" and out["b"].needs_review and out["c"].ref_match_method == "none" and out["c"].review_reason


def brute_resolve(new, old, p):
    fold = lambda x: " ".join("".join(c if c.isalnum() or c in "%./+-_" else " " for c in (x or "").lower()).split())
    num = lambda x: "".join(c for c in fold(x) if c.isalnum())
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    out = {}
    for row, number, url, title, authority, deadline in new:
        hits = sorted(i for i, n, *_ in old if num(number) and num(n) == num(number))
        if hits:
            out[row] = ("match", hits[0])
            continue
        apart = lambda n: num(number) and num(n) and num(n) != num(number)  # noqa: B023, E731
        hits = sorted(i for i, n, u, *_ in old if url and u == url and not apart(n))
        if hits:
            out[row] = ("match", hits[0])
            continue
        best = (0.0, None)
        for i, n, _, t, a, d in sorted(old):
            if apart(n) or (authority and a and ratio(fold(authority), fold(a)) < p.authority):
                continue
            s = ratio(fold(title), fold(t)) + (p.deadline_bonus if deadline and deadline == d else 0)
            if s > best[0]:
                best = (s, i)
        out[row] = ("match", best[1]) if best[0] >= p.same else ("ambiguous", best[1]) if best[0] >= p.maybe else ("new", None)
    return out


def test_resolution_matches_a_loop(spark):
    titles = ["supply of carboplatin vials", "supply of carboplatin vial", "supply of cisplatin vials for the north", "annual cleaning of offices", "suply carboplatin vials", "x", None]
    old = [(i, f"T/{i}" if i % 3 else None, f"http://p/{i}", titles[i % 6], ["Ministry of Health", "Ministry of Helth", "Port"][i % 3], date(2026, 1, 1 + i % 4)) for i in range(1, 25)]
    new = [(i, [None, f"t-{i % 30}", None][i % 3], f"http://p/{i}" if i % 4 == 0 else f"http://q/{i}", titles[i % 7], ["Ministry of Health", None, "Harbour"][i % 3 if i % 5 else 1], date(2026, 1, 1 + i % 5) if i % 6 else None) for i in range(1, 60)]
    schema = "{} long, tender_number string, tender_page_url string, tender_title string, issuing_authority string, submission_deadline date"
    state = spark.createDataFrame(old, schema.format("id")).withColumn("source", F.lit("s"))
    listings = spark.createDataFrame(new, schema.format("row_id")).withColumn("source", F.lit("s"))
    got = {r.row_id: (r.action, r.tender_id) for r in resolve.resolve(listings, state, P).collect()}
    assert got == brute_resolve(new, old, P)
    assert {a for a, _ in got.values()} == {"match", "ambiguous", "new"}


def test_merge_is_idempotent(spark):
    schema = "id long, tender_title string, estimated_value double, note string"
    old = spark.createDataFrame([(1, "a", 1.0, "n"), (2, "b", 2.0, "n"), (4, "d", None, "n")], schema)
    new = spark.createDataFrame([(1, "A", None, "changed"), (2, "Not Available", 3.0, None), (3, "c", 5.0, "new"), (4, "", 0.0, None)], schema)
    want = [(1, "A", 1.0, "n"), (2, "b", 3.0, "n"), (3, "c", 5.0, "new"), (4, "d", 0.0, "n")]
    merged = merge.upsert(old, new)
    assert sorted(map(tuple, merged.collect())) == want
    assert sorted(map(tuple, merge.upsert(merged, new).collect())) == want
    feed = sorted(map(tuple, merge.change_feed(old, new).collect()))
    assert feed == [(1, "tender_title", "a", "A"), (2, "estimated_value", "2.0", "3.0"), (4, "estimated_value", None, "0.0")]
    assert merge.change_feed(merged, new).count() == 0


def test_forecasts(spark):
    rows = [("a", date(2020 + y, 3 if y % 2 else 6, 1), 10.0 * (y + 1), 5.0, "box", f"k{y}") for y in range(6)] + [("b", date(2020, 1, 1), None, None, None, "z"), ("b", date(2020, 5, 1), 0.0, 1.0, "u", "y")]
    df = spark.createDataFrame(rows, "subject string, day date, quantity double, value double, unit string, key string")
    out = {(r.subject, r.metric): r for r in forecast.product_forecasts(df).collect()}
    assert out["a", "expected_next"].value == "2025-11-29" and out["a", "typical_quantity"].value == "35 box" and out["a", "typical_quantity"].confidence == "high"
    assert out["a", "seasonal_pattern"].value == "3, 6" and out["a", "historical_value"].value == "5"
    assert all(out["b", m].value is None for m in ("expected_next", "frequency", "typical_quantity", "historical_value", "seasonal_pattern"))
    assert tuple(forecast.summary(forecast.product_forecasts(df)).first()) == (2, 5, 5)


def test_html_tables_and_labels(spark):
    html = """<table><tr><td>menu</td></tr></table><table><tr><th>Tender No.</th><th>Title <b>x</b></th><th>Closing Date</th><th>Value</th></tr>
      <tr><td>T/1</td><td>Vials &amp; more</td><td>3/2/2026</td><td>1,000 KD</td></tr><tr><td>only</td></tr></table>
      <table><tr><td>Issuing authority</td><td>Port</td></tr><tr><td>Title</td><td>second</td></tr></table>"""
    tables = extract.html_tables(spark.createDataFrame([(1, html), (2, None), (3, "<table><tr><td>open")], "page_id long, html string"))
    rows = extract.listings_of(tables).collect()
    assert [(r.page_id, r.tender_number, r.tender_title, r.submission_deadline, r.estimated_value, r.currency) for r in rows] == [(1, "T/1", "Vials & more", date(2026, 2, 3), 1000.0, "KWD")]
    labels = extract.label_values(tables, "page_id", extract.LISTING_HINTS)
    assert [(r.page_id, r.issuing_authority, r.tender_title) for r in labels.collect()] == [(1, "Port", "second")]
    base = spark.createDataFrame([(1, None, "kept", None)], "page_id long, issuing_authority string, tender_title string, estimated_value double")
    assert tuple(extract.filled(base, labels, "page_id").first()) == (1, "Port", "kept", None)


def test_items_from_documents(spark):
    table = [[["List"], ["No", "Item description", "Qty", "Price"], ["1", "Carboplatin 150 mg vial", "1,000 vials", "2.5"], ["2", "ab", "5", "1"]]]
    tables = spark.createDataFrame([(1, table), (2, [])], "tender_id long, tables array<array<array<string>>>")
    texts = spark.createDataFrame([(1, "1. Ignored here 5 mg"), (2, "Intro:\n 1) Insulin pen 100 iu   2,500 boxes each\nno dose\n2. Heparin   30 vials\nHeparin sodium 5000iu/ml amp\nab 5 mg")], "tender_id long, text string")
    key = lambda rows: sorted(rows, key=repr)
    out = [(r.tender_id, r.product_name, r.item_no, r.strength, r.line_value, r.needs_review) for r in extract.items_of(tables, texts).collect()]
    # A name and a dose make an item, and a name may run over lines. The header "No" is no hint of a number.
    want = [(2, *x, None, True) for x in dosed(texts.collect()[1].text)]
    assert len(want) == 2 and key(out) == key([(1, "Carboplatin 150 mg vial", None, "150 mg", 2500.0, None), *want])
    counted = sorted((r.product_name, r.quantity, r.unit) for r in extract.counted_lines(texts.filter("tender_id = 2")).collect())
    assert counted == [("Heparin", 30.0, "vials"), ("Insulin pen 100 iu", 2500.0, "boxes")]


def dosed(text):
    """Names and doses, read one after the other."""
    import re

    at, out = 0, []
    rx = re.compile(r"^\s*(?:(\d{1,3})[).\s-]+)?([A-Za-z][\w\s/(),.-]{4,80}?)\s+(\d+(?:[.,]\d+)?\s*(?:mcg|mg|g|ml|iu|%)\b[^\n]{0,30})", re.M)
    while m := rx.search(text, at):
        name = " ".join(f"{m[2]} {m[3]}".split())
        strength = re.search(r"\d+\s*(mg|iu)(/ml)?", name)
        out.append((name, m[1], strength and strength[0]))
        at = m.end()
    return out


def test_price_list(spark):
    lines = ["Product Name   Wholesale", "Carboplatin 150 mg     Maker One Ltd   10 vial   1.250  1.500", "Longname cisplatin Maker One Ltd 5 vial 2.000 2.500", "Plain thing 3 tab 1.000 1.000", "unreadable"]
    good, unread = extract.price_list(spark.createDataFrame(list(enumerate(lines)), "line_no int, line string"), "drug")
    rows = [(r.product_name, r.manufacturer, r.pack_qty, r.form, r.retail_price) for r in good.orderBy("line_no").collect()]
    assert rows == [("Carboplatin 150 mg", "Maker One Ltd", 10.0, "vial", 1.5), ("Longname cisplatin", "Maker One Ltd", 5.0, "vial", 2.5), ("Plain thing", None, 3.0, "tab", 1.0)]
    assert [r.line for r in unread.collect()] == ["unreadable"]


def test_sheets(spark):
    a = spark.createDataFrame([(" Abc ", "x", "Registered"), (None, "y", None)], "`Product Name.` string, `Active` string, `Registration Status` string")
    b = spark.createDataFrame([("q",)], "other string")
    rows = extract.sheets({"S1": a, "S2": b}).collect()
    assert [(r.product_name, r.api, r.registration_status, r.company, r.sheet) for r in rows] == [("Abc", "x", "Registered", None, "S1")]


def test_tracker_counts_add_up(spark):
    schema = "item_id string, tender_id long, product_name string, unit string, quantity double, therapeutic_area string, portfolio_product array<string>, portfolio_principal array<string>, registered_products array<string>, ref_match_method string, needs_review boolean"
    items = spark.createDataFrame([("a", 1, "p", "u", 1.0, None, ["x"], ["P"], [], "exact", False), ("b", 1, "q", "u", 1.0, None, [], [], ["r"], "brand", True), ("c", 2, "q", None, 1.0, "N", [], [], [], "none", True)], schema)
    tenders = spark.createDataFrame([(1, "T1", "t", "A", date(2026, 1, 5), None, "High", True, "ON", None), (2, None, "t", "A", None, None, "Low", False, "ZZ", None)], "id long, tender_number string, tender_title string, issuing_authority string, submission_deadline date, publication_date date, priority string, is_oncology boolean, search_code string, therapeutic_area string")
    both = tracker.joined(items, tenders, P)
    assert tuple(tracker.kpis(both, "2026-01-05").first()) == (3, 1, 1, 1, 2, 2, 2, 2, 1)
    c = tracker.coverage(both).first()
    assert c.n_rows == 3 and c.n_unmatched == 1 and c.n_fuzzy == 1
    assert tracker.scoped(items, tenders, P, "2026-01-06", window="open").count() == 0 and tracker.scoped(items, tenders, P, "2026-01-05", window="closed").count() == 2
