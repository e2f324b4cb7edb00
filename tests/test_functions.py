from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gazette.functions import keys, molecules, parse, present, text
from gazette.operators.lexicon import fold_literal, hits, mode_of, stem_hits


def values(spark, column, *rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r.v for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_fold(spark):
    got = values(spark, text.fold, None, "", "  MOH/2026  (x) ", "أدوية الأورامِ", "٤٥ ملغ", "ﬁne‏ A_b", "Ünïcode—ß")
    assert got == ["", "", "moh/2026 x", "ادويه الاورام", "45 ملغ", "fine a_b", "ünïcode ß"]
    assert values(spark, lambda c: text.tokens_of(text.fold(c)), "a-b  c+d 5%") == [["a", "b", "c", "d", "5"]]
    assert values(spark, text.clean, None, " A​ b\n c ") == ["", "A b c"]
    assert values(spark, text.strip_cid, "a(cid:12)b   c") == ["a b c"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=20))
def test_fold_is_idempotent(spark, rows):
    rows = [r.encode("utf-8", "ignore").decode() for r in rows]
    once = values(spark, text.fold, *rows)
    assert values(spark, text.fold, *once) == once
    assert [fold_literal(r) for r in once] == once


def test_dates_and_times(spark):
    rows = ("2026-02-03", "3/2/2026", "03-02-2026 10:30 AM", "due 3.2.2026", "13/25/2026", "02/13/2026", "1 Feb 2026", "1 February 2026", "Feb 1, 2026", "٣/٢/٢٠٢٦", "31/02/2026", "", None, "nothing")
    day = date(2026, 2, 3)
    assert values(spark, parse.parse_date, *rows) == [day, day, day, day, None, date(2026, 2, 13), date(2026, 2, 1), date(2026, 2, 1), date(2026, 2, 1), day, None, None, None, None]
    assert values(spark, lambda c: parse.parse_date(c, day_first=False), "02/03/2026") == [date(2026, 2, 3)]
    assert values(spark, parse.parse_time, "1:05 PM", "12:00 am", "at 23:59", "noon", None) == ["13:05", "00:00", "23:59", None, None]
    assert values(spark, lambda c: parse.days_until(c, F.to_date(F.lit("2026-02-01"))), "2026-02-03", "bad") == [2, None]


def test_amounts(spark):
    got = values(spark, parse.parse_amount, "1,250.500 KD", "USD 5", "€ 7", "-3", "٥٫٥ دينار", "none", None)
    assert [tuple(r) for r in got] == [(1250.5, "KWD"), (5.0, "USD"), (7.0, "EUR"), (-3.0, None), (5.5, "KWD"), (None, None), (None, None)]
    got = values(spark, parse.parse_quantity, "50,000 vials", "12", "1.2.3 kg", "x 5", None)
    assert [tuple(r) for r in got] == [(50000.0, "vials"), (12.0, None), (None, "1.2.3 kg"), (None, None), (None, None)]


def test_product_details(spark):
    assert values(spark, parse.extract_strength, "Drug 100 mg/5 ml syrup", "5%", "no") == ["100 mg/5 ml", None, None]
    assert values(spark, parse.extract_dosage_form, "Film-coated tablet", "solution for infusion", "x") == ["film-coated tablet", "solution for infusion", None]
    assert values(spark, parse.extract_pack_size, "10x5 ml", "box of 30", "28 tabs/pack", "x") == ["10x5 ml", "box of 30", "28 tabs/pack", None]


def test_keys(spark):
    assert values(spark, keys.normalise_number, "KW-77/2025.b", "kw 77 2025 B", None) == ["kw772025b", "kw772025b", ""]
    assert values(spark, keys.normalise_url, " HTTP://X/a/?token=1&b=2 ", "http://x/a?", None) == ["http://x/a/&b=2", "http://x/a", ""]


def test_molecules(spark):
    assert len(set(values(spark, molecules.skeleton, "Karboplatin", "Carboplatin"))) == 1
    assert values(spark, molecules.skeleton, "Carboplatin", "Anaztrozole", "Anastrozole", "Keytruda", "Ketotard") == ["crbpltn", "nctrcl", "nctrcl", "ctrd", "ctrd"]
    assert values(spark, molecules.molecule_variants, "Revlimid (lenalidomide) Capsules", None) == [["revlimid lenalidomide", "lenalidomide", "revlimid"], []]
    assert values(spark, lambda c: molecules.candidates_of(molecules.normalise_molecule(c)), "CLOBETASOL PROPIONATE SHAMPOO", "a b") == [["clobetasol propionate", "clobetasol", "propionate"], []]
    df = spark.createDataFrame([("piperacillin", "parcalin"), ("carboplatin", "karboplatin")], "a string, b string")
    assert [r[0] for r in df.select(molecules.comparable_length(F.col("a"), F.col("b"))).collect()] == [False, True]


def test_presentation(spark):
    df = spark.createDataFrame([(["a", " ", "b", "c", "d", "e"],), ([],), (None,), (["a", "b"],)], "x array<string>")
    assert [r[0] for r in df.select(present.join_top(F.col("x"))).collect()] == ["a; b; c; (+2 more)", "Not Available", "Not Available", "a; b"]
    rows = [("Cardiology", None, "ON"), ("Other Pharmaceutical", "Neurology", "ON"), ("Other Pharmaceutical", None, "ON"), (None, None, "ON"), (None, "", "??")]
    df = spark.createDataFrame(rows, "i string, t string, c string")
    area = present.display_area(F.col("i"), F.col("t"), present.labels_of({"ON": "Oncology"}, F.col("c")))
    assert [r[0] for r in df.select(area).collect()] == ["Cardiology", "Neurology", "Other Pharmaceutical", "Oncology", "Not Available"]


@pytest.mark.parametrize("term, mode", [("carboplatin", "substring"), ("all", "word"), ("سل", "article"), ("الاورام", "substring")])
def test_modes(term, mode):
    assert mode_of(term) == mode


def test_hits(spark):
    terms = ("all", "api", "carboplatin", "سل", "أورام")
    rows = ("capital of all", "api, all", "carboplatins", "مرض السل", "تسلسل", "الأورام")
    got = values(spark, lambda c: hits(text.fold(c), terms), *rows)
    assert got == [["all"], ["all", "api"], ["carboplatin"], ["سل"], [], ["اورام"]]
    assert values(spark, lambda c: stem_hits(text.fold(c), ("tinib",)), "Zanubrutinib xtinib tinibs") == [["zanubrutinib"]]
