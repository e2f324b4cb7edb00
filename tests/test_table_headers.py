"""A table's header is found in one step where the table is; cells are tidied as one column."""

from pyspark.sql import functions as F

from gazette.functions import text
from gazette.operators import extract


def test_headers_need_no_join(spark):
    head, late = ["Item No", " Item​  Description", "Qty"], [["x"]] * 8
    tables = [[head, ["1", "ﬁlm  tablet 5 mg", None], ["alone"], ["2", "", "٣ vials"]], None, [], [None, head, ["3", "gauze"]], [*late, head, ["4", "never read", "1"]], [["Qty"], ["Qty", "x" * 61 + " item"]]]
    df = spark.createDataFrame([(1, tables), (2, None), (3, [[["Qty", "Product", "Item No"], ["7", "　saline\x85bag ", "9", "more"]]])], "k long, tables array<array<array<string>>>")
    rows = extract.table_rows(df, "k", extract.ITEM_HINTS, "product_name")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Exchange" not in plan
    got = {(r.k, r.table, r.row): (r.item_no, r.product_name, r.quantity, r.unit) for r in rows.collect()}
    assert got == {(1, 0, 1): ("1", "film tablet 5 mg", None, None), (1, 0, 3): ("2", None, "٣ vials", None), (1, 3, 2): ("3", "gauze", None, None), (3, 0, 1): ("9", "saline bag", "7", None)}
    plain = {(r.k, r.table, r.row): r.product_name for r in extract.table_rows(df, "k", extract.ITEM_HINTS, "product_name", normalise=False).collect()}
    assert plain == {k: "ﬁlm tablet 5 mg" if k == (1, 0, 1) else v[1] for k, v in got.items()}


def test_elements_are_cleaned_as_columns_are(spark):
    values = [None, "", " a\t\x0b b ", "\x1c\x1fx​‏ y ", "ﬁ ①　２", "é\xa0\x85", "᠎ z"]
    df = spark.createDataFrame([(values,), ([],), (None,), ([None],), (values[1:],)], "v array<string>").coalesce(1)
    one = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    want = [r.v for r in one.select("i", text.clean(F.col("v")).alias("v")).orderBy("i").collect()]
    assert [r[0] for r in df.select(text.clean_each(F.col("v"))).collect()] == [want, [], None, [""], want[1:]]
