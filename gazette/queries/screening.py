"""Lexicons, classification and extraction over the driver's tables, with a lexicon of words that their prose has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions.text import fold
from gazette.operators import extract
from gazette.operators.classify import SIGNALS, classify_items, oncology_score, with_area, with_evidence, with_verdict
from gazette.operators.headers import completeness, guess_fields
from gazette.operators.lexicon import compiled, hits, stem_hits
from gazette.plans.params import ScreenParams
from gazette.queries import query
from gazette.queries.functions import fold_sql
from gazette.sources.views import read, tenders, with_views

PROSE = ScreenParams(
    lexicons={
        "pharma": ("theand", "inea", "der die", "erent", "les"), "non_pharma": ("onble",), "device": ("stand", "eaux"), "onc_context": ("inthe", "enten"), "onc_indication": ("heon", "schen", "of"),
        "onc_molecule": ("thereat", "mentre"), "onc_mab": ("andhe",), "onc_supportive": ("ereden",), "commodity": ("ouin",),
    },
    areas=(("Hematology", ("ndat", "with")), ("Neurology", ("tising", "atre")), ("Cardiology", ("ouer", "enst"))), stems=("tinib", "tion", "ment"), portfolio=("erion", "ishe"),
)


def _hit(term: str, mode: str) -> str:
    if mode == "substring":
        return f"contains(f, '{term}')"
    return f"regexp_matches(f, '(?:^|[^\\p{{L}}\\p{{N}}_])({term})(?:$|[^\\p{{L}}\\p{{N}}_])')"


def hits_sql(terms) -> str:
    return "[x for x in [" + ", ".join(f"CASE WHEN {_hit(t, m)} THEN '{t}' END" for t, m in compiled(terms)) + "] if x IS NOT NULL]"


STEMS_SQL = f"list_sort(list_distinct(list_filter(regexp_split_to_array(f, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 7 AND regexp_matches(x, '({'|'.join(PROSE.stems)})$'))))"
FOLDED = f"WITH d AS (SELECT doc_id, {fold_sql('text')} AS f FROM documents)"
EVIDENCE = FOLDED + ", e AS (SELECT doc_id, f, " + ", ".join(f"{hits_sql(t)} AS {n}" for n, t in PROSE.lexicons.items()) + f", {STEMS_SQL} AS stems, " + ", ".join(f"len({hits_sql(t)}) AS a{i}" for i, (_, t) in enumerate(PROSE.areas)) + " FROM d)"
SCORE = "least(1.0::DOUBLE, " + " + ".join(f"least({cap}::DOUBLE, {w}::DOUBLE * len({n}))" for n, w, cap in SIGNALS) + ")"
AREA = "CASE WHEN greatest(a0, a1, a2) = 0 THEN 'Other Pharmaceutical' WHEN a0 = greatest(a0, a1, a2) THEN 'Hematology' WHEN a1 = greatest(a0, a1, a2) THEN 'Neurology' ELSE 'Cardiology' END"
_P = ["erion", "ishe"]
VERDICT = EVIDENCE + f""", s AS (SELECT *, {SCORE} AS score, {AREA} AS area, least(0.95::DOUBLE, CASE WHEN greatest(a0, a1, a2) = 0 THEN 0.25 ELSE 0.45::DOUBLE + 0.18::DOUBLE * greatest(a0, a1, a2) END) AS ac FROM e),
v AS (SELECT *, f <> '' AND (len(pharma) > 0 OR score >= 0.22 OR area <> 'Other Pharmaceutical') AS is_pharma, f <> '' AND len(device) > 0 AS is_device FROM s),
w AS (SELECT *, is_pharma AND score >= 0.45 AS is_oncology FROM v),
x AS (SELECT *, CASE WHEN is_oncology THEN 'Oncology' WHEN is_pharma THEN area END AS therapeutic_area,
  CASE WHEN f = '' THEN 0.0 WHEN NOT is_pharma AND len(non_pharma) > 0 THEN 0.8 WHEN NOT is_pharma AND is_device THEN 0.6 WHEN NOT is_pharma THEN 0.2 WHEN is_oncology THEN least(0.97::DOUBLE, 0.5 + score / 2) WHEN score >= 0.22 THEN least(ac, 0.5) ELSE ac END AS confidence,
  CASE WHEN f = '' THEN true WHEN NOT is_pharma AND len(non_pharma) > 0 THEN false WHEN NOT is_pharma AND is_device THEN false WHEN NOT is_pharma THEN true WHEN is_oncology THEN false WHEN score >= 0.22 THEN true ELSE area = 'Other Pharmaceutical' END AS needs_review FROM w),
p AS (SELECT *, CASE WHEN is_pharma THEN CASE WHEN is_oncology THEN 50 ELSE 0 END + CASE WHEN contains(f, 'erion') OR contains(f, 'ishe') THEN 35 ELSE 0 END + CASE WHEN therapeutic_area IN ('Hematology', 'Rare Disease', 'Immunology') THEN 22 ELSE 0 END
  + CASE WHEN len(commodity) > 0 THEN -18 ELSE 0 END + CASE WHEN is_device AND NOT is_oncology THEN -12 ELSE 0 END ELSE 0 END AS priority_score FROM x)"""


@query(FOLDED + f" SELECT doc_id, array_to_string({hits_sql(PROSE.lexicons['onc_indication'] + PROSE.lexicons['pharma'])}, ';') AS hits, array_to_string({STEMS_SQL}, ';') AS stems FROM d")
def c02_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", fold(F.col("text")).alias("f"))
    terms = PROSE.lexicons["onc_indication"] + PROSE.lexicons["pharma"]
    return d.select("doc_id", F.array_join(hits(F.col("f"), terms), ";").alias("hits"), F.array_join(stem_hits(F.col("f"), PROSE.stems), ";").alias("stems"))


@query(EVIDENCE + f", s AS (SELECT doc_id, {SCORE} AS score, {AREA} AS area FROM e) SELECT doc_id, round(score, 6) AS score, area FROM s")
def c04_score_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = with_area(with_evidence(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", PROSE))
    return e.select("doc_id", F.round(oncology_score(), 6).alias("score"), "area")


@query(VERDICT + """ SELECT doc_id, is_pharma, is_device, is_oncology, therapeutic_area, round(confidence, 6) AS confidence, needs_review, CAST(priority_score AS DOUBLE) AS priority_score,
  CASE WHEN priority_score >= 45 THEN 'High' WHEN priority_score >= 15 THEN 'Medium' ELSE 'Low' END AS priority FROM p""")
def c06_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = with_verdict(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", PROSE)
    return v.select("doc_id", "is_pharma", "is_device", "is_oncology", "therapeutic_area", F.round("confidence", 6).alias("confidence"), "needs_review", "priority_score", "priority")


@query(VERDICT + " SELECT count(*) AS n, count(*) FILTER (WHERE is_pharma OR needs_review) AS n_kept, count(*) FILTER (WHERE is_pharma) AS n_pharma, count(*) FILTER (WHERE is_oncology) AS n_oncology FROM p")
def c11_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = with_verdict(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", PROSE)
    return v.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_pharma") | F.col("needs_review")).alias("n_kept"), F.count_if("is_pharma").alias("n_pharma"), F.count_if("is_oncology").alias("n_oncology"))


@query()
def c09_evidence_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = with_verdict(read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", PROSE)
    return v.select("conv_id", "turn", F.array_join("notes", "; ").alias("notes"), "review_reason")


@query(with_views("SELECT id, priority_score + CASE WHEN estimated_value >= 100000 THEN 20 ELSE 0 END AS boosted, priority FROM tenders"))
def c08_value_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazette.operators.classify import value_boost

    return tenders(spark, sf_dir).select("id", value_boost(F.col("priority_score"), F.col("estimated_value"), ScreenParams()).alias("boosted"), "priority")


_HREF = "unnest(regexp_extract_all(html, '(?i)href=\"([^\"]+)\"', 1)) AS href, unnest(range(len(regexp_extract_all(html, '(?i)href=\"([^\"]+)\"', 1)))) AS pos"


@query(f"""
WITH l AS (SELECT page_id, url, {_HREF} FROM pages)
SELECT page_id, pos, href, regexp_matches(href, '(?i)\\.(pdf|docx?|xlsx?|zip|csv|txt)([?#].*)?$') AS is_document,
  CASE WHEN regexp_matches(href, '^[a-zA-Z]+:') THEN href WHEN starts_with(href, '//') THEN concat(regexp_extract(url, '^([a-zA-Z]+:)', 1), href) WHEN starts_with(href, '/') THEN concat(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1), href)
    ELSE concat(CASE WHEN regexp_extract(url, '^([a-zA-Z]+://[^?#]*/)', 1) = '' THEN concat(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1), '/') ELSE regexp_extract(url, '^([a-zA-Z]+://[^?#]*/)', 1) END, href) END AS absolute
FROM l WHERE NOT starts_with(lower(href), 'javascript:')""")
def s04_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.links(read(spark, sf_dir, "pages")).withColumn("pos", F.col("at").cast("long")).drop("at")


@query()
def s05_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", extract.page_text(F.col("html")).alias("text"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS reference, event_type AS subject, CAST(ts AS DATE) AS publication_date, value AS estimated_value, 'KWD' AS currency FROM events")
def s02_json_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    raw = e.groupBy(F.floor(F.col("event_id") / 500).alias("page")).agg(F.collect_list(F.struct(F.from_json("props", "k long")["k"].alias("ref"), F.col("event_type").alias("name"), F.date_format("ts", "dd/MM/yyyy HH:mm").alias("day"), F.concat(F.lit("KWD "), F.col("value").cast("string")).alias("amount"))).alias("rows"))
    nested = raw.select(F.struct("rows").alias("data"))
    return extract.json_listings(nested, "data.rows", {"reference": "ref", "subject": "name", "publication_date": "day", "estimated_value": "amount"})


@query()
def s06_price_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines made from parts: wide ones teach the makers, tight ones use them, a tenth can't be read."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    price = F.format_string("%.3f", "p_retailprice")
    gap = F.when(k % 2 == 0, "     ").otherwise(" ")
    line = F.when(k % 10 == 9, F.concat("p_name", F.lit(" no price"))).otherwise(F.concat("p_name", gap, F.lit("Maker "), "p_brand", F.lit("   "), F.col("p_size").cast("string"), F.lit(" tab   "), price, F.lit("  "), price))
    good, _ = extract.price_list(p.select(k.alias("line_no"), line.alias("line")), "list")
    return good.select("line_no", "product_name", "manufacturer", "pack_qty", "form", "retail_price", "skeleton")


@query()
def s03_html_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result tables built around the pages' URLs, read back as listings."""
    row = F.format_string("<tr><td>TN/%d</td><td>Supply %d</td><td>0%d/02/2026</td><td>%d,000 KD</td></tr>", "page_id", "page_id", F.col("page_id") % 9 + 1, "page_id")
    html = F.concat(F.col("html"), F.lit("<table><tr><th>Tender No</th><th>Title</th><th>Closing Date</th><th>Value</th></tr>"), row, F.lit("<tr><td>alone</td></tr></table>"))
    tables = extract.html_tables(read(spark, sf_dir, "pages").select("page_id", html.alias("html")))
    return extract.listings_of(tables).select("page_id", "tender_number", "tender_title", "submission_deadline", "estimated_value", "currency")


@query()
def m13_items_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazette.sources.views import items

    i = items(spark, sf_dir)
    row = F.array(F.col("item_no").cast("string"), "product_name", F.concat(F.format_number("quantity", 0), F.lit(" "), "unit"), F.format_number("unit_price", 2))
    head = F.array(F.array(F.lit("Annual list")), F.array(F.lit("Item No"), F.lit("Item Description"), F.lit("Qty"), F.lit("Unit Price")))
    tables = i.groupBy("tender_id").agg(F.array(F.concat(head, F.sort_array(F.collect_list(row)))).alias("tables"))
    return extract.items_of_tables(tables).select("tender_id", "product_name", "quantity", "unit", "unit_price", "dosage_form", "strength")


@query()
def m14_items_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazette.sources.views import items

    i = items(spark, sf_dir)
    line = F.concat(F.col("item_no").cast("string"), F.lit(". "), "product_name", F.lit("   "), F.format_number("quantity", 0), F.lit(" vials"))
    text = F.concat(F.lit("Annual list\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n"), F.lit("\nend"))
    return extract.counted_lines(i.groupBy("tender_id").agg(text.alias("text"))).select("tender_id", "row", "product_name", "quantity", "unit", "needs_review")


_DOSES = extract.dose_line(word=r"\p{L}\p{N}_").replace("'", "''")


@query(with_views(f"""
, l AS (SELECT tender_id, CASE WHEN item_no % 3 = 0 THEN '' ELSE concat(item_no, CASE WHEN item_no % 3 = 1 THEN '. ' ELSE ') ' END) END || product_name || ' for ' || quantity::INT || ' wards' AS line, item_id FROM items),
t AS (SELECT tender_id, concat('List of goods' || chr(10) || '----' || chr(10), string_agg(line, chr(10) || '----' || chr(10) ORDER BY line, item_id)) AS text FROM l GROUP BY tender_id),
m AS (SELECT tender_id, unnest(regexp_extract_all(text, '{_DOSES}', 1)) AS item_no, unnest(regexp_extract_all(text, '{_DOSES}', 2)) AS name, unnest(regexp_extract_all(text, '{_DOSES}', 3)) AS dose FROM t)
SELECT tender_id, nullif(item_no, '') AS item_no, trim(regexp_replace(concat(name, ' ', dose), '\\s+', ' ', 'g')) AS product_name, true AS needs_review FROM m WHERE length(trim(regexp_replace(concat(name, ' ', dose), '\\s+', ' ', 'g'))) >= 6"""))
def m14_dose_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of goods as prose: names with doses, two lines of three with a number."""
    from gazette.sources.views import items

    i, n = items(spark, sf_dir), F.col("item_no")
    number = F.when(n % 3 == 0, "").otherwise(F.concat(n.cast("string"), F.when(n % 3 == 1, ". ").otherwise(") ")))
    line = F.concat(number, "product_name", F.lit(" for "), F.col("quantity").cast("int").cast("string"), F.lit(" wards"))
    rows = F.sort_array(F.collect_list(F.struct(line.alias("line"), "item_id")))
    text = F.concat(F.lit("List of goods\n----\n"), F.array_join(F.transform(rows, lambda x: x["line"]), "\n----\n"))
    return extract.items_of_text(i.groupBy("tender_id").agg(text.alias("text"))).select("tender_id", "item_no", "product_name", "needs_review")


TURNS = "WITH d AS (SELECT concat(conv_id, '-', turn) AS doc_id, " + fold_sql("concat_ws(' ', role, text)") + " AS f FROM conversations)"


@query(VERDICT.replace(FOLDED, TURNS) + " SELECT doc_id AS item_id, therapeutic_area, is_oncology FROM p")
def c12_item_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as line items: role and text are their values."""
    items = read(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("item_id"), "role", "text")
    return classify_items(items, PROSE).select("item_id", "therapeutic_area", "is_oncology")


@query("""
SELECT p_brand AS source, count(*) AS n_rows, count(*) FILTER (WHERE p_partkey % 9 = 0) AS n_no_manufacturer, count(*) FILTER (WHERE p_size % 5 = 0) AS n_no_pack, count(*) FILTER (WHERE p_partkey % 4 = 1) AS n_no_price,
  count(*) FILTER (WHERE p_partkey % 11 = 3) AS n_unread FROM part GROUP BY p_brand""")
def p10_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    products = p.select(F.col("p_brand").alias("source"), F.when(k % 11 != 3, F.col("p_name")).alias("product_name"), F.when(k % 9 == 0, "").otherwise(F.col("p_type")).alias("manufacturer"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("pack_qty"), F.when(k % 4 != 1, F.col("p_retailprice")).alias("retail_price"))
    return completeness(products)


@query()
def j14_fuzzy_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product names as headers: some as they are, some with a letter missing or in capitals, some backwards; a test holds the operator against a loop."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.col("p_name")
    header = F.when(k % 4 == 0, name).when(k % 4 == 1, F.concat(F.substring(name, 1, 3), F.expr("substring(p_name, 5)"))).when(k % 4 == 2, F.upper(name)).otherwise(F.reverse(name))
    return guess_fields(p.select(header.alias("header")), p.select(name.alias("alias"), F.concat(F.lit("field "), name).alias("field")))


@query(with_views("SELECT id, row_number() OVER (ORDER BY publication_date DESC, id) AS place FROM tenders WHERE needs_review"))
def l07_review_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each notice in the order of review: it counts the rows before it, partition by partition."""
    from gazette.operators.merge import places, review_order

    flagged = tenders(spark, sf_dir).withColumn("last_seen", F.col("publication_date"))
    return places(review_order(flagged)).select("id", "place")


@query(with_views("SELECT id, publication_date AS last_seen FROM tenders WHERE needs_review"))
def l07_review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazette.operators.merge import review_order

    return review_order(tenders(spark, sf_dir).withColumn("last_seen", F.col("publication_date"))).select("id", "last_seen")
