"""Scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import keys, molecules, parse, present, text
from gazette.queries import query
from gazette.sources.views import AS_OF, items, read, tenders, with_views

FOLD = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_؀-ۿ%./+-]+', ' ', 'g'), '\s+', ' ', 'g'))"
CORE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\d+(?:[.,]\d+)?\s*%?', ' ', 'g'), '\b(NOISE)\b', ' ', 'g'), '[^a-z ]+', ' ', 'g'), '\s+', ' ', 'g'))".replace("NOISE", "|".join(molecules.NOISE))


def fold_sql(column: str) -> str:
    return FOLD.format(column)


def core_sql(folded: str) -> str:
    return CORE.replace("{0}", folded)


def skeleton_sql(core: str) -> str:
    out = f"replace({core}, ' ', '')"
    for a, b in molecules.SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    out = f"regexp_replace({out}, '[aeiouy]', '', 'g')"
    for letter in "bcdfghjklmnpqrstvwxz":
        out = f"regexp_replace({out}, '{letter}+', '{letter}', 'g')"
    return out


@query(f"""
WITH f AS (SELECT doc_id, text, {fold_sql('text')} AS folded FROM documents)
SELECT doc_id, md5(folded) AS folded, len(list_filter(regexp_split_to_array(folded, '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')) AS n_tokens,
  md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS cleaned FROM f""")
def f01_fold_tokens_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"), text.clean(F.col("text")).alias("cleaned"))
    return df.select("doc_id", F.md5("folded").alias("folded"), F.size(text.tokens_of(F.col("folded"))).alias("n_tokens"), F.md5("cleaned").alias("cleaned"))


_DATE = ("yyyy-MM-dd", "dd/MM/yyyy", "d-M-yyyy", "dd.MM.yyyy", "d MMM yyyy", "MMM d, yyyy")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed,
  CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE date_diff('day', DATE '1998-06-15', CAST(o_orderdate AS DATE)) END AS days_left,
  concat(lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0'), ':', lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0')) AS at
FROM orders""")
def f06_dates_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    forms = [F.when(k % 7 == i, F.concat(F.lit("Closing: "), F.date_format("o_orderdate", form), F.lit(" 10:30 AM"))) for i, form in enumerate(_DATE)]
    written = F.coalesce(*forms, F.lit("31/02/1999 to be fixed"))
    hour = F.when(k % 12 == 0, 12).otherwise(k % 12)  # noon is 12 PM, midnight 12 am
    clock = F.concat(hour.cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"), F.when(k % 24 >= 12, " PM").otherwise("am"))
    out = o.select("o_orderkey", parse.parse_date(written).alias("parsed"), parse.parse_time(clock).alias("at"))
    return out.select("o_orderkey", "parsed", parse.days_until(F.col("parsed"), F.to_date(F.lit(AS_OF))).cast("long").alias("days_left"), "at")


@query("""
SELECT o_orderkey, round(o_totalprice, 2) AS amount, ['KWD', 'KWD', 'USD', 'EUR', NULL][CAST(o_orderkey % 5 + 1 AS INT)] AS currency, CAST(o_orderkey AS DOUBLE) AS quantity,
  CASE WHEN o_orderkey % 2 = 0 THEN 'vials' END AS unit FROM orders""")
def f09_amounts_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    number = F.format_number("o_totalprice", 2)
    amount = F.when(k % 5 == 0, F.concat(number, F.lit(" KD"))).when(k % 5 == 1, F.concat(F.lit("KWD "), number)).when(k % 5 == 2, F.concat(F.lit("$"), number)).when(k % 5 == 3, F.concat(number, F.lit(" €"))).otherwise(number)
    quantity = F.concat(F.format_number("o_orderkey", 0), F.when(k % 2 == 0, "  vials ").otherwise(""))
    return o.select("o_orderkey", parse.parse_amount(amount).alias("a"), parse.parse_quantity(quantity).alias("q")).select("o_orderkey", F.round("a.amount", 2).alias("amount"), "a.currency", "q.quantity", "q.unit")


_FORM_SQL = " ".join(f"WHEN contains(low, '{form}') THEN '{form}'" for form in sorted(parse.DOSAGE_FORMS, key=lambda x: -len(x)))


@query(f"""
WITH d AS (SELECT p_partkey, concat(p_name, ' ', p_size, ' mg/5 ml oral solution box of ', p_size, CASE WHEN p_partkey % 2 = 0 THEN ' 10x5 ml vial' ELSE ' (cid:12)  tablets' END) AS raw FROM part),
l AS (SELECT p_partkey, {fold_sql('raw')} AS low, raw FROM d)
SELECT p_partkey, trim(regexp_extract(raw, '\\d+ mg/5 ml')) AS strength, CASE {_FORM_SQL} END AS form, regexp_extract(raw, 'box of \\d+') AS pack,
  regexp_replace(regexp_replace(raw, '\\(cid:\\d+\\)', ' ', 'g'), ' {{2,}}', ' ', 'g') AS stripped FROM l""")
def f11_product_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    raw = F.concat("p_name", F.lit(" "), size, F.lit(" mg/5 ml oral solution box of "), size, F.when(F.col("p_partkey") % 2 == 0, " 10x5 ml vial").otherwise(" (cid:12)  tablets"))
    d = read(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    c = F.col("raw")
    return d.select("p_partkey", parse.extract_strength(c).alias("strength"), parse.extract_dosage_form(c, normalise=False).alias("form"), parse.extract_pack_size(c).alias("pack"), text.strip_cid(c).alias("stripped"))


_URL = r"regexp_replace(regexp_replace(lower(trim({0})), '[?&](sessionid|jsessionid|token|_|timestamp|rnd)=[^&]*', '', 'g'), '[/?&]+$', '')"
_NUM = rf"regexp_replace({fold_sql('tender_number')}, '[^\p{{L}}\p{{N}}_]', '', 'g')"


@query(with_views(f"""
, k AS (SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE {_NUM} END AS number, {_URL.format('tender_page_url')} AS url, {fold_sql('issuing_authority')} AS auth, {fold_sql('tender_title')} AS title, * EXCLUDE (id) FROM tenders)
SELECT id, coalesce(number, '') AS number, url,
  sha1(CASE WHEN number IS NOT NULL THEN concat_ws('|', source, 'num', number) WHEN id % 2 = 0 THEN concat_ws('|', source, 'url', url) ELSE concat_ws('|', source, 'txt', auth, title) END) AS print,
  sha1(concat_ws('|', title, auth, {fold_sql('CAST(publication_date AS VARCHAR)')}, coalesce({fold_sql('CAST(submission_deadline AS VARCHAR)')}, 'none'), '', '', '', '')) AS hash FROM k"""))
def f15_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = tenders(spark, sf_dir), F.col("id")
    number = F.when(k % 3 != 0, F.col("tender_number"))
    url = F.when((k % 3 != 0) | (k % 2 == 0), F.col("tender_page_url"))
    watched = {c: F.col(c) for c in ("tender_title", "issuing_authority", "publication_date", "submission_deadline")}
    return t.select(
        "id", keys.normalise_number(number, normalise=False).alias("number"), keys.normalise_url(F.col("tender_page_url")).alias("url"),
        keys.fingerprint(F.col("source"), number, url, F.col("tender_title"), F.col("issuing_authority"), normalise=False).alias("print"), keys.content_hash(watched, normalise=False).alias("hash"),
    )


@query(f"""
WITH p AS (SELECT p_partkey, {fold_sql("concat(p_name, ' (', replace(p_type, ' ', ''), 'ine) & ', lower(p_brand), ' 50 mg tablets and sodium')")} AS folded FROM part),
c AS (SELECT p_partkey, {core_sql('folded')} AS core FROM p),
s AS (SELECT *, {skeleton_sql('core')} AS skeleton, list_filter(string_split(core, ' '), lambda w: length(w) >= 5 AND w NOT IN ({', '.join(f"'{w}'" for w in molecules.STOP_WORDS)})) AS w FROM c)
SELECT p_partkey, core, skeleton, array_to_string(list_distinct_ordered, ';') AS terms FROM (
  SELECT *, list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 8) AS list_distinct_ordered FROM (
    SELECT *, list_concat(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])) ELSE [] END, w) AS l FROM s))""")
def f19_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(" ("), F.replace("p_type", F.lit(" "), F.lit("")), F.lit("ine) & "), F.lower("p_brand"), F.lit(" 50 mg tablets and sodium"))
    d = read(spark, sf_dir, "part").select("p_partkey", molecules.normalise_molecule(raw, normalise=False).alias("core"))
    c = F.col("core")
    return d.select("p_partkey", "core", molecules.skeleton_of(c).alias("skeleton"), F.array_join(molecules.candidates_of(c), ";").alias("terms"))


@query(f"""
WITH v AS (SELECT p_partkey, unnest([lower(concat(p_name, ' (', p_brand, 'um), mitomycin')), lower(concat(p_brand, 'um')), lower(p_name), 'mitomycin']) AS raw, unnest([1, 2, 3, 4]) AS i FROM part),
c AS (SELECT p_partkey, i, {core_sql(fold_sql('raw'))} AS core FROM v)
SELECT p_partkey, coalesce(string_agg(core, ';' ORDER BY i) FILTER (WHERE length(core) >= 4), '') AS variants FROM (SELECT p_partkey, core, min(i) AS i FROM c GROUP BY ALL) GROUP BY p_partkey""")
def f21_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(" ("), "p_brand", F.lit("um), mitomycin"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(molecules.molecule_variants(raw), ";").alias("variants"))


@query(with_views("""
SELECT item_id, CASE WHEN len(portfolio_product) = 0 THEN 'Not Available' ELSE array_to_string(portfolio_product, '; ') END AS shown,
  CASE WHEN len(l) > 3 THEN concat(l[1], '; ', l[2], '; ', l[3], '; (+', len(l) - 3, ' more)') ELSE array_to_string(l, '; ') END AS listed,
  CASE WHEN quantity * unit_price <> 0 THEN floor(quantity * unit_price + 0.0001) END AS value, format('{:,.0f}', quantity * 1000) AS formatted,
  regexp_replace(lower(product_name), '[^a-z0-9]', '', 'g') AS core, lower(trim(unit)) AS unit_key
FROM (SELECT *, list_concat([product_name, 'b', 'c'], list_transform(range(item_no % 3), lambda x: 'more')) AS l FROM items)"""))
def f27_presentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    listed = F.concat(F.array("product_name", F.lit("b"), F.lit("c")), F.array_repeat(F.lit("more"), (F.col("item_no") % 3).cast("int")))
    key = keys.item_key(F.col("product_name"), F.col("unit"), F.col("quantity"))
    value = parse.line_value(F.col("quantity"), F.col("unit_price"))
    return i.select("item_id", present.join_top(F.col("portfolio_product")).alias("shown"), present.join_top(listed).alias("listed"), F.floor(value + 0.0001).cast("double").alias("value"), present.whole_number(F.col("quantity") * 1000).alias("formatted"), key["core"].alias("core"), key["unit"].alias("unit_key"))


@query(with_views("""
SELECT item_id, coalesce(CASE WHEN i.therapeutic_area <> 'Other Pharmaceutical' THEN i.therapeutic_area END, CASE WHEN t.therapeutic_area <> 'Other Pharmaceutical' THEN t.therapeutic_area END,
    i.therapeutic_area, t.therapeutic_area, CASE search_code WHEN 'ON' THEN 'Oncology' WHEN 'TB' THEN 'Tuberculosis' WHEN 'IN' THEN 'Infectious Disease' WHEN 'SP' THEN 'Specialty' WHEN 'NU' THEN 'Nutrition' END, 'Not Available') AS area,
  coalesce(submission_deadline >= DATE '1998-06-15', false) AS is_open, coalesce(submission_deadline <= DATE '1998-06-15', false) AS is_closed, coalesce(submission_deadline BETWEEN DATE '1998-06-15' AND DATE '1998-07-15', false) AS in_30
FROM items i JOIN tenders t ON t.id = i.tender_id"""))
def f28_area_and_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazette.plans.params import ScreenParams

    t = tenders(spark, sf_dir).select("id", F.col("therapeutic_area").alias("tender_area"), "search_code", "submission_deadline")
    i = items(spark, sf_dir).select("item_id", "tender_id", F.col("therapeutic_area").alias("item_area"))
    joined = i.join(t, i.tender_id == t.id)
    area = present.display_area(F.col("item_area"), F.col("tender_area"), present.labels_of(ScreenParams().code_labels, F.col("search_code")))
    day = F.col("submission_deadline")
    return joined.select("item_id", area.alias("area"), *(present.within(day, *present.closing_window(p, AS_OF)).alias(n) for p, n in (("open", "is_open"), ("closed", "is_closed"), ("30", "in_30"))))


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, concat_ws(' ', event_type, CAST(user_id AS VARCHAR)) AS search_text, to_json({'event_type': event_type, 'user_id': user_id}) AS row_json FROM events""")
def f32_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("search_text"), present.evidence_json(F.col("event_type"), F.col("user_id")).alias("row_json"))
