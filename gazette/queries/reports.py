"""Tracker, reports and forecasts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.operators import forecast, planning, resolve, tracker
from gazette.operators.contains import contains_join
from gazette.plans.params import ScreenParams
from gazette.queries import query
from gazette.sources.settled import dealt, settled
from gazette.sources.views import AS_OF, items, read, tenders, with_views

P = ScreenParams()
AREA_SQL = """coalesce(CASE WHEN i.therapeutic_area <> 'Other Pharmaceutical' THEN i.therapeutic_area END, CASE WHEN t.therapeutic_area <> 'Other Pharmaceutical' THEN t.therapeutic_area END,
    i.therapeutic_area, t.therapeutic_area, CASE search_code WHEN 'ON' THEN 'Oncology' WHEN 'TB' THEN 'Tuberculosis' WHEN 'IN' THEN 'Infectious Disease' WHEN 'SP' THEN 'Specialty' WHEN 'NU' THEN 'Nutrition' END, 'Not Available')"""
JOINED = f""", j AS (SELECT i.* EXCLUDE (therapeutic_area), t.id, t.tender_number, t.tender_title, t.issuing_authority, t.submission_deadline, t.publication_date, t.priority, t.is_oncology, t.search_code, {AREA_SQL} AS area
  FROM items i JOIN tenders t ON t.id = i.tender_id)"""
OPEN = "coalesce(submission_deadline >= DATE '1998-06-15', false)"
SCOPE = f"{JOINED}, s AS (SELECT * FROM j WHERE submission_deadline BETWEEN DATE '1998-06-15' AND DATE '1998-08-14' AND len(portfolio_product) > 0 AND contains(lower(concat_ws(' ', tender_number, product_name, issuing_authority, area, search_code, unit)), 'a'))"


def _scope(spark: SparkSession, sf_dir: str, **filters) -> DataFrame:
    return tracker.scoped(items(spark, sf_dir), tenders(spark, sf_dir), P, AS_OF, **filters)


@query(with_views(SCOPE + """
SELECT item_id, tender_number, CAST(submission_deadline AS VARCHAR) AS closing, area, product_name, unit, quantity,
  CASE WHEN len(registered_products) = 0 THEN 'Not Available' ELSE registered_products[1] END AS registered, portfolio_product[1] AS product, portfolio_principal[1] AS principal,
  ref_match_method AS method, CASE WHEN ref_match_method IN ('skeleton', 'brand') THEN 'amber' WHEN ref_match_method = 'none' THEN 'pink' ELSE 'none' END AS highlight FROM s"""))
def r09_scoped_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.shown(tracker.ordered(_scope(spark, sf_dir, window="60", kind="portfolio", needle="A")))


@query(with_views(JOINED + f"""
SELECT count(*) AS n_items, count(*) FILTER (WHERE len(portfolio_product) > 0) AS n_portfolio, count(*) FILTER (WHERE len(registered_products) > 0) AS n_registry,
  count(*) FILTER (WHERE {OPEN} AND len(portfolio_product) > 0) AS n_open_portfolio, count(*) FILTER (WHERE needs_review) AS n_review, count(*) FILTER (WHERE is_oncology) AS n_oncology,
  count(*) FILTER (WHERE {OPEN}) AS n_open, count(DISTINCT tender_number) AS n_tenders, count(DISTINCT CASE WHEN {OPEN} THEN tender_number END) AS n_open_tenders FROM j"""))
def r05_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.kpis(_scope(spark, sf_dir), AS_OF)


@query(with_views(JOINED + """
SELECT item_id, tender_number, submission_deadline, area, left(product_name, 60) AS product, CASE WHEN ref_match_method = 'exact' THEN 'exact' ELSE 'verify' END AS "check"
FROM j WHERE submission_deadline >= DATE '1998-06-15' AND len(portfolio_product) > 0"""))
def r06_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.opportunities(_scope(spark, sf_dir), AS_OF)


@query(with_views(JOINED + """
SELECT tender_number, submission_deadline, area, tender_title, priority FROM (SELECT *, row_number() OVER (PARTITION BY tender_number ORDER BY submission_deadline, item_id) AS n
  FROM j WHERE submission_deadline BETWEEN DATE '1998-06-15' AND DATE '1998-07-15') WHERE n = 1"""))
def r07_closing_soon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.closing_soon(_scope(spark, sf_dir), AS_OF)


@query(with_views(JOINED + "SELECT principal, count(*) AS n_items FROM (SELECT unnest(portfolio_principal) AS principal FROM j) GROUP BY principal"))
def r08_by_principal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.by_principal(_scope(spark, sf_dir))


@query(with_views(JOINED + """
SELECT area, count(*) AS n_tenders FROM (SELECT area, row_number() OVER (PARTITION BY tender_number ORDER BY submission_deadline NULLS LAST, item_id) AS n FROM j) WHERE n = 1 GROUP BY area"""))
def r08_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.by_area(_scope(spark, sf_dir))


@query(with_views(JOINED + """
, r AS (SELECT tender_number, count(*) AS n_items, count(*) FILTER (WHERE len(portfolio_product) > 0) AS n_matched, arg_min(area, (submission_deadline IS NULL, submission_deadline, item_id)) AS first_area, min(submission_deadline) AS closing FROM j GROUP BY tender_number)
SELECT r.*, t.tender_title, t.priority, t.is_oncology FROM r JOIN tenders t USING (tender_number)"""))
def r10_tenders_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = tenders(spark, sf_dir).groupBy("tender_number").agg(F.max_by(F.struct("tender_title", "priority", "is_oncology"), "id").alias("t")).select("tender_number", "t.*")
    return tracker.roll_up(_scope(spark, sf_dir)).join(flags, "tender_number")


@query(with_views(JOINED + f""", q AS (
SELECT 'tender' AS kind, CAST(id AS VARCHAR) AS key, tender_number, {AREA_SQL.replace('i.therapeutic_area', 'CAST(NULL AS VARCHAR)')} AS area, tender_title AS name FROM tenders t WHERE needs_review
UNION ALL SELECT 'item', item_id, tender_number, area, product_name FROM j WHERE needs_review)
SELECT * FROM q WHERE contains(lower(concat_ws(' ', tender_number, area, name, kind)), 'cardio')"""))
def r11_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.review_queue(items(spark, sf_dir), tenders(spark, sf_dir), P, needle="Cardio")


@query(with_views(JOINED + f""", e AS (SELECT *, unnest(CASE WHEN len(portfolio_product) > 0 THEN portfolio_product ELSE ['(no product matched)'] END) AS sku, {OPEN} AS o FROM j)
SELECT sku, count(DISTINCT tender_number) AS n_tenders, sum(quantity) AS quantity, array_to_string(list_sort(list_distinct(list(trim(unit)))), ', ') AS units, count(DISTINCT product_name) AS n_names,
  count(*) FILTER (WHERE o) AS n_open, min(submission_deadline) FILTER (WHERE o) AS next_closing, arg_min(portfolio_principal[1], item_id) FILTER (WHERE len(portfolio_principal) > 0) AS principal FROM e GROUP BY sku"""))
def r12_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.demand(_scope(spark, sf_dir), AS_OF)


@query(with_views(JOINED + f""", e AS (SELECT *, portfolio_principal[1] AS principal, portfolio_product[1] AS sku, {OPEN} AS o FROM j WHERE len(portfolio_principal) > 0)
SELECT principal, count(DISTINCT sku) AS n_skus, count(DISTINCT item_id) AS n_items, count(DISTINCT CASE WHEN o THEN tender_number END) AS n_open_tenders FROM e GROUP BY principal"""))
def a08_portfolio_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.portfolio_overview(_scope(spark, sf_dir), AS_OF)


@query(with_views(JOINED + """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE len(registered_products) > 0) AS n_registry, count(*) FILTER (WHERE len(portfolio_product) > 0) AS n_portfolio,
  count(*) FILTER (WHERE len(registered_products) = 0 AND len(portfolio_product) = 0) AS n_unmatched, count(*) FILTER (WHERE ref_match_method IN ('skeleton', 'brand')) AS n_fuzzy FROM j"""))
def a10_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.coverage(_scope(spark, sf_dir))


_CYCLE = """, g AS (SELECT subject, day, date_diff('day', lag(day) OVER (PARTITION BY subject ORDER BY day), day) AS gap FROM d WHERE day IS NOT NULL),
c AS (SELECT subject, count(*) AS n_days, median(gap) AS m, coalesce(stddev_pop(gap), 0) AS s, max(day) AS last_day, min(day) AS first_day FROM g GROUP BY subject),
cycles AS (SELECT subject, n_days, first_day, last_day, CASE WHEN n_days >= 3 THEN CAST(round_even(m, 0) AS INT) END AS cycle_days, CASE WHEN n_days >= 3 THEN CAST(round_even(s, 0) AS INT) END AS spread_days,
  CASE WHEN n_days >= 3 THEN last_day + CAST(round_even(m, 0) AS INT) END AS expected_next, CASE WHEN n_days >= 3 THEN CASE WHEN s < m * 0.20 THEN 'high' WHEN s < m * 0.45 THEN 'medium' ELSE 'low' END END AS confidence FROM c)"""


@query(with_views(", d AS (SELECT issuing_authority AS subject, publication_date AS day FROM tenders)" + _CYCLE + " SELECT * FROM cycles"))
def r03_authority_rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = tenders(spark, sf_dir).select(F.coalesce("issuing_authority", F.lit("Unknown")).alias("subject"), F.col("publication_date").alias("day"))
    return forecast.cycles(dated).drop("first_gaps")


def _histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tenders(spark, sf_dir).select("id", "publication_date", "estimated_value")
    i = items(spark, sf_dir).select("tender_id", "item_id", "product_name", "quantity", "unit")
    return i.join(t, i.tender_id == t.id).select(F.lower("product_name").alias("subject"), F.col("publication_date").alias("day"), "quantity", F.col("estimated_value").alias("value"), "unit", F.col("item_id").alias("key"))


_HISTORY = ", d AS (SELECT lower(product_name) AS subject, publication_date AS day, quantity, estimated_value AS value, unit, item_id AS key FROM items i JOIN tenders t ON t.id = i.tender_id)"


@query(with_views(_HISTORY + _CYCLE + """, a AS (SELECT subject, count(*) FILTER (WHERE quantity <> 0) AS n_quantity, median(quantity) FILTER (WHERE quantity <> 0) AS q, count(*) FILTER (WHERE value <> 0) AS n_value, median(value) FILTER (WHERE value <> 0) AS v, arg_min(unit, key) AS unit FROM d GROUP BY subject),
mo AS (SELECT subject, month(day) AS mo, count(*) AS n FROM d GROUP BY ALL), top AS (SELECT subject, string_agg(CAST(mo AS VARCHAR), ', ' ORDER BY mo) AS peaks FROM (SELECT *, rank() OVER (PARTITION BY subject ORDER BY n DESC) AS r FROM mo) WHERE r = 1 GROUP BY subject),
y AS (SELECT subject, count(DISTINCT year(day)) AS n_years FROM d GROUP BY subject)
SELECT subject, 'expected_next' AS metric, CAST(expected_next AS VARCHAR) AS value, confidence FROM cycles
UNION ALL SELECT subject, 'frequency', concat(CAST(cycle_days AS VARCHAR), CASE WHEN cycle_days IS NULL THEN NULL ELSE ' days' END), confidence FROM cycles WHERE cycle_days IS NOT NULL
UNION ALL SELECT subject, 'frequency', NULL, confidence FROM cycles WHERE cycle_days IS NULL
UNION ALL SELECT subject, 'typical_quantity', CASE WHEN n_quantity >= 3 THEN concat(format('{:,.0f}', q), ' ', trim(unit)) END, CASE WHEN n_quantity >= 5 THEN 'high' ELSE 'medium' END FROM a
UNION ALL SELECT subject, 'historical_value', CASE WHEN n_value >= 3 THEN format('{:,.0f}', v) END, 'medium' FROM a
UNION ALL SELECT subject, 'seasonal_pattern', CASE WHEN n_days >= 6 AND n_years >= 2 THEN peaks END, CASE WHEN n_days >= 6 AND n_years >= 2 THEN CASE WHEN n_days < 10 THEN 'low' ELSE 'medium' END END FROM cycles JOIN top USING (subject) JOIN y USING (subject)"""))
def r02_product_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.product_forecasts(_histories(spark, sf_dir)).drop("basis")


@query(with_views(_HISTORY + _CYCLE + " SELECT (SELECT count(*) FROM cycles) AS examined, count(*) AS with_cycle FROM cycles WHERE cycle_days IS NOT NULL"))
def r04_forecast_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forecast.product_forecasts(_histories(spark, sf_dir))
    return rows.filter("metric = 'expected_next'").agg(F.count_distinct("subject").alias("examined"), F.count("value").alias("with_cycle"))


@query(with_views(_HISTORY + " SELECT subject, day, date_diff('day', lag(day) OVER (PARTITION BY subject ORDER BY day), day) AS gap FROM d"))
def w01_lag_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.gaps(_histories(spark, sf_dir).select("subject", "day")).withColumn("gap", F.col("gap").cast("long"))


_HITS = JOINED + """, h AS (SELECT * FROM j WHERE contains(lower(concat_ws(' ', array_to_string(portfolio_principal, ' '), array_to_string(portfolio_product, ' '), product_name, array_to_string(registered_products, ' '))), 'principal 3'))"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.hits(_scope(spark, sf_dir), "Principal 3")


@query(with_views(_HITS + f"""
SELECT count(DISTINCT tender_number) AS n_tenders, count(DISTINCT CASE WHEN {OPEN} THEN tender_number END) AS n_open, count(*) AS n_items,
  (SELECT count(DISTINCT sku) FROM (SELECT unnest(CASE WHEN len(portfolio_product) > 0 THEN portfolio_product ELSE ['(no product matched)'] END) AS sku FROM h)) AS n_skus FROM h"""))
def r12_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.headline(_hits(spark, sf_dir), AS_OF)


@query(with_views(_HITS + f"""
SELECT tender_number, product_name, submission_deadline, item_id, unit, quantity, area, array_to_string(portfolio_product, '; ') AS products, CASE WHEN {OPEN} THEN 'open' ELSE 'closed' END AS state
FROM (SELECT *, row_number() OVER (PARTITION BY tender_number, product_name ORDER BY submission_deadline NULLS FIRST, item_id, unit, quantity) AS n FROM h) WHERE n = 1"""))
def r12_tenders_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.tenders_behind(_hits(spark, sf_dir), AS_OF)


@query(with_views(_HITS + f""", e AS (SELECT *, unnest(CASE WHEN len(portfolio_product) > 0 THEN portfolio_product ELSE ['(no product matched)'] END) AS sku, {OPEN} AS o FROM h)
SELECT sku, count(DISTINCT tender_number) AS n_tenders, sum(quantity) AS quantity, array_to_string(list_sort(list_distinct(list(trim(unit)))), ', ') AS units, count(DISTINCT product_name) AS n_names,
  count(*) FILTER (WHERE o) AS n_open, min(submission_deadline) FILTER (WHERE o) AS next_closing, arg_min(portfolio_principal[1], item_id) FILTER (WHERE len(portfolio_principal) > 0) AS principal FROM e GROUP BY sku"""))
def r12_demand_of_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.demand(_hits(spark, sf_dir), AS_OF)


@query(with_views(""", u AS (SELECT 'product' AS kind, lower(product_name) AS subject, publication_date AS day FROM items i JOIN tenders t ON t.id = i.tender_id
  UNION ALL SELECT 'authority', coalesce(issuing_authority, 'Unknown'), publication_date FROM tenders), d AS (SELECT concat(kind, '|', subject) AS subject, day FROM u WHERE contains(lower(subject), 'an'))""" + _CYCLE + """
, k AS (SELECT string_split(subject, '|')[1] AS kind, string_split(subject, '|')[2] AS subject, cycle_days, expected_next, confidence, concat(n_days, ' days observed') AS basis FROM cycles)
SELECT kind, subject, 'expected_next' AS metric, CAST(expected_next AS VARCHAR) AS value, confidence, basis FROM k
UNION ALL SELECT kind, subject, 'frequency', CASE WHEN cycle_days IS NOT NULL THEN concat(cycle_days, ' days') END, confidence, basis FROM k WHERE kind = 'authority'"""))
def r12_matching_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rhythms of what bears a name; r02 has the other metrics of products."""
    t = tenders(spark, sf_dir).select(F.coalesce("issuing_authority", F.lit("Unknown")).alias("subject"), F.col("publication_date").alias("day"))
    found = planning.matching_forecasts(_histories(spark, sf_dir), t, "AN")
    return found.filter("metric = 'expected_next' or kind = 'authority'")


_SOLD = ", d AS (SELECT concat(lower(product_name), ' for ', issuing_authority) AS subject, publication_date AS day, quantity FROM items i JOIN tenders t ON t.id = i.tender_id)"


@query(with_views(_SOLD + """, n AS (SELECT subject, count(day) AS days, count(*) FILTER (WHERE quantity <> 0) AS quantities, count(DISTINCT year(day)) AS years FROM d GROUP BY subject)
SELECT subject, 'cycle' AS metric, days AS observed, 3 AS needed, concat('cycle: ', days, ' days, 3 needed') AS message FROM n WHERE days < 3
UNION ALL SELECT subject, 'typical_quantity', quantities, 3, concat('typical_quantity: ', quantities, ' quantities, 3 needed') FROM n WHERE quantities < 3
UNION ALL SELECT subject, 'seasonal_pattern', days, 6, concat('seasonal_pattern: ', days, ' days, 6 needed in two years') FROM n WHERE days < 6 OR years < 2"""))
def r02_forecast_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can't be forecast of each product for each authority."""
    t = tenders(spark, sf_dir).select("id", "issuing_authority", F.col("publication_date").alias("day"))
    i = items(spark, sf_dir).select("tender_id", "product_name", "quantity")
    subject = F.concat(F.lower("product_name"), F.lit(" for "), "issuing_authority")
    return forecast.withheld(i.join(t, i.tender_id == t.id).select(subject.alias("subject"), "day", "quantity"))


_PROOF = """, q AS (SELECT lower(product_name) AS subject, tender_number, issuing_authority AS authority, publication_date AS day FROM items i JOIN tenders t ON t.id = i.tender_id),
proof AS (SELECT DISTINCT subject, 'tender' AS kind, tender_number AS value FROM q UNION ALL SELECT DISTINCT subject, 'authority', authority FROM q UNION ALL SELECT DISTINCT subject, 'day', CAST(day AS VARCHAR) FROM q)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tenders(spark, sf_dir).select("id", "tender_number", F.col("issuing_authority").alias("authority"), F.col("publication_date").alias("day"))
    i = items(spark, sf_dir).select("tender_id", F.lower("product_name").alias("subject"))
    return settled(i.join(t, i.tender_id == t.id).select("subject", "tender_number", "authority", "day"), "asked")


@query(with_views(_PROOF + " SELECT * FROM proof WHERE value IS NOT NULL"))
def r04_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.evidence(_asked(spark, sf_dir))


@query(with_views(_HISTORY + _CYCLE + _PROOF + """, z AS (SELECT subject, concat('{"tenders":', count(*) FILTER (WHERE kind = 'tender'), ',"authorities":', count(*) FILTER (WHERE kind = 'authority'), ',"days":', count(*) FILTER (WHERE kind = 'day'),
  ',"first":"', min(value) FILTER (WHERE kind = 'day'), '","last":"', max(value) FILTER (WHERE kind = 'day'), '"}') AS evidence FROM proof GROUP BY subject)
SELECT 'run 1' AS run_id, subject, 'expected_next' AS metric, CAST(expected_next AS VARCHAR) AS value, confidence, evidence FROM cycles JOIN z USING (subject) WHERE expected_next IS NOT NULL
UNION ALL SELECT 'run 1', subject, 'frequency', concat(cycle_days, ' days'), confidence, evidence FROM cycles JOIN z USING (subject) WHERE cycle_days IS NOT NULL"""))
def r04_saved_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rhythms of products with their evidence, as a run saves them."""
    asked = _asked(spark, sf_dir)
    dated = dealt(asked.select("subject", "day"), asked.count(), "subject")
    return forecast.saved(forecast.cycle_forecasts(dated), forecast.evidence(asked), "run 1")


_LISTED = "SELECT p_partkey AS k, concat('Principal ', p_partkey % 13, CASE WHEN p_partkey % 2 = 0 THEN concat(', Principal ', p_partkey % 120) ELSE '' END) AS principals FROM part"


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    more = F.when(k % 2 == 0, F.concat(F.lit(", Principal "), (k % 120).cast("string"))).otherwise("")
    return read(spark, sf_dir, "part").select(k.alias("k"), F.concat(F.lit("Principal "), (k % 13).cast("string"), more).alias("principals"))


@query(f"""WITH l AS ({_LISTED}), s AS (SELECT DISTINCT k, unnest(string_split(principals, ', ')) AS principal FROM l), p AS (SELECT DISTINCT principal FROM s)
SELECT principal, (SELECT count(*) FROM l WHERE contains(l.principals, p.principal)) AS n_inside, (SELECT count(*) FROM s WHERE s.principal = p.principal) AS n_equal FROM p""")
def j15_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of each principal, by its name inside the text of all principals (1 is inside 10, too), and as an element of the list."""
    listed = _listed(spark, sf_dir)
    own = listed.select("k", F.explode(F.array_distinct(F.split("principals", ", "))).alias("principal"))
    inside = contains_join(listed, own, "principals", "principal").join(listed, F.col("text") == F.col("principals")).groupBy("needle").agg(F.count(F.lit(1)).alias("n_inside"))
    equal = own.groupBy("principal").agg(F.count(F.lit(1)).alias("n_equal"))
    return equal.join(inside, F.col("needle") == F.col("principal")).select("principal", "n_inside", "n_equal")


@query("""WITH n AS (SELECT DISTINCT w AS needle FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE length(w) > 0), t AS (SELECT DISTINCT text FROM documents WHERE text <> '')
SELECT needle, count(*) AS n_texts FROM t JOIN n ON contains(text, needle) GROUP BY needle""")
def j15_words_inside_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many distinct texts each word of the benchmark occurs, inside longer words too."""
    words = read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word"))
    return contains_join(read(spark, sf_dir, "documents"), words, "text", "word").groupBy("needle").agg(F.count(F.lit(1)).alias("n_texts"))


@query("""WITH t AS (SELECT DISTINCT p_name AS a, list_sort(string_split(p_name, '')) AS l FROM part WHERE p_name <> ''), c AS (SELECT a, list_transform(l, lambda x, i: concat(x, i - 1 - list_position(l, x))) AS l FROM t)
SELECT x.a, y.a AS b FROM c x, c y WHERE 2 * len(list_intersect(x.l, y.l)) / (length(x.a) + length(y.a)) >= 0.86 AND 2 * least(length(x.a), length(y.a)) / (length(x.a) + length(y.a)) >= 0.86""")
def j08_letter_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names that lengths and shared letters leave to be compared in order."""
    names = read(spark, sf_dir, "part").select(F.lit("part").alias("source"), F.col("p_name").alias("title"))
    return resolve.bounded_pairs(names, names, 0.86).select("a", "b")
