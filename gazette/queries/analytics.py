"""Joins, filters, aggregates, windows, sorts and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gazette.operators import merge, tracker
from gazette.plans.params import ScreenParams
from gazette.queries import query
from gazette.queries.reports import JOINED, OPEN
from gazette.sources import io
from gazette.sources.views import AS_OF, items, read, tenders, with_views

P = ScreenParams()


def _tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.joined(items(spark, sf_dir), tenders(spark, sf_dir), P)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 1000")
def s01_typed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").filter("o_totalprice > 1000").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(with_views("SELECT 'items' AS \"table\", count(*) AS n_rows, 1 AS format FROM items UNION ALL SELECT 'tenders', count(*), 1 FROM tenders"))
def s11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.manifest({"items": items(spark, sf_dir), "tenders": tenders(spark, sf_dir)})


@query(with_views("SELECT tender_number AS \"Number\", left(tender_title, 20) AS \"Title\", CASE WHEN is_oncology THEN 'Yes' ELSE 'No' END AS \"Oncology\", coalesce(therapeutic_area, 'Not Available') AS \"Area\" FROM tenders"))
def s15_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.projection(tenders(spark, sf_dir), {"Number": "tender_number", "Title": "tender_title", "Oncology": "is_oncology", "Area": "therapeutic_area", "Total": ""}, required=("Area",), most=20)


@query(with_views(JOINED + " SELECT item_id FROM j WHERE is_oncology AND priority = 'High' AND needs_review AND search_code = 'ON' AND coalesce(generic_name, product_name) IS NOT NULL"))
def p01_equality_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracker(spark, sf_dir).filter("is_oncology and priority = 'High' and needs_review and search_code = 'ON' and coalesce(generic_name, product_name) is not null").select("item_id")


@query(with_views(JOINED + """ SELECT 'all' AS kind, count(*) AS n FROM j UNION ALL SELECT 'portfolio', count(*) FROM j WHERE len(portfolio_product) > 0 UNION ALL SELECT 'registry-only', count(*) FROM j WHERE len(registered_products) > 0 AND len(portfolio_product) = 0
UNION ALL SELECT 'none', count(*) FROM j WHERE len(registered_products) = 0 AND len(portfolio_product) = 0 UNION ALL SELECT 'review', count(*) FROM j WHERE needs_review"""))
def p02_match_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("all", "portfolio", "registry-only", "none", "review")
    counts = _tracker(spark, sf_dir).agg(*(F.count_if(tracker.status(k)).alias(f"n{i}") for i, k in enumerate(kinds)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"n{i}").alias("n")) for i, k in enumerate(kinds)))).alias("x")).select("x.*")


@query(with_views(JOINED + " SELECT DISTINCT area AS value, 'area' AS option FROM j UNION ALL SELECT DISTINCT unnest(portfolio_principal), 'principal' FROM j"))
def p08_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tracker(spark, sf_dir)
    areas = t.select(F.col("area").alias("value")).distinct().withColumn("option", F.lit("area"))
    return areas.unionByName(t.select(F.explode("portfolio_principal").alias("value")).distinct().withColumn("option", F.lit("principal"))).orderBy("option", "value")


@query("SELECT CASE WHEN quality IS NULL THEN 'no label' WHEN quality = 0 THEN 'rejected' ELSE 'good' END AS verdict, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def p09_quarantine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    reason = F.when(F.col("quality").isNull(), "no label").when(F.col("quality") == 0, "rejected")
    return d.withColumn("reason", reason).groupBy(F.coalesce("reason", F.lit("good")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(with_views("SELECT t.id, i.item_id FROM tenders t LEFT JOIN (SELECT * FROM items WHERE quantity > 45) i ON t.id = i.tender_id"))
def j02_left_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.joined(items(spark, sf_dir).filter("quantity > 45"), tenders(spark, sf_dir), P, "left").select("id", "item_id")


@query(with_views("SELECT t.id, d.doc_id FROM tenders t LEFT JOIN (SELECT doc_id % 500 AS k, min(doc_id) AS doc_id FROM documents GROUP BY 1) d ON t.id = d.k"))
def j03_first_row_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 500).alias("k")).agg(F.min("doc_id").alias("doc_id"))
    t = tenders(spark, sf_dir).select("id")
    return t.join(d, t.id == d.k, "left").select("id", "doc_id")


@query(with_views(", l AS (SELECT concat('K', id % 40) AS k, arg_max(tender_title, id) AS title, max(id) AS last FROM tenders GROUP BY 1) SELECT t.id, l.title, l.last FROM tenders t JOIN l ON concat('K', t.id % 40) = l.k"))
def j04_dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tenders(spark, sf_dir).withColumn("k", F.concat(F.lit("K"), (F.col("id") % 40).cast("string")))
    last = t.groupBy("k").agg(F.max_by(F.struct(F.col("tender_title").alias("title"), F.col("id").alias("last")), "id").alias("x")).select("k", "x.*")
    return t.join(last, "k").select("id", "title", "last")


@query(with_views("SELECT id, 'semi' AS kind FROM tenders WHERE id IN (SELECT tender_id FROM items WHERE needs_review) UNION ALL SELECT id, 'anti' FROM tenders WHERE id NOT IN (SELECT tender_id FROM items WHERE needs_review)"))
def j16_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, i = tenders(spark, sf_dir).select("id"), items(spark, sf_dir).filter("needs_review")
    on = t.id == i.tender_id
    return t.join(i, on, "left_semi").withColumn("kind", F.lit("semi")).unionByName(t.join(i, on, "left_anti").withColumn("kind", F.lit("anti")))


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) FROM events)")
def r13_new_in_last_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    last = e.agg(F.max(F.to_date("ts")).alias("started"))  # one row
    return e.join(F.broadcast(last), F.to_date("ts") >= F.col("started")).select("event_id")


@query("SELECT event_id, ts, event_type FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts DESC, event_id DESC LIMIT 40")
def r14_run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = e.agg(F.min("event_type").alias("kind"))
    return e.join(F.broadcast(kind), F.col("event_type") == F.col("kind")).orderBy(F.desc("ts"), F.desc("event_id")).limit(40).select("event_id", "ts", "event_type")


@query("SELECT CAST(ts AS DATE) AS run, count(*) AS listings, count(DISTINCT user_id) AS sources, count(*) FILTER (WHERE value > 50) AS updated FROM events GROUP BY 1")
def a11_run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("run")).agg(F.count(F.lit(1)).alias("listings"), F.count_distinct("user_id").alias("sources"), F.count_if(F.col("value") > 50).alias("updated"))


@query(with_views("SELECT (SELECT count(*) FROM tenders) AS n_tenders, (SELECT count(*) FROM items) AS n_items, (SELECT count(*) FROM tenders WHERE is_oncology) AS n_oncology, (SELECT count(*) FROM tenders WHERE priority = 'High') AS n_high, (SELECT count(*) FROM tenders WHERE needs_review) AS n_review"))
def a01_global_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tenders(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_tenders"), F.count_if("is_oncology").alias("n_oncology"), F.count_if(F.col("priority") == "High").alias("n_high"), F.count_if("needs_review").alias("n_review"))
    return t.join(items(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_items")), F.lit(True))


@query(with_views(JOINED + f" SELECT area, count(*) FILTER (WHERE len(portfolio_product) > 0) AS n_portfolio, count(*) FILTER (WHERE {OPEN}) AS n_open, count(DISTINCT tender_number) AS n_tenders FROM j GROUP BY area"))
def a02_conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = F.coalesce(F.col("submission_deadline") >= F.to_date(F.lit(AS_OF)), F.lit(False))
    return _tracker(spark, sf_dir).groupBy("area").agg(F.count_if(F.size("portfolio_product") > 0).alias("n_portfolio"), F.count_if(open_).alias("n_open"), F.count_distinct(F.coalesce("tender_number", F.lit(""))).alias("n_tenders"))


@query("SELECT p_brand AS company, count(*) AS n FROM part GROUP BY 1")
def a09_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("company")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "company")


@query(with_views("SELECT issuing_authority, array_to_string(list_sort(list_distinct(list(department))), ';') AS departments, min(publication_date) AS first_day, max(publication_date) AS last_day, count(DISTINCT year(publication_date)) AS n_years, median(estimated_value) AS typical FROM tenders GROUP BY 1"))
def a15_ranges_and_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tenders(spark, sf_dir).groupBy("issuing_authority").agg(
        F.array_join(F.sort_array(F.collect_set("department")), ";").alias("departments"), F.min("publication_date").alias("first_day"), F.max("publication_date").alias("last_day"),
        F.count_distinct(F.year("publication_date")).alias("n_years"), F.median("estimated_value").alias("typical"),
    )


@query("SELECT lower(p_brand) AS key, arg_min(p_brand, p_partkey) AS manufacturer FROM part WHERE length(p_brand) BETWEEN 3 AND 120 GROUP BY 1")
def a19_maker_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").filter(F.length("p_brand").between(3, 120))
    return p.groupBy(F.lower("p_brand").alias("key")).agg(F.min_by("p_brand", "p_partkey").alias("manufacturer"))


@query(with_views("SELECT tender_id, item_id, n FROM (SELECT tender_id, item_id, row_number() OVER (PARTITION BY tender_id ORDER BY unit_price DESC, item_id) AS n FROM items) WHERE n <= 2"))
def w02_rank_and_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("tender_id").orderBy(F.desc("unit_price"), "item_id")).cast("long")
    return items(spark, sf_dir).withColumn("n", n).filter("n <= 2").select("tender_id", "item_id", "n")


@query(with_views(", c AS (SELECT tender_id, item_id, coalesce(sum(quantity) OVER (PARTITION BY tender_id ORDER BY item_no, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM items) SELECT tender_id, item_id FROM c WHERE before < 24"))
def w08_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.coalesce(F.sum("quantity").over(Window.partitionBy("tender_id").orderBy("item_no", "item_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return items(spark, sf_dir).withColumn("before", before).filter("before < 24").select("tender_id", "item_id")


@query(with_views("SELECT id, priority_score FROM tenders ORDER BY priority_score DESC, submission_deadline ASC NULLS FIRST, id LIMIT 300"))
def l02_top_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tenders(spark, sf_dir).orderBy(F.desc("priority_score"), F.asc_nulls_first("submission_deadline"), "id").limit(300).select("id", "priority_score")


@query(with_views(JOINED + " SELECT item_id FROM j ORDER BY submission_deadline NULLS LAST, tender_number, item_id LIMIT 800"))
def l01_tracker_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.ordered(_tracker(spark, sf_dir)).limit(800).select("item_id")


@query("SELECT 'drug' AS source, p_partkey FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'food', p_partkey FROM part WHERE p_partkey % 3 = 0")
def u01_union_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey")
    return p.filter("p_partkey % 2 = 0").withColumn("source", F.lit("drug")).unionByName(p.filter("p_partkey % 3 = 0").withColumn("source", F.lit("food")))


@query("SELECT p_partkey AS link FROM part EXCEPT SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49")
def u04_new_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, known = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("link")), read(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("link"))
    return merge.unknown(links, known, "link")


@query(with_views("SELECT 'product' AS subject_type, count(DISTINCT generic_name) AS n FROM items UNION ALL SELECT 'authority', count(DISTINCT issuing_authority) FROM tenders"))
def u05_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = items(spark, sf_dir).agg(F.count_distinct("generic_name").alias("n")).withColumn("subject_type", F.lit("product"))
    return a.unionByName(tenders(spark, sf_dir).agg(F.count_distinct("issuing_authority").alias("n")).withColumn("subject_type", F.lit("authority")))


@query("SELECT DISTINCT n_name AS department, r_name AS search_code, concat(n_name, '/', r_name) AS lineage FROM nation, region")
def u02_department_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = read(spark, sf_dir, "nation").select(F.col("n_name").alias("department")), read(spark, sf_dir, "region").select(F.col("r_name").alias("search_code"))
    return n.crossJoin(F.broadcast(r)).withColumn("lineage", F.concat_ws("/", "department", "search_code"))  # two configured lists, not tables of data


@query(with_views("""
, i AS (SELECT tender_id, count(*) AS n_items, min(item_id) AS first_item FROM items GROUP BY 1), d AS (SELECT doc_id % 500 AS tender_id, count(*) AS n_documents FROM documents GROUP BY 1)
SELECT t.id, coalesce(n_items, 0) AS n_items, first_item, coalesce(n_documents, 0) AS n_documents FROM tenders t LEFT JOIN i ON t.id = i.tender_id LEFT JOIN d ON t.id = d.tender_id"""))
def m15_detail_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select((F.col("doc_id") % 500).alias("tender_id"), "doc_id", F.length("text").alias("n"))
    none = items(spark, sf_dir).select("tender_id", "item_no").limit(0)
    out = tracker.detail(tenders(spark, sf_dir).select("id"), items(spark, sf_dir).select("tender_id", "item_id", "quantity"), none, d)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return out.select("id", F.greatest(size("items"), F.lit(0)).alias("n_items"), F.array_min(F.transform("items", lambda x: x["item_id"])).alias("first_item"), F.greatest(size("documents"), F.lit(0)).alias("n_documents"))
