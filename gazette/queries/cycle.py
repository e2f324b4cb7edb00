"""Identity, history and the screening cycle over the driver's tables: orders of today against a perturbed yesterday."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.operators import merge, resolve
from gazette.plans.params import ScreenParams
from gazette.queries import query
from gazette.sources.views import items, read, tenders, with_views

P = ScreenParams()
_KEPT = "id, tender_number, tender_title, issuing_authority, publication_date, submission_deadline, estimated_value, priority"
OLD = f", old AS (SELECT {_KEPT}, estimated_value + CASE WHEN id % 11 = 0 THEN 10 ELSE 0 END AS before FROM tenders WHERE id % 13 <> 0)"


def old_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yesterday: some notices missing, some with other values, priorities and deadlines."""
    k = F.col("id")
    out = tenders(spark, sf_dir).filter(k % 13 != 0)
    out = out.withColumn("estimated_value", F.when(k % 11 == 0, F.col("estimated_value") + 10).otherwise(F.col("estimated_value"))).withColumn("priority", F.when(k % 22 == 0, "Other").otherwise(F.col("priority")))
    return out.withColumn("submission_deadline", F.when(k % 33 == 0, F.date_add("submission_deadline", -7)).otherwise(F.col("submission_deadline")))


OLD_SQL = f""", old AS (SELECT id, tender_number, tender_title, issuing_authority, source, tender_page_url, CASE WHEN id % 11 = 0 THEN estimated_value + 10 ELSE estimated_value END AS estimated_value,
  CASE WHEN id % 22 = 0 THEN 'Other' ELSE priority END AS priority, CASE WHEN id % 33 = 0 THEN submission_deadline - 7 ELSE submission_deadline END AS submission_deadline FROM tenders WHERE id % 13 <> 0)"""
_FIELDS = ("estimated_value", "priority", "submission_deadline")


@query(with_views(OLD_SQL + """
SELECT id, CASE WHEN n.id % 7 = 0 THEN o.estimated_value ELSE n.estimated_value END AS estimated_value, n.priority, coalesce(n.submission_deadline, o.submission_deadline) AS submission_deadline FROM tenders n LEFT JOIN old o USING (id)
WHERE o.id IS NOT NULL OR n.id % 13 = 0""").replace("CASE WHEN n.id % 7 = 0 THEN o.estimated_value ELSE n.estimated_value END", "CASE WHEN n.id % 7 = 0 AND o.id IS NOT NULL THEN o.estimated_value WHEN n.id % 7 = 0 THEN NULL ELSE n.estimated_value END"))
def m03_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = tenders(spark, sf_dir).withColumn("estimated_value", F.when(F.col("id") % 7 != 0, F.col("estimated_value")))
    return merge.upsert(old_state(spark, sf_dir), new).select("id", *_FIELDS)


@query(with_views(OLD_SQL + """
SELECT id AS tender_id, 'estimated_value' AS field, true AS differs FROM tenders n JOIN old o USING (id) WHERE n.estimated_value <> o.estimated_value
UNION ALL SELECT id, 'priority', true FROM tenders n JOIN old o USING (id) WHERE n.priority <> o.priority
UNION ALL SELECT id, 'submission_deadline', true FROM tenders n JOIN old o USING (id) WHERE n.submission_deadline IS DISTINCT FROM o.submission_deadline AND n.submission_deadline IS NOT NULL"""))
def m04_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = merge.change_feed(old_state(spark, sf_dir), tenders(spark, sf_dir))
    return feed.select("tender_id", "field", (F.col("old_value") != F.col("new_value")).alias("differs"))


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("content_hash", F.sha1(F.concat_ws("|", F.col("estimated_value").cast("decimal(18,2)").cast("string"), "priority", F.col("submission_deadline").cast("string"))))


@query(with_views(OLD_SQL + """
, b AS (SELECT n.id, n.estimated_value IS DISTINCT FROM o.estimated_value OR n.priority <> o.priority OR n.submission_deadline IS DISTINCT FROM o.submission_deadline AS moved FROM tenders n JOIN old o USING (id))
SELECT count(*) FILTER (WHERE moved) AS n_changed, count(*) FILTER (WHERE NOT moved) AS n_unchanged FROM b"""))
def m02_change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _hashed(tenders(spark, sf_dir)).withColumnRenamed("id", "tender_id")
    moved, same = merge.changed(new, _hashed(old_state(spark, sf_dir)))
    both = moved.select(F.lit(True).alias("moved")).unionByName(same.select(F.lit(False).alias("moved")))
    return both.agg(F.count_if("moved").alias("n_changed"), F.count_if(~F.col("moved")).alias("n_unchanged"))


def _new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings: a third without number, with their URL in other spelling; a tenth with a URL that nobody knows."""
    k = F.col("id")
    url = F.when(k % 10 == 9, F.concat(F.lit("https://elsewhere/"), k.cast("string"))).otherwise(F.concat(F.upper(F.regexp_replace("tender_page_url", r"\?.*", "")), F.lit("?timestamp=9")))
    number = F.when(k % 3 != 0, F.lower(F.replace("tender_number", F.lit("/"), F.lit("-"))))
    return tenders(spark, sf_dir).withColumnRenamed("id", "row_id").withColumn("id", F.col("row_id")).select("row_id", "source", number.alias("tender_number"), "tender_title", "issuing_authority", "submission_deadline", url.alias("tender_page_url"))


@query(with_views(OLD_SQL + "SELECT id AS row_id, id AS tender_id FROM tenders WHERE id % 3 <> 0 AND id % 13 <> 0"))
def j05_number_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = resolve.prepared(_new(spark, sf_dir), "row_id", False), resolve.prepared(old_state(spark, sf_dir), "id", False)
    return resolve.by_number(new, old)


@query(with_views(OLD_SQL + "SELECT id AS row_id, id AS tender_id FROM tenders WHERE id % 10 <> 9 AND id % 13 <> 0"))
def j06_url_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = resolve.prepared(_new(spark, sf_dir), "row_id", False), resolve.prepared(old_state(spark, sf_dir), "id", False)
    return resolve.by_url(new, old)


@query(with_views("""
, t AS (SELECT DISTINCT lower(tender_title) AS t FROM tenders) SELECT a.t AS a, b.t AS b FROM t a, t b WHERE 2 * least(length(a.t), length(b.t)) / (length(a.t) + length(b.t)) >= 0.66"""))
def j08_fuzzy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = resolve.prepared(tenders(spark, sf_dir).withColumn("row_id", F.col("id")), "row_id", False)
    return resolve.candidates(t, t.withColumnRenamed("row_id", "id"), P).select("a", "b")


@query()
def j07_layered_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, URL, then title similarity with authority and deadline; tests hold it against a loop."""
    return resolve.resolve(_new(spark, sf_dir), old_state(spark, sf_dir), P, normalise=False)


@query(with_views(", new AS (SELECT tender_id, item_id FROM items WHERE tender_id % 4 = 0 AND quantity > 25), old AS (SELECT tender_id, item_id FROM items WHERE quantity <= 25) SELECT * FROM new UNION ALL SELECT * FROM old WHERE tender_id NOT IN (SELECT tender_id FROM new)"))
def m05_replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).select("tender_id", "item_id", "quantity")
    return merge.replace_children(i.filter("quantity <= 25"), i.filter("tender_id % 4 = 0 and quantity > 25")).drop("quantity")


@query("SELECT doc_id % 50 AS tender_id, sha256(text) AS sha256, count(*) > 0 AS there FROM documents GROUP BY ALL")
def m06_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("tender_id"), F.sha2("text", 256).alias("sha256"), "doc_id")
    old = d.filter("doc_id % 2 = 0").dropDuplicates(["tender_id", "sha256"])
    return merge.insert_ignore(old, d).select("tender_id", "sha256", F.lit(True).alias("there"))


APPROVED = ", ok AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)"


@query(with_views(APPROVED + """
, done AS (SELECT item_id, tender_id, needs_review AND tender_id NOT IN (SELECT doc_id FROM ok) AS needs_review, tender_id IN (SELECT doc_id FROM ok) AS touched FROM items),
clear AS (SELECT tender_id FROM done GROUP BY tender_id HAVING bool_or(touched) AND NOT bool_or(needs_review))
SELECT id, needs_review AND id NOT IN (SELECT doc_id * 5 FROM ok) AND id NOT IN (SELECT tender_id FROM clear) AS needs_review FROM tenders"""))
def m07_approve(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    i = items(spark, sf_dir)
    approved = i.join(ok, i.tender_id == ok.doc_id, "left_semi").select("item_id")
    out, _ = merge.approve(tenders(spark, sf_dir), i, ok.select((F.col("doc_id") * 5).alias("id")), approved)
    return out.select("id", "needs_review")


@query(with_views("""
, few AS (SELECT * FROM items WHERE tender_id % 3 <> 0)
SELECT tender_id, item_id, product_name FROM few UNION ALL SELECT id, NULL, tender_title FROM tenders WHERE id NOT IN (SELECT tender_id FROM few)"""))
def m08_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.with_placeholders(tenders(spark, sf_dir), items(spark, sf_dir).filter("tender_id % 3 <> 0")).select("tender_id", "item_id", "product_name")


@query(with_views("""
SELECT tender_id, count(*) AS n FROM (SELECT DISTINCT tender_id, regexp_replace(lower(generic_name), '[^a-z0-9]', '', 'g'), lower(trim(unit)), quantity FROM items) GROUP BY tender_id"""))
def m09_distinct_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).withColumn("product_name", F.col("generic_name"))
    return merge.distinct_items(i).groupBy("tender_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def m01_screening_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cycle of today's notices over yesterday's state: its metrics. The three-cycle test checks every output."""
    from gazette.plans.cycle import STATE, screen
    from gazette.queries.matching import aliases, portfolio, registry

    line = F.struct(F.col("item_no").cast("int").alias("item_no"), "product_name", F.trim("unit").alias("unit"), F.col("quantity").cast("double").alias("quantity"))
    lists = items(spark, sf_dir).groupBy("tender_id").agg(F.sort_array(F.collect_list(line)).alias("items"))
    new = _new(spark, sf_dir).join(tenders(spark, sf_dir).select(F.col("id").alias("row_id"), "department", "publication_date", "estimated_value", "search_code"), "row_id")
    new = new.join(lists, new.row_id == lists.tender_id, "left").drop("tender_id").withColumn("source_url", F.lit(None).cast("string")).withColumn("description", F.lit(None).cast("string"))
    old = old_state(spark, sf_dir)
    state = spark.createDataFrame([], STATE).unionByName(old, allowMissingColumns=True)
    state = state.select(*spark.createDataFrame([], STATE).columns)
    return screen(new, state, None, registry(spark, sf_dir), portfolio(spark, sf_dir), aliases(spark, sf_dir), P, "run-1", "2026-01-01 00:00:00").metrics.drop("finished_at")


SECOND = "https://second.example/"
#: One to four listings of each order: A repeats the order's number; B does so again, from another page; C is of that page, without number; D
#: repeats C. E has the page of yesterday's notice, in other spelling.
ARRIVALS_SQL = OLD_SQL + f""", spelled AS (SELECT *, CASE WHEN id % 3 <> 0 THEN lower(replace(tender_number, '/', '-')) ELSE tender_number END AS asked, concat('{SECOND}', id) AS second FROM tenders)"""


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Today's listings, see ARRIVALS_SQL."""
    k = F.col("id")
    t = tenders(spark, sf_dir).withColumn("second", F.concat(F.lit(SECOND), k.cast("string")))
    number = F.when(k % 3 != 0, F.lower(F.replace("tender_number", F.lit("/"), F.lit("-")))).otherwise(F.col("tender_number"))
    line = F.struct(F.col("item_no").cast("int").alias("item_no"), "product_name", F.trim("unit").alias("unit"), F.col("quantity").cast("double").alias("quantity"))
    lists = items(spark, sf_dir).filter("tender_id % 3 = 1").groupBy(F.col("tender_id").alias("id")).agg(F.sort_array(F.collect_list(line)).alias("items"))
    a = t.join(lists, "id", "left").withColumn("row_id", k * 4).withColumn("tender_number", number)
    b = a.filter(k % 4 == 0).withColumn("row_id", k * 4 + 1).withColumn("tender_number", F.replace("tender_number", F.lit("-"), F.lit(" "))).withColumn("tender_page_url", F.col("second"))
    bare = {c: F.lit(None).cast(a.schema[c].dataType) for c in ("tender_number", "tender_title", "publication_date", "submission_deadline", "estimated_value", "items")}
    c = b.withColumns(bare).withColumn("row_id", k * 4 + 2)
    d = c.filter(k % 8 == 0).withColumn("row_id", k * 4 + 3)
    e = t.filter((k % 8 == 4) & (k % 13 != 0)).withColumn("items", F.lit(None).cast(a.schema["items"].dataType)).withColumns({x: v for x, v in bare.items() if x != "items"}).withColumn("row_id", k * 4 + 3)
    e = e.withColumn("tender_page_url", F.concat(F.upper(F.regexp_replace("tender_page_url", r"\?.*", "")), F.lit("?timestamp=9")))
    every = a.unionByName(b).unionByName(c).unionByName(d).unionByName(e).withColumn("source_url", F.lit(None).cast("string")).withColumn("description", F.lit("medicine"))
    return every.select("row_id", "source", "tender_number", "tender_title", "issuing_authority", "department", "publication_date", "submission_deadline", "tender_page_url", "source_url", "description", "estimated_value", "search_code", "items")


def _cycle(spark: SparkSession, sf_dir: str):
    """Today's listings, of which many are of one notice, over yesterday's state."""
    from gazette.plans.cycle import STATE, screen
    from gazette.queries.matching import aliases, portfolio, registry

    empty = spark.createDataFrame([], STATE)
    state = empty.unionByName(old_state(spark, sf_dir), allowMissingColumns=True).select(*empty.columns)
    return screen(_arrivals(spark, sf_dir), state, None, registry(spark, sf_dir), portfolio(spark, sf_dir), aliases(spark, sf_dir), P, "run-1", "2026-01-01 00:00:00", normalise=False)


@query(with_views(ARRIVALS_SQL + """
SELECT id * 4 AS row_id, CASE WHEN id % 13 <> 0 THEN 'match' ELSE 'new' END AS action, CASE WHEN id % 13 <> 0 THEN id END AS tender_id, NULL::BIGINT AS root, CASE WHEN id % 13 <> 0 THEN 'number' ELSE 'none' END AS tier FROM spelled
UNION ALL SELECT id * 4 + 1, CASE WHEN id % 13 <> 0 THEN 'match' ELSE 'duplicate' END, CASE WHEN id % 13 <> 0 THEN id END, CASE WHEN id % 13 = 0 THEN id * 4 END, 'number' FROM spelled WHERE id % 4 = 0
UNION ALL SELECT id * 4 + 2, 'new', NULL, NULL, 'none' FROM spelled WHERE id % 4 = 0
UNION ALL SELECT id * 4 + 3, 'duplicate', NULL, id * 4 + 2, 'url' FROM spelled WHERE id % 8 = 0
UNION ALL SELECT id * 4 + 3, 'match', id, NULL, 'url' FROM spelled WHERE id % 8 = 4 AND id % 13 <> 0"""))
def m01_batch_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each listing of a batch is, against the history and the listings before it."""
    from gazette.operators.batch import settle_batch

    new = _arrivals(spark, sf_dir)
    found = resolve.resolve(new, old_state(spark, sf_dir), P, normalise=False)
    return settle_batch(new, found, new.select("row_id", F.lit(True).alias("enters")), P, normalise=False).select("row_id", "action", "tender_id", "root", "tier")


@query(with_views(ARRIVALS_SQL + """
SELECT n.tender_number, n.tender_title, n.submission_deadline, n.estimated_value, n.tender_page_url, 'Low' AS priority, 'Other Pharmaceutical' AS therapeutic_area FROM spelled n WHERE id % 13 <> 0
UNION ALL SELECT asked, tender_title, submission_deadline, estimated_value, tender_page_url, 'Low', 'Other Pharmaceutical' FROM spelled WHERE id % 13 = 0
UNION ALL SELECT NULL, NULL, NULL, NULL, second, 'Low', 'Other Pharmaceutical' FROM spelled WHERE id % 4 = 0"""))
def m01_tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cycle(spark, sf_dir).tenders.select("tender_number", "tender_title", "submission_deadline", "estimated_value", "tender_page_url", "priority", "therapeutic_area")


@query(with_views(ARRIVALS_SQL + """
SELECT id AS tender_id, 'estimated_value' AS field FROM spelled WHERE id % 13 <> 0 AND id % 11 = 0
UNION ALL SELECT id, 'priority' FROM old WHERE priority <> 'Low'
UNION ALL SELECT id, 'submission_deadline' FROM spelled WHERE id % 13 <> 0 AND id % 33 = 0 AND submission_deadline IS NOT NULL
UNION ALL SELECT id, 'therapeutic_area' FROM spelled WHERE id % 13 <> 0 AND id % 3 <> 0"""))
def m01_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cycle(spark, sf_dir).changes.select("tender_id", "field")


@query(with_views(ARRIVALS_SQL + """
, kept AS (SELECT id, CASE WHEN id % 13 <> 0 THEN tender_number ELSE asked END AS tender, tender_title FROM spelled),
few AS (SELECT DISTINCT tender_id, product_name, trim(unit) AS unit, quantity FROM items WHERE tender_id % 3 = 1)
SELECT tender, product_name, unit, quantity FROM kept JOIN few ON id = tender_id
UNION ALL SELECT tender, tender_title, NULL, NULL FROM kept WHERE id NOT IN (SELECT tender_id FROM few) UNION ALL SELECT second, NULL, NULL, NULL FROM spelled WHERE id % 4 = 0"""))
def m01_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _cycle(spark, sf_dir)
    named = out.tenders.select(F.col("id").alias("tender_id"), F.coalesce("tender_number", "tender_page_url").alias("tender"))
    return out.items.join(named, "tender_id").select("tender", "product_name", "unit", "quantity")


_DAY = "CASE WHEN o_orderkey % 10 = 3 THEN 'soon' WHEN o_orderkey % 10 = 4 THEN '31/02/2026' WHEN o_orderkey % 10 = 5 THEN '' ELSE strftime(o_orderdate, '%d/%m/%Y') END"
_VALUE = "CASE WHEN o_orderkey % 7 = 2 THEN 'on request' ELSE concat('KD ', o_totalprice) END"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a portal would list them, some with days and amounts that can't be read, some without any name."""
    from gazette.operators.intake import RAW

    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    named = k % 21 != 8
    day = F.when(k % 10 == 3, "soon").when(k % 10 == 4, "31/02/2026").when(k % 10 == 5, "").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    value = F.when(k % 7 == 2, "on request").otherwise(F.concat(F.lit("KD "), F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
    count = F.when(k % 6 == 1, "many").otherwise("1,500 vials")
    line = F.array(F.struct(F.lit(1).alias("item_no"), F.lit("Carboplatin").alias("product_name"), count.alias("quantity")), F.struct(F.lit(2).alias("item_no"), F.when(k % 9 != 4, "Imatinib").alias("product_name"), F.lit("3 boxes").alias("quantity")))
    cells = F.create_map(F.lit("Remark"), F.when(k % 8 == 1, "leukaemia ward").otherwise("none"))
    own = {"row_id": k, "source": F.lit("portal"), "tender_number": F.when(named, F.concat(F.lit("R/"), k.cast("string"))), "tender_title": F.when(named, F.lit("Supplies of the year")), "submission_deadline": day, "estimated_value": value, "items": line, "raw_row": cells}
    empty = spark.createDataFrame([], RAW)
    return o.select(*(own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema))


@query(f"""
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 21 <> 8 THEN concat('R/', o_orderkey) ELSE concat('row ', o_orderkey) END AS target, {_DAY} AS day, o_orderkey % 7 = 2 AS no_value FROM orders)
SELECT 'parse' AS stage, target, concat('submission_deadline: ', day) AS message FROM r WHERE o_orderkey % 10 IN (3, 4) UNION ALL SELECT 'parse', target, 'estimated_value: on request' FROM r WHERE no_value
UNION ALL SELECT 'listing', target, 'row: neither number, title nor URL' FROM r WHERE o_orderkey % 21 = 8 UNION ALL SELECT 'items', target, 'quantity: item 1, many' FROM r WHERE o_orderkey % 6 = 1
UNION ALL SELECT 'items', target, 'product_name: item 2, 3 boxes' FROM r WHERE o_orderkey % 9 = 4""")
def m12_intake_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazette.operators.intake import read_listings

    return read_listings(_raw(spark, sf_dir))[1]


@query(f"""
SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 10 NOT IN (3, 4, 5) THEN CAST(o_orderdate AS DATE) END AS submission_deadline, CASE WHEN o_orderkey % 7 <> 2 THEN CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) END AS estimated_value,
  CASE WHEN o_orderkey % 9 = 4 THEN 1 ELSE 2 END AS n_items, CASE WHEN o_orderkey % 6 <> 1 THEN 1500.0 ELSE 0.0 END + CASE WHEN o_orderkey % 9 = 4 THEN 0.0 ELSE 3.0 END AS quantity FROM orders WHERE o_orderkey % 21 <> 8""")
def m12_intake_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazette.operators.intake import read_listings

    listings, _ = read_listings(_raw(spark, sf_dir))
    total = F.aggregate("items", F.lit(0.0), lambda acc, x: acc + F.coalesce(x["quantity"], F.lit(0.0)))
    return listings.select("row_id", "submission_deadline", "estimated_value", F.size("items").alias("n_items"), total.alias("quantity"))


@query("""
SELECT o_orderkey AS row_id, concat_ws(chr(32) || chr(10), 'Supplies of the year', CASE WHEN o_orderkey % 9 = 4 THEN 'Carboplatin' ELSE 'Carboplatin Imatinib' END, CASE WHEN o_orderkey % 8 = 1 THEN 'leukaemia ward' ELSE 'none' END) AS text FROM orders WHERE o_orderkey % 21 <> 8""")
def f33_classification_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the classifier reads of a listing, the cells of its raw row among it."""
    from gazette.operators.intake import read_listings
    from gazette.plans.cycle import with_text

    return with_text(read_listings(_raw(spark, sf_dir))[0]).select("row_id", "text")


@query(with_views("SELECT 'run-1' AS run_id, 'completed' AS status, count(*) + 2 * count(*) FILTER (WHERE id % 4 = 0) + count(*) FILTER (WHERE id % 8 = 0 OR id % 8 = 4 AND id % 13 <> 0) AS listings_reviewed, count(*) FILTER (WHERE id % 13 = 0) + count(*) FILTER (WHERE id % 4 = 0) AS new_tenders, count(*) FILTER (WHERE id % 13 <> 0) AS updated_tenders, count(*) FILTER (WHERE id % 4 = 0) + count(*) FILTER (WHERE id % 8 = 0 OR id % 8 = 4 AND id % 13 <> 0) AS duplicates_skipped, 0 AS errors FROM tenders"))
def m11_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's row of the log, as it is read back after it was appended twice."""
    from gazette.sources.io import append_run
    from gazette.sources.settled import settled

    run = settled(_cycle(spark, sf_dir).run, "run")
    log = run.inputFiles()[0].rsplit("/", 1)[0] + "-log"
    append_run(run, log)
    append_run(run, log)
    return spark.read.parquet(log).select(*(c for c in ("run_id", "status", "listings_reviewed", "new_tenders", "updated_tenders", "duplicates_skipped", "errors")))
