"""Quality rules at host level, in DataFrame functions only.

Each document has base counts and a base verdict. Failures are added up for each host (``source``); each host's failure rate is shrunk
towards a beta prior fitted to all hosts (empirical Bayes, method of moments), so that a host of a few documents isn't judged by chance;
hosts whose shrunk rate is above ``HOST_LIMIT`` are rejected, and the verdict is joined back to their documents.

Words in repeated three-word windows are found within the row: windows are hashed (64 bits), sorted with their positions, and
compared with their neighbours.

Cases: a null text has no words and fails; a null host is a host of its own; repeated rows are each counted; one host alone, or hosts
that all fail alike, give a prior as strong as ``MOST``; an empty table gives no rows; columns other than id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.common import stored, table

LEAST_WORDS = 50
REPEAT_PERCENT = 50
HOST_LIMIT = 0.5
#: Bounds of the prior's strength, in documents.
LEAST, MOST = 1.0, 10_000.0
_SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Number of words inside three-word windows that occur twice or more."""
    windows = lambda w: F.when(
        F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    ).otherwise(F.array().cast("array<struct<h: bigint, i: int>>"))
    twice = lambda s: F.filter(s, lambda x, k: F.coalesce((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), F.get(s, k - 1)["h"] == x["h"], F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    covered = lambda s: F.size(F.array_distinct(F.flatten(F.transform(twice(s), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return _let(words, lambda w: _let(F.sort_array(windows(w)), covered))


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = lambda t: F.filter(F.split(t, _SPACE), lambda x: x != "")
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = _let(
        text,
        lambda t: F.struct(
            F.char_length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.char_length(t) - F.char_length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            _let(lines(t), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("again"))).alias("w"),
        ),
    )
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), counts.alias("c"))
    out = out.select("doc_id", "host", F.col("c.w.n").alias("n_words"), "c.word_chars", "c.n_symbols", "c.n_dup_lines", F.col("c.w.again").alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def host_rates(base: DataFrame) -> DataFrame:
    """host, n, failed and rate, the failure rate shrunk towards the beta prior of all hosts."""
    hosts = base.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("failed"))
    share = F.col("failed") / F.col("n")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("n") * share * share).alias("squares"), F.sum(F.col("n") * F.col("n")).cast("double").alias("weights")).first()
    alpha = beta = 0.5
    if total["hosts"]:
        n, mean = total["n"], total["failed"] / total["n"]
        # Variance between hosts: what they show beyond binomial noise.
        shown = max(total["squares"] - n * mean * mean, 0.0)
        spread = n - total["weights"] / n
        between = (shown - (total["hosts"] - 1) * mean * (1 - mean)) / spread if spread > 0 else 0.0
        strength = min(max(mean * (1 - mean) / between - 1, LEAST), MOST) if between > 0 else MOST
        alpha, beta = mean * strength, (1 - mean) * strength
    return hosts.withColumn("rate", (F.col("failed") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta)))


def judge(docs: DataFrame, limit: float = HOST_LIMIT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row for each row of docs: the base counts, base_failed, host_rate and kept."""
    base = stored(base_counts(docs, id_col, text_col, host_col), "base")
    rates = host_rates(base).select(F.col("host").alias("of"), F.col("rate").alias("host_rate"))
    joined = base.join(rates, base["host"].eqNullSafe(rates["of"]), "left").drop("of")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= limit))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents
), split AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM docs
), windows AS (
  SELECT rid, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS t FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM split)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM windows) WHERE c > 1
), repeats AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid
), base AS (
  SELECT s.rid, s.doc_id, s.source, CAST(len(s.ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(s.text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(s.text) - length(regexp_replace(s.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(s.ls) - len(list_distinct(s.ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM split s LEFT JOIN repeats r USING (rid)
), marked AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS failed FROM marked GROUP BY source
), total AS (
  SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(failed) AS DOUBLE) / sum(n) AS m, count(*) AS k,
    sum(n * (failed / n) * (failed / n)) AS squares, CAST(sum(n * n) AS DOUBLE) AS weights FROM hosts
), moments AS (
  SELECT m, CASE WHEN n - weights / n > 0 THEN (greatest(squares - n * m * m, 0) - (k - 1) * m * (1 - m)) / (n - weights / n) ELSE 0 END AS b FROM total
), prior AS (
  SELECT m, CASE WHEN b > 0 THEN least(greatest(m * (1 - m) / b - 1, 1.0), 10000.0) ELSE 10000.0 END AS s FROM moments
)
SELECT d.doc_id, d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, d.base_failed,
  NOT d.base_failed AND (h.failed + p.m * p.s) / (h.n + p.s) <= 0.5 AS kept
FROM marked d JOIN hosts h ON d.source IS NOT DISTINCT FROM h.source CROSS JOIN prior p
"""
