"""URL filter: host and path rules first, else a weighted vocabulary.

The longest rule that fits a URL gives its verdict. Elsewhere an Aho-Corasick automaton finds all vocabulary terms of the URL in one
pass; a term counts only between boundaries (no ASCII letter or digit on either side). One strict term rejects, and so do ``SOFT``
distinct soft terms.

Cases: a null URL, and one without ``://``, has empty host and path and fits no rule; a null URL has no terms and is allowed; empty
rules or terms are ignored; repeated rows are each judged; columns other than id and url are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.common import table

#: (host, path, verdict); a rule is named by host and path together.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
STRICT = ("porn", "xxx", "xvideos", "hentai", "camgirls", "escorts", "warez", "torrent", "keygen", "viagra")
SOFT_TERMS = ("adult", "casino", "poker", "betting", "sex", "nude", "dating", "loan", "pills", "cheap", "free", "bonus", "crack", "hack", "prize", "lottery", "webcam", "escort", "replica")
SOFT = 2
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_OUT = "page_id long, host string, path string, rule string, verdict string, strict int, soft int"


def parts(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for stop in "#?":
        rest = rest.split(stop, 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


class Rules:
    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[int, str, str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((len(host) + len(path), path, host + path, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best = (-1, None, None)
        labels = host.split(".")
        for i in range(len(labels)):
            for size, start, name, verdict in self.by_host.get(".".join(labels[i:]), ()):
                if size > best[0] and path.startswith(start):
                    best = (size, name, verdict)
        return best[1], best[2]


def automaton(strict: Sequence[str], soft: Sequence[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):
        for term in terms:
            if term:
                out.add_word(term, (term, weight))
    if len(out):
        out.make_automaton()
    return out


def _inside(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()


def terms_of(url: str | None, vocabulary: ahocorasick.Automaton) -> tuple[int, int]:
    """Numbers of distinct strict and soft terms."""
    if not url or not len(vocabulary):
        return 0, 0
    low = url.translate(_UPPER)
    found = {value for end, value in vocabulary.iter(low) if not _inside(low, end + 1) and not _inside(low, end - len(value[0]))}
    return sum(w == 2 for _, w in found), sum(w == 1 for _, w in found)


def _judge(rules: Sequence, strict: Sequence[str], soft: Sequence[str], most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vocabulary = Rules(rules), automaton(strict, soft)
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                host, path = parts(url)
                rule, verdict = own.find(host, path)
                hard, light = terms_of(url, vocabulary)
                rows.append((host, path, rule, verdict or ("block" if hard or light >= most else "allow"), hard, light))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id")} | {k: pa.array(c, t) for k, c, t in zip(("host", "path", "rule", "verdict", "strict", "soft"), columns, kinds)})

    return run


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT_TERMS, most: int = SOFT) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict and the numbers of distinct strict and soft terms."""
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return urls.mapInArrow(_judge(tuple(rules), tuple(strict), tuple(soft), most), _OUT)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _term(term: str) -> str:
    return f"CAST(regexp_matches(low, '(^|[^a-z0-9]){term}($|[^a-z0-9])') AS INT)"


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}')"


_ORDERED = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
ORACLE_SQL = rf"""
WITH low AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), marked AS (
  SELECT page_id, host, path, {" + ".join(map(_term, STRICT))} AS strict, {" + ".join(map(_term, SOFT_TERMS))} AS soft,
    CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for h, p, _ in _ORDERED)} END AS rule FROM low
)
SELECT page_id, host, path, rule,
  CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in _ORDERED)} WHEN strict > 0 OR soft >= {SOFT} THEN 'block' ELSE 'allow' END AS verdict
FROM marked
"""
