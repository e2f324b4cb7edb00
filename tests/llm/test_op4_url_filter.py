import random
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from helpers import oracle_rows, spark_rows  # noqa: E402

from gazette.llm.op4_url_filter import ORACLE_SQL, SOFT, SOFT_TERMS, STRICT, automaton, filter_urls, parts, terms_of  # noqa: E402

CASES = [
    ("http://WWW.Example.com/en/x", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
    ("http://example.com/en", "example.com", "/en", "com/", "allow"),
    ("http://anexample.com/en/", "anexample.com", "/en/", "com/", "allow"),
    ("http://a.net/es/1?q=xxx", "a.net", "/es/1", "net/es/", "block"),
    ("http://a.com?x=xxx", "a.com", "", None, "block"),
    ("http://a.org/xxxl/2", "a.org", "/xxxl/2", None, "allow"),
    ("http://a.org/-XXX-#f", "a.org", "/-XXX-", None, "block"),
    ("http://a.org/casino/pokers", "a.org", "/casino/pokers", None, "allow"),
    ("http://a.org/casino/poker?bonus=1", "a.org", "/casino/poker", None, "block"),
    ("http://a.org/casino/casino/casino", "a.org", "/casino/casino/casino", None, "allow"),
    ("ftp://é.org/a://b/en/", "é.org", "/a://b/en/", None, "allow"),
    ("no scheme porn", "", "", None, "block"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "c", "d") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")


def test_cases(spark):
    out = {r.page_id: r for r in filter_urls(frame(spark, [c[0] for c in CASES])).collect()}
    for i, (url, *want) in enumerate(CASES):
        assert [out[i].host, out[i].path, out[i].rule, out[i].verdict] == want, url
    assert filter_urls(frame(spark, [])).count() == 0


def test_oracle(spark):
    rng = random.Random(2)
    bits = [*STRICT, *SOFT_TERMS, "en", "fr", "es", "a", "Example", "com", "net", "org", "x1"]
    urls = [rng.choice(["http://", "HTTPS://", "//", ""]) + rng.choice([".", "-", "/"]).join(rng.choice(bits) for _ in range(rng.randint(1, 5))) + rng.choice(["", "/", "?", "#"]) + rng.choice("/.-_=a").join(rng.choice(bits) for _ in range(rng.randint(0, 4))) for _ in range(800)] + [None, "", "x" * 10_000 + "://porn"]
    import pandas as pd

    pages = pd.DataFrame({"page_id": range(len(urls)), "url": urls})
    got = filter_urls(frame(spark, urls)).select("page_id", "host", "path", "rule", "verdict")
    assert spark_rows(got) == oracle_rows(ORACLE_SQL, pages=pages)


def test_terms_match_regex():
    rng = random.Random(3)
    vocabulary = automaton(STRICT, SOFT_TERMS)
    for _ in range(500):
        text = "".join(rng.choice([*STRICT, *SOFT_TERMS, "-", "/", "9", "é", "."]) for _ in range(8))
        count = lambda terms: sum(bool(re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", text)) for t in terms)  # noqa: E731, B023
        assert terms_of(text, vocabulary) == (count(STRICT), count(SOFT_TERMS))
    assert SOFT > 1 and parts("http://h") == ("h", "")
