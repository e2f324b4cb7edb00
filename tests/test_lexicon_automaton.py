import random
import re

from gazette.functions.text import fold
from gazette.operators.lexicon import compiled, with_hits
from pyspark.sql import functions as F


def brute(text, terms):
    edge = r"[\w؀-ۿ]"
    out = []
    for term, mode in compiled(terms):
        prefix = "(?:ال)?" if mode == "article" else ""
        if (term in text) if mode == "substring" else re.search(f"(?<!{edge}){prefix}{re.escape(term)}(?!{edge})", text):
            out.append(term)
    return sorted(out)


def test_one_pass_over_all_lexicons_matches_term_by_term(spark):
    rng = random.Random(1)
    syllables = ["al", "api", "ta", "tb", "iv a", "um", "كر", "سل", "ال", "ورم", "éa", "x_1", "carbo", "platin"]
    lexicons = {f"l{i}": ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(25)] + [" ", ""] for i in range(17)} | {"none": []}
    texts = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(0, 30))) for _ in range(120)] + [None, "", "(السل)", "السل سلم", "all"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("f", fold(F.col("t")))
    for part in (50_000, 40):
        for r in with_hits(df, "f", lexicons, part).collect():
            for name, terms in lexicons.items():
                assert r[name] == brute(r.f, terms), (r.t, name)
