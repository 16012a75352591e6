import math
import re

import pytest
import xxhash
from keelgrid.llm import urlfilter as u
from pyspark.sql import functions as F

URLS = [None, "", "no scheme", "http://", "http://A.Example.COM/en/7x?y#z", "https://x.example.com/en/8", "http://com/en/", "http://notexample.com/en/71", "http://example.com:80/en/7", "http://a.net/de/", "http://example.net/de/81", "http://org#/es/", "http://é.ORG/es/ä?b://c", "x://y://z/de/", "http://a.net?/de/", "http://a.org/ES/", "ftp://Ünet/\n/q", "http://" + "a" * 30000 + ".com/en/", "://com/en/1"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule(host, path):
    fits = [(of + p, a) for a, of, p in u.RULES if (host == of or host.endswith("." + of)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0])) if fits else (None, None)


def grams(host, path):
    out = []
    for mark, text in (("h", host), ("p", path.lower())):
        whole = f"^{text}$"
        for n in u.ORDERS:
            for i in range(len(whole) - n + 1):
                x = xxhash.xxh64_intdigest(whole[i : i + n].encode(), xxhash.xxh64_intdigest(mark.encode(), 42))
                out.append((x - (1 << 64) if x >> 63 else x) % u.BUCKETS)
    return out


def test_parts_rules_and_scores(spark):
    df = spark.createDataFrame([(i, x, "h") for i, x in enumerate(URLS)], "page_id long, url string, host string")
    out = u.judge_urls(df)
    examples = spark.createDataFrame(list(u.EXAMPLES), "url string, label int")
    weights, bias = u.train(examples)
    rows = {r.page_id: r for r in out.collect()}
    for i, url in enumerate(URLS):
        host, path = parts(url)
        assert (rows[i].host, rows[i].path) == (host, path), url
        name, action = rule(host, path)
        assert rows[i].rule == name, url
        g = grams(host, path)
        p = 1 / (1 + math.exp(-bias - sum(weights[b] for b in g) / math.sqrt(max(len(g), 1))))
        assert abs(p - rows[i].score) < 1e-9
        assert rows[i].verdict == (action or ("block" if rows[i].score >= 0.5 else "allow"))
    assert "Python" not in out._jdf.queryExecution().toString()


def test_the_model_separates_its_examples_and_others_like_them(spark):
    told = [*u.EXAMPLES, ("http://poker-casino.example.biz/bonus/spins", 1), ("https://cheap-crack.example.info/keygen", 1), ("https://en.example.wiki/article/art", 0), ("http://blog.example.org/fr/9", 0)]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(told)], "page_id long, url string")
    got = {r.page_id: r.score >= 0.5 for r in u.judge_urls(df, rules=()).collect()}
    assert [got[i] for i in range(len(told))] == [bool(y) for _, y in told]


def test_no_examples_repeated_rows_empty_table(spark):
    none = spark.createDataFrame([], "url string, label int")
    df = spark.createDataFrame([(None, "http://a.b/c"), (None, "http://a.b/c")], "page_id long, url string")
    assert [r.score for r in u.judge_urls(df, none).collect()] == [0.5, 0.5]
    assert u.judge_urls(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        u.train(spark.range(u.MAX_EXAMPLES + 1).select(F.lit("http://a/b").alias("url"), F.lit(1).alias("label")))
