from keelgrid.llm import urlfilter as u

#: The contract's list, written out here: (action, host, path).
CONTRACT = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def test_rules_are_the_contracts(spark):
    assert sorted(u.RULES) == sorted(CONTRACT)
    urls = ["http://a.com/en/x", "http://example.com/en/71", "http://a.net/de/9", "http://m.example.net/de/9", "http://example.net/de/81", "http://a.org/es/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in u.judge_urls(df).collect()}
    assert [got[i] for i in range(len(urls))] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
