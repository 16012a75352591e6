"""URL filter: rules on hosts and paths first, then logistic regression on hashed character n-grams of host and path.

The host is what stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; the path goes on up to `?`,
`#` or the end. A null url, or one without `://`, has an empty host and path. A rule fits its host and all subdomains, if
the path starts with the rule's path; of those that fit the longest decides (then the first given). Urls that no rule fits
are blocked if the model's probability is `threshold` or more. Repeated rows get equal results; a null id stays null; other
columns are ignored; an empty table gives no rows.

The model is trained on the driver from a labelled table of at most MAX_EXAMPLES urls, whose features come from the same
DataFrame expressions. Scoring is one projection: no shuffle, no Python, the weights are a literal array.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelgrid.llm.shared import let

BUCKETS, ORDERS, MAX_EXAMPLES = 1024, (3, 4), 20_000
#: (action, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Labelled urls (1: to block) from which the default model is trained.
EXAMPLES = (
    ("http://win-casino.example.biz/slots/bonus", 1),
    ("https://casino-royal.example.info/free-spins", 1),
    ("http://cheap-pills.example.biz/order/now", 1),
    ("https://pharma-discount.example.info/pills/buy", 1),
    ("http://adult-cams.example.biz/live/girls", 1),
    ("https://xxx-tube.example.info/watch/adult", 1),
    ("http://login-verify.example.biz/account/secure", 1),
    ("https://free-crack.example.info/download/keygen", 1),
    ("http://warez-zone.example.biz/torrent/crack", 1),
    ("https://bet-poker.example.info/casino/jackpot", 1),
    ("http://quick-loan.example.biz/payday/apply", 1),
    ("https://clicktrack.example.info/ads/redirect", 1),
    ("http://ads.spam-mail.example.biz/unsubscribe", 1),
    ("https://fake-watches.example.info/replica/shop", 1),
    ("http://www.example.edu/library/catalogue", 0),
    ("https://docs.example.io/en/guide/install", 0),
    ("https://en.example.wiki/article/history", 0),
    ("http://news.example.press/en/science/2021", 0),
    ("https://blog.example.dev/fr/posts/12", 0),
    ("http://museum.example.gov/es/collection", 0),
    ("https://m.example.net/en/551.html", 0),
    ("http://blog.example.org/fr/204/", 0),
    ("https://recipes.example.food/de/suppe/31", 0),
    ("http://forum.example.community/thread/4410", 0),
    ("https://journal.example.science/volume/7/paper", 0),
    ("http://maps.example.travel/fr/ville/18", 0),
    ("https://school.example.edu/en/course/math", 0),
    ("http://weather.example.gov/de/bericht", 0),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The deciding rule (host and path as one text) and its action; null where none fits."""
    rules = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, of, begin in reversed(rules):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(begin)
        name, action = F.when(fits, F.lit(of + begin)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def _bucket(mark: str, buckets: int):
    return lambda gram: F.pmod(F.xxhash64(F.lit(mark), gram), F.lit(buckets)).cast("int")


def features(host: Column, path: Column, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> Column:
    """Buckets of the character n-grams of host and path, each marked with its part."""
    parts = []
    for mark, text in (("h", host), ("p", F.lower(path))):
        whole = F.concat(F.lit("^"), text, F.lit("$"))
        for n in orders:
            grams = F.regexp_extract_all(whole, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
            parts.append(F.transform(grams, _bucket(mark, buckets)))
    return F.concat(*parts)


def train(examples: DataFrame, url_col: str = "url", label_col: str = "label", buckets: int = BUCKETS, epochs: int = 300, rate: float = 1.0, l2: float = 1e-3) -> tuple[list[float], float]:
    """Weights and bias by gradient descent on mean counts. Rows with a null label are left out."""
    host, path = host_and_path(F.col(url_col))
    rows = examples.where(F.col(label_col).isNotNull()).select(features(host, path, buckets), F.col(label_col).cast("int"), F.coalesce(url_col, F.lit(""))).limit(MAX_EXAMPLES + 1).collect()
    if len(rows) > MAX_EXAMPLES:
        raise ValueError(f"the labelled table has more than {MAX_EXAMPLES} rows")
    data = []
    for places, label, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        share: dict[int, float] = {}
        for b in places:
            share[b] = share.get(b, 0.0) + 1 / math.sqrt(len(places))
        data.append((share, label))
    w, bias = [0.0] * buckets, 0.0
    for _ in range(epochs if data else 0):
        step, step_bias = [l2 * x for x in w], 0.0
        for share, label in data:
            e = (1 / (1 + math.exp(-bias - sum(w[b] * x for b, x in share.items()))) - label) / len(data)
            step_bias += e
            for b, x in share.items():
                step[b] += e * x
        w = [a - rate * g for a, g in zip(w, step, strict=True)]
        bias -= rate * step_bias
    return w, bias


def probability(host: Column, path: Column, weights: list[float], bias: float, orders: tuple[int, ...] = ORDERS) -> Column:
    table = F.expr(f"array({','.join(f'{x!r}D' for x in weights)})")
    places = features(host, path, len(weights), orders)
    total = let(places, lambda p: F.aggregate(p, F.lit(0.0), lambda a, b: a + table[b]) / F.sqrt(F.greatest(F.size(p), F.lit(1)).cast("double")))
    return 1 / (1 + F.exp(-(total + F.lit(bias))))


def judge_urls(df: DataFrame, examples: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", rules: Iterable[tuple[str, str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """id, host, path, rule, verdict and score (the model's probability of block, for every url)."""
    if examples is None:
        examples = df.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"('{u}', {y})" for u, y in EXAMPLES) + " AS t(url, label)")
    weights, bias = train(examples)
    host, path = host_and_path(F.col(url_col))
    cut = df.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    scored = cut.select(id_col, "host", "path", rule.alias("rule"), action.alias("kg_action"), probability(F.col("host"), F.col("path"), weights, bias).alias("score"))
    verdict = F.coalesce("kg_action", F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "score")
