"""URL filter: host and path rules, else logistic regression on hashed character n-grams.

Only DataFrame and SQL functions: no Python runs in tasks. The model is fitted
by gradient descent whose gradients are aggregations over a small labelled
table (at most ``MAX_LABELLED`` rows); its ``buckets`` weights are the only
thing that comes back to the driver, and travel as one constant.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and is judged by the model on no n-grams (allow); an empty table
gives an empty result; repeated rows are judged each; other columns are kept
out of the result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (verdict, rule). A rule is a host and the start of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: The labelled table the registered query learns from: (1: block, url).
LABELLED = (
    (1, "http://casino-royal.test/en/12"), (1, "https://www.win-casino.test/de/7.html"), (1, "https://m.best-bets.test/es/31"),
    (1, "https://free-bets-now.test/fr/8"), (1, "http://blog.cheap-meds.test/en/9"), (1, "https://pills-online.test/en/2?utm_source=feed"),
    (1, "https://cheap-pills-shop.test/de/3/"), (1, "http://adult-video.test/en/5"), (1, "https://xxx-adult.test/es/6#top"),
    (1, "https://ads-server.test/en/1"), (1, "http://click-track.test/fr/77"), (1, "https://ad-track-ads.test/en/4"),
    (1, "http://spam-links.test/en/10"), (1, "https://link-farm.test/de/15"), (1, "https://www.spam-farm-hub.test/es/19"),
    (1, "http://poker-win.test/en/22"), (1, "https://blog.slots-casino.test/en/23"), (1, "https://bet-win-free.test/es/24"),
    (0, "http://www.library.test/en/12"), (0, "https://news.city.test/de/7.html"), (0, "https://m.weather.test/es/31"),
    (0, "https://blog.garden.test/fr/8"), (0, "http://history.school.test/en/9"), (0, "https://recipes.kitchen.test/en/2?utm_source=feed"),
    (0, "https://museum.test/de/3/"), (0, "http://www.theatre.test/en/5"), (0, "https://thinking.test/es/6#top"),
    (0, "https://blog.mountain.test/en/1"), (0, "http://m.river.test/fr/77"), (0, "https://www.physics.test/en/4"),
    (0, "http://other.nation.test/en/10"), (0, "https://blog.station.test/de/15"), (0, "https://the-things.test/es/19"),
    (0, "http://therein.test/en/22"), (0, "https://m.another.test/en/23"), (0, "https://www.the-shore.test/es/24"),
)
MAX_LABELLED = 10_000


def url_parts(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(F.col(url), pattern, 1), upper, upper.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(F.col(url), pattern, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(verdict, rule) of the longest rule that fits; null without one. Of equal lengths, the first in the order of text."""
    verdict, rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        verdict, rule = F.when(fits, kind).otherwise(verdict), F.when(fits, text).otherwise(rule)
    return verdict, rule


def ngram_buckets(host: Column, path: Column, buckets: int, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Distinct hash buckets of the character n-grams of host and path, each with its borders marked."""

    def grams(name: str, part: Column, n: int) -> Column:
        framed = F.concat(F.lit("^"), part, F.lit("$"))
        # Shorter parts have no n-gram of that size; sequence() would count down.
        last = F.length(framed) - (n - 1)
        every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                            lambda i: F.pmod(F.xxhash64(F.lit(name), framed.substr(i, F.lit(n))), F.lit(buckets)).cast("int"))
        return F.when((F.length(part) > 0) & (last >= 1), every)

    parts = [grams(name, part, n) for name, part in (("h", host), ("p", path)) for n in sizes]
    return F.array_distinct(F.concat(*[F.coalesce(p, F.array().cast("array<int>")) for p in parts]))


def _score(grams: str, weights: list[float], bias: float) -> Column:
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    total = F.aggregate(F.col(grams), F.lit(0.0), lambda acc, i: acc + F.get(table, i))
    return total / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double")) + F.lit(bias)


def labelled_table(spark: SparkSession, rows: tuple[tuple[int, str], ...] = LABELLED) -> DataFrame:
    """A labelled table (label, url) from constants."""
    text = json.dumps([{"label": label, "url": url} for label, url in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), "array<struct<label:int,url:string>>")))


def fit(labelled: DataFrame, buckets: int = 4096, steps: int = 12, rate: float = 6.0, decay: float = 1e-3) -> tuple[list[float], float]:
    """Weights and bias. Rows with a null label are left out; without rows all weights are zero and the bias allows."""
    host, path = url_parts("url")
    rows = labelled.filter("label is not null").select(F.col("label").cast("double").alias("y"), host.alias("h"), path.alias("p"))
    rows = rows.select("y", ngram_buckets(F.col("h"), F.col("p"), buckets).alias("grams"))
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if n > MAX_LABELLED:
        raise ValueError(f"the labelled table has {n} rows; at most {MAX_LABELLED} are meant")
    weights = [0.0] * buckets
    if not n:
        return weights, -1.0
    bias = math.log((positive + 1) / (n - positive + 1))
    for _ in range(steps):
        error = F.lit(1.0) / (1 + F.exp(-_score("grams", weights, bias))) - F.col("y")
        scaled = rows.select(error.alias("e"), (error / F.sqrt(F.greatest(F.size("grams"), F.lit(1)).cast("double"))).alias("g"), F.explode_outer("grams").alias("i"))
        for i, gradient in scaled.groupBy("i").agg(F.sum("g")).collect():  # at most one row a bucket
            if i is not None:
                weights[i] -= rate * (gradient / n * 8 + decay * weights[i])
    return weights, bias


def url_filter(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, buckets: int = 4096) -> DataFrame:
    """page_id, host, path, rule, verdict, and the model's probability that the url is to be blocked."""
    weights, bias = fit(labelled, buckets)
    host, path = url_parts("url")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    verdict, rule = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), ngram_buckets(F.col("host"), F.col("path"), buckets).alias("grams"))
    chance = F.when(F.size("grams") > 0, F.lit(1.0) / (1 + F.exp(-_score("grams", weights, bias)))).otherwise(F.lit(0.0))
    rows = rows.select("page_id", "host", "path", "rule", "ruled", chance.alias("block_probability"))
    return rows.select("page_id", "host", "path", "rule",
                       F.coalesce("ruled", F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")).alias("verdict"), "block_probability")
