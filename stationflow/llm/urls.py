"""URL filter: host and path rules, and for every other URL a logistic regression on hashed character n-grams.

All of it is DataFrame functions and Spark's own classifier; nothing runs in Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.llm.common import ascii_lower

ALLOW, BLOCK = "allow", "block"
GRAMS = (3, 4)
FEATURES = 1 << 13
#: Labelled URLs of each class that training may use at most, about.
PER_CLASS = 2_000
THRESHOLD = 0.5

# A small labelled table: kinds of unwanted and of ordinary hosts and paths, spelled out to URLs by ``labelled_urls``.
BAD_HOSTS = (
    "casino", "casino-win", "win-casino", "best-casino", "poker-online", "free-bets", "bets", "betting-tips", "sports-bets", "slots",
    "jackpot", "lottery-win", "cheap-pills", "pills", "online-pharmacy", "viagra-shop", "cheap-meds", "adult", "adult-x", "xxx-tube",
    "sex-cams", "porn", "escort-girls", "spam", "spam-farm", "link-farm", "seo-links", "ads", "ads-track", "ad-tracker", "track-clicks",
    "popup-ads", "adserver", "free-download", "crack-keygen", "warez", "torrent-movies", "payday-loans", "quick-cash", "crypto-giveaway",
    "free-followers", "replica-watches", "phish-login", "malware",
)
GOOD_HOSTS = (
    "news", "blog", "university", "library", "museum", "weather", "recipes", "garden", "travel", "history", "science", "physics", "maths",
    "health", "hospital", "school", "teachers", "books", "poetry", "music", "theatre", "film", "football", "cycling", "hiking", "maps",
    "wiki", "docs", "help", "support", "forum", "community", "developer", "python", "linux", "archive", "journal", "research", "council",
    "parliament", "railway", "station", "market", "bakery", "farm", "coffee", "nature", "birds", "oceans", "rivers", "mountains", "tion",
    "inter", "ther", "stone", "north", "shore", "heron", "earth", "ember", "thistle", "anther", "tinder", "render", "onset", "reading",
)
BAD_PATHS = ("win", "bonus", "free-bets", "cheap-pills", "xxx", "click", "track", "promo-code", "crack", "casino-bonus")
GOOD_PATHS = ("article", "about", "news", "wiki", "docs", "guide", "story", "topic", "help", "archive")
PREFIXES = ("", "www.", "m.", "blog.")
ENDINGS = (".example.com", ".example.net", ".example.org", ".com", ".net", ".org")
LANGUAGES = ("en", "de", "fr", "es")


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled URL table: every named host beside a language and a number, which both classes share alike, and some
    ordinary made-up hosts beside the named paths."""
    made = []
    for blocked, hosts in ((1, BAD_HOSTS), (0, GOOD_HOSTS)):
        for i, host in enumerate(hosts):
            for j, prefix in enumerate(PREFIXES):
                for k, ending in enumerate(ENDINGS):
                    number, language = 37 * i + 211 * j + 1009 * k, LANGUAGES[(i + j + k) % len(LANGUAGES)]
                    made.append((f"https://{prefix}{host}{ending}/{language}/{number}", blocked))
    for blocked, paths in ((1, BAD_PATHS), (0, GOOD_PATHS)):
        for i, path in enumerate(paths):
            for k, ending in enumerate(ENDINGS):
                made.append((f"http://{GOOD_HOSTS[(7 * i + k) % len(GOOD_HOSTS)]}{ending}/{path}/{91 * i + k}", blocked))
    return made


# The rules of the query's contract, as (host and path, verdict).
RULES = (
    ("com/", ALLOW),
    ("example.com/en/", BLOCK),
    ("www.example.com/en/", ALLOW),
    ("net/es/", BLOCK),
    ("net/fr/", BLOCK),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for NULL or without ``://``."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, NULL if none does.

    The rules are few and part of the plan. A rule fits its host and all subdomains if the path starts with the rule's.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        at = rule.index("/")
        suffix, start = rule[:at].lower(), rule[at:]
        fits = ((host == suffix) | host.endswith(f".{suffix}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of the host and of the path, each marked with where it is from and its ends marked."""

    def of(text: Column, kind: str, n: int) -> Column:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.concat(F.lit(f"{kind}:"), F.substring(marked, i, F.lit(n))))

    return F.concat(*[of(text, kind, n) for text, kind in ((host, "h"), (path, "p")) for n in GRAMS])


def _featured(urls: DataFrame) -> DataFrame:
    """Adds the hashed n-grams of ``_host`` and ``_path`` as ``_x``."""
    hashed = HashingTF(inputCol="_grams", outputCol="_x", numFeatures=FEATURES, binary=True)
    return hashed.transform(urls.withColumn("_grams", grams(F.col("_host"), F.col("_path")))).drop("_grams")


@dataclass(frozen=True)
class UrlModel:
    """A fitted classifier, or the one answer where there was nothing to tell apart."""

    fitted: LogisticRegressionModel | None
    constant: float = 0.0


def small_table(labelled: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """At most about ``per_class`` (url, blocked) rows of each class, picked by a hash of the URL; equal URLs count once."""
    known = labelled.where(F.col("url").isNotNull() & F.col("blocked").isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy("blocked").count().collect()}
    spot, share = F.pmod(F.xxhash64("url"), F.lit(1 << 30)) / float(1 << 30), F.lit(0.0)
    for value, count in counts.items():
        share = F.when(F.col("blocked") == value, min(1.0, per_class / count)).otherwise(share)
    return known.where(spot < share).groupBy("url").agg(F.max("blocked").alias("blocked")).limit(3 * per_class)


def train(labelled: DataFrame, per_class: int = PER_CLASS) -> UrlModel:
    """Fit on a small labelled URL table (url, blocked 0 or 1). Without rows nothing is blocked; with one class only,
    every URL is of that class."""
    rows = small_table(labelled, per_class).coalesce(1)
    urls = rows.select(host_of(F.col("url")).alias("_host"), path_of(F.col("url")).alias("_path"), F.col("blocked").cast("double"))
    data = _featured(urls).select("_x", "blocked").persist()
    try:
        seen = [r[0] for r in data.select("blocked").distinct().collect()]
        if len(seen) < 2:
            return UrlModel(None, float(seen[0]) if seen else 0.0)
        fit = LogisticRegression(
            featuresCol="_x", labelCol="blocked", predictionCol="_p", probabilityCol="_chance", rawPredictionCol="_raw",
            maxIter=30, regParam=0.003,
        ).fit(data)
        return UrlModel(fit)
    finally:
        data.unpersist()


def judged(pages: DataFrame, model: UrlModel, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, chance) of every row.

    The longest rule that fits decides; else the classifier does, from host and path. ``chance`` is the classifier's for
    every row. NULL URLs and those without ``://`` have an empty host and path and are judged like any other.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("_host"), path_of(F.col("url")).alias("_path"))
    if model.fitted is None:
        scored = urls.withColumn("_blocked", F.lit(model.constant))
    else:
        scored = model.fitted.transform(_featured(urls)).withColumn("_blocked", vector_to_array("_chance")[1])
    rule = longest_rule(F.col("_host"), F.col("_path"), rules)
    by_model = F.when(F.col("_blocked") >= THRESHOLD, BLOCK).otherwise(ALLOW)
    return scored.withColumn("_rule", rule).select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", by_model).alias("verdict"), F.col("_blocked").alias("chance"),
    )


def labelled_table(spark: SparkSession) -> DataFrame:
    """(url, blocked) of ``labelled_urls``."""
    return spark.createDataFrame(labelled_urls(), "url string, blocked int")
