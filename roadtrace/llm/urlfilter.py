"""URL filters: allow and block rules by host and path, and for all other URLs a logistic regression on hashed character n-grams.

The classifier is Spark ML's, trained from a small labelled URL table
(``labelled_urls``, or the caller's own): the 3- to 5-grams of host and path, with marks
at their ends and told apart, are hashed to ``FEATURES`` places. Everything runs on the
JVM in one narrow pass over the pages.
"""

from __future__ import annotations

import hashlib
import itertools

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: (verdict, host, path). A rule fits its host and all subdomains where the URL's path starts with the rule's.
RULES = [(ALLOW, "com", "/"), (BLOCK, "example.com", "/en/"), (ALLOW, "www.example.com", "/en/"), (BLOCK, "net", "/es/"), (BLOCK, "net", "/fr/")]
FEATURES, GRAMS = 1 << 16, (3, 4, 5)
REG, ITERATIONS, THRESHOLD = 1e-4, 60, 0.5
#: Rows of the labelled table that are fitted at most (the first by a hash of the URL).
TRAIN_URLS = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words of the labelled hosts.
UNWANTED = (
    "casino poker bets betting jackpot slots roulette gamble lottery bingo adult porn sex xxx nude escort cams hookup pills pharmacy viagra cialis drugs steroids "
    "spam linkfarm clickbait popup ads adserver tracker tracking clicks banner doubleclick affiliate torrent warez crack keygen pirate malware phishing hacked loan payday forex replica"
).split()
ORDINARY = (
    "news library museum school university science history garden kitchen recipes travel weather music theatre football cycling running photos maps health hospital "
    "research journal review forum wiki docs support help about city council government law nature forest river mountain planet space physics chemistry biology maths language books poems letters art design build house family"
).split()
#: What stands beside a word in a host, and paths.
BESIDE = ["best", "my", "free", "win", "farm", "online", "the", "top", "cheap", "x", "daily", "world", "track", "club", "shop", "live"]
PATHS = ["/", "/en/{}", "/fr/{}.html", "/de/{}/", "/es/{}", "/index.html", "/a/b/{}", "/2021/05/{}"]
_SYLLABLES = ["th", "er", "on", "ti", "re", "an", "sh", "ble", "ing", "or", "en", "st", "ha", "ou", "in", "li", "mo", "ka", "ve", "du"]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, label (1: unwanted): a small table by rule from the word lists above and from made-up names.

    Each word stands in hosts alone, before and behind others; what stands beside it is
    the same for both labels, and its subdomain, domain and path follow from a hash, so
    that the words decide.
    """
    names = [(name, label) for label, words in ((1.0, UNWANTED), (0.0, ORDINARY)) for word in words for name in (word, f"{word}s", *(x for b in BESIDE[::2] for x in (f"{word}-{b}", f"{b}-{word}", f"{b}{word}")))]
    names += [("".join(p), 0.0) for p in [*itertools.product(_SYLLABLES, _SYLLABLES), *itertools.product(_SYLLABLES[::2], _SYLLABLES[1::2], _SYLLABLES[::3])]]
    dress = lambda *x: hashlib.md5(repr(x).encode()).digest()
    urls = []
    for name, label in names:
        h = dress(name)
        host = ["", "www.", "m.", "blog."][h[0] % 4] + name + ["", ".example"][h[1] % 2] + [".com", ".net", ".org"][h[2] % 3]
        urls.append((["http", "https"][h[3] % 2] + "://" + host + PATHS[h[4] % len(PATHS)].format(h[5] * 39 + h[6]), label))
    return spark.createDataFrame(urls, "url string, label double")


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and path (from there up to ``?``, ``#`` or the end); both empty for a null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(rules: list[tuple[str, str, str]], host: str, path: str) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. For lists of up to some hundred rules, which become one expression."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):  # longer ones are asked first
        fits = ((F.col(host) == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def with_features(rows: DataFrame, host: str, path: str) -> DataFrame:
    """Add ``_features``: which hashed n-grams of host and path occur, all digits being one. Characters are cut once, so a long URL takes time in proportion to its length."""
    for part, name in ((host, "_h"), (path, "_p")):
        marked = F.translate(F.concat(F.lit("^"), F.col(part), F.lit("$")), "123456789", "0" * 9)
        rows = rows.withColumn(name, F.when(F.length(part) > 0, F.split(marked, "")).otherwise(F.array().cast("array<string>")))
        for n in GRAMS:
            rows = NGram(n=n, inputCol=name, outputCol=f"{name}{n}").transform(rows)
    tagged = [F.transform(f"{name}{n}", lambda x, name=name: F.concat(F.lit(name), x)) for name in ("_h", "_p") for n in GRAMS]
    rows = rows.withColumn("_grams", F.concat(*tagged))
    rows = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="_features").transform(rows)
    return rows.drop("_h", "_p", "_grams", *(f"{name}{n}" for name in ("_h", "_p") for n in GRAMS))


def train(labelled: DataFrame, most: int = TRAIN_URLS) -> LogisticRegressionModel:
    """Logistic regression from (url, label: 1 unwanted), of which at most ``most`` rows are fitted, in one partition, so that sums always have one order. Null urls and labels teach nothing."""
    rows = labelled.where("url is not null and label is not null").select("url", F.col("label").cast("double").alias("label"))
    rows = rows.orderBy(F.xxhash64("url"), "url", "label").limit(most).coalesce(1)
    host, path = host_and_path("url")
    rows = with_features(rows.select("label", host.alias("host"), path.alias("path")), "host", "path").cache()
    try:
        return LogisticRegression(featuresCol="_features", labelCol="label", regParam=REG, maxIter=ITERATIONS, standardization=False).fit(rows)
    finally:
        rows.unpersist()


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``page`` (the row), host, path, rule, verdict and score of each row of ``pages``.

    The verdict is that of the longest rule that fits; without one a URL is blocked
    where the classifier's probability of an unwanted URL (``score``) is at least
    ``threshold``. A null url, or one without ``://``, has neither host nor path: no rule
    fits, and its score is that of a URL of which nothing is known. Repeated rows are
    judged each; an empty table gives no rows.
    """
    model = train(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    host, path = host_and_path("_url")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), F.col("url").alias("_url"))
    rows = rows.select("page", host.alias("host"), path.alias("path"))
    rows = model.transform(with_features(rows, "host", "path").withColumn("_rule", fitting_rule(rules, "host", "path")))
    score = vector_to_array("probability")[1]
    return rows.select("page", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", F.when(score >= threshold, BLOCK).otherwise(ALLOW)).alias("verdict"), score.alias("score"))
