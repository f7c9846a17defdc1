"""URL filters: ordered rules, then logistic regression on hashed character n-grams of host and path.

Features and scores are DataFrame expressions, evaluated row by row without a shuffle. The model is fitted on the
driver from a small labelled table, whose features come from the same expressions; at most MOST of its rows are read.
The default table is made by a rule from short lists of words.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS = 16_384
LENGTHS = (3, 4, 5)
MOST = 5000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A rule is a host, that stands for its subdomains too, and the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

# fixed values: words of hosts and paths of the default table, to block and to allow, and what stands around them
BLOCKED = (
    "casino bonus poker jackpot slots roulette betting gamble lottery winner prize spam farm pills viagra cialis pharma cheap discount xxx porn sex adult cams nude escort "
    "warez crack keygen torrent malware phish click banner popunder payday loan cash replica rolex hacked proxy backlinks seo fake miracle weight-loss crypto-doubler singles"
).split()
ALLOWED = (
    "news blog university research docs library wiki museum art daily culture zeitung politik revista ciencia school lessons health guide code project forum garden city services "
    "weather forecast recipes cooking books reviews journal article science archive teaching nature birds music history film theatre travel notes history law court data survey"
).split()
CONSONANTS, VOWELS = "b c d f g h j k l m n p r s t th v w sh ch st nd nt".split(), "a e i o u ea ou".split()
FRONTS = ("", "", "www.", "blog.", "m.")
ENDS = (".example.com", ".example.net", ".example.org", ".com", ".net", ".org", ".info")
TAILS = ("", "/", ".html", "?page=2&ref=x", "?utm_source=feed", "#top")
TABLE = 1600  # URLs of the default table, a quarter of them to block


def default_urls(many: int = TABLE, seed: int = 17) -> list[tuple[str, int]]:
    """The default labelled URLs, 1 to block, by a seeded rule: hosts of one or two words of a kind, or of neither (allowed),
    with numbered pages or with words of that kind as paths."""
    rng = random.Random(seed)

    def unknown() -> str:
        return "".join(rng.choice(("", rng.choice(CONSONANTS))) + rng.choice((rng.choice(VOWELS), rng.choice(CONSONANTS))) + rng.choice(CONSONANTS) for _ in range(rng.randint(1, 3)))

    out = []
    for i in range(many):
        label = int(i % 4 == 0)
        some = rng.sample(BLOCKED if label else ALLOWED, 2)
        host = rng.choice((some[0], "-".join(some), "".join(some)))
        if rng.random() < 0.3 + 0.4 * (1 - label):  # a word that is none alone, or beside one to block
            host = "-".join(rng.sample((some[0], unknown()), 2)) if label else unknown()
        page = str(rng.randrange(1000))
        tongue = rng.choice(("en", "de", "fr", "es"))
        path = rng.choice((f"/{tongue}/{page}", f"/{tongue}/{page}", f"/{some[1]}/{page}", f"/{some[1]}"))
        out.append((f"{rng.choice(('http', 'https'))}://{rng.choice(FRONTS)}{host}{rng.choice(ENDS)}{path}{rng.choice(TAILS)}", label))
    return out


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path. Null, or no `://`: both empty."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, shape, 1), UPPER, LOWER), F.regexp_extract(text, shape, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (of equally long ones the least), or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        where, slash, start = rule.partition("/")
        fits = ((host == where) | F.endswith(host, F.lit("." + where))) & F.startswith(path, F.lit(slash + start))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _grams(text: Column, kind: str) -> Column:
    def some(n: int) -> Column:
        at = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(kind), F.substring(text, i, F.lit(n))), F.lit(DIMENSIONS)).cast("int"))

    return F.concat(*(some(n) for n in LENGTHS))


def features(host: Column, path: Column) -> Column:
    """Distinct numbers of the hashed n-grams of host and path, ends marked."""
    return F.array_distinct(F.concat(_grams(F.concat(F.lit("^"), host, F.lit("$")), "host"), _grams(F.concat(F.lit("^"), path, F.lit("$")), "path")))


def default_labelled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(default_urls(), "url string, label int")


def train(labelled: DataFrame, epochs: int = 30, rate: float = 0.5, l2: float = 1e-4, seed: int = 5) -> tuple[list[float], float]:
    """Weights and bias of a logistic regression on (url, label), label 1 to block; rows with a null label are left out.

    Of a larger table the MOST rows of least hash are read, so reruns agree. A model without rows has weight zero
    everywhere and blocks at a cutoff of one half; add rows.
    """
    host, path = parts(F.col("url"))
    some = labelled.where("label is not null").select("url", F.col("label").cast("int").alias("y")).orderBy(F.xxhash64("url", "y"), "url", "y").limit(MOST)
    rows = some.select(features(host, path).alias("f"), "y").collect()
    data = sorted((sorted(r["f"]), r["y"]) for r in rows)
    w, b = [0.0] * DIMENSIONS, 0.0
    rng = random.Random(seed)
    for e in range(epochs):
        rng.shuffle(data)
        step = rate / (1 + 0.1 * e)
        for f, y in data:
            scale = 1 / math.sqrt(len(f)) if f else 0.0
            s = b + scale * sum(w[i] for i in f)
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) - y
            b -= step * g
            for i in f:
                w[i] -= step * (g * scale + l2 * w[i])
    return w, b


def score(host: Column, path: Column, model: tuple[list[float], float]) -> Column:
    """Probability that the URL is to be blocked."""
    w, b = model
    table = F.from_json(F.lit(json.dumps(w)), "array<double>")
    f = features(host, path)
    total = F.aggregate(f, F.lit(0.0), lambda a, i: a + F.get(table, i))
    return 1 / (1 + F.exp(-(F.lit(b) + total / F.sqrt(F.greatest(F.size(f), F.lit(1))))))


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, cutoff: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of pages (page_id, url).

    verdict: that of the longest rule that fits, else block where the model's score reaches the cutoff, else allow.
    score is the model's for every row. Rows that repeat a page_id are judged each, a null one too; a null or blank
    url has neither host nor path; an empty table gives no rows; other columns are not read.
    """
    model = train(labelled if labelled is not None else default_labelled(pages.sparkSession))
    host, path = parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("score", score(F.col("host"), F.col("path"), model))
    says = F.lit(None).cast("string")
    for rule, verdict in rules:
        says = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(says)
    method = F.when(F.col("score") >= cutoff, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce(says, method).alias("verdict"), "score")
