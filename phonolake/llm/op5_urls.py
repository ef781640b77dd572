"""URL filters: host and path rules first, a character n-gram model for the rest.

The model is a logistic regression over hashed character n-grams of host and
path. It is fitted once on the driver from a small labelled table (at most
TRAIN_ROWS rows, the ones whose urls hash lowest, so any run picks the same) and
becomes BUCKETS weights inside the plan; scoring is DataFrame functions only and
needs no shuffle. `labelled_urls` is the table that comes with the package: hosts
named after a subject that is blocked (gambling, drugs, adult, adverts and
tracking, spam, scams, malware) or allowed, with the same companions, prefixes,
suffixes and paths on either side, so that nothing but the subject tells them
apart. Any other table of url and label will do, and `ruled_urls` makes one from
the rules where these are to be carried on to other hosts.

Defined results: a null url, or one without "://", has an empty host and path;
of rules of one length the first in RULES wins; repeated rows are judged alike,
one by one; an empty table gives an empty result; without labelled rows of both
kinds the model allows everything; columns other than id and url are not read.
Very long urls cost time in proportion.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.llm.common import column, table

GRAM = 3
BUCKETS = 4096
TRAIN_ROWS = 4000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The filter's fixed rules.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...], give: str) -> Column:
    """The name, or the verdict, of the longest rule that fits; null if none does."""
    found = F
    for r in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = found.when(fits, F.lit(getattr(r, give)))
    return found.otherwise(F.lit(None).cast("string"))


def grams(host: Column, path: Column) -> Column:
    """The buckets of all n-grams of ^host$path."""
    chars = F.split(F.concat(F.lit("^"), host, F.lit("$"), path, F.lit(" " * (GRAM - 2))), "")
    hashed = lambda c: F.transform(
        F.sequence(F.lit(0), F.size(c) - GRAM),
        lambda i: F.pmod(F.xxhash64(*[F.get(c, i + k) for k in range(GRAM)]), F.lit(BUCKETS)).cast("int"),
    )
    return F.get(F.transform(F.array(chars), hashed), F.lit(0))


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS, rounds: int = 1500, rate: float = 4.0, shrink: float = 1e-4, block_weight: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias from labelled (url, label), label 1 for block: full-batch descent with momentum.
    A row to block weighs block_weight times one to allow, so that urls unlike both are allowed.

    A count sets the hash below which urls can be among the lowest `rows`, so that
    tasks hand on a few times that many at most.
    """
    total = labelled.count()
    if total > 4 * rows:
        labelled = labelled.where(F.xxhash64("url") < -(1 << 63) + (1 << 64) * 4 * rows // total)
    taken = labelled.select("url", "label").distinct().orderBy(F.xxhash64("url"), "url", "label").limit(rows)
    taken = taken.select("label", grams(host_of(F.col("url")), path_of(F.col("url"))).alias("grams")).collect()
    y = np.array([float(r.label) for r in taken])
    if not len(y) or y.min() == y.max():
        return np.zeros(BUCKETS), -1.0
    x = np.zeros((len(taken), BUCKETS))
    for i, r in enumerate(taken):
        np.add.at(x[i], r.grams, 1 / np.sqrt(len(r.grams)))
    used = np.flatnonzero(x.any(axis=0))
    x, weight = x[:, used], np.where(y == 1, block_weight, 1.0)
    weight /= weight.sum()
    w, b, vw, vb = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0
    for _ in range(rounds):
        off = weight * (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y)
        vw = 0.9 * vw - rate * (1 - 0.9) * (x.T @ off + shrink * w)
        vb = 0.9 * vb - rate * (1 - 0.9) * off.sum()
        w, b = w + vw, b + vb
    every = np.zeros(BUCKETS)
    every[used] = w
    return every, float(b)


def score(buckets: Column, model: tuple[np.ndarray, float]) -> Column:
    """The model's log-odds of block."""
    weights = F.array(*[F.lit(float(v)) for v in model[0].round(9)])
    total = F.aggregate(buckets, F.lit(0.0), lambda acc, k: acc + F.get(weights, k))
    return total / F.sqrt(F.size(buckets)) + F.lit(model[1])


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """For each page: key, host, path, the rule that decided (null: the model), and the verdict."""
    model = fit(labelled)
    slim = pages.select(column(pages, key).alias(key), host_of(column(pages, url)).alias("host"), path_of(column(pages, url)).alias("path"))
    ruled = slim.select("*", rule_of(F.col("host"), F.col("path"), rules, "name").alias("rule"), rule_of(F.col("host"), F.col("path"), rules, "verdict").alias("stated"))
    learned = F.when(score(grams(F.col("host"), F.col("path")), model) > 0, "block").otherwise("allow")
    return ruled.select(key, "host", "path", "rule", F.coalesce("stated", learned).alias("verdict"))


#: Subjects of the labelled table's hosts.
BLOCKED = "casino slots poker bets betting jackpot lottery roulette pills viagra pharmacy diet adult xxx porn sexy escort ads adserver banner click track tracker popup spam backlink linkfarm farm seo replica cheap free loans payday crypto prize winner bonus warez keygen crack torrent phishing malware".split()
ALLOWED = "library museum university school college news journal recipes garden travel hiking wiki docs manual poems music choir theatre cinema chess football cycling maths physics biology history geology medicine hospital court council parliament railway harbour reader writer thinking letters station language dictionary article forum thread theology health earth mother weather heather method nation motion intention entrance heritage theory thousand winter".split()
#: What stands with a subject, before or after it.
COMPANIONS = "online my the best daily north old open world house club land guide point notes".split()


def labelled_urls(spark: SparkSession, forms: int = 8) -> DataFrame:
    """The package's labelled table (url, label), label 1 for block, with so many hosts for each subject."""
    rows = []
    for label, subjects in ((1, BLOCKED), (0, ALLOWED)):
        for i, subject in enumerate(subjects):
            for form in range(forms):
                k = i * forms + form
                companion = COMPANIONS[(i + 2 * form) % len(COMPANIONS)]
                name = (f"{subject}-{companion}", f"{companion}-{subject}", f"{companion}{subject}", subject)[form % 4]
                host = ("", "www.", "m.", "blog.")[(i + form) % 4] + name + ".example." + ("com", "net", "org")[k % 3]
                path = f"/{('en', 'de', 'fr', 'es')[(i + form // 2) % 4]}/{37 * k % 990 + 1}" + ("", ".html", "?page=2", "#top")[(k // 4) % 4]
                rows.append((f"http{'s' if k % 2 else ''}://{host}{path}", label))
    return spark.createDataFrame(rows, "url string, label int")


def ruled_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url") -> DataFrame:
    """The labelled table that the rules themselves give: (url, label) of every page that one fits."""
    u = column(pages, url)
    stated = rule_of(host_of(u), path_of(u), rules, "verdict")
    return pages.select(u.alias("url"), (stated == "block").cast("int").alias("label")).where(F.col("label").isNotNull())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, labelled_urls(spark))
