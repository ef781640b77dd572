"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule rejects a document on one signal. A bounded sample gives every rule's
cost (seconds over the sample) and selectivity (share rejected); rules run in
the order of rejection per cost, inside one CASE, so a document that an early
rule rejects never pays for the later ones. The order changes the work, never
the verdict: a document is kept if no rule rejects it.

Defined results: a null or empty text has no words and is rejected by
min_words; texts of any length are judged whole, with counts as longs (a text's
words are one array, so a text has 2**31 words at most); rules that tie in
rejection per cost stand by cost, then by name; repeated rows are judged alike,
one by one; an empty table gives an empty result; other columns pass through
`judge` untouched, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.llm.common import SPACE, column, materialize, table, unused

#: Words in a window whose repetition counts.
WINDOW = 8
#: Rows that a rule is tried on, about, and how often.
SAMPLE_ROWS = 2000
RUNS = 3


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def n_words(words: Column) -> Column:
    return F.size(words).cast("long")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once: a lambda's variable holds it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long")


def capitals(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\p{Lu}")), F.lit(0)).cast("long")


def worded_lines(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def dup_lines(text: Column) -> Column:
    lines = worded_lines(text)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def stutters(words: Column) -> Column:
    """Words equal to the word before them."""
    return F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1)))).cast("long")


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each window, from its words' hashes."""
    return bound(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.when(
            F.size(h) >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))),
        ).otherwise(F.array().cast("array<bigint>")),
    )


def repeated_words(words: Column) -> Column:
    """Words inside windows that the text has twice or more, the first included.

    Sorting (hash, start) pairs puts equal windows side by side; the starts of
    windows with an equal neighbour are sorted again and the union of their
    spans is measured gap by gap. Most texts repeat no window: they stop at the
    distinct count.
    """
    def starts(pairs: Column) -> Column:
        def twin(p: Column, j: Column) -> Column:
            same = lambda k: F.coalesce(F.get(pairs, k)["h"] == p["h"], F.lit(False))
            return same(j - 1) | same(j + 1)

        return F.array_sort(F.transform(F.filter(pairs, twin), lambda p: p["i"]))

    def union(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
            lambda acc, s: F.struct((s + WINDOW).alias("end"), (acc["n"] + s + WINDOW - F.greatest(s, acc["end"])).cast("long").alias("n")),
            lambda acc: acc["n"],
        )

    def measure(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeats, bound(ordered, lambda pairs: union(starts(pairs)))).otherwise(F.lit(0).cast("long"))

    return bound(window_hashes(words), measure)


@dataclass(frozen=True)
class Rule:
    """rejects: from the text and the array of its words to a boolean, never null."""

    name: str
    rejects: Callable[[Column, Column], Column]


#: Thresholds follow the usual web-corpus rules, set so that the labelled clean
#: documents of the test tables stay (see the README).
RULES = (
    Rule("min_words", lambda t, w: n_words(w) < 20),
    Rule("repeated_words", lambda t, w: repeated_words(w) * 100 > n_words(w) * 30),
    Rule("symbols", lambda t, w: symbols(t) * 10 > n_words(w)),
    Rule("exclamations", lambda t, w: F.coalesce(F.regexp_count(t, F.lit("!")), F.lit(0)) * 2 > n_words(w)),
    Rule("capitals", lambda t, w: capitals(t) * 2 > word_chars(w)),
    Rule("word_length", lambda t, w: (word_chars(w) > n_words(w) * 15) | (word_chars(w) < n_words(w) * 2)),
    Rule("dup_lines", lambda t, w: dup_lines(t) * 2 > n_words(worded_lines(t))),
    Rule("stutter", lambda t, w: stutters(w) * 10 > n_words(w) * 3),
)


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float


def estimate(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, runs: int = RUNS) -> list[Estimate]:
    """Cost and selectivity of each rule on about sample_rows rows, drawn from all, best first.

    A count sets the share drawn; every task draws its own rows, and they are written
    once, so that no rule reads the whole table. Only averages come back to the driver.
    The cost is a rule's seconds, the median of some runs, less those of a pass that
    makes the words alone.
    """
    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample = materialize(docs.select(column(docs, text).alias("t")).sample(share, 42), "sample")
    sample = sample.select("t", words_of(F.col("t")).alias("w"))

    def timed(reject: Column) -> tuple[float, float]:
        seconds, got = [], 0.0
        for _ in range(runs):
            began = time.perf_counter()
            got = sample.agg(F.avg(reject.cast("int")), F.sum(n_words(F.col("w")))).first()[0]
            seconds.append(time.perf_counter() - began)
        return median(seconds), got or 0.0

    timed(F.lit(False))  # the first runs also plan and compile
    base, _ = timed(F.lit(False))
    found = []
    for rule in rules:
        seconds, rejected = timed(rule.rejects(F.col("t"), F.col("w")))
        found.append(Estimate(rule.name, max(seconds - base, 1e-3), rejected))
    return sorted(found, key=lambda e: (-e.rejected / e.seconds, e.seconds, e.name))


def cascade(text: Column, words: Column, order: list[str], rules: tuple[Rule, ...] = RULES) -> Column:
    """The name of the first rule in that order which rejects; null if none does."""
    by_name = {r.name: r for r in rules}
    verdict = F
    for name in order:
        verdict = verdict.when(by_name[name].rejects(text, words), F.lit(name))
    return verdict.otherwise(F.lit(None).cast("string"))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that a generator makes, one row for each: filters on it stay above it, where
    the optimizer would otherwise copy the whole expression into them, several times."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def judge(docs: DataFrame, text: str = "text", out: str = "rejected_by", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with one more column: the rule that rejects the row, null if it is kept."""
    order = [e.name for e in estimate(docs, text, rules, sample_rows)]
    w = unused(docs, "words")
    worded = once(docs, w, words_of(column(docs, text)))
    return once(worded, out, cascade(column(worded, text), F.col(w), order, rules)).drop(w)


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that no rule rejects, columns unchanged."""
    out = unused(docs, "rejected_by")
    return judge(docs, text, out, rules).where(F.col(out).isNull()).select(*[column(docs, c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = [e.name for e in estimate(docs) if e.name not in ("min_words", "repeated_words")]
    words = docs.withColumn("w", words_of(F.col("text")))
    base = words.withColumn("n_repeat_words", repeated_words(F.col("w")))
    failed = (F.size("w") < 20) | (F.col("n_repeat_words") * 100 > n_words(F.col("w")) * 30)
    return base.select(
        "doc_id",
        n_words(F.col("w")).alias("n_words"),
        word_chars(F.col("w")).alias("word_chars"),
        symbols(F.col("text")).alias("n_symbols"),
        dup_lines(F.col("text")).alias("n_dup_lines"),
        "n_repeat_words",
        failed.alias("base_failed"),
        F.when(failed, False).otherwise(cascade(F.col("text"), F.col("w"), order).isNull()).alias("kept"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS s
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), dup AS (
  SELECT rid, unnest(starts) AS i FROM (SELECT rid, list(i) AS starts FROM win GROUP BY rid, s HAVING count(*) > 1)
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM dup, range(8) r(k) GROUP BY rid
), f AS (
  SELECT doc_id, text, w, lines, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid)
), g AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words
    OR 2 * len(regexp_extract_all(text, '!')) > n_words
    OR 2 * len(regexp_extract_all(text, '\p{Lu}')) > word_chars
    OR word_chars > 15 * n_words OR word_chars < 2 * n_words
    OR 2 * n_dup_lines > len(lines)
    OR 10 * len(list_filter(range(2, n_words + 1), lambda i: w[i] = w[i - 1])) > 3 * n_words) AS kept
FROM g
"""
