"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A benchmark item's windows are its runs of WINDOW words (a shorter item is one
window). All shingles of a window must occur for the window to occur, so the
join's necessary prefix is one shingle: the one rarest in all documents. Each
document word opens a shingle; those that equal a prefix are candidates, cut by
position (the window must begin and end inside the document) and verified word
for word over the window. Up to BLOCK_WINDOWS distinct windows are broadcast, and
documents are read twice: to count shingles, and to match. More windows go by hash:
documents are still read once for each pass, their shingles meet the windows' by an
equality join of 64-bit hashes, and what meets goes back to the documents to be
verified. The items that a window stands for join only what was found.

Shingles compare under full lower-casing, which merges all that ASCII
lower-casing merges; the verification compares under ASCII lower-casing.

Defined results: a null or empty text has no words and is clean; an item
without words has no window; repeated rows are judged alike and each returned;
equal item texts and repeated item ids count as the ids they carry (a null
id names no item); an empty
table on either side gives clean documents or none; other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.llm.common import column, materialize, repeated, table, text_key, unused

WINDOW = 10
#: Words in a shingle of the prefix filter; one-word windows use one word.
SHINGLE = 2
#: Rows of windows, and of shingles, that are broadcast at most: some 10 MB.
BLOCK_WINDOWS = 100_000
#: 64-bit hashes that are broadcast at most: some 30 MB.
BROADCAST_HASHES = 1 << 20
#: Everything but digits, letters of either case, and code points past ASCII.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def raw_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAP), "")


def windows(items: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(item, win): the windows of each item, by their words."""
    w = items.select(column(items, key).cast("string").alias("item"), raw_words(ascii_lower(column(items, text))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    return w.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, size), " "))).alias("win")).distinct()


def _shingle(arr: str | Column, at: Column, n: int) -> list[Column]:
    """The keys of the shingle whose first word stands at place `at`, from 0."""
    return [F.lower(F.coalesce(F.get(arr, at + i), F.lit(""))).alias(f"k{i}") for i in range(n)]


def _opened(docs: DataFrame, n: int) -> DataFrame:
    """A row for each word of docs (column arr, from place 1), with the shingle it opens, and
    one for place 0, whose keys are empty: the document itself."""
    rows = docs.select("*", F.posexplode("arr").alias("pos", "word"))
    keys = [F.when(F.col("pos") == 0, F.lit("")).otherwise(F.lower(F.col("word") if i == 0 else F.coalesce(F.get("arr", F.col("pos") + i), F.lit("")))).alias(f"k{i}") for i in range(n)]
    return rows.select("*", *keys)


def _hashed(docs: DataFrame, n: int, hashes: DataFrame, *keep: str) -> DataFrame:
    """(keep, h): the shingles of docs that are among hashes (h), by one join whatever their number."""
    few = hashes.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES
    opened = _opened(docs, n).where("pos > 0").select(*keep, F.xxhash64(*[f"k{i}" for i in range(n)]).alias("h"))
    return opened.join(F.broadcast(hashes) if few else hashes, "h", "left_semi")


def _signed(docs: DataFrame, wins: DataFrame, n: int) -> DataFrame:
    """wins with the keys and the offset of each one's rarest shingle over all docs."""
    inside = F.transform(F.sequence(F.lit(0), F.col("len") - n), lambda i: F.struct(i.alias("off"), *_shingle(F.split("win", " "), i, n)))
    keys = [f"k{i}" for i in range(n)]
    each = materialize(wins.select("win", F.inline(inside)), "shingles")
    wanted = materialize(each.select(*keys).distinct(), "wanted")
    if wanted.count() <= BLOCK_WINDOWS:
        counts = _opened(docs, n).select(*keys).join(F.broadcast(wanted), keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    else:
        by_hash = wanted.select(F.xxhash64(*keys).alias("h"), *keys)
        found = _hashed(docs, n, by_hash.select("h").distinct()).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        counts = by_hash.join(found, "h").select(*keys, "n")
    ranked = each.join(counts, keys, "left").select("win", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", *keys).alias("s"))
    return wins.join(ranked.groupBy("win").agg(F.min("s").alias("s")), "win").select("win", "len", "s.off", *[f"s.{k}" for k in keys])


def _matches(docs: DataFrame, wins: DataFrame, n: int, alone: bool) -> DataFrame:
    """(doc_id, th, n_words, span, win) of occurrences; with alone, a row without a span for each document."""
    keys = [f"k{i}" for i in range(n)]
    signed = materialize(_signed(docs, wins, n), "signatures")
    if signed.count() > BLOCK_WINDOWS:
        return _far_matches(docs, signed, n, alone)
    if alone:
        blank = F.lit("")
        signed = signed.unionByName(docs.sparkSession.range(1).select(blank.alias("win"), F.lit(0).alias("len"), F.lit(0).alias("off"), *[blank.alias(k) for k in keys]))
    start = F.col("pos") - F.col("off")
    whole = (F.col("pos") > 0) & (F.col("len") > 0) & (start >= 1) & (start + F.col("len") - 1 <= F.col("n_words"))
    same = ascii_lower(F.array_join(F.slice("arr", start + 1, F.col("len")), " ")) == F.col("win")
    hit = F.when(whole, same).otherwise((F.col("pos") == 0) & (F.col("len") == 0))
    found = _opened(docs, n).join(F.broadcast(signed), keys).where(hit)
    return found.select("doc_id", "th", "n_words", F.when(F.col("len") > 0, F.struct(start.alias("start"), "len")).alias("span"), "win")


def _far_matches(docs: DataFrame, signed: DataFrame, n: int, alone: bool) -> DataFrame:
    """`_matches` for more windows than are broadcast: shingles and windows meet by hash."""
    by_hash = signed.select(F.xxhash64(*[f"k{i}" for i in range(n)]).alias("h"), "win", "len", "off")
    opened = materialize(_hashed(docs, n, by_hash.select("h").distinct(), "doc_id", "th", "n_words", "pos"), "opened")
    start = F.col("pos") - F.col("off")
    inside = (start >= 1) & (start + F.col("len") - 1 <= F.col("n_words"))
    near = opened.join(by_hash, "h").where(inside).select("doc_id", "th", F.struct(start.alias("start"), "len", "win").alias("at"))
    near = materialize(near.groupBy(F.col("doc_id").alias("own"), F.col("th").alias("own_th")).agg(F.collect_set("at").alias("near")), "candidates")
    held = docs.join(near, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("th") == F.col("own_th")))
    same = F.filter("near", lambda c: ascii_lower(F.array_join(F.slice("arr", c["start"] + 1, c["len"]), " ")) == c["win"])
    found = held.select("doc_id", "th", "n_words", F.inline(F.transform(same, lambda c: F.struct(F.struct(c["start"].alias("start"), c["len"].alias("len")).alias("span"), c["win"].alias("win")))))
    if not alone:
        return found
    return found.union(docs.select("doc_id", "th", "n_words", F.lit(None).cast(found.schema["span"].dataType).alias("span"), F.lit("").alias("win")))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """For each row of docs: doc_id, th (its text's key), n_words, n_hit, the item ids found, and contaminated."""
    t = column(docs, text)
    slim = docs.select(column(docs, key).alias("doc_id"), text_key(t).alias("th"), F.concat(F.array(F.lit("")), raw_words(t)).alias("arr"))
    slim = slim.withColumn("n_words", (F.size("arr") - 1).cast("long"))
    sources = materialize(windows(items, item_key, item_text, size), "windows")
    wins = sources.select("win").distinct().withColumn("len", F.size(F.split("win", " ")))
    found = _matches(slim, wins.where(F.col("len") >= SHINGLE), SHINGLE, alone=True)
    single = wins.where(F.col("len") < SHINGLE)
    if single.limit(1).count():
        found = found.union(_matches(slim, single, 1, alone=False))
    found = materialize(found, "found")
    rows = found.groupBy("doc_id", "th").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.col("span").isNull().cast("long")).alias("copies"),
        F.sort_array(F.collect_set("span")).alias("spans"),
    )
    held = found.where("span IS NOT NULL").select(F.col("doc_id").alias("at"), F.col("th").alias("at_th"), "win").distinct().join(sources, "win")
    held = held.groupBy("at", "at_th").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = rows.join(held, F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("th") == F.col("at_th")), "left")
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s["start"] + s["len"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(s["start"], acc["end"]))).cast("long").alias("n")),
        lambda acc: acc["n"],
    )
    out = rows.select("doc_id", "th", "n_words", covered.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.size("spans") > 0).alias("contaminated"), "copies")
    return repeated(out, "copies")


def keep_clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark window, columns unchanged."""
    bad = contamination(docs, items, key, text).where("contaminated").select("doc_id", "th").distinct()
    th, bad_id, bad_th = (unused(docs, x) for x in ("th", "bad_id", "bad_th"))
    with_key = docs.withColumn(th, text_key(column(docs, text)))
    bad = materialize(bad.select(F.col("doc_id").alias(bad_id), F.col("th").alias(bad_th)), "contaminated")
    kept = with_key.join(bad, column(with_key, key).eqNullSafe(F.col(bad_id)) & (F.col(th) == F.col(bad_th)), "left_anti")
    return kept.select(*[column(kept, c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win),
seen AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, sizes WHERE len(w) >= n)
), hit AS (SELECT rid, item, i, n FROM seen JOIN win USING (n, s)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
