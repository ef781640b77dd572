"""Sharding by weighted rendezvous hashing of stable record keys.

A record's score on a shard is -ln(u) / weight, with u in (0, 1) hashed from
the key and the shard's number alone; the smallest score wins. Adding a shard
adds one score per record and changes no other, so records move only into the
new shard, and each shard's share is its weight's. `place` numbers the rows of
a shard without gaining an order over all of them in one task: rows go to
hash-ordered buckets, buckets are counted, and a row's slot is its bucket's
start plus its rank inside.

Defined results: a null key is the empty key; a null text has no bytes;
repeated rows go to one shard and take slots one after the other; an empty
table gives an empty result; columns other than the key and the text are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phonolake.llm.common import column, materialize, table

#: Hash bits that name a bucket: 4096 buckets a shard, a bound on the table of starts.
BUCKET_BITS = 12
#: Rows that one step of spreading equal rows makes at most.
SPREAD = 10_000


def hash52(*parts: Column) -> Column:
    """52 bits of an MD5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long")


def score(key: Column, shard: int, weight: float) -> Column:
    return -F.log((hash52(key, F.lit(shard)) + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard, from 0, that scores least; equal scores go to the lower number."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    return F.array_min(F.array(*[F.struct(score(key, i, w).alias("s"), F.lit(i).alias("i")) for i, w in enumerate(weights)]))["i"]


def starts(rows: DataFrame, n: str) -> DataFrame:
    """The first slot of each (shard, bucket), from the counts in column n."""
    counts = rows.groupBy("shard", "bucket").agg(F.sum(n).alias("in_bucket"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("shard", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("start"))


def place(docs: DataFrame, weights: list[float], new_weight: float | None = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard of every row of docs."""
    t = F.coalesce(column(docs, text), F.lit(""))
    slim = docs.select(column(docs, key).alias("doc_id"), (F.octet_length(t).cast("long") + 1).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    slim = slim.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    order = hash52(F.lit("slot"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32"), F.col("size"))
    keyed = slim.select(
        "*",
        shard_of(F.col("doc_id"), weights).alias("shard"),
        (shard_of(F.col("doc_id"), [*weights, new_weight]) if new_weight else F.lit(None).cast("int")).alias("grown_shard"),
        order.alias("place"),
        F.shiftright(order, 52 - BUCKET_BITS).cast("int").alias("bucket"),
    )
    keyed = materialize(keyed, "keyed")
    inside = Window.partitionBy("shard", "bucket").orderBy("place", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = keyed.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    # At most 4096 rows a shard, whatever the input: a proven bound.
    ranked = ranked.join(F.broadcast(starts(keyed, "n")), ["shard", "bucket"])
    first = F.col("start") + F.col("before")
    runs = ranked.select("*", first.alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SPREAD))).alias("run"))
    slots = F.sequence(F.col("first") + F.col("run") * SPREAD, F.col("first") + F.least(F.col("n"), (F.col("run") + 1) * SPREAD) - 1)
    return runs.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(slots).alias("slot"), "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents"), [1.0] * 8)


def _sql() -> str:
    u = lambda parts: f"CAST('0x' || substr(md5(concat_ws(':', {parts})), 1, 13) AS BIGINT)"
    scores = lambda n: ", ".join(f"{{'s': -ln(({u(f'k, {i}')} + 0.5::DOUBLE) / 4503599627370496::DOUBLE), 'i': {i}}}" for i in range(n))
    entry = lambda k: "0" if k == 0 else str(_crc_entry(k))
    entries = ", ".join(entry(k) for k in range(16))
    return f"""
WITH c AS (SELECT [{entries}]::BIGINT[] AS tbl),
d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, octet_length(encode(coalesce(text, ''))) AS n,
         string_split(lower(hex(encode(coalesce(text, '')))), '') AS hx
  FROM documents
), e AS (
  SELECT doc_id, k, CAST(n + 1 AS BIGINT) AS size,
    CASE WHEN n = 0 THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 2 * n),
      lambda i: CAST(strpos('0123456789abcdef', hx[i + 2 - 2 * (i % 2)]) - 1 AS BIGINT))),
      lambda a, b: xor(tbl[(xor(a, b) & 15) + 1], a >> 4)), 4294967295) END AS text_crc32
  FROM d, c
), f AS (
  SELECT *, list_min([{scores(8)}]).i AS shard, list_min([{scores(9)}]).i AS grown_shard,
    {u("'slot', k, text_crc32, size")} AS place
  FROM e
)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, size, text_crc32) - 1 AS BIGINT) AS slot,
  CAST(grown_shard AS INT) AS grown_shard
FROM f
"""


def _crc_entry(k: int) -> int:
    """CRC-32 of one half byte, by the reflected polynomial."""
    for _ in range(4):
        k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
    return k


ORACLE_SQL = _sql()
