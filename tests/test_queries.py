"""Every query that has one against its SQL twin, and the others for rows."""

import duckdb
import pytest

from phonolake.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    rows, columns = got.collect(), sorted(got.columns)
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    want = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    pick = lambda row, where: tuple(row[where(c)] for c in columns)
    assert sorted((pick(r, lambda c: c) for r in rows), key=repr) == sorted((pick(r, names.index) for r in want.fetchall()), key=repr)


def test_flagship(spark):
    assert registry.flagship(spark, DATA).count() > 0


def test_queries_are_the_same_over_many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    run = lambda: sorted(map(tuple, registry.QUERIES["perturb_shimmer"](spark, DATA).collect()))
    one = run()
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert run() == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_formant_rates_agree_with_the_kernel(spark):
    from pyspark.sql import functions as F

    from phonolake.functions.scalar import formant_rate
    from phonolake.kernels.audio import formant_rate as factors

    for r in spark.range(8000, 100_000, 379).select("id", formant_rate(F.col("id").cast("int"), 5500.0).alias("f")).collect():
        up, down = factors(r.id, 5500.0)
        assert r.f == r.id * up // down, r.id


def test_nearest_match_takes_values_of_zero(spark, tmp_path):
    from datetime import datetime

    pairs = [(5.0, 2.5), (5.0, 0.0), (0.0, 5.0), (0.0, 0.0), (-5.0, 5.0), (-5.0, 0.0), (-5.0, -2.5), (None, 0.0), (5.0, None), (5.0, -0.0), (float("nan"), 5.0)]
    rows = [(2 * u + k, datetime(2024, 1, 1, 0, k), u, kind, v, "") for u, pair in enumerate(pairs) for k, (kind, v) in enumerate(zip(("view", "click"), pair, strict=True))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(registry.ORACLE_SQL["nearest_match"]).fetchall()
    got = [tuple(r) for r in registry.QUERIES["nearest_match"](spark, str(tmp_path)).collect()]
    assert len(got) == len(pairs)
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_recordings_and_their_frames_are_not_broadcast(spark):
    plan = registry.QUERIES["condition_agreement"](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    joins = [line.partition("Join ")[2] for line in plan.splitlines() if "BroadcastNestedLoopJoin" in line]
    assert joins and all(j.startswith("BuildRight") for j in joins)  # the conditions
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
