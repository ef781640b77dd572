"""Ranks, running sums and quantiles of large groups against plain ones."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from phonolake.operators import ranks


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    made = []
    for i in range(4000):
        value = None if i % 97 == 0 else float(rng.integers(0, 300)) if i % 2 else float(rng.standard_normal() * 50)
        made.append((["a", "a", "a", "b", None][int(rng.integers(0, 5))], i // 2, i, value, int(rng.integers(0, 9)) or None))
    made += [("few", 1, 5000 + i, float(i), 1) for i in range(3)] + [("none", 1, 6000, None, None)]
    return spark.createDataFrame(made, "g string, at long, id long, v double, n int").repartition(5).cache()


def test_running_sums(rows):
    got = {r.id: r.used for r in ranks.running_sum(rows, ["g"], ["at", "id"], "n", "used").collect()}
    w = Window.partitionBy("g").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    assert got == {r.id: r.used for r in rows.withColumn("used", F.sum("n").over(w)).collect()}


def test_upper_halves(rows):
    some = rows.where("v IS NOT NULL")
    w = Window.partitionBy("g")
    ranked = some.withColumn("k", F.row_number().over(w.orderBy(F.col("v").desc(), F.col("id").desc()))).withColumn("m", F.count(F.lit(1)).over(w))
    want = sorted(r.id for r in ranked.where("m <= 5 OR k <= greatest(5, floor(m / 2))").collect())
    got = ranks.upper_half(some, ["g"], "v", ["id"])
    assert got.columns == some.columns and sorted(r.id for r in got.collect()) == want


def test_quantiles(rows):
    shares = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = {r.g: r.q for r in ranks.quantiles(rows, ["g"], ["v", "n"], shares, "q").collect()}
    for i, c in enumerate(("v", "n")):
        held = {}
        for r in rows.collect():
            if r[c] is not None:
                held.setdefault(r.g, []).append(r[c])
        assert {g for g in got if got[g][i] is not None} == held.keys()
        for g, values in held.items():
            assert got[g][i] == pytest.approx(np.quantile(values, shares).tolist())


def test_nothing(rows):
    none = rows.limit(0)
    assert ranks.running_sum(none, ["g"], ["at"], "n", "used").count() == ranks.upper_half(none, ["g"], "v", ["id"]).count() == ranks.quantiles(none, ["g"], ["v"], [0.5], "q").count() == 0


def test_bounded_groups_give_the_same(rows):
    from phonolake.operators import statistics

    some = rows.where("v IS NOT NULL AND g IS NOT NULL")
    near, far = (statistics.energetic_half(some, ["g"], "v", ["id"], bounded=b) for b in (True, False))
    assert sorted(r.id for r in near.collect()) == sorted(r.id for r in far.collect())
    one, two = (sorted(map(tuple, statistics.formant_summary(some, ["g"], ["v", "n"], bounded=b).collect())) for b in (True, False))
    assert len(one) == len(two) == 3
    for a, b in zip(one, two, strict=True):
        assert a == pytest.approx(b)
