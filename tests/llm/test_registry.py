"""Registered queries against their SQL, and the pipeline as a whole."""

import collections
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from phonolake.llm import op2_simhash, op4_secrets, op7_decontaminate, op10_quality, registry, tokens

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = registry.QUERIES[name](spark, DATA)
    want = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert collections.Counter(tuple(r[c] for c in names) for r in got.collect()) == collections.Counter(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_without_sql(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_names_are_one_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows, n = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, DATA).cache()
        assert rows.columns == docs.columns, name
        n.append(rows.count())
    good = op10_quality.judge(docs).where("rejected_by IS NULL").count()
    assert n[0] == good and n[0] >= n[1] >= n[2] == n[3] > 0
    texts = {r.doc_id: r.text for r in rows.collect()}
    assert not any(op4_secrets.base_spans(t) for t in texts.values())
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert op7_decontaminate.contamination(rows, bench).where("contaminated").count() == 0
    # No two kept texts share four fifths of their five-word shingles.
    sets = [frozenset(zip(*(w[i:] for i in range(5)), strict=False)) or frozenset([tuple(w)]) for w in (t.lower().split() for t in texts.values())]
    assert not any(5 * len(a & b) >= 4 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    packed = corpus_pipeline.run(spark, DATA)
    total = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert total == {i: len(tokens.tokenizer().encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_near_duplicates_are_those_of_brute_force(spark):
    """Over a whole table: of each component of pairs at 0.8 or more the smallest id stays, and nothing else goes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    sets = [frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (t.encode().lower().split() for _, t in rows)]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    pairs = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
                pairs += 1
    assert pairs > 50
    assert sorted(r.doc_id for r in op2_simhash.keep_one(docs).select("doc_id").collect()) == [i for k, (i, _) in enumerate(rows) if root(k) == k]


def test_pipeline_over_awkward_and_empty_tables(spark, tmp_path, docs, empty):
    import corpus_pipeline

    bench = spark.createDataFrame([("b1", "nothing of this stands in any text at all here now"), ("b2", None), (None, "")], "item_id string, text string")
    for name, table in (("awkward", docs), ("empty", empty)):
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        rows = spark.read.parquet(f"{folder}/documents.parquet")
        for step, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, folder)
            assert rows.columns == docs.columns, step
        kept = collections.Counter(r.doc_id for r in rows.collect())
        packed = corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()
        assert {r.doc_id for r in packed} == set(kept) and max(kept.values(), default=1) <= 2
        if name == "awkward":
            assert {1, 8, 9, 12} <= set(kept) and not set(kept) & {2, 3, 4, 5, 6, 7, 16, 17, 18, 19}


def test_fingerprint_lengths():
    assert op2_simhash.fingerprint("a b c d", 3, 4)[0] == op2_simhash.fingerprint("A  b\tc d", 3)[0]
