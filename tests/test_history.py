"""The append-only history through its life."""

import pytest

from phonolake.sources.history import History


@pytest.fixture
def history(spark, tmp_path):
    return History(spark, str(tmp_path / "h"))


def test_conversations(history):
    assert history.conversations().count() == 0
    a = history.create("u", "t" * 100, at=1.0)
    b = history.create("u", "second", at=2.0)
    history.create("v", "other", at=3.0)
    assert [r.id for r in history.listed("u").collect()] == [b, a] and len(history.listed("u").first().title) <= 80
    history.add_messages(a, [("user", "q", ["x.wav"]), ("assistant", "r", [])], at=9.0)
    assert [r.id for r in history.listed("u").collect()] == [a, b]
    assert [(r.role, r.files) for r in history.messages_of(a).collect()] == [("user", ["x.wav"]), ("assistant", [])]
    assert history.touch(b, "renamed", at=20.0) and not history.touch("nobody")
    assert history.listed("u").first().title == "renamed"
    history.delete(a)
    assert history.owner(a) is None and history.messages_of(a).count() == 0 and history.owner(b) == "u"


def test_exchange_needs_the_owner(history):
    a = history.exchange("u", None, "question", "answer")
    assert history.exchange("u", a, "more", "yes") == a and history.messages_of(a).count() == 4
    other = history.exchange("v", a, "mine?", "no")
    assert other != a and history.owner(other) == "v"


def test_measurements(spark, history):
    rows = [("u", "100", "a.wav", "120.5", None, None, "20"), ("u", "50", "b.wav", "bad", None, None, None), ("u", "0", "c", None, None, None, None), ("u", None, "d", "1", None, None, None), ("u", "9999", "e", "1", None, None, None)]
    refused = history.measure(spark.createDataFrame(rows, "user_key string, ts string, file string, f0 string, jitter string, shimmer string, hnr string"), now=1000.0)
    assert {r.file for r in refused.collect()} == {"b.wav", "c", "e"}
    assert [(r.ts, r.file) for r in history.measurements_of("u").collect()] == [(100.0, "a.wav"), (1000.0, "d")]
    history.clear("u")
    assert history.measurements_of("u").count() == 0


def test_compaction_changes_no_view(spark, history):
    a = history.exchange("u", None, "question", "answer", ["x.wav"])
    b = history.exchange("u", None, "second", "answer")
    c = history.exchange("v", None, "third", "answer")
    for k in range(4):
        history.touch(b, f"title {k}", at=2e9 + k)
    history.delete(c)
    rows = [("u", str(100 + k), "a.wav", "120.5", None, None, "20") for k in range(3)]
    kinds = "user_key string, ts string, file string, f0 string, jitter string, shimmer string, hnr string"
    history.measure(spark.createDataFrame(rows, kinds), now=1000.0)
    history.measure(spark.createDataFrame([("w", *r[1:]) for r in rows], kinds), now=1000.0)
    history.clear("w")
    views = lambda: [sorted(map(tuple, v().collect()), key=repr) for v in (history.conversations, history.messages, history.measurements)]
    before = views()
    assert [len(v) for v in before] == [2, 4, 3]
    for name in ("messages", "conversations", "measurements"):
        history.compact(name)
    assert views() == before
    assert history.log("conversations").count() == 3 and history.log("messages").count() == 4 and history.log("measurements").count() == 3
    assert history.owner(c) is None and history.messages_of(c).count() == 0 and history.messages_of(a).first()["files"] == ["x.wav"]
    history.add_messages(a, [("user", "more", [])])
    assert history.messages_of(a).count() == 3 and history.listed("u").count() == 2


def test_one_key_reads_one_folder(history):
    a = history.exchange("u", None, "question", "answer")
    plan = history.log("messages", a)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
