"""State that streams keep: several triggers, restarts, broken attempts, quantiles by bins."""

import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from caselake.streaming import cases as S
from caselake.streaming import stateful as P

SCHEMA = "id long, v string, n long"


def test_current_table_after_a_broken_batch(spark, tmp_path):
    """A batch that wrote but didn't commit is invisible and comes again; a committed one changes nothing."""
    table = P.CurrentTable(spark, str(tmp_path / "t"), ["id"], ["n"], SCHEMA, buckets=4)
    rows = lambda *x: spark.createDataFrame(list(x), SCHEMA)
    held = lambda: sorted(map(tuple, table.read().collect()))
    assert held() == []
    table.upsert(rows((1, "a", 1), (2, "b", 5), (1, "c", 3)), 0)
    assert held() == [(1, "c", 3), (2, "b", 5)]
    commit, table._commit = table._commit, lambda *a: (_ for _ in ()).throw(RuntimeError("killed"))
    second = rows((2, "old", 4), (3, None, 1), (1, "d", 9))
    with pytest.raises(RuntimeError):
        table.upsert(second, 1)
    assert held() == [(1, "c", 3), (2, "b", 5)]
    table._commit = commit
    for _ in range(2):
        table.upsert(second, 1)
        assert held() == [(1, "d", 9), (2, "b", 5), (3, None, 1)]
    table.upsert(rows((1, "stale", 0)), 0)
    table.upsert(rows(), 2)
    assert held() == [(1, "d", 9), (2, "b", 5), (3, None, 1)]


def test_quantiles_of_bins(spark):
    rng = random.Random(1)
    rows = [(k, rng.uniform(-1, 40)) for k in range(5) for _ in range(1 + 30 * k)]
    df = spark.createDataFrame(rows, "k long, value double")
    counts = [F.count_if(P.bin_of(F.col("value")) == i).alias(f"b{i}") for i in range(P.BINS)]
    got = df.groupBy("k").agg(*counts).select("k", P.quantile_of(F.array(*[f"b{i}" for i in range(P.BINS)]), 0.95).alias("q")).collect()
    for r in got:
        bins = sorted(min(max(math.floor(v / 0.5), 0), 63) for k, v in rows if k == r["k"])
        assert r["q"] == bins[math.ceil(0.95 * len(bins)) - 1] * 0.5
    assert df.select(P.quantile_of(F.array(*[F.lit(0)] * P.BINS), 0.5).alias("q")).first()["q"] is None


EVENTS = "case_id long, request_key string, event_id long, ts timestamp, kind string"


def test_deadlines_over_triggers(spark, tmp_path):
    """In time, late, never answered and still open requests; events of one trigger come in any order."""
    slices = [
        [(1, "a", 1, 0, "message"), (1, "a", 2, 5, "result"), (2, "b", 3, 0, "message"), (3, None, 4, 1, "message"), (5, "x", 9, 2, "result")],
        [(2, "b", 6, 40, "result"), (2, "b", 5, 12, "message"), (4, "c", 7, 45, "message"), (3, None, 8, 9, "other")],
        [(6, "z", 10, 50, "message")],
    ]
    out, folder = str(tmp_path / "out"), str(tmp_path / "in")
    frames = [spark.createDataFrame(s, "case_id long, request_key string, event_id long, m int, kind string").select("case_id", "request_key", "event_id", F.expr("timestamp_seconds(1700000000 + 60 * m)").alias("ts"), "kind") for s in slices]
    start = lambda e: P.request_deadlines(e, 600).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    with P.with_rocksdb(spark):
        P.run_slices(frames, folder, lambda f: spark.readStream.schema(EVENTS).parquet(f), start)
    got = sorted(map(str, (tuple(r) for r in spark.read.schema(P.REQUEST).parquet(out).collect())))
    assert got == sorted(map(str, [(1, "a", "done", None, False), (2, "b", "error", "RESTARTED", True), (3, None, "error", "RESTARTED", True)]))
    assert "RocksDB" not in spark.conf.get(P.PROVIDER)


class Calls:
    """Stands in for the state store; counts what is asked of it."""

    def __init__(self) -> None:
        self.case, self.maps, self.asked = None, {}, []

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def getMapState(self, name, key, schema):  # noqa: N802
        return CountedMap(self.maps.setdefault(name, {}), self.asked, name)

    def get(self):
        self.asked.append("get")
        return self.case

    def update(self, case) -> None:
        self.asked.append("update")
        self.case = case


class CountedMap:
    def __init__(self, rows, asked, name) -> None:
        self.rows, self.asked, self.name = rows, asked, name

    def getValue(self, key):  # noqa: N802
        self.asked.append(f"read {self.name} {key[0]}")
        return self.rows.get(key[0])

    def updateValue(self, key, value) -> None:  # noqa: N802
        self.asked.append(f"write {self.name} {key[0]}")
        self.rows[key[0]] = tuple(value)


def told(i: int, kind: str, key: str, body: str = "b", **more) -> dict:
    return {"event_id": i, "ts": i, "kind": kind, "request_key": key, "body_hash": body, "expected_version": None, "outcome": None, "useful": None, "solved": None} | more


def test_case_state_is_asked_once_a_trigger():
    """refused events and a case's first entries ask nothing of the store; of entries beyond them each key is read once."""
    store, fold = Calls(), P.CaseFold()
    fold.init(store)
    trigger = lambda events: [r["reason"] for r in fold.handleInputRows((1,), iter([Row(**e) for e in events]), None)]
    assert set(trigger([told(i, "feedback", f"r{i}", solved=True) for i in range(100)])) == {"not_found"}
    assert store.asked == ["get"] and store.case is None
    opening = [told(100, "message", "m"), told(101, "result", "m", outcome="handoff_offered"), told(102, "handoff", "h")]
    assert trigger(opening + [told(200 + i, "handoff", f"h{i}") for i in range(P.INLINE)]) == ["", "", ""] + ["existing_ticket"] * P.INLINE
    assert [a for a in store.asked if not a.startswith("write")] == ["get", "get", "update"]
    assert len(store.maps["seen"]) == 2
    del store.asked[:]
    assert trigger([told(400 + i, "handoff", f"h{i % P.INLINE}", "other" if i % 2 else "b") for i in range(3 * P.INLINE)]) == ["replay", "conflict"] * (3 * P.INLINE // 2)
    assert sorted(store.asked) == ["get", f"read seen handoff:h{P.INLINE - 2}", f"read seen handoff:h{P.INLINE - 1}"]


def test_long_cases_over_triggers(spark, tmp_path):
    """more receipts, answers and ratings than lie in a case's own state; the stream tells what the batch fold tells."""
    rows = []
    for case in (1, 2, None):
        turn = [("message", "m", {}), ("result", "m", {"outcome": "handoff_offered"}), ("handoff", "h", {})]
        for i in range(2 * P.INLINE):
            turn += [("handoff", f"h{i}", {}), ("reply", f"a{i}", {"solved": False}), ("feedback", f"a{i}", {"solved": False}), ("feedback", f"a{i // 2}", {"useful": True}), ("reply", f"a{i // 3}", {"body_hash": "c"}), ("feedback", f"a{i // 2}", {})]
        rows += [(case, *told(n, kind, key, **more).values()) for n, (kind, key, more) in enumerate(turn)]
    frame = spark.createDataFrame(rows, "case_id long, event_id long, n int, kind string, request_key string, body_hash string, expected_version long, outcome string, useful boolean, solved boolean")
    events = frame.select("case_id", "event_id", F.expr("if(n = 765, null, timestamp_seconds(1700000000 + n div 2))").alias("ts"), *frame.columns[3:]).orderBy(F.desc("event_id"))
    slices = [events.where(c) for c in ("event_id < 150", "event_id >= 150 and event_id < 420", "event_id >= 420")]
    out = str(tmp_path / "out")
    start = lambda e: P.fold_stream(e).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    with P.with_rocksdb(spark):
        P.run_slices(slices, str(tmp_path / "in"), lambda f: spark.readStream.schema(S.EVENT).parquet(f), start)
    got, want = (sorted(map(str, df.collect())) for df in (spark.read.schema(S.RESULT).parquet(out), S.fold_batch(events)))
    assert got == want
    assert max(r["version"] for r in spark.read.schema(S.RESULT).parquet(out).collect()) > 2 * P.INLINE
