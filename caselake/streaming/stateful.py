"""Stateful streams: the case fold and request deadlines as state processors, windows with quantiles, deduplication, and
current-state tables that a stream keeps.

State processors need the RocksDB state store, which ``with_rocksdb`` sets for the start of a stream. What a trigger brings of a
case is sorted together, so the bytes of a trigger bound it; state is read and written by key."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import cases as S

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


#: Entries of a case's receipts, answers and ratings that lie in its own state, each; what comes beyond them has a state by key.
INLINE = 64


class Kept:
    """Entries of a case by key. The first INLINE of them come and go with the case; of those beyond, only keys that events
    name are read, once a trigger, and the changed ones written when it ends."""

    def __init__(self, held: dict | None, stored: bool, state, into: Callable = lambda v: (v,), out: Callable = lambda v: v[0]) -> None:
        self.held, self.stored, self.state, self.into, self.out = dict(held or {}), stored, state, into, out
        self.found: dict = {}
        self.changed: set = set()

    def _get(self, key: str):
        if key in self.held:
            return self.held[key]
        if key not in self.found:
            self.found[key] = self.state.getValue(Row(key)) if self.stored else None
        return self.found[key]

    def __contains__(self, key: str | None) -> bool:
        return key is not None and self._get(key) is not None

    def __getitem__(self, key: str):
        return self.out(self._get(key))

    def __setitem__(self, key: str | None, value) -> None:
        if key is None:
            return
        if key in self.held or len(self.held) < INLINE:
            self.held[key] = self.into(value)
        else:
            self.found[key] = self.into(value)
            self.changed.add(key)

    def append(self, key: str | None) -> None:
        self[key] = True

    def write(self) -> None:
        for key in sorted(self.changed):
            self.state.updateValue(Row(key), Row(*self.found[key]))

    def inner(self) -> dict:
        """The entries that go with the case."""
        return {key: tuple(value) for key, value in self.held.items()}


SCALARS = {"status": "string", "version": "long", "active": "string", "accepted_at": "long", "answer": "string", "later": "boolean", "clarified": "int", "ticket": "string", "messages": "int"}
MAPS = {"seen": "body string", "answers": "there boolean", "feedback": "useful boolean, solved boolean"}


class CaseFold(StatefulProcessor):
    """The fold of cases.apply_event: a value state for each case, with its first receipts, answers and ratings; map states by
    their key for the rest (T1). A case is read once a trigger, and written if an event changed it; most are refused."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        inner = [f"{m} map<string, struct<{', '.join(':'.join(f.split()) for f in v.split(', '))}>>, {m}_stored boolean" for m, v in MAPS.items()]
        self.case = handle.getValueState("case", ", ".join([*(f"{k} {v}" for k, v in SCALARS.items()), *inner]))
        self.maps = {m: handle.getMapState(m, "key string", v) for m, v in MAPS.items()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        before = self.case.get()
        scalars = tuple(before[: len(SCALARS)]) if before is not None else tuple(S.NEW[k] for k in SCALARS)
        inner = before[len(SCALARS) :] if before is not None else (None, False) * len(MAPS)
        ways = {"feedback": (lambda v: (v.get("useful"), v.get("solved")), lambda v: {k: g for k, g in zip(("useful", "solved"), v, strict=True) if g is not None})}
        kept = {m: Kept(inner[2 * i], inner[2 * i + 1], self.maps[m], *ways.get(m, ())) for i, m in enumerate(MAPS)}
        state, changed = dict(zip(SCALARS, scalars, strict=True)) | kept, False
        for e in sorted((r.asDict() for r in rows), key=lambda r: (r["ts"] is None, r["ts"], r["event_id"] is None, r["event_id"])):
            ok, why, cancelled = S.apply_event(state, e)
            changed |= ok  # what is refused changes nothing
            yield Row(case_id=key[0], event_id=e["event_id"], accepted=ok, reason=why, version=state["version"], status=state["status"], ticket=state["ticket"], cancelled=cancelled)
        if changed:
            self.case.update((*(state[k] for k in SCALARS), *(x for k in kept.values() for x in (k.inner(), k.stored or bool(k.changed)))))
            for k in kept.values():
                k.write()

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame) -> DataFrame:
    """The case fold over a stream of commands, a row for each event; started within with_rocksdb."""
    return events.withColumn("ts", F.unix_micros("ts")).groupBy("case_id").transformWithState(CaseFold(), S.RESULT, "Append", "None")


REQUEST = "case_id long, request_key string, status string, error_code string, retryable boolean"


class Deadlines(StatefulProcessor):
    """A request in flight ends as done by a result within its time, and as a retryable error by a timer once the watermark
    has passed its deadline; results that come later find it ended (T8). Rows as such, as a frame for each of many small keys
    costs more than what is done with it."""

    def __init__(self, seconds: float) -> None:
        self.millis = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.request = handle.getValueState("request", "created long, status string")

    def ended(self, key, status: str, code: str | None = None) -> Row:
        return Row(case_id=key[0], request_key=key[1], status=status, error_code=code, retryable=code is not None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        told = sorted((r["at"], r["event_id"], r["kind"]) for r in rows)
        before = self.request.get()
        created, status = before if before is not None else (None, None)
        out = []
        for micros, _id, kind in told:
            at = micros // 1000
            if status is None and kind == "message":
                created, status = at, "in_flight"
            elif status == "in_flight" and kind == "result" and at <= created + self.millis:
                status = "done"
                out.append(self.ended(key, "done"))
        if status == "in_flight" and before is None:
            self.handle.registerTimer(created + self.millis)
        elif status == "done" and before is not None and before[1] == "in_flight":
            self.handle.deleteTimer(created + self.millis)
        if status and (before is None or status != before[1]):
            self.request.update((created, status))
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        created, status = self.request.get() or (None, None)
        if status == "in_flight":
            self.request.update((created, "error"))
            yield self.ended(key, "error", "RESTARTED")

    def close(self) -> None:
        pass


def request_deadlines(events: DataFrame, seconds: float, late: str = "0 seconds") -> DataFrame:
    """events (case_id, request_key, event_id, ts, kind) -> how each request ended; started within with_rocksdb.

    Only messages and results come to the state, but all events move the watermark: the condition names ts, so that it stays
    above it."""
    told = events.withWatermark("ts", late).where(F.when(F.col("ts").isNotNull(), F.col("kind")).isin("message", "result"))
    keyed = told.withColumn("at", F.unix_micros("ts")).groupBy("case_id", "request_key")
    return keyed.transformWithState(Deadlines(seconds), REQUEST, "Append", "EventTime")


#: Bins of the quantile state: BIN_WIDTH each from 0 on; what lies beyond falls into the first or last.
BINS, BIN_WIDTH = 64, 0.5


def bin_of(value: Column) -> Column:
    return F.least(F.greatest(F.floor(value / BIN_WIDTH), F.lit(0)), F.lit(BINS - 1)).cast("int")


def quantile_of(counts: Column, share: float) -> Column:
    """Lower edge of the bin that holds the value of rank ceil(share * n); null without values."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("bin"))
    step = lambda a, n: F.struct((a["sum"] + n).alias("sum"), (a["bin"] + (a["sum"] + n < F.ceil(total * share)).cast("int")).alias("bin"))
    return F.when(total > 0, F.aggregate(counts, start, step)["bin"] * F.lit(BIN_WIDTH))


def sliding_quantiles(events: DataFrame, *, ts: str = "ts", by: str = "event_type", size: str = "1 hour", slide: str = "30 minutes", late: str = "1 hour", share: float = 0.95) -> DataFrame:
    """start, end, by, n, quantile of value by sliding window. Counts by bin are the state: they add up, whatever comes
    late or from other tasks, and the quantile is exact to the bin (T9)."""
    counted = [F.count_if(bin_of(F.col("value")) == i).alias(f"b{i}") for i in range(BINS)]
    g = events.withWatermark(ts, late).groupBy(F.window(ts, size, slide).alias("w"), by).agg(F.count("*").alias("n"), *counted)
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", quantile_of(F.array(*[f"b{i}" for i in range(BINS)]), share).alias("quantile"))


def deduplicated(events: DataFrame, keys: list[str], *, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once: repeats within ``late`` of the first vanish, later ones are too late for the watermark, so a key's
    state is dropped after that time (T2)."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


class CurrentTable:
    """The newest row of each key, kept by a stream's foreachBatch: a folder in the shared file system.

    A batch rewrites the buckets that its keys fall in, below a folder of its own number, from what earlier batches
    committed; creating its marker commits it. So a batch that broke off and comes again finds the same state as before, and one
    that was committed changes nothing."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: list[str], schema: str, buckets: int = 16) -> None:
        self.spark, self.path, self.key, self.order, self.schema, self.buckets = spark, path, key, order, schema, buckets

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def commits(self) -> dict[int, list[int]]:
        """Committed batches with the buckets that each rewrote."""
        fs, p = self._fs(f"{self.path}/commits")
        if not fs.exists(p):
            return {}
        said = [json.loads(r["value"]) for r in self.spark.read.text(f"{self.path}/commits").collect()]  # a line a batch
        return {c["batch"]: c["buckets"] for c in sorted(said, key=lambda c: c["batch"])}

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows as of the last commit, or of the last before a batch."""
        newest: dict[int, int] = {}
        for batch, buckets in self.commits().items():
            if before is None or batch < before:
                newest |= dict.fromkeys(buckets, batch)
        paths = [f"{self.path}/data/{b}/bucket={k}" for k, b in newest.items() if only is None or k in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def newest(self, rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in self.key]
        last = F.max_by(F.struct(*values), F.struct(*self.order)).alias("_last")
        return rows.groupBy(*self.key).agg(last).select(*self.key, *[F.col(f"_last.{c}").alias(c) for c in values])

    def upsert(self, rows: DataFrame, batch: int) -> None:
        """foreachBatch(table.upsert)."""
        if batch in self.commits():
            return
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        new = self.newest(rows).persist()
        touched = sorted(r[0] for r in new.select(bucket).distinct().collect())  # numbers of buckets
        old = self.read(batch, touched).select(*new.columns)
        self.newest(old.unionByName(new)).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{batch}")
        new.unpersist()
        self._commit(batch, touched)

    def _commit(self, batch: int, buckets: list[int]) -> None:
        fs, p = self._fs(f"{self.path}/commits/{batch:012d}")
        out = fs.create(p, True)
        out.write(bytearray((json.dumps({"batch": batch, "buckets": buckets}) + "\n").encode()))
        out.close()


def run_slices(slices: list[DataFrame], folder: str, source: Callable[[str], DataFrame], start: Callable) -> None:
    """Appends each slice to the folder and runs the stream until it has read it: a trigger or more for each, with a restart from
    the checkpoint between them."""
    for rows in slices:
        rows.write.mode("append").parquet(folder)
        start(source(folder)).awaitTermination()
