"""Streaming queries and their batch twins, source and sink queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import cases as C
from ..registry import query, read
from ..sources import io, publish
from ..streaming import cases as S
from ..streaming import stateful as P

RAW = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def shared(spark, name: str) -> str:
    """A fresh path in the folder that the cluster shares; in local mode, where none is named, a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(named or tempfile.mkdtemp()).rstrip('/')}/caselake/{name}-{uuid.uuid4().hex}"


def commands(events):
    """events as case commands: the type gives the kind, each user is a case."""
    kind = F.create_map(*[F.lit(x) for x in ("view", "message", "click", "result", "purchase", "feedback", "signup", "handoff", "error", "policy")])
    previous = F.concat(F.lit("r"), F.floor(F.col("event_id") / 500).cast("string"))
    return events.select(
        F.col("user_id").alias("case_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.try_element_at(kind, F.col("event_type")), F.lit("reply")).alias("kind"),
        previous.alias("request_key"), F.md5("props").alias("body_hash"), F.when(F.col("value") > 12, F.col("event_id") % 5).alias("expected_version"), F.when(F.col("value") > 9, "handoff_offered").when(F.col("value") > 7, "clarify").otherwise("answer").alias("outcome"),
        F.when(F.col("event_id") % 3 > 0, F.col("value") > 5).alias("useful"), F.when(F.col("event_id") % 2 > 0, F.col("value") > 5).alias("solved"),
    )


#: The fold as SQL: one event of each case at a step.
FOLD = """e AS (SELECT user_id AS case_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE event_type WHEN 'view' THEN 'message' WHEN 'click' THEN 'result' WHEN 'purchase' THEN 'feedback' WHEN 'signup' THEN 'handoff' WHEN 'error' THEN 'policy' ELSE 'reply' END AS kind,
  'r' || event_id // 500 AS key, md5(props) AS body, CASE WHEN value > 12 THEN event_id % 5 END AS expected, CASE WHEN value > 9 THEN 'handoff_offered' WHEN value > 7 THEN 'clarify' ELSE 'answer' END AS outcome,
  CASE WHEN event_id % 3 > 0 THEN value > 5 END AS useful, CASE WHEN event_id % 2 > 0 THEN value > 5 END AS solved FROM events),
e2 AS (SELECT *, CASE kind WHEN 'message' THEN 'chat' WHEN 'policy' THEN 'chat' WHEN 'handoff' THEN 'handoff' WHEN 'reply' THEN 'operator_reply' END || ':' || key AS receipt FROM e),
s AS (SELECT case_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, '' AS kind, false AS accepted, '' AS reason, CAST(0 AS BIGINT) AS version, 'open' AS status, CAST(NULL AS VARCHAR) AS ticket, CAST(NULL AS VARCHAR) AS cancelled, CAST(NULL AS VARCHAR) AS active, CAST(NULL AS BIGINT) AS accepted_at,
  CAST(NULL AS VARCHAR) AS answer, false AS later, CAST([] AS VARCHAR[]) AS answers, 0 AS clarified, 0 AS messages, CAST([] AS VARCHAR[]) AS seen, CAST([] AS VARCHAR[]) AS bodies, CAST([] AS VARCHAR[]) AS rated FROM (SELECT DISTINCT case_id FROM e2)
UNION ALL
SELECT case_id, n, event_id, kind, why = '', CASE WHEN why <> '' THEN why ELSE told END, version + CASE WHEN why = '' AND told = '' THEN 1 ELSE 0 END,
  CASE WHEN why <> '' OR told <> '' THEN status WHEN kind = 'message' THEN CASE WHEN ticket IS NULL THEN 'open' ELSE 'handed_off' END
    WHEN kind = 'result' THEN CASE WHEN outcome = 'answer' THEN 'answered' WHEN outcome = 'clarify' AND clarified = 0 THEN 'clarify' ELSE 'handoff_offered' END
    WHEN kind = 'policy' THEN 'closed_policy' WHEN kind = 'handoff' THEN 'handed_off' WHEN kind = 'reply' THEN CASE WHEN coalesce(solved, false) THEN 'resolved' ELSE 'handed_off' END
    WHEN solved THEN 'resolved' WHEN ticket IS NULL THEN 'open' ELSE 'handed_off' END,
  CASE WHEN why <> '' OR told <> '' THEN ticket WHEN kind = 'message' AND ticket IS NOT NULL THEN 'new' WHEN kind = 'policy' AND ticket <> 'resolved' THEN 'closed_policy' WHEN kind = 'handoff' THEN 'new'
    WHEN kind = 'reply' THEN CASE WHEN coalesce(solved, false) THEN 'resolved' ELSE 'waiting_user' END WHEN kind = 'feedback' AND ticket IS NOT NULL THEN CASE WHEN solved THEN 'resolved' ELSE 'new' END ELSE ticket END,
  CASE WHEN why = '' AND told = '' AND kind IN ('policy', 'handoff') THEN active END,
  CASE WHEN why <> '' OR told <> '' THEN active WHEN kind = 'message' THEN CASE WHEN ticket IS NULL THEN key ELSE active END WHEN kind = 'feedback' THEN active END,
  CASE WHEN why = '' AND kind = 'message' AND ticket IS NULL THEN version + 1 ELSE accepted_at END,
  CASE WHEN why = '' AND (kind = 'reply' OR (kind = 'result' AND outcome = 'answer')) THEN key ELSE answer END,
  CASE WHEN why <> '' THEN later WHEN kind = 'message' THEN true WHEN kind = 'reply' OR (kind = 'result' AND outcome = 'answer') THEN false ELSE later END,
  CASE WHEN why = '' AND (kind = 'reply' OR (kind = 'result' AND outcome = 'answer')) THEN list_append(answers, key) ELSE answers END,
  CASE WHEN why = '' AND kind = 'result' AND outcome = 'clarify' THEN 1 ELSE clarified END, messages + CASE WHEN why = '' AND kind IN ('message', 'result', 'reply') THEN 1 ELSE 0 END,
  CASE WHEN why = '' AND receipt IS NOT NULL THEN list_append(seen, receipt) ELSE seen END, CASE WHEN why = '' AND receipt IS NOT NULL THEN list_append(bodies, receipt || ':' || body) ELSE bodies END,
  CASE WHEN why = '' AND kind = 'feedback' THEN list_append(rated, key) ELSE rated END
FROM (SELECT *, CASE WHEN kind = 'handoff' AND ticket IS NOT NULL THEN 'existing_ticket' WHEN kind <> 'feedback' THEN '' WHEN solved IS NULL THEN 'saved' WHEN key = answer AND NOT later AND active IS NULL AND status NOT IN ('resolved', 'closed_policy') THEN '' ELSE 'answer_not_current' END AS told FROM (
  SELECT e2.case_id, e2.n, e2.event_id, e2.kind, e2.key, e2.body, e2.receipt, e2.outcome, e2.useful, e2.solved, s.version, s.status, s.ticket, s.active, s.accepted_at, s.answer, s.later, s.answers, s.clarified, s.messages, s.seen, s.bodies, s.rated,
  CASE WHEN receipt IS NOT NULL AND list_contains(seen, receipt) THEN CASE WHEN list_contains(bodies, receipt || ':' || body) THEN 'replay' ELSE 'conflict' END
    WHEN e2.kind = 'result' THEN CASE WHEN active IS NULL OR key <> active OR version <> accepted_at OR status IN ('resolved', 'closed_policy', 'handed_off') THEN 'late_result' ELSE '' END
    WHEN e2.kind = 'feedback' THEN CASE WHEN NOT list_contains(answers, key) THEN 'not_found' WHEN NOT list_contains(rated, key) AND useful IS NULL AND solved IS NULL THEN 'no_rating' ELSE '' END
    WHEN expected <> version THEN 'stale_version' WHEN status IN ('resolved', 'closed_policy') AND e2.kind <> 'reply' THEN 'terminal'
    WHEN e2.kind = 'message' THEN CASE WHEN active IS NOT NULL THEN 'busy' WHEN ticket <> 'waiting_user' THEN 'invalid_transition' WHEN messages >= 98 THEN 'message_cap' ELSE '' END
    WHEN e2.kind = 'handoff' THEN CASE WHEN ticket IS NOT NULL OR status = 'handoff_offered' THEN '' ELSE 'invalid_transition' END
    WHEN e2.kind = 'reply' THEN CASE WHEN ticket IS NULL THEN 'no_ticket' WHEN ticket = 'new' THEN '' ELSE 'invalid_transition' END ELSE '' END AS why
  FROM s JOIN e2 ON e2.case_id = s.case_id AND e2.n = s.n + 1)))"""
FOLDED = f"WITH RECURSIVE {FOLD}, t AS (SELECT case_id, n, event_id, kind, accepted, reason, version, status, ticket, cancelled FROM s WHERE n > 0)"


def folded(spark, d):
    """The batch fold with the kind of each event."""
    events = commands(read(spark, d, "events"))
    return S.fold_batch(events).join(events.select("event_id", "kind"), "event_id")


@query("t3_rejections", f"{FOLDED} SELECT kind, reason, accepted, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY ALL")
def t3(spark, d):
    """Stale versions, replays, conflicts and the other reasons, by kind."""
    return folded(spark, d).groupBy("kind", "reason", "accepted").agg(F.count("*").alias("n"))


@query("t4_publish_guard", f"{FOLDED} SELECT case_id, CAST(count(*) FILTER (accepted) AS BIGINT) AS published, CAST(count(*) FILTER (reason = 'late_result') AS BIGINT) AS discarded FROM t WHERE kind = 'result' GROUP BY case_id")
def t4(spark, d):
    return folded(spark, d).where("kind = 'result'").groupBy("case_id").agg(F.count_if("accepted").alias("published"), F.count_if(F.col("reason") == "late_result").alias("discarded"))


@query("t5_supersede", f"{FOLDED} SELECT case_id, event_id, kind, cancelled FROM t WHERE cancelled IS NOT NULL")
def t5(spark, d):
    return folded(spark, d).where("cancelled is not null").select("case_id", "event_id", "kind", "cancelled")


@query("t7_ticket_fold", f"{FOLDED} SELECT case_id, arg_max(coalesce(ticket, ''), n) AS ticket, arg_max(status, n) AS status, max(version) AS version, CAST(count(*) FILTER (kind = 'handoff' AND accepted AND reason = '') AS BIGINT) AS opened FROM t GROUP BY case_id")
def t7(spark, d):
    rows = folded(spark, d).join(read(spark, d, "events").select("event_id", "ts"), "event_id")
    last = lambda c: F.max_by(c, F.struct("ts", "event_id"))
    return rows.groupBy("case_id").agg(last(F.coalesce("ticket", F.lit(""))).alias("ticket"), last("status").alias("status"), F.max("version").alias("version"), F.count_if((F.col("kind") == "handoff") & F.col("accepted") & (F.col("reason") == "")).alias("opened"))


@query("t2_receipts", "SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'new' WHEN first_value(md5(props)) OVER w = md5(props) THEN 'replay' ELSE 'conflict' END AS verdict FROM events WINDOW w AS (PARTITION BY user_id, event_type, event_id // 500 ORDER BY ts, event_id)")
def t2_receipts(spark, d):
    c = commands(read(spark, d, "events").withColumnRenamed("event_type", "operation").withColumn("event_type", F.col("operation")))
    sent = c.join(read(spark, d, "events").select("event_id", F.col("event_type").alias("operation")), "event_id").withColumnRenamed("case_id", "actor_id")
    return S.receipts_of(sent).select("event_id", "verdict")


@query("t6_feedback_fields", "SELECT user_id, event_id // 500 AS message_id, arg_max(value > 5, (ts, event_id)) FILTER (event_id % 3 > 0) AS useful, arg_max(value > 5, (ts, event_id)) FILTER (event_id % 2 > 0) AS solved, max(ts) AS updated_at FROM events GROUP BY ALL")
def t6_fields(spark, d):
    given = read(spark, d, "events").select("user_id", F.floor(F.col("event_id") / 500).alias("message_id"), "ts", "event_id", F.when(F.col("event_id") % 3 > 0, F.col("value") > 5).alias("useful"), F.when(F.col("event_id") % 2 > 0, F.col("value") > 5).alias("solved"))
    return S.merged_feedback(given, ["user_id", "message_id"], ["useful", "solved"])


T1 = f"{FOLDED} SELECT case_id, event_id, accepted, reason, version, status, ticket, cancelled FROM t"


@query("t1_case_fold", T1)
def t1(spark, d):
    return S.fold_batch(commands(read(spark, d, "events")))


SLICES = 3
CUTS = [f"TIMESTAMP_NTZ '2024-01-01' + INTERVAL {10 * i} DAYS" for i in range(1, SLICES)]


def sliced(spark, d) -> list:
    """The events in slices of time, as files that come one after the other."""
    e = read(spark, d, "events")
    edges = [None, *CUTS, None]
    return [e.where(f"{f'ts >= {a}' if a else 'true'} AND {f'ts < {b}' if b else 'true'}") for a, b in zip(edges, edges[1:], strict=False)]


def streamed(spark, name: str, slices: list, plan, schema: str, mode: str = "append"):
    """The slices as a stream of several triggers, restarted between them, written to a table that is read back."""
    out = shared(spark, name)

    def start(events):
        rows = plan(events.withColumn("ts", F.col("ts").cast("timestamp")))
        return rows.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()

    with P.with_rocksdb(spark):
        P.run_slices(slices, out + "-in", lambda folder: io.case_event_stream(spark, folder, RAW), start)
    return spark.read.schema(schema).parquet(out)


@query("t1_case_fold_stream", T1)
def t1_stream(spark, d):
    """The same fold by a state processor, over three slices of time."""
    return streamed(spark, "case-fold", sliced(spark, d), lambda e: P.fold_stream(commands(e)), S.RESULT)


DEADLINE = 3 * 86_400


@query("t8_deadline_timers", f"""WITH k AS (SELECT user_id AS case_id, 'r' || event_id // 500 AS request_key, event_id, epoch_ms(ts) AS ms, event_type FROM events),
o AS (SELECT case_id, request_key, min(ms) AS created FROM k WHERE event_type = 'view' GROUP BY ALL),
f AS (SELECT o.case_id, o.request_key, any_value(created) AS created, count(k.event_id) FILTER (event_type = 'click' AND ms >= created AND ms <= created + {DEADLINE * 1000}) AS results FROM o JOIN k USING (case_id, request_key) GROUP BY ALL)
SELECT case_id, request_key, CASE WHEN results > 0 THEN 'done' ELSE 'error' END AS status, CASE WHEN results = 0 THEN 'RESTARTED' END AS error_code, results = 0 AS retryable
FROM f WHERE results > 0 OR created + {DEADLINE * 1000} < (SELECT max(epoch_ms(ts)) FROM events)""")
def t8_timers(spark, d):
    """Requests of three slices of time: those without a result in time end by timers."""
    plan = lambda e: P.request_deadlines(commands(e).select("case_id", "request_key", "event_id", "ts", "kind"), DEADLINE)
    return streamed(spark, "deadlines", sliced(spark, d), plan, P.REQUEST)


SLIDING = "SELECT start, start + INTERVAL 1 HOUR AS \"end\", event_type, CAST(count(*) AS BIGINT) AS n, list_sort(list(bin))[CAST(ceil(0.95 * count(*)) AS BIGINT)] * 0.5 AS quantile FROM (SELECT event_type, greatest(0, least(63, floor(value / 0.5))) AS bin, unnest([time_bucket(INTERVAL 30 MINUTES, ts), time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES]) AS start FROM events) GROUP BY ALL"


@query("t9_sliding_p95_stream", f"SELECT * FROM ({SLIDING}) WHERE \"end\" <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def t9_sliding(spark, d):
    rows = streamed(spark, "sliding", sliced(spark, d), P.sliding_quantiles, "start timestamp, end timestamp, event_type string, n long, quantile double")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", "quantile")


@query("t2_deduplicated_stream", "SELECT event_id, user_id, event_type FROM events")
def t2_stream(spark, d):
    """Events that come again within an hour of the watermark, and some that come weeks late: each is passed on once."""
    first, middle, last = sliced(spark, d)
    again = first.where(f"ts >= {CUTS[0]} - INTERVAL 30 MINUTES")
    rows = streamed(spark, "deduplicated", [first, middle.unionByName(again), last.unionByName(first)], lambda e: P.deduplicated(e, ["event_id"]), RAW.replace("timestamp_ntz", "timestamp"))
    return rows.select("event_id", "user_id", "event_type")


@query("t8_recovery", "SELECT event_id, CASE WHEN event_type IN ('view','click') AND ts < TIMESTAMP '2024-01-15' THEN 'error' ELSE CASE WHEN event_type IN ('view','click') THEN 'processing' ELSE 'final' END END AS status, event_type IN ('view','click') AND ts < TIMESTAMP '2024-01-15' AS error_retryable FROM events")
def t8(spark, d):
    r = read(spark, d, "events").select("event_id", F.when(F.col("event_type").isin("view", "click"), "processing").otherwise("final").alias("status"), F.col("ts").alias("created_at"))
    return S.recover(r, F.expr("TIMESTAMP_NTZ '2024-01-15'")).select("event_id", "status", "error_retryable")


WIN = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total, max(value) AS most FROM events GROUP BY ALL"


@query("t9_windowed_metrics", WIN)
def t9(spark, d):
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.windowed_metrics(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"), "most")


@query("t9_windowed_metrics_stream", f"SELECT * FROM ({WIN}) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def t9_stream(spark, d):
    """Windows that the watermark has closed, each written once; the state of open ones is all that is kept."""
    out = shared(spark, "windows")
    e = io.case_event_stream(spark, f"{d}/events.parquet", RAW).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = S.windowed_metrics(e)
    rows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"), "most")


@query("t10_sessions", "WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), y AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts, f DESC ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS \"end\", CAST(count(*) AS BIGINT) AS n FROM y GROUP BY user_id, s")
def t10(spark, d):
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.activity_sessions(e).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


SESSIONS = "WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), y AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts, f DESC ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS \"end\", CAST(count(*) AS BIGINT) AS n FROM y GROUP BY user_id, s"


@query("t10_sessions_stream", f"SELECT * FROM ({SESSIONS}) WHERE \"end\" < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def t10_stream(spark, d):
    """Sessions that the watermark has closed, over slices of time: open ones merge in state."""
    rows = streamed(spark, "sessions", sliced(spark, d), S.activity_sessions, "user_id long, start timestamp, end timestamp, n long")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


FIELDS = {"useful": ("click", "view"), "solved": ("purchase",)}


def field_updates(events):
    """user_id, field, value, ts, event_id: what an event says of a field."""
    field = F.coalesce(*[F.when(F.col("event_type").isin(*kinds), f) for f, kinds in FIELDS.items()])
    return events.select("user_id", field.alias("field"), F.col("event_type").alias("value"), "ts", "event_id").where("field is not null")


@query("t6_feedback_state_stream", "SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (event_type IN ('click','view')) AS useful, arg_max(event_type, (ts, event_id)) FILTER (event_type IN ('purchase')) AS solved FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY user_id")
def t6_state(spark, d):
    """The newest value of each field in a table that a stream keeps up to date, batch by batch."""
    path = shared(spark, "feedback-state")
    held = P.CurrentTable(spark, path, ["user_id", "field"], ["ts", "event_id"], "user_id long, field string, value string, ts timestamp_ntz, event_id long")
    start = lambda e: field_updates(e).writeStream.foreachBatch(held.upsert).option("checkpointLocation", path + "-state").trigger(availableNow=True).start()
    P.run_slices(sliced(spark, d), path + "-in", lambda folder: io.case_event_stream(spark, folder, RAW), start)
    return held.read().groupBy("user_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS])


@query("t2_deduplicated_commands", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def t2(spark, d):
    return read(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("t6_feedback_merge", "SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (event_type IN ('click','view')) AS useful, arg_max(event_type, (ts, event_id)) FILTER (event_type IN ('purchase')) AS solved FROM events GROUP BY user_id")
def t6(spark, d):
    last = lambda *kinds: F.max_by(F.when(F.col("event_type").isin(*kinds), F.col("event_type")), F.when(F.col("event_type").isin(*kinds), F.struct("ts", "event_id")))
    return read(spark, d, "events").groupBy("user_id").agg(last("click", "view").alias("useful"), last("purchase").alias("solved"))


@query("s1_kb_raw", "SELECT CAST(doc_id AS VARCHAR) AS id, source AS source_key, lang AS audience, md5(coalesce(text,'')) AS content_md5 FROM documents")
def s1(spark, d):
    path = shared(spark, "kb-raw")
    docs = read(spark, d, "documents")
    docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_key"), F.col("lang").alias("audience"), F.coalesce("text", F.lit("")).alias("content")).write.json(path)
    rows, _bad = io.read_kb_raw(spark, path)
    return rows.select("id", "source_key", "audience", F.md5("content").alias("content_md5"))


LINE = """CASE WHEN doc_id % 13 = 0 THEN '{"id": "' || doc_id || '", "content": ' WHEN doc_id % 13 = 1 THEN '{"content": "x"}' WHEN doc_id % 13 = 2 THEN '{"id": "' || doc_id || '"}' WHEN doc_id % 13 = 3 THEN '  ' ELSE '{"id": "' || doc_id || '", "source_key": "' || source || '", "content": "text of ' || doc_id || '"}' END"""
REASON = "CASE doc_id % 13 WHEN 0 THEN 'not_json' WHEN 1 THEN 'no_id' WHEN 2 THEN 'no_content' ELSE '' END"


@query("s1_rejects", f"WITH x AS (SELECT {LINE} AS line, {REASON} AS reason FROM documents WHERE doc_id % 13 <> 3) SELECT reason, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS observed, md5(string_agg(line, chr(10) ORDER BY line)) AS h FROM x WHERE reason <> '' GROUP BY reason UNION ALL SELECT '', CAST(count(*) AS BIGINT), CAST(count(*) AS BIGINT), md5(string_agg(regexp_extract(line, 'text of [0-9]+'), chr(10) ORDER BY regexp_extract(line, 'text of [0-9]+'))) FROM x WHERE reason = ''")
def s1_rejects(spark, d):
    """Lines of which some are broken: rejects with their reason, and counts that were observed as the lines were read."""
    path = shared(spark, "kb-lines")
    read(spark, d, "documents").select(F.expr(LINE).alias("value")).write.text(path)
    rows, bad, seen = publish.split_kb_raw(spark, path, path + "-split")
    told = F.md5(F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("h")  # of a test's lines
    observed = F.create_map(*[F.lit(x) for kv in (seen | {"": seen["lines"] - sum(seen[k] for k in ("not_json", "no_id", "no_content"))}).items() for x in kv])
    each = bad.unionByName(rows.select(F.col("content").alias("line"), F.lit("").alias("reason")))
    return each.groupBy("reason").agg(F.count("*").alias("n"), told).select("reason", "n", observed[F.col("reason")].cast("long").alias("observed"), "h")


@query("s12_file_hashes", "SELECT source AS name, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY doc_id) || chr(10)) AS sha256, CAST(sum(length(CAST(doc_id AS VARCHAR)) + 1) AS BIGINT) AS size FROM documents GROUP BY source")
def s12_files(spark, d):
    """Files of the ids of each source, hashed in blocks."""
    path = shared(spark, "files")
    ids = read(spark, d, "documents").select("source", "doc_id").repartition("source").sortWithinPartitions("source", "doc_id")
    ids.select("source", F.col("doc_id").cast("string").alias("value")).write.partitionBy("source").text(path)
    found = publish.hash_files(spark, path).where("path like '%source=%'")
    return found.select(F.regexp_extract("path", "source=([^/]*)/", 1).alias("name"), "sha256", "size")


PUBLISHED = {"documents": "doc_id", "labels": "doc_id", "pages": "page_id", "benchmark": "item_id", "conversations": "conv_id"}


@query("s10_publication", " UNION ALL ".join(f"SELECT '{t}' AS name, CAST(count(*) AS BIGINT) AS n, CAST(sum({k}) AS BIGINT) AS ids, true AS verified, true AS stable FROM {t}" for t, k in PUBLISHED.items()))
def s10_publication(spark, d):
    """Five tables published twice; an attempt that breaks off before its manifest stays invisible, and the same tables have the
    same snapshot id."""
    held = publish.Publication(spark, shared(spark, "publication"))
    tables, order = {t: read(spark, d, t) for t in PUBLISHED}, {t: [k] for t, k in PUBLISHED.items()}
    first = held.publish(tables, order, {"schema": "1"})
    tables["labels"].limit(1).write.parquet(f"{held.folder}/data/broken/labels")
    stable = held.publish({t: df.repartition(3) for t, df in tables.items()}, order, {"schema": "1"}) == first and held.manifest()["number"] == 1
    verdicts = held.verify().groupBy(F.split_part("name", F.lit("/"), F.lit(1)).alias("name")).agg(F.bool_and(F.col("verdict") == "pass").alias("verified"))
    counts = None
    for t, k in PUBLISHED.items():
        one = held.read(t, f"{k} long").agg(F.lit(t).alias("name"), F.count("*").alias("n"), F.sum(k).alias("ids"))
        counts = one if counts is None else counts.unionByName(one)
    return counts.join(verdicts, "name").withColumn("stable", F.lit(stable))


@query("s10_snapshot", "SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents GROUP BY lang")
def s10(spark, d):
    path = shared(spark, "snapshot")
    io.write_snapshot({"chunks": read(spark, d, "documents")}, path, {"chunks": ["doc_id"]}, {"chunks": "lang"})
    return spark.read.schema("doc_id long, lang string").parquet(f"{path}/chunks").groupBy("lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("s11_export", "SELECT conv_id, CAST(count(*) AS BIGINT) AS n_messages, CAST(max(turn) AS BIGINT) AS last_turn FROM conversations GROUP BY conv_id")
def s11(spark, d):
    path = shared(spark, "export")
    nested = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))  # a conversation's messages
    io.write_export(nested, path)
    back = spark.read.schema("conv_id long, messages array<struct<turn:long,role:string,text:string>>").json(path)
    return back.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.array_max(F.transform("messages", lambda m: m["turn"])).alias("last_turn"))


@query("s12_input_hashes")
def s12(spark, d):
    return io.hash_inputs(spark, f"{d}/benchmark.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256", "size")


@query("s13_snapshot_id")
def s13(spark, d):
    return io.snapshot_id(io.hash_inputs(spark, f"{d}/labels.parquet"), {"schema": "1"})


BODY = """'{"event_type":"' || event_type || '","props":"' || replace(props, '"', '\\"') || '","value":' || CAST(value AS VARCHAR) || '}'"""


@query("f25_body_hashes", f"SELECT event_id, sha256({BODY}) AS h FROM events")
def f25(spark, d):
    return read(spark, d, "events").select("event_id", io.body_hash("event_type", "props", "value").alias("h"))


@query("f29_timings", "SELECT user_id, round(max(value) FILTER (event_type = 'click'), 6) AS click, round(coalesce(max(value) FILTER (event_type = 'view'), max(value) FILTER (event_type = 'purchase')), 6) AS seen, round(max(value) FILTER (event_type = 'error'), 6) AS failed FROM events GROUP BY user_id")
def f29(spark, d):
    """The key seen is in both maps: the later value wins where it is known."""
    most = lambda k: F.max(F.when(F.col("event_type") == k, F.col("value")))
    m = read(spark, d, "events").groupBy("user_id").agg(*[most(k).alias(k) for k in ("click", "view", "purchase", "error")])
    before, after = F.create_map(F.lit("click"), F.col("click"), F.lit("seen"), F.col("purchase")), F.create_map(F.lit("seen"), F.col("view"), F.lit("failed"), F.col("error"))
    merged = C.merged_timings(before, after)
    return m.select("user_id", *[F.round(F.try_element_at(merged, F.lit(k)), 6).alias(k) for k in ("click", "seen", "failed")])
