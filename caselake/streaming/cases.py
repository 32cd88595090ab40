"""Case state over an event stream: one fold, used by the stream and by batch jobs.

Events of a case are folded in order of (ts, event_id). Each gives one row that says whether it was accepted, why not (or
what came of it), and the version and status after it.

* Messages, policy events, handoffs and replies carry a request key: one that was accepted before for the same operation
  replays or, with another body, conflicts. That comes before anything else; a stale expected version comes next (T2, T3).
* A message opens the active request; a case that has one is busy, and one with a ticket takes messages only while the
  operator waits for the user. A result counts only for the active request, at the version it was accepted with, of a case
  that is neither closed nor handed over (T4). Policy and handoff cancel the active request (T5).
* A ticket is opened once, by a handoff that was offered; replies and messages turn it between waiting_user and new; it
  ends as resolved or closed_policy (T7).
* Feedback merges by answer, field by field; it changes the case only for the current answer: the latest one, with no later
  message, no active request and the case not closed (T6).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE_CAP = 98
TERMINAL = ("resolved", "closed_policy")
#: Operation of a kind, for kinds that a request key makes idempotent.
OPERATION = {"message": "chat", "policy": "chat", "handoff": "handoff", "reply": "operator_reply"}
EVENT = "case_id long, event_id long, ts timestamp, kind string, request_key string, body_hash string, expected_version long, outcome string, useful boolean, solved boolean"
RESULT = "case_id long, event_id long, accepted boolean, reason string, version long, status string, ticket string, cancelled string"
RESULT_ARROW = pa.schema([("case_id", pa.int64()), ("event_id", pa.int64()), ("accepted", pa.bool_()), ("reason", pa.string()), ("version", pa.int64()), ("status", pa.string()), ("ticket", pa.string()), ("cancelled", pa.string())])
NEW = {"status": "open", "version": 0, "active": None, "accepted_at": None, "answer": None, "later": False, "answers": [], "clarified": 0, "ticket": None, "messages": 0, "seen": {}, "feedback": {}}


def refusal(s: dict, e: dict) -> str | None:
    """Why the state s doesn't take the event, if it doesn't."""
    key, kind, receipt = e["request_key"], e["kind"], receipt_of(e)
    if receipt in s["seen"]:
        return "replay" if s["seen"][receipt] == e["body_hash"] else "conflict"
    if kind == "result":
        late = s["active"] is None or key != s["active"] or s["version"] != s["accepted_at"] or s["status"] in (*TERMINAL, "handed_off")
        return "late_result" if late else None
    if kind == "feedback":
        given = e["useful"] is not None or e["solved"] is not None
        return "not_found" if key not in s["answers"] else "no_rating" if key not in s["feedback"] and not given else None
    if kind not in OPERATION:
        return "unknown_kind"
    if e["expected_version"] is not None and e["expected_version"] != s["version"]:
        return "stale_version"
    if s["status"] in TERMINAL and kind != "reply":
        return "terminal"
    if kind == "message":
        if s["active"] is not None:
            return "busy"
        if s["ticket"] not in (None, "waiting_user"):
            return "invalid_transition"
        return "message_cap" if s["messages"] >= MESSAGE_CAP else None
    if kind == "handoff":
        return None if s["ticket"] or s["status"] == "handoff_offered" else "invalid_transition"
    if kind == "reply":
        return "no_ticket" if s["ticket"] is None else None if s["ticket"] == "new" else "invalid_transition"
    return None


def receipt_of(e: dict) -> str | None:
    """Operation and key that make an event idempotent; none without a key."""
    return f"{OPERATION[e['kind']]}:{e['request_key']}" if e["kind"] in OPERATION and e["request_key"] is not None else None


def apply_event(s: dict, e: dict) -> tuple[bool, str, str | None]:
    """Changes the state s by an event; (accepted, reason, cancelled request)."""
    why = refusal(s, e)
    if why:
        return False, why, None
    key, kind, cancelled, told = e["request_key"], e["kind"], None, ""
    if kind in ("policy", "handoff") and not (kind == "handoff" and s["ticket"]):
        cancelled, s["active"] = s["active"], None
    if kind == "message":
        s["messages"] += 1
        s["later"] = True
        if s["ticket"]:
            s |= {"ticket": "new", "status": "handed_off"}
        else:
            s |= {"active": key, "accepted_at": s["version"] + 1, "status": "open"}
    elif kind == "result":
        s["active"] = None
        s["messages"] += 1
        outcome = e["outcome"] or "answer"
        if outcome == "answer":
            s |= {"answer": key, "later": False, "status": "answered"}
            s["answers"].append(key)
        elif outcome == "clarify" and not s["clarified"]:
            s |= {"clarified": 1, "status": "clarify"}
        else:
            s["status"] = "handoff_offered"
    elif kind == "policy":
        s |= {"status": "closed_policy", "ticket": s["ticket"] and (s["ticket"] if s["ticket"] == "resolved" else "closed_policy")}
    elif kind == "handoff":
        if s["ticket"]:
            told = "existing_ticket"
        else:
            s |= {"ticket": "new", "status": "handed_off"}
    elif kind == "reply":
        done = bool(e["solved"])
        s |= {"ticket": "resolved" if done else "waiting_user", "status": "resolved" if done else "handed_off", "active": None, "answer": key, "later": False}
        s["answers"].append(key)
        s["messages"] += 1
    else:
        given = {k: e[k] for k in ("useful", "solved") if e[k] is not None}
        s["feedback"][key] = (s["feedback"][key] if key in s["feedback"] else {}) | given
        told = "saved"
        if e["solved"] is not None:
            current = key == s["answer"] and not s["later"] and s["active"] is None and s["status"] not in TERMINAL
            told = "" if current else "answer_not_current"
            if current:
                s["status"] = "resolved" if e["solved"] else "handed_off" if s["ticket"] else "open"
                s["ticket"] = s["ticket"] and ("resolved" if e["solved"] else "new")
    if receipt_of(e):
        s["seen"][receipt_of(e)] = e["body_hash"]
    s["version"] += told == ""
    return True, told, cancelled


def fold_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fold over rows in order of (case_id, ts, event_id): a batch in, its rows out; only the state is carried on."""
    held, state = object(), {}
    for batch in batches:
        out = []
        for e in batch.to_pylist():
            if e["case_id"] != held:
                held, state = e["case_id"], json.loads(json.dumps(NEW))
            ok, why, cancelled = apply_event(state, e)
            out.append((held, e["event_id"], ok, why, state["version"], state["status"], state["ticket"], cancelled))
        columns = zip(*out, strict=True) if out else [()] * len(RESULT_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RESULT_ARROW, strict=True)], schema=RESULT_ARROW)


def fold_batch(events: DataFrame) -> DataFrame:
    """The fold over all events at once. A case is sorted by Spark, which can spill, and never held whole in Python."""
    ordered = events.repartition("case_id").sortWithinPartitions("case_id", F.col("ts").asc_nulls_last(), F.col("event_id").asc_nulls_last())
    return ordered.mapInArrow(fold_sorted, RESULT)


def receipts_of(commands: DataFrame, key: list[str] = ["actor_id", "operation", "request_key"]) -> DataFrame:  # noqa: B006
    """commands (key, event_id, ts, body_hash) -> with verdict: the first of a key is new, later ones replay or, with
    another body, conflict (T2). Commands without a key are all new. First commands are found by an aggregate, so that a key
    that is sent without end isn't sorted in one task."""
    first = commands.where(F.col("request_key").isNotNull()).groupBy(*key).agg(F.min(F.struct("ts", "event_id", "body_hash")).alias("_first"))
    verdict = F.when(F.col("_first").isNull() | (F.col("_first.event_id") == F.col("event_id")), "new").when(F.col("_first.body_hash").eqNullSafe(F.col("body_hash")), "replay").otherwise("conflict")
    return commands.join(first, key, "left").withColumn("verdict", verdict).drop("_first")


def merged_feedback(feedback: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """feedback (key, ts, event_id, fields) -> one row a key: each field as it was last given, null where never."""
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct("ts", "event_id"))).alias(c)
    return feedback.groupBy(*key).agg(*[last(c) for c in fields], F.max("ts").alias("updated_at"))


def recover(requests: DataFrame, deadline: Column) -> DataFrame:
    """Requests in flight past the deadline become retryable errors."""
    late = F.col("status").isin("queued", "processing") & (F.col("created_at") < deadline)
    told = {"error_retryable": late, "error_code": F.when(late, "RESTARTED"), "status": F.when(late, "error").otherwise(F.col("status"))}
    return requests.withColumns(told)  # all from the status before


def windowed_metrics(events: DataFrame, *, ts: str = "ts", by: str = "event_type", size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts, sums and maxima by window with a watermark."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total", "most")


def activity_sessions(events: DataFrame, *, ts: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user that end after a gap."""
    g = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return g.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
