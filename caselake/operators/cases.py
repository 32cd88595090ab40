"""Case analytics: nested export rows, flags, cohort metrics, latency percentiles, consistency checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIMEOUT_MS = 120_000.0
MESSAGE_CAP = 98


def rate(k: Column, n: Column) -> Column:
    """k / n, null where n is 0 (ANSI-safe)."""
    return F.try_divide(k.cast("double"), n.cast("double"))


def latest(rows: DataFrame, by: list[str], when: str, order: str) -> DataFrame:
    """The row of each group with the greatest time; of equal times the one that came first."""
    w = Window.partitionBy(*by).orderBy(F.desc(when), F.asc(order))
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def feedback_on_messages(feedback: DataFrame, messages: DataFrame, key: str) -> DataFrame:
    """Feedback with its message; dangling where there is none."""
    known = messages.select(key, F.lit(True).alias("_known")).distinct()
    return feedback.join(known, key, "left").withColumn("dangling", F.col("_known").isNull()).drop("_known")


def resolution(cases: DataFrame, messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """cases (case_id, case_status), messages (case_id, message_id, kind, answer_origin), feedback (message_id, feedback_id,
    updated_at, solved) -> case_id, resolution: the latest solved feedback on an answer of each resolved case (J14)."""
    answers = messages.where("kind = 'answer'").join(cases.where("case_status = 'resolved'").select("case_id"), "case_id", "left_semi").select("case_id", "message_id", "answer_origin")
    last = F.max_by(F.struct("message_id", F.lit("user").alias("confirmed_by"), "answer_origin", F.col("updated_at").alias("confirmed_at")), F.struct("updated_at", "feedback_id"))
    return feedback.where("solved").join(answers, "message_id").groupBy("case_id").agg(last.alias("resolution"))


def feedback_verdict(feedback: DataFrame, messages: DataFrame) -> DataFrame:
    """feedback (session_id, message_id, specialist_rating, useful, solved, ...), messages (message_id, session_id, kind,
    responder_type, answer_origin) -> feedback with verdict (J24): only a message of one's own session, only an answer, a
    specialist's rating only for what an operator wrote, and some rating at all."""
    known = messages.select("message_id", F.col("session_id").alias("_owner"), F.col("kind").alias("_kind"), ((F.col("responder_type") == "operator") & (F.col("answer_origin") == "operator")).alias("_operator"))
    said = (
        F.when(F.coalesce(F.col("_owner") != F.col("session_id"), F.lit(True)), "not_found")
        .when(F.col("_kind") != "answer", "not_an_answer")
        .when(F.col("specialist_rating").isNotNull() & ~F.coalesce("_operator", F.lit(False)), "rating_of_no_operator")
        .when(F.coalesce(F.col("useful").cast("int"), F.col("solved").cast("int"), F.col("specialist_rating")).isNull(), "no_rating")
        .otherwise("ok")
    )
    return feedback.join(known, "message_id", "left").withColumn("verdict", said).drop("_owner", "_kind", "_operator")


def later_user_message(messages: DataFrame, case: str = "case_id", seq: str = "seq") -> DataFrame:
    """Whether a user message of the same case follows."""
    last = F.max(F.when(F.col("role") == "user", F.col(seq))).over(Window.partitionBy(case))
    return messages.withColumn("user_later", F.coalesce(last > F.col(seq), F.lit(False)))


def next_seq(messages: DataFrame, case: str, order: list[str]) -> DataFrame:
    """Sequence numbers in arrival order."""
    return messages.withColumn("seq", F.row_number().over(Window.partitionBy(case).orderBy(*order)).cast("long"))


def last_user_messages(messages: DataFrame, case: str, seq: str, n: int = 5) -> DataFrame:
    """The last n user messages of each case, oldest first, as one array (W10). n rows a case at most reach the array."""
    w = Window.partitionBy(case).orderBy(F.desc(seq))
    few = messages.where("role = 'user'").withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= n)
    return few.groupBy(case).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col("text").alias("t")))), lambda x: x["t"]).alias("recent"))


def assemble(cases: DataFrame, key: str, **children: tuple[DataFrame, list[str]]) -> DataFrame:
    """cases with one array of structs for each child table, ordered by its columns (J15). Arrays are as long as a case's
    children, which the message cap bounds; children without a key belong to no case and aren't gathered."""
    out = cases
    for name, (rows, columns) in children.items():
        nested = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(nested, key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(nested.schema[name].dataType)))
    return out


def evaluation_rows(cases: DataFrame, messages: DataFrame, requests: DataFrame, feedback: DataFrame, tickets: DataFrame) -> DataFrame:
    """One nested row a case (J15): cases (case_id, cohort, case_status), messages (case_id, seq, message_id, kind,
    responder_type, answer_origin), requests (case_id, created_at, request_id, status, error_code, total_ms), feedback
    (message_id, feedback_id, updated_at, useful, solved), tickets (case_id, ticket_status)."""
    own = feedback.join(messages.select("message_id", "case_id"), "message_id") if "case_id" not in feedback.columns else feedback
    rows = assemble(
        cases.withColumn("policy_closed", F.col("case_status") == "closed_policy"), "case_id",
        messages=(messages, ["seq", "message_id", "kind", "responder_type", "answer_origin"]),
        requests=(requests, ["created_at", "request_id", "status", "error_code", "total_ms"]),
        feedback=(own, ["updated_at", "feedback_id", "message_id", "useful", "solved"]),
    )
    rows = rows.join(tickets.select("case_id", "ticket_status"), "case_id", "left").withColumn("has_ticket", F.col("ticket_status").isNotNull())
    return rows.join(resolution(cases, messages, feedback.drop("case_id")), "case_id", "left")


def handoff_context(rows: DataFrame) -> DataFrame:
    """rows (case_id, messages array<struct<seq, ..., source_ids>> in order, basis_source_ids): history, and the sources of
    the route and then of the messages, each where it is first named (D11)."""
    said = F.transform("messages", lambda m: F.coalesce(m["source_ids"], F.array().cast("array<string>")))
    return rows.withColumn("source_ids", F.array_distinct(F.concat(F.coalesce("basis_source_ids", F.array().cast("array<string>")), F.flatten(said))))


def nearest_rank(c: str, p: float) -> Column:
    """Nearest-rank percentile."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})")


def case_flags(rows: DataFrame) -> DataFrame:
    """rows: EvaluationRow-like (case_id, cohort, case_status, policy_closed, has_ticket, messages array<struct<message_id,
    kind,responder_type>>, requests array<struct<status,error_code,total_ms>>, feedback array<struct<message_id,
    updated_at,useful,solved>>, resolution struct<confirmed_by,answer_origin>) -> flags of each case (A15)."""
    answers = F.filter("messages", lambda m: m["kind"] == "answer")
    by_kind = lambda kind: F.transform(F.filter(answers, lambda m: m["responder_type"] == kind), lambda m: m["message_id"])
    # of equal times the earlier entry counts: a later one replaces it only if it is newer
    indexed = F.transform("feedback", lambda f, i: F.struct(f["updated_at"].alias("at"), (-i).alias("o"), f["message_id"].alias("message_id"), f["useful"].alias("useful"), f["solved"].alias("solved")))
    newest = F.filter(indexed, lambda f: ~F.exists(indexed, lambda g: (g["message_id"] == f["message_id"]) & (F.struct(g["at"], g["o"]) > F.struct(f["at"], f["o"]))))
    ids = F.transform("messages", lambda m: m["message_id"])
    answer_ids = F.transform(answers, lambda m: m["message_id"])
    n = lambda arr, test: F.size(F.filter(arr, test)).cast("long")
    flagged = rows.withColumn("fb", newest).withColumn("ai_ids", by_kind("ai")).withColumn("op_ids", by_kind("operator")).withColumn("answer_ids", answer_ids).withColumn("all_ids", ids)
    done = lambda r: r["status"].isin("final", "error") & r["total_ms"].isNotNull()
    ai, op, ans = F.col("ai_ids"), F.col("op_ids"), F.col("answer_ids")
    r = F.col("resolution")
    return flagged.select(
        "case_id", "cohort", "policy_closed", "has_ticket",
        (F.size(ans) > 0).alias("has_answer"),
        (F.size(ai) > 0).alias("ai_answered"),
        (F.size(op) > 0).alias("operator_answered"),
        F.coalesce((F.size(ai) > 0) & (r["confirmed_by"] == "user") & r["answer_origin"].isin("rag", "card") & (F.size(op) == 0) & ~F.col("has_ticket"), F.lit(False)).alias("confirmed_auto"),
        F.exists("requests", lambda x: x["status"] == "error").alias("has_error"),
        F.exists("requests", lambda x: done(x) & (x["total_ms"] >= TIMEOUT_MS)).alias("has_timeout"),
        (F.col("case_status") == "handoff_offered").alias("handoff_offered"),
        n("fb", lambda f: F.array_contains(ai, f["message_id"]) & f["useful"].isNotNull()).alias("ai_useful_n"),
        n("fb", lambda f: F.array_contains(ai, f["message_id"]) & F.coalesce(f["useful"], F.lit(False))).alias("ai_useful_k"),
        n("fb", lambda f: F.array_contains(op, f["message_id"]) & f["useful"].isNotNull()).alias("op_useful_n"),
        n("fb", lambda f: F.array_contains(op, f["message_id"]) & F.coalesce(f["useful"], F.lit(False))).alias("op_useful_k"),
        n("fb", lambda f: F.array_contains(ans, f["message_id"]) & f["solved"].isNotNull()).alias("solved_n"),
        n("fb", lambda f: F.array_contains(ans, f["message_id"]) & F.coalesce(f["solved"], F.lit(False))).alias("solved_k"),
        F.exists("fb", lambda f: F.array_contains(ans, f["message_id"])).alias("has_feedback"),
        F.exists("fb", lambda f: ~F.array_contains("all_ids", f["message_id"])).alias("dangling"),
        n("requests", lambda x: x["status"] == "error").alias("error_requests"),
        n("requests", lambda x: done(x) & (x["total_ms"] >= TIMEOUT_MS)).alias("timeout_requests"),
        F.array_sort(F.array_distinct(F.transform(F.filter("requests", lambda x: x["status"] == "error"), lambda x: F.coalesce(x["error_code"], F.lit("UNKNOWN"))))).alias("error_codes"),
        F.transform(F.filter("requests", done), lambda x: x["total_ms"]).alias("totals_ms"),
        F.transform(F.filter("requests", lambda x: (x["status"] == "final") & x["total_ms"].isNotNull()), lambda x: x["total_ms"]).alias("answer_ms"),
    )


def cohort_rates(flags: DataFrame, by: list[str] = ["cohort"]) -> DataFrame:  # noqa: B006
    """metric, n, k, value for each cohort over cases that policy didn't close (A16, P12); n of case rates is null where
    no case is left."""
    x = flags.where(~F.col("policy_closed"))
    of = lambda cond: F.count_if(cond).alias("k")
    case_rates = {"auto_answer": F.col("ai_answered"), "confirmed_auto_resolution": F.col("confirmed_auto"), "handoffs": F.col("has_ticket"), "no_answer": ~F.col("has_answer"), "errors": F.col("has_error"), "timeouts": F.col("has_timeout")}
    sums = [F.count("*").alias("n_cases"), F.count_if("has_answer").alias("n_answered")]
    sums += [of(c).alias(m) for m, c in case_rates.items()] + [F.count_if(F.col("has_answer") & F.col("has_feedback")).alias("covered")]
    sums += [F.sum(c).alias(c) for c in ("ai_useful_n", "ai_useful_k", "op_useful_n", "op_useful_k", "solved_n", "solved_k")]
    g = flags.select(*by).distinct().join(x.groupBy(*by).agg(*sums), by, "left").na.fill(0)
    rows = [F.struct(F.lit(m).alias("metric"), F.nullif(F.col("n_cases"), F.lit(0)).alias("n"), F.col(m).alias("k")) for m in case_rates]
    rows += [F.struct(F.lit("feedback_coverage").alias("metric"), F.col("n_answered").alias("n"), F.col("covered").alias("k"))]
    rows += [F.struct(F.lit(m).alias("metric"), F.col(f"{p}_n").alias("n"), F.col(f"{p}_k").alias("k")) for m, p in (("usefulness_ai", "ai_useful"), ("usefulness_operator", "op_useful"), ("solved_rate", "solved"))]
    return g.select(*by, F.inline(F.array(*rows))).withColumn("value", rate(F.col("k"), F.col("n")))


def cohort_info(flags: DataFrame, by: list[str] = ["cohort"]) -> DataFrame:  # noqa: B006
    """Cases in all, closed by policy and left; and of those left the offered handoffs, error and timeout requests and cases
    with dangling feedback (A17)."""
    left = ~F.col("policy_closed")
    sums = {"handoff_offered_cases": F.col("handoff_offered").cast("long"), "error_requests": F.col("error_requests"), "timeout_requests": F.col("timeout_requests"), "dangling_feedback_cases": F.col("dangling").cast("long")}
    return flags.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("policy_closed").alias("policy_closed"), F.count_if(left).alias("eligible"), *[F.sum(F.when(left, c).otherwise(0)).alias(m) for m, c in sums.items()])


def nearest_ranks(rows: DataFrame, by: list[str], value: str, at: dict[str, float], bins: int = 1024) -> DataFrame:
    """by, n and the nearest-rank percentiles ``at`` (name -> share) of each group, exactly.

    A group's range is cut in bins and counted; only the bins that hold a wanted rank are looked into, by distinct value. So
    no task holds a group's values, whatever its size. Nulls don't count; null groups are groups."""
    v = rows.where(F.col(value).isNotNull()).select(F.struct(*by).alias("_by"), F.col(value).cast("double").alias("_v"))
    ends = v.groupBy("_by").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("n"))
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0).cast("long"))
    binned = v.join(ends, "_by").withColumn("_bin", place)
    w = Window.partitionBy("_by").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)  # a group's bins
    counted = binned.groupBy("_by", "n", "_bin").agg(F.count("*").alias("_c")).withColumn("_before", F.sum("_c").over(w) - F.col("_c"))
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1)).alias("rank")) for name, p in at.items()]))
    wanted = counted.withColumn("_r", ranks).where((F.col("_r.rank") > F.col("_before")) & (F.col("_r.rank") <= F.col("_before") + F.col("_c")))
    wanted = wanted.select("_by", "_bin", F.col("_r.name").alias("_name"), (F.col("_r.rank") - F.col("_before")).alias("_rank"))
    inside = binned.join(wanted, ["_by", "_bin"]).groupBy("_by", "_name", "_rank", "_v").agg(F.count("*").alias("_c"))
    up = F.sum("_c").over(Window.partitionBy("_by", "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("_up", up).where("_up >= _rank").groupBy("_by").agg(*[F.min(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in at])
    return ends.select("_by", "n").join(found, "_by").select("_by.*", "n", *at)


def export_summary(flags: DataFrame, cohort: str = "cohort") -> DataFrame:
    """total_cases, eligible_cases and policy_closed_cases for each cohort, and over all with a null cohort."""
    closed = F.count_if("policy_closed").alias("policy_closed_cases")
    return flags.rollup(cohort).agg(F.count("*").alias("total_cases"), F.count_if(~F.col("policy_closed")).alias("eligible_cases"), closed)


def latency(flags: DataFrame, by: list[str] = ["cohort"]) -> DataFrame:  # noqa: B006
    """Nearest-rank p50 and p95 of all totals, and of the final totals of answered cases, each with its n."""
    x = flags.where(~F.col("policy_closed"))

    def part(rows: DataFrame, c: str) -> DataFrame:
        found = nearest_ranks(rows.select(*by, F.explode(c).alias("ms")), by, "ms", {f"{c}_p50": 0.5, f"{c}_p95": 0.95})
        return found.withColumnRenamed("n", f"{c}_n")

    return flags.select(*by).distinct().join(part(x, "totals_ms"), by, "left").join(part(x.where("has_answer"), "answer_ms"), by, "left").na.fill(0, ["totals_ms_n", "answer_ms_n"])


def error_codes(flags: DataFrame, by: list[str] = ["cohort"]) -> DataFrame:  # noqa: B006
    """Cases with each error code."""
    return flags.where(~F.col("policy_closed")).select(*by, F.explode("error_codes").alias("error_code")).groupBy(*by, "error_code").agg(F.count("*").alias("cases"))


def export_issues(rows: DataFrame) -> DataFrame:
    """case_id, issue, detail (D8): no rows at all, duplicate cases, feedback on and resolutions of unknown messages, closed
    tickets without resolution."""
    issue = lambda df, name, detail=None: df.select("case_id", F.lit(name).alias("issue"), (F.lit(None).cast("string") if detail is None else detail.cast("string")).alias("detail"))
    known = F.transform("messages", lambda m: m["message_id"])
    nothing = rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast(rows.schema["case_id"].dataType).alias("case_id"))
    twice = rows.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1")
    unknown = rows.select("case_id", F.explode(F.array_distinct(F.filter(F.transform("feedback", lambda f: f["message_id"]), lambda m: ~F.array_contains(known, m)))).alias("message_id"))
    lost = rows.where(F.col("resolution.message_id").isNotNull() & ~F.array_contains(known, F.col("resolution.message_id")))
    unresolved = rows.where(F.col("ticket_status").isin("resolved", "closed_policy") & F.col("resolution").isNull())
    return (
        issue(nothing, "no_rows")
        .unionByName(issue(twice, "duplicate_case"))
        .unionByName(issue(unknown, "feedback_of_unknown_message", F.col("message_id")))
        .unionByName(issue(lost, "resolution_of_unknown_message", F.col("resolution.message_id")))
        .unionByName(issue(unresolved, "closed_without_resolution", F.col("ticket_status")))
    )


def table_issues(cases: DataFrame, messages: DataFrame, feedback: DataFrame, tickets: DataFrame, resolved: DataFrame) -> DataFrame:
    """export_issues of case tables: what rows nested from them would show, without nesting them, so a task sorts ids alone.
    resolved (case_id, message_id) as resolution gives it; cases may be there twice (D8)."""
    issue = lambda df, name, detail: df.select("case_id", F.lit(name).alias("issue"), detail.cast("string").alias("detail"))
    none = F.lit(None)
    counted = cases.groupBy("case_id").agg(F.count("*").alias("n"))
    nothing = cases.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast(cases.schema["case_id"].dataType).alias("case_id"))
    once = counted.select("case_id")
    deal = lambda df: df.select("case_id", "message_id").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "case_id", "message_id")
    ids = deal(messages)  # partitions as asked for: ids shrink so well in a shuffle that few large tasks would be made of them
    unknown = deal(feedback.where("message_id is not null")).join(ids, ["case_id", "message_id"], "left_anti").distinct()
    lost = resolved.where("message_id is not null").join(ids, ["case_id", "message_id"], "left_anti")
    unresolved = tickets.where(F.col("ticket_status").isin("resolved", "closed_policy")).join(resolved, "case_id", "left_anti")
    found = issue(unknown, "feedback_of_unknown_message", F.col("message_id")).unionByName(issue(lost, "resolution_of_unknown_message", F.col("message_id")))
    found = found.unionByName(issue(unresolved, "closed_without_resolution", F.col("ticket_status"))).join(once, "case_id", "left_semi")
    return issue(nothing, "no_rows", none).unionByName(issue(counted.where("n > 1"), "duplicate_case", none)).unionByName(found)


def chat_mode(policy: Column, handoff: Column, ticket: Column) -> Column:
    """policy before handoff before operator (a ticket is open) before ai."""
    return F.when(policy, "policy").when(handoff, "handoff").when(ticket, "operator").otherwise("ai")


def outcome(decision: Column, clarified: Column) -> Column:
    """What a decision leads to."""
    return F.when((decision == "CLARIFY") & (clarified >= 1), "handoff_offer").when(decision == "CLARIFY", "clarify").when(decision == "ESCALATE", "handoff_offer").when(decision == "OUT_OF_SCOPE", "notice").otherwise("answer")


def receipts(commands: DataFrame, seen: DataFrame) -> DataFrame:
    """commands joined to receipts by (actor, operation, request_key): replay, conflict or new."""
    key = ["actor_id", "operation", "request_key"]
    return commands.join(seen.select(*key, F.col("body_hash").alias("seen_hash")), key, "left").withColumn("verdict", F.when(F.col("seen_hash").isNull(), "new").when(F.col("seen_hash") == F.col("body_hash"), "replay").otherwise("conflict"))


def merged_timings(before: Column, after: Column) -> Column:
    """Two maps as one: of a key in both the later value counts, unless it is null."""
    later = F.map_filter(after, lambda _k, v: v.isNotNull())
    return F.map_concat(F.map_filter(before, lambda k, _v: ~F.map_contains_key(later, k)), later)
