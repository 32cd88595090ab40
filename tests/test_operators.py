"""Small tables with expected values for single operators."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from caselake.functions import russian as RU
from caselake.functions import text as T
from caselake.operators import cases as C
from caselake.operators import evaluation as E
from caselake.operators import kb, policy
from caselake.operators import retrieval as R
from caselake.operators import routing as G
from caselake.sources import io
from caselake.streaming import cases as S


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize("body,title,want", [("3", "", "content_is_page_number_only"), ("  12  ", "", "content_is_page_number_only"), ("1 Общие ..... 5", "", "content_is_table_of_contents"), ("7", "Раздел ....... 7", "content_is_table_of_contents"), ("", "", "empty_content"), (None, None, "empty_content"), ("12 13\n14", "", "content_is_blank_page"), ("Текст", "", None)])
def test_service_reason(spark, body, title, want):
    row = spark.createDataFrame([(body, title)], "b string, t string").select(kb.service_reason("b", "t").alias("r")).first()
    assert row["r"] == want


@pytest.mark.parametrize("body,want", [("см. рисунок", "pointer"), ("Рисунок 5", "incomplete"), ("РИСУНКЕ 1 и Приложение 2", "incomplete"), ("просто", "complete"), (None, "complete")])
def test_attachment(spark, body, want):
    assert one(spark, body, kb.attachment_status("x")) == want


@pytest.mark.parametrize("raw,want", [("supplier, customer", ["customer", "supplier"]), ("instruction", []), (None, []), ("Supplier,supplier", ["supplier"])])
def test_roles(spark, raw, want):
    assert one(spark, raw, kb.derive_roles("x")) == want


def test_identifiers(spark):
    assert one(spark, "Код YML-12 и ИНН, пункт 10.3.1, ИНН снова, слово", T.identifiers("x")) == ["YML-12", "ИНН", "10.3.1"]


def test_scrub(spark):
    got = one(spark, "a.b@c.ru, +7 (912) 345-67-89, ИНН: 7701234567", T.scrub("x"))
    assert got == "<email>, <phone>, ИНН <num>"


def test_titles(spark):
    df = spark.createDataFrame([("doc.pdf", "Порядок регистрации поставщика", "s"), ("", "1", ""), ("Хороший заголовок", "", "")], "t string, c string, s string")
    title, reason = kb.rebuilt_title("t", "c", "s")
    got = [tuple(r) for r in df.select(title, reason).collect()]
    assert got == [("Порядок регистрации поставщика", "title_was_filename"), ("unknown", "title_was_empty_no_replacement_in_content"), ("Хороший заголовок", "")]


def test_toc(spark):
    got = one(spark, "1.2 Регистрация в системе ........ 14", T.toc_entries("x"))
    assert [(r["number"], r["title"], r["page"]) for r in got] == [("1.2", "Регистрация в системе", 14)]


def test_chunks(spark):
    lines = spark.createDataFrame([(1, 1, i, " ".join(f"w{i}_{j}" for j in range(90))) for i in range(10)], "section long, page long, line_no long, line string")
    got = sorted(kb.chunk_sections(lines).collect(), key=lambda r: r["chunk_no"])
    assert all(r["n_tokens"] <= 400 for r in got) and all(r["n_tokens"] >= 220 for r in got[:-1])
    assert got[0]["text"].split()[-40:] == got[1]["text"].split()[:40]


@pytest.mark.parametrize("values,p50,p95", [([1, 2, 3, 4], 2, 4), ([10], 10, 10), ([], None, None), ([860, 2400, 2850, 3100, 5400], 2850, 5400)])
def test_nearest_rank(spark, values, p50, p95):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    r = df.agg(C.nearest_rank("x", 0.5).alias("a"), C.nearest_rank("x", 0.95).alias("b")).first()
    assert (r["a"], r["b"]) == (p50, p95)


def test_latest_keeps_the_earlier_of_equal_times(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 4, 3)], "m long, at long, pos long")
    assert C.latest(df, ["m"], "at", "pos").first()["pos"] == 1


def export_rows(spark, rows):
    return spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", io.EXPORT_ROW).alias("r")).select("r.*")


CASE = {"case_id": "a", "cohort": "demo", "case_status": "resolved", "policy_closed": False, "has_ticket": False, "ticket_status": None, "messages": [{"message_id": "m1", "kind": "answer", "responder_type": "ai"}], "requests": [{"status": "final", "error_code": None, "total_ms": 860.0}, {"status": "error", "error_code": None, "total_ms": 130000.0}], "feedback": [{"message_id": "m1", "updated_at": "2024-01-01T00:00:00Z", "useful": True, "solved": False}, {"message_id": "m1", "updated_at": "2024-01-02T00:00:00Z", "useful": False, "solved": True}, {"message_id": "zz", "updated_at": "2024-01-02T00:00:00Z", "useful": True, "solved": None}], "resolution": {"message_id": "m1", "confirmed_by": "user", "answer_origin": "rag"}}
CLOSED = {"case_id": "b", "cohort": "live", "case_status": "closed", "policy_closed": True, "has_ticket": False, "messages": [], "requests": [], "feedback": []}


def test_metrics(spark):
    rows = export_rows(spark, [CASE, CLOSED])
    flags = C.case_flags(rows)
    f = {r["case_id"]: r for r in flags.collect()}["a"]
    assert f["confirmed_auto"] and f["has_timeout"] and f["dangling"] and f["error_codes"] == ["UNKNOWN"]
    assert (f["ai_useful_n"], f["ai_useful_k"], f["solved_n"], f["solved_k"]) == (1, 0, 1, 1)
    rates = {(r["cohort"], r["metric"]): (r["n"], r["k"], r["value"]) for r in C.cohort_rates(flags).collect()}
    assert rates["demo", "solved_rate"] == (1, 1, 1.0) and rates["live", "solved_rate"] == (0, 0, None) and rates["live", "errors"] == (None, 0, None)
    lat = {r["cohort"]: r for r in C.latency(flags).collect()}
    assert lat["demo"]["totals_ms_p95"] == 130000.0 and lat["demo"]["answer_ms_p50"] == 860.0 and lat["live"]["totals_ms_n"] == 0
    assert [tuple(r) for r in C.error_codes(flags).collect()] == [("demo", "UNKNOWN", 1)]
    issues = {r["issue"] for r in C.export_issues(rows.union(rows)).collect()}
    assert issues == {"duplicate_case", "feedback_of_unknown_message"}
    assert [tuple(r) for r in C.export_issues(rows.where("false")).collect()] == [(None, "no_rows", None)]
    odd = export_rows(spark, [CASE | {"resolution": {"message_id": "q", "confirmed_by": "user", "answer_origin": "rag"}, "feedback": []}, CLOSED | {"ticket_status": "closed_policy"}])
    assert sorted(tuple(r) for r in C.export_issues(odd).collect()) == [("a", "resolution_of_unknown_message", "q"), ("b", "closed_without_resolution", "closed_policy")]


def test_nearest_ranks(spark):
    import math
    import random

    draw = random.Random(2)
    groups = {"a": [draw.gauss(0, 5) for _ in range(500)], "b": [7.0] * 40, None: [1.0, 2.0, 3.0, 4.0], "skew": [0.0] * 90 + [1e9] + [draw.random() for _ in range(30)], "one": [5.0]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("none", None)], "g string, v double")
    at = {"p50": 0.5, "p95": 0.95, "p100": 1.0, "p0": 0.0}
    got = {r["g"]: r for r in C.nearest_ranks(rows, ["g"], "v", at, bins=8).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g]["n"] == len(vs) and all(got[g][name] == sorted(vs)[max(0, math.ceil(p * len(vs)) - 1)] for name, p in at.items())


def test_feedback_rules(spark):
    messages = spark.createDataFrame([("m1", "s1", "answer", "ai", "rag"), ("m2", "s1", "answer", "operator", "operator"), ("m3", "s1", "question", None, None)], "message_id string, session_id string, kind string, responder_type string, answer_origin string")
    rows = [("s1", "m1", None, True, None, "ok"), ("s1", "m1", 5, None, None, "rating_of_no_operator"), ("s1", "m2", 5, None, None, "ok"), ("s1", "m3", None, True, None, "not_an_answer"), ("s2", "m1", None, True, None, "not_found"), ("s1", "zz", None, True, None, "not_found"), ("s1", "m1", None, None, None, "no_rating"), ("s1", None, None, True, None, "not_found")]
    fb = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "session_id string, message_id string, specialist_rating int, useful boolean, solved boolean, want string, i int")
    got = C.feedback_verdict(fb, messages).collect()
    assert len(got) == len(rows) and all(r["verdict"] == r["want"] for r in got)


def test_handoff_context(spark):
    df = spark.createDataFrame([(1, ["b", "a"], [(1, ["a", "c"]), (2, None), (3, ["d", "b"])]), (2, None, [])], "case_id long, basis_source_ids array<string>, messages array<struct<seq:int,source_ids:array<string>>>")
    assert {r["case_id"]: r["source_ids"] for r in C.handoff_context(df).collect()} == {1: ["b", "a", "c", "d"], 2: []}


def test_merge_hits(spark):
    df = spark.createDataFrame([(1, 1, "dense", 9.0), (1, 1, "exact", 1.0), (1, 2, "fts", 3.0), (1, 2, "fts", 5.0)], "query_id long, doc_id long, method string, score double")
    assert sorted(map(tuple, R.merge_hits(df).collect())) == [(1, 1, "exact", 1.0), (1, 2, "fts", 5.0)]


def test_role_gate(spark):
    df = spark.createDataFrame([([], False, "supplier"), (["supplier"], True, None), (["supplier"], True, "supplier"), (["supplier"], True, "customer")], "r array<string>, v boolean, q string")
    assert [r[0] for r in df.select(R.role_gate(F.col("r"), F.col("v"), F.col("q"))).collect()] == ["unverified", "needs_role", "ok", "mismatch"]


def test_exact_needs_every_part(spark):
    posts = R.postings(spark.createDataFrame([(1, "yml 12"), (2, "yml 13")], "doc_id long, text string"), "doc_id", "text")
    ids = spark.createDataFrame([(7, "YML-12"), (7, "ZZZ-1")], "query_id long, identifier string")
    hits = R.exact_hits(posts, ids)
    assert [tuple(r) for r in hits.collect()] == [(7, "YML-12", 1)]
    assert [r["identifier"] for r in R.unknown_identifiers(ids, hits).collect()] == ["ZZZ-1"]


def test_dense(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in R.dense_top_k(v, v.where("vec_id = 1").withColumnRenamed("vec_id", "query_id"), 4).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.0, (1, 4): 0.0, (1, 3): -1.0}
    assert {r["vec_id"]: r["reason"] for r in R.vector_violations(v, 2).collect()} == {4: "norm"}


@pytest.mark.parametrize("text,want", [("постоянно не работает подпись", True), ("не работает", False), ("Ошибка «Сервер недоступен» каждый раз", True), (None, False)])
def test_defects(spark, text, want):
    assert one(spark, text, G.defect_signals("x")["probable_defect"]) is want


def test_recipient(spark):
    assert one(spark, "Необходимо обратиться в Федеральное казначейство, далее", G.recipient("x")) == "Федеральное казначейство"


def test_agreement_and_kappa(spark):
    p = spark.createDataFrame([("1", "c", 1, 1), ("2", "c", 0, 1), ("3", "c", None, 1), ("4", "c", 2, 2)], "pair_id string, dim string, score_a int, score_b int")
    a = E.agreement(p).first()
    assert (a["n"], a["matches"], a["value"]) == (4, 2, 0.5)
    assert round(E.kappa(p).first()["kappa"], 6) == 0.5


@pytest.mark.parametrize("summary,cited,grounding,want", [("Срок 5 дней", ["a"], ["5 дней"], None), ("Срок 6 дней", ["a"], ["5 дней"], "ungrounded_number"), ("", ["a"], [], "empty_answer"), ("x", ["b"], [], "unsupplied_source"), ("см. https://x.ru", ["a"], [], "url"), ("Операция выполнена", ["a"], [], "claimed_action")])
def test_answer_audit(spark, summary, cited, grounding, want):
    df = spark.createDataFrame([(summary, cited, grounding)], "s string, c array<string>, g array<string>")
    none = F.array().cast("array<string>")
    assert df.select(E.answer_fault(F.col("s"), none, none, F.col("c"), F.array(F.lit("a")), none, F.col("g"))).first()[0] == want


RULES = {
    "ruleset_version": "test.1",
    "normalization": {"fold_yo": True, "max_char_run": 3, "zero_width": ["\u200b", "\u00ad"], "homoglyph_map": {"a": "а", "c": "с", "e": "е", "o": "о", "p": "р", "y": "у", "k": "к", "b": "в", "x": "х"}, "digit_map": {"0": "о", "3": "з", "4": "ч", "6": "б"}, "word_merge": {"max_words": 5, "max_word_len": 3, "require_short_word_len": 2}},
    "technical_spans": [{"id": "URL", "pattern": "https?://\\S+"}, {"id": "SNAKE", "pattern": "\\b[A-Za-z]+_[A-Za-z_]+\\b"}],
    "profanity_rules": [
        {"rule_id": "P.STEM", "kind": "stem", "atoms": ["д", "у", "р", "ао", "к"], "prefixes": ["", "по", "не"], "max_suffix": 3, "max_masked": 1, "exception_token_prefixes": ["дуракав"]},
        {"rule_id": "P.TWO", "kind": "stem", "atoms": ["х", "р"], "prefixes": [""], "max_suffix": 0, "max_masked": 1},
        {"rule_id": "P.EXACT", "kind": "exact", "script": "cyrillic", "max_masked": 1, "tokens": ["болван", "чурбан"]},
        {"rule_id": "P.LATIN", "kind": "exact", "script": "latin", "max_masked": 1, "tokens": ["bolvan"]},
    ],
    "human_request": {
        "person_targets": ["оператор", "специалист", "человек"], "channel_targets": ["поддержк"], "transfer_markers": ["позовите", "соедините"], "need_markers": ["нужен", "хочу", "соедините"], "max_gap_tokens": 3,
        "phrase_rules": [{"rule_id": "H.LIVE", "pattern": "\\bжив(?:ой|ым)\\s+челове"}], "politeness_tokens": ["пожалуйста", "мне", "нужен"],
        "suppressors": [{"rule_id": "POL.HUMAN.SUPPRESS.HOWTO", "question_pattern": "\\bкак\\b", "contact_pattern": "\\b(связат|найти)"}, {"rule_id": "POL.HUMAN.SUPPRESS.NEGATION", "pattern": "\\bне\\s+(?:нужен|хочу)\\b"}],
    },
}

PROFANE = [
    ("ты дурак", "P.STEM"), ("ДУРАК!", "P.STEM"), ("д.у р а к", "P.STEM"), ("дypaк", "P.STEM"), ("ду*ак", "P.STEM"), ("д**ак", ""), ("дууурак", "P.STEM"), ("дууууууурак", "P.STEM"), ("подураки", "P.STEM"), ("дуракаваляние", ""), ("мудурак", ""),
    ("дурачьё всякое", ""), ("дур0к", "P.STEM"), ("ду9ак", "P.STEM"), ("duрак", ""), ("ду\u200bрак", "P.STEM"), ("д-у-р-а-к-у", "P.STEM"), ("https://дурак.ru", ""), ("some_дурак", ""), ("х.р", "P.TWO"), ("х*", ""), ("болван", "P.EXACT"), ("бо-л-ван", "P.EXACT"), ("б*лван", "P.EXACT"), ("б*лв*н", ""), ("болвана", ""), ("bolvan", "P.LATIN"), ("бolvan", ""),
    ("bo lv an", "P.LATIN"), ("дурак и болван", "P.STEM,P.EXACT"), ("", ""), (None, ""), (" ... !!! ", ""), ("дурак " * 3000, "P.STEM"),
]
ASKS = [
    ("Позовите оператора", "POL.HUMAN.TRANSFER_REQUEST"), ("нужен специалист", "POL.HUMAN.NEED_PERSON,POL.HUMAN.TARGET_ONLY"), ("нужен сейчас специалист", "POL.HUMAN.NEED_PERSON"), ("нужна поддержка", ""), ("хочу в поддержку", ""), ("соедините с поддержкой", "POL.HUMAN.TRANSFER_REQUEST"), ("оператор", "POL.HUMAN.TARGET_ONLY"), ("Оператор, пожалуйста!", "POL.HUMAN.TARGET_ONLY"), ("не нужен оператор", ""),
    ("не хочу ждать. соедините с оператором", "POL.HUMAN.TRANSFER_REQUEST"), ("Как связаться с оператором?", ""), ("Как связаться с банком? Позовите оператора", "POL.HUMAN.TRANSFER_REQUEST"), ("это ужасный сервис", ""), ("позовите а б в г оператора", ""), ("дайте живой человек", "H.LIVE"), ("не нужен бот, позовите человека", "POL.HUMAN.TRANSFER_REQUEST"), ("нужен договор; специалист подписал", ""), (None, ""),
]


def test_policy(spark):
    rows = [(i, x, w, "") for i, (x, w) in enumerate(PROFANE)] + [(100 + i, x, "", w) for i, (x, w) in enumerate(ASKS)]
    df = spark.createDataFrame([(i, x) for i, x, _, _ in rows], "id long, text string")
    got = {r["id"]: r for r in policy.policy_labels(df, RULES, ["id"]).collect()}
    for i, x, profane, asks in rows:
        assert (",".join(got[i]["profanity"]), ",".join(got[i]["human"])) == (profane, asks), x
        assert got[i]["verdict"] == ("policy_closed" if profane else "handoff" if asks else "pass") and got[i]["human_request"] == bool(asks)
    both = policy.policy_labels(spark.createDataFrame([(1, "дурак, позовите оператора")], "id long, text string"), RULES, ["id"]).first()
    assert both["verdict"] == "policy_closed" and both["human"] == [] and not both["human_request"]


def test_policy_readings(spark):
    df = spark.createDataFrame([(1, "п3р о д he.llo"), (2, None), (3, "some_name")], "id long, text string")
    got = sorted(map(tuple, policy.match_candidates(df, RULES, ["id"]).collect()))
    assert got == sorted([(1, "пзр", True), (1, "п*р", True), (1, "о", True), (1, "д", True), (1, "he*llo", False), (1, "пзро", True), (1, "пзрод", True), (1, "од", True)])


def test_fold_and_technical(spark):
    df = spark.createDataFrame([("ЁЖ ſ ß Ａ ааааа\u00ad", 1), (None, 2)], "text string, id long")
    assert [r[0] for r in df.select(T.fold(RU.nfkc("text"))).collect()] == ["еж s ss a ааа", ""]
    said = 'до see www.a.ru/x и C:\\dir\\sub\\f.txt File "a b", line 12 и a.b.c snake_name _under camelCase 0xDEADBEEF 12345 ёлка123 x+y@d-e.fg'
    clean, hits = spark.createDataFrame([(said,)], "text string").select(*T.mask_technical("text")).first()
    assert " ".join(clean.split()) == "до see и и ёлка123"
    assert list(hits) == ["TECH.WWW", "TECH.EMAIL", "TECH.HEX", "TECH.STACKFRAME", "TECH.PATH", "TECH.DOTTED_IDENT", "TECH.SNAKE_IDENT", "TECH.UNDERSCORE_IDENT", "TECH.CAMEL_IDENT", "TECH.DIGIT_RUN"]


def test_cards(spark):
    cards = spark.createDataFrame([("c1", "reviewed", "a", "b", "s", [("role", " Supplier ")]), ("c2", "reviewed", "a", "a", "s", []), ("c3", "reviewed", "a", "b", "s", [])], "card_id string, status string, author_id string, reviewer_id string, snapshot_id string, required array<struct<key:string,value:string>>")
    facts = spark.createDataFrame([("q1", "role", "supplier"), ("q2", "role", "customer")], "query_id string, key string, value string")
    assert sorted(map(tuple, E.card_usable(cards, facts, "s").collect())) == [("c1", "q1"), ("c3", None)]


def event(i, kind, key=None, h="h", version=None, outcome=None, useful=None, solved=None, case=1):
    return (case, i, dt.datetime(2024, 1, 1, 0, i), kind, key, h, version, outcome, useful, solved)


FOLDS = {
    # events of a case -> reason of each
    "receipts": ([event(1, "message", "k1"), event(2, "message", "k1"), event(3, "message", "k1", h="x"), event(4, "policy", "k1"), event(5, "handoff", "k1"), event(6, "message", None), event(7, "message", None)], ["", "replay", "conflict", "replay", "invalid_transition", "busy", "busy"]),
    "versions": ([event(1, "message", "k1", version=0), event(2, "policy", "k2", version=0), event(3, "message", "k1", version=7), event(4, "policy", "k3", version=1)], ["", "stale_version", "replay", ""]),
    "late results": ([event(1, "result", "k1"), event(2, "message", "k1"), event(3, "result", "k0"), event(4, "policy", "k2"), event(5, "result", "k1"), event(6, "message", "k3")], ["late_result", "", "late_result", "", "late_result", "terminal"]),
    "clarify once": ([event(1, "message", "a"), event(2, "result", "a", outcome="clarify"), event(3, "message", "b"), event(4, "result", "b", outcome="clarify"), event(5, "handoff", "h"), event(6, "handoff", "h2")], ["", "", "", "", "", "existing_ticket"]),
    "ticket": ([event(1, "message", "a"), event(2, "result", "a", outcome="handoff_offered"), event(3, "handoff", "h"), event(4, "message", "b"), event(5, "reply", "r"), event(6, "reply", "r2"), event(7, "message", "c"), event(8, "reply", "r3", solved=True), event(9, "reply", "r4")], ["", "", "", "invalid_transition", "", "invalid_transition", "", "", "invalid_transition"]),
    "feedback": ([event(1, "message", "a"), event(2, "result", "a"), event(3, "feedback", "zz", useful=True), event(4, "feedback", "a"), event(5, "feedback", "a", useful=True), event(6, "feedback", "a"), event(7, "feedback", "a", solved=False), event(8, "message", "b"), event(9, "feedback", "a", solved=True), event(10, "result", "b"), event(11, "feedback", "b", solved=True), event(12, "feedback", "b", solved=False), event(13, "nonsense", "q"), event(14, "reply", "r")],
                 ["", "", "not_found", "no_rating", "saved", "saved", "", "", "answer_not_current", "", "", "answer_not_current", "unknown_kind", "no_ticket"]),
}


def test_case_fold(spark):
    rows = [(no, *e[1:]) for no, (events, _) in enumerate(FOLDS.values()) for e in events]
    got = sorted(S.fold_batch(spark.createDataFrame(rows, S.EVENT)).collect(), key=lambda r: (r["case_id"], r["event_id"]))
    for no, (name, (_, want)) in enumerate(FOLDS.items()):
        assert [r["reason"] for r in got if r["case_id"] == no] == want, name
    last = {name: [r for r in got if r["case_id"] == no][-1] for no, name in enumerate(FOLDS)}
    assert (last["late results"]["status"], last["clarify once"]["status"], last["ticket"]["ticket"], last["feedback"]["status"]) == ("closed_policy", "handed_off", "resolved", "resolved")
    assert [r["cancelled"] for r in got if r["cancelled"]] == ["k1", "k1"]


def test_batch_receipts_and_feedback(spark):
    c = spark.createDataFrame([("u", "chat", "k", 1, 10, "h"), ("u", "chat", "k", 2, 11, "h"), ("u", "chat", "k", 3, 12, "x"), ("u", "chat", "k", 4, 9, "y"), ("u", "handoff", "k", 5, 13, "h"), ("u", "chat", None, 6, 14, "h"), ("u", "chat", None, 7, 15, "h")], "actor_id string, operation string, request_key string, event_id long, ts long, body_hash string")
    assert [r["verdict"] for r in sorted(S.receipts_of(c).collect(), key=lambda r: r["event_id"])] == ["conflict", "conflict", "conflict", "new", "new", "new", "new"]
    f = spark.createDataFrame([(1, 5, 1, True, None), (1, 6, 2, None, False), (1, 4, 3, False, True), (2, 1, 4, None, None)], "m long, ts long, event_id long, useful boolean, solved boolean")
    assert sorted(map(tuple, S.merged_feedback(f, ["m"], ["useful", "solved"]).collect())) == [(1, True, False, 6), (2, None, None, 1)]


def test_case_fold_holds_one_batch(spark):
    import pyarrow as pa

    fields = [f.split() for f in S.EVENT.split(", ")]
    rows = [dict.fromkeys([n for n, _ in fields]) | {"case_id": c, "event_id": i, "kind": "handoff" if i else "message", "request_key": f"r{i}", "body_hash": "h"} for c in (1, 2) for i in range(5)]
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us")}[t]) for n, t in fields])
    read = []

    def batches():
        for at in range(0, 10, 3):
            read.append(at)
            yield pa.RecordBatch.from_pylist(rows[at : at + 3], schema=schema)

    folded = S.fold_sorted(batches())
    first = next(folded)
    assert first.num_rows == 3 and read == [0]
    versions = first.column("version").to_pylist() + [v for b in folded for v in b.column("version").to_pylist()]
    assert versions == [1] * 10


def test_stream_equals_batch(spark):
    from oracle import SF

    from caselake import plans, registry  # noqa: F401

    a, b = (sorted(map(str, registry.QUERIES[n](spark, SF).collect())) for n in ("t1_case_fold", "t1_case_fold_stream"))
    assert a == b
    every, closed = (set(map(str, registry.QUERIES[n](spark, SF).collect())) for n in ("t9_windowed_metrics", "t9_windowed_metrics_stream"))
    assert closed < every  # the watermark leaves the last windows open


def test_streams_read_folders(spark, tmp_path):
    """Events as a folder of parts, and as one file of that name."""
    from oracle import SF

    from caselake.plans import streams

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/d/events.parquet")
    for path in (f"{tmp_path}/d/events.parquet", f"{SF}/events.parquet"):
        out = f"{tmp_path}/out-{len(path)}"
        rows = io.case_event_stream(spark, path, streams.RAW)
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(out).count() == events.count()
    a, b = (sorted(map(str, streams.t1_stream(spark, d).collect())) for d in (f"{tmp_path}/d", SF))
    assert len(a) == len(b)


def test_readers(spark, tmp_path):
    (tmp_path / "kb.jsonl").write_text('{"id": "1", "content": "x"}\n\n{broken\n')
    rows, bad = io.read_kb_raw(spark, str(tmp_path / "kb.jsonl"))
    assert [r["id"] for r in rows.select("id").collect()] == ["1"] and bad.count() == 1
    (tmp_path / "tax.json").write_text('{"rows": [{"row_no": 1, "theme": "t"}]}')
    assert io.read_taxonomy(spark, str(tmp_path / "tax.json")).first()["theme"] == "t"
    (tmp_path / "r.jsonl").write_text('{"pair_id": "1", "rater_id": "a", "clarity": 2}\n{"pair_id": "1", "rater_id": "b", "ratings": {"clarity": 1}}\n')
    assert sorted((r["rater_id"], r["score"]) for r in io.read_ratings(spark, str(tmp_path / "r.jsonl")).where("dim = 'clarity'").collect()) == [("a", 2), ("b", 1)]
    found = io.hash_inputs(spark, str(tmp_path))
    told = {r["name"]: r["verdict"] for r in io.verify_inputs(found, spark.createDataFrame([("kb.jsonl", "0"), ("gone", "0")], "name string, sha256 string")).collect()}
    assert told == {"kb.jsonl": "changed", "gone": "missing"}


@pytest.mark.parametrize("word,want", [("ИНН", "инн"), ("договоры", "договор"), ("договоров", "договор"), ("прайс-листы", "прайс-лист"), ("YML-12", "yml-12"), ("контракты", "контракт"), ("контрактам", "контракт"), ("поставщика", "поставщик"), ("поставщику", "поставщик"), ("оферты", "оферт"), ("офертой", "оферт"), ("СТЕ", "сте"), ("УПД", "упд"), ("running", "running"), ("2024", "2024"), ("регистрация", "регистрац"), ("подписать", "подписа"), ("ё", "е")])
def test_normal_tokens(word, want):
    from caselake.functions.russian import normalise

    assert normalise(word) == want


def test_clean_text():
    from caselake.functions.russian import clean

    assert clean("Первая строка\nпродолжение\n\n\n1. Пункт\r\nТекст.\nНовый  текст") == "Первая строка продолжение\n\n1. Пункт Текст.\nНовый текст"


def test_dense_blocks(spark, monkeypatch):
    """Several blocks of queries and vectors, ties, nulls and odd sizes against plain loops."""
    import random

    draw = random.Random(5)
    rows = [(i, [float(draw.randint(-2, 2)) for _ in range(4)]) for i in range(120)] + [(200, None), (201, [1.0, None, 0.0, 1.0]), (202, [0.0] * 4), (203, [1.0, 2.0]), (204, []), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 10 = 0 or vec_id > 199").withColumnRenamed("vec_id", "query_id")
    monkeypatch.setattr(R, "QUERY_BLOCK", 5)
    monkeypatch.setattr(R, "VECTOR_BLOCK", 17)
    got = {}
    for r in R.dense_top_k(df, queries, 6).collect():
        got.setdefault(r["query_id"], []).append((r["place"], r["vec_id"], r["score"]))
    known = {i: [x or 0.0 for x in v] for i, v in rows if i is not None and v}

    def cosine(a, b):
        n = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 6) if n else 0.0

    for q in [i for i in known if i % 10 == 0 or i > 199]:
        near = sorted((-cosine(known[q], v), i) for i, v in known.items() if len(v) == len(known[q]))[:6]
        assert [(p, i) for p, i, _ in sorted(got.pop(q))] == [(n + 1, i) for n, (_, i) in enumerate(near)]
    assert not got


def test_bm25_top_equals_joins(spark, monkeypatch):
    """Whatever blocks queries and pairs are cut in, and for ids of any type; queries that match nothing have no rows."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}" for k in range(i % 30))) for i in range(200)] + [(900, None), (901, "the the the w1"), (None, "w1 w2")], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"w{i} the W{i + 1} w{i} zzz") for i in range(20)] + [(50, None), (51, "nothing here"), (None, "w1")], "item_id long, text string")
    rounded = lambda df: sorted((str(r["item_id"]), r["place"], str(r["doc_id"]), round(r["score"], 6)) for r in df.collect())
    joined = rounded(R.top(R.bm25(docs.where("doc_id is not null"), items.where("item_id is not null")), ["item_id"], 7, "doc_id"))
    assert rounded(R.bm25_top(docs, items, 7)) == joined and len(joined) > 100
    monkeypatch.setattr(R, "PAIRS", 40)
    assert rounded(R.bm25_top(docs.repartition(3), items, 7, block_terms=15)) == joined
    words = lambda df, c: df.withColumn(c, F.concat(F.lit("k"), F.lpad(F.col(c).cast("string"), 4, "0")))
    named = R.bm25_top(words(docs, "doc_id"), words(items, "item_id"), 7).select(F.substring("item_id", 2, 9).cast("int").alias("item_id"), F.substring("doc_id", 2, 9).cast("int").alias("doc_id"), "place", "score")
    assert rounded(named) == joined
    assert R.bm25_top(docs.where("false"), items).count() == 0 and R.bm25_top(docs, items.where("item_id = 51")).count() == 0


def test_encoder_is_made_once_a_task(spark):
    from caselake.functions.encoder import HashingEncoder, encode

    made = spark.sparkContext.accumulator(0)

    def factory():
        made.add(1)
        return HashingEncoder(8)

    rows = [(i, x) for i, x in enumerate(["a b", None, "", "A  b", "b-a"] * 200)]
    got = spark.createDataFrame(rows, "i long, x string").coalesce(1).select("i", encode("x", factory, 7).alias("v")).collect()
    got = sorted(got, key=lambda r: r["i"])
    assert made.value == 1 and len(got) == 1000
    assert got[0]["v"] == got[3]["v"] != got[4]["v"] and got[1]["v"] == got[2]["v"] == [0.0] * 8


def test_numbered_by_quantiles(spark):
    """A third of the rows share one value and the rest are spread very unevenly: places are right, and buckets of unequal values
    are about even."""
    rows = [(i, "g" if i % 5 else None, 7 if i % 3 == 0 else None if i % 97 == 1 else 2 ** (i % 40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, g string, x long")
    key = lambda r: (r[2] is not None, r[2] or 0, r[0])
    want = {r[0]: n for g in ("g", None) for n, r in enumerate(sorted((r for r in rows if r[1] == g), key=key), 1)}
    assert {r["i"]: r["place"] for r in kb.numbered(df, ["g"], ["x", "i"], bucket_rows=100).collect()} == want
    wide = df.where("x <> 7")
    edges = kb.bucket_edges(wide, "x", 100)
    counts = [r["n"] for r in wide.groupBy(kb.bucket_of(F.col("x").cast("double"), edges).alias("b")).agg(F.count("*").alias("n")).collect()]
    assert len(edges) == 31 and max(counts) <= 5 * sum(counts) / len(counts)
    assert kb.numbered(df.where("false"), ["g"], ["x", "i"]).count() == 0


def test_chunks_of_interleaved_sections(spark):
    """Against the greedy rule over whole sections, with lines of any length, null lines and sections in one partition."""
    import random

    rng = random.Random(4)
    rows = [(s, n // 9, n, None if n % 11 == 5 else " ".join(f"t{s}.{n}.{k}" for k in range(rng.choice([0, 3, 17, 60])))) for s in (1, 2, None, 3) for n in range(40 if s != 3 else 0)]
    want = []
    for s in (1, 2, None):
        held, pages, no = [], [], 0
        for _, page, _, line in [r for r in rows if r[0] == s]:
            words = (line or "").split()
            while words:
                if len(held) + len(words) > 50 and len(held) >= 20:
                    want.append((s, no, min(pages), max(pages), len(held), " ".join(held)))
                    held, pages, no = held[-7:], pages[-1:], no + 1
                room = 50 - len(held)
                held, pages, words = held + words[:room], [*pages, page], words[room:]
        want.append((s, no, min(pages), max(pages), len(held), " ".join(held)))
    rng.shuffle(rows)
    got = kb.chunk_sections(spark.createDataFrame(rows, "section long, page int, line_no int, line string").coalesce(1), 20, 50, 7).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
