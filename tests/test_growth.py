"""What queries move must grow with their input, not with the pairs that copies make."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F
from oracle import SF

from caselake import plans, registry  # noqa: F401
from caselake.functions import text as T
from caselake.functions.encoder import HashingEncoder, encode
from caselake.operators import cases as C
from caselake.operators import evaluation as E
from caselake.operators import policy as PO
from caselake.operators import retrieval as R
from caselake.operators import routing as G
from caselake.plans.policy import RULES
from caselake.sources import io, publish
from caselake.streaming import stateful as P


def written_rows(spark) -> int:
    """Rows that all shuffles wrote so far."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = store.stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def moved(spark, df) -> tuple[int, int]:
    """Rows that a query returns, and rows that its shuffles wrote."""
    before = written_rows(spark)
    n = len(df.toArrow())
    return n, written_rows(spark) - before


def test_cards_meet_by_classes(spark):
    """many cards of one need and many queries of one fact; pairs are made in the last step only."""
    need = "array(struct('size' as key, string(id % 2) as value))"
    cards = spark.range(600).repartition(3).select(F.col("id").alias("card_id"), F.lit("reviewed").alias("status"), F.lit("a").alias("author_id"), F.lit("b").alias("reviewer_id"), F.lit("s").alias("snapshot_id"), F.expr(need).alias("required"))
    facts = spark.range(600).repartition(3).select(F.col("id").alias("query_id"), F.lit("size").alias("key"), F.concat(F.lit(" "), (F.col("id") % 2).cast("string")).alias("value"))
    n, rows = moved(spark, E.card_usable(cards, facts, "s"))
    assert n == 2 * 300 * 300
    assert rows < 30_000


def test_cards_of_odd_needs(spark):
    """Null keys and values and keys asked for twice never fit; several facts must all be there."""
    one = "array<struct<key:string,value:string>>"
    rows = [(1, [("a", "X "), ("b", "y")]), (2, [("a", None)]), (3, [(None, "x")]), (4, [("a", "x"), ("a", "x")]), (5, [("b", "z")]), (6, None)]
    cards = spark.createDataFrame([(i, "reviewed", "a", "b", "s", r) for i, r in rows], f"card_id long, status string, author_id string, reviewer_id string, snapshot_id string, required {one}")
    facts = spark.createDataFrame([(7, "a", "x"), (7, "b", " Y"), (8, "a", "x"), (9, "a", None), (9, None, "x"), (9, "b", "z"), (9, "b", "y")], "query_id long, key string, value string")
    assert sorted(map(tuple, E.card_usable(cards, facts, "s").collect())) == [(1, 7), (5, 9)]


def taxonomies(spark, n: int):
    """n topics of two keyword sets, and n queries whose tokens hold one of them or both."""
    kw = spark.range(n).repartition(3).select(F.col("id").alias("row_no"), F.explode(F.expr("if(id % 2 = 0, array('a', 'b'), array('c'))")).alias("keyword"))
    q = spark.range(n).repartition(3).select(F.col("id").alias("query_id"), F.explode(F.expr("if(id % 3 = 0, array('a', 'x', 'b'), array('b', 'c', 'a'))")).alias("token"))
    return kw, q


def test_containment_by_classes(spark):
    """copies of topics and of queries are paired in the last step."""
    n, rows = moved(spark, G.containment(*taxonomies(spark, 600)))
    assert n == 200 * 300 + 400 * 600
    assert rows < 40_000


def test_containment_in_lists(spark, monkeypatch):
    """a class that is one topic meets its queries in one piece; a class of many meets them in lists of bounded length."""
    one = spark.range(1000).repartition(3).withColumn("word", F.col("id").cast("string"))
    n, rows = moved(spark, G.containment(one.selectExpr("id as row_no", "word as keyword"), one.selectExpr("id as query_id", "word as token")))
    assert n == 1000
    assert rows < 16_000
    monkeypatch.setattr(G, "MANY", 8)
    kw, q = taxonomies(spark, 600)
    got = G.containment(kw, q.where("query_id < 20")).collect()
    assert sorted(map(tuple, got)) == sorted((i, t, 1 + (t % 2 == 0)) for i in range(20) for t in range(600) if t % 2 == 0 or i % 3)
    topics = G.held_classes(kw, q, "query_id", "row_no")[0]
    assert {r["pieces"] for r in topics.select("pieces").distinct().collect()} == {38}


def test_best_topic_by_classes(spark):
    """the best topics are those of all pairs, which are not made."""
    kw, q = taxonomies(spark, 600)
    topics = spark.range(600).select(F.col("id").alias("row_no"), F.expr("if(id = 2, 'u', 't')").alias("theme"), F.lit("s").alias("subtopic"))
    best = G.best_contained(kw, q, topics)
    n, rows = moved(spark, best)
    assert n == 600 and rows < 20_000
    few = [x.where(f"{c} < 40") for x, c in ((kw, "row_no"), (q, "query_id"), (topics, "row_no"))]
    assert sorted(map(tuple, G.best_contained(*few).collect())) == sorted(map(tuple, G.best_topic(G.containment(*few[:2]), few[2]).select(*best.columns).collect()))


def test_identifiers_once_for_all_queries(spark, tmp_path):
    """identifiers that many conversations name meet the documents once."""
    docs = spark.range(400).repartition(3).select(F.col("id").alias("doc_id"), F.lit("The Le cat 5").alias("text"))
    said = spark.range(300).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("The Le Zz").alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    said.write.parquet(f"{tmp_path}/conversations.parquet")
    docs.select(F.col("doc_id").alias("item_id"), "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, many in (("j5_exact_identifiers", 600), ("k3_exact_top20", 600 * 20), ("j6_unknown_identifiers", 300)):
        n, rows = moved(spark, registry.QUERIES[name](spark, str(tmp_path)))
        assert n == many, name
        assert rows < 30_000, name


class Held:
    """State of one key in memory, with the timers that were asked for."""

    def __init__(self) -> None:
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value) -> None:
        self.calls, self.value = self.calls + 1, value

    def registerTimer(self, at) -> None:  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at) -> None:  # noqa: N802
        self.timers.discard(at)


def test_deadlines_of_rows():
    """rows as such and at most two calls of the state for a key; a request that ends in the trigger it began in needs no timer."""
    row = lambda i, at, kind: Row(event_id=i, at=at * 1_000_000, kind=kind)
    for given, want, timers, calls in (([row(2, 9, "result"), row(1, 3, "message")], ["done"], set(), 2), ([row(1, 3, "message"), row(2, 99, "result")], [], {13_000}, 2), ([row(1, 3, "result")], [], set(), 1)):
        held, d = Held(), P.Deadlines(10)
        d.init(held)
        assert [r["status"] for r in d.handleInputRows((1, "a"), iter(given), None)] == want
        assert (held.timers, held.calls) == (timers, calls)


def test_all_events_move_the_watermark(spark, tmp_path):
    """Events that are neither messages nor results don't reach the state, but end requests by their time."""
    schema = "case_id long, request_key string, event_id long, ts timestamp, kind string"
    slices = [[(1, "a", 1, 0, "message")], [(2, "b", 2, 50, "other")], [(3, "c", 3, 51, "other")]]
    frames = [spark.createDataFrame(s, "case_id long, request_key string, event_id long, m int, kind string").select("case_id", "request_key", "event_id", F.expr("timestamp_seconds(1700000000 + 60 * m)").alias("ts"), "kind") for s in slices]
    out = str(tmp_path / "out")
    start = lambda e: P.request_deadlines(e, 600).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    with P.with_rocksdb(spark):
        P.run_slices(frames, str(tmp_path / "in"), lambda f: spark.readStream.schema(schema).parquet(f), start)
    assert [tuple(r) for r in spark.read.schema(P.REQUEST).parquet(out).collect()] == [(1, "a", "error", "RESTARTED", True)]


def test_corpus_statistics_without_postings(spark, tmp_path):
    """terms are counted before they are shuffled."""
    docs = spark.range(2000).repartition(3).select(F.col("id").alias("doc_id"), F.lit("a b c a d e").alias("text"))
    docs.unionByName(spark.createDataFrame([(5000, None), (5001, "...")], "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.QUERIES["a10_corpus_stats"](spark, str(tmp_path))
    n, written = moved(spark, rows)
    assert n == 4 and written < 1000
    assert {r["stat"]: r["value"] for r in rows.collect()} == {"terms": 5.0, "df_sum": 10_000.0, "docs": 2000.0, "avg_len": 6.0}


def test_readings_in_bounded_pieces(spark):
    """what is made of a batch of messages leaves the worker in pieces of so many signs, a long message alone."""
    seen = [(0, 3), (3, 4), (4, 5)]
    assert list(PO.pieces(["a" * 9, "", "b", "c" * PO.SIGNS, "d"])) == seen and list(PO.pieces([])) == []
    long = "в он " * (PO.SIGNS // 5)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([long, long, None, "д.у р"])], "id long, text string").coalesce(1)
    found = PO.match_candidates(rows, RULES, ["id"])
    assert [tuple(r) for r in found.where("id > 1").collect()] == [(3, "д*у", True), (3, "р", True), (3, "д*ур", True)]
    assert sum(b.num_rows > 0 for b in found.where("id < 2").toArrow().to_batches()) > 1


def test_words_are_judged_once():
    """rules see a reading once, however often it is said, and an empty set of requests reads no sentence."""
    rules = PO.Rules(RULES | {"human_request": {}})
    calls, rule = [], rules.profanity[0][1]
    rules.profanity = [("insult", type("Counted", (), {"hits": lambda _, *c: calls.append(c) or rule.hits(*c)})())]
    assert [rules.profane(x) for x in ("much s.id " * 500, "s.id st*pid much " * 500, "Idiot", "")] == [[], ["insult"], ["insult"], []]
    assert len(calls) == 2
    rules.folding.sentences = None
    assert rules.asks_human("of that. " * 100) == []


def test_requests_of_long_sentences():
    """what is near a marker is looked for around it alone."""
    human = PO.Rules(RULES).human
    assert human.sentence("that x x of " + "y " * 20) == [] and human.sentence("that x of " + "y " * 20) == [PO.TRANSFER]
    before = time.process_time()
    assert human.sentence("that " + "in " * 20_000) == [PO.NEED] * 2
    assert time.process_time() - before < 5  # all words around each of them would be 400 million


def test_issues_without_nested_rows(spark):
    """F8: issues of tables are those of the rows nested from them, which no task sorts."""
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    cases = t([(1, "live", "resolved"), (2, "live", "open"), (3, "demo", "resolved"), (3, "demo", "resolved"), (4, "demo", "open")], "case_id long, cohort string, case_status string")
    messages = t([(1, "a", 1, "answer"), (1, "b", 2, "question"), (3, "c", 1, "answer"), (9, "z", 1, "answer")], "case_id long, message_id string, seq long, kind string").selectExpr("*", "'ai' as responder_type", "'rag' as answer_origin")
    requests = t([(1, 1, "r", "final", None, 1.0)], "case_id long, created_at long, request_id string, status string, error_code string, total_ms double")
    feedback = t([(1, "a", "f", 1, True, True), (1, "c", "g", 1, True, False), (2, None, "h", 1, True, None), (2, "x", "i", 1, None, None), (2, "x", "j", 2, None, None), (9, "y", "k", 1, None, None), (None, "y", "l", 1, None, None)], "case_id long, message_id string, feedback_id string, updated_at long, useful boolean, solved boolean")
    tickets = t([(1, "resolved"), (3, "closed_policy"), (4, "new"), (8, "resolved")], "case_id long, ticket_status string")
    resolved = C.resolution(cases, messages, feedback.drop("case_id")).select("case_id", "resolution.message_id")
    issues = lambda df: sorted(map(str, df.distinct().collect()))
    found = C.table_issues(cases, messages, feedback, tickets, resolved)
    assert issues(found) == issues(C.export_issues(C.evaluation_rows(cases, messages, requests, feedback, tickets))) and found.count() == 4
    other = t([(1, "q")], "case_id long, message_id string")
    assert [r["detail"] for r in C.table_issues(cases, messages, feedback, tickets, other).where("issue like 'resolution%'").collect()] == ["q"]
    assert [tuple(r) for r in C.table_issues(cases.where("false"), messages, feedback, tickets, resolved).collect()] == [(None, "no_rows", None)]
    assert "collect_list" not in registry.QUERIES["d8_export_issues"](spark, SF)._jdf.queryExecution().toString()


def test_documents_without_a_shuffle(spark, tmp_path):
    """documents are made of rows where these are, and compressed."""
    rows = spark.range(1000).repartition(3).selectExpr("cast(id as string) as case_id", "'live' as cohort", "array(named_struct('message_id', 'é\"', 'kind', 'answer', 'responder_type', cast(null as string))) as messages").persist()
    rows.count()
    before = written_rows(spark)
    io.write_export_documents(rows, f"{tmp_path}/x", 300)
    assert written_rows(spark) == before
    files = list((tmp_path / "x").glob("part-*"))
    assert len(files) == 6 and all(f.name.endswith(".gz") for f in files)
    back = io.read_export(spark, f"{tmp_path}/x")
    assert sorted(back.select("case_id", "cohort", "messages").collect()) == sorted(rows.collect())


def test_texts_are_encoded_once(spark, tmp_path):
    """a token is hashed once, sums are exact when the table of tokens begins anew, and a count makes no vectors."""
    encoder = HashingEncoder(limit=4)
    texts = ["a B a b", "", "c d e f g h a", "a " * 50]
    one = lambda t: HashingEncoder()([t])[0]
    want = sum(one(t) for t in "c d e f g h a".split())
    got = encoder(texts)
    assert (got[2] == want).all() and (got[3] == 50 * one("a")).all() and not got[1].any() and len(encoder.place) <= 4
    made = spark.sparkContext.accumulator(0)

    def counting():
        return lambda texts: made.add(len(texts)) or np.ones((len(texts), 2), dtype=np.float32)

    rows = spark.range(100).repartition(2).select(F.col("id").alias("vec_id"), encode(F.col("id").cast("string"), counting).alias("embedding"))
    q = spark.createDataFrame([(7, [1.0, 1.0])], "query_id long, embedding array<double>")
    near = R.dense_top_k(rows, q)
    assert made.value == 0
    assert near.count() == 10 and made.value == 100


def test_documents_in_bounded_pieces(spark):
    """A batch is scored in pieces of so many tokens, with the same best documents."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([["a"] * n for n in (3, 4, 9, 1, 1)])], ["key", "tokens"])
    assert [(p.column("key").to_pylist(), len(p.column("tokens").flatten())) for p in R.pieces(iter([batch, batch.slice(3)]), 7)] == [([0, 1], 7), ([2], 9), ([3, 4], 2), ([3, 4], 2)]
    docs = spark.range(300).repartition(1).select(F.col("id").alias("doc_id"), F.expr("concat(repeat('a ', cast(id % 7 as int)), repeat('b ', cast(id % 5 as int)), 'c d', id % 11)").alias("text"))
    items = spark.createDataFrame([(1, "a d3"), (2, "b c d7"), (3, "zz")], "item_id long, text string")
    want = R.top(R.bm25(docs, items), ["item_id"], 10, "doc_id")
    told = lambda df: sorted((r["item_id"], r["doc_id"], r["place"], round(r["score"], 6)) for r in df.collect())
    assert told(R.bm25_top(docs, items)) == told(want)


def test_files_are_dealt(spark, tmp_path):
    """one task doesn't hash all files."""
    spark.range(400).repartition(40).write.parquet(f"{tmp_path}/x")
    hashed = publish.hash_files(spark, f"{tmp_path}/x")
    assert hashed.select(F.spark_partition_id()).distinct().count() > 1
    assert hashed.count() >= 40


def test_candidates_are_counted_where_they_are_read(spark, monkeypatch):
    """one row a query leaves each task, however many documents share a common word; the counts of all pairs."""
    docs = spark.range(2000).repartition(3).select(F.col("id").alias("doc_id"), F.expr("if(id % 10 = 9, null, concat('THE w', id % 7, ' ', repeat('w8-x ', cast(id % 3 as int)), 'Ёж v', id % 41))").alias("text"))
    items = spark.createDataFrame([(i, f"the w{i % 9} ёж w{i % 9}") for i in range(40)] + [(50, "v3 w8-x"), (51, ""), (52, "zz"), (53, None), (None, "v5"), (None, "v6")], "item_id long, text string")
    n, rows = moved(spark, R.bm25_candidates(docs, items))
    assert n == 42 and rows < 5000
    told = lambda df: sorted(map(str, df.select("item_id", "candidates", F.round("best", 6)).collect()))
    want = told(R.bm25(docs, items).groupBy("item_id").agg(F.count("*").alias("candidates"), F.max("score").alias("best")))
    assert told(R.bm25_candidates(docs, items)) == want
    for name, size in (("CHUNK", 8), ("CHUNK_PAIRS", 30), ("BYTES", 500), ("PAIRS", 50)):
        monkeypatch.setattr(R, name, size)
    assert told(R.bm25_candidates(docs, items, block_terms=40)) == want
    assert R.bm25_candidates(docs, items.where("item_id in (51, 53)")).count() == 0 and R.bm25_candidates(docs.where("false"), items).count() == 0


def test_tokens_of_bytes(spark):
    """Tokens found in the bytes of many texts are those that Spark finds in each."""
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("aZ09-_./ \nёЁпрПРЯяАйİKß—я漢😀ѐҐ"), rng.integers(0, 14))) if i % 9 else None for i in range(600)]
    want = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i").select(T.lower_tokens("text")).collect()]
    tokens, n = T.split_tokens(pa.array(["a", *texts])[1:])
    assert n.tolist() == [len(w) for w in want] and tokens.to_pylist() == [t for w in want for t in w]
    assert [len(x) for x in T.split_tokens(pa.array([None, ""], pa.string()))] == [0, 2]


def test_passages_are_found_where_they_are_read(spark, monkeypatch):
    """no row a window of a text is made, and nothing of the documents is shuffled; the pairs of all windows, in any blocks."""
    words = lambda i, n: [f"W{(i * i + i * k // 3) % 7}" for k in range(n)]
    texts = [(i, " ".join(words(i, i % 23))) for i in range(300)] + [(900, None), (901, ""), (902, "w0"), (None, " ".join(words(4, 20)))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    asked = [(i, " ".join(["zz", *words(3 * i, 6), "yy", *words(i + 1, 4)])) for i in range(30)] + [(50, None), (51, "w0 w1"), (None, "w1 w1 w1 w1")]
    items = spark.createDataFrame(asked, "item_id long, text string")
    windows = lambda t: {tuple(w[i : i + 4]) for w in [(t or "").lower().split()] for i in range(len(w) - 3)}
    want = sorted(str((q, i)) for q, x in asked for i, y in texts if q is not None and windows(x) & windows(y))
    n, rows = moved(spark, R.shared_passages(docs, items, 4))
    assert n == len(want) > 500 and rows == 0
    told = lambda df: sorted(str((r["item_id"], r["doc_id"])) for r in df.collect())
    assert told(R.shared_passages(docs, items, 4)) == want
    monkeypatch.setattr(R, "BYTES", 100)
    assert told(R.shared_passages(docs.repartition(3), items, 4, block_terms=90)) == want
    assert R.shared_passages(docs, items.where("item_id > 40"), 4).count() == 0 and R.shared_passages(docs.where("false"), items, 4).count() == 0
