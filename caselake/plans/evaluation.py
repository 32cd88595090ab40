"""Evaluation queries: labels as ratings, benchmark items as gold, conversations as answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..registry import query, read
from .retrieval import BM25, best

PAIRS = "r AS (SELECT doc_id AS pair_id, 'quality' AS dim, quality AS score_a, CASE WHEN toxic = 1 THEN 1 - quality ELSE quality END AS score_b FROM labels UNION ALL SELECT doc_id, 'toxic', toxic, CASE WHEN quality = 0 THEN NULL ELSE toxic END FROM labels)"


def pairs(spark, d):
    labels = read(spark, d, "labels").withColumnRenamed("doc_id", "pair_id")
    a = E.unpivot_ratings(labels, ["pair_id"], ["quality", "toxic"])
    other = labels.select("pair_id", F.when(F.col("toxic") == 1, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"), F.when(F.col("quality") != 0, F.col("toxic")).alias("toxic"))
    p = E.rater_pairs(a, E.unpivot_ratings(other, ["pair_id"], ["quality", "toxic"]))
    return p.select("pair_id", "dim", F.col("score_a").cast("double").alias("score_a"), F.col("score_b").cast("double").alias("score_b"))


@query("j19_rater_pairs", f"WITH {PAIRS} SELECT pair_id, dim, CAST(score_a AS DOUBLE) AS score_a, CAST(score_b AS DOUBLE) AS score_b FROM r")
def j19(spark, d):
    return pairs(spark, d)


@query("a21_agreement", f"WITH {PAIRS} SELECT dim, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (score_a = score_b) AS BIGINT) AS matches, CAST(count(*) - count(*) FILTER (score_a = score_b) AS BIGINT) AS mismatches, count(*) FILTER (score_a = score_b) / count(*)::DOUBLE AS value FROM r GROUP BY dim")
def a21(spark, d):
    return E.agreement(pairs(spark, d))


@query("a22_kappa", f"WITH {PAIRS}, b AS (SELECT * FROM r WHERE score_a IS NOT NULL AND score_b IS NOT NULL), n AS (SELECT dim, count(*) AS n, count(*) FILTER (score_a = score_b) AS s FROM b GROUP BY dim), c AS (SELECT x.dim, sum(x.k * y.k) AS ch FROM (SELECT dim, score_a AS v, count(*) AS k FROM b GROUP BY ALL) x JOIN (SELECT dim, score_b AS v, count(*) AS k FROM b GROUP BY ALL) y USING (dim, v) GROUP BY x.dim) SELECT dim, CAST(n AS BIGINT) AS n, round((s / n::DOUBLE - ch / (n * n)::DOUBLE) / nullif(1 - ch / (n * n)::DOUBLE, 0), 6) AS kappa FROM n JOIN c USING (dim)")
def a22(spark, d):
    return E.kappa(pairs(spark, d)).withColumn("kappa", F.round("kappa", 6))


@query("a23_score_distribution", f"WITH {PAIRS} SELECT dim, CAST(count(*) FILTER (score_b = 0) AS BIGINT) AS n_0, CAST(count(*) FILTER (score_b = 1) AS BIGINT) AS n_1, CAST(count(*) FILTER (score_b IS NULL) AS BIGINT) AS n_na FROM r GROUP BY dim")
def a23(spark, d):
    return E.score_distribution(pairs(spark, d).withColumnRenamed("score_b", "score"), [0, 1])


CODES = "[x FOR x IN [CASE WHEN toxic = 1 THEN 'TOXIC' END, CASE WHEN quality = 0 AND doc_id % 3 = 0 THEN 'WRONG_ROUTE' END, CASE WHEN doc_id % 7 = 2 THEN 'WRONG_ROUTE' END] IF x IS NOT NULL]"


@query("a23_critical_errors", f"WITH x AS (SELECT DISTINCT doc_id AS pair_id, unnest({CODES}) AS code FROM labels) SELECT code, CAST(count(*) AS BIGINT) AS n, array_to_string(list_sort(list(pair_id))[1:3], ',') AS examples FROM x GROUP BY code")
def a23_critical(spark, d):
    i = F.col("doc_id")
    codes = F.array_compact(F.array(F.when(F.col("toxic") == 1, "TOXIC"), F.when((F.col("quality") == 0) & (i % 3 == 0), "WRONG_ROUTE"), F.when(i % 7 == 2, "WRONG_ROUTE")))
    found = E.critical_errors(read(spark, d, "labels").select(i.alias("pair_id"), codes.alias("critical")))
    return found.select("code", "n", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


@query("d12_reconciled", f"WITH {PAIRS} SELECT pair_id, dim, CAST(score_a AS DOUBLE) AS score_a, CAST(score_b AS DOUBLE) AS score_b, CAST(coalesce(CASE WHEN pair_id IN (SELECT page_id FROM pages) THEN 1 END, CASE WHEN score_a = score_b THEN score_a END) AS DOUBLE) AS score FROM r")
def d12(spark, d):
    p = pairs(spark, d)
    chosen = p.select("pair_id", "dim").join(read(spark, d, "pages").select(F.col("page_id").alias("pair_id")), "pair_id", "left_semi").withColumn("score", F.lit(1.0))
    return E.reconciled(p, chosen).select("pair_id", "dim", "score_a", "score_b", "score")


@query("a25_outcome_rates", "SELECT m AS metric, CAST(count(*) FILTER (n) AS BIGINT) AS n, CAST(count(*) FILTER (n AND k) AS BIGINT) AS k, count(*) FILTER (n AND k) / nullif(count(*) FILTER (n), 0)::DOUBLE AS value FROM (SELECT unnest([{'m':'wrong_auto_answers','n':a,'k':NOT c},{'m':'correct_automation','n':true,'k':a AND c},{'m':'correct_automation_answerable','n':q,'k':a AND c},{'m':'false_answer','n':NOT q,'k':a}], recursive := true) FROM (SELECT quality = 1 AS q, toxic = 0 AS a, doc_id % 3 > 0 AS c FROM labels)) GROUP BY m")
def a25(spark, d):
    return E.outcome_rates(read(spark, d, "labels").select((F.col("quality") == 1).alias("answerable"), (F.col("toxic") == 0).alias("auto_answered"), (F.col("doc_id") % 3 > 0).alias("correct")))


PREDICTED = "x AS (SELECT CASE WHEN toxic IS NOT NULL THEN CASE quality WHEN 1 THEN 'L1' ELSE 'L3' END END AS gold_line, CASE WHEN lang = 'en' THEN 'L1' WHEN lang = 'de' THEN 'L3' WHEN doc_id % 3 = 0 THEN 'L2' END AS line, CASE WHEN quality = 0 THEN source END AS gold_recipient, CASE WHEN doc_id % 2 = 0 THEN source END AS recipient FROM documents LEFT JOIN labels USING (doc_id))"
LINE_RATES = {"line_accuracy": ("gold_line IS NOT NULL", "line = gold_line"), "l3_precision": ("gold_line IS NOT NULL AND line = 'L3'", "line = gold_line"), "recipient_accuracy": ("gold_recipient IS NOT NULL", "recipient = gold_recipient")}


@query("a26_line_accuracy", f"WITH {PREDICTED} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST(count(*) FILTER ({n}) AS BIGINT) AS n, CAST(count(*) FILTER ({n} AND {k}) AS BIGINT) AS k, count(*) FILTER ({n} AND {k}) / nullif(count(*) FILTER ({n}), 0)::DOUBLE AS value FROM x" for m, (n, k) in LINE_RATES.items()))
def a26(spark, d):
    x = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    gold = F.when(F.col("toxic").isNotNull(), F.when(F.col("quality") == 1, "L1").otherwise("L3"))
    line = F.when(F.col("lang") == "en", "L1").when(F.col("lang") == "de", "L3").when(F.col("doc_id") % 3 == 0, "L2")
    return E.line_accuracy(x.select(gold.alias("gold_line"), line.alias("line"), F.when(F.col("quality") == 0, F.col("source")).alias("gold_recipient"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("recipient")))


@query("a31_gold_summary", "SELECT lang AS role, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT source) AS BIGINT) AS groups, CAST(count(*) FILTER (quality = 1) AS BIGINT) AS answerable, CAST(count(*) FILTER (quality <> 1) AS BIGINT) AS unanswerable FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def a31(spark, d):
    gold = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    return E.gold_summary(gold.select(F.col("doc_id").alias("case_id"), F.col("lang").alias("role"), F.col("source").alias("group_id"), (F.col("quality") == 1).alias("answerable")))


@query("j21_gold_hits", BM25 + ", g AS (SELECT DISTINCT doc_id % 20 AS item_id, doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), h AS (SELECT item_id, doc_id, place <= 3 AS selected FROM r WHERE place <= 10) SELECT b.item_id AS case_id, CAST(count(g.doc_id) AS BIGINT) AS n_gold, count(h.doc_id) > 0 AS in_candidates, coalesce(bool_or(selected), false) AS selected FROM benchmark b LEFT JOIN g ON g.item_id = b.item_id LEFT JOIN h ON h.item_id = b.item_id AND h.doc_id = g.doc_id GROUP BY b.item_id")
def j21(spark, d):
    """Labelled documents as gold of the first twenty items, against ten candidates of which three are selected."""
    hits = best(spark, d).select(F.col("item_id").alias("case_id"), F.col("doc_id").alias("source_id"), (F.col("place") <= 3).alias("selected"))
    gold = read(spark, d, "labels").where("quality = 1").select((F.col("doc_id") % 20).alias("case_id"), F.col("doc_id").alias("source_id"))
    return E.gold_hits(read(spark, d, "benchmark").select(F.col("item_id").alias("case_id")), gold, hits)


@query("j23_gold_missing", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def j23(spark, d):
    return read(spark, d, "embeddings").join(read(spark, d, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti").select("vec_id")


@query("u5_split_disjoint", "SELECT CAST(count(*) AS BIGINT) AS shared FROM (SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'de')")
def u5(spark, d):
    docs = read(spark, d, "documents")
    return docs.where("lang = 'en'").select("source").intersect(docs.where("lang = 'de'").select("source")).agg(F.count("*").alias("shared"))


@query("f27_numbers", r"SELECT doc_id, CAST(len(regexp_extract_all(regexp_replace(coalesce(text,''), '^\s*\d+[.)]\s*', ''), '\d{3,}')) AS BIGINT) AS n FROM documents")
def f27(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(F.regexp_extract_all(F.regexp_replace(T.text("text"), T.STEP_NUMBER, ""), F.lit(r"\d{3,}"), F.lit(0))).cast("long").alias("n"))


#: Numbers of a text, as T.NUMBER finds them, without lookbehind.
NUMBERS = r"regexp_extract_all({0}, '(?:^|[^\w-])(\d+(?:[.,]\d+)?)', 1)"
STEPLESS = r"regexp_replace({0}, '^\s*\d+[.)]\s*', '')"
FIRST_LINE = "string_split(coalesce(text,''), chr(10))[1]"


@query("f27_grounding", rf"SELECT doc_id, array_to_string(list_sort(list_distinct([x FOR x IN {NUMBERS.format(STEPLESS.format("coalesce(text,'')"))} IF NOT list_contains({NUMBERS.format(FIRST_LINE)}, x)])), ' ') AS ungrounded FROM documents")
def f27_grounding(spark, d):
    """Numbers of whole texts that their first lines lack."""
    said = E.ungrounded(T.text("text"), F.get(F.split(T.text("text"), "\n"), F.lit(0)))
    return read(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(said), " ").alias("ungrounded"))


@query("f28_forbidden", "SELECT page_id, regexp_matches(coalesce(html,''), '(?i)https?://\\S+') AS has_url, regexp_matches(coalesce(html,''), '(?i)track\\(') AS claims FROM pages")
def f28(spark, d):
    return read(spark, d, "pages").select("page_id", T.text("html").rlike(T.URL).alias("has_url"), T.text("html").rlike(r"(?i)track\(").alias("claims"))


LINES_OF = "string_split(coalesce(text,''), chr(10))"
AUDIT = rf"""c AS (SELECT conv_id, turn, coalesce(text,'') AS text, {LINES_OF} AS lines, string_agg(CASE WHEN role = 'user' THEN text END, chr(10)) OVER (PARTITION BY conv_id) AS asked, role, turn % 5 AS cited FROM conversations),
x AS (SELECT *, {NUMBERS.format("coalesce(asked, '')")} AS given, flatten([{NUMBERS.format(STEPLESS.format("y"))} FOR y IN list_concat([text], lines)]) AS used FROM c WHERE role = 'assistant')"""


@query("d7_answer_audit", f"WITH {AUDIT} SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'empty_answer' WHEN cited = 3 THEN 'unsupplied_source' WHEN conv_id % 7 = 0 THEN 'dropped_condition' WHEN regexp_matches(text, '(?i)pathetic|stupid') THEN 'claimed_action' WHEN regexp_matches(text, '(?i)https?://\\S+') THEN 'url' WHEN len([v FOR v IN used IF NOT list_contains(given, v)]) > 0 THEN 'ungrounded_number' END AS fault FROM x")
def d7(spark, d):
    """Answers with their lines as steps; what the user asked is the grounding."""
    c = read(spark, d, "conversations")
    users = c.where("role = 'user' and conv_id is not null").groupBy("conv_id").agg(F.concat_ws("\n", F.array_sort(F.collect_list(F.coalesce("text", F.lit(""))))).alias("asked"))  # a conversation's own messages
    first = F.get(F.split(T.text("text"), "\n"), F.lit(0))
    cited, allowed = F.array(F.concat(F.lit("s"), (F.col("turn") % 5).cast("string"))), F.array(*[F.lit(f"s{i}") for i in (0, 1, 2, 4)])
    required = F.when(F.col("conv_id") % 7 == 0, F.array(F.lit("a condition that no answer keeps"))).otherwise(F.array(first))
    fault = E.answer_fault(T.text("text"), F.array(first), F.split(T.text("text"), "\n"), cited, allowed, required, F.array(F.coalesce("asked", F.lit(""))), forbidden="(?i)pathetic|stupid")
    return c.where("role = 'assistant'").join(users, "conv_id", "left").select("conv_id", "turn", fault.alias("fault"))
