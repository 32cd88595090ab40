"""Corpus audit and history queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import kb
from ..registry import query, read

C = "CAST(count(*) AS BIGINT)"


@query("a4_profile", f"SELECT {C} AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_ids, CAST(count(*) FILTER (coalesce(text,'')='') AS BIGINT) AS empty_text, CAST(count(*) FILTER (coalesce(lang,'')='') AS BIGINT) AS empty_lang, CAST(count(*) FILTER (coalesce(source,'')='') AS BIGINT) AS empty_source, CAST(count(DISTINCT source) AS BIGINT) AS n_sources FROM documents")
def a4(spark, d):
    empty = lambda c: F.count_if(T.text(c) == "").alias(f"empty_{c}")
    return read(spark, d, "documents").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_ids"), empty("text"), empty("lang"), empty("source"), F.countDistinct("source").alias("n_sources"))


@query("a4_histogram", f"SELECT lang, source, {C} AS n FROM documents GROUP BY ALL")
def a4h(spark, d):
    return read(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("a5_length_stats", "SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(min(l) AS BIGINT) AS min_len, CAST(trunc(median(l)) AS BIGINT) AS median_len, CAST(max(l) AS BIGINT) AS max_len, CAST(trunc(avg(l)) AS BIGINT) AS mean_len, CAST(count(*) FILTER (l < 200) AS BIGINT) AS below_200, CAST(count(*) FILTER (l < 100) AS BIGINT) AS below_100 FROM (SELECT lang, length(coalesce(text,'')) AS l FROM documents) GROUP BY lang")
def a5(spark, d):
    x = read(spark, d, "documents").select("lang", F.length(T.text("text")).alias("l"))
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.min("l").cast("long").alias("min_len"), F.median("l").cast("long").alias("median_len"), F.max("l").cast("long").alias("max_len"), F.avg("l").cast("long").alias("mean_len"), F.count_if(F.col("l") < 200).alias("below_200"), F.count_if(F.col("l") < 100).alias("below_100"))


@query("a6_chunks_per_article", f"SELECT k AS chunks, {C} AS articles FROM (SELECT conv_id, {C} AS k FROM conversations GROUP BY conv_id) GROUP BY k")
def a6(spark, d):
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("chunks")).groupBy("chunks").agg(F.count("*").alias("articles"))


# The seven classes of defects, which overlap.
DEFECTS = {
    "content_is_page_number_only": ("content", r"^\d{1,4}$"),
    "content_under_40_chars": ("content", r"(?s)^.{0,39}$"),
    "toc_dot_leader": ("both", r"\.{5,}\s*\d+"),
    "toc_heading": ("title", r"(?iu)^(содержание|оглавление)$"),
    "title_is_filename": ("title", r"(?iu)\.(pdf|docx?|xlsx?)$"),
    "references_figure_not_in_kb": ("content", r"(Рисунок|Рис\.)\s*\d+"),
    "pointer_or_attachment_mention": ("content", r"(Приложени[ея]|см\.\s|смотри)"),
}


def defect_classes(title: F.Column, content: F.Column) -> dict[str, F.Column]:
    """Class -> whether a row of trimmed title and content has the defect."""
    of = {"title": lambda p: title.rlike(p), "content": lambda p: content.rlike(p), "both": lambda p: title.rlike(p) | content.rlike(p)}
    return {name: of[where](p) for name, (where, p) in DEFECTS.items()}


# Headings and texts that documents get here by their number, so that each class is met in the language it is written for.
TITLES = ("СОДЕРЖАНИЕ", " Оглавление", "содержание раздела", "План.PDF", "Отчёт.docx ", "Глава ..... 7", "Раздел")
CONTENTS = ("12", "Рисунок 5 в тексте, который длиннее сорока знаков", "РИСУНОК 5 в тексте, который длиннее сорока знаков", "см. Приложение 2", "Смотри ниже, где написано намного больше сорока знаков", "смотри ниже, где написано намного больше сорока знаков", "Рис. 12", "1 Общие ....... 5")
DEFECT_ROWS = f"SELECT trim([{', '.join(repr(t) for t in TITLES)}][doc_id % {len(TITLES)} + 1]) AS title, trim(coalesce([{', '.join(repr(t) for t in CONTENTS)}][doc_id % 11 + 1], text, ''), ' ' || chr(10)) AS content FROM documents"
DEFECT_TESTS = {name: " OR ".join(f"regexp_matches({c}, '{p.replace('(?iu)', '(?i)')}')" for c in (("title", "content") if where == "both" else (where,))) for name, (where, p) in DEFECTS.items()}


@query("a7_defect_counts", "SELECT " + ", ".join(f"CAST(count(*) FILTER ({p}) AS BIGINT) AS {k}" for k, p in DEFECT_TESTS.items()) + f" FROM ({DEFECT_ROWS})")
def a7(spark, d):
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % n).cast("int"))
    rows = read(spark, d, "documents").select(F.trim(pick(TITLES, len(TITLES))).alias("title"), F.trim(F.coalesce(pick(CONTENTS, 11), T.text("text")), F.lit(" \n")).alias("content"))
    return rows.agg(*[F.count_if(c).alias(k) for k, c in defect_classes(F.col("title"), F.col("content")).items()])


@query("a8_duplicate_groups", f"SELECT sha1(trim(regexp_replace(lower(coalesce(text,'')), '\\s+', ' ', 'g'))) AS h, {C} AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def a8(spark, d):
    h = F.sha1(T.squeeze(F.lower(T.text("text"))).cast("binary"))
    return read(spark, d, "documents").groupBy(h.alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("a9_page_coverage", "SELECT source, CAST(count(DISTINCT doc_id % 60) AS BIGINT) AS pages, CAST(60 - count(DISTINCT doc_id % 60) AS BIGINT) AS missing FROM documents GROUP BY source")
def a9(spark, d):
    n = F.countDistinct(F.col("doc_id") % 60)
    return read(spark, d, "documents").groupBy("source").agg(n.alias("pages"), (60 - n).alias("missing"))


@query("a27_history_profile", f"SELECT o_orderstatus AS status, o_orderpriority AS impact, {C} AS n, CAST(count(DISTINCT (o_custkey, o_orderstatus)) AS BIGINT) AS n_pairs, CAST(count(*) FILTER (o_orderpriority LIKE '1%') AS BIGINT) AS matched FROM orders GROUP BY ALL")
def a27(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("impact")).agg(F.count("*").alias("n"), F.countDistinct(F.struct("o_custkey", "o_orderstatus")).alias("n_pairs"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("matched"))


# What the history audit counts as personal data.
HISTORY_PII = {
    "email": r"[\w.\-]+@[\w\-]+\.[a-zA-Z]{2,}",
    "phone": r"(?:\+7|8)[\s\-(]?\d{3}[\s\-)]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}",
    "inn_labelled": r"\bИНН[\s:]*\d{10,12}\b",
    "guid": r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
}


def pii_classes(text: F.Column) -> dict[str, F.Column]:
    """Class -> whether a text of the history holds it (A28); letters of all scripts are word characters."""
    return {name: text.rlike(f"(?U){p}") for name, p in HISTORY_PII.items()}


#: Signatures that every document gets here: some hold a class, some miss it by a sign.
SIGNATURES = ("ИНН: 7707083893", "ИНН 770708389", "xИНН 7707083893", "тел. 8 (916)123-45-67", "+7 916 123 45 67", "+4 916 123 45", "почта имя.фамилия@пример.com", "0123abcd-01ab-01ab-01ab-0123456789ab", "0123abcd-01ab-01ab-01ab-0123456789abc", "без данных")
PII_SQL = {
    "email": r"[\p{L}\p{N}_.\-]+@[\p{L}\p{N}_\-]+\.[a-zA-Z]{2,}",
    "phone": HISTORY_PII["phone"],
    "inn_labelled": r"(^|[^\p{L}\p{N}_])ИНН[\s:]*\d{10,12}($|[^\p{L}\p{N}_])",
    "guid": r"(^|[^\p{L}\p{N}_])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}($|[^\p{L}\p{N}_])",
}
SIGNED = f"SELECT source, coalesce(text, '') || chr(10) || [{', '.join(repr(t) for t in SIGNATURES)}][doc_id % {len(SIGNATURES)} + 1] AS x FROM documents"


@query("a28_pii_counts", f"SELECT source, {', '.join(f"CAST(count(*) FILTER (regexp_matches(x, '{p}')) AS BIGINT) AS {k}" for k, p in PII_SQL.items())} FROM ({SIGNED}) GROUP BY source")
def a28(spark, d):
    said = F.get(F.array(*[F.lit(t) for t in SIGNATURES]), (F.col("doc_id") % len(SIGNATURES)).cast("int"))
    rows = read(spark, d, "documents").select("source", F.concat(T.text("text"), F.lit("\n"), said).alias("x"))
    return rows.groupBy("source").agg(*[F.count_if(c).alias(k) for k, c in pii_classes(F.col("x")).items()])


@query("j22_crosswalk", "SELECT 'covered' AS side, CAST(count(*) AS BIGINT) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'outside', CAST(count(*) AS BIGINT) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) UNION ALL SELECT 'labels_only', CAST(count(*) AS BIGINT) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)")
def j22(spark, d):
    docs, labels = read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").select("doc_id")
    n = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return n(docs.join(labels, "doc_id", "left_semi"), "covered").unionByName(n(docs.join(labels, "doc_id", "left_anti"), "outside")).unionByName(n(labels.join(docs, "doc_id", "left_anti"), "labels_only"))


@query("u6_subtopic_differences", "SELECT 'left' AS side, x AS value FROM (SELECT DISTINCT split_part(p_type,' ',1) AS x FROM part WHERE p_size <= 3 EXCEPT SELECT DISTINCT split_part(p_type,' ',1) FROM part WHERE p_size > 48) UNION ALL SELECT 'right', x FROM (SELECT DISTINCT p_brand AS x FROM part WHERE p_size > 45 EXCEPT SELECT DISTINCT p_brand FROM part WHERE p_size <= 1)")
def u6(spark, d):
    part = read(spark, d, "part")
    kind = F.split_part("p_type", F.lit(" "), F.lit(1)).alias("value")
    left = part.where("p_size <= 3").select(kind).subtract(part.where("p_size > 48").select(kind))
    right = part.where("p_size > 45").select(F.col("p_brand").alias("value")).subtract(part.where("p_size <= 1").select(F.col("p_brand").alias("value")))
    return left.select(F.lit("left").alias("side"), "value").unionByName(right.select(F.lit("right").alias("side"), "value"))


# How long what was asked and what was answered must be.
LEAST_ASKED, LEAST_ANSWERED = 25, 40


def valid_history(asked: F.Column, answered: F.Column) -> F.Column:
    """Whether a pair of question and resolution is long enough, without runs of blanks."""
    return (F.length(T.squeeze(T.text(asked))) >= LEAST_ASKED) & (F.length(T.squeeze(T.text(answered))) >= LEAST_ANSWERED)


SQUEEZED = r"trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g'))"
PAIRS = "SELECT a.conv_id, a.turn, a.text AS asked, b.text AS answered FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def history_pairs(spark, d):
    """Each message with the one after it, as question and resolution."""
    c = read(spark, d, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answered"))
    return c.select("conv_id", "turn", F.col("text").alias("asked")).join(after, ["conv_id", "turn"])


@query("p9_history_validity", f"SELECT conv_id, turn FROM ({PAIRS}) WHERE length({SQUEEZED.format('asked')}) >= 25 AND length({SQUEEZED.format('answered')}) >= 40")
def p9(spark, d):
    return history_pairs(spark, d).where(valid_history(F.col("asked"), F.col("answered"))).select("conv_id", "turn")


@query("p14_without_training", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def p14(spark, d):
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left_anti")


@query("u3_exact_dedup", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY trim(regexp_replace(coalesce(text,''), '\\s+', ' ', 'g')), lang")
def u3(spark, d):
    # min by group, not a window: a hot text is summed up map-side
    return read(spark, d, "documents").groupBy(T.squeeze(T.text("text")).alias("t"), "lang").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


NEAR = r"trim(regexp_replace(regexp_replace(lower(coalesce(text,'')), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("u4_near_groups", f"SELECT md5({NEAR}) AS near_key, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def u4(spark, d):
    return read(spark, d, "documents").groupBy(F.md5(T.near_key("text")).alias("near_key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("w11_keep_longest", f"SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, k, l, max(l) OVER (PARTITION BY k) AS m FROM (SELECT doc_id, md5({NEAR}) AS k, length(coalesce(text,'')) AS l FROM documents)) WHERE l = m GROUP BY k")
def w11(spark, d):
    best = F.max(F.struct(F.length(T.text("text")).alias("l"), (-F.col("doc_id")).alias("m")))
    return read(spark, d, "documents").groupBy(F.md5(T.near_key("text")).alias("k")).agg(best.alias("b")).select((-F.col("b.m")).alias("doc_id"))


@query("w12_stratified_pool", "SELECT doc_id, source, CAST(count(*) OVER (PARTITION BY source) AS BIGINT) AS stratum, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS place FROM documents")
def w12(spark, d):
    docs = kb.numbered(read(spark, d, "documents").select("doc_id", "source"), ["source"], ["doc_id"])
    sizes = docs.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("stratum"))
    return docs.join(sizes, F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "source", "stratum", "place")


def pool_report(pairs, asked: str, answered: str, stratum: str):
    """Per stratum: rows, valid rows, rows left without exact repeats, and without those that differ in case, signs and blanks
    only (A29). Hashes are counted, map-side first, so a text that comes without end is one row a task."""
    both = F.concat_ws(" \u241e ", T.text(asked), T.text(answered))
    ok = valid_history(F.col(asked), F.col(answered))
    rows = pairs.select(stratum, ok.alias("ok"), F.when(ok, F.md5(T.squeeze(both))).alias("exact"), F.when(ok, F.md5(T.near_key(both))).alias("near"))
    return rows.groupBy(stratum).agg(F.count("*").alias("n"), F.count_if("ok").alias("valid"), F.countDistinct("exact").alias("exact"), F.countDistinct("near").alias("near"))


@query("a29_pool_report", f"""WITH h AS ({PAIRS}), v AS (SELECT conv_id % 7 AS stratum, length({SQUEEZED.format('asked')}) >= 25 AND length({SQUEEZED.format('answered')}) >= 40 AS ok, coalesce(asked, '') || ' \u241e ' || coalesce(answered, '') AS text FROM h)
SELECT stratum, {C} AS n, CAST(count(*) FILTER (ok) AS BIGINT) AS valid, CAST(count(DISTINCT trim(regexp_replace(text, '\\s+', ' ', 'g'))) FILTER (ok) AS BIGINT) AS exact, CAST(count(DISTINCT {NEAR}) FILTER (ok) AS BIGINT) AS near FROM v GROUP BY stratum""")
def a29(spark, d):
    return pool_report(history_pairs(spark, d).withColumn("stratum", F.col("conv_id") % 7), "asked", "answered", "stratum")


@query("u8_duplicates_survive", f"SELECT source, {C} AS n, CAST(count(DISTINCT text) AS BIGINT) AS n_texts FROM documents GROUP BY source")
def u8(spark, d):
    return read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct(F.md5("text")).alias("n_texts"))


#: The scrub patterns without lookaround; two phones that share a border sign take a second pass.
PHONE_SQL = r"'(^|\D)(?:\+7|8|7)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}(\D|$)'"
SCRUB_SQL = f"regexp_replace(coalesce(text,''), '{T.EMAIL}', '<email>', 'g')"
for _ in range(2):
    SCRUB_SQL = rf"regexp_replace({SCRUB_SQL}, {PHONE_SQL}, '\1<phone>\2', 'g')"
SCRUB_SQL = rf"regexp_replace(regexp_replace({SCRUB_SQL}, '{T.GUID}', '<guid>', 'g'), '{T.HEX}', '<hex>', 'g')"


@query("f21_scrub", f"SELECT doc_id, md5({SCRUB_SQL}) AS clean_md5 FROM documents")
def f21(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.scrub("text")).alias("clean_md5"))


@query("f21_scrub_numbers", f"SELECT event_id, {SCRUB_SQL} AS clean FROM (SELECT event_id, concat_ws(' ', '+7 (' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || ') 555-' || lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') || '-01', md5(props), substr(md5(props), 1, 8) || '-aaaa-bbbb-cccc-' || substr(md5(props), 1, 12), event_type || '@mail.example.com', '8' || lpad(CAST(event_id AS VARCHAR), 10, '0') || '1') AS text FROM events)")
def f21_numbers(spark, d):
    """Texts with a phone, a hex string, a guid, an address and a number that is too long for a phone."""
    h, pad = F.md5("props"), lambda c, n: F.lpad(c.cast("string"), n, "0")
    said = F.concat_ws(" ", F.concat(F.lit("+7 ("), pad(F.col("event_id") % 1000, 3), F.lit(") 555-"), pad(F.col("user_id") % 100, 2), F.lit("-01")), h, F.concat(F.substring(h, 1, 8), F.lit("-aaaa-bbbb-cccc-"), F.substring(h, 1, 12)), F.concat("event_type", F.lit("@mail.example.com")), F.concat(F.lit("8"), pad(F.col("event_id"), 10), F.lit("1")))
    return read(spark, d, "events").select("event_id", T.scrub(said).alias("clean"))


@query("f22_safe_labels", "SELECT page_id, substr(trim(regexp_replace(coalesce(url,''), '\\s+', ' ', 'g')), 1, 120) AS label FROM pages")
def f22(spark, d):
    return read(spark, d, "pages").select("page_id", T.safe_label("url").alias("label"))


@query("f23_topic_parts", r"SELECT page_id, CASE WHEN regexp_matches(coalesce(url,''), '^https?://([^/]*)/(.*)$') THEN regexp_extract(url, '^https?://([^/]*)/(.*)$', 1) END AS subtopic, trim(regexp_replace(CASE WHEN regexp_matches(coalesce(url,''), '^https?://([^/]*)/(.*)$') THEN regexp_extract(url, '^https?://([^/]*)/(.*)$', 2) ELSE coalesce(url,'') END, '\s+', ' ', 'g')) AS question FROM pages")
def f23(spark, d):
    topic, rest = T.topic_parts("url", r"^https?://([^/]*)/(.*)$")
    return read(spark, d, "pages").select("page_id", topic.alias("subtopic"), rest.alias("question"))


@query("f24_content_hashes", "SELECT doc_id, sha256(coalesce(text,'')) AS h FROM documents")
def f24(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(T.text("text"), 256).alias("h"))


@query("f9_identifiers", r"SELECT doc_id, t AS identifier FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(coalesce(text,''), '[0-9a-zA-Zа-яёА-ЯЁ]+(?:[-_./][0-9a-zA-Zа-яёА-ЯЁ]+)*')) AS t FROM documents) WHERE regexp_matches(t, '^(?:[А-ЯЁ]{2,6}|[A-Z]{2,6}|[A-ZА-ЯЁ]{2,10}(?:-[A-ZА-ЯЁ0-9]{1,10})+|\d{1,3}(?:\.\d{1,3}){1,3})$')")
def f9(spark, d):
    return read(spark, d, "documents").select("doc_id", F.explode(T.identifiers("text")).alias("identifier"))


@query("f10_meaningful_tokens", r"SELECT conv_id, turn, CAST(len([x FOR x IN t IF length(x) > 1 AND x NOT IN ('the','of','and')]) AS BIGINT) AS n FROM (SELECT conv_id, turn, [lower(y) FOR y IN regexp_extract_all(coalesce(text,''), '[0-9a-zA-Zа-яёА-ЯЁ]+(?:[-_./][0-9a-zA-Zа-яёА-ЯЁ]+)*')] AS t FROM conversations)")
def f10(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.size(T.meaningful("text", ["the", "of", "and"])).cast("long").alias("n"))
