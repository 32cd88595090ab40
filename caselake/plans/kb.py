"""Knowledge-base queries on documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import kb
from ..registry import query, read

CLASS_SQL = r"""CASE WHEN trim(regexp_replace(coalesce(text,''),'\s+',' ','g')) = '' THEN 'empty_content'
  WHEN regexp_matches(trim(coalesce(text,'')), '\.{2,}') THEN 'content_is_table_of_contents'
  WHEN regexp_matches(trim(coalesce(text,'')), '^\s*\d{1,4}\s*$') THEN 'content_is_page_number_only'
  WHEN regexp_matches(trim(coalesce(text,'')), '^[\s\d]*$') THEN 'content_is_blank_page' END"""


def chunks(spark, d):
    """documents as knowledge-base rows."""
    return read(spark, d, "documents")


@query("p1_service_fragments", f"SELECT doc_id, {CLASS_SQL} AS reason FROM documents")
def p1(spark, d):
    return chunks(spark, d).select("doc_id", kb.service_reason("text", dot_leader=r"\.{2,}").alias("reason"))


@query("p2_keep_exclude", f"SELECT source, CAST(count(*) FILTER (r IS NULL) AS BIGINT) AS kept, CAST(count(*) FILTER (r IS NOT NULL) AS BIGINT) AS excluded FROM (SELECT source, {CLASS_SQL.replace('{2,}', '{4,}')} AS r FROM documents) GROUP BY source")
def p2(spark, d):
    kept, out = kb.keep_exclude(chunks(spark, d), "text")
    both = kept.select("source", F.lit(1).alias("k")).unionByName(out.select("source", F.lit(0).alias("k")))
    return both.groupBy("source").agg(F.sum("k").cast("long").alias("kept"), F.sum(1 - F.col("k")).cast("long").alias("excluded"))


@query("p3_attachment_status", r"SELECT doc_id, CASE WHEN regexp_matches(coalesce(text,''), '(?i)fig\w*\s*\d+') THEN 'incomplete' WHEN regexp_matches(coalesce(text,''), '(?i)licen[sc]e') THEN 'pointer' ELSE 'complete' END AS content_status FROM documents")
def p3(spark, d):
    return chunks(spark, d).select("doc_id", kb.attachment_status("text", figure=r"(?i)fig\w*\s*\d+", pointer=r"(?i)licen[sc]e").alias("content_status"))


@query("p4_derive_roles", "SELECT doc_id, CASE WHEN lang IN ('de','en') THEN lang ELSE '' END AS roles, coalesce(lang IN ('de','en'), false) AS role_verified FROM documents")
def p4(spark, d):
    roles = kb.derive_roles(F.concat(F.lit(" "), F.coalesce("lang", F.lit("")), F.lit(" , "), F.coalesce("lang", F.lit(""))), ("de", "en"))
    return chunks(spark, d).select("doc_id", F.array_join(roles, ",").alias("roles"), (F.size(roles) > 0).alias("role_verified"))


@query("p5_version_stamp", r"SELECT doc_id, nullif(regexp_extract(coalesce(text,''), '\d+\.\d+\.\d+', 0), '') AS version FROM documents")
def p5(spark, d):
    return chunks(spark, d).select("doc_id", kb.version_stamp(F.lit(""), "text", F.lit("pdf"), r"\d+\.\d+\.\d+").alias("version"))


@query("p6_portal_keys", r"""SELECT page_id, CASE WHEN h THEN 'portal:' || a || ':' || p ELSE 'portal:' || coalesce(url,'') || ':1' END AS source_id, CASE WHEN h THEN 'portal:' || a ELSE 'portal:' || coalesce(url,'') END AS parent_id
FROM (SELECT page_id, url, regexp_matches(coalesce(url,''), '^https?://([^/]+)/(.+)$') AS h, regexp_extract(url, '^https?://([^/]+)/(.+)$', 1) AS a, regexp_extract(url, '^https?://([^/]+)/(.+)$', 2) AS p FROM pages)""")
def p6(spark, d):
    source, parent = kb.portal_key("url", r"^https?://([^/]+)/(.+)$")
    return read(spark, d, "pages").select("page_id", source.alias("source_id"), parent.alias("parent_id"))


@query("p7_rename_fields", "SELECT page_id, url AS collection_endpoint FROM pages")
def p7(spark, d):
    return kb.rename_fields(read(spark, d, "pages").withColumnRenamed("url", "source_url")).select("page_id", "collection_endpoint")


@query("p8_source_lookup", "SELECT d.doc_id, CASE WHEN length(coalesce(text,'')) > 400 THEN rtrim(substr(text,1,400), ' ') || '…' ELSE coalesce(text,'') END AS excerpt FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def p8(spark, d):
    wanted = read(spark, d, "labels").where("quality = 0").select("doc_id").distinct()
    return chunks(spark, d).join(wanted, "doc_id", "left_semi").select("doc_id", T.excerpt("text").alias("excerpt"))


@query("f2_tokens", r"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(list_slice(t,1,20), ' ') AS head FROM (SELECT doc_id, regexp_extract_all(coalesce(text,''), '[0-9a-zA-Zа-яёА-ЯЁ]+(?:[-_./][0-9a-zA-Zа-яёА-ЯЁ]+)*') AS t FROM documents)")
def f2(spark, d):
    t = T.tokens("text")
    return chunks(spark, d).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(F.slice(t, 1, 20), " ").alias("head"))


@query("f6_rebuilt_titles", r"""WITH l AS (SELECT page_id, url, html, [trim(substr(y,1,180)) FOR y IN [regexp_replace(trim(regexp_replace(x,'\.{4,}',' ','g'),' .…'),'\s{2,}',' ','g') FOR x IN string_split(coalesce(html,''), chr(10))] IF length(y) >= 12 AND regexp_matches(y,'[A-Za-z]{3,}')][1] AS f FROM pages),
r AS (SELECT *, CASE WHEN regexp_matches(t,'(?i)\.(pdf|docx?|xlsx?|pptx?|html)$') THEN 'x' END AS x FROM (SELECT *, trim(coalesce(regexp_extract(url,'[^/]*$',0),'')) AS t FROM l))
SELECT page_id, CASE WHEN reason IS NULL THEN trim(regexp_replace(regexp_replace(t,'\.{4,}',' ','g'),'\s{2,}',' ','g')) ELSE coalesce(f, nullif(t,''), nullif(url,''), 'unknown') END AS title, CASE WHEN reason IS NULL THEN '' WHEN f IS NULL THEN reason || '_no_replacement_in_content' ELSE reason END AS title_reason
FROM (SELECT *, CASE WHEN regexp_matches(t,'(?i)\.(pdf|docx?|xlsx?|pptx?)$') THEN 'title_was_filename' WHEN regexp_matches(t,'\.{4,}') THEN 'title_was_toc_line' WHEN regexp_matches(t,'^[\d.]{6,}\s*v?\d*$') THEN 'title_was_version_stamp' WHEN t = '' THEN 'title_was_empty' WHEN length(t) < 4 THEN 'title_too_short' END AS reason FROM r)""")
def f6(spark, d):
    title, reason = kb.rebuilt_title(F.regexp_extract("url", "[^/]*$", 0), "html", "url", letters="[A-Za-z]{3,}")
    return read(spark, d, "pages").select("page_id", title.alias("title"), reason.alias("title_reason"))


@query("f7_boilerplate_lines", "SELECT doc_id, CAST(len(l) - len([x FOR x IN l IF trim(x) <> 'Released under the MIT License.' AND trim(x) <> 'Licensed under CC BY-NC 4.0.']) AS BIGINT) AS dropped, CAST(length(array_to_string([x FOR x IN l IF trim(x) <> 'Released under the MIT License.' AND trim(x) <> 'Licensed under CC BY-NC 4.0.'], chr(10))) AS BIGINT) AS n_chars FROM (SELECT doc_id, string_split(coalesce(text,''), chr(10)) AS l FROM documents)")
def f7(spark, d):
    out, n = T.drop_lines("text", ["Released under the MIT License.", "Licensed under CC BY-NC 4.0."])
    return chunks(spark, d).select("doc_id", n.alias("dropped"), F.length(out).cast("long").alias("n_chars"))


@query("f8_toc_entries", r"SELECT p_brand AS source_key, CAST(p_size AS VARCHAR) || '.' || (p_partkey % 9 + 1) AS number, trim(regexp_replace(p_type, '\s{2,}', ' ', 'g'), ' .…') AS title, CAST(p_partkey % 9000 + 1 AS INTEGER) AS page FROM part WHERE length(p_type) BETWEEN 3 AND 120")
def f8(spark, d):
    """Contents pages written from parts, a line for each, read back by the pattern."""
    number = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 9 + 1).cast("string"))
    line = F.concat(number, F.when(F.col("p_partkey") % 2 == 0, ". ").otherwise("  "), "p_type", F.lit(" ....... "), (F.col("p_partkey") % 9000 + 1).cast("string"))
    pages = read(spark, d, "part").groupBy("p_brand", F.floor(F.col("p_partkey") / 40).alias("leaf")).agg(F.array_join(F.collect_list(line), "\n").alias("text"))  # 40 lines a page
    return pages.select(F.col("p_brand").alias("source_key"), F.explode(T.toc_entries("text")).alias("e")).select("source_key", "e.number", "e.title", "e.page")


TOC_SQL = r"""e AS (SELECT source AS source_key, doc_id AS at, unnest(regexp_extract_all(coalesce(text,''), '\b(\d{1,2})\.(\d{1,3})', 1)) AS number, unnest(regexp_extract_all(coalesce(text,''), '\b(\d{1,2})\.(\d{1,3})', 2)) AS title, CAST(doc_id % 1000 AS INTEGER) AS page FROM documents),
u AS (SELECT source_key, number, title, page FROM (SELECT *, row_number() OVER (PARTITION BY source_key, number ORDER BY page, length(number), number, title) AS r FROM e) WHERE r = 1)"""


def toc(spark, d):
    """Dotted numbers of documents as contents entries: number, title, page."""
    p = F.lit(r"\b(\d{1,2})\.(\d{1,3})")
    rows = F.arrays_zip(F.regexp_extract_all(T.text("text"), p, F.lit(1)).alias("number"), F.regexp_extract_all(T.text("text"), p, F.lit(2)).alias("title"))
    e = chunks(spark, d).select(F.col("source").alias("source_key"), (F.col("doc_id") % 1000).cast("int").alias("page"), F.explode(rows).alias("r"))
    return kb.unique_toc(e.select("source_key", "r.number", "r.title", "page"))


@query("w2_unique_toc", f"WITH {TOC_SQL} SELECT source_key, number, title, CAST(page AS BIGINT) AS page FROM u")
def w2(spark, d):
    return toc(spark, d).withColumn("page", F.col("page").cast("long"))


@query("j1_latest_toc", f"WITH {TOC_SQL}, p AS (SELECT DISTINCT source AS source_key, doc_id % 1000 AS page FROM documents), x AS (SELECT p.source_key, p.page, u.number, u.title, row_number() OVER (PARTITION BY p.source_key, p.page ORDER BY u.page DESC, length(u.number) DESC, u.number DESC, u.title DESC) AS r FROM p LEFT JOIN u ON p.source_key = u.source_key AND u.page <= p.page) SELECT source_key, CAST(page AS BIGINT) AS page, number, title FROM x WHERE r = 1")
def j1(spark, d):
    pages = chunks(spark, d).select(F.col("source").alias("source_key"), (F.col("doc_id") % 1000).alias("page")).distinct()
    return kb.latest_toc(pages, toc(spark, d)).select("source_key", F.col("page").cast("long").alias("page"), "number", "title")


@query("j2_section_paths", "WITH e AS (SELECT DISTINCT p_brand AS source_key, CAST(p_size AS VARCHAR) AS number, first(p_type ORDER BY p_partkey) OVER (PARTITION BY p_brand, p_size) AS title FROM part), s AS (SELECT DISTINCT p_brand AS source_key, p_size || '.' || (p_partkey % 5) AS number FROM part) SELECT s.source_key, s.number, string_agg(e.number || ' ' || e.title, ' / ' ORDER BY length(e.number)) AS section_path FROM s JOIN e ON e.source_key = s.source_key AND (s.number = e.number OR s.number LIKE e.number || '.%') GROUP BY ALL")
def j2(spark, d):
    part = read(spark, d, "part")
    entries = part.groupBy(F.col("p_brand").alias("source_key"), F.col("p_size").cast("string").alias("number")).agg(F.min_by("p_type", "p_partkey").alias("title"))
    sections = part.select(F.col("p_brand").alias("source_key"), F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 5).cast("string")).alias("number"))
    return kb.section_paths(sections, entries)


@query("j12_missing_pages", "WITH h AS (SELECT DISTINCT source, doc_id % 100 AS page FROM documents WHERE lang = 'en'), e AS (SELECT s.source, r.page FROM (SELECT DISTINCT source FROM documents) s, (SELECT DISTINCT doc_id % 100 AS page FROM documents) r) SELECT e.source AS source_key, CAST(e.page AS BIGINT) AS page FROM e WHERE e.source IN (SELECT source FROM h) AND NOT EXISTS (SELECT 1 FROM h WHERE h.source = e.source AND h.page = e.page)")
def j12(spark, d):
    docs = chunks(spark, d).select(F.col("source").alias("source_key"), (F.col("doc_id") % 100).alias("page"), "lang")
    pages = docs.select("page").distinct()  # 100 rows at most
    expected = docs.select("source_key").distinct().crossJoin(F.broadcast(pages))
    return kb.missing_pages(expected, docs.where("lang = 'en'")).select("source_key", F.col("page").cast("long").alias("page"))


@query("w1_chunk_numbers", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS BIGINT) AS chunk_no FROM documents")
def w1(spark, d):
    return kb.number_chunks(chunks(spark, d).select("doc_id", "source", "lang"), ["source", "lang"], ["doc_id"]).select("doc_id", "chunk_no")


@query("k6_canonical_order", "SELECT doc_id, CAST(row_number() OVER (ORDER BY n_chars, doc_id) AS BIGINT) AS place FROM documents")
def k6(spark, d):
    return kb.numbered(chunks(spark, d).select("doc_id", "n_chars"), [], ["n_chars", "doc_id"]).select("doc_id", "place")


LINES_SQL = "l AS (SELECT doc_id AS doc, unnest(range(0, len(x))) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text,''), chr(10)) AS x FROM documents))"


def lines(spark, d):
    return chunks(spark, d).select(F.col("doc_id").alias("doc"), F.posexplode(F.split(T.text("text"), "\n")).alias("line_no", "line"))


@query("w3_sections", f"WITH {LINES_SQL}, s AS (SELECT doc, line_no, sum(CASE WHEN regexp_matches(line, '^[A-Z]{{2}}|:$|License') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS section FROM l) SELECT doc, CAST(section AS BIGINT) AS section, CAST(min(line_no) AS BIGINT) AS first_line, CAST(count(*) AS BIGINT) AS n_lines FROM s GROUP BY doc, section")
def w3(spark, d):
    s = kb.sections_by_heading(lines(spark, d), r"^[A-Z]{2}|:$|License")
    return s.groupBy("doc", "section").agg(F.min("line_no").cast("long").alias("first_line"), F.count("*").alias("n_lines"))


@query("w4_carry_forward", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS question FROM conversations")
def w4(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("question"))
    return kb.carry_forward(rows, "question", ["conv_id"], "turn")


@query("w5_ordinal_ids", "SELECT p_brand AS theme, 'TH' || row_number() OVER (ORDER BY min(p_partkey)) AS theme_id FROM part GROUP BY p_brand")
def w5(spark, d):
    from pyspark.sql import Window

    firsts = read(spark, d, "part").groupBy(F.col("p_brand").alias("theme")).agg(F.min("p_partkey").alias("first"))  # a row a theme
    return firsts.select("theme", F.concat(F.lit("TH"), F.dense_rank().over(Window.orderBy("first")).cast("string")).alias("theme_id"))


@query("w6_chunking")
def w6(spark, d):
    s = lines(spark, d).select(F.col("doc").alias("section"), F.lit(1).cast("long").alias("page"), "line_no", "line")
    return kb.chunk_sections(s)


@query("a1_build_counts", f"SELECT coalesce(split_part(r, ':', 1), 'included') AS bucket, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT source) AS BIGINT) AS n_parents FROM (SELECT source, {CLASS_SQL} AS r FROM documents) GROUP BY 1")
def a1(spark, d):
    told = chunks(spark, d).select("source", kb.service_reason("text", dot_leader=r"\.{2,}").alias("r"))
    return told.groupBy(F.coalesce(F.split_part("r", F.lit(":"), F.lit(1)), F.lit("included")).alias("bucket")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_parents"))


@query("a2_parents", "SELECT conv_id AS parent_id, md5(string_agg(coalesce(text,''), chr(10)||chr(10) ORDER BY turn)) AS text_md5, CAST(count(*) AS BIGINT) AS child_count FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id")
def a2(spark, d):
    c = read(spark, d, "conversations").withColumn("text", T.text("text"))
    return kb.parents(c, "conv_id", ["turn"], "text").select(F.col("conv_id").alias("parent_id"), F.md5("text").alias("text_md5"), "child_count")


@query("a3_section_parents", "SELECT 'pdf:' || source || ':s' || doc_id % 7 AS parent_id, CAST(arg_min(doc_id % 90, doc_id) AS BIGINT) AS page_from, CAST(nullif(max(CASE WHEN doc_id % 7 = 3 THEN 0 ELSE coalesce(doc_id % 50, 0) END), 0) AS BIGINT) AS page_to, md5(string_agg(substr(coalesce(text,''), 1, 200), chr(10) || chr(10) ORDER BY doc_id)) AS text_md5, CAST(count(*) AS BIGINT) AS child_count FROM documents WHERE source IS NOT NULL GROUP BY source, doc_id % 7")
def a3(spark, d):
    """Documents as chunks (their leading 200 signs) of seven top sections of each source."""
    i = F.col("doc_id")
    rows = chunks(spark, d).select(F.col("source").alias("source_key"), F.concat_ws(".", (i % 7).cast("string"), (i % 3).cast("string")).alias("number"), (i % 90).alias("page_from"), F.when(i % 7 == 3, F.lit(0)).otherwise(i % 50).cast("long").alias("page_to"), F.substring(T.text("text"), 1, 200).alias("text"), "doc_id")
    return kb.section_parents(rows, ["doc_id"]).select("parent_id", "page_from", "page_to", F.md5("text").alias("text_md5"), "child_count")


@query("u1_union_chunks", "SELECT 'doc' AS kind, doc_id AS id, CAST(length(coalesce(text,'')) AS BIGINT) AS n FROM documents UNION ALL SELECT 'page', page_id, CAST(length(coalesce(html,'')) AS BIGINT) FROM pages UNION ALL SELECT 'item', item_id, CAST(length(coalesce(text,'')) AS BIGINT) FROM benchmark")
def u1(spark, d):
    part = lambda t, kind, key, body: read(spark, d, t).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.length(T.text(body)).cast("long").alias("n"))
    return part("documents", "doc", "doc_id", "text").unionByName(part("pages", "page", "page_id", "html")).unionByName(part("benchmark", "item", "item_id", "text"))
