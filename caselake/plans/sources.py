"""Queries of the readers: tables are written to the shared folder in the shape that a reader takes, and read back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cases as C
from ..operators.policy import policy_labels
from ..registry import query, read
from ..sources import io
from . import cases, policy
from .streams import RAW, shared


@query("s2_pages", "SELECT source AS source_key, CAST(doc_id % 1000 AS INTEGER) AS page, md5(coalesce(text,'')) AS text_md5 FROM documents")
def s2(spark, d):
    path = shared(spark, "pages")
    read(spark, d, "documents").select(F.col("source").alias("source_key"), (F.col("doc_id") % 1000).cast("int").alias("page"), T.text("text").alias("text"), "lang").write.parquet(path)
    return io.read_pages(spark, path).select("source_key", "page", F.md5("text").alias("text_md5"))


@query("s3_history", "SELECT lang AS impact, source AS theme, md5(coalesce(text,'')) AS description_md5, CAST(doc_id AS VARCHAR) AS resolution FROM documents")
def s3(spark, d):
    """Six columns with a header; descriptions hold quotes, commas and line ends."""
    path = shared(spark, "history")
    rows = read(spark, d, "documents").select(F.col("lang").alias("impact"), F.lit("r").alias("requester"), F.col("source").alias("theme"), F.lit("closed").alias("status"), T.text("text").alias("description"), F.col("doc_id").cast("string").alias("resolution"))
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path)
    return io.read_history(spark, path).select("impact", "theme", F.md5(T.text("description")).alias("description_md5"), "resolution")


@query("s4_taxonomy", "SELECT DISTINCT p_brand AS theme, p_type AS subtopic, CAST(p_size AS INTEGER) AS row_no FROM part")
def s4(spark, d):
    """A document of nested rows for each theme."""
    path = shared(spark, "taxonomy")
    row = F.struct(F.col("p_size").cast("int").alias("row_no"), F.lit("t").alias("theme_id"), F.col("p_brand").alias("theme"), F.lit("s").alias("subtopic_id"), F.col("p_type").alias("subtopic"))
    documents = read(spark, d, "part").select("p_brand", row.alias("row")).distinct().groupBy("p_brand").agg(F.collect_list("row").alias("rows"))  # sizes and types of a brand
    documents.write.partitionBy("p_brand").json(path)  # a document a file
    return io.read_taxonomy(spark, path).select("theme", "subtopic", "row_no")


@query("s5_ruleset", policy.D6_SQL.replace("SELECT conv_id, turn, CASE WHEN profane THEN 'insult'", "SELECT verdict, CAST(count(*) AS BIGINT) AS n FROM (SELECT conv_id, turn, CASE WHEN profane THEN 'insult'") + ") GROUP BY verdict")
def s5(spark, d):
    """Labels by a ruleset that is read from its document."""
    path = shared(spark, "ruleset")
    spark.createDataFrame([(json.dumps(policy.RULES, ensure_ascii=False, indent=1),)], "value string").coalesce(1).write.text(path)
    labels = policy_labels(read(spark, d, "conversations"), io.read_ruleset(spark, path), ["conv_id", "turn"])
    return labels.groupBy("verdict").agg(F.count("*").alias("n"))


@query("s6_case_tables", f"WITH {cases.TABLES} SELECT case_status, CAST(count(*) AS BIGINT) AS n_messages, CAST(count(DISTINCT case_id) AS BIGINT) AS n_cases FROM m JOIN c USING (case_id) GROUP BY case_status")
def s6(spark, d):
    folder = shared(spark, "case-tables")
    names = ("cases", "messages", "requests", "feedback", "tickets")
    made = dict(zip(names, cases.tables(spark, d), strict=True))
    for name, df in made.items():
        df.write.parquet(f"{folder}/{name}")
    schema = {"cases": "case_id long, cohort string, case_status string", "messages": "case_id long, message_id string, seq long, kind string"}
    t = io.read_tables(spark, folder, schema)
    return t["messages"].join(t["cases"], "case_id").groupBy("case_status").agg(F.count("*").alias("n_messages"), F.countDistinct("case_id").alias("n_cases"))


@query("s7_export", cases.A17_SQL)
def s7(spark, d):
    """Export documents of some hundred cases each, and the cohort report of what is read from them."""
    path = shared(spark, "export-documents")
    rows = cases.evaluation_rows(spark, d)
    named = ("cohort", "case_status", "policy_closed", "has_ticket", "ticket_status", "messages", "requests", "feedback", "resolution")
    io.write_export_documents(rows.select(F.col("case_id").cast("string").alias("case_id"), *named), path)
    return C.cohort_info(C.case_flags(io.read_export(spark, path)))


@query("s8_ratings", "SELECT CAST(doc_id AS VARCHAR) AS pair_id, CASE WHEN doc_id % 2 = 0 THEN 'flat' ELSE 'nested' END AS rater_id, dim, score FROM (SELECT doc_id, unnest([{'dim': 'clarity', 'score': quality}, {'dim': 'completeness', 'score': toxic}, {'dim': 'correctness', 'score': quality + toxic}], recursive := true) FROM labels)")
def s8(spark, d):
    """Half of the ratings as flat records, half as nested ones."""
    path = shared(spark, "ratings")
    scores = [F.col("quality").cast("int").alias("clarity"), F.col("toxic").cast("int").alias("completeness"), (F.col("quality") + F.col("toxic")).cast("int").alias("correctness")]
    labels = read(spark, d, "labels").withColumn("pair_id", F.col("doc_id").cast("string"))
    labels.where("doc_id % 2 = 0").select("pair_id", F.lit("flat").alias("rater_id"), *scores).write.json(path)
    labels.where("doc_id % 2 <> 0").select("pair_id", F.lit("nested").alias("rater_id"), F.struct(*scores).alias("ratings")).write.mode("append").json(path)
    return io.read_ratings(spark, path).where("score is not null")  # no route was rated


@query("s9_vectors", "SELECT CASE WHEN vec_id % 10 = 0 THEN 'other' ELSE 'right' END AS side, CAST(count(*) AS BIGINT) AS n, round(sum(CAST(embedding[1] AS DOUBLE)), 4) AS first FROM embeddings GROUP BY 1")
def s9(spark, d):
    """Every tenth vector is cut short, and found by its size."""
    path = shared(spark, "vectors")
    read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("source_id"), F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")).alias("embedding")).write.parquet(path)
    told = lambda df, side: df.groupBy(F.lit(side).alias("side")).agg(F.count("*").alias("n"), F.round(F.sum(F.get("embedding", F.lit(0)).cast("double")), 4).alias("first"))
    right, other = io.read_vectors(spark, path, 64)
    return told(right, "right").unionByName(told(other, "other"))


@query("s14_event_stream", "SELECT event_id, user_id, event_type, md5(props) AS body_hash FROM events")
def s14(spark, d):
    """Events in several files of a folder, streamed to a sink."""
    path, out = shared(spark, "events"), shared(spark, "streamed")
    read(spark, d, "events").repartition(4, "event_id").write.parquet(path)
    rows = io.case_event_stream(spark, path, RAW).select("event_id", "user_id", "event_type", F.md5("props").alias("body_hash"))
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


@query("s15_manifest", "WITH f AS (SELECT 'index-' || coalesce(lang, '') AS name, sha256(coalesce(lang, '')) AS sha256, CAST(count(*) AS BIGINT) AS size FROM documents GROUP BY lang), k AS (SELECT * FROM f UNION ALL SELECT 'chunks', sha256('chunks'), (SELECT CAST(count(*) AS BIGINT) FROM documents)) SELECT 'm1' AS model, CAST(64 AS BIGINT) AS dim, name, sha256, size FROM k")
def s15(spark, d):
    """The manifest of a build, stamped with the files of an index; an entry of that name from before goes."""
    docs = read(spark, d, "documents")
    entry = lambda name, size: F.struct(F.lit(name).alias("name"), F.sha2(F.lit(name).cast("binary"), 256).alias("sha256"), size.alias("size"))
    manifest = docs.agg(F.count("*").alias("n")).select(F.array(entry("chunks", F.col("n")), entry("index-en", F.lit(-1).cast("long"))).alias("files"))
    lang = F.coalesce("lang", F.lit(""))
    files = docs.groupBy(F.concat(F.lit("index-"), lang).alias("name"), F.sha2(lang.cast("binary"), 256).alias("sha256")).agg(F.count("*").alias("size"))
    return io.stamp_manifest(manifest, {"model": "m1", "dim": 64}, files).select("model", F.col("dim").cast("long").alias("dim"), F.inline("files"))
