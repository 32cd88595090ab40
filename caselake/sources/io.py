"""Readers with explicit schemas, snapshot and export sinks, input hashes and manifests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KB_RAW = "id string, source_type string, source_key string, source_name string, audience string, topic string, subtopic string, title string, page_start int, page_end int, source_url string, updated_at string, content string"
HISTORY = "impact string, requester string, theme string, status string, description string, resolution string"
TAXONOMY_ROW = "row_no int, theme_id string, theme string, subtopic_id string, subtopic string"
RATING = "pair_id string, rater_id string, correctness int, completeness int, clarity int, route int"
EXPORT_ROW = (
    "case_id string, cohort string, case_status string, policy_closed boolean, has_ticket boolean, ticket_status string, "
    "messages array<struct<message_id:string,kind:string,responder_type:string>>, "
    "requests array<struct<status:string,error_code:string,total_ms:double>>, "
    "feedback array<struct<message_id:string,updated_at:timestamp,useful:boolean,solved:boolean>>, "
    "resolution struct<message_id:string,confirmed_by:string,answer_origin:string>"
)


def read_kb_raw(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, and the lines that don't parse."""
    raw = spark.read.schema(KB_RAW + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    bad = spark.read.text(path).where("trim(value) <> ''").where(F.from_json("value", KB_RAW + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})["_corrupt"].isNotNull())
    return raw.where("_corrupt is null").drop("_corrupt"), bad


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """source_key, page, text of extracted pages."""
    return spark.read.schema("source_key string, page int, text string").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Six columns of text with a header (S3)."""
    return spark.read.schema(HISTORY).option("header", True).option("multiLine", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Rows nested in one document."""
    return spark.read.schema(f"rows array<struct<{TAXONOMY_ROW.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path).select(F.inline("rows"))


def read_ruleset(spark: SparkSession, path: str) -> dict:
    """A small ruleset document as a dict."""
    import json

    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).limit(1).collect()))


def read_tables(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Case tables by name."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in schemas.items()}


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an export document."""
    fields = spark.createDataFrame([], EXPORT_ROW).schema.simpleString()
    return spark.read.schema(f"rows array<{fields}>").option("multiLine", True).json(path).select(F.inline("rows"))


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Flat and nested (ratings.*) records as pair_id, rater_id, dim, score."""
    dims = ["correctness", "completeness", "clarity", "route"]
    rows = spark.read.schema(RATING + ", ratings struct<correctness:int,completeness:int,clarity:int,route:int>").json(path)
    flat = rows.select("pair_id", "rater_id", *[F.coalesce(c, F.col(f"ratings.{c}")).alias(c) for c in dims])
    return flat.unpivot(["pair_id", "rater_id"], dims, "dim", "score")


def read_vectors(spark: SparkSession, path: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Vectors of the right size, and the others."""
    v = spark.read.schema("source_id string, embedding array<float>").parquet(path)
    ok = F.coalesce(F.size("embedding") == dim, F.lit(False))
    return v.where(ok), v.where(~ok)


def write_snapshot(tables: dict[str, DataFrame], folder: str, order: dict[str, list[str]], partition: dict[str, str] | None = None) -> None:
    """Each table as Parquet, rows in order within files."""
    for name, df in tables.items():
        w = df.sortWithinPartitions(*order[name]).write.mode("overwrite")
        (w.partitionBy(partition[name]) if partition and name in partition else w).parquet(f"{folder}/{name}")


def write_export(rows: DataFrame, path: str) -> None:
    """One nested document a case, as JSON lines."""
    rows.write.mode("overwrite").json(path)


def write_export_documents(rows: DataFrame, path: str, size: int = 300) -> None:
    """Documents of ``size`` cases at most, each a file that read_export reads (S7). A task makes documents of its own rows as
    they come, so nothing is shuffled for them."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        told = lambda some: pa.RecordBatch.from_arrays([pa.array(['{"rows":[' + ",".join(some) + "]}"])], ["value"])
        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= size:
                yield told(held[:size])
                held = held[size:]
        if held:
            yield told(held)

    made = rows.select(F.to_json(F.struct(*rows.columns)).alias("row")).mapInArrow(documents, "value string")
    made.write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def hash_inputs(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, size of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def verify_inputs(found: DataFrame, expected: DataFrame) -> DataFrame:
    """expected (name, sha256) -> name, verdict: pass, changed or missing."""
    by_name = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("seen"))
    return expected.join(by_name, "name", "left").select("name", F.when(F.col("seen").isNull(), "missing").when(F.col("seen") == F.col("sha256"), "pass").otherwise("changed").alias("verdict"))


def snapshot_id(hashes: DataFrame, versions: dict[str, str]) -> DataFrame:
    """16 hex signs from inputs and versions, without clocks (S13). One row; inputs are files, so their list is small."""
    inputs = F.array_sort(F.collect_list(F.struct(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")))
    told = F.to_json(F.struct(F.lit(str(sorted(versions.items()))).alias("versions"), inputs.alias("inputs")))
    return hashes.agg(F.substring(F.sha2(told, 256), 1, 16).alias("snapshot_id"))


def case_event_stream(spark: SparkSession, path: str, schema: str, most: int = 256 << 20) -> DataFrame:
    """Appended event files as a stream (S14): ``path`` is a folder of them, or one file; ``most`` bytes a trigger."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(most))
    if fs.getFileStatus(at).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def stamp_manifest(manifest: DataFrame, index: dict[str, str], files: DataFrame) -> DataFrame:
    """The one-row manifest (files array<struct<name,sha256,size>>) with embedding fields, and files (name, sha256, size)
    added to its list, in the order of names; a name that is listed again replaces the old entry (S15)."""
    added = files.agg(F.collect_list(F.struct("name", "sha256", "size")).alias("_added"))  # index files: a few
    names = F.transform("_added", lambda f: f["name"])
    kept = F.filter("files", lambda f: ~F.array_contains(names, f["name"]))
    return manifest.join(F.broadcast(added), how="cross").withColumn("files", F.array_sort(F.concat(kept, "_added"))).drop("_added").withColumns({k: F.lit(v) for k, v in index.items()})


def body_hash(*columns: str):
    """Hash of a row's fields as JSON with sorted names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
