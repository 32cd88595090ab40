"""Publication of several tables as one: a manifest that is written last names the files of all of them with their hashes,
readers follow it, and verification compares the files with it. Input lines are split into rows and rejects in one pass."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import io

#: Bytes of a file that are hashed at a time.
BLOCK = 8 << 20


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True):
            store, at = pafs.FileSystem.from_uri(path)
            told = hashlib.sha256()
            with store.open_input_stream(at) as f:
                while block := f.read(BLOCK):
                    told.update(block)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([told.hexdigest()]), pa.array([size], pa.int64())], ["path", "sha256", "size"])


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, size of files of any size: each is streamed through the hash in blocks, where binary columns end at
    2 GB (S12). Spark lists the files, but
    for empty ones, which its readers skip; pyarrow opens them on the executors."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"))
    # partitions as asked for: names of files are so few bytes that one task would be made of all of them
    return listed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(_hashed, "path string, sha256 string, size long")


class Publication:
    """Published tables below ``folder``, the newest manifest counts.

    An attempt writes its tables and its list of files below folders of its own, then creates the manifest of the next
    number; creating it publishes. What broken attempts left is never read."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def manifest(self) -> dict | None:
        """number, attempt, tables, snapshot_id and versions of what is published."""
        fs, p = self._fs(f"{self.folder}/manifests")
        if not fs.exists(p):
            return None
        newest = self.spark.read.text(f"{self.folder}/manifests").where("value <> ''").select("value", F.get_json_object("value", "$.number").cast("long").alias("n")).orderBy(F.desc("n")).first()
        return json.loads(newest["value"]) if newest else None

    def _files(self, attempt: str) -> DataFrame:
        """name, sha256, size; names are relative to the attempt."""
        found = hash_files(self.spark, f"{self.folder}/data/{attempt}")
        return found.select(F.element_at(F.split("path", f"/data/{attempt}/"), -1).alias("name"), "sha256", "size").where("name not like '%/_SUCCESS'")

    def publish(self, tables: dict[str, DataFrame], order: dict[str, list[str]], versions: dict[str, str]) -> str:
        """Writes and publishes the tables; the snapshot's id comes from what they hold and from versions, not from clocks."""
        before, attempt = self.manifest(), uuid.uuid4().hex
        content = {}
        for name, df in tables.items():
            df.sortWithinPartitions(*order[name]).write.parquet(f"{self.folder}/data/{attempt}/{name}")
            rows = self.spark.read.schema(df.schema).parquet(f"{self.folder}/data/{attempt}/{name}")
            row = F.xxhash64(F.to_json(F.struct(*rows.columns))).cast("decimal(20,0)")
            content[name] = [str(x) for x in rows.agg(F.count("*"), F.coalesce(F.sum(row), F.lit(0))).first()]
        self._files(attempt).write.parquet(f"{self.folder}/files/{attempt}")
        snapshot = hashlib.sha256(json.dumps([content, versions], sort_keys=True).encode()).hexdigest()[:16]
        said = {"number": before["number"] + 1 if before else 0, "attempt": attempt, "tables": sorted(tables), "snapshot_id": snapshot, "versions": versions}
        self._commit(said)
        return snapshot

    def _commit(self, said: dict) -> None:
        fs, p = self._fs(f"{self.folder}/manifests/{said['number']:012d}")
        out = fs.create(p, False)
        out.write(bytearray((json.dumps(said) + "\n").encode()))
        out.close()

    def read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/data/{self.manifest()['attempt']}/{name}")

    def files(self) -> DataFrame:
        return self.spark.read.schema("name string, sha256 string, size long").parquet(f"{self.folder}/files/{self.manifest()['attempt']}")

    def verify(self) -> DataFrame:
        """name, verdict of each file that is listed or there: pass, changed, missing or extra."""
        seen = self._files(self.manifest()["attempt"]).select("name", F.col("sha256").alias("seen"))
        verdict = F.when(F.col("sha256").isNull(), "extra").when(F.col("seen").isNull(), "missing").when(F.col("seen") == F.col("sha256"), "pass").otherwise("changed")
        return self.files().join(seen, "name", "full").select("name", verdict.alias("verdict"))


def split_kb_raw(spark: SparkSession, path: str, out: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """JSON lines as rows, as rejects (line, reason), and how many lines there are of each (S1). The lines are read and parsed once:
    both go to one table, and the counts are observed as it is written."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", io.KB_RAW + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("row"))
    reasons = {"not_json": F.col("row").isNull() | F.col("row._corrupt").isNotNull(), "no_id": F.coalesce(F.trim("row.id"), F.lit("")) == "", "no_content": F.col("row.content").isNull()}
    reason = F.coalesce(*[F.when(c, name) for name, c in reasons.items()], F.lit(""))
    told = parsed.withColumn("reason", reason)
    seen = Observation()
    counts = [F.count("*").alias("lines"), *[F.count_if(F.col("reason") == n).alias(n) for n in reasons]]
    split = told.select("row", F.when(F.col("reason") != "", F.col("value")).alias("value"), F.col("reason").alias("kept_reason"), (F.col("reason") == "").alias("good"), "reason")
    split.observe(seen, *counts).drop("reason").write.partitionBy("good").parquet(out)
    schema = told.schema["row"].dataType.simpleString()
    written = spark.read.schema(f"row {schema}, value string, kept_reason string, good boolean").parquet(out)
    rows = written.where("good").select("row.*").drop("_corrupt")
    return rows, written.where("not good").select(F.col("value").alias("line"), F.col("kept_reason").alias("reason")), {k: int(v) for k, v in seen.get.items()}
