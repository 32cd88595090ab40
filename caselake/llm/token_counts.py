"""Token counts as delta-maintained rollups by source, language and tokenizer version.

The store is a folder in a file system that all executors share. A batch of changes (insert, delete, revise) becomes
signed rows: -1 for the count that a document had, +1 for the one it gets. Totals are sums of signs and of signed
counts; they are additive, so a rollup of each batch is kept beside its rows and totals read only those.

A commit writes rows and rollup to folders of its own attempt and then creates the marker of the next number, which names
batch and attempt. Creating the marker is the commit: it fails where it exists, so of two commits at once one comes second and takes
back what the first one made; a batch counts once however often it is sent, and what broken attempts left is never read.
History is read for the changed documents alone: the ledger is kept in buckets by id, and only theirs are read.
``compact`` puts one commit in place of all before it.

Defined cases: a null text has 0 tokens; null sources and languages are groups of their own; an insert of a present
document is a revision, a delete or revision of an absent one deletes nothing (a revision then inserts); of several
changes of a document in a batch a delete wins, then the most tokens, then the first source and language; rows with a
null id are counted when inserted, each as a document of its own that nothing can revise or delete; an empty batch
commits no rows; tokenizer versions don't touch each other's counts; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_table, shared_path, table, worker_cache
from .packing import TOKENIZER, ChunkTokenizer, tokenizer_path

#: The second version that the query keeps counts for.
BYTE_TOKENIZER = "byte_bpe_50k.tiktoken"
#: Chunks whose numbers of tokens a worker keeps.
CHUNKS = 1_000_000
#: Buckets of ids in the ledger.
BUCKETS = 64
LEDGER = "doc_id long, source string, lang string, tokenizer string, n_tokens long, sign int, bucket int"
ROLLUP = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class ChunkCounter(ChunkTokenizer):
    """Numbers of tokens by chunk in place of ids."""

    def _learn(self, chunks: list[bytes]) -> None:
        super()._learn(chunks)
        for c in chunks:
            self.known[c] = len(self.known[c]) // 4

    def count(self, data: bytes) -> int:
        chunks = data.split()
        new = [c for c in set(chunks) if c not in self.known]
        if new:
            if len(self.known) + len(new) > self.limit:
                self.known.clear()
                new = list(set(chunks))
            self._learn(new)
        return sum(map(self.known.__getitem__, chunks))


def _tiktoken(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def counter(path: str):
    """bytes -> number of tokens, by the tokenizer file's kind."""
    if path.endswith(".tiktoken"):
        encode = worker_cache(path, lambda: _tiktoken(path)).encode_ordinary
        return lambda data: len(encode(data.decode("utf-8", "replace")))
    return worker_cache((path, "counts"), lambda: ChunkCounter(path, CHUNKS)).count


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    count = counter(path)
    for batch in batches:
        counts = [count(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()]
        i = batch.schema.get_field_index("text")
        yield batch.set_column(i, "n_tokens", pa.array(counts, pa.int64()))


def count_tokens(docs: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    """doc_id, source, lang, n_tokens of whole texts."""
    path = tokenizer_file or tokenizer_path(TOKENIZER)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _count(it, path), "doc_id long, source string, lang string, n_tokens long")


class TokenRollup:
    """A store of signed counts below ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _fs(self, path: str) -> tuple:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def commits(self) -> list[dict]:
        """What each commit says, in order: its batches, its attempt and, of a compaction, the first commit that it doesn't
        replace. One line a commit since the last compaction."""
        fs, p = self._fs(f"{self.path}/commits")
        if not fs.exists(p):
            return []
        said = sorted((json.loads(r["value"]) for r in self.spark.read.text(f"{self.path}/commits").where("value <> ''").collect()), key=lambda c: c["number"])
        start = max((i for i, c in enumerate(said) if c["compacts"]), default=0)
        return said[start:]

    def _mark(self, commit: dict) -> bool:
        """Creates the marker of the commit's number; False if another has it. One that broke off is empty and replaced."""
        fs, p = self._fs(f"{self.path}/commits/{commit['number']:012d}")
        if fs.exists(p) and fs.getFileStatus(p).getLen() > 0:
            return False
        fs.delete(p, False)
        try:
            out = fs.create(p, False)
        except Exception:
            if fs.exists(p):
                return False
            raise
        out.write(bytearray((json.dumps(commit) + "\n").encode()))
        out.close()
        return True

    def _read(self, kind: str, schema: str, attempts: list[str]) -> DataFrame:
        paths = [f"{self.path}/{kind}/attempt={a}" for a in attempts]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.path}/{kind}").schema(schema).parquet(*paths).drop("attempt")

    def ledger(self) -> DataFrame:
        return self._read("ledger", LEDGER, [c["attempt"] for c in self.commits()])

    def _write(self, rows: DataFrame, attempt: str) -> None:
        """Rows in buckets by id, and their sums. Rows without an id are never looked up and go to any bucket."""
        bucket = F.pmod(F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id")), F.lit(BUCKETS)).cast("int")
        rows.withColumn("bucket", bucket).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "doc_id").write.partitionBy("bucket").parquet(f"{self.path}/ledger/attempt={attempt}")
        made = self._read("ledger", LEDGER, [attempt])
        sums = made.groupBy("source", "lang", "tokenizer").agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        sums.coalesce(1).write.parquet(f"{self.path}/rollup/attempt={attempt}")

    def commit(self, batch: str, changes: DataFrame, version: str, tokenizer_file: str | None = None) -> bool:
        """changes: doc_id, change ('insert', 'revise', 'delete'), text, source, lang. False if the batch was there.

        Texts are counted once; if another commit comes between, only the rows that it takes back are made again."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if any(batch in c["batches"] for c in self.commits()):
            return False
        gone = changes.where("change = 'delete' and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("long").alias("n_tokens"), F.lit(1).alias("gone"))
        counted = table(count_tokens(changes.where("change = 'insert' or (change = 'revise' and doc_id is not null)"), tokenizer_file), "token-counts-batch")
        order = Window.partitionBy("doc_id").orderBy(F.desc("gone"), F.desc("n_tokens"), "source", "lang")
        known = counted.where("doc_id is not null").withColumn("gone", F.lit(0)).unionByName(gone)
        one = table(known.withColumn("place", F.row_number().over(order)).where("place = 1").select("doc_id", "source", "lang", "n_tokens", "gone"), "token-counts-changes")
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
        touched = [r[0] for r in one.select(bucket).distinct().collect()]  # BUCKETS numbers at most
        plus = one.where("gone = 0").unionByName(counted.where("doc_id is null").withColumn("gone", F.lit(0))).select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), "n_tokens", F.lit(1).alias("sign"))
        while True:
            base = self.commits()
            if any(batch in c["batches"] for c in base):
                done = False
                break
            attempt = f"{batch}-{uuid.uuid4().hex}"
            had = self._read("ledger", LEDGER, [c["attempt"] for c in base]).where(F.col("bucket").isin(touched) & (F.col("tokenizer") == version) & F.col("doc_id").isNotNull())
            had = had.join(one.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id", "source", "lang", "n_tokens").agg(F.sum("sign").alias("net")).where("net > 0")
            minus = had.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), "n_tokens", (-F.col("net")).cast("int").alias("sign"))
            self._write(plus.unionByName(minus), attempt)
            number = base[-1]["number"] + 1 if base else 0
            if self._mark({"number": number, "batches": [batch], "attempt": attempt, "compacts": False}):
                done = True
                break
        drop_table(counted)
        drop_table(one)
        return done

    def compact(self) -> bool:
        """One commit in place of all so far: rows that took each other back go, and totals are read from one file. False if
        another commit came between; attempts that are replaced stay for readers that began before."""
        base = self.commits()
        if not base:
            return False
        attempt = f"compact-{uuid.uuid4().hex}"
        keys = ["doc_id", "source", "lang", "tokenizer", "n_tokens"]
        net = self._read("ledger", LEDGER, [c["attempt"] for c in base])
        kept = net.where("doc_id is not null").groupBy(*keys).agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0").unionByName(net.where("doc_id is null").select(*keys, "sign"))
        self._write(kept, attempt)
        return self._mark({"number": base[-1]["number"] + 1, "batches": sorted({b for c in base for b in c["batches"]}), "attempt": attempt, "compacts": True})

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches; groups without documents are left out."""
        sums = self._read("rollup", ROLLUP, [c["attempt"] for c in self.commits()]).groupBy("source", "lang", "tokenizer").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0")


#: Documents that the query revises: those with runs of signs, which the revision takes out.
SIGNS = r"[#*$%&|<>!]"


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """For two tokenizers: all documents come in, those with runs of signs are revised, those labelled toxic are taken
    down, and a replay of the first batch changes nothing. No text is shuffled."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select("doc_id").distinct()
    none = F.lit(None).cast("string")
    first = docs.withColumn("change", F.lit("insert"))
    revised = docs.where(F.col("text").rlike(f"{SIGNS}{{2}}")).withColumn("text", F.regexp_replace("text", SIGNS, "")).withColumn("change", F.lit("revise"))
    gone = toxic.select("doc_id", none.alias("text"), none.alias("source"), none.alias("lang"), F.lit("delete").alias("change"))
    store = TokenRollup(spark, shared_path(spark, "token-counts"))
    for version in (TOKENIZER, BYTE_TOKENIZER):
        name, file = version.partition(".")[0], tokenizer_path(version)
        for batch, changes in (("0001", first), ("0002", revised), ("0003", gone), ("0001", first)):
            store.commit(f"{batch}-{name}", changes, version, file)
    return store.totals()
