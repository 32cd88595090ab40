"""Helpers that several operators share: shared-folder tables, word splitting, hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java form of a word: a run of characters other than space and TAB..CR.
WORD = r"[^\x20\x09-\x0D]+"

_local_dir: list[str] = []
#: Folders of table() in this process, oldest first.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset a temporary one, in local mode only."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="caselake-"))
    return _local_dir[0]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/caselake/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a full URI: one without a scheme is in the session's default file system, on executors as on the driver."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there and a lost executor costs nothing."""
    path = shared_path(df.sparkSession, name)
    _made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table() that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def made() -> int:
    """How many folders table() has made so far."""
    return len(_made)


def sweep(since: int, keep: DataFrame) -> None:
    """Deletes the folders that table() has made since then, but for those that keep reads."""
    read = {f.rpartition("/")[0].rpartition("/")[2] for f in keep.inputFiles()}
    for folder in _made[since:]:
        if folder.rpartition("/")[2] not in read:
            _delete(keep.sparkSession, folder)
    del _made[since:]


#: A key with more than this share of all rows is split in pieces of about that share.
HOT_SHARE = 1 / 1000


def hot_keys(counts: DataFrame, on: list[str]) -> DataFrame:
    """counts (on, n rows of each key) -> on, pieces: the keys with more than HOT_SHARE of all rows and how many pieces of
    about that share they make. Fewer than 1 / HOT_SHARE keys can be hot, whatever the tables hold."""
    total = counts.agg(F.sum("n").alias("total"))
    pieces = F.ceil(F.col("n") / (F.col("total") * HOT_SHARE)).cast("int").alias("pieces")
    return counts.join(F.broadcast(total), how="cross").where(F.col("n") > F.col("total") * HOT_SHARE).select(*on, pieces)  # one row's total


def split_join(many: DataFrame, few: DataFrame, on: list[str], counts: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """many joined to few (one row a key), with hot keys dealt to several tasks.

    counts: ``on`` and n, the rows of many for each key, or hot_keys of them; ``by``: the column of many whose hash chooses a
    piece. Only the rows that hot keys have in few are repeated, once for each piece. Null keys match nothing."""
    hot = counts if "pieces" in counts.columns else hot_keys(counts, on)
    salt = F.coalesce(F.pmod(F.xxhash64(by), F.col("pieces")).cast("int"), F.lit(0)).alias("piece")
    dealt = many.join(F.broadcast(hot), on, "left").select(*[F.col(f"`{c}`") for c in many.columns], salt)
    repeated = few.join(F.broadcast(hot), on, "left").select(*[F.col(f"`{c}`") for c in few.columns], F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("piece"))
    return dealt.join(repeated, [*on, "piece"], how).drop("piece")


class HashedWords(dict):
    """Word (bytes) -> 64-bit hash; keeps the first words it meets, so memory stays bounded in a worker."""

    def __init__(self, limit: int = 400_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = h
        return h


_cache: dict = {}


def give_back() -> None:
    """Returns freed memory to the system, where its allocator can."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def worker_cache(name: object, make):
    """The cache of that name in this worker process. Workers outlive tasks, so a new cache replaces the one before it."""
    if name not in _cache:
        if _cache:
            _cache.clear()
            give_back()
        _cache[name] = make()
    return _cache[name]


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(worker_cache("words", HashedWords).__getitem__, words), dtype=np.uint64, count=len(words))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash for each window of n words (n up to 6); none if there are fewer words."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    count = len(hashes) - n + 1
    total = np.zeros(count, dtype=np.uint64)
    for i in range(n):
        total += mix64(hashes[i : i + count] + np.uint64(i + 1)) * _ODD[i]
    return mix64(total)
