"""Exact top-k search by Hamming distance with incremental multi-index hashing.

A code is one or more words of 64 bits, each cut into segments. The index has a row for each segment of each distinct
code; the k smallest ids of a code are kept apart, so a code that a third of all rows share is one entry. A query
probes, for radius r = 0, 1, ..., and segment by segment, all values at distance r from its own and verifies full
distances. A code counts at the first such step that meets it, so each is found once, and only if it is no farther than
the kth that the query knows already. The query keeps the nearest codes that hold k ids. After segments 0 to a have been probed with radius r, and the others with r - 1, every code at distance
segments * r + a or less has been met; so a query is done when its kth distance is no more than that. Radii grow only
for queries that aren't done; they end at a segment's width, when all values have been probed.

Segments are as many as the number of codes asks for: as wide as its binary logarithm, 16 to 22 bits, so that a probed
value holds few codes and the masks of a radius are 705,432 at most. Hot values of the index are left to Spark's
skew join, which splits their codes.

Defined cases: null vectors have no code and are neither found nor query; null components, and those that a shorter
vector lacks, count as negative; null ids are not found; rows that repeat an id and code count once, an id with several
codes once for each; ties go to the smaller id; fewer than k rows give fewer results; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import drop_table, split_join, table

BITS = 64
K = 10
#: Probes of a query up to which a radius takes all segments in one step.
STEP_PROBES = 10_000


def code_words(vectors: DataFrame, column: str) -> int:
    """64-bit words that the longest vector takes."""
    longest = vectors.agg(F.max(F.size(column))).first()[0]
    return max(1, -(-(longest or 0) // BITS))


def sign_code(vector: Column, words: int = 1) -> Column:
    """Array of 64-bit words: bit i of word w is set if component 64 * w + i is positive."""
    bit = lambda w, i: F.when(F.get(vector, F.lit(BITS * w + i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long")
    word = lambda w: reduce(Column.bitwiseOR, [bit(w, i) for i in range(BITS)])
    return F.when(vector.isNotNull(), F.array(*[word(w) for w in range(words)]))


def cuts(n_codes: int, words: int) -> list[tuple[int, int, int]]:
    """(word, shift, width) of each segment for so many codes."""
    n = -(-BITS // min(22, max(16, n_codes.bit_length() - 1)))
    widths = [BITS // n + (i < BITS % n) for i in range(n)]
    return [(w, sum(widths[:i]), widths[i]) for w in range(words) for i in range(n)]


def steps(parts: list) -> Iterator[tuple[int, int, int]]:
    """(radius, first, end) in order: the segments first to end - 1 are probed with the radius; cheap radii take all at once."""
    width = max(w for _, _, w in parts)
    for radius in range(width + 1):
        if comb(width, radius) * len(parts) <= STEP_PROBES:
            yield radius, 0, len(parts)
        else:
            yield from ((radius, no, no + 1) for no in range(len(parts)))


def segment(code: Column, cut: tuple[int, int, int]) -> Column:
    word, shift, width = cut
    return F.shiftrightunsigned(F.get(code, F.lit(word)), shift).bitwiseAND(F.lit((1 << width) - 1))


def segments(code: Column, parts: list) -> Column:
    """Array of (segment, value, number of values) of a code."""
    return F.array(*[F.struct(F.lit(no).alias("segment"), segment(code, cut).alias("value"), F.lit(1 << cut[2]).cast("long").alias("span")) for no, cut in enumerate(parts)])


def apart(a: Column, b: Column, words: int) -> Column:
    """Hamming distance of two codes."""
    return reduce(Column.__add__, [F.bit_count(F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w)))) for w in range(words)]).cast("int")


def nearest(codes: DataFrame, queries: DataFrame, *, k: int = K, words: int = 1) -> DataFrame:
    """codes (id, code), queries (query_id, code), code an array of ``words`` longs -> query_id, rank, id, distance: the
    k nearest of each query."""
    spark = codes.sparkSession
    known = codes.where("id is not null and code is not null").select("id", "code").distinct()
    # Spark limits a code to its k smallest ids in each task before the shuffle, so no task gathers a hot code.
    first = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    few = known.withColumn("place", first).where(F.col("place") <= k)
    distinct = table(few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "topk-codes")
    parts = cuts(distinct.count(), words)
    index = table(distinct.select("code", F.get("ids", F.lit(0)).alias("id"), F.size("ids").alias("n"), F.explode(segments(F.col("code"), parts)).alias("s")).select("code", "id", "n", "s.segment", "s.value"), "topk-index")
    every = F.lit(BITS * words).alias("bound")
    asked = table(queries.where("query_id is not null and code is not null").select("query_id", F.col("code").alias("query_code")).distinct().withColumn("bound", every), "topk-queries")
    open_queries, best, done = asked, None, None
    last = max(width for _, _, width in parts)
    for radius, start, end in steps(parts):
        flips = spark.range(1 << last).where(F.bit_count("id") == radius).select(F.col("id").alias("mask"))
        own = open_queries.select("query_id", "query_code", "bound", F.explode(segments(F.col("query_code"), parts)).alias("s")).select("query_id", "query_code", "bound", "s.segment", "s.span", F.col("s.value").alias("own")).where(F.col("segment").between(start, end - 1))
        flipped = own.join(F.broadcast(flips), F.col("mask") < F.col("span"))  # the masks of a radius are bounded
        probes = flipped.select("query_id", "query_code", "bound", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        met = probes.join(index.hint("merge"), ["segment", "value"])
        far = [F.bit_count(segment(F.col("query_code"), cut).bitwiseXOR(segment(F.col("code"), cut))) for cut in parts]
        once = reduce(Column.__and__, [(d > radius) | (F.lit(no) == F.col("segment")) | ((d == radius) & (F.lit(no) > F.col("segment"))) for no, d in enumerate(far)])
        distance = apart(F.col("query_code"), F.col("code"), words)
        found = met.where(once & (distance <= F.col("bound"))).select("query_id", "code", "id", "n", distance.alias("distance"))
        # The k nearest ids belong to the k nearest codes by (distance, smallest id).
        pool = found if best is None else found.unionByName(best.join(open_queries.select("query_id"), "query_id", "left_semi").select(*found.columns))
        ahead = F.sum("n").over(_window().rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        near = _top(pool, k).withColumn("ahead", ahead).where(F.col("ahead") < k).drop("ahead")
        best = table(near, "topk-best")
        reach = best.groupBy("query_id").agg(F.sum("n").alias("n"), F.max("distance").alias("worst"))
        known = reach.where(F.col("n") >= k).select("query_id", F.col("worst").alias("known"))
        covered = reach.where((F.col("n") >= k) & (F.col("worst") <= len(parts) * radius + end - 1)).select("query_id")
        finished = best if (radius, end) == (last, len(parts)) else best.join(covered, "query_id", "left_semi")
        done = finished if done is None else done.unionByName(finished)
        still = open_queries.join(covered, "query_id", "left_anti").join(known, "query_id", "left")
        open_queries = table(still.select("query_id", "query_code", F.coalesce("known", "bound").alias("bound")), "topk-open")
        if open_queries.isEmpty():
            break
    drop_table(index)
    ends = done.select("query_id", "code", "distance")
    listed = split_join(ends, distinct, ["code"], ends.groupBy("code").agg(F.count("*").alias("n")), "query_id")
    rows = _top(listed.select("query_id", "distance", F.explode("ids").alias("id")), k)
    return rows.withColumn("rank", F.row_number().over(_window()).cast("int")).select("query_id", "rank", "id", "distance")


def _window() -> WindowSpec:
    return Window.partitionBy("query_id").orderBy("distance", "id")


def _top(pool: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query; Spark keeps k rows a query and task before the shuffle (WindowGroupLimit)."""
    return pool.withColumn("place", F.row_number().over(_window())).where(F.col("place") <= k).drop("place")


def op7_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    words = code_words(vectors, "embedding")
    rows = table(vectors.select(F.col("vec_id").alias("id"), sign_code(F.col("embedding"), words).alias("code")), "topk-rows")
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "code")
    return nearest(rows, queries, words=words).select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


ORACLE_SQL = """
WITH c AS (
  SELECT vec_id, [CASE WHEN x > 0 THEN '1' ELSE '0' END FOR x IN embedding] AS b FROM embeddings),
s AS (SELECT vec_id, CAST(array_to_string(b, '') AS BIT) AS code FROM c),
d AS (
  SELECT q.vec_id AS query_id, s.vec_id, CAST(bit_count(xor(q.code, s.code)) AS INTEGER) AS distance
  FROM s q, s WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
