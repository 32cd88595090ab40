"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Every document gets an exponential key -ln(u) / w from a hash of its id and text and its quality weight w. Within its
source documents stand in key order; the target of the source is met by complete epochs over the source and
then by the documents at the front of that order until the rest of the target is reached.

A source may hold a third of all rows, so no window runs over a whole source: the key axis is cut into buckets
(a monotone function of the key), prefix sums run within (source, bucket), and the sums of earlier buckets are
added from a table of bucket totals. Rows with equal id, source and text are one entry with a number of copies, as
they share a key; the first of them are taken, and the entry becomes rows again at the end.

Defined cases: a null text has size 0 and is hashed as the empty one; a null source is a source of its own, last in
order; a null id is hashed as the empty string; equal keys stand in the order of id, then size; which of equal rows are taken
can't be told apart, so reruns agree in any order of the input; repeated rows count as documents of their own; an
empty table gives no rows; columns other than the named ones are ignored. Sources stand in one order over all, so their
table (a row for each) is sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, table

WEIGHTS = (1, 2, 3)
CAP = 3
#: Rows that a window within a bucket should sort.
ROWS_PER_BUCKET = 20_000
MIN_BUCKETS = 64
#: Sampling weight by labels.quality; documents without a label have the middle one.
LABEL_WEIGHT = {1: 1.0, 0: 0.25}
UNLABELLED_WEIGHT = 0.5


def es_bits(doc_id: Column, text: Column) -> Column:
    """52 bits of the MD5 of id and text, so reruns agree."""
    said = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 13), 16, 10).cast("long")


def es_key(bits: Column, weight: Column) -> Column:
    """-ln(u) / weight; u in (0, 1) from 52 bits."""
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2**52))) / weight


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> source, source_size, target. One row a source.

    Sources in code point order, null last, weigh as ``weights`` repeats and share the total of all sizes. A
    target above cap * source_size is cut to it and the excess shared again: water filling, solved in one pass
    over the sources in order of cap * size / weight.
    """
    listed = sizes.select("source", F.col("source_size").cast("long"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = listed.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("fill", F.col("most") / F.col("weight"))
    order = [F.col("fill"), F.col("source").asc_nulls_last()]
    up, whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - (F.sum("most").over(up) - F.col("most"))) / (F.sum("weight").over(whole) - F.sum("weight").over(up) + F.col("weight"))
    levels = ranked.withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("place", "level"))).over(whole)
    return levels.withColumn("first", first).select(
        "source",
        "source_size",
        F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("most")).otherwise(F.col("first.level") * F.col("weight")).alias("target"),
    )


def mix_sources(docs: DataFrame, weight_of: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: the words of each document that the mix takes.

    ``weight_of``: positive quality weights (doc_id, weight), one row an id; others weigh UNLABELLED_WEIGHT. A document is taken whole,
    floor(target / source_size) times and once more if it stands at the front of the order: if no more than
    half of it lies beyond the rest of the target. So a source misses its target by half a document at most.
    ``row_col``: a column with a number of each row, passed on, by which rows that share an id can be told apart.
    """
    row = [row_col] if row_col else []
    text = F.col(text_col).cast("string")
    sized = docs.select(*row, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias("size"), es_bits(F.col(id_col), text).alias("bits"))
    if not row:
        sized = sized.groupBy("doc_id", "source", "size", "bits").agg(F.count("*").alias("times"))
    if weight_of is not None:  # joined to the sizes, so that no text is shuffled
        null = sized.where("doc_id is null").withColumn("weight", F.lit(None).cast("double"))  # they match nothing, and may be many
        sized = sized.where("doc_id is not null").join(weight_of.select("doc_id", "weight"), "doc_id", "left").select(*null.columns).unionByName(null)
    weight = F.coalesce("weight", F.lit(UNLABELLED_WEIGHT)) if weight_of is not None else F.lit(1.0)
    times = F.lit(1).cast("long") if row else F.col("times")
    sized = table(sized.select(*row, "doc_id", "source", "size", times.alias("times"), es_key(F.col("bits"), weight).alias("key")), "mix-sizes")
    # One shuffle by (source, bucket) serves the prefix sums; the totals are a few rows for each bucket.
    buckets = max(MIN_BUCKETS, sized.count() // ROWS_PER_BUCKET)
    placed = sized.withColumn("bucket", F.floor(F.lit(buckets) * F.col("key") / (1 + F.col("key"))).cast("int")).withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    sums = placed.groupBy("name", "source", "bucket").agg(F.sum(F.col("size") * F.col("times")).alias("sum"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("sum").alias("source_size")))
    earlier = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    starts = sums.select("name", "bucket", (F.sum("sum").over(earlier) - F.col("sum")).alias("start"))
    named = targets.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("name"), "source_size", "target")
    starts = starts.join(named, "name")
    within = Window.partitionBy("name", "bucket").orderBy("key", "doc_id", "size", *row).rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("size") * F.col("times")
    ahead = placed.withColumn("ahead", F.sum(mass).over(within) - mass)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))
    once = (F.col("start") + F.col("ahead") + F.col("copy") * F.col("size") + F.col("size") / 2 <= rest).cast("long")
    joined = ahead.join(starts, ["name", "bucket"])
    return (
        (joined.withColumn("copy", F.lit(0)) if row else joined.withColumn("copy", copy))
        .withColumn("epochs", epochs)
        .select(*row, "doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + once)).cast("long").alias("taken"), (F.col("epochs") + once).cast("int").alias("copies"))
    )


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) from labels.quality; of several labels of a document the lowest counts."""
    by_id = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return by_id.select("doc_id", F.coalesce(*[F.when(F.col("quality") == q, F.lit(v)) for q, v in LABEL_WEIGHT.items()], F.lit(UNLABELLED_WEIGHT)).alias("weight"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT d.doc_id, d.source,
    CAST(len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || coalesce(d.text, '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
      / (CASE q.quality WHEN 1 THEN 1.0::DOUBLE WHEN 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END) AS key
  FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM d GROUP BY source),
f AS (SELECT *, 3.0::DOUBLE * source_size AS most, 3.0::DOUBLE * source_size / weight AS fill FROM s),
l AS (
  SELECT *, row_number() OVER o AS place,
    (CAST(sum(source_size) OVER () AS DOUBLE) - (sum(most) OVER o - most)) / (sum(weight) OVER () - sum(weight) OVER o + weight) AS level
  FROM f WINDOW o AS (ORDER BY fill, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)),
k AS (SELECT min(place) FILTER (level <= fill) AS place FROM l),
t AS (
  SELECT l.source, l.source_size,
    CASE WHEN k.place IS NULL OR l.place < k.place THEN l.most ELSE (SELECT level FROM l l2 WHERE l2.place = k.place) * l.weight END AS target
  FROM l CROSS JOIN k),
a AS (
  SELECT doc_id, source, size,
    sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS ahead
  FROM d),
e AS (
  SELECT a.doc_id, a.size, a.ahead, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM a JOIN t ON a.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN ahead + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e
"""
