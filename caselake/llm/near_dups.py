"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

1. One pass over whole texts makes each document's shingle set, its sketch and the sketch's band keys. The sketch
   has t bins; round i < t hashes every shingle to a random bin, round t + j hashes all of them to bin j, and a bin
   keeps its first (round, hash) value. So every bin fills, whatever the set's size, and two sketches agree in a
   bin with the sets' Jaccard similarity as probability, concentrated as for independent hashes.
2. Texts with equal word sequences form classes; only the smallest id of a class goes on.
3. Documents with an equal band key share a bucket. Of each text in a bucket u counts the shingles that no other text
   in any bucket holds; for texts of n and m shingles with u and v such, the similarity is at most
   min(n - u, m - v) / max(n + v, m + u), and pairs that can't reach the threshold are left out before any text
   is read. Buckets aren't expanded into all their pairs: each has a leader, the text with the least share of u,
   and its members are verified against it on full shingle sets. Links merge components. Then what still lies apart
   in a bucket is compared: in buckets of SMALL members or fewer, by the pairs that pass the bound; larger
   buckets with leaders of one component form a cluster, and its texts outside that component are compared with all
   its texts in blocks, inside tasks, so no pair but a link is ever a row. A pair inside one component can't change
   the result, so no link is lost.
4. Links become components by minimum labels with pointer jumping over tables in the shared folder.

With 30 bands of 5 bins a pair of similarity 0.8 shares no band with probability 7e-6, one of 0.9 with 1e-12.
Shingles are compared by 64-bit hashes.

Defined cases: null, empty and wordless texts have empty sets, are linked with nothing and kept; a null id is
linked with nothing, its component is null and it is kept; rows that repeat an id are one node; ties don't arise,
as the smallest id wins; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, hot_keys, mix64, split_join, table, window_hashes, word_hashes

BANDS, ROWS = 30, 5
#: Members whose texts meet one copy of their leader's text.
CHUNK = 128
#: Members of a bucket up to which its pairs are rows.
SMALL = 64
#: Texts that a block compares, and shingles of the texts they are compared with.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1_000_000


def shingle_set(words: list[bytes], n: int) -> np.ndarray:
    """Sorted hashes of the distinct windows of n words; of the whole sequence if it has fewer words."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = word_hashes(words)
    return np.unique(window_hashes(h, min(n, len(h))) + np.uint64(min(n, len(h))))


def sketch(items: np.ndarray, t: int) -> np.ndarray:
    """t values, each (round, hash) packed in 64 bits; items must not be empty."""
    bins = np.full(t, np.iinfo(np.uint64).max, dtype=np.uint64)
    at, step, one = 0, max(1, -(-2 * t // len(items))), np.uint64(0x9E3779B97F4A7C15)
    while at < 2 * t:
        rounds = np.arange(at, min(at + step, 2 * t), dtype=np.uint64)
        h = mix64(items[None, :] ^ mix64((rounds + np.uint64(1)) * one)[:, None])
        place = np.where(rounds[:, None] < t, (h >> np.uint64(40)) % np.uint64(t), rounds[:, None] - np.uint64(t) * (rounds[:, None] >= t))
        value = (rounds[:, None] << np.uint64(48)) | (mix64(h) >> np.uint64(16))
        np.minimum.at(bins, place.astype(np.int64).ravel(), value.ravel())
        at += step
        if bins.max() != np.iinfo(np.uint64).max:
            break
    return bins


def band_keys(bins: np.ndarray, bands: int) -> np.ndarray:
    rows = bins.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows.shape[1]):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def _sketches(batches: Iterator[pa.RecordBatch], n: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, keys, banded = [], [], []
        for data in _texts(batch):
            words = (data or b"").lower().split()  # bytes.lower() changes A-Z only
            items = shingle_set(words, n)
            counts.append(len(items))
            keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
            banded.append(band_keys(sketch(items, bands * rows), bands) if words else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(banded, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "words_key", "bands"])


def _verify(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, chunk, b), the leader's own row (b null) first; yields the links."""
    held: tuple | None = None
    leaders: list[np.ndarray] = []
    for batch in batches:
        a_out, b_out = [], []
        for a, chunk, b, data in zip(batch.column("a").to_pylist(), batch.column("chunk").to_pylist(), batch.column("b").to_pylist(), _texts(batch), strict=True):
            items = shingle_set((data or b"").lower().split(), n)
            if held != (a, chunk):
                held, leaders = (a, chunk), []
            if b is None:
                leaders.append(items)
                continue
            for other in leaders:
                small, large = sorted((len(items), len(other)))
                if small and 100 * small >= percent * large:
                    common = len(np.intersect1d(items, other, assume_unique=True))
                    if 100 * common >= percent * (small + large - common):
                        a_out.append(a)
                        b_out.append(b)
                        break
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Of the distinct pairs (a, b) those whose full sets are similar enough. Each member's text moves once for each
    of its leaders, a leader's once for each CHUNK of members, so no task holds a leader with all its members."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("members"))
    chunked = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("members") / CHUNK)).alias("chunk"))
    need = chunked.select("a", "chunk", "b", F.col("b").alias("doc_id")).unionByName(chunked.select("a", "chunk").distinct().select("a", "chunk", F.lit(None).cast("long").alias("b"), F.col("a").alias("doc_id")))
    rows = need.join(texts.select("doc_id", "text"), "doc_id").select("a", "chunk", "b", "text")
    dealt = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(lambda it: _verify(it, n, percent), "a long, b long").distinct()


def _block_links(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, members first: links of the block's other texts, one for each component they link to."""
    held, ids, comps, sets, index = None, [], [], [], None
    for batch in batches:
        a_out, b_out = [], []
        for block, stray, i, comp, data in zip(batch.column("block").to_pylist(), batch.column("stray").to_pylist(), batch.column("id").to_pylist(), batch.column("component").to_pylist(), _texts(batch), strict=True):
            items = shingle_set((data or b"").lower().split(), n)
            if block != held:
                held, ids, comps, sets, index = block, [], [], [], None
            if not stray:
                ids.append(i)
                comps.append(comp)
                sets.append(items)
                continue
            if not sets:
                continue
            if index is None:
                known, inverse = np.unique(np.concatenate(sets), return_inverse=True)
                size = np.array([len(x) for x in sets])
                index = known, inverse, np.concatenate([[0], np.cumsum(size)[:-1]]), size, np.array(ids), np.array(comps)
            known, inverse, starts, size, id_at, comp_at = index
            at = np.searchsorted(known, items)
            at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == items)]
            mark = np.zeros(len(known), dtype=np.int32)
            mark[at] = 1
            common = np.add.reduceat(mark[inverse], starts)
            linked = (100 * common >= percent * (size + len(items) - common)) & (comp_at != comp)
            for k in np.unique(comp_at[linked], return_index=True)[1]:
                a_out.append(i)
                b_out.append(int(id_at[linked][k]))
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])


def cluster_links(rows: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """rows (key, id, n, own, component) of large buckets: links between the components in them.

    Buckets whose leaders lie in one component form a cluster; its texts outside that component meet all its texts."""
    lead = rows.groupBy("key").agg(F.min_by("component", F.struct(F.floor(1000 * F.col("own") / F.col("n")), "id")).alias("cluster"))
    able = rows.where(100 * (F.col("n") - F.col("own")) >= percent * F.col("n"))  # the others link to nothing
    sizes = able.groupBy("key").agg(F.count("*").alias("n"))
    each = table(split_join(able, lead, ["key"], sizes, "id").select("cluster", "id", "n", "own", "component").distinct(), "dups-clusters")
    of = each.groupBy("cluster").agg(F.count_if(F.col("component") != F.col("cluster")).alias("strays"), F.sum("n").alias("shingles"))
    split = of.where("strays > 0").select("cluster", F.ceil(F.col("strays") / BLOCK_TEXTS).alias("ns"), F.ceil(F.col("shingles") / BLOCK_SHINGLES).alias("nm"))
    told = table(split_join(each, split, ["cluster"], each.groupBy("cluster").agg(F.count("*").alias("n")), "id"), "dups-told")
    block = lambda s, m: F.concat_ws(":", F.col("cluster").cast("string"), s.cast("string"), m.cast("string")).alias("block")
    h = F.xxhash64("id")
    strays = told.where(F.col("component") != F.col("cluster")).withColumn("m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nm") - 1)))
    members = told.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ns") - 1)))
    need = members.select(block(F.col("s"), F.pmod(h, F.col("nm"))), F.lit(False).alias("stray"), "id", "component").unionByName(strays.select(block(F.pmod(h, F.col("ns")), F.col("m")), F.lit(True).alias("stray"), "id", "component"))
    dealt = need.join(texts.select(F.col("doc_id").alias("id"), "text"), "id").select("block", "stray", "id", "component", "text").repartition("block").sortWithinPartitions("block", "stray", "id")
    return dealt.mapInArrow(lambda it: _block_links(it, n, percent), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> id, component: the smallest id reachable, for every id in a link."""
    both = table(links.select("a", "b").union(links.select("b", "a")).distinct(), "dups-links")
    labels = table(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("component")), "dups-labels")
    hubs = table(hot_keys(both.groupBy("b").agg(F.count("*").alias("n")), ["b"]), "dups-hubs")
    while True:
        near = split_join(both, labels.withColumnRenamed("id", "b"), ["b"], hubs, "a").groupBy("a").agg(F.min("component").alias("near"))
        stepped = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        sizes = labels.groupBy("component").agg(F.count("*").alias("n"))  # components only grow together
        new = table(split_join(stepped, up, ["component"], sizes, "id", "left").select("id", "before", F.least("component", "up").alias("component")), "dups-labels")
        moved = new.where("component <> before").limit(1).count()
        drop_table(labels)
        labels = new.select("id", "component")
        if not moved:
            return labels


def _shingle_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            sets = [shingle_set((data or b"").lower().split(), n) for data in _texts(part)]
            ids = np.repeat(np.asarray(part.column("doc_id").to_numpy(), dtype=np.int64), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets).view(np.int64))], names=["id", "h"])


def own_shingles(texts: DataFrame, n: int) -> DataFrame:
    """(id, own): how many of its shingles no other text holds; ids with several texts are left out."""
    rows = texts.select("doc_id", "text").mapInArrow(lambda it: _shingle_rows(it, n), "id long, h long")
    once = rows.groupBy("h").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1")
    several = texts.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("c")).where("c > 1")
    return once.groupBy("id").agg(F.count("*").alias("own")).join(several, "id", "left_anti")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (see the module's docstring)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = table(texts.mapInArrow(lambda it: _sketches(it, shingle, bands, rows), "doc_id long, n_shingles long, words_key binary, bands array<long>"), "dups-sketches")
    linked = made.where("n_shingles > 0 and doc_id is not null")
    classes = table(linked.groupBy("words_key").agg(F.min("doc_id").alias("node")), "dups-classes")
    nodes = linked.join(classes.withColumnRenamed("node", "doc_id"), ["words_key", "doc_id"], "left_semi")
    keyed = nodes.select("doc_id", "n_shingles", F.explode("bands").alias("key"))
    shared = table(keyed.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n"), "dups-shared")
    hot = table(hot_keys(shared, ["key"]), "dups-hot")
    found = table(split_join(keyed, shared.select("key"), ["key"], hot, "doc_id").select("key", F.col("doc_id").alias("id"), F.col("n_shingles").alias("n")), "dups-buckets")
    # Texts of bucket members are fetched once; by a sort-merge join at any size, so that work grows evenly.
    inside = table(texts.join(found.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "dups-texts")
    own = own_shingles(inside, shingle)
    members = table(found.join(own, "id", "left").select("key", "id", "n", F.coalesce("own", F.lit(0)).alias("own")), "dups-members")
    drop_table(found)

    def may_link() -> F.Column:
        shared_most = F.least(F.col("n") - F.col("own"), F.col("n2") - F.col("own2"))
        return 100 * shared_most >= percent * F.greatest(F.col("n") + F.col("own2"), F.col("n2") + F.col("own"))

    def checked(pairs: DataFrame) -> DataFrame:
        return table(verified(table(pairs.select("a", "b").distinct(), "dups-pairs"), inside, shingle, percent), "dups-found")

    other = members.select("key", F.col("id").alias("b"), F.col("n").alias("n2"), F.col("own").alias("own2"))
    first = F.min(F.struct(F.floor(1000 * F.col("own") / F.col("n")).alias("rank"), "id", "n", "own")).alias("lead")
    lead = members.groupBy("key").agg(first).select("key", F.col("lead.id").alias("a"), "lead.n", "lead.own")
    found_links = checked(split_join(other, lead, ["key"], hot, "b").where(may_link() & (F.col("a") != F.col("b"))))
    # Rows of an id with several word sequences are one node: all classes they belong to are linked through the id.
    spread = linked.groupBy("doc_id").agg(F.min("words_key").alias("low"), F.max("words_key").alias("high")).where("low < high").select("doc_id")
    id_links = linked.select("doc_id", "words_key").join(spread, "doc_id").join(classes, "words_key").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
    links = found_links.unionByName(table(id_links, "dups-id-links"))
    label = components(links)
    here = members.join(label.withColumnRenamed("component", "found"), "id", "left").select("key", "id", "n", "own", F.coalesce("found", "id").alias("component"))
    several = here.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")).where("low < high").select("key", "members")
    split = table(split_join(here, several, ["key"], hot, "id"), "dups-split")
    few = split.where(F.col("members") <= SMALL)
    beside = few.select("key", F.col("id").alias("b"), F.col("n").alias("n2"), F.col("own").alias("own2"), F.col("component").alias("component2"))
    across = few.withColumnRenamed("id", "a").join(beside, "key").where((F.col("a") < F.col("b")) & (F.col("component") != F.col("component2")) & may_link())
    more = checked(across)
    large = split.where(F.col("members") > SMALL).drop("members")
    if large.limit(1).count():
        more = table(more.unionByName(cluster_links(large, inside, shingle, percent)), "dups-found")
    if more.limit(1).count():
        label = components(links.unionByName(more))
    node_of = classes.join(label, classes["node"] == label["id"], "left").select("words_key", F.coalesce("component", "node").alias("node"))
    slim = made.select("doc_id", "n_shingles", "words_key")
    with_class = slim.where("n_shingles > 0 and doc_id is not null").join(node_of, "words_key").select("doc_id", "n_shingles", F.col("node").alias("component_id"))
    alone = slim.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_class.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9_near_dups(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)


#: Brute force over all pairs with a common shingle; {n} is the words of a shingle.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < {n} THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + {n} - 1], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n} + 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
""".replace("{n}", "4")
