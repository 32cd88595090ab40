"""How the sources of a language differ in the words they use, by single-pass in-memory indexing.

1. Each task fills a block in memory: documents by (language, term), and counts by (language, term, source). When the
   block holds BLOCK postings it is written as a run sorted by language and term, and the next one begins.
2. Runs are dealt by a hash of language and term. A task heap-merges its shard of all runs, so each term comes once with all
   its sources, and those in enough documents of their language are kept. Where there are more than FAN runs, groups
   of FAN are merged to runs first.
3. p of a term that a source lacks is the same for all such terms. So two sources differ by the number of kept terms
   times the distance of those, and a stream over the kept terms corrects that for terms that one of them has: a
   source's row of corrections at a time, written whenever ROOM numbers have gathered.

Defined cases: null text, language and source count as empty strings; a (language, source) without any term takes part with
counts of zero; where a language keeps no term all its pairs have value 0; repeated rows and ids are documents of their
own; equal values stand in the order of the item's UTF-8; an empty table gives no rows; other columns are ignored. The
groups (language, source) are held by every task, a few numbers each; the pairs asked for are their square.
"""

from __future__ import annotations

import heapq
import itertools
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

MIN_DOCS, SMOOTH, ONE, RANKS = 30, 5, 1_000_000_000, 50
#: Postings of a block in memory, and runs that one merge reads.
BLOCK, FAN = 1_000_000, 256
#: Documents for each hash shard, and the least number of shards.
DOCS_PER_SHARD, SHARDS = 20_000, 64
#: Corrections that a task holds, and kept terms that it takes at once.
ROOM, TERMS = 4_000_000, 1024
#: Bytes of a text whose words are split at once.
PIECE = 1 << 22

#: A run's part in a shard: its entries in order, as a compressed Arrow stream.
RUN = "run string, shard int, entries binary"
#: key: language, NUL, term (a term has no NUL); docs: documents with the term, in the first entry of a key, else 0.
ENTRY = pa.schema([("key", pa.binary()), ("source", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

#: Terms are runs of ASCII letters and of all signs beyond ASCII, whose UTF-8 has only bytes from 128 up.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a piece of it at a time."""
    data = text.translate(LETTERS)
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            end = data.find(b" ", end)
            end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class Block:
    """Postings in memory: documents by (language, term) and occurrences by (language, source, term)."""

    def __init__(self) -> None:
        self.docs: dict[str, Counter] = defaultdict(Counter)
        self.counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        self.size = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        counts, seen = self.counts[lang][source], set()
        before = len(counts)
        for words in pieces(text):
            counts.update(words)
            seen.update(words)
        self.docs[lang].update(seen)
        self.size += len(counts) - before

    def run(self) -> pa.Table:
        """The entries in the order of key and source."""
        keys, sources, sizes, counts = [], [], [], []
        for lang, by_source in self.counts.items():
            front = lang.encode() + b"\0"
            for source, terms in by_source.items():
                keys.extend([front + t for t in terms])
                counts.extend(terms.values())
                sources.append(source)
                sizes.append(len(terms))
        names = pa.array(sources, pa.string()).take(pa.array(np.repeat(np.arange(len(sources)), sizes)))
        rows = pa.table({"key": pa.array(keys, pa.binary()), "source": names, "n": pa.array(counts, pa.int64())}).sort_by([("key", "ascending"), ("source", "ascending")])
        first = _first(rows["key"])
        docs = np.zeros(len(rows), dtype=np.int64)
        docs[first] = [self.docs[lang.decode()][term] for lang, _, term in (k.rpartition(b"\0") for k in rows["key"].take(pa.array(first)).to_pylist())]
        return rows.append_column("docs", pa.array(docs)).cast(ENTRY)


def _first(keys: pa.ChunkedArray) -> np.ndarray:
    """Where a key begins."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64)
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    return np.flatnonzero(np.r_[True, pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)])


def _written(run: pa.Table, shards: int, name: str) -> Iterator[pa.RecordBatch]:
    """A row for each shard of a run."""
    shard = np.fromiter(map(zlib.crc32, run["key"].to_pylist()), dtype=np.int64, count=len(run)) % shards
    order = np.argsort(shard, kind="stable")
    run, shard = run.take(pa.array(order)).combine_chunks(), shard[order]
    starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]).tolist() if len(shard) else []
    for a, b in itertools.pairwise([*starts, len(shard)]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, ENTRY, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(run.slice(a, b - a))
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([shard[a]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["run", "shard", "entries"])


def _index(batches: Iterator[pa.RecordBatch], shards: int, limit: int) -> Iterator[pa.RecordBatch]:
    block = Block()
    for batch in batches:
        for lang, source, text in zip(*[batch.column(c).to_pylist() for c in ("lang", "source", "text")], strict=True):
            block.add(lang, source, text)
            if block.size >= limit:
                yield from _written(block.run(), shards, uuid.uuid4().hex)
                block = Block()
    yield from _written(block.run(), shards, uuid.uuid4().hex)


def merged(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Heap-merges runs: an entry for each (key, source), with the key's documents in its first, and where keys begin."""
    runs = [pa.ipc.open_stream(x.as_py()).read_all() for x in rows["entries"]]
    starts = np.r_[0, np.cumsum([len(r) for r in runs])].tolist()
    heads = [zip(r["key"].to_pylist(), range(a, b), strict=True) for r, (a, b) in zip(runs, itertools.pairwise(starts), strict=True)]
    order = np.fromiter((i for _, i in heapq.merge(*heads)), dtype=np.int64, count=starts[-1])
    found = pa.concat_tables([ENTRY.empty_table(), *runs]).combine_chunks().take(pa.array(order)).combine_chunks()
    first = _first(found["key"])
    docs = np.add.reduceat(found["docs"].to_numpy(), first) if len(first) else np.zeros(0, dtype=np.int64)
    of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(found)]))
    names = found["source"].combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    by_name = pc.sort_indices(names.dictionary).to_numpy()
    rank = np.empty(len(by_name), dtype=np.int64)
    rank[by_name] = np.arange(len(by_name))
    pair = of * max(1, len(rank)) + rank[names.indices.to_numpy()]
    order = np.argsort(pair, kind="stable")
    new = np.flatnonzero(np.r_[True, pair[order][1:] != pair[order][:-1]]) if len(pair) else np.zeros(0, dtype=np.int64)
    n = np.add.reduceat(found["n"].to_numpy()[order], new) if len(new) else np.zeros(0, dtype=np.int64)
    kept = order[new]
    begin = np.searchsorted(of[kept], np.arange(len(first)))
    all_docs = np.zeros(len(kept), dtype=np.int64)
    all_docs[begin] = docs
    one = found.select(["key", "source"]).take(pa.array(kept))
    return one.append_column("n", pa.array(n)).append_column("docs", pa.array(all_docs)).cast(ENTRY), begin


def _remade(rows: pa.Table, shards: int) -> pa.Table:
    """A group of runs as one, within a shard; its shards share the name."""
    return pa.Table.from_batches(_written(merged(rows)[0], shards, f"part-{rows['part'][0]}"), pa.schema([("run", pa.string()), ("shard", pa.int32()), ("entries", pa.binary())]))


KEPT = "lang string, term string, sources array<string>, counts array<long>"


def _keep(rows: pa.Table, least: int) -> pa.Table:
    found, begin = merged(rows)
    docs = found["docs"].to_numpy()[begin]
    whole = np.diff(np.r_[begin, len(found)])
    kept = found.filter(pa.array(np.repeat(docs >= least, whole)))
    sizes = whole[docs >= least]
    offsets = np.r_[0, np.cumsum(sizes)]
    keys = [k.rpartition(b"\0") for k in kept["key"].take(pa.array(offsets[:-1])).to_pylist()]
    lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), kept[c].combine_chunks()) for c in ("source", "n")]
    return pa.table([pa.array([k[0].decode() for k in keys], pa.string()), pa.array([k[2].decode() for k in keys], pa.string()), *lists], names=["lang", "term", "sources", "counts"])


def frequencies(docs: DataFrame, min_docs: int = MIN_DOCS, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """lang, term, sources, counts of the terms in at least min_docs documents of their language. docs: lang, source, text,
    none null."""
    shards = max(SHARDS, docs.count() // DOCS_PER_SHARD)
    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    runs = table(rows.mapInArrow(lambda it: _index(it, shards, block), RUN), "divergence-runs")
    while (n := runs.select("run").distinct().count()) > fan:
        grouped = runs.withColumn("part", F.pmod(F.hash("run"), F.lit(-(-n // fan))))
        runs = table(grouped.groupBy("shard", "part").applyInArrow(lambda rows: _remade(rows, shards), RUN), "divergence-runs")
    return table(runs.groupBy("shard").applyInArrow(lambda rows: _keep(rows, min_docs), KEPT), "divergence-terms")


def share(count: Column | int, total: str, terms: str) -> Column:
    """1 + floor(10**9 * (count + 5) / (total + 5 * terms)), exact."""
    count = count if isinstance(count, Column) else F.lit(count)
    scaled = F.lit(ONE).cast("decimal(18,0)") * (count.cast("decimal(19,0)") + F.lit(SMOOTH).cast("decimal(1,0)"))
    below = F.col(total).cast("decimal(38,0)") + F.lit(SMOOTH).cast("decimal(38,0)") * F.col(terms).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", scaled, below)


def _shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    if counts.max(initial=0) < 9_000_000_000:
        return 1 + (ONE * (counts + SMOOTH)) // total
    return np.array([1 + ONE * (int(c) + SMOOTH) // int(t) for c, t in zip(counts, total, strict=True)], dtype=np.int64)


class Corrections:
    """What kept terms add to the distances of pairs beyond that of absent terms."""

    def __init__(self, groups: dict[str, tuple[list[str], np.ndarray]]) -> None:
        self.groups = groups  # language -> its sources in order, and total + 5 * terms of each
        self.places = {lang: {s: i for i, s in enumerate(sources)} for lang, (sources, _) in groups.items()}
        self.rows: dict[tuple[str, int], np.ndarray] = {}
        self.size = 0

    def add(self, lang: str, postings: list[tuple[list[str], list[int]]]) -> Iterator[pa.RecordBatch]:
        sources, below = self.groups[lang]
        term = np.repeat(np.arange(len(postings)), [len(s) for s, _ in postings])
        place = np.array([self.places[lang][s] for ss, _ in postings for s in ss])
        count = np.array([c for _, cc in postings for c in cc], dtype=np.int64)
        base = 1 + (ONE * SMOOTH) // below
        p = np.tile(base, (len(postings), 1))
        p[term, place] = _shares(count, below[place])
        here = np.zeros(p.shape, dtype=bool)
        here[term, place] = True
        for a in np.unique(place).tolist():
            has = np.flatnonzero(here[:, a])
            more = np.abs(p[has, a][:, None] - p[has]) - np.abs(base[a] - base)
            more[:, :a][here[has, :a]] = 0  # pairs of two that have the term are counted with the first
            if (lang, a) not in self.rows:
                if self.size and self.size + len(sources) > ROOM:
                    yield from self.flush()
                self.rows[lang, a] = np.zeros(len(sources), dtype=np.int64)
                self.size += len(sources)
            self.rows[lang, a] += more.sum(axis=0)

    def flush(self) -> Iterator[pa.RecordBatch]:
        for (lang, a), row in self.rows.items():
            sources = self.groups[lang][0]
            for b in itertools.batched(np.flatnonzero(row).tolist(), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b), pa.string()), pa.array([sources[a]] * len(b), pa.string()), pa.array([sources[i] for i in b], pa.string()), pa.array(row[list(b)], pa.int64())], ["lang", "source", "item", "more"])
        self.rows, self.size = {}, 0


def _correct(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    found = Corrections(shared.value)
    for batch in batches:
        rows = zip(*[batch.column(c).to_pylist() for c in ("lang", "sources", "counts")], strict=True)
        by_lang: dict[str, list] = defaultdict(list)
        for lang, sources, counts in rows:
            by_lang[lang].append((sources, counts))
        for lang, postings in by_lang.items():
            for part in itertools.batched(postings, TERMS):
                yield from found.add(lang, list(part))
    yield from found.flush()


def divergence(docs: DataFrame, *, min_docs: int = MIN_DOCS, ranks: int = RANKS, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """lang, source, part, item, value, rank: the distance of each two sources of a language, and the terms that tell a
    source from its language."""
    spark = docs.sparkSession
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = frequencies(rows, min_docs, block, fan)
    each = kept.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
    whole = kept.select("lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("of_lang"))
    langs = whole.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("of_lang").alias("lang_total"))
    totals = each.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    groups = table(groups, "divergence-groups")

    q = share(F.col("of_lang"), "lang_total", "terms")
    told = each.join(whole, ["lang", "term"]).join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), share(F.col("n"), "total", "terms").alias("p"), q.alias("q"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = told.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", (F.col("p") - F.col("q")).alias("value")).withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= ranks)

    held: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
    for g in sorted(groups.where("terms > 0").select("lang", "source", (F.col("total") + SMOOTH * F.col("terms")).alias("below")).toArrow().to_pylist(), key=lambda g: (g["lang"], g["source"])):
        held[g["lang"]][0].append(g["source"])
        held[g["lang"]][1].append(g["below"])
    shared = spark.sparkContext.broadcast({lang: (s, np.array(b, dtype=np.int64)) for lang, (s, b) in held.items()})
    more = kept.select("lang", "sources", "counts").mapInArrow(lambda it: _correct(it, shared), "lang string, source string, item string, more long")
    both = more.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "more").groupBy("lang", "x.source", "x.item").agg(F.sum("more").alias("more"))
    one = groups.select("lang", "source", "terms", F.when(F.col("terms") > 0, share(0, "total", "terms")).otherwise(0).alias("base"))
    other = one.select("lang", F.col("source").alias("item"), F.col("base").alias("other"))
    pairs = one.join(other, "lang").where("source <> item").join(both, ["lang", "source", "item"], "left")
    value = F.col("terms") * F.abs(F.col("base") - F.col("other")) + F.coalesce("more", F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value")).withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(terms)


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT lang, source, CAST(coalesce(s.total, 0) AS HUGEINT) AS total, coalesce(v, 0) AS v
      FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) s USING (lang, source) LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p
      FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 5)) // (any_value(total) + 5 * any_value(v)) AS q
      FROM c JOIN v USING (lang) JOIN (SELECT lang, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY lang) USING (lang) GROUP BY lang, term),
f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT p.lang, p.source, p.term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
UNION ALL
SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM term
QUALIFY rank <= 50
"""
