"""Knowledge-base build: classify raw rows, keep or exclude, section, parents, counts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze, text

# Reasons and statuses by pattern.
DOT_LEADER = r"\.{4,}"
PAGE_NUMBER = r"^\s*\d{1,4}\s*$"
BLANK_PAGE = r"^[\s\d]*$"
FIGURE = r"(?iu)\b(?:Рисун(?:ок|ке|ка)|Рис\.)\s*\d+"
POINTER = r"(?iu)\b(?:Приложени[еяию]|см\.\s|смотри\s)"
VERSION = r"\d{2}\.\d{2}\.\d{4}v\d+"
PORTAL_KEY = r"^portal_api:([^:]+):([^:]+)$"
FILE_NAME = r"(?i)\.(pdf|docx?|xlsx?|pptx?)$"
STAMP_TITLE = r"^[\d.]{6,}\s*v?\d*$"
LETTERS = r"[А-Яа-яЁё]{3,}"


def service_reason(content: Column | str, title: Column | str | None = None, dot_leader: str = DOT_LEADER) -> Column:
    """Why a row is a service fragment, else null; the order decides, length never does."""
    body, head = F.trim(text(content)), text(title) if title is not None else F.lit("")
    return (
        F.when(squeeze(body) == "", "empty_content")
        .when(body.rlike(dot_leader) | head.rlike(dot_leader), "content_is_table_of_contents")
        .when(body.rlike(PAGE_NUMBER), "content_is_page_number_only")
        .when(body.rlike(BLANK_PAGE), "content_is_blank_page")
    )


def keep_exclude(rows: DataFrame, content: str, title: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Kept rows, and excluded rows with their reason."""
    told = rows.withColumn("reason", service_reason(content, title))
    return told.where("reason is null").drop("reason"), told.where("reason is not null")


def attachment_status(content: Column | str, figure: str = FIGURE, pointer: str = POINTER) -> Column:
    """incomplete wins over pointer, else complete."""
    return F.when(text(content).rlike(figure), "incomplete").when(text(content).rlike(pointer), "pointer").otherwise("complete")


def derive_roles(audience: Column | str, known: tuple = ("supplier", "customer")) -> Column:
    """Known roles of a comma-separated list, distinct and sorted (P4); empty means unverified."""
    parts = F.transform(F.split(F.lower(text(audience)), ","), lambda p: F.trim(p))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: p.isin(*known))))


def version_stamp(title: Column | str, content: Column | str, source_type: Column | str, pattern: str = VERSION) -> Column:
    """First stamp of the title, else of the content; none for portal rows (P5)."""
    hit = lambda c: F.nullif(F.regexp_extract(text(c), pattern, 0), F.lit(""))
    kind = F.col(source_type) if isinstance(source_type, str) else source_type
    return F.when(kind != "portal", F.coalesce(hit(title), hit(content)))


def portal_key(key: Column | str, pattern: str = PORTAL_KEY) -> tuple[Column, Column]:
    """(source_id, parent_id) of portal_api:article:part; other keys are part 1 of themselves."""
    k = text(key)
    hit = k.rlike(pattern)
    article = F.when(hit, F.regexp_extract(k, pattern, 1)).otherwise(k)
    part = F.when(hit, F.regexp_extract(k, pattern, 2)).otherwise("1")
    return F.concat_ws(":", F.lit("portal"), article, part), F.concat_ws(":", F.lit("portal"), article)


def rename_fields(rows: DataFrame) -> DataFrame:
    """Collection facts under their own names."""
    return rows.withColumnsRenamed({"updated_at": "collected_at", "source_url": "collection_endpoint"})


def rebuilt_title(title: Column | str, content: Column | str, source_name: Column | str, letters: str = LETTERS) -> tuple[Column, Column]:
    """Title and the reason it was replaced for: the first content line of 12 signs with letters, cut at 180."""
    t = F.trim(text(title))
    reason = (
        F.when(t.rlike(FILE_NAME), "title_was_filename")
        .when(t.rlike(DOT_LEADER), "title_was_toc_line")
        .when(t.rlike(STAMP_TITLE), "title_was_version_stamp")
        .when(t == "", "title_was_empty")
        .when(F.length(t) < 4, "title_too_short")
    )
    lines = F.transform(F.split(text(content), "\n"), lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, DOT_LEADER, " "), r"^[ .…]+|[ .…]+$", ""), r"\s{2,}", " "))
    first = F.trim(F.substring(F.get(F.filter(lines, lambda x: (F.length(x) >= 12) & x.rlike(letters)), F.lit(0)), 1, 180))
    plain = F.trim(F.regexp_replace(F.regexp_replace(t, DOT_LEADER, " "), r"\s{2,}", " "))
    kept = F.coalesce(F.nullif(t, F.lit("")), F.nullif(text(source_name), F.lit("")), F.lit("unknown"))
    return F.when(reason.isNull(), plain).otherwise(F.coalesce(first, kept)), F.when(reason.isNull(), "").when(first.isNull(), F.concat(reason, F.lit("_no_replacement_in_content"))).otherwise(reason)


#: Rows of a bucket of numbered, and how many buckets there are at most.
BUCKET_ROWS, MOST_BUCKETS = 100_000, 4096


def bucket_edges(rows: DataFrame, column: str, bucket_rows: int = BUCKET_ROWS) -> list[float]:
    """2**k - 1 quantiles of a numeric column that cut it in about equal buckets of bucket_rows; k from the number of rows."""
    n = rows.count()
    buckets = 16
    while buckets < min(MOST_BUCKETS, n / bucket_rows):
        buckets *= 2
    shares = [i / buckets for i in range(1, buckets)]
    found = rows.agg(F.percentile_approx(F.col(column).cast("double"), shares, 10 * buckets).alias("e")).first()["e"]
    return found or [0.0] * (buckets - 1)


def bucket_of(value: Column, edges: list[float]) -> Column:
    """How many edges are no larger than the value, by halving; -1 for null."""
    steps = [1 << i for i in range(len(edges).bit_length())][::-1]
    held = F.array(*[F.lit(float(e)) for e in edges])
    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: at + F.when(F.get(held, at + s - 1) <= value, s).otherwise(0))
    return F.when(value.isNull(), F.lit(-1)).otherwise(found)


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "place", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows with their place (from 1) within by, in order; the first order column is a number.

    No task sorts a whole group: quantiles of that column cut its range in buckets of about bucket_rows, rows are numbered within
    (by, bucket) and the counts of earlier buckets, a few rows for each group, are added. Null keys are groups, null order values come
    first."""
    edges = bucket_edges(rows, order[0], bucket_rows)
    placed = rows.select(*rows.columns, F.struct(F.lit(0), *by).alias("_by"), bucket_of(F.col(order[0]).cast("double"), edges).alias("_bucket"))
    w = Window.partitionBy("_by").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    before = placed.groupBy("_by", "_bucket").agg(F.count("*").alias("_n")).select("_by", "_bucket", (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
    within = placed.withColumn("_place", F.row_number().over(Window.partitionBy("_by", "_bucket").orderBy(*order)))
    return within.join(before, ["_by", "_bucket"]).select(*rows.columns, (F.col("_before") + F.col("_place")).alias(name))


def number_chunks(chunks: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """chunk_no within (document, page) in order."""
    return numbered(chunks, by, order, "chunk_no")


def unique_toc(entries: DataFrame) -> DataFrame:
    """entries (source_key, number, title, page): the first of each number by page."""
    w = Window.partitionBy("source_key", "number").orderBy("page", F.length("number"), "number", "title")
    return entries.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def latest_toc(pages: DataFrame, entries: DataFrame, span: int = 64) -> DataFrame:
    """Each page with the last entry that starts no later; ties by the longest number; null if there is none.

    As-of by union and a running window over ``span`` pages of a document, so that neither its entries are multiplied by
    its pages nor one task sorts a long document; the last entry of earlier spans, a row for each, is carried in."""
    entry = F.struct(F.col("page").alias("start"), F.length("number").alias("n"), "number", "title")
    both = entries.select("source_key", F.col("page").alias("at"), F.lit(0).alias("kind"), entry.alias("entry"), F.lit(None).cast("long").alias("page")).unionByName(
        pages.select("source_key", F.col("page").cast("int").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<start:int,n:int,number:string,title:string>").alias("entry"), F.col("page").cast("long").alias("page"))
    ).withColumn("_span", F.floor(F.col("at") / span))
    earlier = Window.partitionBy("source_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("source_key", "_span").agg(F.max("entry").alias("_most")).select(F.struct("source_key", "_span").alias("_key"), F.max("_most").over(earlier).alias("_carried"))
    w = Window.partitionBy("source_key", "_span").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("last", F.max("entry").over(w)).where("kind = 1").withColumn("_key", F.struct("source_key", "_span")).join(carried, "_key", "left")
    last = F.coalesce("last", "_carried")  # a later span's entries start later
    return here.select("source_key", "page", last["number"].alias("number"), last["title"].alias("title"))


def section_paths(sections: DataFrame, entries: DataFrame) -> DataFrame:
    """sections (source_key, number) -> section_path from the titles of its prefixes 1, 1.2, 1.2.3."""
    parts = F.split("number", r"\.")
    prefixes = sections.distinct().select("source_key", "number", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(F.split("number", r"\."), F.lit(1), n), "."))).alias("level", "prefix"))
    named = prefixes.join(entries.select("source_key", F.col("number").alias("prefix"), F.col("title").alias("prefix_title")), ["source_key", "prefix"])
    parts_of = F.array_sort(F.collect_list(F.struct("level", F.concat_ws(" ", "prefix", "prefix_title").alias("part"))))
    return named.groupBy("source_key", "number").agg(F.array_join(F.transform(parts_of, lambda x: x["part"]), " / ").alias("section_path"))


def parents(chunks: DataFrame, parent: str, order: list[str], content: str) -> DataFrame:
    """Ordered text, first chunk's title and child count of each parent (A2, A3). A parent is one article."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(content).alias("_text"))))
    return chunks.where(F.col(parent).isNotNull()).groupBy(parent).agg(F.array_join(F.transform(rows, lambda r: r["_text"]), "\n\n").alias("text"), F.count("*").alias("child_count"))


def section_parents(chunks: DataFrame, order: list[str]) -> DataFrame:
    """chunks (source_key, number, page_from, page_to, text, ...) -> parent_id, page_from of the first chunk, the last page
    (null where it is 0 or unknown), texts in order, child_count (A3). A parent is a top section of one document, so its
    texts are as long as that section; chunks without a number have no parent."""
    top = F.get(F.split("number", r"\."), F.lit(0))
    named = chunks.where("source_key is not null and number is not null").withColumn("parent_id", F.concat(F.lit("pdf:"), "source_key", F.lit(":s"), top))
    rows = F.array_sort(F.collect_list(F.struct(*order, "page_from", "text"))).alias("rows")
    g = named.groupBy("parent_id").agg(rows, F.nullif(F.max(F.coalesce("page_to", F.lit(0))), F.lit(0)).alias("page_to"), F.count("*").alias("child_count"))
    first = F.get("rows", F.lit(0))
    return g.select("parent_id", first["page_from"].alias("page_from"), "page_to", F.array_join(F.transform("rows", lambda r: r["text"]), "\n\n").alias("text"), "child_count")


def missing_pages(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Pages of documents that have some pages, but not these."""
    return expected.join(present.select("source_key").distinct(), "source_key", "left_semi").join(present.select("source_key", "page").distinct(), ["source_key", "page"], "left_anti")


def sections_by_heading(lines: DataFrame, heading: str) -> DataFrame:
    """lines (doc, line_no, line) with section: headings start one, it runs to the next."""
    w = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.sum(F.col("line").rlike(heading).cast("long")).over(w))


def carry_forward(rows: DataFrame, column: str, by: list[str], order: str) -> DataFrame:
    """Nulls take the last value above them."""
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


CHUNK = pa.schema([("chunk_no", pa.int64()), ("page_from", pa.int64()), ("page_to", pa.int64()), ("n_tokens", pa.int64()), ("text", pa.string())])


class _Chunker:
    """The chunk that is open in a section: at most ``high`` tokens and the pages of its lines."""

    def __init__(self, low: int, high: int, overlap: int) -> None:
        self.low, self.high, self.overlap = low, high, overlap
        self.no, self.held, self.first, self.last = 0, [], None, None

    def close(self, carry: bool) -> Iterator[tuple]:
        if self.held:
            yield self.no, self.first, self.last, len(self.held), " ".join(self.held)
            self.no += 1
            self.held, self.first = (self.held[-self.overlap :], self.last) if carry else ([], None)

    def line(self, page: int, line: str | None) -> Iterator[tuple]:
        words = (line or "").split()
        while words:
            if len(self.held) + len(words) > self.high and len(self.held) >= self.low:
                yield from self.close(True)
            room = self.high - len(self.held)
            self.held += words[:room]
            self.first = page if self.first is None else min(self.first, page)
            self.last = page
            words = words[room:]


def _chunks(batches: Iterator[pa.RecordBatch], low: int, high: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Rows in the order of section, page and line: a batch in, the chunks that it closes out."""
    section, open_chunk, kind = None, None, None
    for batch in batches:
        kind, out, owners = batch.column("section").type, [], []
        for s, page, line in zip(batch.column("section").to_pylist(), batch.column("page").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if open_chunk is None or s != section:
                closed = list(open_chunk.close(False)) if open_chunk else []
                out += closed
                owners += [section] * len(closed)
                section, open_chunk = s, _Chunker(low, high, overlap)
            closed = list(open_chunk.line(page, line))
            out += closed
            owners += [s] * len(closed)
        yield _chunk_batch(owners, out, kind)
    if open_chunk:
        closed = list(open_chunk.close(False))
        yield _chunk_batch([section] * len(closed), closed, kind)


def _chunk_batch(owners: list, rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(CHUNK)
    return pa.RecordBatch.from_arrays([pa.array(owners, kind), *[pa.array(c, f.type) for c, f in zip(columns, CHUNK, strict=True)]], ["section", *CHUNK.names])


def chunk_sections(sections: DataFrame, low: int = 220, high: int = 400, overlap: int = 40) -> DataFrame:
    """sections (section, page, line_no, line) -> section, chunk_no, page_from, page_to, n_tokens, text.

    Greedy over the lines of one section: a chunk closes where the next line would take it beyond ``high`` and it
    has ``low`` tokens; its last ``overlap`` tokens open the next. Spark sorts the lines, which can spill; a task holds the open
    chunk and a batch, never a whole section."""
    rows = sections.select("section", F.col("page").cast("long").alias("page"), "line_no", "line").repartition("section").sortWithinPartitions("section", "page", "line_no").drop("line_no")
    kind = dict(sections.dtypes)["section"]
    return rows.mapInArrow(lambda it: _chunks(it, low, high, overlap), f"section {kind}, chunk_no long, page_from long, page_to long, n_tokens long, text string")
