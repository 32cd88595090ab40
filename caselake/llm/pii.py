r"""Information-theoretic sanitisation of personal data, with DataFrame functions alone.

1. Base patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers in whole texts, leftmost and
   without overlaps for each kind; matches that fail the kind's test are dropped. Each distinct value is a protected
   entity.
2. The corpus tells how strongly a term reveals an entity. With documents as contexts, n(e), n(t) and n(t, e) of N
   documents give IC(e) = -log2 p(e) and PMI(t; e) = log2 p(t, e) / (p(t) p(e)); the disclosure of e by t is
   PMI / IC, 1 if t occurs only beside e. Counts cover all documents; a pair needs SUPPORT common documents.
   Most entities are in one or two documents, which says nothing about their terms, so they are estimated from a
   pool: of the entity itself, of its mail domain, network (first two parts), card issuer (six digits) or dialling
   prefix (four digits), and of its kind, the narrowest that SUPPORT documents hold counts.
3. In documents that hold e, terms that disclose it by GENERALISE or more become spans of kind term: they are
   generalised to a label, from REMOVE up they are removed. Base spans stay as they are.

Terms are runs of letters, digits and _ outside of base spans; numbers that aren't valid entities are terms as well.
Positions are code points, ends exclusive.

Defined cases: a null text is empty and has no span; rows that repeat a text or an id are contexts of their own;
spans with equal starts stand in the order email, ip, card, phone, term; a pool that all documents hold has
no information and no term discloses it; pools in fewer than SUPPORT documents have no terms; an empty table gives no rows; other
columns are ignored (``sanitise`` passes them on). Pools that the same documents hold count once, so a list of many values
that goes round whole has one pool. Patterns use possessive quantifiers and start only where a run
starts or the last match ended, so very long runs take linear time; they match what the plain patterns match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, split_join, table

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT = 3
GENERALISE = 0.8
REMOVE = 0.95
TERM, TERM_GAP = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]+"
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without a hit of these have no valid match.
MAY_HOLD = {
    "email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?+[0-9]){13}",
    "phone": r"\+[0-9][\x20().0-9-]",
}
#: 0 to 255 with any zeros before; the zeros may be the whole part.
PART = "(?=[0-9])0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])?"
SPAN = "struct<start: bigint, kind: int, end: bigint, value: string>"


#: Matches whose positions are summed together, and code points of a text that are rewritten together.
BLOCK, CHUNK = 256, 4096


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is computed once, however often then names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def located(text: Column, pattern: Column | str, kind: int) -> Column:
    """Array of (start, kind, end, value) of all matches: the texts between the matches give the positions. Lengths are summed
    within blocks of matches and then over blocks, as one sum over all would copy what it has at each step."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.slice(F.split(text, p, -1), 1, F.size(found))
    pairs = F.zip_with(gaps, found, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value")))
    zero = F.lit(0).cast("long")

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + pair["gap"]
        end = start + F.length(pair["value"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    empty = F.struct(zero.alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    moved = lambda s, at: F.struct((s["start"] + at).alias("start"), s["kind"].alias("kind"), (s["end"] + at).alias("end"), s["value"].alias("value"))

    def summed(pairs: Column) -> Column:
        cuts = F.when(F.size(pairs) > 0, F.sequence(F.lit(1), F.size(pairs), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return F.transform(cuts, lambda at: F.aggregate(F.slice(pairs, at, BLOCK), empty, step))

    def whole(blocks: Column) -> Column:
        ahead = F.aggregate(blocks, F.array(zero), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        both = F.zip_with(blocks, F.slice(ahead, 1, F.size(blocks)), lambda b, at: F.struct(b["spans"].alias("spans"), at.alias("at")))
        return F.flatten(F.transform(both, lambda b: F.transform(b["spans"], lambda s: moved(s, b["at"]))))

    return let(let(pairs, summed), whole)


def rewritten(text: Column, spans: Column, say: Callable[[Column, Column, Column], Column]) -> Column:
    """text with its sorted spans replaced, a chunk of it at a time. say(span, first, n) gives what stands for n code points of
    a span; first: that it begins here, and not in a chunk or a span before."""
    chunks = F.regexp_extract_all(text, F.lit(f"((?s).{{1,{CHUNK}}})"), F.lit(1))

    def one(chunk: Column, no: Column, spans: Column) -> Column:
        begin = no.cast("long") * CHUNK
        end = begin + F.length(chunk)
        part = lambda a, b: F.substring(chunk, (a - begin + 1).cast("int"), (b - a).cast("int"))

        def put(acc: Column, s: Column) -> Column:
            a, b = F.greatest(acc["at"], s["start"]), F.greatest(acc["at"], F.least(end, s["end"]))
            said = say(s, s["start"] >= acc["at"], F.greatest(b - a, F.lit(0)).cast("int"))
            return F.struct(b.alias("at"), F.concat(acc["out"], part(acc["at"], a), said).alias("out"))

        here = F.filter(spans, lambda s: (s["start"] < end) & (s["end"] > begin))
        start = F.struct(begin.alias("at"), F.lit("").alias("out"))
        return F.aggregate(here, start, put, lambda acc: F.concat(acc["out"], part(acc["at"], end)))

    return let(spans, lambda found: F.array_join(F.transform(chunks, lambda chunk, no: one(chunk, no, found)), ""))


def blanked(text: Column, spans: Column) -> Column:
    """text with spaces in place of spans; positions stay."""
    return rewritten(text, spans, lambda s, first, n: F.repeat(F.lit(" "), n))


def luhn(value: Column) -> Column:
    """Whether the digits of value pass the Luhn test."""
    digits = F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def n_digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
    "card": lambda v: F.when(n_digits(v).between(14, 19), luhn(v)).otherwise(False),
    "phone": lambda v: n_digits(v).between(10, 15),
}


def base_spans(text: Column) -> Column:
    """All valid base matches by start, then kind."""
    none = F.array().cast(f"array<{SPAN}>")
    parts = []
    for no, kind in enumerate(KINDS[:4]):
        valid = VALID[kind]
        spans = F.filter(located(text, PATTERNS[kind], no), lambda s: valid(s["value"]))  # noqa: B023  (used at once)
        parts.append(F.when(text.rlike(MAY_HOLD[kind]), spans).otherwise(none))
    return F.array_sort(F.concat(*parts))


def told(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pools(span: Column) -> Column:
    """Names of an entity's pools, the narrowest first."""
    digits = F.regexp_replace(span["value"], "[^0-9]", "")
    parts = [F.lower(F.regexp_extract(span["value"], "@(.*)$", 1)), F.regexp_extract(span["value"], r"^[0-9]+\.[0-9]+", 0), F.substring(digits, 1, 6), F.substring(digits, 1, 4)]
    wide = F.element_at(F.array(*parts), span["kind"] + 1)
    kind = span["kind"].cast("string")
    return F.array(F.concat_ws(":", kind, F.lit("value"), span["value"]), F.concat_ws(":", kind, F.lit("group"), wide), kind)


def disclosing_terms(held: DataFrame, texts: DataFrame, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """held (row, rest, spans): the documents with entities, rest their texts without these; texts (text): all documents ->
    row, term, disclosure: the terms of each document that disclose one of its entities, with the highest disclosure."""
    each = held.select("row", F.explode(F.array_distinct(F.transform("spans", pools))).alias("names"))
    levels = each.select("row", F.posexplode("names").alias("level", "pool"), F.element_at("names", 1).alias("entity"))
    beside = table(levels.groupBy("row", "pool", "level").agg(F.collect_set("entity").alias("entities")), "pii-pools")
    # Pools that the same documents hold have the same counts with any term: they are one, known by a hash of these documents.
    same = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y")]
    n_in = beside.groupBy("pool").agg(*same)
    frequent = n_in.where(F.col("n") >= support).select("pool", F.xxhash64("n", "x", "y").alias("class"), F.col("n").alias("n_e"))
    rows = split_join(beside, frequent, ["pool"], n_in.select("pool", "n"), "row")
    # Of the pools of an entity the narrowest counts. Rows are documents, so what a group gathers is no longer than its text.
    narrowest = rows.select("row", "class", "level", F.explode("entities").alias("entity")).groupBy("row", "entity").agg(F.min_by("class", "level").alias("class")).groupBy("row").agg(F.collect_set("class").alias("narrowest"))
    by_row = rows.groupBy("row").agg(F.collect_set(F.struct("class", "n_e")).alias("classes")).join(narrowest, "row")
    contexts = table(held.join(by_row, "row").select("row", F.array_remove(F.array_distinct(F.split("rest", TERM_GAP)), "").alias("terms"), "classes", "narrowest"), "pii-contexts")
    beside_term = contexts.select(F.explode("terms").alias("term"), "classes").select("term", F.inline("classes"))
    pairs = table(beside_term.groupBy("class", "n_e", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= support).withColumn("h", F.xxhash64("term")), "pii-pairs")
    # Documents of each term: counted by its hash, so that the shuffle moves numbers, one a term and task.
    terms = texts.select(F.explode(F.array_distinct(F.split("text", TERM_GAP))).alias("term"))
    counts = terms.groupBy(F.xxhash64("term").alias("h")).agg(F.count("*").alias("n_t"))
    total = texts.agg(F.count("*").alias("n"))
    known = pairs.join(counts, "h").join(F.broadcast(total), how="cross")  # one row
    ic = -F.log2(F.col("n_e") / F.col("n"))
    given = F.least(F.col("n_te") / F.col("n_t"), F.lit(1.0))
    disclosure = F.when(ic > 0, 1 + F.log2(given) / ic).otherwise(F.lit(0.0))
    strong = table(known.withColumn("disclosure", disclosure).where(F.col("disclosure") >= threshold).select("class", "term", "disclosure", "n_te"), "pii-strong")
    own = contexts.select("row", F.explode("terms").alias("term"), "narrowest").select("row", "term", F.explode("narrowest").alias("class"))
    each = split_join(own, strong.drop("n_te"), ["class", "term"], strong.select("class", "term", F.col("n_te").alias("n")), "row")
    found = table(each.groupBy("row", "term").agg(F.max("disclosure").alias("disclosure")), "pii-terms")
    for used in (beside, contexts, pairs, strong):
        drop_table(used)
    return found


def _find(docs: DataFrame, support: int, threshold: float, keep_all_texts: bool) -> DataFrame:
    """doc (struct of docs' columns), spans, terms (spans of kind term; value is the disclosure) for every row."""
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    spanned = packed.select("doc", base_spans(text).alias("spans"))
    rested = spanned.select("doc", "spans", F.when(F.size("spans") > 0, blanked(text, F.col("spans"))).alias("rest"))
    kept = rested.select(F.monotonically_increasing_id().alias("row"), "spans", "rest", F.col("doc") if keep_all_texts else F.col("doc").dropFields("text").alias("doc"))
    base = table(kept, "pii-base")
    held = base.where("rest is not null").select("row", "rest", "spans")
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    strong = disclosing_terms(held, texts, support, threshold)
    # The places of a document's terms: its own words at most, so a row is no longer than its text.
    words = held.join(strong.select("row").distinct(), "row", "left_semi").select("row", F.explode(located(F.col("rest"), TERM, 4)).alias("s"))
    hits = words.select("row", "s", F.col("s.value").alias("term")).join(strong, ["row", "term"])
    terms = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s.start", "s.kind", "s.end", F.col("disclosure").cast("string").alias("value")))).alias("terms"))
    return base.join(terms, "row", "left").select("doc", "spans", F.coalesce("terms", F.array().cast(f"array<{SPAN}>")).alias("terms"))


def find_pii(docs: DataFrame, *, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term for every row of docs (doc_id, text)."""
    found = _find(docs.select("doc_id", "text"), support, threshold, False)
    count = lambda no, kind: F.size(F.filter("spans", lambda s: s["kind"] == no)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("doc.doc_id").alias("doc_id"),
        *[count(no, kind) for no, kind in enumerate(KINDS[:4])],
        F.sha2(told(F.col("spans")).cast("binary"), 256).alias("base_sha256"),
        told(F.array_sort(F.concat("spans", "terms"))).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


def sanitise(docs: DataFrame, *, support: int = SUPPORT, threshold: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """docs with base spans replaced by [EMAIL] and so on, and disclosing terms by [TERM] or nothing."""
    found = _find(docs, support, threshold, True)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("doc.text")

    def say(s: Column, first: Column, n: Column) -> Column:
        gone = ~first | ((s["kind"] == 4) & (s["value"].cast("double") >= remove))
        return F.when(gone, F.lit("")).otherwise(F.element_at(names, s["kind"] + 1))

    spans = F.array_sort(F.concat("spans", "terms"))
    return found.select(*[(F.when(F.size(spans) > 0, rewritten(text, spans, say)).otherwise(text) if c == "text" else F.col("doc").getField(c)).alias(c) for c in docs.columns])


def op1_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
