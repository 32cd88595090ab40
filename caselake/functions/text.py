"""Text columns: tokens, identifiers, cleaning and masking, as built-in expressions.

Null texts count as empty. Patterns that are meant for Cyrillic set the (?iu) flags, as Java folds ASCII only
with (?i) alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Token and identifier patterns.
TOKEN = r"[0-9a-zA-Zа-яёА-ЯЁ]+(?:[-_./][0-9a-zA-Zа-яёА-ЯЁ]+)*"
IDENTIFIER = r"^(?:[А-ЯЁ]{2,6}|[A-Z]{2,6}|[A-ZА-ЯЁ]{2,10}(?:-[A-ZА-ЯЁ0-9]{1,10})+|\d{1,3}(?:\.\d{1,3}){1,3})$"
TOC_ENTRY = r"(\d{1,2}(?:\.\d{1,2})*)\.?\s*\n?\s*([^\n.]{3,120}?)\s*\.{4,}\s*(\d{1,4})\b"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?<!\d)(?:\+7|8|7)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}(?!\d)"
GUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
HEX = r"\b[0-9a-fA-F]{16,}\b"
LABELLED_NUMBER = r"(?iu)(ИНН|ИНС|ИПП|КПП|ОГРН|ОКПО|ГИД|УИД|нюм)\s*[:=#]?\s*\d[\d\s\-]{5,}"
TOPIC_PREFIX = r"(?s)^\s*Подтема запроса:\s*(.*?)\s*/\s*(.*)$"
NUMBER = r"(?<![\w-])\d+(?:[.,]\d+)?"
STEP_NUMBER = r"^\s*\d+[.)]\s*"
URL = r"(?i)https?://\S+"
# What looks technical, in this order, is blanked before words are judged.
TECHNICAL = {
    "TECH.URL": "(?U)(?:https?|ftp)://[^\\s<>\"']+",
    "TECH.WWW": "(?U)\\bwww\\.[^\\s<>\"']+",
    "TECH.EMAIL": r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+",
    "TECH.GUID": rf"(?U){GUID}",
    "TECH.HEX": r"(?U)\b(?:0x)?[0-9a-fA-F]{8,}\b",
    "TECH.STACKFRAME": '(?U)File "[^"]*", line \\d+',
    "TECH.PATH": r"(?U)(?:[A-Za-z]:)?[\\/][A-Za-z0-9_.\-]+(?:[\\/][A-Za-z0-9_.\-]+)+",
    "TECH.DOTTED_IDENT": r"(?U)\b[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+\b",
    "TECH.SNAKE_IDENT": r"(?U)\b[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+\b",
    "TECH.UNDERSCORE_IDENT": r"(?U)\b_[A-Za-z][A-Za-z0-9_]*\b",
    "TECH.CAMEL_IDENT": r"(?U)\b[a-z]+[A-Z][A-Za-z0-9]*\b",
    "TECH.DIGIT_RUN": r"(?U)\b\d{3,}\b",
}


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def tokens(c: Column | str) -> Column:
    """Letters and digits, joined by - _ . / (F2)."""
    return F.regexp_extract_all(text(c), F.lit(TOKEN), F.lit(0))


def lower_tokens(c: Column | str) -> Column:
    return F.transform(tokens(c), F.lower)


#: What a byte is to TOKEN: a letter or digit (1), a sign that joins them (2) or neither; bytes in lower case; and the two bytes of
#: a Cyrillic letter, by the last bit of the first and by the second, in lower case.
_KIND, _LOWER = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
_KIND[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")], _KIND[list(b"-_./")] = 1, 2
_LOWER[ord("A") : ord("Z") + 1] += 32
_CYRILLIC = np.zeros((2, 256, 2), np.uint8)
for _c in [*map(chr, range(ord("\u0410"), ord("\u044f") + 1)), "\u0401", "\u0451"]:
    _CYRILLIC[_c.encode()[0] & 1, _c.encode()[1]] = list(_c.lower().encode())


def split_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(tokens, their number in each text): the lower_tokens of a batch of texts, found in the bytes of all of them at once."""
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or at[0] == at[-1]:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    raw = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]]
    at = at - at[0]
    kind, n = _KIND[raw], len(raw)
    first = np.zeros(n + 1, bool)  # of a text
    first[at] = True
    lead = np.flatnonzero((raw[:-1] & 0xFE) == 0xD0)
    letter = _CYRILLIC[raw[lead] & 1, raw[lead + 1]]
    lead, letter = lead[letter[:, 0] > 0], letter[letter[:, 0] > 0]
    raw[lead], raw[lead + 1], kind[lead], kind[lead + 1] = letter[:, 0], letter[:, 1], 1, 1
    word = kind == 1
    sign = np.flatnonzero(kind[1:-1] == 2) + 1
    word[sign[word[sign - 1] & word[sign + 1] & ~first[sign] & ~first[sign + 1]]] = True
    begin, end = word & first[:-1], word & first[1:]
    begin[0], end[-1] = word[0], word[-1]
    begin[1:] |= word[1:] & ~word[:-1]
    end[:-1] |= word[:-1] & ~word[1:]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    offsets = np.r_[0, np.cumsum(end - begin)].astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(raw[word]))
    return tokens, np.diff(np.searchsorted(begin, at))


def identifiers(c: Column | str, pattern: str = IDENTIFIER) -> Column:
    """Codes and abbreviations in order of first appearance."""
    return F.array_distinct(F.filter(tokens(c), lambda t: t.rlike(pattern)))


def meaningful(c: Column | str, stop_words: list[str]) -> Column:
    """Lower tokens longer than one sign that aren't stop words."""
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(lower_tokens(c), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def near_key(c: Column | str) -> Column:
    """Lower-cased, without punctuation, single spaces (U4)."""
    return squeeze(F.regexp_replace(F.lower(text(c)), r"[^\p{L}\p{N}\s]", " "))


def scrub(c: Column | str) -> Column:
    """Personal data by labels, in order: e-mail, phone, guid, hex, labelled numbers."""
    out = text(c)
    for pattern, put in ((EMAIL, "<email>"), (PHONE, "<phone>"), (GUID, "<guid>"), (HEX, "<hex>"), (LABELLED_NUMBER, "$1 <num>")):
        out = F.regexp_replace(out, pattern, put)
    return out


def safe_label(c: Column | str) -> Column:
    """Scrubbed, spaces squeezed, 120 signs at most."""
    return F.substring(squeeze(scrub(c)), 1, 120)


def topic_parts(c: Column | str, pattern: str = TOPIC_PREFIX) -> tuple[Column, Column]:
    """Subtopic (null without the prefix) and question."""
    hit = text(c).rlike(pattern)
    return F.when(hit, F.regexp_extract(text(c), pattern, 1)), squeeze(F.when(hit, F.regexp_extract(text(c), pattern, 2)).otherwise(text(c)))


def drop_lines(c: Column | str, boilerplate: list[str]) -> tuple[Column, Column]:
    """Text without lines that, trimmed, are boilerplate; and how many went."""
    lines = F.split(text(c), "\n")
    bad = F.array(*[F.lit(x) for x in boilerplate]).cast("array<string>")
    kept = F.filter(lines, lambda x: ~F.array_contains(bad, F.trim(x)))
    return F.array_join(kept, "\n"), (F.size(lines) - F.size(kept)).cast("long")


def toc_entries(c: Column | str, pattern: str = TOC_ENTRY) -> Column:
    """Array of (number, title, page) (F8)."""
    part = lambda i: F.regexp_extract_all(text(c), F.lit(pattern), F.lit(i))
    rows = F.arrays_zip(part(1).alias("number"), part(2).alias("title"), part(3).alias("page"))
    clean = F.transform(rows, lambda r: F.struct(r["number"].alias("number"), F.regexp_replace(F.regexp_replace(r["title"], r"\s{2,}", " "), r"^[ .…]+|[ .…]+$", "").alias("title"), r["page"].cast("int").alias("page")))
    return F.filter(clean, lambda r: F.length(r["title"]) >= 3)


def mask_technical(c: Column | str) -> tuple[Column, Column]:
    """Text with technical spans blanked, and the names of the patterns that hit, in order."""
    out, hits = text(c), []
    for name, pattern in TECHNICAL.items():
        hits.append(F.when(out.rlike(pattern), F.lit(name)))
        out = F.regexp_replace(out, pattern, " ")
    return out, F.array_compact(F.array(*hits))


def fold(c: Column | str) -> Column:
    """Invisible signs out, case folded, yo as e, runs of a sign cut to three (F15); NFKC comes before (functions.russian.nfkc)."""
    plain = F.regexp_replace(text(c), "[\u200b\u200c\u200d\u2060\ufeff\u00ad]", "")
    folded = F.regexp_replace(F.lower(plain), "ß", "ss")  # the letter whose folded form isn't its small one
    return F.regexp_replace(F.translate(folded, "ё", "е"), r"(.)\1{3,}", "$1$1$1")


def numbers(c: Column) -> Column:
    """Numbers of a text without its leading step number."""
    return F.regexp_extract_all(F.regexp_replace(c, STEP_NUMBER, ""), F.lit(NUMBER), F.lit(0))


def excerpt(c: Column | str, n: int = 400) -> Column:
    """n signs at most, with an ellipsis where something is cut."""
    return F.when(F.length(text(c)) > n, F.concat(F.rtrim(F.substring(text(c), 1, n)), F.lit("…"))).otherwise(text(c))
