"""Quality rules as a short-circuit cascade.

A document is kept if no rule rejects it. Rules are ordered by rejections per second: ``plan_cascade`` runs every
rule on a bounded sample of documents and measures its CPU time and how many documents it rejects, both on texts as the
cascade meets them: those that the base rules passed, with what the base counts have already made of them (words and
lines); the main pass applies the rules in that order to each document and stops at the first that rejects. The
verdict is the conjunction of all rules, so it doesn't depend on the order; only the time does.

Defined cases: a null or empty text has no words and fails the base rules; ties in the order go by rule name;
repeated rows are judged each; an empty table gives no rows; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import window_hashes, word_hashes

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
WINDOW = 5
REPEAT_PERCENT = 20
#: Distinct rows that the plan of the cascade is measured on: those with the lowest hash of id and text.
SAMPLE_ROWS = 512


class Text:
    """A text with what several rules need, computed at most once."""

    def __init__(self, data: bytes | None) -> None:
        self.data = data or b""
        self._words: list[bytes] | None = None
        self._lines: list[bytes] | None = None

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.data.split()
        return self._words

    @property
    def lines(self) -> list[bytes]:
        if self._lines is None:
            self._lines = [x for x in self.data.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        return self._lines


def count_points(data: bytes) -> int:
    """Code points of UTF-8 data."""
    return len(data) if data.isascii() else len(data.decode("utf-8", "replace"))


def count_symbols(data: bytes, symbols: str = SYMBOLS) -> int:
    return sum(data.count(s.encode()) for s in symbols)


def count_duplicate_lines(lines: list[bytes]) -> int:
    """Lines equal to an earlier one."""
    return len(lines) - len(set(lines))


def count_repeated_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words that lie in a window of n words that the text holds twice or more."""
    windows = window_hashes(word_hashes(words), n)
    if not len(windows):
        return 0
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())



def symbols_per_word(t: Text) -> bool:
    return count_symbols(t.data) > 0.1 * len(t.words)


def bangs_per_word(t: Text) -> bool:
    return t.data.count(b"!!") > 0.1 * len(t.words)


def duplicate_line_share(t: Text) -> bool:
    # a share of few lines says little
    return len(t.lines) >= 5 and count_duplicate_lines(t.lines) > 0.3 * len(t.lines)


def adjacent_word_repeats(t: Text) -> bool:
    h = word_hashes(t.words)
    return bool(len(h) > 1) and int((h[1:] == h[:-1]).sum()) > 0.2 * len(h)


def upper_case_share(t: Text) -> bool:
    letters = np.frombuffer(t.data, dtype=np.uint8)
    upper = int(((letters >= 65) & (letters <= 90)).sum())
    lower = int(((letters >= 97) & (letters <= 122)).sum())
    return upper > 0.6 * (upper + lower) and upper + lower > 0


def mean_word_length(t: Text) -> bool:
    points = count_points(b"".join(t.words))
    return bool(t.words) and not 2 <= points / len(t.words) <= 25


def few_distinct_words(t: Text) -> bool:
    return len(t.words) >= 50 and len(set(t.words)) < 0.02 * len(t.words)


#: Name -> whether the rule rejects a text.
RULES: dict[str, Callable[[Text], bool]] = {f.__name__: f for f in (symbols_per_word, bangs_per_word, duplicate_line_share, adjacent_word_repeats, upper_case_share, mean_word_length, few_distinct_words)}


def _binary(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def base_counts(t: Text) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    n, repeated = len(t.words), count_repeated_words(t.words)
    return n, count_points(b"".join(t.words)), count_symbols(t.data), count_duplicate_lines(t.lines), repeated, n < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * n


def _measure(batches: Iterator[pa.RecordBatch], rules: dict) -> Iterator[pa.RecordBatch]:
    spent, rejected, n = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0), 0
    for batch in batches:
        for data in _binary(batch, "text"):
            t = Text(data)
            if base_counts(t)[-1]:
                continue  # never meets the cascade
            n += 1
            for name, rule in rules.items():
                began = time.process_time()
                rejected[name] += rule(t)
                spent[name] += time.process_time() - began
    if n:
        yield pa.RecordBatch.from_pydict({"rule": list(rules), "rejected": list(rejected.values()), "seconds": list(spent.values()), "n": [n] * len(rules)})


def plan_cascade(docs: DataFrame, rules: dict | None = None, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejections per second on the sample, best first; rules that reject nothing stand last, cheapest first."""
    rules = RULES if rules is None else rules
    hashed = docs.select(F.xxhash64(F.col(id_col), F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))
    chosen = hashed.select("h").distinct().orderBy("h").limit(sample_rows)  # equal rows are one
    sample = hashed.join(F.broadcast(chosen), "h").groupBy("h").agg(F.first("text").alias("text"))
    found = sample.select("text").mapInArrow(lambda it: _measure(it, rules), "rule string, rejected long, seconds double, n long").groupBy("rule").agg(F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))
    rows = {r["rule"]: (r["rejected"], r["seconds"]) for r in found.collect()}  # one row a rule
    worth = {name: (-rows[name][0] / max(rows[name][1], 1e-9), rows[name][1], name) if name in rows else (0.0, 0.0, name) for name in rules}
    return sorted(rules, key=worth.__getitem__)


def _judge(batches: Iterator[pa.RecordBatch], order: list[str], rules: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")}
        for data in _binary(batch, "text"):
            t = Text(data)
            base = base_counts(t)
            by = None if base[-1] else next((name for name in order if rules[name](t)), None)
            for k, v in zip(out, (*base, not base[-1] and by is None, by), strict=True):
                out[k].append(v)
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]], names=["doc_id", *out])


def apply_rules(docs: DataFrame, rules: dict | None = None, *, order: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, kept, rejected_by (the cascade's first rejecting rule, else null)."""
    rules = RULES if rules is None else rules
    order = plan_cascade(docs, rules, id_col=id_col, text_col=text_col) if order is None else order
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        lambda it: _judge(it, order, rules),
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string",
    )


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    # Which rule rejected first depends on measured times, so the query leaves it out: reruns agree.
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rejected_by")
