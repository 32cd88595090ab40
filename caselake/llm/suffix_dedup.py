"""Removes bytes that a document shares with one of a smaller id: suffix sorting by a common-prefix-aware merge sort.

Only the first WINDOW bytes of a suffix matter, so suffixes are windows: a window that sorts beside an equal one of a smaller
document is removed. Windows are taken as WORDS symbols of eight bytes; common prefixes are counted in these.

1. Tasks pack their documents into runs, each text once. Equal texts of other runs are found by a hash of 128 bits: all but
   those of the smallest id are removed whole and take no part in what follows.
2. A window that occurs twice has the same smallest hash of its GRAM-byte pieces both times. Runs send the set of these
   hashes, sorted, as differences; what only one text has comes back as 0. Such windows occur once, and aren't sorted.
3. Neighbouring windows with one such hash make a unit, the string that they cover, so that copied passages are cut in equal units
   wherever they stand. Units are sorted and merged first (4, 5): one that a smaller document has is lost with all its windows.
   Units that are left may still share single windows: these are hashed as wholes, and windows of a hash that several documents have
   are sorted and merged in the same way. A window's smallest document always holds it in a unit that is left.
4. Each run sorts its strings, a symbol at a time within ties, so that prefixes are known; equal ones become one entry with its
   smallest document, the others are covered. Entries are cut into ranges and sent front-coded: the number of symbols shared with the
   entry before, then the others.
5. A range's runs are merged by loser trees that hold each loser's common prefix with the winner it lost to. Of two with
   different prefixes the longer wins unread; equal ones are compared behind the prefix. One tree for each of many lanes
   (sub-ranges of the range) plays in step. The merge tells equal neighbours and so each string's smallest document, and a bit for each
   entry goes back to its run.
6. Runs mark the bytes that lost units, lost windows and covered places take.

Texts are written once, bucketed by run, and are not shuffled. Runs hold RUN_BYTES or a single longer text.

Defined cases: null texts are empty; matches never cross documents; of rows with equal ids none is the smaller, so they
don't remove each other's bytes; a null id counts as larger than all; texts below WINDOW bytes lose nothing; an empty
table gives no rows; other columns are ignored. Splitters of ranges come from a sample, which only shapes the ranges.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, mix64, shared_path, table

WINDOW, GRAM, WORDS = 50, 26, 7
SPAN = WINDOW - GRAM + 1
#: Symbols of a unit: those of its bytes (of SPAN windows at most), and its size.
UNIT_WORDS = -(-(WINDOW + SPAN - 1) // 8) + 1
RUN_BYTES = 8 << 20
#: Positions whose hashes are made at once.
BLOCK = 1 << 16
#: Bits by which the hashes of step 2 exceed the logarithm of their number, and hashes of a bucket.
SPARE_BITS, BUCKET_HASHES = 8, 2_000_000
#: Entries of a range, ranges at least and at most, windows of a run that the splitters are drawn from, and how many of all.
RANGE_ENTRIES, RANGES, MOST_RANGES, SAMPLE, MOST_SAMPLES = 1_000_000, 12, 1 << 17, 64, 500_000
#: Runs that one tree merges, entries of a lane (twice as many as its tree has runs at least).
FAN, LANE = 32, 64
#: Compression of what is large: texts of runs and symbols of entries.
LEVEL = 3
#: Of a symbol, the first 0 to 8 bytes.
MASKS = np.array([(0xFFFFFFFFFFFFFFFF << (8 * (8 - i))) & 0xFFFFFFFFFFFFFFFF for i in range(9)], dtype=np.uint64)
NO_ID = np.iinfo(np.int64).max
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA0761D6478BD642F], dtype=np.uint64)
_WHOLE = np.array([*_MIX, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)

RUNS = "run string, ids array<long>, texts array<int>, sizes array<int>, firsts array<long>, hashes array<binary>, sample array<binary>, n_bytes long, data binary"


@functools.cache
def _compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


@functools.cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def squeeze(data, level: int = 1) -> bytes:
    return _compressor(level).compress(memoryview(np.ascontiguousarray(data)).cast("B") if isinstance(data, np.ndarray) else data)


def unsqueeze(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(_decompressor().decompress(data), dtype=kind)


def _packed(rows: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
    """A run of (id, text)."""
    place: dict[bytes, int] = {}
    firsts: list[int] = []
    texts = []
    for i, x in rows:
        at = place.setdefault(x, len(place))
        if at == len(firsts):
            firsts.append(NO_ID)
        firsts[at] = min(firsts[at], NO_ID if i is None else i)
        texts.append(at)
    data = b"".join(place)
    sizes = [len(x) for x in place]
    sample = [x[p : p + WINDOW] for x, p in _spread(place, max(1, len(data) // SAMPLE))]
    row = [[uuid.uuid4().hex], [[i for i, _ in rows]], [texts], [sizes], [firsts], [[xxhash.xxh3_128_digest(x) for x in place]], [sample], [len(data)], [squeeze(data, LEVEL)]]
    kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in RUNS.split(", ")])


def _spread(texts, step: int) -> Iterator[tuple[bytes, int]]:
    """Every step-th window start of the texts laid end to end."""
    at = step // 2
    for x in texts:
        for p in range(at, len(x) - WINDOW + 1, step):
            yield x, p
        at = (at - len(x)) % step


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for i, x in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = x.as_py() or b""
            if held and size + len(text) > most:
                yield _packed(held)
                held, size = [], 0
            held.append((i, text))
            size += len(text)
    if held:
        yield _packed(held)


class Texts:
    """A run's texts but for those gone, laid end to end, with zeros behind; ``size`` bytes, text t from starts[t] to starts[t + 1]."""

    def __init__(self, data: bytes, sizes: list[int], gone: list[int] | None = None) -> None:
        raw = _decompressor().decompress(data) if sum(sizes) else b""
        if gone:
            ends, skip = list(itertools.accumulate(sizes)), set(gone)
            raw = b"".join(raw[b - n : b] for t, (b, n) in enumerate(zip(ends, sizes, strict=True)) if t not in skip)
            sizes = [n for t, n in enumerate(sizes) if t not in skip]
        self.size, self.raw = len(raw), raw + bytes(128)
        self.starts = np.r_[0, np.cumsum(np.array(sizes, dtype=np.int64))]
        self._words = np.ndarray((len(self.raw) - 7,), dtype=">u8", buffer=self.raw, strides=(1,))

    def word(self, at: np.ndarray, k: int, sizes: np.ndarray | None = None) -> np.ndarray:
        """Symbol k of the strings at those positions, windows if sizes are not given; the last symbol of others is their size."""
        if sizes is not None and k == UNIT_WORDS - 1:
            return sizes.astype(np.uint64)
        left = WINDOW - 8 * k if sizes is None else sizes - 8 * k
        return self._words[at + 8 * k].astype(np.uint64) & MASKS[np.clip(left, 0, 8)]

    def gram_hash(self, at: np.ndarray) -> np.ndarray:
        w = [self._words[at + k].astype(np.uint64) for k in (0, 8, 16, 18)]
        return mix64(w[0] * _MIX[0] + w[1] * _MIX[1] + w[2] * _MIX[2] + w[3] * _MIX[3])

    def window_hash(self, at: np.ndarray, bits: int) -> np.ndarray:
        """A hash of the whole window at each position."""
        out = np.empty(len(at), dtype=np.uint64)
        for a in range(0, len(at), BLOCK):
            here = at[a : a + BLOCK]
            h = np.zeros(len(here), dtype=np.uint64)
            for k, m in zip((0, 8, 16, 24, 32, 40, 42), _WHOLE, strict=True):
                h += self._words[here + k].astype(np.uint64) * m
            out[a : a + BLOCK] = mix64(h) >> np.uint64(64 - bits)
        return out

    def codes(self, at: np.ndarray, bits: int) -> np.ndarray:
        """The least hash of the window at each position."""
        least = self.gram_hash(at)
        for k in range(1, SPAN):
            least = np.minimum(least, self.gram_hash(at + k))
        return mix64(least) >> np.uint64(64 - bits)  # least hashes are small: mixed again they spread over all buckets

    def units(self, changes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions and sizes of the units that begin at changes, long ones cut after SPAN windows, and which change each is of."""
        ends = np.minimum(np.r_[changes[1:], self.size], self.starts[self.text_of(changes) + 1] - WINDOW + 1) if len(changes) else changes
        parts = -(-(ends - changes) // SPAN)
        of = np.repeat(np.arange(len(changes)), parts)
        at = changes[of] + SPAN * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
        return at, np.minimum(ends[of] - at, SPAN) + WINDOW - 1, of

    def windows(self) -> np.ndarray:
        """Whether a window starts at each position."""
        ok = np.ones(self.size, dtype=bool)
        n = np.minimum(np.diff(self.starts), WINDOW - 1)
        ok[np.repeat(self.starts[1:] - np.cumsum(n), n) + np.arange(int(n.sum()))] = False
        return ok

    def least_hashes(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of windows at which the least hash of the window's grams or the text changes, and that hash."""
        ok = self.windows()
        at, codes = [], []
        for a in range(0, self.size, BLOCK):
            b = min(self.size, a + BLOCK)
            m = b - a + SPAN - 1
            w = self._words[a : a + m + GRAM - 8].astype(np.uint64)
            h = mix64(w[:m] * _MIX[0] + w[8 : m + 8] * _MIX[1] + w[16 : m + 16] * _MIX[2] + w[18 : m + 18] * _MIX[3])
            for step in (1, 2, 4, 8):
                h = np.minimum(h[:-step], h[step:])
            h = np.minimum(h[: b - a], h[SPAN - 16 : SPAN - 16 + b - a])
            here = np.flatnonzero(ok[a:b])
            new = np.r_[True, h[here[1:]] != h[here[:-1]]] if len(here) else np.zeros(0, bool)
            begins = np.zeros(b - a, dtype=bool)
            begins[self.starts[np.searchsorted(self.starts, a) : np.searchsorted(self.starts, b)] - a] = True
            new |= begins[here]
            at.append(here[new] + a)
            codes.append(mix64(h[here[new]]) >> np.uint64(64 - bits))
        return np.concatenate(at or [np.zeros(0, np.int64)]), np.concatenate(codes or [np.zeros(0, np.uint64)])

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


def _differences(sorted_values: np.ndarray) -> bytes:
    d = np.diff(sorted_values, prepend=np.zeros(1, sorted_values.dtype))
    narrow = not len(d) or int(d.max()) < 1 << 32
    return (b"n" if narrow else b"w") + squeeze(d.astype(np.uint32 if narrow else np.uint64))


def _whole(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data[1:], np.uint32 if data[:1] == b"n" else np.uint64).astype(np.uint64), dtype=np.uint64)


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """A row at a time as Python objects."""
    for i in range(batch.num_rows):
        yield tuple(batch.column(n)[i].as_py() for n in names)


HASHES = "run string, bucket int, n int, hashes binary, several binary"
HASH_FIELDS = pa.schema([("run", pa.string()), ("bucket", pa.int32()), ("n", pa.int32()), ("hashes", pa.binary()), ("several", pa.binary())])


def ordered(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of codes below 2 ** bits, equal ones as they came, and the sorted codes. Where both fit in a word it is sorted
    with the place in it, which takes half the time."""
    low = max(1, (len(codes) - 1).bit_length())
    if bits + low > 64:
        order = np.argsort(codes, kind="stable")
        return order, codes[order]
    both = codes << np.uint64(low)
    both |= np.arange(len(codes), dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << low) - 1)).astype(np.int64), both >> np.uint64(low)


def _hash_rows(run: str, codes: np.ndarray, of: np.ndarray, bits: int, bucket_bits: int) -> Iterator[pa.RecordBatch]:
    """The distinct codes of a run by bucket, and which of them more than one text has."""
    order, codes = ordered(codes, bits)
    of = of[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    if not len(first):
        return
    several = np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first)
    codes = codes[first]
    low = np.uint64(bits - bucket_bits)
    bucket = (codes >> low).astype(np.int64)
    cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(codes)]
    codes &= np.uint64((1 << int(low)) - 1)
    row = lambda a, b: (run, int(bucket[a]), b - a, _differences(codes[a:b]), np.packbits(several[a:b]).tobytes())
    yield _batch([row(a, b) for a, b in itertools.pairwise(cuts.tolist())], HASH_FIELDS)


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)


def _send_hashes(batches: Iterator[pa.RecordBatch], bits: int, bucket_bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run, data, sizes, gone in _rows(batch, "run", "data", "sizes", "gone"):
            texts = Texts(data, sizes, gone)
            at, codes = texts.least_hashes(bits)
            yield from _hash_rows(run, codes, texts.text_of(at), bits, bucket_bits)


def marked(codes: np.ndarray, answers: list[dict] | None, bits: int) -> np.ndarray:
    """Whether each code came back as one that several texts have."""
    told = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]) for a in sorted(answers or [], key=lambda a: a["bucket"])]
    twice, out = np.concatenate([np.zeros(0, np.uint8), *told]).astype(bool), np.zeros(len(codes), dtype=bool)
    if len(twice):
        order, codes = ordered(codes, bits)
        out[order] = twice[np.cumsum(np.r_[False, codes[1:] != codes[:-1]])]
    return out


def _answer(rows: pa.Table) -> pa.Table:
    """Which hashes of each run more than one text has."""
    runs, ns, buckets = (rows.column(c).to_pylist() for c in ("run", "n", "bucket"))
    values = np.concatenate([_whole(x) for x in rows.column("hashes").to_pylist()])
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(rows.column("several").to_pylist(), ns, strict=True)]).astype(bool)
    order, values = ordered(values, int(values.max()).bit_length())
    same = values[1:] == values[:-1]
    twice[order] |= np.r_[False, same] | np.r_[same, False]
    cuts = np.r_[0, np.cumsum(ns)]
    bits = [twice[a:b] for a, b in itertools.pairwise(cuts)]
    return pa.table({"run": runs, "bucket": pa.array(buckets, pa.int32()), "n": pa.array(ns, pa.int32()), "n_twice": pa.array([int(b.sum()) for b in bits], pa.int64()), "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})


def sort_strings(texts: Texts, at: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings at those positions, and the number of symbols each then shares with the one before (0 for the
    first). Each symbol is read for strings that tie so far."""
    take = lambda i, k: texts.word(at[i], k, None if sizes is None else sizes[i])
    word = take(slice(None), 0)
    order = np.argsort(word, kind="stable")
    word = word[order]
    shared = np.zeros(len(at), dtype=np.uint8)
    shared[1:] = word[1:] == word[:-1]
    for k in range(1, WORDS if sizes is None else UNIT_WORDS):
        tie = shared == k  # shares all k symbols so far with the one before
        inside = np.flatnonzero(tie | np.r_[tie[1:], False])
        if not len(inside):
            break
        group = np.cumsum(~tie[inside])
        word = take(order[inside], k)
        again = np.lexsort((word, group))
        order[inside], word = order[inside][again], word[again]
        more = np.r_[False, word[1:] == word[:-1]] & tie[inside]
        shared[inside[more]] = k + 1
    return order, shared


PIECES = "range int, run string, n int, shared binary, symbols binary, ids binary, docs binary, own binary"
PIECE_FIELDS = pa.schema([("range", pa.int32()), ("run", pa.string()), ("n", pa.int32())] + [(c, pa.binary()) for c in ("shared", "symbols", "ids", "docs", "own")])


def front_coded(texts: Texts, at: np.ndarray, sizes: np.ndarray | None, shared: np.ndarray) -> tuple[bytes, bytes]:
    """The shared symbols of sorted strings, none for the first, and all symbols behind these."""
    shared = shared.copy()
    shared[:1] = 0
    n = WORDS if sizes is None else UNIT_WORDS
    symbols = np.stack([texts.word(at, k, sizes) for k in range(n)], axis=1)
    return squeeze(shared), squeeze(symbols[np.arange(n) >= shared[:, None]].astype(">u8"), LEVEL)


def decoded(shared: np.ndarray, symbols: np.ndarray, n: int) -> np.ndarray:
    """(strings, n) from front-coded symbols."""
    has = np.arange(n) >= shared[:, None]
    full = np.zeros(has.shape, dtype=np.uint64)
    full[has] = symbols
    for k in range(n):
        full[:, k] = full[np.maximum.accumulate(np.where(has[:, k], np.arange(len(full)), 0)), k]
    return full


class Entries:
    """A run's strings, sorted: each distinct one (heads, sizes, shared: symbols shared with the one before) with its smallest document
    (docs) and its places there (``times`` of each in ``places``, of ``place_sizes``); covered: places in larger documents."""

    def __init__(self, texts: Texts, firsts: np.ndarray, at: np.ndarray, sizes: np.ndarray | None = None) -> None:
        order, shared = sort_strings(texts, at, sizes)
        all_sizes = np.full(len(at), WINDOW) if sizes is None else sizes
        at, all_sizes = at[order], all_sizes[order]
        docs = firsts[texts.text_of(at)]
        start = np.flatnonzero(shared < (WORDS if sizes is None else UNIT_WORDS))
        ends = np.r_[start, len(at)]
        self.docs = np.minimum.reduceat(docs, start) if len(start) else docs
        own = docs == np.repeat(self.docs, np.diff(ends))
        self.covered, self.covered_sizes = at[~own], all_sizes[~own]
        self.places, self.place_sizes, self.shared = at[own], all_sizes[own], shared[start]
        self.times = np.diff(np.r_[0, np.cumsum(own)][ends])
        self.heads = self.places[np.r_[0, np.cumsum(self.times)][: len(start)]]
        self.sizes = None if sizes is None else all_sizes[start]

    def pieces(self, texts: Texts, run: str, bounds: list[bytes]) -> Iterator[pa.RecordBatch]:
        size = lambda i: WINDOW if self.sizes is None else self.sizes[i]
        cuts = [0, *(bisect_left(range(len(self.heads)), s, key=lambda i: texts.raw[self.heads[i] : self.heads[i] + size(i)]) for s in bounds), len(self.heads)]
        rows = []
        for r, (a, b) in enumerate(itertools.pairwise(cuts)):
            if a < b:
                first, symbols = front_coded(texts, self.heads[a:b], None if self.sizes is None else self.sizes[a:b], self.shared[a:b])
                ids, docs = np.unique(self.docs[a:b], return_inverse=True)
                rows.append((r, run, b - a, first, symbols, squeeze(ids), squeeze(docs.astype(np.uint32)), None))
        if rows:
            yield _batch(rows, PIECE_FIELDS)

    def lost(self, told: list[dict] | None) -> np.ndarray:
        """Whether a smaller document of another run has each entry."""
        bits = [np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]) for x in sorted(told or [], key=lambda x: x["range"])]
        return np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)


def _starts(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The windows of strings at those positions."""
    n = sizes - WINDOW + 1
    return np.repeat(at - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _own_row(run: str, own: bytes, splitters) -> pa.RecordBatch:
    """What a run needs again after the merge goes round with the row of a range."""
    return pa.RecordBatch.from_pylist([{"range": int.from_bytes(run[:8].encode()) % (len(splitters.value) + 1), "run": run, "n": 0, "own": own}], PIECE_FIELDS)


class Units:
    """A run's units after their merge."""

    def __init__(self, texts: Texts, firsts: np.ndarray, own: bytes, told: list[dict] | None) -> None:
        at, sizes = np.split(unsqueeze(own, np.uint32).astype(np.int64), 2)
        self.entries = Entries(texts, firsts, np.cumsum(at), sizes)
        self.lost = self.entries.lost(told)

    def windows(self, lost: bool) -> np.ndarray:
        """The windows of units that are lost, or those of units that are left but for places in larger documents."""
        e = self.entries
        places = np.repeat(self.lost == lost, e.times)
        return np.sort(_starts(e.places[places], e.place_sizes[places]))

    def removed_windows(self) -> np.ndarray:
        return np.r_[_starts(self.entries.covered, self.entries.covered_sizes), self.windows(True)]


def _firsts(firsts: list[int], gone: list[int] | None) -> np.ndarray:
    return np.delete(np.array(firsts, dtype=np.int64), gone or [])


def _sort_units(batches: Iterator[pa.RecordBatch], bits: int, splitters) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run, data, sizes, firsts, answers, gone in _rows(batch, "run", "data", "sizes", "firsts", "answers", "gone"):
            texts = Texts(data, sizes, gone)
            changes, codes = texts.least_hashes(bits)
            at, lengths, of = texts.units(changes)
            wanted = marked(codes, answers, bits)[of]
            at, lengths = at[wanted], lengths[wanted]
            if len(at):
                yield _own_row(run, squeeze(np.r_[np.diff(at, prepend=0), lengths].astype(np.uint32)), splitters)
                yield from Entries(texts, _firsts(firsts, gone), at, lengths).pieces(texts, run, splitters.value)


def _send_windows(batches: Iterator[pa.RecordBatch], bits: int, bucket_bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run, data, sizes, firsts, own, units, gone in _rows(batch, "run", "data", "sizes", "firsts", "own", "units", "gone"):
            texts = Texts(data, sizes, gone)
            at = Units(texts, _firsts(firsts, gone), own, units).windows(False)
            yield from _hash_rows(run, texts.window_hash(at, bits), texts.text_of(at), bits, bucket_bits)


def _sort_windows(batches: Iterator[pa.RecordBatch], bits: int, splitters) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run, data, sizes, firsts, own, units, answers, gone in _rows(batch, "run", "data", "sizes", "firsts", "own", "units", "answers", "gone"):
            texts, firsts = Texts(data, sizes, gone), _firsts(firsts, gone)
            at = Units(texts, firsts, own, units).windows(False)
            at = at[marked(texts.window_hash(at, bits), answers, bits)]
            if len(at):
                yield _own_row(run, squeeze(np.diff(at, prepend=0).astype(np.uint32)), splitters)
                yield from Entries(texts, firsts, at).pieces(texts, run, splitters.value)


class Lanes:
    """Loser trees over sorted runs, one a lane, played in step.

    ``at`` and ``end`` hold each run's next and last entry in each lane; a node holds the run that lost there and the symbols
    it shares with the winner that beat it."""

    def __init__(self, words: np.ndarray, rows: np.ndarray, shared: np.ndarray, bounds: np.ndarray) -> None:
        """bounds: (lanes + 1, runs) places in rows, falling by lane size."""
        lanes, runs = bounds[0].shape
        self.words, self.symbols, self.rows, self.shared = words.ravel(), words.shape[1], rows, shared
        self.width = 1 << (runs - 1).bit_length()
        self.at, self.end = (np.zeros((lanes, self.width), dtype=np.int64) for _ in range(2))
        self.at[:, :runs], self.end[:, :runs] = bounds
        self.at, self.end = self.at.ravel(), self.end.ravel()
        self.loser = np.zeros(lanes * self.width, dtype=np.int64)
        self.prefix = np.zeros(lanes * self.width, dtype=np.int64)
        base = np.arange(lanes)[:, None] * self.width
        who = base + np.arange(self.width)
        prefix = np.zeros(who.shape, dtype=np.int64)
        while who.shape[1] > 1:
            half = who.shape[1] // 2
            a, b, ha, hb = who[:, ::2].ravel(), who[:, 1::2].ravel(), prefix[:, ::2].ravel(), prefix[:, 1::2].ravel()
            wins, left = self.play(a, ha, b, hb)
            node = (base + half + np.arange(half)).ravel()
            self.loser[node], self.prefix[node] = np.where(wins, b, a), left
            who, prefix = np.where(wins, a, b).reshape(-1, half), np.where(wins, ha, hb).reshape(-1, half)
        self.winner, self.known = who.ravel(), prefix.ravel()

    def play(self, a: np.ndarray, ha: np.ndarray, b: np.ndarray, hb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a wins against b, and what the loser shares with the winner. ha, hb: symbols known to be shared with
        the last that left the tree."""
        ia, ib = self.at[a], self.at[b]
        over_a, over_b = ia >= self.end[a], ib >= self.end[b]
        wins = ((ha >= hb) & ~over_a) | over_b  # of two equal strings a wins
        left = np.minimum(ha, hb)
        same = np.flatnonzero((ha == hb) & (ha < self.symbols) & ~over_a & ~over_b)
        k = ha[same]
        ra, rb = self.rows[ia[same]] * self.symbols, self.rows[ib[same]] * self.symbols
        while len(same):
            x, y = self.words[ra + k], self.words[rb + k]
            differ = x != y
            wins[same], left[same] = x < y, k
            k = k + 1
            done = differ | (k == self.symbols)
            if done.any():
                equal = same[done & ~differ]
                wins[equal], left[equal] = True, self.symbols
                go = ~done
                same, k, ra, rb = same[go], k[go], ra[go], rb[go]
        return wins, left

    def step(self, lanes: int) -> tuple[np.ndarray, np.ndarray]:
        """Takes the least entry out of each of the first lanes: its place in rows, and the symbols it shares with the
        one before."""
        who, known = self.winner[:lanes], self.known[:lanes]
        out = self.at[who]
        self.at[who] += 1
        alive = out + 1 < self.end[who]
        prefix = np.where(alive, self.shared[np.where(alive, out + 1, 0)], 0).astype(np.int64)
        base = np.arange(lanes) * self.width
        node = (who - base + self.width) >> 1
        for _ in range(self.width.bit_length() - 1):
            place = base + node
            other, theirs = self.loser[place], self.prefix[place]
            wins, left = self.play(who, prefix, other, theirs)
            self.loser[place], self.prefix[place] = np.where(wins, other, who), left
            who, prefix = np.where(wins, who, other), np.where(wins, prefix, theirs)
            node >>= 1
        known = known.copy()
        self.winner[:lanes], self.known[:lanes] = who, prefix
        return out, known


def merge(words: np.ndarray, runs: list[tuple[np.ndarray, np.ndarray]], fan: int = FAN, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Runs (rows of words in order, symbols shared with the row before) as one such run."""
    while len(runs) > fan:  # in passes of about as many levels of full trees, as small ones stay in the caches
        levels = (len(runs) - 1).bit_length()
        passes = -(-levels // (fan.bit_length() - 1))
        runs = [merge(words, list(part), fan, lane) for part in itertools.batched(runs, 1 << -(-levels // passes))]
    if len(runs) == 1:
        return runs[0]
    rows, shared = (np.concatenate([r[i] for r in runs]) for i in range(2))
    starts = np.r_[0, np.cumsum([len(r) for r, _ in runs])]
    keys = words[rows].astype(">u8").view(f"S{8 * words.shape[1]}").ravel()
    lanes = max(1, len(rows) // max(lane, 2 * len(runs)))
    sample = np.sort(keys[:: max(1, len(keys) // (16 * lanes))])
    splits = np.unique(sample[np.linspace(0, len(sample), lanes, endpoint=False).astype(int)[1:]])
    cuts = np.stack([np.r_[a, a + np.searchsorted(keys[a:b], splits), b] for a, b in itertools.pairwise(starts.tolist())], axis=1)
    del keys
    sizes = np.diff(cuts, axis=0).sum(axis=1)
    order = np.argsort(-sizes, kind="stable")
    at = np.r_[0, np.cumsum(sizes)][:-1][order]
    trees = Lanes(words, rows, shared, np.stack([cuts[:-1][order], cuts[1:][order]]))
    found, known = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.uint8)
    falling = -sizes[order]
    for n in range(int(sizes.max())):
        active = int(np.searchsorted(falling, -n, side="left"))
        out, prefix = trees.step(active)
        found[at[:active] + n], known[at[:active] + n] = rows[out], prefix
    first = at[(at > 0) & (sizes[order] > 0)]  # where a lane begins nothing was compared with the one before
    known[first] = np.cumprod(words[found[first]] == words[found[first - 1]], axis=1).sum(axis=1)
    return found, known


LOST = "range int, run string, n int, bits binary, own binary"


def _merge_range(pieces: pa.Table, n: int) -> pa.Table:
    """Which entries of each run a smaller document of another has; rows without entries pass."""
    kept = pieces.select(["range", "run", "n", "own"])
    there = np.flatnonzero(pieces.column("n").to_numpy())
    bits: list[bytes | None] = [None] * len(pieces)
    if len(there):
        part = lambda c, kind: [unsqueeze(pieces.column(c)[i].as_py(), kind) for i in there]
        shared = part("shared", np.uint8)
        words = decoded(np.concatenate(shared), np.concatenate(part("symbols", ">u8")).astype(np.uint64), n)
        docs = np.concatenate([ids[of] for ids, of in zip(part("ids", np.int64), part("docs", np.uint32), strict=True)])
        cuts = np.r_[0, np.cumsum([len(x) for x in shared])]
        rows, known = merge(words, [(np.arange(a, b), s) for a, b, s in zip(cuts[:-1], cuts[1:], shared, strict=True)])
        start = np.flatnonzero(known < n)
        least = np.minimum.reduceat(docs[rows], start)
        lost = np.zeros(len(docs), dtype=bool)
        lost[rows] = docs[rows] > np.repeat(least, np.diff(np.r_[start, len(rows)]))
        for i, a, b in zip(there.tolist(), cuts[:-1], cuts[1:], strict=True):
            bits[i] = np.packbits(lost[a:b]).tobytes()
    return pa.table({"range": kept["range"], "run": kept["run"], "n": kept["n"], "bits": pa.array(bits, pa.binary()), "own": kept["own"]})


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _remove(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, sizes, firsts, ids, of, own, units, places, windows, gone in _rows(batch, "data", "sizes", "firsts", "ids", "texts", "own", "units", "places", "windows", "gone"):
            texts, left = Texts(data, sizes, gone), _firsts(firsts, gone)
            removed = np.zeros(texts.size, dtype=bool)
            if own:  # sorted again, which is less than to send the places round
                removed[Units(texts, left, own, units).removed_windows()] = True
            if places:
                e = Entries(texts, left, np.cumsum(unsqueeze(places, np.uint32), dtype=np.int64))
                removed[e.covered] = True
                removed[e.places[np.repeat(e.lost(windows), e.times)]] = True
                del e
            for n in (1, 2, 4, 8, 16, 18):  # windows that begin at most 1, 3, 7, 15, 31, 49 bytes before
                removed[n:] |= removed[:-n].copy()
            said = hashlib.sha256 if digest else bytes
            told = []
            for a, b in itertools.pairwise(texts.starts.tolist()):
                cut, text = removed[a:b], texts.raw[a:b]
                spans = int(np.count_nonzero(cut[1:] > cut[:-1])) + int(b > a and cut[0])
                kept = np.frombuffer(text, np.uint8)[~cut].tobytes() if spans else text
                told.append((b - a, int(np.count_nonzero(cut)), spans, said(kept)))
            whole = [(n, n, 1, said(b"")) if n >= WINDOW else None for n in sizes]
            if gone:
                each, skip = iter(told), set(gone)
                told = [whole[t] if t in skip else next(each) for t in range(len(sizes))]
            whole = [w or x for w, x in zip(whole, told, strict=True)]
            rows = [(i, *(told if (NO_ID if i is None else i) == firsts[t] else whole)[t]) for i, t in zip(ids, of, strict=True)]
            for part in itertools.batched(rows, 1_000):
                columns = [list(c) for c in zip(*part, strict=True)]
                columns[4] = [c.digest() if digest else c for c in columns[4]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 4 else pa.int64()) for k, c in enumerate(columns)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _bucketed(runs: DataFrame) -> DataFrame:
    """runs written in buckets by run, in the shared folder, so that joins by run don't shuffle them."""
    spark = runs.sparkSession
    name = f"caselake_runs_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs.write.format("parquet").bucketBy(buckets, "run").option("path", shared_path(spark, "suffix-runs")).saveAsTable(name)
    return spark.table(name)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, run_bytes: int = RUN_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: each row with the bytes that are left, or with digest their SHA-256."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    runs = _bucketed(rows.mapInArrow(lambda it: _pack(it, run_bytes), RUNS))
    total, n_runs = runs.agg(F.sum("n_bytes"), F.count("*")).first()
    bits, bucket_bits = _widths((total or 0) * 2 // (SPAN + 1))

    slots = runs.select("run", F.posexplode(F.arrays_zip("hashes", "firsts", "sizes")).alias("slot", "x")).where(f"x.sizes >= {WINDOW}").select("run", "slot", "x.hashes", "x.firsts")
    least = slots.groupBy("hashes").agg(F.min("firsts").alias("least"), F.max("firsts").alias("most")).where("least < most").select("hashes", "least")
    gone = slots.join(least, "hashes").where("least < firsts").groupBy("run").agg(F.collect_list("slot").alias("gone"))
    gone = table(gone, "suffix-gone")

    texts = _with(runs.select("run", "data", "sizes", "firsts"), gone)
    answers = _asked(texts.drop("firsts").mapInArrow(lambda it: _send_hashes(it, bits, bucket_bits), HASHES), "suffix-answers")
    n_twice = answers.agg(F.sum("n_twice")).first()[0] or 0
    sample = runs.select(F.explode("sample").alias("x"))
    if n_runs * SAMPLE > MOST_SAMPLES:
        sample = sample.where(F.rand(7) < MOST_SAMPLES / (n_runs * SAMPLE))
    drawn = sorted(sample.toArrow()["x"].to_pylist())

    cuts = _splitters(spark, drawn, n_twice)
    units = table(_with(texts, _by_run(answers)).mapInArrow(lambda it: _sort_units(it, bits, cuts), PIECES).groupBy("range").applyInArrow(lambda rows: _merge_range(rows, UNIT_WORDS), LOST), "suffix-units")
    of_units = _told(units, "units", "own")
    with_units = texts.join(of_units.hint("merge"), "run")

    whole_bits, whole_buckets = _widths(n_twice * (SPAN + 1) // 2)
    again = _asked(with_units.mapInArrow(lambda it: _send_windows(it, whole_bits, whole_buckets), HASHES), "suffix-answers-windows")
    finer = _splitters(spark, drawn, again.agg(F.sum("n_twice")).first()[0] or 0)
    windows = table(_with(with_units, _by_run(again)).mapInArrow(lambda it: _sort_windows(it, whole_bits, finer), PIECES).groupBy("range").applyInArrow(lambda rows: _merge_range(rows, WORDS), LOST), "suffix-windows")

    last = _with(runs.select("run", "data", "sizes", "firsts", "ids", "texts"), gone, of_units, _told(windows, "windows", "places"))
    result = table(last.mapInArrow(lambda it: _remove(it, digest), RESULT), "suffix-result")
    for used in (runs, answers, again, units, windows, gone):
        drop_table(used)
    return result


def _widths(hashes: int) -> tuple[int, int]:
    """Bits of so many hashes, and those of them that name a bucket."""
    buckets = max(5, math.ceil(math.log2(max(2, hashes) / BUCKET_HASHES)))
    return min(64, max(buckets + 16, math.ceil(math.log2(max(2, hashes))) + SPARE_BITS)), buckets


def _told(merged: DataFrame, bits: str, own: str) -> DataFrame:
    """run, bits: what the ranges tell of its entries, own: what it sent for itself."""
    return merged.groupBy("run").agg(F.collect_list(F.when(F.col("n") > 0, F.struct("range", "n", "bits"))).alias(bits), F.max("own").alias(own))


def _asked(sent: DataFrame, name: str) -> DataFrame:
    return table(sent.groupBy("bucket").applyInArrow(_answer, "run string, bucket int, n int, n_twice long, bits binary"), name)


def _by_run(answers: DataFrame) -> DataFrame:
    """run, answers: of runs of which some hash came back."""
    some = answers.where("n_twice > 0").select("run").distinct()
    return answers.join(some, "run", "left_semi").groupBy("run").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias("answers"))


def _with(runs: DataFrame, *found: DataFrame) -> DataFrame:
    for df in found:
        runs = runs.join(df.hint("merge"), "run", "left")
    return runs


def _splitters(spark: SparkSession, drawn: list[bytes], entries: int):
    """Bounds of ranges of about RANGE_ENTRIES, as a broadcast variable: quantiles of the drawn windows."""
    ranges = min(MOST_RANGES, max(RANGES, entries // RANGE_ENTRIES))
    return spark.sparkContext.broadcast(sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else [])


def op13_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))
