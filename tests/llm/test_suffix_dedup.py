"""Removal of repeated bytes against a brute force over all windows, and the merge's parts on their own."""

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import SF

from caselake.llm import queries, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, run string, range int, data string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, x, "en", "s", 0, "r", 1, "d") for i, x in rows], SCHEMA)


def brute(rows):
    rows = [(i, (x or "").encode()) for i, x in rows]
    known = lambda i: suffix_dedup.NO_ID if i is None else i
    least = {}
    for i, x in rows:
        for p in range(len(x) - 49):
            least[x[p : p + 50]] = min(least.get(x[p : p + 50], known(i)), known(i))
    out = []
    for i, x in rows:
        cut = bytearray(len(x))
        for p in range(len(x) - 49):
            if least[x[p : p + 50]] < known(i):
                cut[p : p + 50] = b"\1" * 50
        kept = bytes(b for b, c in zip(x, cut, strict=True) if not c)
        out.append((i, len(x), sum(cut), sum(c and not (j and cut[j - 1]) for j, c in enumerate(cut)), kept))
    return sorted(out, key=str)


def held(spark, rows, **how):
    got = suffix_dedup.remove_repeats(docs_of(spark, rows).repartition(4), **how)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    want = brute(rows)
    assert sorted(((*r[:4], bytes(r[4])) for r in got.collect()), key=str) == want
    return want


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, n, r, s, hashlib.sha256(k).hexdigest()) for i, n, r, s, k in brute(rows))
    assert sorted(map(tuple, queries.QUERIES["op13_suffix_dedup"](spark, SF).collect())) == want
    assert sum(r[2] for r in want) > 10_000
    got = suffix_dedup.remove_repeats(spark.read.parquet(f"{SF}/documents.parquet").repartition(5), digest=True, run_bytes=20_000)
    assert sorted((*r[:4], bytes(r[4]).hex()) for r in got.collect()) == want


LONG = "".join(random.Random(1).choices("abcdef ", k=900))
ODD = [
    (1, LONG), (2, LONG), (2, LONG), (None, LONG), (None, LONG + "tail"), (3, "x" + LONG[100:400] + "y" + LONG[380:]), (4, LONG[:49]), (5, LONG[:50]), (5, LONG[:51]), (0, LONG[850:]), (6, None), (7, ""), (7, None), (None, None),
    (8, "a" * 400), (9, "a" * 120 + "b"), (10, "é" * 40 + "\0" * 70), (11, "\0" * 60 + "é" * 30), (12, "\0" * 49 + "\1"), (13, "日本語\U0001f600" * 30), (14, "本語\U0001f600日" * 30), (2**63 - 1, LONG[200:300]), (-5, LONG[300:360]),
]


@pytest.mark.parametrize("run_bytes", [1, 2000, 1 << 20])
def test_odd_rows(spark, run_bytes):
    want = held(spark, ODD, run_bytes=run_bytes)
    assert any(r[3] > 1 for r in want)


def test_hot_passages(spark):
    """A third of the rows share a passage, another third are near copies of one text."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    passage, base = " ".join(word() for _ in range(60)), [word() for _ in range(150)]
    rows = []
    for i in range(90):
        own = " ".join(word() for _ in range(80))
        near = base.copy()
        near[rng.randrange(150)] = word()
        rows.append((rng.randrange(10**6), [f"{own} {passage} {own[:90]}", " ".join(near), own][i % 3]))
    want = held(spark, rows, run_bytes=3000)
    assert sum(r[2] for r in want) > 29 * len(passage)


def test_empty(spark):
    assert suffix_dedup.remove_repeats(docs_of(spark, ODD).where("false")).count() == 0
    held(spark, [(1, "short"), (2, "short")])
    held(spark, [(1, None)])


def sorted_run(keys):
    """Distinct sorted rows of symbols, and what each shares with the one before."""
    keys = sorted(set(map(tuple, keys)))
    shared = [0] + [next((k for k in range(7) if a[k] != b[k]), 7) for a, b in zip(keys, keys[1:], strict=False)]
    return np.array(keys, dtype=np.uint64).reshape(-1, 7), np.array(shared[: len(keys)], dtype=np.uint8)


@pytest.mark.parametrize(("runs", "fan", "lane"), [(1, 4, 8), (2, 4, 8), (5, 8, 10_000), (7, 8, 3), (23, 3, 5), (40, 64, 16)])
def test_merge(runs, fan, lane):
    rng = np.random.default_rng(runs)
    parts = [sorted_run(rng.integers(0, 3, (rng.integers(1, 60), 7))) for _ in range(runs)]
    words = np.concatenate([k for k, _ in parts])
    cuts = np.cumsum([0] + [len(k) for k, _ in parts])
    rows, known = suffix_dedup.merge(words, [(np.arange(a, b), s) for a, b, (_, s) in zip(cuts, cuts[1:], parts, strict=False)], fan, lane)
    got = list(map(tuple, words[rows]))
    assert sorted(rows.tolist()) == list(range(len(words))) and got == sorted(got)
    true = [0] + [next((k for k in range(7) if a[k] != b[k]), 7) for a, b in zip(got, got[1:], strict=False)]
    assert known.tolist() == true


def test_known_prefixes_are_not_read_again(monkeypatch):
    """Entries that share six symbols with the one before cost one symbol each, but for the first match of each run."""
    reads = []
    real = suffix_dedup.Lanes.play

    class Counted(np.ndarray):
        def __getitem__(self, at):
            reads.append(np.size(at))
            return np.asarray(super().__getitem__(at))

    def play(self, *a):
        self.words = self.words.view(Counted)
        return real(self, *a)

    monkeypatch.setattr(suffix_dedup.Lanes, "play", play)
    keys = np.full((200, 7), 5, dtype=np.uint64)
    keys[:, 6] = np.arange(200)
    parts = [keys[::2], keys[1::2]]
    shared = np.r_[0, np.full(99, 6)].astype(np.uint8)
    rows, _ = suffix_dedup.merge(np.concatenate(parts), [(np.arange(100), shared), (np.arange(100, 200), shared)], lane=1000)
    assert np.concatenate(parts)[rows].tolist() == keys.tolist()
    assert sum(reads) <= 2 * (200 + 7)


def test_front_coding_and_sort():
    text = ("abcdefgh" * 40 + LONG + LONG[:500]).encode()
    texts = suffix_dedup.Texts(suffix_dedup.squeeze(text), [len(text)])
    at = np.flatnonzero(texts.windows())
    order, shared = suffix_dedup.sort_strings(texts, at)
    at = at[order]
    windows = [text[p : p + 50] for p in at]
    assert windows == sorted(windows) and len(windows) == len(text) - 49
    symbols = [[w[8 * k : 8 * k + 8] for k in range(7)] for w in windows]
    assert shared.tolist() == [0] + [next((k for k in range(7) if a[k] != b[k]), 7) for a, b in zip(symbols, symbols[1:], strict=False)]
    first, rest = suffix_dedup.front_coded(texts, at, None, shared)
    words = suffix_dedup.decoded(suffix_dedup.unsqueeze(first, np.uint8), suffix_dedup.unsqueeze(rest, ">u8").astype(np.uint64), 7)
    assert [w.astype(">u8").tobytes()[:50] for w in words] == windows
    assert len(suffix_dedup.unsqueeze(rest, ">u8")) < 0.6 * 7 * len(windows)


def test_units():
    """Units cover every window once, are at most SPAN windows long, and those of a passage are equal wherever it stands."""
    rng = random.Random(9)
    passage, own = LONG[:400], ["".join(rng.choices("abcdefgh ", k=300)) for _ in range(3)]
    parts = [own[0] + passage + own[1], "zz" + passage + own[2], "q" * 300, "short"]
    texts = suffix_dedup.Texts(suffix_dedup.squeeze("".join(parts).encode()), [len(x) for x in parts])
    changes, _ = texts.least_hashes(40)
    at, sizes, _ = texts.units(changes)
    assert suffix_dedup._starts(at, sizes).tolist() == np.flatnonzero(texts.windows()).tolist() and sizes.max() <= 50 + suffix_dedup.SPAN - 1
    string = lambda a, n: texts.raw[a : a + n]
    strings = [string(a, n) for a, n in zip(at.tolist(), sizes.tolist(), strict=True)]
    assert len(strings) - len(set(strings)) >= 15
    order, shared = suffix_dedup.sort_strings(texts, at, sizes)
    assert [strings[i] for i in order] == sorted(strings)
    assert [bool(s == suffix_dedup.UNIT_WORDS) for s in shared] == [False, *(a == b for a, b in zip(sorted(strings), sorted(strings)[1:], strict=False))]
    codes = texts.codes(at, 40)
    assert (codes == texts.codes(at + sizes - 50, 40)).all()


def sorted_entries(spark, monkeypatch, rows, **how):
    """How many units and windows went to the merges."""
    made = []
    monkeypatch.setattr(suffix_dedup, "drop_table", made.append)
    held(spark, rows, **how)
    n = lambda name: sum(df.selectExpr("coalesce(sum(n), 0) AS n").first().n for df in made if any(name in f for f in df.inputFiles()))
    return n("suffix-units-"), n("suffix-windows-")


def test_only_shared_windows_are_sorted(spark, monkeypatch):
    """Texts that share 45 bytes share hashes of 26 bytes, but no window."""
    rng = random.Random(4)
    own = lambda: "".join(rng.choices("abcdefghijkl ", k=200))
    short, long = own()[:45], own()[:80]
    units, windows = sorted_entries(spark, monkeypatch, [(i, own() + short + own()) for i in range(40)], run_bytes=2000)
    assert units > 0 and windows <= 10
    units, windows = sorted_entries(spark, monkeypatch, [(i, own() + long[: 80 - i % 3] + own()) for i in range(40)], run_bytes=2000)
    assert units > 0 and windows <= 40 * 31


def test_copies_are_not_sorted(spark, monkeypatch):
    assert sorted_entries(spark, monkeypatch, [(i, LONG) for i in range(20)] + [(20, LONG[::-1])], run_bytes=1) == (0, 0)


def test_texts_without_those_gone():
    parts = [LONG[:90], LONG[90:200], "short", LONG[200:260]]
    texts = suffix_dedup.Texts(suffix_dedup.squeeze("".join(parts).encode()), [len(x) for x in parts], [1, 3])
    assert texts.raw[: texts.size].decode() == parts[0] + "short" and texts.starts.tolist() == [0, 90, 95]
    assert np.flatnonzero(texts.windows()).tolist() == list(range(41))


def test_window_hashes():
    """A change of any of the 50 bytes changes the hash, and no other byte counts."""
    base = LONG[:60].encode()
    h = lambda x: suffix_dedup.Texts(suffix_dedup.squeeze(x), [len(x)]).window_hash(np.array([0]), 48).tolist()[0]
    changed = [h(base[:i] + b"#" + base[i + 1 :]) for i in range(60)]
    assert len({h(base), *changed[:50]}) == 51 and set(changed[50:]) == {h(base)}


@pytest.mark.parametrize("bits", [30, 60])
def test_marked_codes(bits):
    rng = np.random.default_rng(bits)
    codes = rng.integers(0, 1 << bits, 3000, dtype=np.uint64)[rng.integers(0, 3000, 5000)]
    order, values = suffix_dedup.ordered(codes, bits)
    assert order.tolist() == np.argsort(codes, kind="stable").tolist() and values.tolist() == sorted(codes.tolist())
    told = set(rng.choice(codes, 700).tolist())
    known = sorted(set(codes.tolist()))
    half = len(known) // 2
    answers = [{"bucket": b, "n": len(part), "bits": np.packbits([c in told for c in part]).tobytes()} for b, part in ((1, known[half:]), (0, known[:half]))]
    assert suffix_dedup.marked(codes, answers, bits).tolist() == [c in told for c in codes.tolist()]
    assert not suffix_dedup.marked(codes, None, bits).any()


def test_lanes_are_short(monkeypatch):
    """Runs of 20,000 entries in all are merged in few steps of many lanes."""
    steps = []
    real = suffix_dedup.Lanes.step
    monkeypatch.setattr(suffix_dedup.Lanes, "step", lambda self, lanes: steps.append(lanes) or real(self, lanes))
    rng = np.random.default_rng(3)
    parts = [sorted_run(rng.integers(0, 9, (1000, 7))) for _ in range(20)]
    words = np.concatenate([k for k, _ in parts])
    cuts = np.cumsum([0] + [len(k) for k, _ in parts])
    rows, _ = suffix_dedup.merge(words, [(np.arange(a, b), s) for a, b, (_, s) in zip(cuts, cuts[1:], parts, strict=False)])
    assert list(map(tuple, words[rows])) == sorted(map(tuple, words)) and steps[0] > 200 and len(steps) < 200


def test_hashes_are_dealt_evenly():
    """The least of many hashes is small; its buckets are alike all the same."""
    text = "".join(random.Random(6).choices("abcdefghijkl ", k=60_000)).encode()
    texts = suffix_dedup.Texts(suffix_dedup.squeeze(text), [len(text)])
    at, codes = texts.least_hashes(40)
    each = np.bincount((codes >> np.uint64(35)).astype(int), minlength=32)
    assert len(codes) > 3000 and each.max() < 2 * each.mean()
    assert (codes == texts.codes(at, 40)).all()


def test_trees_are_small(monkeypatch):
    """Many runs are merged in passes of about equal fans."""
    widths = []
    real = suffix_dedup.Lanes.__init__
    monkeypatch.setattr(suffix_dedup.Lanes, "__init__", lambda self, *a: real(self, *a) or widths.append(self.width))
    rng = np.random.default_rng(5)
    parts = [sorted_run(rng.integers(0, 4, (6, 7))) for _ in range(300)]
    words = np.concatenate([k for k, _ in parts])
    cuts = np.cumsum([0] + [len(k) for k, _ in parts])
    rows, known = suffix_dedup.merge(words, [(np.arange(a, b), s) for a, b, (_, s) in zip(cuts, cuts[1:], parts, strict=False)])
    got = list(map(tuple, words[rows]))
    assert got == sorted(map(tuple, words)) and max(widths) <= 32
    assert known.tolist() == [0] + [next((k for k in range(7) if a[k] != b[k]), 7) for a, b in zip(got, got[1:], strict=False)]
