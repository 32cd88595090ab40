"""Source divergence by single-pass indexing against a brute force over all kept terms."""

import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from caselake.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, shard int, value long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, *r, 1, "t", 2, 3) for i, r in enumerate(rows)], SCHEMA)


def brute(rows, least):
    upper = {chr(c): chr(c + 32) for c in range(65, 91)}
    df, counts, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in ((t or "", lang or "", s or "") for t, lang, s in rows):
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(upper.get(c, c) for c in text))
        df.update({(lang, w) for w in words})
        counts[lang, source].update(words)
        groups.add((lang, source))
    kept = defaultdict(list)
    for (lang, w), n in df.items():
        if n >= least:
            kept[lang].append(w)

    def shares(n_of, lang):
        total = sum(n_of[w] for w in kept[lang])
        return {w: 1 + 10**9 * (n_of[w] + 5) // (total + 5 * len(kept[lang])) for w in kept[lang]}

    out = []
    for lang, source in groups:
        own, whole = shares(counts[lang, source], lang), shares(sum((counts[g] for g in groups if g[0] == lang), Counter()), lang)
        pairs = [(s, sum(abs(own[w] - x) for w, x in shares(counts[lang, s], lang).items())) for la, s in groups if la == lang and s != source]
        told = [(w, own[w] - whole[w]) for w in kept[lang] if counts[lang, source][w] and own[w] > whole[w]]
        for part, found, most in (("pair", pairs, None), ("term", told, 50)):
            for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


ROWS = [("The cat-THE dog's é2É", "en", "a"), ("the\0cat ÀB ab", "en", "b"), (None, "en", "c"), ("", None, None), ("12 34", "de", "x"), ("the the the dog", "en", "a"), ("the the the dog", "en", "a"), ("日本the cat \U0001f600dog", "en", None), ("cat dog", None, "a"), ("x" * 300 + " the " * 200, "en", "b"), ("der dog", "de", "y"), ("der DER", "de", "x")]


def test_divergence(spark):
    for least in (1, 2, 4):
        got = divergence.divergence(docs_of(spark, ROWS), min_docs=least)
        assert found(got) == brute(ROWS, least)
    assert {"cat", "the", "dog"} <= {r[3] for r in brute(ROWS, 2)}


def test_blocks_and_groups_of_runs(spark):
    """Small blocks spill many runs, which are merged in groups first."""
    rng = np.random.default_rng(3)
    rows = [(" ".join(f"w{chr(97 + int(w))}" for w in rng.zipf(1.6, 40) % 26), str(rng.choice(["en", "de"])), f"s{min(int(rng.zipf(1.7)), 6)}") for _ in range(120)]
    docs = docs_of(spark, rows).repartition(5)
    got = divergence.divergence(docs, min_docs=3, block=30, fan=4)
    assert found(got) == brute(rows, 3) == found(divergence.divergence(docs, min_docs=3))


def test_corrections_are_written_as_they_fill(spark, monkeypatch):
    monkeypatch.setattr(divergence, "ROOM", 5)
    sources = [f"s{i}" for i in range(4)]
    c = divergence.Corrections({"en": (sources, np.array([40, 50, 60, 70]))})
    posts = [(["s0", "s2"], [3, 1]), (["s1"], [2]), (["s0", "s1", "s3"], [1, 9, 4])]
    parts = [b for b in c.add("en", posts)]
    assert parts and sum(len(v) for v in c.rows.values()) <= 8
    total = Counter()
    for b in [*parts, *c.flush()]:
        for _, s, i, m in zip(*[b.column(k).to_pylist() for k in ("lang", "source", "item", "more")], strict=True):
            total[frozenset((s, i))] += m
    p = lambda n, below: 1 + 10**9 * (n + 5) // below
    for a in range(4):
        for b in range(a):
            far = 0
            for ss, nn in posts:
                n = dict(zip(ss, nn, strict=True))
                pa, pb = (p(n.get(f"s{x}", 0), 40 + 10 * x) for x in (a, b))
                far += abs(pa - pb) - abs(p(0, 40 + 10 * a) - p(0, 40 + 10 * b))
            assert total[frozenset((f"s{a}", f"s{b}"))] == far


def test_long_texts_in_pieces(monkeypatch):
    text = ("Wörd other, " * 50).encode()
    whole = [w for p in divergence.pieces(text) for w in p]
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert [w for p in divergence.pieces(text) for w in p] == whole and len(whole) == 100


def test_empty(spark):
    docs = docs_of(spark, ROWS)
    assert divergence.divergence(docs.where("false")).count() == 0
    assert found(divergence.divergence(docs, min_docs=99)) == brute(ROWS, 99)
