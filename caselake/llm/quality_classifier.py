"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text's terms are its words, hashed to WORD_BINS columns, its pairs of neighbouring characters (code points of any
script, as they stand), hashed to PAIR_BINS columns, and the shares of adjacent equal words, repeated words and
repeated lines. TF-IDF weights (sublinear tf) of a bounded sample of labelled texts give a latent space by randomised
SVD; the sample's unit vectors and labels are the model (SAMPLE_PER_CLASS * 2 rows of DIMS floats, 3 MB at most with
its basis, whatever the corpus), which goes to every task. A document's cosine products with all of them are computed
exactly, in blocks of documents; its K nearest vote, weighted by similarity. The score is the share of label 1.

The sample holds each distinct text once and as many texts of either label, so that copies and the common label
don't outvote the rest; where one label has fewer, its votes weigh as much more (the ratio of the two counts), as if
both had the same number. Only labels and texts of the training rows enter the model; lang, source, doc_id don't.

Defined cases: a null or empty text, or one without a known term, scores 0 (no content to vouch for) whatever the
labels, and so does one that is like no labelled text; ties among neighbours go to the earlier sample row (the lower text hash); rows that repeat an id are scored
each; with no labelled row of one class every score is that of the other class (0.5 if there is none at all); an empty
table gives no rows; of several labels of a document the lowest counts, as it does for texts with both labels; labels
other than 0 and 1 are no labels; columns other than the named ones are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, mix64, word_hashes

SAMPLE_PER_CLASS = 2000
DIMS = 64
K = 15
#: Documents, and characters beyond which no further one joins, of a block.
BLOCK, BLOCK_CHARS = 128, 250_000
THRESHOLD = 0.3
WORD_BINS, PAIR_BINS = 2048, 4096
#: Columns for adjacent equal words, repeated words and repeated lines: a term in n columns weighs sqrt(n) times as much.
EXTRA = (32, 4, 4)
TERMS = WORD_BINS + PAIR_BINS + sum(EXTRA)
_PAIR = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def term_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of TERMS terms in each of a block of whole texts."""
    texts = [x or "" for x in texts]
    n, bins = len(texts), np.uint64(64 - (PAIR_BINS.bit_length() - 1))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(n), [len(x) for x in texts])
    whole = of[1:] == of[:-1]  # pairs don't reach across texts
    pair = mix64(points[:-1][whole] * _PAIR[0] + points[1:][whole] * _PAIR[1]) >> bins
    pairs = np.bincount(of[1:][whole] * PAIR_BINS + pair.astype(np.int64), minlength=n * PAIR_BINS).reshape(n, PAIR_BINS)
    out = np.zeros((n, TERMS), dtype=np.float32)
    out[:, WORD_BINS : WORD_BINS + PAIR_BINS] = pairs
    for i, x in enumerate(texts):
        data = x.encode("utf-8", "surrogatepass")
        words = data.split()
        if not words:
            continue
        h = word_hashes(words)
        out[i, :WORD_BINS] = np.bincount((h % np.uint64(WORD_BINS)).astype(np.int64), minlength=WORD_BINS)
        lines = [line for line in data.split(b"\n") if line.strip()]
        # Shares, so that a long clean text doesn't look like a repetitive one.
        shares = 1000 * int((h[1:] == h[:-1]).sum()) / len(h), 100 * (1 - len(np.unique(h)) / len(h)), 100 * (1 - len(set(lines)) / max(1, len(lines)))
        out[i, WORD_BINS + PAIR_BINS :] = np.repeat(shares, EXTRA)
    return out


def blocks(texts: pa.Array) -> Iterator[list[str | None]]:
    """texts in order, cut so that a block is bounded unless one text alone is beyond the bound; only a block's texts are
    Python objects at a time."""
    held, chars = [], 0
    for at in range(0, len(texts), BLOCK):
        for x in texts.slice(at, BLOCK).to_pylist():
            if held and (len(held) == BLOCK or chars + len(x or "") > BLOCK_CHARS):
                yield held
                held, chars = [], 0
            held.append(x)
            chars += len(x or "")
    if held:
        yield held


def _weights(counts: np.ndarray, idf: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Unit TF-IDF rows, in one copy of counts or in out."""
    x = np.log1p(counts, out=out)
    x *= idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=x, where=norm > 0)


class Model:
    """idf (TERMS), basis (TERMS, DIMS), vectors (rows, DIMS) of unit length, labels (rows)."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray) -> None:
        """counts is written over by its weights, so that the driver holds the sample once."""
        n = len(labels)
        self.labels = labels.astype(np.float32)
        self.idf = np.log((1 + n) / (1 + np.count_nonzero(counts, axis=0))).astype(np.float32) + np.float32(0.1)
        x = _weights(counts, self.idf, out=counts)
        draw = np.random.default_rng(7).standard_normal((TERMS, min(DIMS + 16, max(1, n)))).astype(np.float32)
        for _ in range(4):
            q, _r = np.linalg.qr(x @ draw) if n else (np.zeros((0, draw.shape[1]), np.float32), None)
            draw = x.T @ q
        _u, _s, vt = np.linalg.svd(draw.T, full_matrices=False)
        self.basis = np.ascontiguousarray(vt[:DIMS].T, dtype=np.float32)
        self.vectors = self._unit(x @ self.basis)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the K nearest, for each row of counts."""
        if not len(self.labels):
            return np.where(counts.any(axis=1), 0.5, 0.0)
        if self.labels.min() == self.labels.max():
            return np.where(counts.any(axis=1), float(self.labels[0]), 0.0)
        v = self._unit(_weights(counts, self.idf) @ self.basis)
        near = np.round(v @ self.vectors.T, 5)  # rounded: equal vectors tie whatever the order of the sums
        k = min(K, near.shape[1])
        best = np.argsort(-near, axis=1, kind="stable")[:, :k] if near.shape[1] <= 64 else _top(near, k)
        sims = np.maximum(np.take_along_axis(near, best, axis=1), 0)
        ones = float(self.labels.sum())
        sims = sims * np.where(self.labels[best] == 1, 1.0, ones / max(1.0, len(self.labels) - ones) if ones else 1.0)
        total = sims.sum(axis=1)
        votes = (sims * self.labels[best]).sum(axis=1)
        return np.where(counts.any(axis=1) & (total > 0), votes / np.where(total > 0, total, 1), 0.0).clip(0, 1)


def _top(near: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row; equal values by the lower column."""
    rank = near.astype(np.float64) * 1e5 * near.shape[1] - np.arange(near.shape[1])
    return np.argpartition(-rank, k - 1, axis=1)[:, :k]


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r for block in blocks(batch.column("text")) for r in term_counts(block)]
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("quality"), pa.array([zlib.compress(r.tobytes(), 1) for r in rows], pa.binary())], names=["h", "quality", "counts"])


def text_hash() -> F.Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def fit(docs: DataFrame, quality: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """docs (doc_id, text), quality (doc_id, quality) of the training rows. Each label gives the per_class distinct
    texts of lowest hash. Only hashes are joined to labels; texts are read for the chosen ones alone."""
    hashed = docs.select("doc_id", text_hash().alias("h")).join(quality.where("quality in (0, 1)"), "doc_id")
    distinct = hashed.groupBy("h").agg(F.min("quality").alias("quality"))
    picked = distinct.where("quality = 0").orderBy("h").limit(per_class).union(distinct.where("quality = 1").orderBy("h").limit(per_class))
    chosen = [(r["h"], r["quality"]) for r in picked.collect()]  # 2 * per_class rows at most
    small = docs.sparkSession.createDataFrame(chosen, "h long, quality int")
    sample = docs.select(text_hash().alias("h"), "text").join(F.broadcast(small), "h")
    once = sample.mapInArrow(_count_rows, "h long, quality int, counts binary").groupBy("h").agg(F.first("counts").alias("counts"), F.first("quality").alias("quality"))
    rows = once.orderBy("h").toArrow()
    counts = np.zeros((len(rows), TERMS), np.float32)
    for i, packed in enumerate(rows["counts"]):
        counts[i] = np.frombuffer(zlib.decompress(packed.as_py()), dtype=np.float32)
    labels = rows["quality"].to_numpy().astype(np.float32)
    del rows
    model = Model(counts, labels)
    del counts
    give_back()
    return model


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        scores = [model.score(term_counts(block)) for block in blocks(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["doc_id", "score"])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_on_labels(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS):
    """The model as a broadcast variable; held-out rows never enter it."""
    quality = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model = fit(known, quality.where(~held_out(F.col("doc_id"))), per_class)
    return docs.sparkSession.sparkContext.broadcast(model)


def score_documents(docs: DataFrame, labels: DataFrame, *, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    shared = fit_on_labels(docs, labels, per_class)
    kind = dict(docs.dtypes)["doc_id"]
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = known.mapInArrow(lambda it: _score(it, shared), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _keep(batches: Iterator[pa.RecordBatch], shared, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scored = pa.Table.from_batches(list(_score([pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text")], names=["doc_id", "text"])], shared)))
        yield batch.filter(pa.array(scored["score"].to_numpy() >= threshold))


def keep_predicted(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, whole, whose score reaches the threshold."""
    shared = fit_on_labels(docs, labels)
    return docs.mapInArrow(lambda it: _keep(it, shared, threshold), docs.schema)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
