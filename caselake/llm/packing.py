"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

Documents are tokenised whole, end with an end id and are cut into pieces of the sequence length only where they
are longer. A full piece is a sequence of its own. The others are dealt at random into blocks of a few thousand
pieces, since packing within such a block wastes less than one sequence a block. A block is packed by best fit
decreasing; if that meets a lower bound it is done. Otherwise islands evolve plans of the block, each in a task of
its own: a child gets the bins of one parent, then whole well-filled bins of the other are injected, bins that
share a piece with them are dissolved and the displaced pieces are put back by best fit. After each epoch an
island's best plan migrates to the next island of the block. The best plan of all islands wins.

Defined cases: a null or empty text is the end id alone; rows that repeat an id are documents of their own; ties
go to the earlier bin; an empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import os
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, worker_cache

LENGTH = 2048
BLOCK_ITEMS = 4096
ISLANDS = 3
EPOCHS = 2
POPULATION = 4
GENERATIONS = 6
TOKENIZER = "word_bpe_49k.json"


class ChunkTokenizer:
    """Ids of a text as little-endian 32-bit data, with the ids of chunks between ASCII white space kept.

    Exact for tokenizers that neither merge across white space nor give ids to it. The cache is emptied when it
    holds ``limit`` chunks, so its memory is bounded.
    """

    def __init__(self, path: str, limit: int = 1_000_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.known: dict[bytes, bytes] = {}

    def encode(self, data: bytes) -> bytes:
        chunks = data.split()
        known = self.known
        new = [c for c in set(chunks) if c not in known]
        if new:
            if len(known) + len(new) > self.limit:
                known.clear()
                new = list(set(chunks))
            self._learn(new)
        return b"".join(map(known.__getitem__, chunks))


    def _learn(self, chunks: list[bytes]) -> None:
        """Encodes the chunks as one text and cuts its ids at their bounds: far fewer calls and objects than one by one."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        encoding = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = np.asarray(encoding.ids, dtype="<u4").tobytes()
        starts = np.fromiter((o[0] for o in encoding.offsets), dtype=np.int64, count=len(encoding.offsets))
        ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
        cuts = (4 * np.searchsorted(starts, ends)).tolist()
        at = 0
        for c, cut in zip(chunks, cuts, strict=True):
            self.known[c] = ids[at:cut]
            at = cut


def tokenizer(path: str) -> ChunkTokenizer:
    """One a worker process, kept from task to task."""
    return worker_cache(path, lambda: ChunkTokenizer(path))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, length: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encode = tokenizer(path).encode
    end = int(end_id).to_bytes(4, "little")
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        at: list[int] = []
        out: dict[str, list[int]] = {k: [] for k in ("item", "piece", "start", "length", "ids_crc32")}
        for i, data in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            ids = encode(data or b"") + end
            for piece, start in enumerate(range(0, len(ids) // 4, length)):
                part = ids[4 * start : 4 * (start + length)]
                at.append(i)
                for k, v in zip(out, (row, piece, start, len(part) // 4, zlib.crc32(part)), strict=True):
                    out[k].append(v)
                row += 1
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *[pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]], names=["doc_id", *out])


class Plan:
    """Bins of item indexes with their free space; best fit by a bit set of the free spaces that occur."""

    def __init__(self, sizes: list[int], length: int) -> None:
        self.sizes, self.length = sizes, length
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: dict[int, list[int]] = {}
        self.mask = 0

    def add_bin(self, items: list[int]) -> None:
        self.bins.append(items)
        self.free.append(self.length - sum(self.sizes[i] for i in items))
        self._list(len(self.bins) - 1)

    def _list(self, b: int) -> None:
        f = self.free[b]
        self.by_free.setdefault(f, []).append(b)
        self.mask |= 1 << f

    def place(self, item: int) -> None:
        size = self.sizes[item]
        above = self.mask >> size
        if not above:
            self.add_bin([item])
            return
        f = size + (above & -above).bit_length() - 1
        bins = self.by_free[f]
        b = bins.pop()
        if not bins:
            self.mask &= ~(1 << f)
        self.bins[b].append(item)
        self.free[b] -= size
        self._list(b)

    @property
    def fitness(self) -> tuple[int, float]:
        return -len(self.bins), sum((self.length - f) ** 2 for f in self.free)


def best_fit(sizes: list[int], length: int, order: list[int]) -> Plan:
    plan = Plan(sizes, length)
    for i in order:
        plan.place(i)
    return plan


def lower_bound(sizes: np.ndarray, length: int) -> int:
    """The largest of the bounds that count items over a half and what the items from k up must add to them."""
    bound = -(-int(sizes.sum()) // length)
    for k in range(0, length // 2 + 1, max(1, length // 64)):
        big, mid = sizes[sizes > length - k], sizes[(sizes <= length - k) & (sizes > length // 2)]
        small = sizes[(sizes >= k) & (sizes <= length // 2)]
        bound = max(bound, len(big) + len(mid) + max(0, -(-int(small.sum() - (len(mid) * length - mid.sum())) // length)))
    return bound


def crossover(a: Plan, b: Plan, draw: random.Random) -> Plan:
    """a's bins with some of b's best-filled bins injected; displaced items go back by best fit, largest first."""
    ranked = sorted(range(len(b.bins)), key=b.free.__getitem__)
    pool = ranked[: max(1, len(ranked) // 2)]
    injected = draw.sample(pool, max(1, len(pool) // 3))
    inside = {i for n in injected for i in b.bins[n]}
    child, displaced = Plan(a.sizes, a.length), []
    worst = sorted(range(len(a.bins)), key=a.free.__getitem__, reverse=True)[: max(2, len(a.bins) // 20)]
    dissolve = set(draw.sample(worst, max(1, len(worst) // 2)))
    for n, items in enumerate(a.bins):
        if n in dissolve or not inside.isdisjoint(items):
            displaced += [i for i in items if i not in inside]
        else:
            child.add_bin(list(items))
    for n in injected:
        child.add_bin(list(b.bins[n]))
    for i in sorted(displaced, key=lambda i: -a.sizes[i] * (1 + 0.1 * draw.random())):
        child.place(i)
    return child


def evolve(plans: list[Plan], bound: int, seed: int, population: int = POPULATION, generations: int = GENERATIONS) -> Plan:
    """The best plan after some generations; the best of each generation stays."""
    draw = random.Random(seed)
    sizes, length = plans[0].sizes, plans[0].length
    while len(plans) < population:
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + 0.15 * draw.random()))
        plans.append(best_fit(sizes, length, order))
    for _ in range(generations):
        plans.sort(key=lambda p: p.fitness, reverse=True)
        if len(plans[0].bins) <= bound:
            break
        children = [crossover(*draw.sample(plans, 2), draw) for _ in range(population)]
        plans = sorted([*plans, *children], key=lambda p: p.fitness, reverse=True)[:population]
    return max(plans, key=lambda p: p.fitness)


def _first_plan(block: pd.DataFrame, length: int) -> pd.DataFrame:
    block = block.sort_values("item", ignore_index=True)
    sizes = block["length"].tolist()
    plan = best_fit(sizes, length, sorted(range(len(sizes)), key=lambda i: -sizes[i]))
    return _rows(block, plan, len(plan.bins) <= lower_bound(block["length"].to_numpy(), length))


def _rows(block: pd.DataFrame, plan: Plan, solved: bool) -> pd.DataFrame:
    bins = np.empty(len(block), dtype=np.int64)
    for n, items in enumerate(plan.bins):
        bins[items] = n
    return block[["block", "island", "item", "length"]].assign(bin=bins, bins=len(plan.bins), solved=solved)


def _evolved(rows: pd.DataFrame, length: int, epoch: int) -> pd.DataFrame:
    """rows: each item once for each plan of the island (column plan)."""
    plans, block = [], None
    for _n, own in sorted(rows.groupby("plan"), key=lambda g: g[0]):
        block = own.sort_values("item", ignore_index=True)
        plan = Plan(block["length"].tolist(), length)
        for _bin, items in block.groupby("bin").indices.items():
            plan.add_bin(items.tolist())
        plans.append(plan)
    bound = lower_bound(block["length"].to_numpy(), length)
    best = evolve(plans, bound, seed=int(block["block"][0]) * 1009 + int(block["island"][0]) * 31 + epoch)
    return _rows(block, best, len(best.bins) <= bound)


PLAN_SCHEMA = "block long, island int, item long, length long, bin long, bins long, solved boolean"


def pack_items(items: DataFrame, *, length: int = LENGTH, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(item, length), lengths below ``length``, items unique -> item, block, bin."""
    blocks = max(1, -(-items.count() // block_items))
    dealt = items.select(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), F.lit(0).alias("island"), "item", "length")
    first = table(dealt.groupBy("block").applyInPandas(lambda g: _first_plan(g, length), PLAN_SCHEMA), "pack-first")
    done, current = first.where("solved"), None
    for epoch in range(epochs):
        if current is None:
            start = first.where("not solved").drop("island").withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)]))).withColumn("plan", F.lit(0))
        else:  # each island keeps its best plan and gets that of the island before it
            start = current.withColumn("plan", F.lit(0)).unionByName(current.withColumn("island", (F.col("island") + 1) % islands).withColumn("plan", F.lit(1)))
        current = table(start.groupBy("block", "island").applyInPandas(lambda g: _evolved(g, length, epoch), PLAN_SCHEMA), "pack-islands")  # noqa: B023  (run at once)
    best = current.groupBy("block", "island").agg(F.first("bins").alias("bins")).groupBy("block").agg(F.min_by("island", F.struct("bins", "island")).alias("island"))
    won = current.join(best, ["block", "island"], "left_semi")
    return done.select("item", "block", "bin").unionByName(won.select("item", "block", "bin"))


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str | None = None, length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    path = tokenizer_file or tokenizer_path(TOKENIZER)
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = table(texts.mapInArrow(lambda it: _pieces(it, path, length, end_id), f"doc_id {kind}, item long, piece int, start long, length long, ids_crc32 long"), "pack-pieces")
    part = F.col("length") < length
    packed = pack_items(pieces.where(part).select("item", "length"), length=length)
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    before = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, 0)  # length rows at most
    placed = pieces.where(part).join(packed, "item").withColumn("sequence_id", F.col("block") * (1 << 24) + F.col("bin")).withColumn("offset", F.sum("length").over(before) - F.col("length"))
    full = pieces.where(~part).withColumn("sequence_id", -1 - F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    return placed.select(*out).unionByName(full.select(*out))


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
