"""Items of varying length in containers of fixed capacity, neighbours along a space-filling curve together.

Hashed document vectors are projected to three dimensions, put in order along a Hilbert curve, and range
partitioned by their place on it. Each task walks its stretch of the curve and fills one container at a time:
with the oldest items along the curve while they fit, and the room left by the best sum of sizes among the
WINDOW oldest items that are still to be placed. So a container holds neighbours: how far apart its items lie
on the curve is bounded by their number and the window. An item is divided only if it alone exceeds the capacity.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tokens import TOKENIZER, measured
from corpusloom.plans.durable import durable

#: Dimensions and bits of each on the curve; oldest items among which a container's last room is filled.
DIMS, BITS, WINDOW = 3, 12, 64
#: A task fills so many containers at least, the last of which stays partly empty, and takes up to so many items.
LEAST_CONTAINERS, MOST_ITEMS = 500, 1_000_000


def hilbert_key(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer points (n, dims), each coordinate below 2 ** bits."""
    x = grid.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work, from the highest bit down
        low = q - 1
        for i in range(n):
            flip = (x[:, i] & q) != 0
            x[flip, 0] ^= low
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= swap
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray encode
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t[(x[:, n - 1] & q) != 0] ^= q - 1
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> bit) & 1)
    return key


def along_curve(vectors: DataFrame, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """Adds ``curve``: the place of (x0, x1, ...) on a Hilbert curve over four standard deviations round the mean of all rows."""
    stats = vectors.agg(*[f(F.col(f"x{k}")).alias(f"{n}{k}") for k in range(dims) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([stats[f"m{k}"] or 0.0 for k in range(dims)])
    spread = np.array([stats[f"s{k}"] or 1.0 for k in range(dims)])
    spread[spread == 0] = 1.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = (pdf[[f"x{k}" for k in range(dims)]].to_numpy() - mean) / spread
            grid = ((z.clip(-4, 4) + 4) / 8 * (2**bits - 1)).round().astype(np.int64)
            out = pdf.drop(columns=[f"x{k}" for k in range(dims)])
            yield out.assign(curve=hilbert_key(grid, bits))

    kept = [f for f in vectors.schema.fields if f.name not in {f"x{k}" for k in range(dims)}]
    form = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", curve bigint"
    return vectors.mapInPandas(run, form)


def best_sum(sizes: list[int], room: int) -> list[int]:
    """Positions of the sizes whose sum comes closest to ``room`` without exceeding it; earlier sizes are preferred."""
    reach = [1]  # bit s: the sum s is reached by sizes from the last one back to here
    mask = (1 << (room + 1)) - 1
    for n in reversed(sizes):
        reach.append((reach[-1] | (reach[-1] << n)) & mask if n <= room else reach[-1])
    left, out = reach[-1].bit_length() - 1, []
    for i, n in enumerate(sizes):
        rest = reach[len(sizes) - i - 1]
        if n <= left and rest >> (left - n) & 1:
            out.append(i)
            left -= n
    return out


class Filler:
    """One container at a time, filled along the curve; holds ``window`` items. ``out`` gets (item, piece, size, container, place)."""

    def __init__(self, capacity: int, window: int, first: int = 0) -> None:
        self.capacity, self.window, self.next = capacity, window, first
        self.waiting: deque[tuple[int, int, int]] = deque()  # (item, piece, size), oldest first
        self.out: list[tuple[int, int, int, int, int]] = []
        self._open()

    def _open(self) -> None:
        self.container, self.room, self.place = self.next, self.capacity, 0
        self.next += 1

    def _put(self, item: int, piece: int, size: int) -> None:
        self.place += 1
        self.room -= size
        self.out.append((item, piece, size, self.container, self.place))

    def feed(self, item: int, size: int) -> None:
        piece = 1
        while size > self.capacity:  # full pieces have containers of their own
            self.out.append((item, piece, self.capacity, self.next, 1))
            self.next, piece, size = self.next + 1, piece + 1, size - self.capacity
        self.waiting.append((item, piece, size))
        while len(self.waiting) > self.window:
            self._step()

    def _step(self) -> None:
        """The oldest item if it fits; else the container's last room is filled as well as the window can, and the next is opened."""
        if self.waiting[0][2] <= self.room:
            self._put(*self.waiting.popleft())
            return
        chosen = set(best_sum([n for _, _, n in self.waiting], self.room)) if self.room else ()
        if chosen:
            for k in sorted(chosen):
                self._put(*self.waiting[k])
            self.waiting = deque(x for k, x in enumerate(self.waiting) if k not in chosen)
        self._open()

    def close(self) -> None:
        while self.waiting:
            self._step()


def parts_for(items: int, tokens: int, capacity: int, parallelism: int) -> int:
    """Stretches of the curve: each with LEAST_CONTAINERS or more, and up to MOST_ITEMS items unless there are enough for all tasks."""
    return max(1, min(tokens // (capacity * LEAST_CONTAINERS), max(parallelism, items // MOST_ITEMS)))


def pack(items: DataFrame, key: str, size: str, curve: str, capacity: int, parts: int, *, window: int = WINDOW) -> DataFrame:
    """(container, place, ``key``, piece, token_from, tokens): where every item, or piece of one, goes.

    No container holds more than ``capacity``; an item is divided only if it is larger, then into pieces of
    ``capacity`` and a rest, numbered from 1. Empty items, and items of null size, take a place of size 0. Ties
    in ``curve`` go by ``key``; rows that repeat a key are items of their own. ``place`` counts from 1 in each
    container. ``parts`` stretches of the curve are filled independently, each leaving its last containers
    partly empty. A wider ``window`` fills better and lets a container's items lie further apart.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    kind = items.schema[key].dataType.simpleString()
    chosen = items.select(F.col(key).alias("key"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("size"), F.col(curve).alias("curve"))
    ranged = chosen.repartitionByRange(parts, "curve", "key").sortWithinPartitions("curve", "key", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler = Filler(capacity, window, TaskContext.get().partitionId() << 40)
        keys: dict[int, object] = {}
        count = 0

        def done() -> pa.RecordBatch:
            item, piece, size, container, place = (list(x) for x in zip(*filler.out))
            filler.out = []
            starts = (np.array(piece) - 1) * capacity
            out = [pa.array(container, pa.int64()), pa.array(place, pa.int64()), pa.array([keys[i] for i in item], key_type), pa.array(piece, pa.int64()), pa.array(starts, pa.int64()), pa.array(size, pa.int64())]
            return pa.RecordBatch.from_arrays(out, names=["container", "place", "key", "piece", "token_from", "tokens"])

        key_type = None
        for b in batches:
            key_type = b.schema.field(0).type
            kept = {i for i, _, _ in filler.waiting}
            keys = {i: k for i, k in keys.items() if i in kept}
            for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys[count] = k
                filler.feed(count, n)
                count += 1
            if filler.out:
                yield done()
        filler.close()
        if filler.out:
            yield done()

    out = ranged.mapInArrow(run, f"container bigint, place bigint, key {kind}, piece bigint, token_from bigint, tokens bigint")
    return out.withColumnRenamed("key", key) if key != "key" else out


def pack_texts(documents: DataFrame, key: str, text: str, capacities: dict[str, int], *, path: str = TOKENIZER, window: int = WINDOW) -> DataFrame:
    """(name, container, place, ``key``, piece, token_from, tokens): ``pack`` for texts, measured in tokens, for each named capacity.

    Texts are measured once. Null and empty texts take a place of no tokens. Without a capacity, or without
    texts, there are no rows.
    """
    vectors = measured(documents, key, text, path=path, dims=DIMS)
    placed = durable(along_curve(durable(vectors)))
    whole = placed.agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()
    parallelism = documents.sparkSession.sparkContext.defaultParallelism
    out = None
    for name, capacity in sorted(capacities.items()):
        one = pack(placed, key, "tokens", "curve", capacity, parts_for(whole.n, whole.t, capacity, parallelism), window=window).select(F.lit(name).alias("name"), "*")
        out = one if out is None else out.unionAll(one)
    return pack(placed, key, "tokens", "curve", 1, 1).limit(0).select(F.lit("").alias("name"), "*") if out is None else out


def fill_report(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """A row for each name: its capacity, containers, tokens, and the share of the capacity that is used."""
    one = packed.groupBy("name", "container").agg(F.sum("tokens").alias("t"))
    known = packed.sparkSession.createDataFrame(sorted(capacities.items()), "name string, capacity bigint")  # one row per capacity asked for
    per_name = one.groupBy("name").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    both = known.join(per_name, "name", "left")
    return both.select("name", "capacity", F.coalesce("containers", F.lit(0)).alias("containers"), F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("used_share"))
