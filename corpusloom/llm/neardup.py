"""Records whose sets of words differ by small edits: Hamming search by the general pigeonhole principle.

A record is the binary vector of the words it holds. A Jaccard similarity of at least t between sets of sizes
a <= b means a Hamming distance of at most (a + b) (1 - t) / (1 + t). The dimensions (words) are grouped into
partitions; if the thresholds of the partitions, each plus one, add up to more than that distance, two similar
vectors are within the threshold of at least one partition. Which words go together is fitted on a bounded
sample of each class of sizes: frequent words that occur together share a partition where that is estimated to
cost less. Each probing record then allocates its own thresholds by a dynamic programme over the candidates
that each partition would bring, as counted on the sample; a partition of which the record holds nothing, or
only what many others hold, gets -1: it is not probed. The fit and the estimates only steer cost: every record
is indexed and probed, and no pair within the threshold is lost.

Within a partition, vectors that differ in one word meet where that word is left out: on the probing side if
only the probing record has it, on the indexed side if only the other has. Candidates pass a parity sketch that
never exceeds the true distance, and are then verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.durable import durable
from corpusloom.plans.skew import hot_split_join, pairs_of_members

#: Words in the sample of a class of sizes (a record more may be in it): a bound on the driver's memory.
SAMPLE_WORDS = 65_536
#: Frequent words (in at least this share of the sample) are placed by the sample, at most so many; all others by hash.
FREQUENT, MOST_PLACED = 0.01, 4096
#: Words of 64 bits in a sketch, and the cost of a row of the index in candidates.
SKETCH, ROW_COST = 3, 15.0
#: A key that this share of the sample holds is split into SALT keys. Partitions allocated at a time.
HOT_SHARE, SALT, BLOCK = 1 / 64, 16, 64
#: Plans that are compared: the largest threshold of a partition, and units of distance for each partition.
PLANS = [(0, 0.7), (1, 1.2), (1, 1.6)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A finalizer for 64-bit hashes."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distance_bound(size: int, threshold: Fraction) -> int:
    """Largest Hamming distance of a set of ``size`` words to one that is not larger and similar enough."""
    return math.floor(2 * size * (1 - threshold) / (1 + threshold))


@dataclass
class SizeClass:
    """Probing sets of sizes low..high - 1 against sets of sizes from reach, in ``parts`` partitions of thresholds up to ``most``."""

    number: int
    low: int
    high: int
    reach: int
    parts: int
    most: int
    frequent: np.ndarray  # sorted hashes of the placed words
    placed: np.ndarray  # partition of each of them
    seen: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))  # keys of the sample, whole and less a word, sorted
    scale: float = 0.0  # indexed records for each one of the sample
    hot: np.ndarray | None = None  # sorted keys that many records hold

    def part_of(self, hashes: np.ndarray) -> np.ndarray:
        part = (_mix(hashes) % np.uint64(self.parts)).astype(np.int64)
        if not len(self.frequent):
            return part
        at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
        return np.where(self.frequent[at] == hashes, self.placed[at], part)


@dataclass
class Cells:
    """The words of a batch of records by record and partition."""

    cell: np.ndarray  # record * parts + partition of each word, ascending
    whole: np.ndarray  # key of each cell
    less: np.ndarray  # key of each word's cell without the word


def cells_of(c: SizeClass, offsets: np.ndarray, hashes: np.ndarray) -> Cells:
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    cell = owner * c.parts + c.part_of(hashes)
    order = np.argsort(cell, kind="stable")
    h, cell = hashes[order], cell[order]
    total = np.zeros((len(offsets) - 1) * c.parts, np.uint64)
    with np.errstate(over="ignore"):
        if len(cell):
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            total[cell[first]] = np.add.reduceat(_mix(h), first)
        salt = _mix(np.arange(c.parts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c.number * 1_000_003 + 1))
        whole = _mix(total ^ np.tile(salt, len(offsets) - 1))
        less = _mix((total[cell] - _mix(h)) ^ salt[cell % c.parts])
    return Cells(cell, whole, less)


def _hits(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.searchsorted(table, keys, side="right") - np.searchsorted(table, keys, side="left")


def _is_in(table: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    if table is None or not len(table):
        return np.zeros(len(keys), bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


def costs_of(c: SizeClass, cells: Cells, itself: int = 0) -> np.ndarray:
    """Estimated cost [cell, threshold + 1] of probing each cell; ``itself`` is what a record adds to the sample's counts."""
    whole, less = c.seen
    cost = np.zeros((len(cells.whole), c.most + 2))
    at_none = (_hits(whole, cells.whole) - itself) * c.scale
    row = ROW_COST * (1 + (SALT - 1) * _is_in(c.hot, cells.whole))
    cost[:, 1] = at_none + row
    if c.most:
        spare = np.bincount(cells.cell, weights=_hits(whole, cells.less) * c.scale + ROW_COST * (1 + (SALT - 1) * _is_in(c.hot, cells.less)), minlength=len(cost))
        cost[:, 2] = at_none + spare + _hits(less, cells.whole) * c.scale + 2 * row
    return cost


def allocate(cost: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """Thresholds [record, partition] from -1 up, of least total ``cost[record, partition, threshold + 1]``, that plus one add up to
    ``budget[record]`` or more: a dynamic programme over the partitions, BLOCK of them at a time, each block with its share of the budget."""
    records, parts, options = cost.shape
    if parts > BLOCK:
        edges = [*range(0, parts, BLOCK), parts]
        done = [-(-budget * e // parts) for e in edges]
        return np.concatenate([allocate(cost[:, a:b], y - x) for a, b, x, y in zip(edges, edges[1:], done, done[1:])], axis=1)
    most = int(budget.max(initial=0))
    best = np.full((records, most + 1), np.inf, np.float32)
    best[:, 0] = 0
    choice = np.zeros((parts, records, most + 1), np.int8)
    level = np.arange(most + 1)
    for p in range(parts):
        new = best + cost[:, p, :1].astype(np.float32)
        for o in range(1, options):
            total = best[:, np.maximum(level - o, 0)] + cost[:, p, o : o + 1].astype(np.float32)
            better = total < new
            new[better] = total[better]
            choice[p][better] = o
        best = new
    out, at, every = np.empty((records, parts), np.int64), budget.copy(), np.arange(records)
    for p in range(parts - 1, -1, -1):
        out[:, p] = choice[p, every, at]
        at = np.maximum(at - out[:, p], 0)
    return out - 1


def thresholds(c: SizeClass, cells: Cells, budget: np.ndarray, itself: int = 0) -> tuple[np.ndarray, float]:
    """Threshold of each cell, and what they are estimated to cost in all."""
    cost = costs_of(c, cells, itself).reshape(len(budget), c.parts, c.most + 2)
    out = np.empty((len(budget), c.parts), np.int64)
    step = max(1, 4_000_000 // (min(c.parts, BLOCK) * (int(budget.max(initial=0)) + 1)))
    for a in range(0, len(budget), step):
        out[a : a + step] = allocate(cost[a : a + step], budget[a : a + step])
    chosen = np.take_along_axis(cost, (out + 1)[:, :, None], 2).sum()
    return out.reshape(-1), float(chosen)


def _place(x: np.ndarray, parts: int, correlated: bool) -> np.ndarray:
    """Partition of each column of the 0/1 matrix ``x``: even entropy, correlated columns together if asked."""
    p = x.mean(axis=0).clip(1e-6, 1 - 1e-6)
    entropy = -(p * np.log(p) + (1 - p) * np.log(1 - p))
    unit = (x - p) / np.sqrt(p * (1 - p)) / math.sqrt(len(x))
    load, centre = np.zeros(parts), np.zeros((parts, len(x)))
    room = entropy.sum() / parts * 1.05
    out = np.zeros(x.shape[1], np.int64)
    for j in np.argsort(-entropy):
        k = int(load.argmin())
        if correlated:
            near = np.abs(centre @ unit[:, j])
            near[load + entropy[j] > room] = -1
            if near.max() > 0.3:
                k = int(near.argmax())
            centre[k] += unit[:, j]
        out[j] = k
        load[k] += entropy[j]
    return out


def _joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return offsets, np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def _fit_class(number: int, bounds: tuple[int, int, int], probing: int, indexed: int, near: list[np.ndarray], threshold: Fraction) -> SizeClass:
    low, high, reach = bounds
    most = distance_bound(high - 1, threshold) + 1
    words, counts = np.unique(_joined(near)[1], return_counts=True)
    often = counts >= max(2, FREQUENT * len(near))
    if often.sum() > MOST_PLACED:
        often = np.zeros(len(words), bool)
        often[np.argsort(-counts, kind="stable")[:MOST_PLACED]] = True
    frequent = words[often]
    x = np.zeros((len(near), len(frequent)))
    for i, s in enumerate(near):
        x[i, np.flatnonzero(np.isin(frequent, s, assume_unique=True))] = 1
    probes = [s for s in near if len(s) >= low]
    budget = np.array([distance_bound(len(s), threshold) + 1 for s in probes], np.int64)
    best, least = None, math.inf
    for level, per in PLANS:
        parts = math.ceil(most / per)
        for correlated in (False, True) if len(frequent) else (False,):
            placed = _place(x, parts, correlated) if len(frequent) else np.zeros(0, np.int64)
            c = SizeClass(number, low, high, reach, parts, level, frequent, placed)
            if near:
                cells = cells_of(c, *_joined(near))
                c.seen, c.scale = (np.sort(cells.whole), np.sort(cells.less)), indexed / len(near)
                keys, n = np.unique(np.concatenate([cells.whole, cells.less]) if level else cells.whole, return_counts=True)
                c.hot = keys[n >= max(2, HOT_SHARE * len(near))]
            rows = parts + (sum(map(len, near)) / len(near) if level and near else 0)
            cost = ROW_COST * rows * indexed
            if probes:
                cost += thresholds(c, cells_of(c, *_joined(probes)), budget, 1)[1] / len(probes) * probing
            if cost < least:
                best, least = c, cost
    return best


def fit(sample: dict[int, list[np.ndarray]], counts: dict[int, int], bounds: list[tuple[int, int, int]], threshold: Fraction) -> list[SizeClass]:
    """The classes of sizes that hold records; ``sample`` and ``counts`` go by class, the counts being those of all records.

    A class is indexed with the records below it that can still be similar, so these are in its sample too.
    """
    out = []
    for number, (low, high, reach) in enumerate(bounds):
        if not counts.get(number):
            continue
        below = [s for n in range(number) for s in sample.get(n, []) if len(s) >= reach]
        # classes are sampled at different rates: each record of the sample stands for as many as those of its class
        mine = sample.get(number, [])
        share = sum(counts.get(n, 0) for n in range(number) if bounds[n][1] > reach)
        keep = len(below) if not mine else min(len(below), max(1, round(len(mine) * share / counts[number])))
        near = mine + below[:keep]
        out.append(_fit_class(number, bounds[number], counts[number], counts[number] + share, near, threshold))
    return out


def size_bounds(smallest: int, largest: int, threshold: Fraction) -> list[tuple[int, int, int]]:
    """(low, high, reach) of the classes that cover sizes smallest..largest; a set is indexed in at most two classes."""
    out, low = [], smallest
    while low <= largest:
        high = max(low + 1, math.ceil(low / threshold**2))
        out.append((low, high, math.ceil(low * threshold)))
        low = high
    return out


def signature_keys(probing: bool, offsets: np.ndarray, hashes: np.ndarray, classes: list[SizeClass], threshold: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields (record numbers, keys) for a batch of sets given as offsets into their hashes."""
    sizes = np.diff(offsets)
    for c in classes:
        docs = np.flatnonzero((sizes >= (c.low if probing else c.reach)) & (sizes < c.high))
        if not len(docs):
            continue
        chosen = np.zeros(len(sizes), bool)
        chosen[docs] = True
        cells = cells_of(c, np.concatenate([[0], np.cumsum(sizes[docs])]), hashes[np.repeat(chosen, sizes)])
        at, doc_of = np.arange(len(cells.whole)), docs[cells.cell // c.parts]
        level = np.full(len(cells.whole), c.most)
        if probing:
            level, _ = thresholds(c, cells, np.array([distance_bound(int(n), threshold) + 1 for n in sizes[docs]]))
            at = np.flatnonzero(level >= 0)
        # whole against whole, and a word less on one side against whole on the other
        roles = [(docs[at // c.parts], cells.whole[at], 0)]
        if c.most:
            with_one = level >= 1
            word = with_one[cells.cell]
            ones = np.flatnonzero(with_one)
            roles += [(doc_of[word], cells.less[word], 1 if probing else 2), (docs[ones // c.parts], cells.whole[ones], 2 if probing else 1)]
        for record, key, role in roles:
            if not probing and role == 1:
                continue  # the same rows as those of role 0
            yield record, key if role < 2 else _mix(key + np.uint64(1)), _is_in(c.hot, key)


def _salted(key: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return _mix(key ^ _mix(salt.astype(np.uint64) + np.uint64(0x51ED270B)))


def _signatures(probing: bool, classes: list[SizeClass], threshold: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            offsets = np.asarray(lists.offsets).astype(np.int64)
            hashes = np.asarray(lists.flatten()).astype(np.int64).view(np.uint64)
            offsets = offsets - offsets[0]
            sizes = np.diff(offsets)
            sketch = _sketch(offsets, hashes)
            ids = np.asarray(b.column(0))
            for docs, keys, hot in signature_keys(probing, offsets, hashes, classes, threshold):
                # a hot key is split by the indexed records; a probe looks at every split
                times = np.where(hot, SALT if probing else 1, 1)
                turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                docs, keys, hot = np.repeat(docs, times), np.repeat(keys, times), np.repeat(hot, times)
                salt = turn if probing else (_mix(ids[docs].astype(np.uint64)) % np.uint64(SALT)).astype(np.int64)
                keys = np.where(hot, _salted(keys, salt), keys)
                for a in range(0, len(docs), 65_536):
                    d, k = docs[a : a + 65_536], keys[a : a + 65_536]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k.view(np.int64)), pa.array(ids[d]), pa.array(sizes[d].astype(np.int32)), *[pa.array(sketch[d, i]) for i in range(SKETCH)]],
                        names=["k", "id", "size", *[f"b{i}" for i in range(SKETCH)]],
                    )

    return run


def _sketch(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Parity of the words that fall on each of 64 * SKETCH bits; two sketches differ in at most as many bits as the sets in words."""
    bit = (_mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(64 * SKETCH)).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    grid = np.bincount(owner * 64 * SKETCH + bit, minlength=(len(offsets) - 1) * 64 * SKETCH) & 1
    packed = np.packbits(grid.astype(np.uint8).reshape(-1, 64), axis=1, bitorder="little")
    return packed.view(np.uint64).reshape(-1, SKETCH).view(np.int64)


def word_sets(records: DataFrame, key: str, words: str, min_size: int) -> DataFrame:
    """(rec_key, h): the different words of each record as sorted hashes; records with fewer, and null arrays, are left out."""
    h = F.array_sort(F.array_distinct(F.transform(F.filter(F.col(words), lambda x: x.isNotNull()), lambda x: F.xxhash64(x))))
    return records.select(F.col(key).alias("rec_key"), h.alias("h")).filter(F.size("h") >= min_size)


def _drawn(distinct: DataFrame, bounds: list[tuple[int, int, int]]) -> tuple[dict[int, list[np.ndarray]], dict[int, int]]:
    """The sample and the number of records of each class of sizes."""
    number = sum((F.when(F.col("size") >= low, 1).otherwise(0) for low, _, _ in bounds), F.lit(0)) - 1
    classes = distinct.withColumn("c", number)
    totals = classes.groupBy("c").agg(F.count("*").alias("n"), F.sum("size").alias("words")).collect()  # a row per class
    # a share of each class, by a hash of the set
    share = F.create_map(*[F.lit(x) for t in totals for x in (t.c, min(1.0, SAMPLE_WORDS / t.words))]) if totals else None
    sample: dict[int, list[np.ndarray]] = {}
    if totals:
        draw = F.shiftrightunsigned(F.xxhash64("set_id", F.lit(7)), 11) / F.lit(float(2**53))
        for r in classes.filter(draw < share[F.col("c")]).select("c", "h").collect():
            sample.setdefault(r.c, []).append(np.sort(np.array(r.h, np.int64).view(np.uint64)))
    return sample, {t.c: t.n for t in totals}


def similar_records(sets: DataFrame, threshold: float, smallest: int) -> tuple[DataFrame, DataFrame]:
    """Members (set_id, rec_key) and links (a_set, b_set, similarity) between different sets of at least ``smallest`` words.

    ``sets`` is the result of ``word_sets``. Records with equal sets are one class, joined once, named by a
    hash of 128 bits. Links are exact and complete, but for words whose 64-bit hashes collide. An empty table
    gives no members and no links.
    """
    t = Fraction(threshold).limit_denominator(10_000)
    members = durable(sets.withColumn("set_id", F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64("h", F.lit(s))), 16, "0") for s in (0, 1)]))))
    distinct = members.groupBy("set_id").agg(F.first("h").alias("h")).withColumns({"size": F.size("h"), "id": F.monotonically_increasing_id()})
    distinct = durable(distinct)  # from here on the numbers stay what they are
    largest = distinct.agg(F.max("size")).first()[0] or smallest
    bounds = size_bounds(smallest, largest, t)
    classes = fit(*_drawn(distinct, bounds), bounds, t)
    form = "k bigint, id bigint, size int, " + ", ".join(f"b{k} bigint" for k in range(SKETCH))
    source = distinct.select("id", "h")
    probes = source.mapInArrow(_signatures(True, classes, t), form)
    index = source.mapInArrow(_signatures(False, classes, t), form)
    p = probes.select("k", *[F.col(c).alias(f"p_{c}") for c in probes.columns[1:]])
    q = index.select("k", *[F.col(c).alias(f"q_{c}") for c in index.columns[1:]])
    apart: Column = sum((F.bit_count(F.col(f"p_b{k}").bitwiseXOR(F.col(f"q_b{k}"))) for k in range(SKETCH)), F.lit(0))
    allowed = (F.col("p_size") + F.col("q_size")) * (t.denominator - t.numerator) / (t.denominator + t.numerator)
    near = (
        (F.col("q_size") <= F.col("p_size"))
        & (F.col("q_size") * t.denominator >= F.col("p_size") * t.numerator)
        & ((F.col("q_size") < F.col("p_size")) | (F.col("q_id") < F.col("p_id")))
        & (apart <= allowed + 1e-9)
    )
    # neither side is small, whatever Spark takes the output of an Arrow function for: every join here is a shuffled one
    candidates = p.hint("merge").join(q, "k").filter(near).select(F.col("p_id").alias("x"), F.col("q_id").alias("y")).distinct()
    x = distinct.select(F.col("id").alias("x"), F.col("set_id").alias("a_set"), F.col("h").alias("hx"))
    y = distinct.select(F.col("id").alias("y"), F.col("set_id").alias("b_set"), F.col("h").alias("hy"))
    both = candidates.hint("merge").join(x, "x").hint("merge").join(y, "y").withColumn("shared", F.size(F.array_intersect("hx", "hy")))
    union = F.size("hx") + F.size("hy") - F.col("shared")
    links = both.filter(F.col("shared") * t.denominator >= union * t.numerator).select("a_set", "b_set", (F.col("shared") / union).alias("similarity"))
    return members.select("set_id", "rec_key"), links


def expand_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs (a, b, similarity) of records, a < b, those with equal sets included. ``members`` is that of ``similar_records``."""
    return pairs_of_members(members, links, "rec_key")


def class_report(members: DataFrame, links: DataFrame) -> DataFrame:
    """(rec_key, class_id, class_size, links): class_id is the smallest key of the class; links go to other sets."""
    size = members.groupBy("set_id").agg(F.count("*").alias("class_size"), F.min("rec_key").alias("class_id"))
    ends = links.select(F.explode(F.array("a_set", "b_set")).alias("set_id"))
    per_class = size.hint("merge").join(ends.groupBy("set_id").agg(F.count("*").alias("links")), "set_id", "left").fillna(0, ["links"])
    per_class = durable(per_class.withColumn("uses", F.col("class_size")))
    return hot_split_join(members, per_class, ["set_id"], "uses", members.count()).select("rec_key", "class_id", "class_size", "links")
