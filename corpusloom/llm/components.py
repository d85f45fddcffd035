"""Groups of records from pairwise matches: connected components by alternating star rewrites."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.durable import durable_with, forget
from corpusloom.plans.skew import HOT_FRACTION, hot_split_join

#: Edges that are contracted at a time before the first round, and edges of a node up to which a plain join takes it.
STRETCH, PLAIN = 500_000, 20_000


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) to the smallest node of each component of the edges u - v."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(nodes)))
    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    for i in range(len(parent)):  # a parent is never larger, so it is final when its child is reached
        parent[i] = parent[parent[i]]
    root = np.array(parent, np.int64)
    tied = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[tied], nodes[root[tied]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def stars() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        u, v = contracted(t.column(0).to_numpy(), t.column(1).to_numpy())
        kind = t.schema.field(0).type
        return pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind)], names=["u", "v"])

    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= STRETCH:
            yield stars()
            held, size = [], 0
    if size:
        yield stars()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The edges, written, with their number and an order-free hash of them."""
    out, seen = durable_with(edges, n=F.count(F.lit(1)), h=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    return out, (int(seen["n"]), int(seen["h"] or 0))


def _star(edges: DataFrame, n: int, small: bool) -> DataFrame:
    """One star rewrite of the ``n`` edges (u, v), u the larger end.

    Large star: every node's larger neighbours are tied to its smallest neighbour (itself included).
    Small star: every node's smaller neighbours, and the node, are tied to its smallest neighbour.
    """
    if small:
        arcs = edges.select(F.col("u").alias("at"), F.col("v").alias("to"))
    else:
        arcs = edges.select(F.explode(F.array(F.struct(F.col("u").alias("at"), F.col("v").alias("to")), F.struct(F.col("v").alias("at"), F.col("u").alias("to")))).alias("e")).select("e.at", "e.to")
    least, seen = durable_with(arcs.groupBy("at").agg(F.least(F.min("to"), F.first("at")).alias("m"), F.count("*").alias("uses")), most=F.max("uses"))
    tied = arcs if small else arcs.filter(F.col("to") > F.col("at"))
    arcs_in_all = n if small else 2 * n
    if (seen["most"] or 0) > max(PLAIN, arcs_in_all // HOT_FRACTION):
        joined = hot_split_join(tied, least, ["at"], "uses", arcs_in_all)
    else:  # no node holds more edges than a task takes
        joined = tied.hint("merge").join(least.drop("uses"), "at")
    out = joined.select(F.col("to").alias("u"), F.col("m").alias("v"))
    if small:
        out = out.unionByName(least.select(F.col("at").alias("u"), F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def connected_components(pairs: DataFrame, a: str, b: str, node: str = "node", component: str = "component") -> DataFrame:
    """(``node``, ``component``) for every value in ``pairs`` tied to another; component is the smallest member.

    Keys are numbers or text. Pairs may come in either direction and more than once. Pairs with a null side and pairs of a value with
    itself tie nothing; a value in no other pair does not come out. An empty table gives an empty result.

    Large-star and small-star rewrites alternate until neither changes the edges, which are then stars round
    the smallest member of each component. Before the first round and after each, every stretch of edges that
    lies in one task is replaced by the stars of its own components, which saves rounds. Each rewrite is written to the shared checkpoint folder, and the one before it
    deleted; the driver only sees a few numbers a round. A node that holds many edges is split by ``hot_split_join``.
    """
    edges = (
        pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col("u") != F.col("v"))
    )
    kind = edges.schema["u"].dataType.simpleString()
    form = f"u {kind}, v {kind}"
    edges, before = _written(edges.mapInArrow(_contract, form).distinct())
    while True:
        large, between = _written(_star(edges, before[0], small=False))
        forget(edges)
        edges, after = _written(_star(large, between[0], small=True).mapInArrow(_contract, form))
        forget(large)
        if before == between == after:
            break
        before = after
    members = edges.select(F.col("u").alias(node), F.col("v").alias(component))
    roots = edges.select(F.col("v").alias(node), F.col("v").alias(component)).distinct()
    return members.unionByName(roots)
