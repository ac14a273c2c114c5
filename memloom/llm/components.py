"""Connected components: union inside tasks, then jumps to the least node."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edges that a task gathers before it contracts them.
HELD_EDGES = 1 << 18


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the edges a-b, for every node that isn't the least."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
        if not len(x):
            break
        tops = label[x], label[y]
        least = np.minimum(*tops)
        for top in tops:
            np.minimum.at(label, top, least)
        while not np.array_equal(up := label[label], label):
            label = up
    other = np.flatnonzero(label != np.arange(len(ids)))
    return ids[other], ids[label[other]]


class Forest:
    """Edges of a task, contracted as they gather: memory goes with the task's nodes."""

    def __init__(self):
        self.held, self.n = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((a, b))
        self.n += len(a)
        if self.n > HELD_EDGES and self.n > 2 * len(self.held[0][0]):
            self.stars()

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        made = stars(*(np.concatenate(x) for x in zip(*self.held, strict=True)))
        self.held, self.n = [made], len(made[0])
        return made


def contracted(batches):
    """The edges ``u, v`` of a task as stars: (node, least node of its component in the task)."""
    import pyarrow as pa

    forest = Forest()
    for batch in batches:
        forest.add(*(c.to_numpy() for c in batch.columns))
    yield pa.record_batch([pa.array(x) for x in forest.stars()], ["u", "v"])


def _met(batches):
    """As ``contracted``; ``extra`` marks nodes whose own edges are dealt to another task."""
    import pyarrow as pa

    forest, own = Forest(), np.zeros(0, np.int64)
    for batch in batches:
        u, v = (c.to_numpy() for c in batch.columns)
        forest.add(u, v)
        own = np.union1d(own, u)
    u, v = forest.stars()
    yield pa.record_batch([pa.array(u), pa.array(v), pa.array(~np.isin(u, own))], ["u", "v", "extra"])


def pointers(edges: DataFrame, most_rounds: int = 60, contract: bool = True) -> DataFrame:
    """(id, component) of every node of the edges ``a, b`` but the least of each component.

    A round contracts the edges inside the tasks, deals them by their larger node and contracts again;
    each node that was dealt there then points to one smaller node, and all edges jump over those pointers. Edges go
    from leaves to the least node, so they are dealt evenly however many a node has, and the jump is a
    plain join whose hot nodes Spark can split. The rounds end once nothing was left to contract or
    jump; without nodes that have several pointers a round only jumps. Each round is written to the shared folder.
    ``contract=False`` leaves out the first contraction, for edges that are dealt so that tasks hold few of a component's.
    """
    now, single = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), False
    for _ in range(most_rounds):
        if not single:
            ends = now.select("u", "v")
            ends = ends.mapInArrow(contracted, "u long, v long") if contract else ends
            contract = True
            now = written(ends.repartition("u").mapInArrow(_met, "u long, v long, extra boolean"), "stars")
        up = now.where("not extra").select(F.col("u").alias("v"), F.col("v").alias("top"))
        jumped = now.join(up, "v", "left").select("u", F.coalesce("top", "v").alias("v"), "extra", F.col("top").isNotNull().alias("moved"))
        now = written(jumped, "jumped")
        extra, moved = now.agg(F.max("extra"), F.max("moved")).first()
        single = not extra
        if not extra and not moved:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    raise RuntimeError(f"no components after {most_rounds} rounds")


def components(edges: DataFrame, most_rounds: int = 60, contract: bool = True) -> DataFrame:
    """(id, component) of every node of the edges ``a, b``: the least node reachable.

    Edges with a null end are passed over, repeated edges and loops change nothing.
    """
    found = pointers(edges, most_rounds, contract)
    return found.union(found.select(F.col("component").alias("id"), "component").distinct())
