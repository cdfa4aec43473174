"""Connected components of a distributed graph, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


class Forest:
    """Union-find over the nodes it has met, the least node as root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent
        top = x
        while (up := p.get(top, top)) != top:
            top = up
        while (up := p.get(x, x)) != top and x != top:
            p[x] = top
            x = up
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


    def edges(self) -> pa.RecordBatch:
        pairs = [(x, self.root(x)) for x in self.parent]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], type=pa.int64()) for i in (0, 1)], names=["a", "b"])


def finished(edges: DataFrame) -> DataFrame:
    """(u, p): each node of a few edges (a, b) with its component's least node; one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, nodes = Forest(), set()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
                nodes.update((a, b))
        yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (list(nodes), [forest.root(x) for x in nodes])], names=["u", "p"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "u long, p long")


def components(edges: DataFrame, *, few: int = 1 << 17) -> DataFrame:
    """(node, label) for every node of the edges (a, b: long); nodes of a component have one of its nodes as label.

    Each round gives every node the neighbour of least random rank below its own as parent, follows parents once more
    and contracts the edges to the parents; ranks are drawn anew each round, so edges vanish geometrically whatever the
    graph's shape. When at most `few` are left, one task unites them. Labels follow the maps of all rounds. All steps are
    aggregations with map-side combining and equi-joins of written tables, which the adaptive planner splits where one node is hot.
    """
    left = stored(_tidy(edges), "edges")
    maps: list[DataFrame] = []
    while size := left.count():
        if size <= few:
            maps.append(stored(finished(left), "parents"))
            break
        rank = lambda c, k=len(maps): F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("n"))
        both = left.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(left.select(F.col("b").alias("u"), F.col("a").alias("v")))
        up = both.groupBy("u").agg(F.min(rank("v")).alias("r")).select("u", F.least("r", rank("u"))["n"].alias("p"))
        up = stored(up, "parents")
        twice = stored(up.join(up.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p")), "parents")
        maps.append(twice)
        left = left.join(twice.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a").join(twice.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
        left = stored(_tidy(left.select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "edges")
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = maps[-1]
    for m in reversed(maps[:-1]):
        labels = m.join(labels.select(F.col("u").alias("p"), F.col("p").alias("q")), "p", "left").select("u", F.coalesce("q", "p").alias("p"))
    return labels.select(F.col("u").alias("node"), F.col("p").alias("label"))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
