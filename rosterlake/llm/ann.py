"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact reranking.

A table hashes a vector to floor((A x + b) / W), for `functions` rows of A drawn from the normal law, which is 2-stable: the difference of
two vectors at distance r is moved by A as by a normal variable of deviation r. So the chance that a neighbour at distance r lies
one cell down, up or in the same cell is known for each function from where the query lies in its cell, and the chance of a
perturbed bucket is their product. `probes` lists buckets in order of that chance until they hold a neighbour with probability
`target`, over all tables; the candidates of all tables are merged and reranked by exact distance.

- r is fitted for each query: its distance to the member of a bounded sample that stands where its k-th neighbour would, or
  nearer the end; so it is too large rather than too small, and hard queries visit more buckets. W is `width` times its median.
- A query whose chance cannot be reached within `most` buckets of a table, and one that found fewer than k, is compared with every
  row (`exact way`): nothing is capped.

Work is dealt by buckets, in parts of about `per` rows that a task holds, whatever the table's size; buckets with more rows
than a part are split over several, which their visitors all visit. There are at most 65,536 of these, as `per` grows with the table
beyond. Queries stream through the parts that their buckets lie in, one row for a query and part with its bucket keys, and leave
their k best there; no pair goes through a shuffle. Of equal vectors only the k + 1 of least id are indexed, which are all that
can be among a query's nearest: a vector that a third of all rows hold is a few rows.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, neither as queries nor as
candidates; a query is compared with vectors of its own length; rows of the query's own id are no candidates; an id on several
vectors is at the distance of the nearest one, and as a query asks with each; repeated rows count once; rows without an id are
candidates, as one with null id; ties go to the smaller id, null last; fewer than k candidates are all returned; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored, table
from .sketch import mixed

SEED, MOST_SPLIT = 12, 65_536


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, all components finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def representatives(rows: DataFrame, k: int) -> DataFrame:
    """The rows (id, v), of each vector those of the k + 1 least ids, each once. Limited in each task before the shuffle."""
    nth = F.dense_rank().over(Window.partitionBy("h", "v").orderBy(F.asc_nulls_last("id")))
    return rows.withColumn("h", F.xxhash64("v")).withColumn("nth", nth).filter(F.col("nth") <= k + 1).select("id", "v", "h").dropDuplicates(["h", "v", "id"]).drop("h")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of one length as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        yield dim, batch.filter(pa.array(sizes == dim))


_phi = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)), otypes=[float])


class Model:
    """What was fitted, by length of vectors: how many rows there are, the sample and W. Functions follow from the seed."""

    def __init__(self, counts: dict[int, int], samples: dict[int, np.ndarray], k: int, tables: int, width: float, target: float, most: int):
        self.counts, self.samples, self.k, self.tables, self.target, self.most = counts, samples, k, tables, target, most
        self.w = {d: width * float(np.median(self.radii(s, d))) for d, s in samples.items()}
        self._functions: dict[int, tuple] = {}

    def radii(self, vectors: np.ndarray, dim: int) -> np.ndarray:
        """Where the k-th neighbour of each vector is expected, or nearer than that: from its distances to the sample's other vectors."""
        sample = self.samples[dim].astype(np.float64)
        rank = max(1, math.ceil(self.k * len(sample) / max(1, self.counts[dim])))
        out = np.empty(len(vectors))
        for at in range(0, len(vectors), 256):
            x = vectors[at : at + 256].astype(np.float64)
            d = np.maximum((x**2).sum(1)[:, None] + (sample**2).sum(1)[None] - 2 * x @ sample.T, 0)
            scale = (sample**2).sum(1).max()
            d[d <= 1e-9 * scale] = np.inf  # itself and its copies
            own = np.sort(d, axis=1)[:, min(rank, d.shape[1]) - 1]
            out[at : at + 256] = np.sqrt(np.where(np.isfinite(own), own, scale))
        return out

    def functions(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A, b in cells, odd multipliers) of all tables."""
        if dim not in self._functions:
            rng = np.random.default_rng([SEED, dim])
            per_table = min(16, max(2, round(math.log2(max(2, self.counts[dim])) / 2)))
            a = rng.standard_normal((self.tables, per_table, dim))
            self._functions = {dim: (a, rng.random((self.tables, per_table)), rng.integers(1, 1 << 62, (self.tables, per_table)) * 2 + 1)}
        return self._functions[dim]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """(row, table, function): where a vector lies, in cells."""
        a, b, _ = self.functions(vectors.shape[1])
        return np.einsum("nd,tfd->ntf", vectors, a) / self.w[vectors.shape[1]] + b

    def keys(self, dim: int, t: int, corners: np.ndarray) -> np.ndarray:
        """64-bit keys of buckets of table t, given by their integer corners (row, function)."""
        with np.errstate(over="ignore"):
            h = (corners.astype(np.int64) * self.functions(dim)[2][t]).sum(1).astype(np.uint64)
        return mixed(h ^ mixed(np.full(1, (dim << 8) + t + 1, dtype=np.uint64))).view(np.int64)

    def probes(self, cell: np.ndarray, dim: int, radius: float) -> list[np.ndarray] | None:
        """For each table the keys of the buckets to visit, likeliest first; None if the target is out of reach."""
        found = [self._order(cell[t], self.w[dim] / radius) for t in range(self.tables)]
        # one order over all tables; a neighbour is missed if every table misses it
        p = np.concatenate([x[0] for x in found])
        of = np.repeat(np.arange(self.tables), [len(x[0]) for x in found])
        order = np.argsort(-p, kind="stable")
        caught = np.stack([np.cumsum(np.where(of[order] == t, p[order], 0)) for t in range(self.tables)])
        enough = np.flatnonzero(1 - np.prod(1 - np.minimum(caught, 1), axis=0) >= self.target)
        if not len(enough):
            return None
        visited = np.bincount(of[order[: enough[0] + 1]], minlength=self.tables)
        return [self.keys(dim, t, np.floor(cell[t]).astype(np.int64) + found[t][1][: visited[t]]) for t in range(self.tables)]

    def _order(self, cell: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
        """(chances, steps of -1, 0, 1 for each function) of perturbed buckets, falling, until a table's share of the target is reached.

        All above a threshold are found by extending those of the first functions; the threshold falls until they do.
        """
        f = cell - np.floor(cell)
        edges = _phi(np.stack([-1 - f, -f, 1 - f, 2 - f]) * scale)
        chance = np.diff(edges, axis=0).T
        rest = np.append(np.cumprod(chance.max(1)[::-1])[::-1], 1.0)
        own, least = 1 - (1 - self.target) ** (1 / self.tables), rest[0]
        own = min(1.0, own + 0.01)
        while True:
            least /= 4
            p, steps = np.ones(1), np.zeros((1, 0), dtype=np.int8)
            for i in range(len(f)):
                p = (p[:, None] * chance[i]).ravel()
                keep = np.flatnonzero(p * rest[i + 1] >= least)
                steps = np.concatenate([np.repeat(steps, 3, axis=0)[keep], (keep % 3 - 1).astype(np.int8)[:, None]], axis=1)
                p = p[keep]
                if len(p) > 4 * self.most:
                    break
            if len(p) > self.most or p.sum() >= own or least < 1e-12:
                break
        if steps.shape[1] < len(f) or len(p) > self.most and p.sum() < own:
            return np.zeros(0), np.zeros((0, len(f)), dtype=np.int8)  # out of reach
        order = np.argsort(-p, kind="stable")
        return p[order], steps[order]


def fit(rows: DataFrame, *, k: int, sample: int = 4096, numbers: int = 1 << 22, tables: int = 2, width: float = 2.5, target: float = 0.98, most: int = 16_384) -> Model:
    """From the rows (id, v) of least hash, `sample` of them or as many as hold about `numbers` components; counts are of all rows."""
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 1
    drawn = rows.orderBy(F.xxhash64("v", "id"), "id").limit(min(sample, max(64, numbers // longest))).select("v").collect()
    samples: dict[int, list] = {}
    for r in drawn:
        samples.setdefault(len(r["v"]), []).append(r["v"])
    counts = {r["d"]: r["count"] for r in rows.groupBy(F.size("v").alias("d")).count().filter(F.col("d").isin(list(samples))).collect()} if samples else {}
    # a length with one vector in the sample says nothing about distances
    return Model(counts, {d: np.array(x, dtype=np.float32) for d, x in samples.items() if len(x) > 1}, k, tables, width, target, most)


class Parts:
    """Which part a bucket, or a share of a split one, is in."""

    def __init__(self, parts: int, split: dict[int, int]):
        self.parts = parts
        self.keys = np.array(sorted(split), dtype=np.int64)
        self.shares = np.array([split[x] for x in self.keys.tolist()], dtype=np.int64)

    def share(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.ones(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.shares[at], 1)

    def of(self, keys: np.ndarray, share: np.ndarray) -> np.ndarray:
        return (mixed(keys.view(np.uint64) + share.astype(np.uint64)) % np.uint64(self.parts)).astype(np.int64)


_ROW = "part long, kind int, key long, id long, v array<{0}>, keys binary"


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)


def _schema(v: pa.DataType) -> pa.Schema:
    return pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("key", pa.int64()), ("id", pa.int64()), ("v", v), ("keys", pa.binary())])


def bucket_sizes(rows: DataFrame, model: Model) -> DataFrame:
    """(key, n) of all tables' buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, some in by_length(batch, "v"):
                if dim in model.w:
                    cells = np.floor(model.cells(matrix(some.column("v"), dim))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([model.keys(dim, t, cells[:, t]) for t in range(model.tables)]))], names=["key"])

    return rows.select("v").mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def indexed(rows: DataFrame, model: Model, parts: Parts, kind: str) -> DataFrame:
    """Every row, once for each table, with its bucket's key and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, some in by_length(batch, "v"):
                if dim not in model.w:
                    continue
                cells = np.floor(model.cells(matrix(some.column("v"), dim))).astype(np.int64)
                salt = mixed(some.column("id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                for t in range(model.tables):
                    keys = model.keys(dim, t, cells[:, t])
                    share = (salt % parts.share(keys).astype(np.uint64)).astype(np.int64)
                    n = len(keys)
                    yield _batches([parts.of(keys, share), np.zeros(n, dtype=np.int32), keys, some.column("id"), some.column("v"), pa.nulls(n, pa.binary())], _schema(some.column("v").type))

    return rows.mapInArrow(run, _ROW.format(kind))


def asked(queries: DataFrame, model: Model, parts: Parts, kind: str) -> DataFrame:
    """A row for each query (id, v) and part that it visits, with its buckets there; part -1 for queries whose target is out of reach."""

    def visits(cell: np.ndarray, dim: int, radius: float) -> dict[int, np.ndarray]:
        probes = model.probes(cell, dim, radius)
        if probes is None:
            return {-1: np.zeros(0, dtype=np.int64)}
        keys = np.concatenate(probes)
        shares = parts.share(keys)
        every = np.repeat(keys, shares)
        nth = np.arange(len(every)) - np.repeat(np.cumsum(shares) - shares, shares)
        part = parts.of(every, nth)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        return {int(part[g[0]]): np.unique(every[g]) for g in np.split(order, cuts)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, some in by_length(batch, "v"):
                vectors = matrix(some.column("v"), dim)
                known = dim in model.w
                cells, radii = (model.cells(vectors), model.radii(vectors, dim)) if known else (None, None)
                for i in range(len(some)):
                    got = visits(cells[i], dim, radii[i]) if known else {-1: np.zeros(0, dtype=np.int64)}
                    n = len(got)
                    at = pa.array([i] * n, type=pa.int64())
                    yield _batches([list(got), [1] * n, pa.nulls(n, pa.int64()), some.column("id").take(at), some.column("v").take(at), [k.tobytes() for k in got.values()]], _schema(some.column("v").type))

    return queries.mapInArrow(run, _ROW.format(kind))


class Held:
    """The indexed rows of one part, by length."""

    def __init__(self):
        self.batches: list[pa.RecordBatch] = []
        self.rows: dict[int, tuple] | None = None

    def of(self, dim: int) -> tuple | None:
        """(keys, ids, whether they are null, vectors, squares), by key."""
        if self.rows is None:
            self.rows, found = {}, {}
            for batch in self.batches:
                for d, some in by_length(batch, "v"):
                    found.setdefault(d, []).append(some)
            self.batches = []
            for d, some in found.items():
                keys = np.concatenate([b.column("key").fill_null(0).to_numpy(zero_copy_only=False) for b in some])
                ids = np.concatenate([b.column("id").fill_null(0).to_numpy(zero_copy_only=False) for b in some])
                null = np.concatenate([b.column("id").is_null().to_numpy(zero_copy_only=False) for b in some])
                x = np.concatenate([matrix(b.column("v"), d) for b in some])
                order = np.argsort(keys, kind="stable")
                self.rows[d] = keys[order], ids[order], null[order], x[order], (x[order] ** 2).sum(1)
        return self.rows.get(dim)


def nearest(held: tuple, query: int, vector: np.ndarray, keys: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, null, distances) of the k nearest rows in the buckets `keys` (None: in all) that are not the query's own; ties by id, null last."""
    own_keys, ids, null, x, squares = held
    if keys is None:
        at = np.arange(len(ids))
    else:
        low, high = np.searchsorted(own_keys, keys, "left"), np.searchsorted(own_keys, keys, "right")
        sizes = high - low
        at = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
    at = at[null[at] | (ids[at] != query)]
    # a product rules out what is clearly farther; what may be among the nearest is measured exactly. A row is met once in each table
    square, most = float(vector @ vector), 4 * k
    many = 4 * len(at) > len(x)
    rough = squares[at] + square - 2 * ((x @ vector)[at] if many else x[at] @ vector)
    slack = 1e-9 * (squares[at].max(initial=0) + square)
    while True:
        near = at[rough <= np.partition(rough, most - 1)[most - 1] + slack] if len(at) > most and np.isfinite(rough).all() else at
        distance = np.sqrt(((x[near] - vector) ** 2).sum(1))
        order = np.lexsort((ids[near], null[near], distance))
        _, firsts = np.unique(np.stack([ids[near[order]], null[near[order]]]), axis=1, return_index=True)
        if len(firsts) >= k or len(near) == len(at):
            order = order[np.sort(firsts)[:k]]
            return ids[near[order]], null[near[order]], distance[order]
        most *= 4


def visited(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): what each query finds in each part that it visits. Of a part the index comes first and is held, queries stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, Held()
        for batch in batches:
            parts, kinds = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            out: list[tuple] = []
            cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                some = batch.slice(begin, end - begin)
                if not len(some):
                    continue
                if parts[begin] != part:
                    part, held = parts[begin], Held()
                if kinds[begin] == 0:
                    held.batches.append(some)
                    continue
                for dim, asking in by_length(some, "v"):
                    if (rows_of := held.of(dim)) is None:
                        continue
                    for query, vector, keys in zip(asking.column("id").to_pylist(), matrix(asking.column("v"), dim), asking.column("keys").to_pylist(), strict=True):
                        ids, null, d = nearest(rows_of, query, vector, None if keys is None else np.frombuffer(keys, dtype=np.int64), k)
                        out.append((np.full(len(ids), query), pa.array(ids, mask=null), d))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out])), pa.concat_arrays([o[1] for o in out]), pa.array(np.concatenate([o[2] for o in out]))], names=["query_id", "vec_id", "score"])

    dealt = rows.repartition("part").sortWithinPartitions("part", "kind", "key")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def everywhere(rows: DataFrame, queries: DataFrame, parts: int) -> DataFrame:
    """The exact way: every row in one of `parts`, each query (id, v) in all of them, without keys."""
    own = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(parts)).alias("part"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("key"), "id", "v", F.lit(None).cast("binary").alias("keys"))
    all_parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part")
    return own.unionByName(queries.select(all_parts, F.lit(1).alias("kind"), F.lit(None).cast("long").alias("key"), "id", "v", F.lit(None).cast("binary").alias("keys")))


def merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of what all tables and parts found."""
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", F.asc_nulls_last("vec_id")))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, is_query: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, per: int = 8192, **fitted) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors where is_query holds its k nearest others found, by Euclidean distance."""
    prepare(vectors.sparkSession)
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    good = vectors.filter(usable(F.col(vector))).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("asks"))
    rows = stored(representatives(good.select("id", "v"), k), "vectors")
    queries = stored(good.filter("asks AND id IS NOT NULL").select("id", "v").distinct(), "queries")
    model = fit(rows, k=k, **fitted)
    total = model.tables * sum(model.counts.values())
    per = max(1, min(per, (1 << 22) // max([1, *model.w])), -(-total // MOST_SPLIT))
    sizes = bucket_sizes(rows, model).filter(F.col("n") > per)
    split = {r["key"]: -(-r["n"] // per) for r in sizes.collect()}  # fewer than MOST_SPLIT
    parts = Parts(max(1, -(-2 * total // per)), split)
    plans = stored(asked(queries, model, parts, kind), "visits")
    found = stored(visited(indexed(rows, model, parts, kind).unionByName(plans.filter("part >= 0")), k), "found")
    first = merged(found, k)
    enough = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
    rest = stored(queries.join(enough, "id", "left_anti"), "rest")
    if rest.isEmpty():
        return first
    again = visited(everywhere(rows, rest, max(1, -(-rows.count() // per))), k)
    return merged(found.unionByName(again), k)


def op12_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
