"""Near-duplicate detection: fast similarity sketches, banding, exact verification.

1. One pass over the texts makes each document's set of n-word shingles, the set's 128-bit digest, the sketch's band
   keys and its signature, a byte of each coordinate. Equal sets are one class from here on: thousands of copies are one row.
2. Classes that share a band key meet. Tasks combine some thousand classes at a time and send one class, the leader, for
   each band key on, so a key that a third of all rows have is a few rows where it is shuffled. A leader is the class of least random
   rank, so a class that meets a group in many bands meets few leaders there.
3. Links are verified in three turns: every class with the leader that its signature agrees with best; then, where
   the classes of a band are still of several components, one class of each with one of them; then what is left: the pairs of
   classes that share a band, are of different components and that sizes and signatures do not rule out span clusters, and a cluster's
   classes are compared on full sets, in groups of two chunks. Groups of near copies are largely one component after the
   first two turns, whose cost is linear; in the last one no group grows with the data, and groups give spanning forests, not
   pairs. All links are found, as each is inside a component or inside a cluster.
4. Components of the links give each class its component, and each document the least id in it.

Recall: with 32 bands of 4 coordinates a pair of similarity 0.8 shares no band with probability (1 - 0.8^4)^32 < 5e-8, and
its signatures agree in less than 0.8 - 0.28 of 128 places with probability < 3e-9. All else is exact, on 64-bit hashes of shingles.
Full sets move only for classes that meet another, found in a second pass over the texts.

Skew: keys that hold more than 1/4096 of the rows (so fewer than 4096) are joined by broadcast or in parts of 64 rows.

Defined cases: null and blank texts have an empty set and are linked with nothing, not even each other; a text with
fewer than n words is one shingle; repeated rows are copies; a null id counts only where a component has no other, and
then each such row is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, hot_keys, map_texts, slices, stored, table
from .components import Forest, components
from .sketch import WordHashes, band_keys, fast_sketches, mixed, shingle_sets

BANDS, ROWS, SLACK = 32, 4, 0.28


def _digest(elements: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(elements.tobytes())


def sketched(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """(doc_id, n_shingles, key, bands, sig): the set's digest, its band keys and signature; null for empty sets."""

    def make():
        hashes = WordHashes()

        def f(texts: list[bytes | None]) -> list:
            sets = shingle_sets(texts, n, hashes)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list[bytes | None] = [None] * len(sets)
            bands: list[bytes | None] = [None] * len(sets)
            sigs: list[bytes | None] = [None] * len(sets)
            rows: dict[bytes, list[int]] = {}
            for i in full:
                keys[i] = _digest(sets[i])
                rows.setdefault(keys[i], []).append(i)
            firsts = [v[0] for v in rows.values()]
            sketches = fast_sketches([sets[i] for i in firsts], BANDS * ROWS)
            for i, row, sig in zip(firsts, band_keys(sketches, ROWS), sketches.astype(np.uint8), strict=True):
                bands[i], sigs[i] = row.tobytes(), sig.tobytes()  # once for equal sets of a slice
            return [[len(s) for s in sets], keys, bands, sigs]

        return f

    return map_texts(docs, text, make, "n_shingles long, key binary, bands binary, sig binary", keep=[F.col(doc_id).alias("doc_id")], limit=2 << 20)


def meetings(classes: DataFrame, many: int = 8192) -> DataFrame:
    """(k, id, lead): the classes (id, bands) that share a band key k with others, each with a leader that has the key too."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bands = [], []

        def out() -> pa.RecordBatch:
            own = np.repeat(np.array(ids, dtype=np.int64), BANDS)
            rank = (mixed(own.astype(np.uint64)) >> np.uint64(33)).astype(np.int32)
            keys = np.frombuffer(b"".join(bands), dtype=np.int64)
            order = np.lexsort((rank, keys))
            own, rank, keys = own[order], rank[order], keys[order]
            begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[begins, len(keys)])
            lead, top = np.repeat(own[begins], sizes), np.zeros(len(own), dtype=bool)
            top[begins] = True
            columns = (keys, rank, own, pa.array(lead, mask=top), np.repeat(np.minimum(sizes, 2), sizes).astype(np.int8))
            return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["k", "rank", "id", "lead", "m"])

        for batch in batches:
            ids += batch.column(0).to_pylist()
            bands += batch.column(1).to_pylist()
            if len(ids) >= many:
                yield out()
                ids, bands = [], []
        if ids:
            yield out()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaders of a key come one after another, by rank; the first leads them all. The last one is held, as more may follow."""
        held = None  # key, leader, id, and whether it is out already
        for batch in batches:
            k, i, m = (batch.column(c).to_numpy() for c in ("k", "id", "m"))
            top = batch.column("lead").is_null().to_numpy(zero_copy_only=False)
            rows = [(k[~top], i[~top], batch.column("lead").drop_null().to_numpy())]
            k, i, m = k[top], i[top], m[top]
            done, own = np.zeros(len(k), dtype=bool), i
            if held:
                k, i, own, m, done = np.r_[held[0], k], np.r_[held[2], i], np.r_[held[1], own], np.r_[1, m], np.r_[held[3], done]
            if len(k):
                begins = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                sizes = np.diff(np.r_[begins, len(k)])
                first = np.repeat(own[begins], sizes)
                meets = np.repeat(sizes > 1, sizes) | (m > 1)
                new = meets & ~done
                rows.append((k[new], i[new], first[new]))
                held = (k[-1], first[-1], i[-1], bool(meets[-1] or done[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=["k", "id", "lead"])

    sent = classes.select("id", "bands").mapInArrow(combine, "k long, rank int, id long, lead long, m tinyint")
    # a leader (lead is null) goes where its key does, its followers anywhere
    return sent.repartition(F.when(F.col("lead").isNull(), F.col("k")).otherwise(F.xxhash64("k", "id"))).sortWithinPartitions("k", "rank").mapInArrow(link, "k long, id long, lead long")


def agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(1)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), BANDS * ROWS)


def least_agreement(percent: int) -> int:
    return max(0, int((percent / 100 - SLACK) * BANDS * ROWS))


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, agree): the pairs that sizes and signatures do not rule out."""
    least = least_agreement(percent)
    pairs = stored(pairs.distinct(), "pairs")
    of = lambda c: classes.select(F.col("id").alias(c), F.struct("n", "sig").alias(f"_{c}"))
    both = pairs
    for c in ("a", "b"):
        both = hot_join(both, of(c), c, hot_keys(pairs, c))
    fits = 100 * F.least("_a.n", "_b.n") >= percent * F.greatest("_a.n", "_b.n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                agree = agreements(_signatures(batch.column(2)), _signatures(batch.column(3)))
                good = pa.array(agree >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good), pa.array(agree).filter(good)], names=["a", "b", "agree"])

    return both.filter(fits).select("a", "b", F.col("_a.sig").alias("sa"), F.col("_b.sig").alias("sb")).mapInArrow(run, "a long, b long, agree long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, *, rows: int = 64, parts: int = 4096) -> DataFrame:
    """(a, b): the pairs (a written table) that are links, by exact intersections of their full sets (id, elements).

    A class of many pairs is sent once for each `rows` of them, so that no task gets all.
    """
    pairs = pairs.select("a", "b")
    full = pairs
    for c, other in (("b", "a"), ("a", "b")):
        counts = pairs.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias("n"))
        hot = counts.filter((F.col("n") > rows) & (F.col("n") > pairs.agg(F.count(F.lit(1)) / parts).scalar()))
        hot = hot.select("id", F.ceil(F.col("n") / rows).cast("int").alias("wide"))  # fewer than `parts`
        wide = F.coalesce("wide", F.lit(1))
        full = full.join(F.broadcast(hot.withColumnRenamed("id", c)), c, "left").withColumn("part", F.pmod(F.xxhash64(other), wide.cast("long")).cast("int")).drop("wide")
        spread = sets.join(F.broadcast(hot), "id", "left").select(F.col("id").alias(c), F.col("elements").alias(f"elements_{c}"), F.explode(F.sequence(F.lit(0), wide - 1)).alias("part"))
        full = full.join(spread, [c, "part"]).drop("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(len(batch), dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in (0, 1)], names=["a", "b"])

    return full.select("a", "b", "elements_a", "elements_b").mapInArrow(run, "a long, b long")


def still_open(met: DataFrame, labels: DataFrame, hot: DataFrame) -> DataFrame:
    """(k, id, comp, m): the classes of band keys whose classes are of several components, and how many there are."""
    state = met.select("k", "id").join(labels.select(F.col("node").alias("id"), "label"), "id", "left").select("k", "id", F.coalesce("label", "id").alias("comp"))
    state = stored(state, "met-components")
    several = state.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo <> hi").select("k", "m")
    return stored(hot_join(state, several, "k", hot).filter("m IS NOT NULL"), "open")


def one_for_each(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(a, b): in each band key, a class of every component with the class of one of them."""
    heads = stored(rows.groupBy("k", "comp").agg(F.min_by("id", F.xxhash64("id", "k")).alias("b")), "heads")
    tops = heads.groupBy("k").agg(F.min_by("b", F.xxhash64("comp", "k")).alias("a"))
    return hot_join(heads, tops, "k", hot).filter("a <> b").select("a", "b")


def plausible(rows: DataFrame, classes: DataFrame, percent: int, chunk: int) -> DataFrame:
    """(a, b): edges that span the pairs of classes that share a band key, are of different components and not ruled out.

    A key's classes are cut into chunks of about `chunk`. First each chunk gives a spanning forest of its pairs; then, where a key's
    chunks are not spanned as one by that, every two chunks give a forest between what is spanned. No group grows with the data, and all
    of them together give about a row for each of their classes.
    """
    cut = rows.withColumn("chunks", F.ceil(F.col("m") / chunk)).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    full = stored(cut.join(classes.select("id", "n", "sig"), "id"), "open-classes")
    each = full.select("k", F.col("chunk").alias("x"), F.col("chunk").alias("y"), "chunk", "id", F.col("id").alias("node"), "comp", "n", "sig")
    inner = stored(_forests(each, percent), "plausible")
    wide = full.filter("chunks > 1")
    if wide.isEmpty():
        return inner
    spanned = components(inner).select(F.col("node").alias("id"), "label")
    wide = stored(wide.join(spanned, "id", "left").withColumn("node", F.coalesce("label", "id")), "wide-bands")
    several = wide.groupBy("k").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("k", F.lit(True).alias("apart"))
    apart = hot_join(wide, several, "k", hot_keys(wide, "k")).filter("apart").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1))).filter("o <> chunk")
    outer = _forests(apart.select("k", F.least("chunk", "o").alias("x"), F.greatest("chunk", "o").alias("y"), "chunk", "id", "node", "comp", "n", "sig"), percent)
    return stored(inner.unionByName(outer), "plausible")


def _forests(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) for each group (k, x, y): a spanning forest, over the nodes, of the pairs of its rows that are of different components and
    nodes, of the two chunks (if it has two), and not ruled out."""
    least = least_agreement(percent)

    def forest(t: pa.Table, g: np.ndarray) -> pa.RecordBatch:
        side, comp, n, node, two = (t[c].to_numpy() for c in ("chunk", "comp", "n", "node", "x"))
        two, sig = two != t["y"].to_numpy(), _signatures(t["sig"].combine_chunks())
        a, b = [], []
        for d in range(1, len(g)):
            i = np.flatnonzero(g[d:] == g[:-d])
            if not len(i):
                break
            j = i + d
            ok = (comp[i] != comp[j]) & (node[i] != node[j]) & (~two[i] | (side[i] != side[j])) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            i, j = i[ok], j[ok]
            good = agreements(sig[i], sig[j]) >= least
            a.append(i[good])
            b.append(j[good])
        a, b = (np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in (a, b))
        # one number for each node of a group
        _, first, of = np.unique(np.stack([g, node]), axis=1, return_index=True, return_inverse=True)
        of = of.ravel()
        a, b, root = of[a], of[b], np.arange(len(first))
        while len(a):  # the least node that each is joined to
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
            differ = root[a] != root[b]
            a, b = a[differ], b[differ]
        joined = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(node[first[root[joined]]]), pa.array(node[first[joined]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            key = np.stack([t[c].to_numpy() for c in ("k", "x", "y")])
            new = np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)]
            last = int(np.flatnonzero(new)[-1])
            rest = t.slice(last)
            if last:
                yield forest(t.slice(0, last), np.cumsum(new)[:last])
        if rest is not None:
            yield forest(rest, np.zeros(len(rest), dtype=np.int64))

    keys = ["k", "x", "y"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def linked(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of sets with 100 * intersection >= percent * union, by exact counts."""
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    if len(a) * len(b) <= 256:
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                if 100 * min(na[i], nb[j]) >= percent * max(na[i], nb[j]):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (na[i] + nb[j] - both):
                        yield i, j
        return
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
    counts = np.zeros((len(a), len(b)), dtype=np.float32)
    places = [[np.searchsorted(shared, x[np.isin(x, shared, assume_unique=True)]) for x in side] for side in (a, b)]
    width = 4096
    for start in range(0, len(shared), width):
        dense = []
        for side in places:
            m = np.zeros((len(side), width), dtype=np.float32)
            for i, p in enumerate(side):
                lo, hi = np.searchsorted(p, [start, start + width])
                m[i, p[lo:hi] - start] = 1
            dense.append(m)
        counts += dense[0] @ dense[1].T
    both = np.rint(counts).astype(np.int64)
    yield from zip(*np.nonzero(100 * both >= percent * (na[:, None] + nb[None, :] - both)), strict=True)


def verified_edges(members: DataFrame, percent: int) -> DataFrame:
    """A spanning forest of the links in every group of two chunks. members: (cluster, x, y, chunk, id, elements).

    Groups give no pairs, and at most a row for each class in them.
    """

    def forest_of(rows: list[tuple]) -> pa.RecordBatch:
        x, y = rows[0][1], rows[0][2]
        unique = {r[4]: r for r in rows}  # a class may come from several tasks
        sides = [sorted((r for r in unique.values() if r[3] == c), key=lambda r: r[4]) for c in (x, y)]
        sets = [[np.frombuffer(r[5], dtype=np.uint64) for r in side] for side in sides]
        forest = Forest()
        if sides[0] and sides[1]:
            for i, j in linked(sets[0], sets[1], percent):
                if sides[0][i][4] != sides[1][j][4]:
                    forest.join(sides[0][i][4], sides[1][j][4])
        return forest.edges()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][:3] != row[:3]:
                    if len(group) > 1:
                        yield forest_of(group)
                    group = []
                group.append(row)
        if len(group) > 1:
            yield forest_of(group)

    keys = ["cluster", "x", "y"]
    return members.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "chunk", "id", "elements").mapInArrow(run, "a long, b long")


def rest_of_links(edges: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, chunk: int, bits: int, *, size: int = 16 << 20) -> DataFrame:
    """(a, b): a spanning forest of the links inside the components of plausible edges, on full sets.

    A component is cut into chunks of `chunk` classes, or so many more that there are 32, up to 8 * chunk, and of about `size` bytes at
    most; every two are one group.
    """
    clusters = stored(components(edges).withColumnRenamed("node", "id").join(classes.select("id", "n"), "id"), "clusters")
    rows = F.count(F.lit(1))
    per = F.greatest(F.lit(chunk), F.least(F.lit(8 * chunk), F.ceil(rows / 32).cast("int")))
    sizes = clusters.groupBy("label").agg(F.greatest(F.ceil(rows / per), F.ceil(F.sum("n") * 8 / size)).cast("int").alias("chunks"))
    named = stored(hot_join(clusters, sizes, "label", hot_keys(clusters, "label")).select("id", F.col("label").alias("cluster"), "chunks"), "clustered")
    given = among(sets, "id", named.select("id"), bits).join(named, "id").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks").cast("long")).cast("int"))
    pairs = given.select("cluster", "id", "chunk", "elements", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o"))
    return verified_edges(pairs.select("cluster", F.least("chunk", "o").alias("x"), F.greatest("chunk", "o").alias("y"), "chunk", "id", "elements"), percent)


def full_sets(docs: DataFrame, doc_id: str, text: str, n: int, wanted: DataFrame, bits: int) -> DataFrame:
    """(key, elements) of documents whose id is, or may be, in the one column of `wanted`; each key once."""
    given = among(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")), "doc_id", wanted, bits).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sent = WordHashes(), set()
        for batch in batches:
            for _, texts in slices(batch.column(0), 2 << 20):
                sets = {k: s for s in shingle_sets(texts, n, hashes) if len(s) and (k := _digest(s)) not in sent}
                sent = (sent if len(sent) < 500_000 else set()) | set(sets)
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), type=pa.binary()), pa.array([s.tobytes() for s in sets.values()], type=pa.binary())], names=["key", "elements"])

    return given.mapInArrow(run, "key binary, elements binary").groupBy("key").agg(F.first("elements").alias("elements"))


def among(rows: DataFrame, column: str, ids: DataFrame, bits: int) -> DataFrame:
    """The rows whose value is in the one column of ids (null values stay if ids has null), with some more by chance: ids that fill at
    most an eighth of `bits` flags are sent as a bit map; more are joined, which shuffles the rows."""
    size = 1 << max(16, (16 * ids.count()).bit_length())
    if size > bits:
        return rows.join(ids.select(F.col(ids.columns[0]).alias("_id")).distinct(), F.col(column).eqNullSafe(F.col("_id")), "left_semi")
    return rows.filter(flagged(F.col(column), ids, size))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, chunk: int = 64, bits: int = 1 << 26, few: int = 1 << 14) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; see the module for what counts as a link."""
    return grouped(docs, doc_id, text, n, percent, chunk, bits, few).select("doc_id", "n_shingles", "component_id")


def linked_classes(classes: DataFrame, sets: DataFrame, met: DataFrame, percent: int, chunk: int, bits: int, few: int) -> DataFrame:
    """(node, label): the components of the links between the classes that meet. The second turn only saves work in the third, so
    it is left out where at most `few` rows are open."""
    first = likely(met.filter("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")), classes, percent)
    first = stored(first.groupBy("b").agg(F.max_by("a", F.struct("agree", "a")).alias("a")), "stars")
    labels = stored(components(verified(first, sets, percent)), "labels")
    hot = stored(hot_keys(met, "k"), "hot-bands")
    rows = still_open(met, labels, hot)
    if rows.count() > few:
        pairs = stored(likely(one_for_each(rows, hot), classes, percent), "likely")
        near = among(sets, "id", pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), bits)
        labels = stored(components(_stars(labels).unionByName(verified(pairs, near, percent))), "labels")
        rows = still_open(met, labels, hot)
    if rows.isEmpty():
        return labels
    more = rest_of_links(plausible(rows, classes, percent, 4 * chunk), classes, sets, percent, chunk, bits)
    return stored(components(_stars(labels).unionByName(more)), "labels")


def _stars(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("node").alias("a"), F.col("label").alias("b"))


def grouped(docs: DataFrame, doc_id: str, text: str, n: int, percent: int, chunk: int = 64, bits: int = 1 << 26, few: int = 1 << 14) -> DataFrame:
    """As near_duplicates, with the set's digest `key` and `first`: is this the component's first set, by least id, then digest?"""
    found = stored(sketched(docs, doc_id, text, n), "sketches")
    classes = found.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"), F.max("bands").alias("bands"), F.max("sig").alias("sig"), F.max("n_shingles").alias("n"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    met = stored(meetings(classes), "meetings")
    wanted = stored(classes.select("id", "key", "least").join(met.select("id").distinct(), "id", "left_semi"), "wanted")
    sets = stored(full_sets(docs, doc_id, text, n, wanted.select("least"), bits).join(wanted.select("id", "key"), "key").select("id", "elements"), "sets")
    labels = linked_classes(classes.select("id", "n", "sig"), sets, met, percent, chunk, bits, few)
    named = classes.select("id", "key", "least").join(labels.withColumnRenamed("node", "id"), "id", "left")
    named = stored(named.select("key", "least", "label"), "named")
    whole = stored(named.filter("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("component_id"), F.min(F.struct(F.col("least").isNull(), "least", "key")).alias("head")), "least")
    joined = hot_join(named.filter("label IS NOT NULL"), whole, "label", hot_keys(named.filter("label IS NOT NULL"), "label")).select("key", "component_id", (F.col("key") == F.col("head.key")).alias("first"))
    by_key = stored(named.filter("label IS NULL").select("key", F.col("least").alias("component_id"), F.lit(True).alias("first")).unionByName(joined), "by-key")
    alone = found.filter("key IS NULL").select("doc_id", "n_shingles", "key", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    full = found.filter("key IS NOT NULL").select("doc_id", "n_shingles", "key")
    return hot_join(full, by_key, "key", hot_keys(full, "key")).select("doc_id", "n_shingles", "key", "component_id", "first").unionByName(alone)


def flagged(column, ids: DataFrame, bits: int):
    """A Column: may the value be among the one column of ids? One bit map of fixed size, no join. Never wrong for a no."""
    at = F.pmod(F.xxhash64(ids.columns[0]), F.lit(bits))
    words = ids.select((at / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    dense = ids.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("w")).join(words, "w", "left").select(F.struct("w", F.coalesce("m", F.lit(0).cast("long")).alias("m")).alias("s"))
    flags = stored(dense.agg(F.sort_array(F.collect_list("s")).alias("s")).select(F.col("s.m").alias("flags")), "flags").scalar()
    here = F.pmod(F.xxhash64(column), F.lit(bits))
    return F.call_function("shiftrightunsigned", F.get(flags, (here / 64).cast("int")), (here % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with their columns, one for each group of near copies: a row with the group's least id.

    Rows are told apart by id and set of shingles, so an id on several texts loses none that is no copy, and rows
    without an id count as all others. Texts without words are no copies, but for equal ones under one id. Only rows
    that may have to go are joined, so the texts of all others are not shuffled.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, body = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    found = stored(grouped(plain, key, body, n, percent), "groups")
    stays = F.col("key").isNull() | (F.col("first") & F.col("doc_id").eqNullSafe(F.col("component_id")))
    known = found.filter("doc_id IS NOT NULL")
    repeated = known.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    doubtful = stored(known.filter(~stays).select("doc_id").unionByName(repeated).distinct(), "doubtful")
    may = F.col(key).isNull() | flagged(F.col(key), doubtful, 1 << min(26, max(16, (16 * doubtful.count()).bit_length())))
    marked = plain.withColumn("may", may)
    sure = marked.filter("NOT may").drop("may")
    rest = map_texts(marked.filter("may").drop("may"), body, lambda: _keys(n), "set binary", limit=2 << 20)
    heads = found.filter(F.col("key").isNotNull() & stays).select("doc_id", "key").distinct()
    # one row for each id and set first, combined map-side, so that the join has no hot key
    full = rest.filter("set IS NOT NULL").dropDuplicates([key, "set"])
    full = full.join(heads, F.col(key).eqNullSafe(F.col("doc_id")) & (F.col("set") == F.col("key")), "left_semi").select(*plain.columns)
    blank = rest.filter("set IS NULL").select(*plain.columns)
    equal = blank.filter(F.col(key).isNotNull()).withColumn("digest", F.sha2(F.coalesce(body, F.lit("")), 256)).dropDuplicates([key, "digest"]).drop("digest")
    return sure.unionByName(full).unionByName(equal).unionByName(blank.filter(F.col(key).isNull())).toDF(*names)


def _keys(n: int):
    """As sketched(): the digest of each text's set, None for empty ones."""
    hashes = WordHashes()
    return lambda texts: [[_digest(s) if len(s) else None for s in shingle_sets(texts, n, hashes)]]


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"), n=4)
    return got.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: All pairs by their common shingles, then the transitive closure of links.
OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
x AS (SELECT a.r AS p, b.r AS q, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
e AS (SELECT p, q FROM x JOIN n na ON na.r = p JOIN n nb ON nb.r = q WHERE 100 * k >= 80 * (na.n + nb.n - k)),
reach AS (SELECT r AS p, r AS q FROM d UNION SELECT reach.p, e.q FROM reach JOIN e ON reach.q = e.p),
c AS (SELECT p, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.q GROUP BY p)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN c ON c.p = d.r LEFT JOIN n ON n.r = d.r
"""
