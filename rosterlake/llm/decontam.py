"""Benchmark decontamination by suffix arrays.

Every task turns its documents, some MB at a time, into a shard: one array of word ids with the array of its suffixes,
sorted by as many words as a window has. Every suffix of the test items is binary-searched in each shard; the interval
found holds all verbatim occurrences and where they lie. Each is extended from where the match begins (what goes on to the left is part of a
longer one): the items' suffixes are sorted too, so the places of a window are neighbours there, and those that go on as the document does
are found by halving, whatever number of items share the window. The longest match is kept with its place.

The plan is one narrow stage over the documents: no shuffle of texts, so no key can be hot. The test items are written to
the shared folder by Spark in blocks of about `block_words` words; a task searches a shard for one block after another and
holds one block at a time, and the driver none.

Only suffixes that can match stand in a shard's array: those where as many known words follow as the shortest
window has. Leaving out the rest loses nothing.

Defined cases: null and empty texts have no words and are never hit; items without words have no windows; a null
item_id is listed as "null"; repeated items or documents count each on their own rows, items once by id; of longest
matches of one length the one of the item last by name counts, and there the first place; an empty
benchmark leaves every document clean; other columns pass through unread.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_uri, map_texts, noted, prepare, shared_dir, table

#: A-Z become a-z; what is neither a digit, a letter nor beyond ASCII becomes a blank.
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def item_words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class TestBlock:
    """Suffixes of one block of test items, ready to be searched for."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.window, self.ids, self.names = window, {}, []
        found: dict[tuple, set[int]] = {}
        self.lefts: dict[tuple, set[int]] = {}  # by window, the words before it in the items (0: none)
        rows, places = [], []
        for name, text in items:
            row = [self.ids.setdefault(w, len(self.ids) + 1) for w in item_words(text)]
            if not row:
                continue
            k = len(self.names)
            self.names.append(name)
            rows.append(row)
            n = min(window, len(row))
            for i in range(len(row) - n + 1):
                found.setdefault(key := tuple(row[i : i + n]), set()).add(k)
                self.lefts.setdefault(key, set()).add(row[i - 1] if i else 0)
                places.append((key, k, i))
        self._sort(rows, places)
        self.windows = {n: [x for x in found if len(x) == n] for n in sorted({len(x) for x in found})}
        #: By window, which of owner_sets has its items; windows of a passage that items share have one.
        ids: dict[frozenset, int] = {}
        self.owners = {x: ids.setdefault(frozenset(v), len(ids)) for x, v in found.items()}
        self.owner_sets = [frozenset(self.names[k] for k in v) for v in ids]

    def packed(self, rows: np.ndarray) -> np.ndarray:
        """Rows of ids as byte strings that sort as the rows do."""
        return np.ascontiguousarray(rows, dtype=">u4").view(f"S{4 * self.window}").ravel()

    def search(self, ids: np.ndarray) -> list[tuple[tuple, np.ndarray]]:
        """(window, its positions) for the windows that occur in ids, where 0 parts documents and stands for unknown words."""
        if not len(ids) or not self.windows:
            return []
        stops = np.flatnonzero(ids == 0)
        at = np.arange(len(ids))
        until = np.append(stops, len(ids))[np.searchsorted(stops, at)]
        starts = np.flatnonzero(until - at >= min(self.windows))
        if not len(starts):
            return []
        rows = np.zeros((len(starts), self.window), dtype=np.int64)
        for j in range(self.window):
            here = starts + j
            rows[:, j] = np.where(here < until[starts], ids[np.minimum(here, len(ids) - 1)], 0)
        keys = self.packed(rows)
        order = np.argsort(keys, kind="stable")
        suffixes, starts = keys[order], starts[order]
        out = []
        for n, windows in self.windows.items():
            low = np.zeros((len(windows), self.window), dtype=np.int64)
            low[:, :n] = windows
            high = low.copy()
            high[:, n:] = 0xFFFFFFFF
            a = np.searchsorted(suffixes, self.packed(low), "left")
            b = np.searchsorted(suffixes, self.packed(high), "right")
            out += [(windows[i], starts[a[i] : b[i]]) for i in np.flatnonzero(b > a)]
        return out

    def _sort(self, rows: list[list[int]], places: list[tuple]) -> None:
        """The items' words in one array, each item followed by a number of its own, with its suffixes in order; where each window's stand."""
        known, sizes = len(self.ids), np.array([len(r) + 1 for r in rows], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        self.words = np.zeros(int(sizes.sum()), dtype=np.int64)
        self.item = np.repeat(np.arange(len(rows)), sizes)
        for k, r in enumerate(rows):
            self.words[begins[k] : begins[k] + len(r)] = r
            self.words[begins[k] + len(r)] = known + 1 + k
        self.order = sorted_suffixes(self.words)
        rank = np.empty_like(self.order)
        rank[self.order] = np.arange(len(self.order))
        self.span: dict[tuple, tuple[int, int]] = {}
        for key, k, i in places:
            at = int(rank[begins[k] + i])
            low, high = self.span.get(key, (at, at))
            self.span[key] = min(low, at), max(high, at)
        by_name = {n: j for j, n in enumerate(sorted(set(self.names)))}
        self.name_rank = np.array([by_name[n] for n in self.names], dtype=np.int64)
        self.by_rank = sorted(by_name)

    def longest(self, ids: np.ndarray, at: int, key: tuple) -> tuple[int, str]:
        """The longest match from position `at` on, which holds a window, over all its places in the items, and the last item by name that has it.

        The places are neighbours in the order of suffixes; word by word those that go on alike are told apart by halving.
        """
        low, high = self.span[key]
        high += 1
        n = len(key)
        while high - low > 1 and at + n < len(ids) and ids[at + n]:
            word = int(ids[at + n])
            behind = lambda j: int(self.words[self.order[j] + n])  # noqa: B023, E731  used before n changes
            a = bisect_left(range(low, high), word, key=behind) + low
            b = bisect_right(range(low, high), word, key=behind) + low
            if a == b:
                break
            low, high, n = a, b, n + 1
        if high - low == 1:
            part, row = ids[at + n :], self.words[self.order[low] + n :]
            size = min(len(part), len(row), 64)
            while True:
                differ = np.flatnonzero(part[:size] != row[:size])
                if len(differ) or size == min(len(part), len(row)):
                    break
                size = min(len(part), len(row), size * 4)
            n += int(differ[0]) if len(differ) else size
        return n, self.by_rank[int(self.name_rank[self.item[self.order[low:high]]].max())]


def sorted_suffixes(words: np.ndarray) -> np.ndarray:
    """Where the suffixes of an array begin, in order, by prefix doubling."""
    if not len(words):
        return np.zeros(0, dtype=np.int64)
    rank, step = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while True:
        second = np.full(len(words), -1, dtype=np.int64)
        second[:-step] = rank[step:]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        new = np.r_[0, np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))]
        if new[-1] == len(words) - 1 or step >= len(words):
            return order
        rank = np.empty_like(rank)
        rank[order] = new
        step *= 2


class Shard:
    """Word ids of some documents for one block, each followed by 0, and what the block's windows hit in them."""

    def __init__(self, block: TestBlock, rows: list[list[bytes]], sizes: np.ndarray, begins: np.ndarray):
        get = block.ids.get
        ends = begins + sizes + 1
        ids = np.zeros(int(ends[-1]), dtype=np.int64)
        for r, a in zip(rows, begins.tolist(), strict=True):
            if r:
                ids[a : a + len(r)] = np.fromiter((get(w, 0) for w in r), dtype=np.int64, count=len(r))
        self.edge = np.zeros(len(ids) + 1, dtype=np.int64)
        self.best: dict[int, tuple[int, str, int]] = {}
        owners: dict[int, set[int]] = {}
        for key, at in block.search(ids):
            np.add.at(self.edge, at, 1)
            np.add.at(self.edge, at + len(key), -1)
            docs, left, lefts = np.searchsorted(ends, at, side="right"), ids[at - 1], block.lefts[key]  # the last id is 0, as is the one before a document
            for d in np.unique(docs).tolist():
                owners.setdefault(d, set()).add(block.owners[key])
            # where every place of the window has the document's word before it, a longer match has begun there
            first = np.ones(len(at), dtype=bool) if len(lefts) > 1 or 0 in lefts else left != next(iter(lefts))
            for d, p in zip(docs[first].tolist(), at[first].tolist(), strict=True):
                found = (*block.longest(ids, p, key), int(begins[d]) - p)
                self.best[d] = max(self.best.get(d, found), found)
        self.items = {d: set().union(*(block.owner_sets[i] for i in own)) for d, own in owners.items()}


_held: dict[str, TestBlock] = {}  # the block that a Python worker searches for, from slice to slice and task to task


def _block(path: str, window: int) -> TestBlock:
    if path not in _held:
        _held.clear()
        store, base = fs.FileSystem.from_uri(path)
        files = [f.path for f in store.get_file_info(fs.FileSelector(base)) if f.path.endswith(".parquet")]
        items = pa.concat_tables([pq.ParquetFile(store.open_input_file(f)).read() for f in files])
        _held[path] = TestBlock(list(zip(items["name"].to_pylist(), items["text"].to_pylist(), strict=True)), window)
    return _held[path]


def _scan(paths: list[str], window: int):
    def make():
        turn = 0

        def f(texts: list[bytes | None]) -> list:
            nonlocal turn
            rows = [item_words(x) for x in texts]
            sizes = np.array([len(r) for r in rows], dtype=np.int64)
            begins = np.cumsum(sizes + 1) - sizes - 1
            hit = np.zeros(int(sizes.sum()) + len(sizes), dtype=bool)
            items: list[set[str]] = [set() for _ in texts]
            best: list[tuple[int, str | None, int]] = [(0, None, 0)] * len(texts)
            for path in reversed(paths) if turn % 2 else paths:  # the last block of a slice is the first of the next
                shard = Shard(_block(path, window), rows, sizes, begins)
                hit |= np.cumsum(shard.edge[:-1]) > 0
                for d, found in shard.items.items():
                    items[d] |= found
                for d, found in shard.best.items():
                    best[d] = found if best[d][1] is None else max(best[d], found)
            turn += 1
            total = np.concatenate([[0], np.cumsum(hit)])
            return [sizes, total[begins + sizes] - total[begins], [sorted(x) for x in items], [b[0] for b in best], [b[1] for b in best], [-b[2] if b[0] else None for b in best]]

        return f

    return make


_FIELDS = "n_words long, n_hit long, items array<string>, longest long, longest_item string, longest_at long"


def write_blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> list[str]:
    """Writes the test items (name, text) to the shared folder, dealt by hash to blocks of about block_words words."""
    spark = benchmark.sparkSession
    prepare(spark)
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("name"), F.col(text).cast("string").alias("text"))
    words = items.agg(F.coalesce(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))), F.lit(0))).first()[0]
    blocks = max(1, -(-words // block_words))
    root = f"{as_uri(shared_dir(spark))}/test-items-{uuid.uuid4().hex}"
    dealt = items.select("name", F.col("text").cast("binary"), F.pmod(F.xxhash64("name", "text"), F.lit(blocks)).alias("block"))
    dealt.repartition("block").write.partitionBy("block").parquet(root)
    noted(root)
    return [f"{root}/block={r[0]}" for r in dealt.select("block").distinct().orderBy("block").collect()]


def annotate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_words: int = 1 << 17, keep: list[Column] | None = None) -> DataFrame:
    """`keep` (default: all columns of docs) with one struct column `found`: n_words, n_hit, items (sorted ids) and the
    longest verbatim match that begins with a window: its words, item and position in the document."""
    cols = [docs[c] for c in docs.columns] if keep is None else keep
    paths = write_blocks(benchmark, item_id, item_text, block_words)
    whole = docs.select(F.struct(*cols).alias("row"), F.col(text).alias("text"))
    got = map_texts(whole, "text", _scan(paths, window), _FIELDS, keep=[F.col("row")], limit=4 << 20 if len(paths) < 2 else 32 << 20)
    return got.select("row.*", F.struct(*[c.split()[0] for c in _FIELDS.split(", ")]).alias("found"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents, with their columns, in which no window of an item occurs."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    got = annotate(plain, benchmark, text=f"c{names.index(text)}", **options)
    return got.filter("found.n_hit = 0").drop("found").toDF(*names)


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, tests = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    got = annotate(docs, tests, keep=[F.col("doc_id")])
    return got.select("doc_id", F.col("found.n_words").alias("n_words"), F.col("found.n_hit").alias("n_hit"), F.size("found.items").cast("long").alias("n_items"), F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"), *[F.col(f"found.{c}").alias(c) for c in ("longest", "longest_item", "longest_at")])


#: Windows as joined words; a document word is hit if any of the windows that hold it occurs in an item. Windows that follow one
#: another in a document and in an item are one match.
OP10_SQL = r"""
WITH low AS (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
item AS (SELECT item_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
size AS (SELECT row_number() OVER () AS q, item_id, w, least(10, len(w)) AS n FROM item WHERE len(w) > 0),
place AS (SELECT q, coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, n, j, array_to_string(w[j : j + n - 1], ' ') AS k FROM (SELECT q, item_id, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM size)),
win AS (SELECT DISTINCT item_id, n, k FROM place),
doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lens)),
occ AS (SELECT r, i, p.n, item_id FROM pos p JOIN win USING (n, k)),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM occ)) GROUP BY r),
runs AS (SELECT r, q, item_id, p.n, i, i - j AS diagonal, i - row_number() OVER (PARTITION BY r, q, i - j ORDER BY i) AS run FROM pos p JOIN place USING (n, k)),
matches AS (SELECT r, item_id, min(i) - 1 AS at_, count(*) + n - 1 AS len FROM runs GROUP BY r, q, item_id, n, diagonal, run),
top AS (SELECT r, max(len) AS longest, arg_max(item_id, (len, item_id, -at_)) AS longest_item, arg_max(at_, (len, item_id, -at_)) AS longest_at FROM matches GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest, longest_item, CAST(longest_at AS BIGINT) AS longest_at
FROM doc LEFT JOIN hit USING (r) LEFT JOIN its USING (r) LEFT JOIN top USING (r)
"""
