"""Language-model scoring with a log-bilinear neural model trained by noise-contrastive estimation.

Vocabulary: all tokens of the training texts are counted by Spark. The `frequent` commonest words are classes of their
own, all others fall into `buckets` classes by a hash of their ending, the end of a text is one class. The model gives
p(class | two classes before); a word of a bucket gets (c + 1) / (sum of c + 1 in the bucket, + 1) of it, where c is its
count, so the log-probabilities are normalised over an open vocabulary.

Model: score(w | u, v) = (r_u * c1 + r_v * c2) . q_w + b_w. It is trained in numpy, by noise samples that a few tokens share, so all gradients are matrix products. Every task trains on all its texts and sends its parameters as rows;
Spark averages them by tokens. `rounds` passes see a share of the training texts each, all together see every text once;
each starts from the average of the one before. What is gathered grows with the corpus, what reaches the driver
does not: the parameters, and at most `head` commonest tokens (chosen by a threshold from a binned histogram).

Scoring: as the model is bilinear, exp(scores) factor into two matrices of the classes, and one matrix product gives
the normaliser of every pair of contexts. Tokens outside the head are joined with the full counts: one row for each
text and rare token; a head token never enters the join, so no join key is hot.

Defined cases: null and empty texts are the end token alone; without training texts N is 0, base scores are 0 and the
model is uniform over its classes; repeated rows are scored each; an empty table gives no rows; a null id is trained on.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, remainder, slices, stored, table, words

END = b"\n"  # no word holds white space
DIM, BATCH, GROUP, NOISE = 16, 4096, 64, 32
_built: dict[str, tuple] = {}  # what a Python worker keeps from task to task, for one model


def bucket(word: bytes, buckets: int) -> int:
    return zlib.crc32(word[-3:]) % buckets


def count_tokens(docs: DataFrame, text: str, most: int = 300_000) -> DataFrame:
    """(token, c): counts of all words and of the ends of texts, combined in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), type=pa.binary()), pa.array(list(counts.values()), type=pa.int64())], names=["token", "c"])

        for batch in batches:
            for _, texts in slices(batch.column(0), 1 << 20):
                for x in texts:
                    counts.update(words(x))
                counts[END] += len(texts)
                if len(counts) > most:
                    yield out()
                    counts.clear()
        yield out()

    prepare(docs.sparkSession)
    return docs.select(F.col(text).cast("binary")).mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The head of the counts with its classes, and what is needed of the rest."""

    def __init__(self, counts: DataFrame, *, head: int, frequent: int, buckets: int, head_bytes: int = 32 << 20):
        self.frequent, self.buckets, self.classes = frequent, buckets, 1 + frequent + buckets
        self.key = uuid.uuid4().hex
        by_bucket = F.crc32(F.substring("token", -3, 3)) % buckets
        sums = counts.filter(F.col("token") != END).groupBy(by_bucket.cast("int").alias("b")).agg(F.sum(F.col("c") + 1).alias("s"), F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).collect()
        self.bucket_sums = np.zeros(buckets)
        for r in sums:
            self.bucket_sums[r["b"]] = r["s"]
        ends = counts.filter(F.col("token") == END).agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        self.end_count = ends[0]
        self.tokens = sum(r["n"] for r in sums) + ends[0]
        self.types = sum(r["v"] for r in sums) + ends[1]
        # commonest words: bins of equal ratio, from the top down to the last that still fits, by number and by bytes
        fine = F.floor(F.log2("c") * 64).cast("int")
        bins = counts.filter(F.col("token") != END).groupBy(fine.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("token")).alias("bytes")).collect()
        room, bytes_left, least = head, head_bytes, None
        for r in sorted(bins, key=lambda r: -r["bin"]):
            room, bytes_left = room - r["n"], bytes_left - r["bytes"]
            if room < 0 or bytes_left < 0:
                break
            least = r["bin"]
        top = counts.filter((F.col("token") != END) & (fine >= (least if least is not None else 1 << 30))).toArrow()
        pairs = sorted(zip(top["token"].to_pylist(), top["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
        self.words = [END] + [w for w, _ in pairs]
        self.counts = np.array([self.end_count] + [c for _, c in pairs], dtype=np.float64)
        own = min(frequent, len(pairs))
        self.class_of = np.array([0] + list(range(1, own + 1)) + [1 + frequent + bucket(w, buckets) for w, _ in pairs[own:]], dtype=np.int32)
        for w, c in pairs[:own]:
            self.bucket_sums[bucket(w, buckets)] -= c + 1
        self.own = own

    def class_counts(self) -> np.ndarray:
        out = np.zeros(self.classes)
        out[: self.own + 1] = self.counts[: self.own + 1]
        out[1 + self.frequent :] = self.bucket_sums
        return out

    def lookup(self) -> tuple[dict[bytes, int], "ClassIds"]:
        """word -> place in the head, and word -> class; made once in a worker."""
        if self.key not in _built:
            _built.clear()
            _built[self.key] = ({w: i for i, w in enumerate(self.words)}, ClassIds(self))
        return _built[self.key][:2]


class ClassIds(dict):
    def __init__(self, v: Vocabulary):
        super().__init__(zip(v.words, v.class_of.tolist(), strict=True))
        self.first, self.buckets = 1 + v.frequent, v.buckets

    def __missing__(self, word: bytes) -> int:
        return self.first + bucket(word, self.buckets)


def contexts(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two before each token; 0, the end, before a text's first."""
    one, two = np.zeros_like(ids), np.zeros_like(ids)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    one[starts] = two[starts] = 0
    second = starts + 1
    two[second[second < len(ids)]] = 0
    return one, two


class Parameters:
    NAMES = ("r", "q", "b", "c1", "c2")

    def __init__(self, shares: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        n = len(shares)
        self.r = rng.normal(0, 0.3 / math.sqrt(DIM), (n, DIM)).astype(np.float32)
        self.q = rng.normal(0, 0.3 / math.sqrt(DIM), (n, DIM)).astype(np.float32)
        self.b = np.log(shares).astype(np.float32)
        self.c1, self.c2 = np.ones(DIM, dtype=np.float32), np.ones(DIM, dtype=np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            x = getattr(self, k)
            setattr(self, k, flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size


class Trainer:
    """Noise-contrastive estimation with Adagrad steps."""

    def __init__(self, p: Parameters, shares: np.ndarray, seed: int, rate: float = 0.15):
        self.p, self.rate = p, rate
        self.log_noise = np.log(NOISE * shares).astype(np.float32)
        self.edges = np.cumsum(shares)
        self.rng = np.random.default_rng(seed)
        self.squares = {k: np.full(getattr(p, k).shape, 1e-3, dtype=np.float32) for k in p.NAMES}

    def step(self, one: np.ndarray, two: np.ndarray, w: np.ndarray) -> None:
        """One step over a minibatch; every GROUP tokens share NOISE samples, so each group is two small matrix products."""
        p, n = self.p, len(self.log_noise)
        real = len(w)
        pad = -real % GROUP
        one, two, w = (np.concatenate([x, np.zeros(pad, dtype=x.dtype)]) for x in (one, two, w))
        groups = len(w) // GROUP
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random((groups, NOISE)) * self.edges[-1]), n - 1)
        r1, r2, qw, qn = p.r[one], p.r[two], p.q[w], p.q[noise]
        h = r1 * p.c1 + r2 * p.c2
        data = np.einsum("bd,bd->b", h, qw) + p.b[w] - self.log_noise[w]
        away = h.reshape(groups, GROUP, DIM) @ qn.transpose(0, 2, 1) + (p.b[noise] - self.log_noise[noise])[:, None, :]
        g0 = 1 / (1 + np.exp(np.clip(data, -30, 30)))  # 1 - sigmoid
        gk = -1 / (1 + np.exp(np.clip(-away, -30, 30)))
        if pad:
            g0[real:] = 0
            gk.reshape(-1, NOISE)[real:] = 0
        dh = g0[:, None] * qw + (gk @ qn).reshape(-1, DIM)
        d1, d2 = dh * p.c1, dh * p.c2
        dn = gk.transpose(0, 2, 1) @ h.reshape(groups, GROUP, DIM)
        at = np.arange(DIM)
        rows = lambda i: (i[:, None] * DIM + at).ravel()
        added = lambda i, x: np.bincount(rows(i), weights=x.ravel(), minlength=n * DIM).reshape(n, DIM)
        dq = added(np.concatenate([w, noise.ravel()]), np.concatenate([g0[:, None] * h, dn.reshape(-1, DIM)]))
        dr = added(np.concatenate([one, two]), np.concatenate([d1, d2]))
        db = np.bincount(w, weights=g0, minlength=n) + np.bincount(noise.ravel(), weights=gk.sum(1).ravel(), minlength=n)
        for k, g in (("r", dr), ("q", dq), ("b", db), ("c1", (dh * r1).sum(0)), ("c2", (dh * r2).sum(0))):
            g = (g / math.sqrt(real)).astype(np.float32)
            s = self.squares[k]
            s += g * g
            getattr(p, k)[...] += self.rate * g / np.sqrt(s)


def train_round(docs: DataFrame, text: str, v: Vocabulary, p: Parameters, seed: int) -> None:
    """One pass: every task trains on from p over all its texts; p becomes the average by tokens."""
    shares = (v.class_counts() + 1) / (v.class_counts() + 1).sum()
    start = p.flat()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Parameters(shares)
        own.load(start)
        _, classes = v.lookup()
        trainer, seen = Trainer(own, shares, seed), 0
        for batch in batches:
            for _, texts in slices(batch.column(0), 2 << 20):
                rows = [words(x) for x in texts]
                sizes = np.array([len(r) + 1 for r in rows])
                starts = np.cumsum(sizes) - sizes
                ids = np.zeros(int(sizes.sum()), dtype=np.int64)
                for r, at in zip(rows, starts.tolist(), strict=True):
                    ids[at : at + len(r)] = np.fromiter(map(classes.__getitem__, r), dtype=np.int64, count=len(r))
                one, two = contexts(ids, starts)
                for at in range(0, len(ids), BATCH):
                    trainer.step(one[at : at + BATCH], two[at : at + BATCH], ids[at : at + BATCH])
                seen += len(ids)
        if seen:
            flat = own.flat().astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(flat))), pa.array(np.concatenate([[seen], flat]))], names=["i", "x"])

    sums = docs.select(F.col(text).cast("binary")).mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    if not len(sums):
        return
    order = np.argsort(sums["i"].to_numpy())
    x = sums["x"].to_numpy()[order]
    p.load(x[1:] / x[0])


class Scorer:
    def __init__(self, v: Vocabulary, p: Parameters):
        self.v, self.p = v, p

    def tables(self):
        """Scores of each context class by word class, and the normaliser of each pair of contexts."""
        got = _built.get(self.v.key, ())
        if len(got) < 3:
            place, classes = self.v.lookup()
            first = (self.p.r * self.p.c1) @ self.p.q.T
            second = (self.p.r * self.p.c2) @ self.p.q.T + self.p.b
            a, b = first.max(1, keepdims=True), second.max(1, keepdims=True)  # so that no exponent overflows
            product = np.exp(first - a) @ np.exp(second - b).T
            lost = product < 1e-30  # pairs whose sum has no large term: added up one by one
            norm = np.log(np.where(lost, 1, product)) + a + b.T
            for i in np.flatnonzero(lost.any(1)):
                norm[i, lost[i]] = np.logaddexp.reduce(first[i] + second[lost[i]], axis=1)
            _built[self.v.key] = got = (place, classes, (first, second, norm))
        return got

    def __call__(self, texts: list[bytes | None]):
        """For each text: tokens, known head tokens, its sums for the base and the model; and its rare tokens."""
        place, _, (first, second, norm) = self.tables()
        v = self.v
        rows = [words(x) for x in texts]
        sizes = np.array([len(r) + 1 for r in rows])
        starts = np.cumsum(sizes) - sizes
        at = np.zeros(int(sizes.sum()), dtype=np.int64)
        get = place.get
        for r, s in zip(rows, starts.tolist(), strict=True):
            at[s : s + len(r)] = np.fromiter((get(w, -1) for w in r), dtype=np.int64, count=len(r))
        rare = np.flatnonzero(at < 0)
        ids = v.class_of[at].astype(np.int64)
        doc = np.searchsorted(starts, rare, side="right") - 1
        tails: list[Counter] = [Counter() for _ in texts]
        for i, d in zip(rare.tolist(), doc.tolist(), strict=True):
            w = rows[d][i - starts[d]]
            tails[d][w] += 1
            ids[i] = 1 + v.frequent + bucket(w, v.buckets)
        one, two = contexts(ids, starts)
        model = (first[one, ids] + second[two, ids] - norm[one, two]).astype(np.float64) / math.log(10)
        logs = np.log10(v.counts + 1)[at]
        logs[rare] = 0.0
        in_bucket = ids > v.frequent
        model += np.where(in_bucket, logs - np.log10(v.bucket_sums + 1)[np.where(in_bucket, ids - 1 - v.frequent, 0)], 0.0)
        known = (v.counts > 0)[at]
        known[rare] = False
        total = lambda x: np.add.reduceat(x, starts, dtype=np.float64)
        return sizes, total(known), total(logs), total(model), tails


def score_texts(docs: DataFrame, counts: DataFrame, scorer: Scorer, *, keep, text: str) -> DataFrame:
    """The columns `keep` with n_tokens, n_known, base_score and score."""
    v = scorer.v
    given = docs.select(F.struct(*keep).alias("row"), F.col(text).cast("binary").alias("text"))
    row_type = given.schema["row"].dataType.simpleString()
    head = f"struct<row:{row_type},n:bigint,known:double,base:double,score:double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = (TaskContext.get().partitionId() << 36) - 1
        for batch in batches:
            for at, texts in slices(batch.column(1), 2 << 20):
                n, known, base, score, tails = scorer(texts)
                ids = np.arange(rid + 1, rid + 1 + len(texts))
                rid += len(texts)
                doc = pa.StructArray.from_arrays([batch.column(0).slice(at, len(texts)), *[pa.array(x) for x in (n, known, base, score)]], names=["row", "n", "known", "base", "score"])
                yield pa.RecordBatch.from_arrays([pa.array([b" %d" % i for i in ids], type=pa.binary()), pa.array(ids), pa.array(np.zeros(len(texts), dtype=np.int64)), doc], names=["token", "rid", "k", "doc"])
                tokens = [w for t in tails for w in t]
                if tokens:
                    owner = np.repeat(ids, [len(t) for t in tails])
                    times = np.fromiter((c for t in tails for c in t.values()), dtype=np.int64, count=len(tokens))
                    yield pa.RecordBatch.from_arrays([pa.array(tokens, type=pa.binary()), pa.array(owner), pa.array(times), pa.nulls(len(tokens), doc.type)], names=["token", "rid", "k", "doc"])

    rows = given.mapInArrow(run, f"token binary, rid bigint, k bigint, doc {head}")
    joined = rows.join(counts, "token", "left")
    add = F.when(F.col("k") > 0, F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 1)).otherwise(0.0)
    summed = joined.groupBy("rid").agg(F.max("doc").alias("doc"), F.sum(add).alias("rare"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("rare_known"))
    floor = math.log10(v.tokens + v.types + 1)
    return summed.select(
        "doc.row.*",
        F.col("doc.n").alias("n_tokens"),
        (F.col("doc.known").cast("long") + F.col("rare_known")).alias("n_known"),
        F.lit(int(v.tokens)).cast("long").alias("train_tokens"),
        F.round(F.col("doc.base") + F.col("rare") - F.col("doc.n") * F.lit(floor), 6).alias("base_score"),
        F.round(F.col("doc.score") + F.col("rare"), 6).alias("score"),
    )


def fit(train: DataFrame, *, text: str = "text", rounds: int = 2, head: int = 1 << 18, frequent: int = 1535, buckets: int = 512) -> tuple[DataFrame, Scorer]:
    """Counts of the training texts and the trained model."""
    counts = stored(count_tokens(train, text), "token-counts")
    v = Vocabulary(counts, head=head, frequent=frequent, buckets=buckets)
    shares = (v.class_counts() + 1) / (v.class_counts() + 1).sum()
    p = Parameters(shares)
    turn = F.pmod(F.xxhash64(F.length(text), F.crc32(F.col(text).cast("binary"))), F.lit(rounds))
    for k in range(rounds):
        train_round(train.filter(F.coalesce(turn, F.lit(0)) == k), text, v, p, seed=k)
    return counts, Scorer(v, p)


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 7) == 2
    counts, scorer = fit(docs.filter(~held))
    return score_texts(docs, counts, scorer, keep=[F.col("doc_id"), held.alias("held_out")], text="text")
