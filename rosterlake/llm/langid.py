"""Language identification by a linear-chain conditional random field over words.

Every word has a hidden language. Emissions add up weights of byte n-grams with word boundaries (so affixes count), of
the whole word, and of its presence in each language's lexicon; transitions between neighbours are learned. Training
sequences splice segments of documents of several languages, so the chain meets switches. Forward-backward gives
every word its marginals; a text's language is the one with the largest mean marginal, its score that mean.

The fit takes at most about `sample` documents of each language, drawn by the hash of their text, copies once, and up to
`pieces` x `words` words of each in segments spread evenly over the whole text (documented bounds); nothing else reaches
the driver but the count of each language. Prediction is one narrow stage over whole texts: all words and all of
their n-grams count. Long texts are walked in pieces of PIECE words at once, joined by exact messages at their ends.

Defined cases: null texts and texts without a letter are `und` with score 0, as is everything when no labelled text was
given; ties go to the first language by name; repeated rows are labelled each; empty tables give no rows; language,
source and id are never inputs of a prediction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, prepare, remainder, table

CELLS = 1 << 17
PIECE = 1024  # words of a long text that are walked one after another; its pieces are walked side by side
_LETTERS = bytes(c if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def letter_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of letters (and of what is beyond ASCII)."""
    if not text:
        return []
    return text.decode("utf-8", "replace").lower().encode().translate(_LETTERS).split()


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(c.isalpha() for c in text.decode("utf-8", "replace")))


class Features:
    """Cells of a list of words, with the word that each belongs to: all n-grams of a word in its boundary marks, and the word."""

    def __init__(self, words: list[bytes], shortest: int = 2, longest: int = 4):
        marked = b"".join(b"^" + w + b"$" for w in words)
        b = np.frombuffer(marked, dtype=np.uint8).astype(np.uint32)
        sizes = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(b))  # bytes of the word from here on
        cells, owner, h = [], [], b
        for n in range(2, longest + 1):
            h = h[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(n)
            if n >= shortest:
                inside = left[: len(h)] >= n
                cells.append((h[inside] * np.uint32(0x9E3779B1)) >> np.uint32(15))
                owner.append(word[: len(h)][inside])
        cells.append(np.fromiter((xxhash.xxh32_intdigest(w) for w in words), dtype=np.uint32, count=len(words)) >> np.uint32(15))
        owner.append(np.arange(len(words)))
        self.cells, self.owner = np.concatenate(cells).astype(np.int64), np.concatenate(owner)


def chain_marginals(emissions: np.ndarray, starts: np.ndarray, sizes: np.ndarray, transition: np.ndarray, *, want_behind: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward over packed sequences: rows starts[i] .. starts[i] + sizes[i] of emissions are sequence i.

    Returns the marginals and, if wanted, what comes to each word from behind (its backward message times its own
    evidence). A sequence of more than two PIECEs is cut into such, whose messages at the ends come from the products of
    their words' matrices; then all sequences advance together, those that have ended drop out. Messages are scaled to sum 1.
    """
    p = np.exp(emissions - emissions.max(1, keepdims=True)).astype(np.float32)
    t = np.exp(transition - transition.max()).astype(np.float32)
    n = len(t)
    before = np.full((len(sizes), n), np.nan, dtype=np.float32)  # message into a first word; NaN: it has none before it
    after = np.ones((len(sizes), n), dtype=np.float32)  # message into a last word from behind
    long = sizes > 2 * PIECE
    if long.any():
        rest = ~long
        parts = ((starts[rest], sizes[rest], before[rest], after[rest]), _pieces(p, t, starts[long], sizes[long]))
        starts, sizes, before, after = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes, before, after = starts[order], sizes[order], before[order], after[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # sequences longer than each step
    forward, state = np.empty_like(p), None
    for i in range(longest):
        k = int(active[i])
        at = starts[:k] + i
        state = np.where(np.isnan(before), 1, before)[:k] * p[at] if state is None else (state[:k] @ t) * p[at]
        state /= state.sum(1, keepdims=True)
        forward[at] = state
    back = after[:0]
    out, behind = forward, np.empty_like(p) if want_behind else None
    for i in range(longest - 1, -1, -1):
        k = int(active[i])
        at = starts[:k] + i
        if k > len(back):
            back = np.concatenate([back, after[len(back) : k]])
        both = out[at] * back
        out[at] = both / both.sum(1, keepdims=True)
        back = back * p[at]
        if behind is not None:
            behind[at] = back
        back = back @ t.T
        back /= back.sum(1, keepdims=True)
    return out, behind


def _pieces(p: np.ndarray, t: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts and sizes of the PIECEs of sequences, the messages into their first words, and into their last from behind."""
    n, counts = len(t), -(-sizes // PIECE)
    first = np.cumsum(counts) - counts
    within = np.arange(counts.sum()) - np.repeat(first, counts)
    at, length = np.repeat(starts, counts) + PIECE * within, np.minimum(PIECE, np.repeat(sizes, counts) - PIECE * within)
    product = np.broadcast_to(np.eye(n), (len(at), n, n)).copy()
    for i in range(PIECE):  # of every word's matrix: the transition into it (none into a sequence's first), then its evidence
        k = np.flatnonzero(length > i)
        x = product[k] @ t
        if not i:
            x[first] = product[first]
        x *= p[at[k] + i][:, None, :]
        product[k] = x / x.max((1, 2), keepdims=True)
    before, after = np.full((len(at), n), np.nan), np.ones((len(at), n))
    for a, count in zip(first.tolist(), counts.tolist(), strict=True):
        state, behind = np.ones(n), np.ones(n)
        for j in range(a + 1, a + count):
            state = state @ product[j - 1]
            state /= state.sum()
            before[j] = state @ t
        for j in range(a + count - 1, a, -1):
            behind = product[j] @ behind
            behind /= behind.sum()
            after[j - 1] = behind
    return at, length, before.astype(np.float32), after.astype(np.float32)


class LanguageModel:
    def __init__(self, texts: list[tuple[str, list[bytes]]], *, rounds: int = 2, seed: int = 5, length: int = 64, batch: int = 256, lexicon: int = 1000):
        self.langs = sorted({lang for lang, w in texts if w})
        n = len(self.langs)
        if not n:
            return
        index = {x: i for i, x in enumerate(self.langs)}
        counts = [Counter() for _ in self.langs]
        segments: list[tuple[int, list[bytes]]] = []
        rng = np.random.default_rng(seed)
        for lang, words in texts:
            if not words:
                continue
            counts[index[lang]].update(words)
            at = 0
            while at < len(words):
                step = int(rng.integers(6, 48))
                segments.append((index[lang], words[at : at + step]))
                at += step
        self.lexicon: dict[bytes, list[int]] = {}
        for i, c in enumerate(counts):
            for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:lexicon]:
                self.lexicon.setdefault(w, []).append(i)
        self.weights = np.zeros((CELLS, n), dtype=np.float32)
        self.lexical = np.zeros((n, n), dtype=np.float32)
        self.transition = np.zeros((n, n), dtype=np.float32)
        self._train(segments, rng, rounds, length, batch)

    def emissions(self, words: list[bytes], features: Features | None = None) -> np.ndarray:
        f = features or Features(words)
        got = np.stack([np.bincount(f.owner, weights=self.weights[f.cells, k], minlength=len(words)) for k in range(len(self.langs))], 1).astype(np.float32)
        for i, w in enumerate(words):
            for lang in self.lexicon.get(w, ()):
                got[i] += self.lexical[lang]
        return got

    def _train(self, segments, rng, rounds: int, length: int, batch: int) -> None:
        """Stochastic gradients of the chain's log-likelihood, steps scaled by Adagrad."""
        n = len(self.langs)
        squares = [np.full(x.shape, 1e-2, dtype=np.float32) for x in (self.weights, self.lexical, self.transition)]
        for _ in range(rounds):
            order = rng.permutation(len(segments))
            words = [w for i in order for w in segments[i][1]]
            labels = np.concatenate([np.full(len(segments[i][1]), segments[i][0]) for i in order])
            size = batch * length
            for a in range(0, len(words), size):
                part, y = words[a : a + size], labels[a : a + size]
                ids: dict[bytes, int] = {}
                back = np.fromiter((ids.setdefault(w, len(ids)) for w in part), dtype=np.int64, count=len(part))
                unique = list(ids)
                f = Features(unique)
                e = self.emissions(unique, f)[back]
                starts = np.arange(0, len(part), length)
                sizes = np.minimum(length, len(part) - starts)
                m, behind = chain_marginals(e, starts, sizes, self.transition, want_behind=True)
                gradient = -m
                gradient[np.arange(len(part)), y] += 1
                by_word = np.stack([np.bincount(back, weights=gradient[:, k], minlength=len(unique)) for k in range(n)], 1)
                by_cell = np.stack([np.bincount(f.cells, weights=by_word[f.owner, k], minlength=CELLS) for k in range(n)], 1)
                lexical = np.zeros_like(self.lexical)
                for i, w in enumerate(unique):
                    for lang in self.lexicon.get(w, ()):
                        lexical[lang] += by_word[i]
                moves = self._moves(y, m, behind, e, starts)
                for x, g, s in zip((self.weights, self.lexical, self.transition), (by_cell, lexical, moves), squares, strict=True):
                    s += (g * g).astype(np.float32)
                    x += (0.3 * g / np.sqrt(s)).astype(np.float32)

    def _moves(self, y, m, behind, e, starts) -> np.ndarray:
        """Seen moves between neighbours' languages, less those that the chain expects."""
        n = len(self.langs)
        inner = np.ones(len(y), dtype=bool)
        inner[starts] = False
        here = np.flatnonzero(inner)
        moves = np.bincount(y[here - 1] * n + y[here], minlength=n * n).reshape(n, n).astype(np.float64)
        t, p = np.exp(self.transition), np.exp(e - e.max(1, keepdims=True))
        # forward message: the marginal without what comes from behind, the word's own evidence kept
        forward = m * p / np.maximum(behind, 1e-30)
        for a in range(0, len(here), 8192):
            h = here[a : a + 8192]
            joint = forward[h - 1][:, :, None] * t[None] * behind[h][:, None, :]
            moves -= (joint / np.maximum(joint.sum((1, 2), keepdims=True), 1e-30)).sum(0)
        return moves

    def predict(self, texts: list[bytes | None], memory: dict[bytes, int], rows: list[np.ndarray]) -> list[tuple[str, float]]:
        """(language, score) of each text. memory and rows keep the emissions of words met before."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.langs:
            return out
        split = [letter_words(x) for x in texts]
        if len(memory) > 250_000:
            memory.clear()
            rows[0] = rows[0][:0]
        fresh = list({w for ws in split for w in ws}.difference(memory))
        for part in batches_of(fresh):
            base = len(memory)
            memory.update(zip(part, range(base, base + len(part)), strict=True))
            rows[0] = np.concatenate([rows[0], self.emissions(part)])
        sizes = np.array([len(ws) for ws in split])
        starts = np.cumsum(sizes) - sizes
        ids = np.fromiter((memory[w] for ws in split for w in ws), dtype=np.int64, count=int(sizes.sum()))
        some = np.flatnonzero(sizes > 0)
        if not len(some):
            return out
        m, _ = chain_marginals(rows[0][ids], starts[some], sizes[some], self.transition)
        mean = np.add.reduceat(m, starts[some], axis=0, dtype=np.float64) / sizes[some][:, None]
        for i, row in zip(some.tolist(), mean, strict=True):
            if has_letter(texts[i]):
                k = int(row.argmax())
                out[i] = (self.langs[k], float(min(1.0, row[k])))
        return out


def batches_of(words: list[bytes], most: int = 8_192, size: int = 1 << 17) -> Iterator[list[bytes]]:
    """Words in lists of at most `most` words and about `size` bytes."""
    part, held = [], 0
    for w in words:
        part.append(w)
        held += len(w)
        if len(part) == most or held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def spread(words: list[bytes], pieces: int = 40, size: int = 16) -> list[bytes]:
    """All words, or `pieces` runs of `size` words at even distances over the text."""
    if len(words) <= pieces * size:
        return words
    places = (k * (len(words) - size) // (pieces - 1) for k in range(pieces))
    return [w for at in places for w in words[at : at + size]]


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", sample: int = 400, pieces: int = 40, words: int = 16, word_bytes: int = 64) -> LanguageModel:
    """Fits on rows (text, lang), about `sample` of each language, with up to `pieces` runs of `words` words of each text, of a word its first
    `word_bytes`: what is gathered is bounded for each language. Predictions see whole words."""
    prepare(docs.sparkSession)
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    totals = known.groupBy(F.col(lang).alias("_lang")).agg((F.lit(float(sample)) * (1 << 30) / F.count(F.lit(1))).alias("_most"))
    totals = F.broadcast(totals) if totals.limit((1 << 16) + 1).count() <= 1 << 16 else totals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[str, bytes]] = set()  # copies count once, here and over all tasks
        for batch in batches:
            got = {(a, b" ".join(w[:word_bytes] for w in spread(letter_words(x), pieces, words))) for a, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)} - sent
            sent |= got
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], type=t) for i, t in ((0, pa.string()), (1, pa.binary()))], names=["lang", "words"])

    drawn = known.join(totals, F.col(lang) == F.col("_lang")).filter(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < F.col("_most"))
    rows = drawn.select(F.col(lang).alias("lang"), F.col(text).cast("binary")).mapInArrow(run, "lang string, words binary").distinct().collect()
    return LanguageModel([(a, w.split()) for a, w in sorted((r[0], bytes(r[1])) for r in rows)])


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", keep=None) -> DataFrame:
    """`keep` (default: all columns) with lang_pred and lang_score."""

    def make():
        memory: dict[bytes, int] = {}
        rows = [np.zeros((0, max(1, len(model.langs))), dtype=np.float32)]

        def f(texts: list[bytes | None]) -> list:
            got = model.predict(texts, memory, rows)
            return [[g[0] for g in got], [g[1] for g in got]]

        return f

    return map_texts(docs, text, make, "lang_pred string, lang_score double", keep=keep, limit=3 << 20)


def retain(docs: DataFrame, model: LanguageModel, *, min_score: float, text: str = "text") -> DataFrame:
    """The rows, with their columns, that have a language with a score of min_score or more."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    got = identify(plain, model, text=f"c{names.index(text)}")
    return got.filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= min_score)).drop("lang_pred", "lang_score").toDF(*names)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 4) == 2
    got = identify(docs, fit(docs.filter(~held)), keep=[F.col("doc_id")])
    return got.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
