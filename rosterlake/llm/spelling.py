"""Spelling variant grouping by asymmetric q-chunks.

Two words are near if one is the other with one code point inserted, deleted or replaced. A word of length m is cut into two
disjoint chunks, at 0 and q = m // 2; one edit harms one of them at most. What is intact is either the first chunk, in its place, or the second,
moved by the difference of the lengths, which is one at most. So one word contributes its two chunks, the other its positional grams at
the places that these can have, and they meet where they are equal; `near_pairs` verifies what met. The shorter word gives
the chunks (of two of a length, the first), so each pair meets in one direction only.

A chunk that many words have (a common beginning or ending) would bring all pairs of these together. So what a chunk leaves over is cut
in two again: one edit in it leaves its first half where it is or moves its last half with the word's end. Each chunk is looked up with one
and with the other half of the rest behind it; a key is then three quarters of the word, and a common chunk costs only what its
words' rests share. Nothing is lost by that. Pairs are verified inside the join, which puts out pairs of near words.

Counts: occurrences are summed map-side before words are shuffled, so that a word that a third of all rows hold is a row for each
task. Roots are found by doubling: a form has five times its word's occurrences, so chains have some 20 links at most.

Defined cases: null and empty texts have no runs; a null doc_id is written as nothing before the colon; repeated rows count each; a run
whose only code point is deleted is no word; letters beyond A-Z keep their case; ties of near words go to the first in code-point order
(that of UTF-8 bytes); very long runs are words like others, an edit in them is verified in linear time; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored, table

#: Runs of letters that are words. A fixed value.
RUNS = "[A-Za-zÀ-ÿ]+"


def runs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, run): every maximal run of letters, A-Z lower-cased, a row for each occurrence."""
    low = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    return docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all(low, F.lit(RUNS), F.lit(0))).alias("run"))


def misspelt(found: DataFrame) -> DataFrame:
    """(word): runs (doc_id, run), of which every 199th by crc32 of `doc_id:run` loses a code point."""
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.withColumn("h", h).select(F.when(F.col("h") % 199 == 0, cut).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, least_length: int, least: int) -> DataFrame:
    """(word, n): words of at least so many code points and occurrences."""
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _without(w: Column, m: Column, longer: int) -> list[Column]:
    """Keys of a word of length m + longer against chunks of words of length m: of each quarter, what is before and behind it."""
    q = F.floor(m / 2).cast("int")
    cuts = [F.lit(0), F.floor(q / 2).cast("int"), q, q + F.floor((m - q) / 2).cast("int"), m]
    # behind a quarter, places are counted from the word's end: there the edit has moved all by `longer`
    parts = [(F.substring(w, F.lit(1), cuts[i]), F.substring(w, cuts[i + 1] + 1 + longer, m - cuts[i + 1])) for i in range(4)]
    return [F.xxhash64(m, F.lit(i), before, behind) for i, (before, behind) in enumerate(parts)]


def chunk_keys(words: DataFrame) -> DataFrame:
    """(key, w, wn): each word (word, n) under its two chunks, each with one and the other half of the rest."""
    return words.select(F.explode(F.array(*_without(F.col("word"), F.length("word"), 0))).alias("key"), F.col("word").alias("w"), F.col("n").alias("wn"))


def gram_keys(words: DataFrame) -> DataFrame:
    """(key, v, vn): each word under its positional grams that chunks of words of its length, or one less, may have become."""
    m = F.length("word")
    keys = F.concat(*[F.array(*_without(F.col("word"), m - longer, longer)) for longer in (0, 1)])
    return words.select(F.explode(keys).alias("key"), F.col("word").alias("v"), F.col("n").alias("vn"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(w, wn, v, vn): pairs of near words (word, n), each once; v is longer, or of w's length and behind it in order."""
    longer = F.length("v") - F.length("w")
    near = ((longer == 1) | ((longer == 0) & (F.col("w") < F.col("v")))) & (F.levenshtein("w", "v", 1) == 1)
    chunks, grams = chunk_keys(words), gram_keys(words)
    return chunks.join(grams, (chunks["key"] == grams["key"]) & near).select("w", "wn", "v", "vn").distinct()


def variants(words: DataFrame, factor: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n): the near word of most occurrences, if it has `factor` times the word's."""
    pairs = near_pairs(words)
    both = pairs.select(F.col("w").alias("word"), F.col("v").alias("form"), F.col("vn").alias("form_n")).unionByName(pairs.select(F.col("v").alias("word"), F.col("w").alias("form"), F.col("wn").alias("form_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("least"), "form")).alias("best"))
    fits = -F.col("best.least") >= factor * F.col("n")
    named = words.join(best, "word", "left").select("word", F.when(fits, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, -F.col("best.least")).alias("form_n"))
    named = stored(named, "forms")
    return named.join(roots(named.filter("form IS NOT NULL").select("word", "form")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where the links (word, form; no circles) from each word end. Each round follows twice as many links as the one before."""
    reached = links.select("word", F.col("form").alias("root"))
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = stored(reached.join(onward, "root", "left"), "roots")
        if ahead.filter("next IS NOT NULL").isEmpty():
            return ahead.select("word", "root")
        reached = ahead.select("word", F.coalesce("next", "root").alias("root"))


def grouped(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_length: int = 6, least: int = 5, factor: int = 5, prepared=misspelt) -> DataFrame:
    """The words of the texts with their forms and roots (see variants). prepared: (doc_id, run) -> (word)."""
    words = stored(counted(prepared(runs(docs, doc_id, text)), least_length, least), "words")
    return variants(words, factor)


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"))


#: crc32 by a table of the 256 bytes' remainders; near words by what is left when a code point goes.
OP13_SQL = r"""
WITH RECURSIVE tbl AS (SELECT list(r ORDER BY b) AS t FROM (SELECT b, list_reduce(list_concat([CAST(b AS BIGINT)], range(8)), lambda x, j: xor(x >> 1, 3988292384 * (x & 1))) AS r FROM (SELECT unnest(range(256)) AS b))),
run AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
each AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS k, w, count(*) AS c FROM run GROUP BY ALL),
crc AS (SELECT w, c, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(k, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END))), lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1]))) AS h FROM each, tbl),
word AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, c FROM crc),
n AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM word WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
gone AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM n)),
near AS (SELECT DISTINCT a.word, b.word AS form, b.n AS form_n FROM gone a JOIN gone b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, n.word, n.n FROM gone g JOIN n ON n.word = g.d UNION SELECT n.word, g.word, g.n FROM gone g JOIN n ON n.word = g.d),
best AS (SELECT word, count(*) AS n_near, min({'m': -form_n, 'f': form}) AS b FROM near GROUP BY word),
form AS (SELECT n.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.b.m >= 5 * n THEN b.b.f END AS form, CASE WHEN -b.b.m >= 5 * n THEN -b.b.m END AS form_n FROM n LEFT JOIN best b USING (word)),
walk AS (SELECT word, word AS root, form AS next FROM form UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN form f ON f.word = w.next)
SELECT f.word, form, root, n, n_near, form_n FROM form f JOIN walk w ON w.word = f.word AND w.next IS NULL
"""
