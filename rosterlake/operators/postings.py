"""The search index inverted: which rows hold which words, and which words hold which pieces. Kept as tables, it answers without a scan.

A word of a query matches inside a word of a row (words have no blanks), so two steps find its rows: the words of the corpus that
contain it, by its rarest piece of up to three characters; then the rows that hold these words. Rows are named by (l, ord) all the way; their fields are read once, for
rows that hold the query's rarest word, and scored.

Tables of an inverted index, each dealt into `buckets` folders by what it is looked up by:
- rows: the index (see search.index), by (l, ord);
- postings: (w, l, ord), by w;
- pieces: (g, w, n), words with the number of their rows, by piece g;
- frequency: (g, n), how many rows hold a piece; at most 47,988 rows, as pieces are of 36 characters, one to three.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words and candidates up to so many are looked up by bucket; beyond, tables are joined.
FEW = 1 << 16


class Inverted(NamedTuple):
    rows: DataFrame
    postings: DataFrame
    pieces: DataFrame
    frequency: DataFrame
    buckets: int = 0  # 0: not written


def grams(words: Column, *sizes: int) -> Column:
    """Distinct substrings of these sizes of each word."""

    def of(n: int) -> Column:
        places = lambda t: F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - n + 1))
        long = F.filter(words, lambda t: F.length(t) >= n)
        return F.flatten(F.transform(long, lambda t: F.transform(places(t), lambda i: F.substr(t, i, F.lit(n)))))

    return F.array_distinct(F.concat(*map(of, sizes)))


def bucket(buckets: int, *columns: Column | str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def words_of(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(text, " ")), lambda w: w != "")


def vocabulary(postings: DataFrame) -> DataFrame:
    """(w, n): words with the number of rows that hold them, from a row for each word of each."""
    return postings.groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def pieces_of(words: DataFrame) -> DataFrame:
    """(g, w, n): words under each of their pieces."""
    return words.select("w", "n", F.explode(grams(F.array("w"), 1, 2, 3)).alias("g")).select("g", "w", "n")


def frequencies(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("g").agg(F.sum("n").alias("n"))


def invert(idx: DataFrame) -> Inverted:
    """The inverted index of index rows, not written."""
    postings = idx.select("l", "ord", F.explode(words_of(F.concat_ws(" ", "k", "x"))).alias("w")).select("w", "l", "ord")
    pieces = pieces_of(vocabulary(postings))
    return Inverted(idx, postings, pieces, frequencies(pieces))


def write(idx: DataFrame, path: str, *, buckets: int = 64) -> None:
    """Writes the inverted index of index rows. More rows want more buckets: some 100 MB each read well."""
    of = invert(idx)

    def put(df: DataFrame, name: str, *by: str) -> None:
        df.withColumn("b", bucket(buckets, *by)).repartition("b").sortWithinPartitions("b", *by).write.mode("overwrite").partitionBy("b").parquet(f"{path}/{name}")

    put(of.rows, "rows", "l", "ord")
    put(of.postings, "postings", "w")
    written = idx.sparkSession.read.parquet(f"{path}/postings")
    put(pieces_of(vocabulary(written)), "pieces", "g")
    frequencies(idx.sparkSession.read.parquet(f"{path}/pieces")).coalesce(1).write.mode("overwrite").parquet(f"{path}/frequency")
    idx.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").json(f"{path}/layout")


def read(spark: SparkSession, path: str) -> Inverted:
    buckets = spark.read.schema("buckets int").json(f"{path}/layout").first()["buckets"]
    return Inverted(*[spark.read.parquet(f"{path}/{t}") for t in ("rows", "postings", "pieces", "frequency")], buckets)


def holding(of: Inverted, tokens: DataFrame) -> DataFrame:
    """(tok, w, n): the words that contain a token (tok) anywhere."""
    asked = tokens.select("tok", F.explode(F.when(F.length("tok") < 3, F.array("tok")).otherwise(grams(F.array("tok"), 3))).alias("g"))
    best = asked.join(of.frequency, "g").groupBy("tok").agg(F.min_by("g", F.struct("n", "g")).alias("g"))
    key = ["g"]
    if of.buckets:
        best, key = best.withColumn("b", bucket(of.buckets, "g")), ["b", "g"]
    return of.pieces.join(best, key).filter(F.contains("w", F.col("tok"))).select("tok", "w", "n")


def meetings(of: Inverted, asked: DataFrame) -> DataFrame:
    """(qid, q, l, ord): the rows that hold the word of each normalized query (qid, q) that fewest rows can hold; none if a word has no rows.

    Names of rows alone meet; a query meets no row that lacks its rarest word.
    """
    tokens = asked.select("qid", "q", F.explode(words_of(F.col("q"))).alias("tok"))
    held = holding(of, tokens.select("tok").distinct())
    totals = held.groupBy("tok").agg(F.sum("n").alias("n"))
    best = tokens.join(totals, "tok", "left").groupBy("qid", "q").agg(F.min_by("tok", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "tok")).alias("tok"))
    words, key = best.join(held.select("tok", "w"), "tok").select("qid", "q", "w"), ["w"]
    if of.buckets:
        words, key = words.withColumn("b", bucket(of.buckets, "w")), ["b", "w"]
    return words.join(of.postings, key).select("qid", "q", "l", "ord").distinct()


def candidates(of: Inverted, tokens: list[str]) -> DataFrame:
    """The rows of a written index that may match a query of these words: those that hold its rarest. Only the buckets that they are in are read.

    What is gathered is bounded: pieces of the query's words with their counts, then up to FEW words, then up to FEW names of rows; where more
    words contain the rarest, or more rows hold these, tables are joined instead, as a good part of the index is asked for.
    """
    spark = of.rows.sparkSession
    pieces = {t: [t] if len(t) < 3 else [t[i : i + 3] for i in range(len(t) - 2)] for t in tokens}
    known = {r["g"]: r["n"] for r in of.frequency.filter(F.col("g").isin(*{g for gs in pieces.values() for g in gs})).collect()}
    rarest = {t: min(gs, key=lambda g: (known.get(g, 0), g)) for t, gs in pieces.items()}
    token = min(tokens, key=lambda t: (known.get(rarest[t], 0), t))
    folder = spark.range(1).select(bucket(of.buckets, F.lit(rarest[token]))).first()[0]
    words = of.pieces.filter((F.col("b") == folder) & (F.col("g") == rarest[token]) & F.contains("w", F.lit(token))).select("w", "n")
    some = words.limit(FEW + 1).collect()
    if len(some) > FEW:
        return of.rows.join(of.postings.join(words.select("w"), "w").select("l", "ord").distinct(), ["l", "ord"], "left_semi")
    names = _looked_up(of.postings, spark.createDataFrame([(r["w"],) for r in some], "w string"), ["w"], of.buckets).select("l", "ord").distinct()
    if sum(r["n"] for r in some) > FEW:
        return of.rows.join(names, ["l", "ord"], "left_semi")
    return _looked_up(of.rows, spark.createDataFrame(names.collect(), names.schema), ["l", "ord"], of.buckets)


def _looked_up(rows: DataFrame, keys: DataFrame, by: list[str], buckets: int) -> DataFrame:
    """The rows with one of a few keys, from the folders that these are in."""
    keys = keys.withColumn("b", bucket(buckets, *by))
    folders = sorted(r["b"] for r in keys.select("b").distinct().collect())
    return rows.filter(F.col("b").isin(folders)).join(F.broadcast(keys), ["b", *by], "left_semi")
