"""Search against brute force, and against texts and groups of a size that a plan could stumble over."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rosterlake.operators import postings, search


def contained(docs, items):
    return Counter((i, d) for i, q in items for d, t in docs if q and q in t)


def test_containing_is_substring_search(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))
    text = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi)))
    docs = [(rng.choice([None, *range(30)]), text(0, 25)) for _ in range(60)]
    cut = lambda t: t[(a := rng.randint(0, len(t))) : a + rng.randint(1, 20)].strip()
    items = [(i % 70, q) for i, q in enumerate(["", "zz", "zz zz zz zz zz", "a", "b", *[cut(rng.choice(docs)[1]) for _ in range(120)]])]
    for most in (1 << 20, 0):
        got = search.containing(spark.createDataFrame(docs, "doc_id int, t string"), spark.createDataFrame(items, "item_id int, q string"), broadcast_rows=most)
        assert Counter((r["item_id"], r["doc_id"]) for r in got.collect()) == contained(docs, items)


def test_containing_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b c d")], "doc_id int, t string"), spark.createDataFrame([(1, "b c d")], "item_id int, q string")
    assert search.containing(docs, items.filter("false")).collect() == [] == search.containing(docs.filter("false"), items).collect()


def test_a_text_of_many_words_is_not_copied(spark):
    """100,000 distinct words, 700 KB: a row for each word with the text would be 70 GB."""
    long = " ".join(f"w{i}" for i in range(100_000))
    docs = spark.createDataFrame([(1, long), (2, "w1 w2")], "doc_id int, t string")
    items = spark.createDataFrame([(1, "w10 w11 w12 w13"), (2, "w1 w2"), (3, "99999"), (4, "4 w5 w6"), (5, "w2 w1 w0")], "item_id int, q string")
    got = {(r["item_id"], r["doc_id"]) for r in search.containing(docs, items).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (3, 1), (4, 1)}


def index_of(spark, n=400, seed=1):
    rng = random.Random(seed)
    words = ["alamo", "beta", "co", "group", "ltd", "sea", "seafood", "x1", "y", "zz9", "harbin", "aircraft"]
    rows = [(i, f"L{i % 3}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))), [" ".join(rng.choice(words) for _ in range(2)) for _ in range(rng.randint(0, 3))], rng.choice([None, "China", "Iran"]), rng.choice(words), None) for i in range(n)]
    df = spark.createDataFrame(rows, "ord long, list_id string, name string, aliases array<string>, country string, address string, notes string")
    return search.index(df.withColumns({c: F.lit(None).cast("string") for c in ("status", "effective_date", "federal_register")}))


QUERIES = ["alamo", "al", "a", "sea food", "seafood beta", "zz9 y", "o o o", "qq", "co group ltd", "harbin aircraft china", "1"]


def scanned(idx, q):
    tier = search.score(F.lit(search.normalized(q)), F.col("nn"), F.col("k"), F.col("x"))
    return sorted((r["l"], r["ord"], r["score"]) for r in idx.withColumn("score", tier).filter("score > 0").collect())


@pytest.fixture(scope="module")
def inverted(spark, tmp_path_factory):
    idx, path = index_of(spark).cache(), str(tmp_path_factory.mktemp("inverted"))
    postings.write(idx, path, buckets=8)
    return idx, postings.read(spark, path)


@pytest.mark.parametrize("few", [1 << 16, 3, 0])
def test_inverted_search_equals_a_scan(inverted, monkeypatch, few):
    monkeypatch.setattr(postings, "FEW", few)
    idx, of = inverted
    for q in QUERIES if few != 3 else QUERIES[:4]:
        got = search.matching(of, q)
        assert (sorted((r["l"], r["ord"], r["score"]) for r in got.collect()) if got is not None else None) == (scanned(idx, q) if len(q) > 1 else None)


def test_screening_equals_scans_over_either_index(spark, inverted):
    idx, of = inverted
    asked = spark.createDataFrame([(q, q) for q in QUERIES], "qid string, q string")
    wanted = sorted((q, *r) for q in QUERIES if len(q) > 1 for r in scanned(idx, q))
    for index in (idx, of):
        assert sorted((r["qid"], r["l"], r["ord"], r["score"]) for r in search.screen(index, asked).collect()) == wanted


def test_inverted_search_reads_only_the_folders_it_needs(inverted, capsys):
    _, of = inverted
    search.matching(of, "zz9 harbin").explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("PartitionFilters: [") >= 1 and "PartitionFilters: [b#" in plan.replace("isnotnull(", "") and "PartitionFilters: []" not in plan
    tokens = search.normalized("zz9 harbin").split()
    assert postings.candidates(of, tokens).count() < of.rows.count()


def test_pages_joined_are_the_whole_order(spark):
    groups = search.grouped(index_of(spark, 600).withColumn("score", (F.col("ord") % 3).cast("int")))
    wanted = [r["nn"] for r in search.ranked(groups, pages=100).collect()]
    got, last, left = [], None, None
    while True:
        page, seen = search.page_after(groups, last, page=13)
        rows = page.collect()
        got += [r["nn"] for r in rows]
        assert search.remaining(seen, 13) == len(wanted) - len(got)
        if not search.remaining(seen, 13):
            break
        last = rows[-1]
    assert got == wanted


def test_a_name_on_many_rows_is_one_small_group(spark):
    many = spark.range(200_000, numPartitions=8).select(F.col("id").alias("ord"), F.lit("L").alias("l"), F.lit("Same").alias("n"), F.lit("same").alias("nn"), F.lit(70).alias("score"), F.concat(F.lit("C"), (F.col("id") % 5).cast("string")).alias("c"), F.array((F.col("id") % 50_000).cast("string"), F.lit("x")).alias("a"), *[F.lit("").alias(x) for x in ("ad", "s", "d", "fr", "no")])
    groups = search.grouped(many)
    r = search.cards(many, groups).first()
    assert (r["n_recs"], r["n_lists"], r["countries"], r["aliases"], r["more_aliases"]) == (200_000, 1, ["C0", "C1", "C2", "C3", "C4"], ["0", "x", "1", "2", "3", "4", "5", "6"], True)
    assert search.records(many, groups).count() == 200_000
