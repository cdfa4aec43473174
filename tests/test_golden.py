"""Search over published list documents: known counts of records, scores and groups."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rosterlake.operators import checks, search
from rosterlake.sources import files, sinks

HERE = Path(__file__).parent / "fixtures"
COUNTS = {"bis-meu": 70, "cbp-wro": 67, "fcc-covered": 15, "ofac-eo14032": 59, "state-debarred-admin": 8}
#: query: ({score: records}, groups)
RESULTS = {
    "Huawei": ({85: 3}, 3), "Beihang University": ({}, 0), "aviation": ({85: 1, 70: 16, 55: 1, 25: 7}, 25), "Kaspersky": ({85: 1, 70: 1}, 2),
    "china mobile": ({85: 3}, 3), "harbin aircraft": ({70: 1}, 1), "seafood": ({25: 6}, 5), "zzz": ({}, 0),
}


@pytest.fixture(scope="module")
def entities(spark):
    rows, missing = files.read_documents(spark, *[str(HERE / f"{x}.json") for x in COUNTS], str(HERE / "none.json"))
    assert missing == [str(HERE / "none.json")]
    return rows.cache()


@pytest.fixture(scope="module")
def idx(entities):
    return search.index(entities).cache()


def test_counts_of_lists(entities, idx):
    assert {r["l"]: r["n_records"] for r in search.counts_by_list(idx).collect()} == COUNTS
    assert idx.select("nn").distinct().count() == 212
    again = checks.repeated(idx.select("nn", "l"), "nn").collect()
    assert len(again) == 7 and all(r["n"] == 2 for r in again)


@pytest.mark.parametrize("q", list(RESULTS))
def test_known_results(idx, q):
    scores, groups = RESULTS[q]
    plain = search.normalized(q)
    tiers = idx.select(search.score(F.lit(plain), F.col("nn"), F.col("k"), F.col("x")).alias("s")).filter("s > 0").groupBy("s").count()
    assert {r["s"]: r["count"] for r in tiers.collect()} == scores
    assert search.search(idx, q).count() == groups


def test_screening_finds_the_same_records(spark, idx):
    asked = spark.createDataFrame([(q, q) for q in RESULTS], "qid string, q string")
    got = {(r["qid"], r["score"]): r["count"] for r in search.screen(idx, asked).groupBy("qid", "score").count().collect()}
    assert got == {(q, s): n for q, (scores, _) in RESULTS.items() for s, n in scores.items()}


def test_documents_are_written_as_they_came(entities, tmp_path):
    """Files of published lists; one of them was published without a last line end."""
    for x in COUNTS:
        wanted = (HERE / f"{x}.json").read_text()
        source = wanted.split('"source_file": "')[1].split('"')[0]
        extracted = wanted.split('"extracted": "')[1].split('"')[0]
        rows = entities.filter(F.col("list_id") == x).withColumn("source_file", F.lit(source)).repartition(3)
        sinks.write_documents(rows, str(tmp_path), extracted=extracted, newline=wanted.endswith("\n"))
        assert (tmp_path / f"{x.replace('-', '_')}.json").read_text() == wanted
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(f"{x.replace('-', '_')}.json" for x in COUNTS)
