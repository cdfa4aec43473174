"""The pipeline: stages on odd rows, on an empty table, and end to end against plain Python."""

import os

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from rosterlake.llm.common import shared_dir, written

from .conftest import SF
from .test_operators import brute, plain_hits


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "secret_scan", "mix_sources"]


def test_stages_keep_columns_and_take_odd_rows(spark, odd):
    """Odd rows come with nulls, ties, repeated rows, a long text, and extra columns of names that the stages use."""
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, odd, SF)
        assert got.columns == odd.columns and got.filter("may <> 'mine' OR row <> 'mine'").count() == 0, name
        assert stage(spark, odd.filter("false"), SF).count() == 0, name
    mixed = pipeline.mix_sources(spark, odd, SF)
    assert mixed.count() == odd.count() and mixed.filter("size = 0 AND taken > 0").count() == 0
    assert pipeline.mix_sources(spark, odd.filter("false"), SF).count() == 0


def shared_tables(spark):
    return set(os.listdir(shared_dir(spark)))


def test_run_equals_its_stages_in_plain_python(spark, docs):
    before, since = shared_tables(spark), written()
    got = pipeline.run(spark, SF).collect()
    assert [t.split("-")[1] for t in shared_tables(spark) - before] == ["mix_sources"] and written() == since + 1
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = [(d, t) for d, t in sorted(rows.items()) if any(c.isalpha() for c in t)]
    kept = {d for d, _, least in brute(left, 5) if d == least}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {d for d, _, hit, _ in plain_hits([(d, rows[d]) for d in kept], items) if not hit}
    assert {r["doc_id"] for r in got} == clean and len(got) == len(clean)
    assert sum(r["taken"] for r in got) > 1.4 * sum(r["size"] for r in got)


def test_secrets_are_gone_from_kept_texts(spark):
    before = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.col("text").rlike("AKIA[A-Z0-9]{16}|[0-9a-f]{24}"))
    assert before.count() > 0
    after = pipeline.secret_scan(spark, before, SF)
    assert after.filter(F.col("text").rlike("AKIA[A-Z0-9]{16}|[0-9a-f]{24}")).count() == 0 and after.count() == before.count()
