"""Order-dependent operators on groups that a task should not have to hold, against plain loops."""

import random

from pyspark.sql import functions as F

from rosterlake.functions.folds import scanned
from rosterlake.operators import ordered
from rosterlake.plans import lists


def test_states_of_a_fold(spark):
    rows = [(i, list(range(n))) for i, n in enumerate((0, 1, 255, 256, 257, 1000))]
    got = spark.createDataFrame(rows, "i int, xs array<int>").select("i", scanned(F.col("xs"), F.lit(0), lambda s, x: s + x, "int").alias("s")).collect()
    for r in got:
        n = len(rows[r["i"]][1])
        assert r["s"] == [k * (k + 1) // 2 for k in range(n)]


def test_anchors_of_a_long_page_equal_a_loop(spark):
    rng = random.Random(1)
    places = sorted({round(rng.uniform(0, 50_000), 2) for _ in range(30_000)}, reverse=True)
    df = spark.createDataFrame([(1, p) for p in places] + [(1, p) for p in places[:50]], "page int, y double").repartition(4)
    got = {r["y"]: r["cluster"] for r in ordered.anchor_clusters(df, "y", 3.0, by=["page"]).collect()}
    n, anchor = 0, None
    for p in places:
        if anchor is None or anchor - p >= 3.0:
            n, anchor = n + 1, p
        assert got[p] == n


def test_a_machine_over_one_large_block_equals_a_loop(spark):
    rng = random.Random(2)
    table = [[rng.randrange(4) for _ in range(4)] for _ in range(7)]
    kinds = {(g, o): rng.randrange(7) for g, n in ((0, 60_000), (1, 3), (2, 5000)) for o in rng.sample(range(3 * n), n)}
    df = spark.createDataFrame([(*k, v) for k, v in kinds.items()], "g int, o long, kind int").repartition(4)
    out = ordered.run_machine(df, F.col("kind"), table, by=["g"], ord="o", chunk=256)
    got = {(r["g"], r["o"]): r["state"] for r in out.collect()}
    assert len(got) == len(kinds)
    for g in range(3):
        state = 0
        for k in sorted(k for k in kinds if k[0] == g):
            assert got[k] == state
            state = table[kinds[k]][state]
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # so small a table would be one part
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        again = ordered.run_machine(df, F.col("kind"), table, by=["g"], ord="o", chunk=256)
        assert again.filter("g = 0").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        for k in held:
            spark.conf.unset(k)
    numbered = ordered.block_number_in_chunks(df, F.col("kind") == 0, by=["g"], ord="o", chunk=256)
    plain = ordered.block_number(df, F.col("kind") == 0, by=["g"], ord=["o"])
    assert sorted(map(tuple, numbered.select("g", "o", "blk").collect())) == sorted(map(tuple, plain.select("g", "o", "blk").collect()))


def test_cells_of_a_block_act_as_the_sequence_says(spark):
    """Acts of random cells by a loop over the four states."""
    rng = random.Random(7)
    texts = {"stop": "[note]", "more": "Subordinate institution", "fr": "79 FR 1234, x", "": "Acme Co", ", licensed": "All items", "more, licensed": "Addresses for x subject to the EAR"}
    cells, rows = [("p", 0, "CHINA")], []
    state = 0
    for i in range(1, 3000):
        kind = rng.choice(list(texts))
        cells.append(("p", i, texts[kind]))
        licensed, base = kind.endswith("licensed"), kind.split(",")[0]
        if kind == "stop":
            state = 0
        elif state == 0 or state == 3 and base != "more":
            rows.append([texts[kind]])
            state = 1
        elif state == 3 or state == 1 and not licensed:
            rows[-1].append(texts[kind])
        elif state == 1:
            state = 2
        elif base == "fr":
            state = 3
    df = spark.createDataFrame(cells, "path string, cell long, text string").withColumn("lines", F.array("text"))
    got = [r["lines"] for r in lists.entity_list_rows(df).orderBy("row_no").collect()]
    assert got == rows
