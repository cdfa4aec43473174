"""What the operators share."""

from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from rosterlake.llm import common


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 2000])
def test_running_sums_and_maxima(spark, n):
    values = [(i * 37) % 101 for i in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    sums, most = df.select(common.running(F.col("v"), lambda a, x: a + x), common.running(F.col("v"), lambda a, x: F.greatest(a, x), block=7)).first()
    assert sums == [0, *accumulate(values)] and most == [0, *accumulate(values, max)]


def test_pieces_cut_by_code_points(spark):
    text = "aé𝒳中\n" * 500
    cuts = [(0, 0), (0, 1), (3, 700), (511, 513), (512, 1024), (2499, 2500), (5, 2), (2500, 2500)]
    df = spark.createDataFrame([(text, cuts)], "t string, c array<struct<start:int,end:int>>")
    assert df.select(common.pieces(F.col("t"), F.col("c"))).first()[0] == [text[a:b] for a, b in cuts]


def test_hot_join_is_a_left_join(spark):
    rows = spark.createDataFrame([(1 if i < 60 else i, i) for i in range(100)] + [(-5, 1)], "k long, v long")
    values = spark.createDataFrame([(k, k * 10) for k in range(0, 100, 2)] + [(1, 10)], "k long, w long")
    wanted = sorted(map(tuple, rows.join(values, "k", "left").collect()), key=str)
    for parts in (2, 50, 4096):
        hot = common.hot_keys(rows, "k", parts=parts)
        assert hot.count() == 1 and sorted(map(tuple, common.hot_join(rows, values, "k", hot).collect()), key=str) == wanted
    assert common.hot_keys(rows.filter("false"), "k").count() == 0


def test_slices_are_bounded():
    import pyarrow as pa

    texts = pa.array([b"x" * n for n in (5, 5, 30, 1, 1, 1)] + [None], type=pa.binary())
    got = list(common.slices(texts, 10))
    assert [at for at, _ in got] == [0, 2, 3] and sum((x for _, x in got), []) == texts.to_pylist()
