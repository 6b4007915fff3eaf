"""Block-wise scans equal plain windows, at tiny block sizes and with several levels."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lilt.operators.scan import Run, adjacent, attach, running


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [
        (key, i, rng.choice([None, rng.randint(-5, 5)]))
        for key, n in ((1, 97), (2, 1), (3, 16), (4, 33))
        for i in range(n)
    ]
    return spark.createDataFrame(data, "k long, i long, v long")


@pytest.mark.parametrize("blocks", [["i div 8"], ["i div 4", "i div 16"], ["i div 2", "i div 8", "i div 32"]])
def test_running(rows, blocks):
    runs = {
        "s": Run("sum", F.col("v")),
        "sx": Run("sum", F.col("v"), inclusive=False),
        "m": Run("max", F.col("v")),
        "nb": Run("min", F.col("v"), backward=True),
        "l": Run("last", F.col("v"), inclusive=False),
        "lb": Run("last", F.col("v"), backward=True),
    }
    got = running(rows, ["k"], "i", runs, blocks=[F.expr(b) for b in blocks])
    ahead, back = Window.partitionBy("k").orderBy("i"), Window.partitionBy("k").orderBy(F.desc("i"))
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    here = ahead.rowsBetween(Window.unboundedPreceding, 0)
    after = back.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select(
        "k", "i", "v",
        F.coalesce(F.sum("v").over(here), F.lit(0)).alias("s"),
        F.coalesce(F.sum("v").over(before), F.lit(0)).alias("sx"),
        F.max("v").over(here).alias("m"),
        F.min("v").over(after).alias("nb"),
        F.last("v", True).over(before).alias("l"),
        F.last("v", True).over(after).alias("lb"),
    )
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())


def test_adjacent(rows):
    got = adjacent(rows, ["k"], "i", lead={"n": F.col("v")}, lag={"p": F.col("v")}, rows=8)
    w = Window.partitionBy("k").orderBy("i")
    want = rows.withColumns({"n": F.lead("v").over(w), "p": F.lag("v").over(w)})
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_attach_keeps_every_row(spark, rows):
    lookup = spark.createDataFrame([(1, "a"), (3, "c")], "k long, name string")
    got = attach(rows, lookup, ["k"], F.expr("i div 8"))
    want = rows.join(lookup, "k", "left")
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_blocks_bound_window_partitions(rows):
    plan = running(rows, ["k"], "i", {"s": Run("sum", F.col("v"))})._jdf.queryExecution().optimizedPlan().toString()
    spec = [line for line in plan.splitlines() if "windowspecdefinition" in line and "_v_s" in line]
    assert spec and all("_blk0" in line for line in spec)
