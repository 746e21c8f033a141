import math

import pytest
from pyspark.sql import functions as F

from pairwright.functions import arrays as A


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_softmax_is_stable(spark):
    assert value(spark, A.softmax(lit(1000, 1000))) == [0.5, 0.5]
    assert value(spark, A.softmax(lit(0, math.log(3)))) == pytest.approx([0.25, 0.75])


def test_top_p_keeps_while_the_mass_before_is_small(spark):
    p = lit(0.1, 0.5, 0.3, 0.1)
    assert value(spark, A.kept_by_top_p(p, 0.5)) == [1, 2]
    assert value(spark, A.kept_by_top_p(p, 0.49)) == [1]
    assert value(spark, A.kept_by_top_p(p, 1.0, k=3)) == [1, 2, 0]
    assert value(spark, A.filtered(p, A.kept_by_top_p(p, 0.5))) == pytest.approx([0, 0.625, 0.375, 0])


def test_overlap_and_residual(spark):
    p, q = lit(0.5, 0.5, 0), lit(0.2, 0.7, 0.1)
    assert value(spark, A.overlap(p, q)) == pytest.approx(0.7)
    assert value(spark, A.residual(p, q)) == pytest.approx([1, 0, 0])
    assert value(spark, A.residual(p, p)) == [None, None, None]


def test_entropy_and_gap(spark):
    assert value(spark, A.entropy(lit(0.5, 0.5, 0))) == pytest.approx(math.log(2))
    assert value(spark, A.top_gap(lit(-1, -0.25, -3))) == 0.75


def test_early_exit(spark):
    probes = F.array(lit(0, 0), lit(-2, -2), lit(-0.01, -0.02))
    assert value(spark, A.early_exit(probes, 0.9)) == 2
    assert value(spark, A.early_exit(probes, 0.9, least=0)) == 0
    assert value(spark, A.early_exit(probes, 0.9999, least=1)) is None


def test_seeds_and_ratios(spark):
    assert value(spark, A.derived_seed(F.lit("gsm8k_17"), 4200000)) == 4200017
    rows = spark.createDataFrame([(0, 3), (2, 4), (4, 4)], "a int, b int")
    assert rows.agg(A.median_of_ratios("a", "b").alias("m")).first().m == 2.0
