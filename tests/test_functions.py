import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions.binomial import clopper_pearson_bounds
from plumbline.functions.columns import clean_number, invert_rigid, matmul, natural_key, parse_quantity, quaternion_matrix, segment_distance, wrap_angle


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "metres"), [("3.2 m", 3.2), ("320cm", 3.2), ("3,20 m", 3.2), ("1,234 mm", 1.234), ("10' 6\"", 3.2004), ("10 ft 6 in", 3.2004), ("7", 7.0), ("wide", None), ("", None)])
def test_quantities(spark, text, metres):
    got = one(spark, parse_quantity(F.lit(text)))
    assert got == (None if metres is None else pytest.approx(metres))


def test_unit_of_the_header_and_of_the_cell(spark):
    assert one(spark, parse_quantity(F.lit("12"), F.lit("cm"))) == pytest.approx(0.12)
    assert one(spark, parse_quantity(F.lit("12 m"), F.lit("cm"))) == 12


def test_numbers(spark):
    assert [one(spark, clean_number(F.lit(t))) for t in ("1,5", " 2 ", "x", "", "NaN", "inf")] == [1.5, 2.0, None, None, None, None]


def test_natural_order(spark):
    names = ["room 10", "Room 2", "room 2b", "room"]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_key(F.col("n")))
    assert [r.n for r in df.collect()] == ["room", "Room 2", "room 2b", "room 10"]


def test_angles_and_transforms(spark):
    assert one(spark, wrap_angle(F.lit(3.5 * math.pi), 2 * math.pi)) == pytest.approx(-0.5 * math.pi)
    t = [0.0, -1.0, 0.0, 2.0, 1.0, 0.0, 0.0, 3.0, 0.0, 0.0, 1.0, 4.0, 0.0, 0.0, 0.0, 1.0]
    a = F.array(*map(F.lit, t))
    assert one(spark, matmul(a, invert_rigid(a), 4)) == pytest.approx([float(i % 5 == 0) for i in range(16)])
    half = F.lit(math.sqrt(0.5))
    assert one(spark, quaternion_matrix(F.lit(0.0), F.lit(0.0), half, half)) == pytest.approx([0, -1, 0, 1, 0, 0, 0, 0, 1], abs=1e-12)
    assert one(spark, segment_distance(*map(F.lit, (1.0, 1.0, 0.0, 0.0, 4.0, 0.0)))) == 1.0


def test_exact_binomial():
    assert clopper_pearson_bounds(0, 0) == (0.0, 1.0)
    assert clopper_pearson_bounds(0, 10) == (0.0, pytest.approx(1 - 0.025 ** (1 / 10)))
    assert clopper_pearson_bounds(10, 10) == (pytest.approx(0.025 ** (1 / 10)), 1.0)
    lo, hi = clopper_pearson_bounds(479, 560)
    # the tails beyond the bounds hold 2.5 % each
    tail = lambda p, ks: sum(math.comb(560, k) * p**k * (1 - p) ** (560 - k) for k in ks)
    assert tail(lo, range(479, 561)) == pytest.approx(0.025)
    assert tail(hi, range(480)) == pytest.approx(0.025)
